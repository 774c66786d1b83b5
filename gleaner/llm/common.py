"""Shared helpers of the training-data operators: written tables, slices of Arrow batches, words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table, spread

#: A word: a maximal run of characters other than space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of texts with fewer splits than cores is dealt over them."""
    df = read_table(spark, sf_dir, name)
    return spread(df) if name in ("documents", "pages") else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on this machine alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/gleaner/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            removed(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            pass

    atexit.register(remove)
    return path


def written(df: DataFrame, name: str, **options: int | str) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder as Parquet, with a writer's options, and read it again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, *names: str) -> None:
    """ValueError if `df` has one of the columns that an operator adds; names are compared as Spark does, whatever their case."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the input has columns named {', '.join(sorted(taken))}")


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for `rows` rows of `each` a partition, at least the session's own count."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that `column` (null: empty) holds about `most` bytes in each piece, or one row."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text with A-Z in lower case: text ends (offsets), codes and the batch's distinct words."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    counts = np.concatenate([[0], np.cumsum(keep)])
    raw = split.offsets.to_numpy()
    ends = counts[raw - raw[0]]
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    lower = pc.ascii_lower(coded.dictionary).dictionary_encode()  # not of the texts: pyarrow 23 garbles slices of large strings
    to_lower = lower.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return ends, to_lower[coded.indices.to_numpy(zero_copy_only=False)], lower.dictionary


def hashes(words: pa.Array) -> np.ndarray:
    """A fixed 64-bit hash of each string."""
    return pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null, inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and an executor's memory is shared by all of them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
