"""Mergeable bottom-k sketches: k uniform rows without replacement for each of many replicates, in one pass and without copies of rows.

A row's MD5 gives a number x below the prime `PRIME`; replicate r ranks rows by (a x + b) mod PRIME, with a and b of its own, from MD5 too. For any
a and b the ranks of rows are as uniform as x is, so each replicate's k least are a uniform sample. A rank, further bits of the MD5 and the value are one
64-bit number, which is all that a sketch keeps: k numbers for each group and replicate, whatever the rows. Each task folds its rows into
sketches, sketches of `FAN` tasks are merged into one, level by level; the k least of the union are the k least of the k least, so the
sample depends on the rows alone, exactly as if a window had ranked all rows for each replicate.

Rows without an id, or with a value that is not 0 to 7, take no part. Repeated rows count each. A group of k rows or fewer gives all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .similarity import types_of

PRIME = 2**31 - 1
FAN = 32
#: Replicates of one row of sketches, rows that are ranked at once, and bytes of sketches that a task holds before it passes them on.
REPLICATES = 50
ROWS = 1024
HELD = 64 << 20


def _md5(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def factors(replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """a (1 to PRIME - 1) and b of each replicate."""
    a = [1 + _md5(f"{seed}:a:{r}") % (PRIME - 1) for r in range(replicates)]
    return np.array(a, np.int64), np.array([_md5(f"{seed}:b:{r}") % PRIME for r in range(replicates)], np.int64)


def _digits(seed: int, id_col: str, start: int, n: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, start, n), 16, 10).cast("long")


def least(keys: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row of keys."""
    return keys if keys.shape[1] <= k else np.partition(keys, k - 1, axis=1)[:, :k]


def bottom_k(df: DataFrame, k: int, replicates: int, seed: int, value: str, id_col: str, group: Sequence[str]) -> DataFrame:
    """group, replicate, values: the value of each of the k drawn rows of a group and replicate."""
    group = list(group)
    rows = df.where(F.col(id_col).isNotNull() & F.col(value).between(0, 7))
    rows = rows.select(*group, (_digits(seed, id_col, 1, 8) % PRIME).alias("_x"), (_digits(seed, id_col, 9, 7) * 8 + F.col(value).cast("long")).alias("_low"))
    kinds = types_of(rows, group)
    out = kinds + "_part int, _block int, _keys binary"
    schema = to_arrow_schema(T._parse_datatype_string(out))
    a, b = factors(replicates, seed)

    def states(held: dict[tuple, np.ndarray], part: int) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in schema]
        for name, keys in held.items():
            for start in range(0, replicates, REPLICATES):
                for c, x in zip(columns, (*name, part, start // REPLICATES, keys[start : start + REPLICATES].tobytes()), strict=True):
                    c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            x, low = batch.column("_x").to_numpy(), batch.column("_low").to_numpy()
            names = list(zip(*[batch.column(g).to_pylist() for g in group], strict=True)) if group else [()] * batch.num_rows
            numbers = {n: i for i, n in enumerate(dict.fromkeys(names))}
            of = np.fromiter(map(numbers.__getitem__, names), np.int64, len(names))
            for name, i in numbers.items():
                mine = np.flatnonzero(of == i)
                for at in range(0, len(mine), ROWS):
                    own = mine[at : at + ROWS]
                    keys = ((a[:, None] * x[None, own] + b[:, None]) % PRIME << 32) | low[None, own]
                    held[name] = least(np.concatenate([held[name], keys], axis=1) if name in held else keys, k)
                if sum(h.nbytes for h in held.values()) > HELD:
                    yield states(held, part)
                    held = {}
        if held:
            yield states(held, part)

    def merge(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(s, np.int64) for s in rows.column("_keys").to_pylist()]
        block = rows.column("_block")[0].as_py()
        n = min(REPLICATES, replicates - block * REPLICATES)
        done = least(np.concatenate([s.reshape(n, -1) for s in keys], axis=1), k)
        return pa.table([*[rows.column(c).slice(0, 1) for c in (*group, "_part", "_block")], pa.array([done.tobytes()])], schema=schema)

    state, parts = rows.mapInArrow(fold, out), max(1, rows.rdd.getNumPartitions())
    while True:
        state = state.withColumn("_part", F.floor(F.col("_part") / FAN).cast("int")).groupBy(*group, "_part", "_block").applyInArrow(merge, out)
        parts = -(-parts // FAN)
        if parts == 1:
            break
    drawn = kinds + "replicate int, values array<int>"
    told = to_arrow_schema(T._parse_datatype_string(drawn))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("_block")[i].as_py()
                n = min(REPLICATES, replicates - block * REPLICATES)
                values = (np.sort(np.frombuffer(batch.column("_keys")[i].as_py(), np.int64).reshape(n, -1), axis=1) & 7).astype(np.int32)
                given = [pa.array([batch.column(g)[i].as_py()] * n, told.field(g).type) for g in group]
                yield pa.RecordBatch.from_arrays([*given, pa.array(np.arange(n, dtype=np.int32) + block * REPLICATES), pa.array(list(values), told.field("values").type)], schema=told)

    return state.mapInArrow(tell, drawn)
