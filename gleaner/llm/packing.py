"""Best-fit packing of tokenised documents under token, document-count and attention-cost capacities.

The pieces' lengths decide everything: a piece of n tokens asks for n tokens, one document and n^2 attention
cost. So packing is planned on the histogram of lengths, at most `max_tokens` rows whatever the corpus, by vector
best-fit with the longest pieces first: of the kinds of open bins with room in every dimension, the one with the
greatest weighted dot product of demand and residual, or the least residual norm, takes the next pieces, as many as there
are such bins. The plan is a list of runs (length, first rank, count, first bin, offset). Pieces are ranked within
their length by salted counts, no length is gathered anywhere, and each finds its run by its rank.

Null or empty text: the end token alone. A text of more than `max_tokens` ids is cut, its first piece taking what is
over whole pieces. A very long text is many pieces. Repeated rows are packed each. Empty table: no rows. Extra columns are ignored.
A piece beyond a capacity on its own raises ValueError.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, table, written
from .tokens import Encoder, default_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32."""
    schema = to_arrow_schema(T._parse_datatype_string(PIECES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                rows = []
                ends, ids = encode.ids(batch.column("text"))
                for name, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1], ends[1:], strict=True):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    start, first = 0, len(own) % max_tokens or max_tokens
                    for k in range(-(-len(own) // max_tokens)):
                        stop = first + k * max_tokens
                        rows.append((name, k, start, stop - start, zlib.crc32(own[start:stop])))
                        start = stop
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], max_tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None, score: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, runs (first rank, count, first bin, offset in the bin) in order of rank; bins count from 0."""
    top = np.array([max_tokens, max_docs or max_tokens, max_cost or max_tokens**2], np.int64)
    w = np.array(weights) / np.square(top.astype(float))
    state: dict[tuple[int, int, int], list[list[int]]] = defaultdict(list)  # room left: runs of [first bin, count]
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0
    for n in sorted(histogram, reverse=True):
        need, left, rank, runs = np.array([n, 1, n * n]), histogram[n], 0, []
        if (need > top).any():
            raise ValueError(f"a piece of {n} tokens is beyond a capacity")
        while left:
            kinds = np.array(list(state), np.int64).reshape(-1, 3)
            fit = (kinds >= need).all(axis=1)
            if fit.any():
                room = kinds[fit].astype(float)
                value = (w * need * room).sum(axis=1) if score == "dot" else -(w * np.square(room - need)).sum(axis=1)
                at = tuple(int(x) for x in kinds[fit][np.argmax(value)])
            else:  # new bins, as many as the rest of this length fills
                each = int((top // need).min())
                at = tuple(int(x) for x in top)
                state[at].append([bins, new := -(-left // each)])
                bins += new
            held = state[at]
            first, count = held[-1]
            take = min(count, left)
            runs.append((rank, take, first, max_tokens - at[0]))
            if take == count:
                held.pop()
                if not held:
                    del state[at]
            else:
                held[-1] = [first + take, count - take]
            state[tuple(int(a) for a in np.array(at) - need)].append([first, take])
            rank, left = rank + take, left - take
        out[n] = runs
    return out


def place(cut: DataFrame, runs: dict[int, list[tuple[int, int, int, int]]], total: int, each: int = 200_000) -> DataFrame:
    """Give each piece its rank within its length, then its bin and offset. `cut`: a written table."""
    salts = max(16, -(-total // each))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r"))
    names = [x.strip().split(" ")[0] for x in PIECES.split(",")]
    schema = to_arrow_schema(T._parse_datatype_string(PLACED))
    shared = cut.sparkSession.sparkContext.broadcast({n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bins, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                firsts, _, base, at = shared.value[int(n)]
                k = np.searchsorted(firsts, rank[mine], side="right") - 1
                bins[mine], offset[mine] = base[k] + rank[mine] - firsts[k], at[k]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(bins), pa.array(offset)], schema=schema)

    return ranked.select(*names, "rank").mapInArrow(settle, PLACED)


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = 2048, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of `docs` (doc_id, text)."""
    cut = written(pieces(docs, tokenizer or default_tokenizer(), max_tokens), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    return place(cut, plan(histogram, max_tokens, **limits), sum(histogram.values()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
