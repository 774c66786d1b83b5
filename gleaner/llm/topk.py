"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are integers. Of each vector, segments of each resolution have a mean and a deviation; for segments of length L,
sum(L * (mean_q * mean_c + dev_q * dev_c)) is never below the inner product (Cauchy-Schwarz), which bounds the
distance |q|^2 + |c|^2 - 2 q.c from below. Coarse to fine, candidates whose bound falls under the k-th best
exact score known so far are dropped; the survivors' scores are computed exactly.

Queries and candidates meet in blocks: candidates are dealt evenly into slices, queries into blocks, and each pair of
block and slice is one small group whose best k go on to a merge by query. No block grows with the data; work does. A first
pass over one slice gives each query a floor, a score that k candidates reach, so that other slices start with it.

Null vectors, and such as hold null, NaN or infinite components, take no part. Vectors shorter than the longest of a
group count as filled up with 0. Equal scores: the smaller id first; repeated ids are candidates each, but never
for a query with their own id. A query without candidates gets no rows, nor does an empty table. Extra columns are ignored. Scores are exact integers of any
size, by Python's where 64 bits could overflow; a component or a score beyond 64 bits counts as the nearest long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SCORED = "query_id long, vec_id long, score long"
LEVELS = (4, 8, 16)
#: Room for rounding in the bounds, which are floating-point numbers, in parts of the product of both lengths; scores are integers.
SLACK = 1e-9
LEAST, MOST = -(2**63), 2**63 - 1


def _floor(x: Column) -> Column:
    """The floor of a double as a double: Spark's own is a long and overflows beyond 64 bits."""
    near = F.rint(x)
    return F.when(near > x, near - 1.0).otherwise(near)


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as long; unfit vectors are left out."""
    whole = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fit = lambda x: F.when(x >= 2.0**63, MOST).when(x <= -(2.0**63), LEAST).otherwise(F.when(F.abs(x) < 2.0**63, x).cast("long"))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: fit(_floor(F.lit(float(scale)) * x.cast("double")))).alias("v"))


def _matrix(rows: pd.Series, wide: int) -> np.ndarray:
    out = np.zeros((len(rows), wide), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations side by side, scaled so that one matrix product gives the bound."""
    parts = np.array_split(m.astype(np.float64), segments, axis=1)
    root = [math.sqrt(p.shape[1]) for p in parts]
    return np.concatenate([np.stack([p.mean(1) * r for p, r in zip(parts, root, strict=True)], 1), np.stack([p.std(1) * r for p, r in zip(parts, root, strict=True)], 1)], axis=1)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T if most < 2**62 else q.astype(object) @ c.astype(object).T


def best_of(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, vector, score) of the k best candidates of each query among a slice, coarse bounds first.

    `floors`: by query a score that k candidates are known to reach, or NaN; what is below it may be left out.
    """
    levels = [s for s in levels if s < q.shape[1]]
    by_level = [(_statistics(q, s), _statistics(c, s)) for s in levels]
    coarse = by_level[0][0] @ by_level[0][1].T if levels else np.full((len(q), len(c)), np.inf)
    size_q, size_c = (np.sqrt(np.square(x.astype(np.float64)).sum(1)) for x in (q, c))
    found = []
    for i, own in enumerate(q_ids):
        alive = np.flatnonzero(c_ids != own)
        if not len(alive):
            continue
        floor = -np.inf if floors is None or np.isnan(floors[i]) else floors[i]
        alive = alive[coarse[i, alive] + SLACK * size_q[i] * size_c[alive] + 1 >= floor]
        if not len(alive):
            continue
        first = alive[np.argpartition(-coarse[i, alive], k - 1)[:k]] if len(alive) > k else alive
        if len(first) == k:
            floor = max(floor, float(_exact(q[i : i + 1], c[first])[0].min()))
        for stats_q, stats_c in by_level:
            bound = stats_c[alive] @ stats_q[i]
            alive = alive[bound + SLACK * size_q[i] * size_c[alive] + 1 >= floor]
        score = _exact(q[i : i + 1], c[alive])[0]
        order = np.lexsort((c_ids[alive], -score)) if score.dtype != object else sorted(range(len(score)), key=lambda j: (-score[j], c_ids[alive[j]]))
        for j in order[:k]:
            found.append((int(own), int(c_ids[alive[j]]), min(max(int(score[j]), LEAST), MOST)))
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, slice_rows: int = 1024, block_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score. `vectors`, `queries`: vec_id, v (integers), as `quantised` returns them."""
    n_slices, n_blocks = max(1, math.ceil(vectors.count() / slice_rows)), max(1, math.ceil(queries.count() / block_rows))
    # By id, not by value: a frequent vector would fill its slice.
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    vectors, queries = vectors.select("vec_id", "v", deal(n_slices).alias("slice")), queries.select("vec_id", "v", deal(n_blocks).alias("block"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        wide = max([1, *q["v"].map(len), *c["v"].map(len)])
        rows = best_of(q["vec_id"].to_numpy(), _matrix(q["v"], wide), c["vec_id"].to_numpy(), _matrix(c["v"], wide), k, floors=q["floor"].to_numpy(np.float64)) if len(q) and len(c) else []
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    def met(blocks: DataFrame, slices: DataFrame) -> DataFrame:
        slices = slices.select(*[F.col(c).alias(c) for c in slices.columns])  # columns of its own, so that the two sides can be told apart
        return blocks.groupBy("block", "slice").cogroup(slices.groupBy("block", "slice")).applyInPandas(meet, SCORED)

    unknown = F.lit(None).cast("double").alias("floor")
    if n_slices > 1:
        # Scores in the first slice, of which the k-th best of each query is a floor for all others.
        start = written(met(queries.select("vec_id", "v", "block", F.lit(0).alias("slice"), unknown), vectors.where("slice = 0").select("vec_id", "v", "slice", every(n_blocks).alias("block"))), "topk-start")
        floors = start.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k).drop("n")
        known = queries.join(floors, "vec_id", "left").select("vec_id", "v", "block", "floor", F.explode(F.sequence(F.lit(1), F.lit(n_slices - 1))).alias("slice"))
        some = met(known, vectors.where("slice > 0").select("vec_id", "v", "slice", every(n_blocks).alias("block"))).unionByName(start)
    else:
        some = met(queries.select("vec_id", "v", "block", F.lit(0).alias("slice"), unknown), vectors.select("vec_id", "v", "slice", every(n_blocks).alias("block")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
