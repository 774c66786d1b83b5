"""Exact integer k-means whose assignments search a vantage-point tree over the centroids.

Each round the tree of the centroids is built anew and broadcast (`k` vectors, whatever the table). A node holds a vantage centroid
and the median of its distances to the rest, which parts these into an inside and an outside; a leaf holds a few centroids. Every
vector walks the tree best first: of the nodes that it has not opened it takes the one with the least lower bound (triangle
inequality), compares itself exactly with what the node holds and stops when that bound is above its best distance. The pruning
radius is inclusive, so a node that might hold an equally near centroid is opened, and of equally near ones the smaller number wins.
Vectors walk by themselves, but the steps of a batch are taken together, in numpy. Distances are integers: 64-bit ones where
they can't overflow, Python's elsewhere; bounds are floating-point numbers with room for their rounding.

Sums by cluster are taken in each task, added up in Spark, and divided exactly. The vectors are a written table, so a lost executor
costs a part of one round.

Vectors that are null, of another size, or hold a null or non-finite component take no part; a component beyond 64 bits counts as the
nearest long, and so does a distance or a sum of distances. Start: the vectors with the least hashes of seed and id; of equal ids the
lesser vector first; null ids last. Fewer vectors than `k`: each is a centroid. Repeated rows count each. Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .topk import LEAST, MOST, _floor

LEAF = 4
#: Squared distances below this are 64-bit integers.
SAFE = 2**62
#: Room for rounding in bounds, in parts of the lengths they are made of.
SLACK = 1e-9
BATCH = 4096
SUMS = "cluster int, i int, n long, s decimal(38,0)"
ASSIGNED = "vec_id long, cluster int, distance long"


def _wide(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether squared distances could overflow."""
    most = max((max(int(x.max()), -int(x.min())) for x in (a, b) if x.size), default=0)
    return (2 * most) ** 2 * a.shape[-1] >= SAFE


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of `a` and `b` (as broadcast against each other), of 64-bit integers or, where these could overflow, Python's."""
    if _wide(a, b):
        a, b = a.astype(object), b.astype(object)
    return np.square(a - b).sum(axis=-1)


class Tree:
    """Nodes of the vantage-point tree, by number; 0 is the top. `held`: centroids that a node compares with, `radius`: null in leaves."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF) -> None:
        self.centroids = centroids
        self.held: list[list[int]] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.radius: list[float] = []
        if len(centroids):
            self._grow(np.arange(len(centroids)), leaf)
        wide = max((len(h) for h in self.held), default=1)
        self.rows = np.array([h + [-1] * (wide - len(h)) for h in self.held]).reshape(-1, wide)
        self.below = np.array([self.inside, self.outside]).reshape(2, -1)
        self.radii = np.array(self.radius)

    def _grow(self, of: np.ndarray, leaf: int) -> int:
        at = len(self.held)
        for store in (self.held, self.inside, self.outside, self.radius):
            store.append(-1)
        self.radius[at] = np.nan
        if len(of) <= leaf:
            self.held[at] = of.tolist()
            return at
        # The vantage point: the centroid farthest from the set's first, so near a border, where spheres cut best.
        far = np.sqrt(_squares(self.centroids[of], self.centroids[of[0]][None]).astype(float))
        point = int(np.argmax(far))
        rest = np.delete(of, point)
        far = np.sqrt(_squares(self.centroids[rest], self.centroids[of[point]][None]).astype(float))
        order = np.argsort(far, kind="stable")
        half = len(rest) // 2
        self.held[at], self.radius[at] = [int(of[point])], float(far[order[half - 1]])
        # Equal distances may stand on both sides; the bounds of both sides hold with `<=` and `>=`.
        self.inside[at] = self._grow(np.sort(rest[order[:half]]), leaf)
        self.outside[at] = self._grow(np.sort(rest[order[half:]]), leaf)
        return at

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance (exact) of the nearest centroid of each row, and how many distances were computed."""
        n = len(v)
        bound = np.full((n, len(self.held)), np.inf)
        bound[:, 0] = 0.0
        best, near, radius = np.full(n, len(self.centroids)), np.full(n, MOST), np.full(n, np.inf)
        if _wide(v, self.centroids):
            near = np.full(n, 2**200, object)
        alive, seen = np.arange(n), 0
        while len(alive):
            node = bound[alive].argmin(axis=1)
            low = bound[alive, node]
            go = (low <= radius[alive]) & np.isfinite(low)  # inclusive: an equal distance may bring a smaller number
            alive, node, low = alive[go], node[go], low[go]
            if not len(alive):
                break
            bound[alive, node] = np.inf
            first = None
            for c in range(self.rows.shape[1]):
                who = self.rows[node, c]
                mine = np.flatnonzero(who >= 0)
                if not len(mine):
                    break
                seen += len(mine)
                rows, number = alive[mine], who[mine]
                far = _squares(v[rows], self.centroids[number])
                better = ((far < near[rows]) | ((far == near[rows]) & (number < best[rows]))).astype(bool)
                won = rows[better]
                best[won], near[won] = number[better], far[better]
                root = np.sqrt(far.astype(float))
                radius[won] = root[better]
                first = (mine, root) if c == 0 else first
            inner = ~np.isnan(self.radii[node])
            mine, root = first
            far = np.zeros(len(node))
            far[mine] = root
            rows, at, far, low, mid = alive[inner], node[inner], far[inner], low[inner], self.radii[node[inner]]
            room = SLACK * (far + mid)
            bound[rows, self.below[0][at]] = np.maximum(low, far - mid - room)
            bound[rows, self.below[1][at]] = np.maximum(low, mid - far - room)
        return best, near, seen


def _clamped(x: int) -> int:
    return min(max(int(x), LEAST), MOST)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def sums(vectors: DataFrame, tree: Tree) -> DataFrame:
    """cluster, component, count and sum over the vectors nearest to each centroid; a task gives one row for each that it meets."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                v = _vectors(whole.slice(start, BATCH))
                best, _, _ = shared.value.nearest(v)
                exact = v if int(np.abs(v.astype(float)).max(initial=0)) < 2**48 else v.astype(object)
                for c in np.unique(best).tolist():
                    mine = exact[best == c]
                    total[c] = total.get(c, 0) + mine.sum(axis=0).astype(object)
                    count[c] = count.get(c, 0) + len(mine)
        rows = [(c, i, count[c], Decimal(int(x))) for c, s in total.items() for i, x in enumerate(s)]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cluster", "i", "n", "s"])

    return vectors.select("v").mapInArrow(work, SUMS).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def assigned(vectors: DataFrame, tree: Tree) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                part = whole.slice(start, BATCH)
                best, near, _ = shared.value.nearest(_vectors(part))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best, pa.int32()), pa.array([_clamped(x) for x in near], pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(work, ASSIGNED)


def fit(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> np.ndarray:
    """The centroids after `rounds`. `vectors`: a written table of vec_id and v, all of one size. Only k vectors and their sums reach the driver."""
    chosen = vectors.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)).orderBy(F.col("_h").asc_nulls_last(), "v").limit(k)
    centroids = np.array([r["v"] for r in chosen.select("v").collect()], np.int64)
    for _ in range(rounds if len(centroids) else 0):
        after = centroids.copy()
        for r in sums(vectors, Tree(centroids)).collect():  # k rows for each component
            after[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
        if np.array_equal(after, centroids):
            break
        centroids = after
    return centroids


def integers(embeddings: DataFrame, size: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as long; unfit vectors are left out."""
    whole = (F.size(vec_col) == size) & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fit_in = lambda x: F.when(x >= 2.0**63, MOST).when(x <= -(2.0**63), LEAST).otherwise(F.when(F.abs(x) < 2.0**63, x).cast("long"))
    return embeddings.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: fit_in(_floor(F.lit(float(scale)) * x.cast("double")))).alias("v"))


def clusters(embeddings: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each fit vector."""
    spark = embeddings.sparkSession
    vectors = written(integers(embeddings, size, scale, id_col, vec_col), "vectors")
    centroids = fit(vectors, k, rounds, seed)
    got = written(assigned(vectors, Tree(centroids)), "assigned")
    each = {r["cluster"]: int(r["s"]) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    total = _clamped(sum(each.values()))
    facts = [(c, _clamped(s), total, hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest()) for c, s in each.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return got.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def oracle(k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2, scale: int = 256) -> str:
    """The same by comparing every vector with every centroid, a common table expression a round."""
    parts = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS cluster, v AS c FROM v ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v LIMIT {k})",
    ]
    near = "SELECT vec_id, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT row, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM (SELECT row_number() OVER () AS row, vec_id, v FROM v) CROSS JOIN c{0}) GROUP BY row, vec_id, v"
    for r in range(rounds):
        parts.append(f"a{r} AS ({near.replace('{0}', str(r))})")
        parts.append(f"m{r} AS (SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i))")
        parts.append(f"c{r + 1} AS (SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS c FROM m{r} GROUP BY cluster) m ON c.cluster = m.cluster)")
    parts.append(f"z AS ({near.replace('{0}', str(rounds))})")
    return f"WITH {', '.join(parts)} SELECT z.vec_id, z.cluster, z.distance, CAST(sum(distance) OVER (PARTITION BY z.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM z JOIN c{rounds} c ON z.cluster = c.cluster"


ORACLE = oracle()
