"""Connected components within groups by alternating stars, and tables stored in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _top(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and runs on this machine alone."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(top)
    return top


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, removed when the driver's Python ends."""
    path = f"{_top(spark).rstrip('/')}/gleaner/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
            pass

    atexit.register(remove)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet below the checkpoint folder and read again; unlike a checkpoint it keeps no partitioning, which grows with each round of joins."""
    path = shared_folder(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _least(edges: DataFrame, group: list[str]) -> DataFrame:
    """u, v, m of directed edges: m is the least of u and all its neighbours. Minima are taken before rows are moved; a hub's edges are
    joined with its one minimum, a join that Spark can split."""
    least = edges.groupBy(*group, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, [*group, "u"])


def components(edges: DataFrame, group: Sequence[str] = (), rounds: int = 60) -> DataFrame:
    """group, node, component (the least node) of every node of `edges` (group, a, b). Loops and repeats do no harm.

    Large and small stars take turns: each node's greater neighbours, then its lesser ones, are linked to the least it knows, until the
    edges are stars around the components' least nodes. Every round is stored.
    """
    group = list(group)
    seen = stored(edges.select(*group, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    loops = seen.where("u = v").select(*group, F.col("u").alias("node"), F.col("u").alias("component"))
    now, mark = seen.where("u <> v"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(*group, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, group).where("v > u").select(*group, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large, group)
        small = small.select(*group, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select(*group, "u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(small)
        state = tuple(now.agg(F.count("*"), F.sum(F.hash(*group, "u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            stars = now.select(*group, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(*group, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            return stars.unionByName(loops.join(stars, [*group, "node"], "left_anti"))
        mark = state
    raise RuntimeError(f"no components after {rounds} rounds")
