"""Tables of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as it lies: its splits are its tasks."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores dealt over all of them; one of more, any large table, is left as it is.

    For work on texts, which costs far more than moving a small table once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
