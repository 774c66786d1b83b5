"""Incremental ingest: typed rows, each id once within the watermark, and counts of stars by window.

Rows later than the watermark are dropped; what was dropped shows in the query's progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.reviews import REVIEW


def read_stream(spark: SparkSession, path: str, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(REVIEW).option("maxFilesPerTrigger", files_at_once).json(path)


def once(reviews: DataFrame, late: str = "30 days") -> DataFrame:
    """Each review id once; state is kept no longer than `late`."""
    valid = reviews.where("source_review_id IS NOT NULL AND rating BETWEEN 1 AND 5 AND created_at IS NOT NULL")
    return valid.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["country", "source_review_id"])


def rating_windows(reviews: DataFrame, window: str = "7 days") -> DataFrame:
    """Reviews and stars by country and window, appended as windows close. The input has a watermark."""
    got = reviews.groupBy("country", F.window("created_at", window).alias("w")).agg(F.count("*").alias("n"), F.sum("rating").alias("stars"), F.count_if(F.col("rating") <= 2).alias("low"))
    return got.select("country", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "stars", "low")


def write_windows(windows: DataFrame, path: str, checkpoint: str):
    """The started query, appending to Parquet, exactly once by its checkpoint; ends when all there is has been read."""
    return windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
