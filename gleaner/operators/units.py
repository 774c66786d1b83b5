"""Complaint sentences: candidates, the score gate and its accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text
from . import GROUP

LEAST_POSITIVE, LEAST_OTHER = 0.85, 0.50


def sentences(reviews: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A row for each sentence of the analysable reviews, with unit_id."""
    rows = reviews.where("analysable").select(*group, F.col("source_review_id").alias("review_id"), "rating", "created_at", F.posexplode(text.sentences(F.col("analysis_text"))).alias("sentence_index", "sentence"))
    return rows.withColumn("unit_id", F.concat("review_id", F.lit(":s"), F.col("sentence_index")))


def passes(least_positive: float = LEAST_POSITIVE, least_other: float = LEAST_OTHER) -> Column:
    if not (0 <= least_positive <= 1 and 0 <= least_other <= 1):
        raise ValueError("thresholds lie between 0 and 1")
    return F.col("negative_score") >= F.when(F.col("rating") >= 4, least_positive).otherwise(least_other)


def unit_gate(scored: DataFrame, **least: float) -> DataFrame:
    """Sentences labelled negative whose score passes, as units. `scored`: label, negative_score, rating, sentence."""
    kept = scored.where((F.col("label") == "negative") & passes(**least))
    return kept.withColumn("lexical_text", text.lexical(F.col("sentence")))


def gate_accounting(scored: DataFrame, group: Sequence[str] = GROUP, **least: float) -> DataFrame:
    """How many sentences were negative, kept, and removed by each rule."""
    ok, happy = passes(**least), F.col("rating") >= 4
    return scored.where("label = 'negative'").groupBy(*group).agg(F.count("*").alias("candidates"), F.count_if(ok).alias("kept"), F.count_if(~ok & happy).alias("removed_positive"), F.count_if(~ok & ~happy).alias("removed_other"))


def complaint_totals(units: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    return units.groupBy(*group).agg(F.count("*").alias("n_units"), F.countDistinct("review_id").alias("n_complaint_reviews"))


def wilson_columns(k: str, n: str) -> list[Column]:
    w = stats.wilson(F.col(k), F.col(n))
    return [w["low"].alias("low"), w["high"].alias("high")]
