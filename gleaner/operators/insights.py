"""Areas of improvement from categories, themes and, where a group has neither, phrases; marts for reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import GROUP

AREA = ("source", "area", "count", "total", "share", "low", "high", "mean_star_rating", "newest", "share_last_12_months", "historical", "excerpt")
WEAK_BELOW = 0.80
LABEL_CHARS = 48


def area_text(area: Column, count: Column, total: Column, share: Column, low: Column, high: Column, excerpt: Column) -> Column:
    ci = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit(", 95% CI "), stats.percent(low), F.lit("-"), stats.percent(high))).otherwise("")
    example = F.when(F.coalesce(excerpt, F.lit("")) != "", F.concat(F.lit(", for example '"), excerpt, F.lit("'"))).otherwise("")
    return F.concat(F.lit("Investigate "), area, F.lit(": "), count.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" complaint reviews ("), F.coalesce(stats.percent(share), F.lit("unknown share")), ci, F.lit(")"), example, F.lit("."))


def category_areas(cat_stats: DataFrame, evidence: DataFrame, labels: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """`cat_stats` as areas. `labels`: category_id, label."""
    first = evidence.where("rank = 1").select(*group, "category_id", "excerpt")
    got = cat_stats.join(first, [*group, "category_id"], "left").join(labels.select("category_id", "label").distinct(), "category_id")
    return got.select(*group, F.lit("issue_category").alias("source"), F.col("label").alias("area"), F.col("review_count").alias("count"), F.col("denominator").alias("total"), "share", F.col("ci95.low").alias("low"), F.col("ci95.high").alias("high"), "mean_star_rating", "newest", "share_last_12_months", "historical", "excerpt")


def theme_areas(theme_stats: DataFrame, names: DataFrame, reps: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """`theme_stats` as areas, named by their first two phrases (`names`: theme_id, rank, phrase)."""
    said = names.where("rank <= 2").groupBy(*group, "theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda x: x["phrase"]), " / ").alias("name"))
    first = reps.where("rank = 1").select(*group, "theme_id", "excerpt")
    got = theme_stats.join(said, [*group, "theme_id"], "left").join(first, [*group, "theme_id"], "left")
    name = F.coalesce("name", F.format_string("Unlabelled complaint group (%d units)", F.col("unit_count")))
    return got.select(*group, F.lit("theme").alias("source"), name.alias("area"), F.col("review_count").alias("count"), F.col("n_complaint_reviews").alias("total"), "share", F.col("ci95.low").alias("low"), F.col("ci95.high").alias("high"), "mean_star_rating", "newest", "share_last_12_months", "historical", "excerpt")


def phrase_areas(phrases: DataFrame, others: DataFrame, reviews: DataFrame, most: int = 3, group: Sequence[str] = GROUP) -> DataFrame:
    """The first phrases of groups that have no other area. `reviews`: source_review_id, analysis_text."""
    kept = phrases.where(F.col("rank") <= most).join(others.select(*group).distinct(), list(group), "left_anti")
    shown = reviews.select(*group, F.col("source_review_id").alias("example_review_id"), F.col("analysis_text").alias("excerpt"))
    null = F.lit(None).cast("double")
    return kept.join(shown, [*group, "example_review_id"], "left").select(*group, F.lit("phrase").alias("source"), F.col("phrase").alias("area"), F.col("support").alias("count"), F.col("n_negative").alias("total"), stats.share(F.col("support"), F.col("n_negative")).alias("share"), null.alias("low"), null.alias("high"), null.alias("mean_star_rating"), "newest", "share_last_12_months", (F.col("share_last_12_months") == 0).alias("historical"), "excerpt")


def areas_of_improvement(parts: Sequence[DataFrame], group: Sequence[str] = GROUP) -> DataFrame:
    """All areas, categories first, then current ones, greater shares, names; with their sentence."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    place = F.when(F.col("source") == "issue_category", 0).otherwise(1)
    order = Window.partitionBy(*group).orderBy(place, "historical", F.col("share").desc(), "area")
    return both.withColumn("rank", F.row_number().over(order)).withColumn("text", area_text(*[F.col(c) for c in ("area", "count", "total", "share", "low", "high", "excerpt")]))


def area_status(groups: DataFrame, areas: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Of each group how many areas it has, and ok or insufficient_signal."""
    n = areas.groupBy(*group).agg(F.count("*").alias("n_areas"))
    got = groups.select(*group).distinct().join(n, list(group), "left").withColumn("n_areas", F.coalesce("n_areas", F.lit(0)))
    return got.withColumn("status", F.when(F.col("n_areas") > 0, "ok").otherwise("insufficient_signal"))


def mart_distribution(dist: DataFrame, value: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Bars of a distribution; a missing interval falls back to the value."""
    return dist.select(*group, F.col(value).cast("string").alias("label"), F.col("share").alias("value"), F.coalesce("ci95.low", "share").alias("low"), F.coalesce("ci95.high", "share").alias("high"), "count")


def mart_category_support(cat_stats: DataFrame, labels: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    got = cat_stats.join(labels.select("category_id", "label").distinct(), "category_id")
    return got.select(*group, "rank", F.left("label", F.lit(LABEL_CHARS)).alias("label"), F.col("share").alias("value"), F.col("ci95.low").alias("low"), F.col("ci95.high").alias("high"), F.col("review_count").alias("count"))


def mart_periods(periods: DataFrame, means: DataFrame | None = None, group: Sequence[str] = GROUP) -> DataFrame:
    """Mean stars of periods; `means` may give their intervals (group, bucket, low, high)."""
    if means is not None:
        periods = periods.join(means.select(*group, "bucket", "low", "high"), [*group, "bucket"], "left")
    else:
        periods = periods.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    return periods.select(*group, "bucket", "label", F.col("mean").alias("value"), F.coalesce("low", "mean").alias("low"), F.coalesce("high", "mean").alias("high"), "n")


def mart_negative_phrases(phrases: DataFrame, most: int = 12, group: Sequence[str] = GROUP) -> DataFrame:
    return phrases.where((F.col("rank") <= most) & (F.trim("phrase") != "")).select(*group, "rank", F.col("phrase").alias("label"), stats.share(F.col("support"), F.col("n_negative")).alias("value"), F.col("support").alias("count"))


def mart_funnel(sampled: DataFrame, complaint: DataFrame, rest: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Steps sampled, with complaints, categorised. `sampled`: group, n; `rest`: group, review_count (uncategorised)."""
    got = sampled.join(complaint.select(*group, "n_complaint_reviews"), list(group), "left").join(rest.select(*group, "review_count"), list(group), "left")
    with_, without = F.coalesce("n_complaint_reviews", F.lit(0)), F.coalesce("review_count", F.lit(0))
    counts = (("sampled", F.col("n")), ("with complaints", with_), ("categorised", F.greatest(F.lit(0), with_ - without)))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("label"), k.cast("long").alias("count")) for i, (name, k) in enumerate(counts)])
    note = F.when(without > 0, F.concat(without.cast("string"), F.lit(" complaint reviews match no category"))).otherwise("all complaint reviews match a category")
    return got.select(*group, F.explode(steps).alias("x"), note.alias("note")).select(*group, "x.*", "note")


def mart_category_precision(audit: DataFrame, labels: DataFrame) -> DataFrame:
    got = audit.where("category <> 'overall'").join(labels.select(F.col("category_id").alias("category"), "label").distinct(), "category", "left")
    order = Window.orderBy(F.col("precision").desc(), F.col("n").desc(), "label")  # a row for each category of the lexicon
    return got.select(F.row_number().over(order).alias("rank"), "category", "label", F.col("precision").alias("value"), F.col("ci95.low").alias("low"), F.col("ci95.high").alias("high"), "n")


def weak_categories(audit: DataFrame, below: float = WEAK_BELOW) -> DataFrame:
    return audit.where((F.col("category") != "overall") & (F.col("precision") < below)).select("category", "precision", "n")


def mart_summary(ratings: DataFrame, sentiments: DataFrame, complaint: DataFrame, top: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Up to four tiles of a group; a tile without data is left out."""
    mean = ratings.where("mean IS NOT NULL").select(*group, F.lit(1).alias("tile"), F.lit("mean rating").alias("label"), F.format_string("%.2f", F.col("mean")).alias("value"))
    bad = sentiments.where("sentiment_label = 'negative' AND share IS NOT NULL").select(*group, F.lit(2).alias("tile"), F.lit("negative reviews").alias("label"), stats.percent(F.col("share")).alias("value"))
    units = complaint.where("n_complaint_reviews > 0").select(*group, F.lit(3).alias("tile"), F.lit("reviews with complaints").alias("label"), F.col("n_complaint_reviews").cast("string").alias("value"))
    area = top.where("rank = 1").select(*group, F.lit(4).alias("tile"), F.lit("first area").alias("label"), F.col("area").alias("value"))
    return mean.unionByName(bad).unionByName(units).unionByName(area)
