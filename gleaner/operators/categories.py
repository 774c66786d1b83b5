"""Issue categories by a closed lexicon: n-gram occurrences meet phrases by an equi-join, never by scans of each pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text, wordlists
from . import GROUP
from .phrases import recent

LONGEST = 5


def lexicon(spark: SparkSession, rows: Sequence[tuple[str, str, str]] = wordlists.LEXICON) -> DataFrame:
    """category_id, label, phrase. A few hundred rows."""
    flat = [(c, label, p.strip()) for c, label, said in rows for p in said.split(",")]
    return spark.createDataFrame(flat, "category_id string, label string, phrase string")


def lexicon_match(units: DataFrame, phrases: DataFrame, guarded: Sequence[str] = wordlists.GUARDED, guards: Sequence[str] = wordlists.GUARDS) -> DataFrame:
    """unit_id, category_id, phrase: phrases of the lexicon in a unit's words, but for occurrences that a negation guards."""
    lists = lambda ws: F.array(*[F.lit(w) for w in ws])
    toks = units.withColumn("_t", text.words(F.col("lexical_text")))
    # A guarded word counts as another word where a guard stands in the two places before it.
    guarded_at = F.transform("_t", lambda w, i: F.when(F.array_contains(lists(guarded), w) & (i > 0) & F.arrays_overlap(F.slice(F.col("_t"), F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), lists(guards)), F.lit("\u0000")).otherwise(w))
    grams = toks.withColumn("_t", guarded_at).select("unit_id", F.explode(text.ngrams(F.col("_t"), LONGEST)).alias("phrase"))
    return grams.join(phrases.select("category_id", "phrase"), "phrase").select("unit_id", "category_id", "phrase").distinct()


def category_match(units: DataFrame, matches: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A row for each category and review: its phrases, and its best unit (most phrases, greatest score, first id)."""
    per_unit = matches.groupBy("unit_id", "category_id").agg(F.collect_set("phrase").alias("found"))
    rows = per_unit.join(units, "unit_id").withColumn("_k", F.struct((-F.size("found")).alias("a"), (-F.col("negative_score")).alias("b"), F.col("unit_id").alias("c")))
    best = F.min(F.struct("_k", F.col("sentence").alias("sentence"), F.array_sort("found").alias("found")))
    got = rows.groupBy(*group, "category_id", "review_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("phrases"), best.alias("best"), F.first("rating").alias("rating"), F.max("created_at").alias("created_at"))
    first = F.array_min(F.transform("best.found", lambda p: F.struct((-F.size(F.split(p, " "))).alias("n"), p.alias("p"))))["p"]
    return got.select(*group, "category_id", "review_id", "phrases", F.col("best._k.c").alias("unit_id"), F.col("best.sentence").alias("sentence"), first.alias("matched_phrase"), "rating", "created_at")


def category_stats(matched: DataFrame, complaint: DataFrame, reference: str, least: int = 2, group: Sequence[str] = GROUP, labels: DataFrame | None = None) -> DataFrame:
    """Categories with enough reviews: support, share of complaint reviews with interval, mean stars, recency, in order.

    Order: current ones first, then greater shares, then labels (`labels`: category_id, label, a row for each category at least), without them ids.
    """
    got = matched.groupBy(*group, "category_id").agg(F.count("*").alias("review_count"), F.avg("rating").alias("mean_star_rating"), F.max("created_at").alias("newest"), F.count_if(recent(reference)).alias("n_recent")).where(F.col("review_count") >= least)
    got = got.join(complaint.select(*group, F.col("n_complaint_reviews").alias("denominator")), list(group))
    got = got.withColumns({"share": stats.share(F.col("review_count"), F.col("denominator")), "ci95": stats.wilson(F.col("review_count"), F.col("denominator")), "share_last_12_months": stats.share(F.col("n_recent"), F.col("review_count")), "historical": F.col("n_recent") == 0})
    if labels is not None:
        got = got.join(labels.groupBy("category_id").agg(F.min("label").alias("_label")), "category_id", "left")
    else:
        got = got.withColumn("_label", F.col("category_id"))
    order = Window.partitionBy(*group).orderBy("historical", F.col("share").desc(), "_label", "category_id")
    return got.withColumn("rank", F.row_number().over(order)).drop("_label")


def top_phrases(matched: DataFrame, most: int = 5, group: Sequence[str] = GROUP) -> DataFrame:
    """The phrases of each category by reviews, longer first."""
    counts = matched.select(*group, "category_id", F.explode("phrases").alias("phrase")).groupBy(*group, "category_id", "phrase").agg(F.count("*").alias("count"))
    order = Window.partitionBy(*group, "category_id").orderBy(F.col("count").desc(), F.size(F.split("phrase", " ")).desc(), "phrase")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def evidence(matched: DataFrame, most: int = 3, group: Sequence[str] = GROUP) -> DataFrame:
    """The reviews that show a category best: most phrases, dated, newest, first id."""
    order = Window.partitionBy(*group, "category_id").orderBy(F.size("phrases").desc(), F.col("created_at").isNull(), F.col("created_at").desc(), "review_id")
    return matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*group, "category_id", "rank", "review_id", text.excerpt(F.col("sentence")).alias("excerpt"))


def uncategorised(units: DataFrame, matched: DataFrame, least: int = 2, group: Sequence[str] = GROUP) -> DataFrame:
    """Complaint reviews of no category that has enough reviews: their best unit each."""
    enough = matched.groupBy(*group, "category_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    covered = matched.join(enough, [*group, "category_id"], "left_semi").select(*group, "review_id").distinct()
    key = F.struct((-F.col("negative_score")).alias("a"), F.col("unit_id").alias("b"))
    return units.join(covered, [*group, "review_id"], "left_anti").groupBy(*group, "review_id").agg(F.min(F.struct(key.alias("k"), "sentence", "created_at")).alias("b")).select(*group, "review_id", F.col("b.k.b").alias("unit_id"), F.col("b.sentence").alias("sentence"), F.col("b.created_at").alias("created_at"))


def uncategorised_summary(rest: DataFrame, complaint: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    n = rest.groupBy(*group).agg(F.count("*").alias("review_count"))
    got = complaint.join(n, list(group), "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))
    return got.select(*group, "review_count", F.col("n_complaint_reviews").alias("denominator"), stats.share(F.col("review_count"), F.col("n_complaint_reviews")).alias("share"))


def uncategorised_top(rest: DataFrame, most: int = 3, group: Sequence[str] = GROUP) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.col("created_at").isNull(), F.col("created_at").desc(), "review_id")
    return rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*group, "rank", "review_id", text.excerpt(F.col("sentence")).alias("excerpt"))


def audit_sheet(matched: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """A row to judge for each category and review, with an empty label."""
    return matched.select(*group, F.col("category_id").alias("category"), "review_id", "matched_phrase", "sentence", F.lit("").alias("human_label"))
