"""Tables of reviews, units and labels made of the given tables, so that every operator can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import categories, sentiment, units
from ..operators.graph import stored
from ..sources.tables import read_table, spread

REFERENCE = "2026-09-29"
NEGATIVE, POSITIVE = ("ther", "thes", "die", "les"), ("than", "thon", "der", "des")
UNIT_NEGATIVE, UNIT_POSITIVE = ("this", "ther", "thes"), ("than",)
#: A lexicon of words that the invented texts have.
LEXICON = (("alpha", "Alpha", "ther, of the, this is"), ("beta", "Beta", "thon, in the, to the and"), ("gamma", "Gamma", "thes, and the"))
GUARDED, GUARDS = ("thon", "ther"), ("the", "of", "and")
BLOCKED = ("the", "of", "and", "to", "a", "on", "is", "that", "it", "as", "be", "was", "for", "with", "this", "are", "by", "from", "at", "in", "en", "an", "or")


TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = read_table(spark, sf_dir, name)
    return spread(df) if name in TEXTS else df


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as reviews of five apps, with stars from labels, dates from ids and labels by a word list."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    stars = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when(F.col("quality").isNotNull(), F.col("doc_id") % 3 + 3).otherwise(F.col("doc_id") % 5 + 1)
    when = F.when(F.col("doc_id") % 97 != 0, F.expr(f"TIMESTAMP '{REFERENCE}' - make_interval(0, 0, 0, CAST(doc_id * 37 % 2500 AS INT))"))
    body = F.coalesce("text", F.lit(""))
    scored = sentiment.lexicon_scorer(body, NEGATIVE, POSITIVE)
    return d.select(
        (F.col("doc_id") % 5).alias("app_id"), F.lit("us").alias("country"), F.col("doc_id").cast("string").alias("source_review_id"), F.col("doc_id").alias("rank"),
        F.lit("").alias("title"), body.alias("body"), body.alias("analysis_text"), text.lexical(body).alias("lexical_text"), F.col("lang").alias("language"),
        (F.col("lang") == "en").alias("analysable"), stars.cast("int").alias("rating"), when.alias("created_at"), scored["label"].alias("sentiment_label"),
        F.array_compact(F.array(F.when(F.length(body) > text.LONG_ABOVE, "long_text"), F.when(F.col("lang") != "en", "non_english"))).alias("flags"),
    )


def light(df: DataFrame) -> DataFrame:
    """Reviews without texts: the scan then reads no text but for the label's words."""
    return df.select("app_id", "country", "source_review_id", "rank", "rating", "created_at", "language", "analysable")


def frames(reviews_: DataFrame) -> DataFrame:
    return reviews_.groupBy("app_id", "country").agg((F.count("*") * (F.col("app_id") + 1)).alias("reachable"))


def scored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = units.sentences(reviews(spark, sf_dir))
    label = sentiment.lexicon_scorer(F.col("sentence"), UNIT_NEGATIVE, UNIT_POSITIVE)["label"]
    # A score that the sentence's length gives, so that the gate has work at both thresholds.
    score = F.when(label == "negative", 0.4 + (F.length("sentence") % 60) / 100.0).otherwise(0.05)
    return s.withColumns({"label": label, "negative_score": F.round(score, 2)})


def kept_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unit_gate(scored_units(spark, sf_dir))


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units and their categories; units are stored, so that texts are cut and scored once, however often they are read."""
    u = stored(kept_units(spark, sf_dir))
    return u, categories.category_match(u, categories.lexicon_match(u, categories.lexicon(spark, LEXICON), GUARDED, GUARDS))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a true class by stars and two predictions by words."""
    r = reviews(spark, sf_dir)
    other = sentiment.lexicon_scorer(F.col("analysis_text"), ("thes",), ("than",))["label"]
    from ..functions import stats

    return r.select("source_review_id", F.col("rating").alias("star"), stats.star_class(F.col("rating")).alias("true"), F.col("sentiment_label").alias("shipping"), other.alias("challenger"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as units of themes: one group, reviews of two units, stars and dates from ids."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    when = F.when(F.col("vec_id") % 13 != 0, F.expr(f"TIMESTAMP '{REFERENCE}' - make_interval(0, 0, 0, CAST(vec_id * 53 % 1200 AS INT))"))
    return e.select(F.lit(1).alias("app_id"), F.lit("us").alias("country"), F.col("vec_id").alias("unit_id"), F.floor(F.col("vec_id") / 2).cast("long").alias("review_id"), F.col("embedding").alias("vector"), F.col("label").alias("cluster"), (F.col("vec_id") % 5 + 1).cast("int").alias("rating"), when.alias("created_at"), F.concat(F.lit("sentence number "), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 3 == 0, " of a text that is long enough").otherwise("")).alias("sentence"))


def feed_pages(spark: SparkSession, sf_dir: str, ids: int | None = 40) -> DataFrame:
    """conversations as pages of a feed, JSON text: an app, a turn and a running block of 150 ids, so some 50 of the app's entries. ids: how many different ones, null for all."""
    at = F.col("conv_id")
    page = F.col("turn") * F.lit(1 << 40) + F.coalesce(F.floor(at / 150), F.lit(0))
    said = lambda v: F.struct(v.cast("string").alias("label"))
    entry = F.struct(at.alias("at"), said(F.concat(F.lit("r"), (at % ids if ids else at).cast("string"))).alias("id"), said(F.lit("t")).alias("title"), said(F.lit("b")).alias("content"), said(at % 5 + 1).alias("im:rating"))
    pages = table(spark, sf_dir, "conversations").groupBy((at % 3).alias("app_id"), page.alias("page"))
    return pages.agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(entry)).alias("entry")).alias("feed"))).alias("value")).withColumn("country", F.lit("us"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as units of themes, with the words of each: five apps by conversation, stars and dates from ids."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    when = F.expr(f"TIMESTAMP '{REFERENCE}' - make_interval(0, 0, 0, CAST(conv_id * 53 % 1200 AS INT))")
    return c.select((F.col("conv_id") % 5).alias("app_id"), F.lit("us").alias("country"), F.concat_ws(":t", "conv_id", "turn").alias("unit_id"), F.col("conv_id").alias("review_id"), F.coalesce("text", F.lit("")).alias("sentence"), text.lexical(F.coalesce("text", F.lit(""))).alias("lexical_text"), (F.col("conv_id") % 5 + 1).cast("int").alias("rating"), when.alias("created_at"))
