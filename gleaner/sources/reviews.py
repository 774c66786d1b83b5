"""Reviews from stored JSON and tables. Schemas are given, never inferred: what they don't name, personal fields too, is never read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

REVIEW = """source_review_id string, rank bigint, country string, title string, body string, rating int, created_at timestamp, is_edited boolean,
  vote_count bigint, vote_sum bigint, has_developer_response boolean, developer_response_id string, developer_response_date timestamp,
  app_version string, provider string, source_flags array<string>"""
STORE_ROW = "struct<userReviewId:string,title:string,body:string,rating:string,date:string,isEdited:string,voteCount:string,voteSum:string,developerResponse:string>"
STORE = f"start bigint, country string, app_id bigint, userReviewList array<{STORE_ROW}>"
_L = "struct<label:string>"
ENTRY = f"array<struct<id:{_L},title:{_L},content:{_L},`im:rating`:{_L},`im:version`:{_L},updated:{_L},`im:voteCount`:{_L},`im:voteSum`:{_L}>>"
FRAME_MOST = 500


def parse_datetime(value: Column, iso_only: bool = False) -> Column:
    """A timestamp, as UTC if it says nothing else; null for what is none. Years or months alone are none."""
    v = F.trim(value)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(v))
    return iso if iso_only else F.coalesce(iso, F.try_to_timestamp(v, F.lit("MMM d, yyyy")), F.try_to_timestamp(v, F.lit("MMMM d, yyyy")))


def optional_int(value: Column) -> Column:
    v = F.nullif(F.trim(value), F.lit(""))
    return F.coalesce(v.try_cast("bigint"), F.when(v.rlike(r"^[+-]?\d+\.\d*$"), v.try_cast("double").try_cast("bigint")))


def optional_float(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit("")).try_cast("double")


def optional_bool(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False).when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint") != 0)


def typed_reviews(rows: DataFrame, provider: str = "store") -> DataFrame:
    """Raw store rows, typed; `valid` is false without an id or stars from 1 to 5. Adds flags for blank title, body, date."""
    rating = optional_int(F.col("rating"))
    title, body = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("body", F.lit("")))
    when = parse_datetime(F.col("date"))
    reply = F.from_json("developerResponse", "id string, modified string")
    has = F.coalesce(F.col("developerResponse").rlike(r'^\s*\{\s*"'), F.lit(False))
    flags = F.array_compact(F.array(F.when(title == "", "missing_or_blank_title"), F.when(body == "", "missing_or_blank_body"), F.when(when.isNull(), "missing_or_unparseable_date")))
    valid = (F.trim(F.coalesce("userReviewId", F.lit(""))) != "") & F.coalesce(rating.between(1, 5), F.lit(False))
    return rows.select("app_id", "country", F.trim("userReviewId").alias("source_review_id"), "rank", title.alias("title"), body.alias("body"), rating.cast("int").alias("rating"), when.alias("created_at"), optional_bool(F.col("isEdited")).alias("is_edited"), optional_int(F.col("voteCount")).alias("vote_count"), optional_int(F.col("voteSum")).alias("vote_sum"), has.alias("has_developer_response"), F.when(has, reply["id"]).alias("developer_response_id"), F.when(has, parse_datetime(reply["modified"])).alias("developer_response_date"), F.lit(None).cast("string").alias("app_version"), F.lit(provider).alias("provider"), flags.alias("source_flags"), valid.alias("valid"))


def read_store_rows(spark: SparkSession, path: str) -> DataFrame:
    """Pages of store rows as reviews; rank is the page's start plus the place on it."""
    pages = spark.read.schema(STORE).json(path)
    rows = pages.select("app_id", "country", "start", F.posexplode("userReviewList").alias("_i", "_r")).withColumn("rank", F.col("start") + F.col("_i"))
    return typed_reviews(rows.select("app_id", "country", "rank", "_r.*"))


def feed_entries(pages: DataFrame) -> DataFrame:
    """Pages (app_id, country, page, value: JSON text) as entries; a lone entry is a list of one, and only rated ones are reviews."""
    got = pages.select("app_id", "country", "page", F.posexplode(F.from_json(F.get_json_object("value", "$.feed.entry"), ENTRY)).alias("pos", "e"))
    said = lambda n: F.col(f"e.`{n}`.label")
    rated = got.where(said("im:rating").isNotNull())
    return rated.select("app_id", "country", "page", "pos", F.trim(said("id")).alias("source_review_id"), F.trim(F.coalesce(said("title"), F.lit(""))).alias("title"), F.trim(F.coalesce(said("content"), F.lit(""))).alias("body"), optional_int(said("im:rating")).cast("int").alias("rating"), parse_datetime(said("updated"), iso_only=True).alias("created_at"), F.nullif(F.trim(said("im:version")), F.lit("")).alias("app_version"), optional_int(said("im:voteCount")).alias("vote_count"), optional_int(said("im:voteSum")).alias("vote_sum"))


def feed_frame(entries: DataFrame, most: int = FRAME_MOST) -> DataFrame:
    """Entries in page order, the first of each id, ranked from 0; at most `most` an app and country."""
    rest = [c for c in entries.columns if c not in ("app_id", "country", "source_review_id", "page", "pos")]
    # The first of an id is taken in each task before rows are moved, so an id may be as frequent as it likes.
    once = entries.groupBy("app_id", "country", "source_review_id").agg(F.min(F.struct("page", "pos", *rest)).alias("_e"))
    once = once.select("app_id", "country", F.col("_e.page").alias("page"), F.col("_e.pos").alias("pos"), "source_review_id", *[F.col(f"_e.{c}").alias(c) for c in rest])
    place = Window.partitionBy("app_id", "country").orderBy("page", "pos")
    return once.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).withColumn("rank", (F.col("_n") - 1).cast("long")).drop("_n")


def parse_app_id(value: Column) -> Column:
    """An app's number from digits or a store address, null if it is none of 1 to 2**63 - 1."""
    v = F.trim(value)
    host = F.lower(F.try_parse_url(v, F.lit("HOST")))
    path = F.regexp_extract(F.try_parse_url(v, F.lit("PATH")), r"/id([0-9]{1,19})(?:[/?#]|$)", 1)
    digits = F.when(v.rlike("^[0-9]{1,19}$"), v).when(host.isin("apps.apple.com", "itunes.apple.com"), F.nullif(path, F.lit("")))
    number = digits.try_cast("bigint")
    return F.when(number > 0, number)


def normalise_country(df: DataFrame, supported: DataFrame, column: str = "country") -> DataFrame:
    """Rows of supported countries (a table with column country), in lower case."""
    return df.withColumn(column, F.lower(F.trim(column))).join(supported.select(F.col("country").alias(column)), column, "left_semi")


def window_frame(reviews: DataFrame, reference: str, days: int) -> DataFrame:
    """The reviews of the last `days` before the reference; the filter reaches the scan."""
    if not 1 <= days <= 36_500:
        raise ValueError("days lie between 1 and 36500")
    return reviews.where(F.col("created_at") >= F.lit(reference).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def preprocess(reviews: DataFrame, language: Column | None = None) -> DataFrame:
    """Reviews with analysis_text, lexical_text, language, analysable and flags. `language`: a column, else `language` of the input."""
    lang = language if language is not None else F.col("language")
    clean = reviews.withColumns({"_t": text.normalise(F.col("title")), "_b": text.normalise(F.col("body"))})
    clean = clean.withColumn("analysis_text", text.joined(F.col("_t"), F.col("_b")))
    clean = clean.withColumn("language", F.when(F.length("analysis_text") < text.FEWEST_LETTERS, "und").otherwise(lang))
    clean = clean.withColumn("lexical_text", text.lexical(F.col("analysis_text")))
    clean = clean.withColumn("flags", text.flags(F.col("analysis_text"), F.col("_t"), F.col("_b"), F.col("language"), F.col("source_flags")))
    return clean.withColumn("analysable", text.analysable(F.col("analysis_text"), F.col("language"))).drop("_t", "_b")
