"""Exports of reviews and collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

RAW = ("source_review_id", "rank", "country", "title", "body", "rating", "created_at", "is_edited", "vote_count", "vote_sum", "has_developer_response", "app_version", "provider", "source_flags")
ANALYSED = (*RAW, "analysis_text", "language", "analysable", "sentiment_label", "class_scores", "flags")


def export_rows(reviews: DataFrame, columns: Sequence[str] = RAW) -> DataFrame:
    """Listed columns only: dates in ISO form, lists and maps as JSON, texts safe for spreadsheets. Missing ones are null."""
    out = []
    for c in columns:
        if c not in reviews.columns:
            out.append(F.lit(None).cast("string").alias(c))
            continue
        kind = dict(reviews.dtypes)[c]
        if kind == "timestamp":
            out.append(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c))
        elif kind.startswith(("array", "map", "struct")):
            out.append(F.to_json(c).alias(c))
        elif kind == "string":
            out.append(text.csv_safe(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return reviews.select(*out)


def write_reviews_csv(reviews: DataFrame, path: str, columns: Sequence[str] = RAW, sep: str = ",") -> None:
    """RFC 4180 with CRLF; leading white space, the protecting TAB among it, is kept. Spark writes no byte-order mark."""
    if sep not in (",", ";"):
        raise ValueError("the delimiter is , or ;")
    export_rows(reviews, columns).write.mode("errorifexists").options(header=True, sep=sep, quote='"', escape='"', lineSep="\r\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(path)


def collection_documents(reviews: DataFrame, apps: DataFrame, group: Sequence[str] = ("app_id", "country"), part_rows: int = 10_000) -> DataFrame:
    """Nested documents of an app and its reviews; large apps give several, so that none holds an unbounded list."""
    parts = reviews.withColumn("part", F.floor(F.col("rank") / part_rows))
    lists = parts.groupBy(*group, "part").agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in RAW if c in reviews.columns and c not in ("rank", *group)]))).alias("reviews"))
    return lists.join(apps, list(group), "left")


def write_collection_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("errorifexists").json(path)
