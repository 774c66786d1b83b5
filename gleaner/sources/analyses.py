"""Stored analyses: a nested row for each, and its reviews by position, both partitioned by analysis_id.

An insert claims each id by creating a file that must not exist yet, so that of two writers one is refused, and gives the claim back if it
fails; a replacement rewrites the partitions of its ids alone. One analysis' reviews are split over tasks by position. Reviews are written before the
analysis' row, so what can be read is whole. Reads prune to the partition of the id: as functions of this module, or, after `register`, as SQL
table functions with the id as parameter.

Rows without an id, or ids that the other table doesn't have, are refused with ValueError. Extra columns are stored as they are. Ids are strings, whatever
they look like.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("preprocessing", "metrics", "sentiment", "keywords")
INSIGHTS = ("themes", "insights")
#: Reviews of one analysis in one task, and analyses of one call.
PART_ROWS = 100_000
MOST = 10_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _claim(spark: SparkSession, path: str, name: str) -> bool:
    """Create the file of an id; false if it is there."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/_claims/{quote(name, safe='')}")
    try:
        fs.create(p, False).close()
    except Exception as e:  # noqa: BLE001  the store's own exception arrives as one of the gateway
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def _release(spark: SparkSession, path: str, names: list[str]) -> None:
    for name in names:
        fs, p = _fs(spark, f"{path.rstrip('/')}/_claims/{quote(name, safe='')}")
        fs.delete(p, False)


def _ids(df: DataFrame) -> set[str]:
    got = {r["analysis_id"] for r in df.select("analysis_id").distinct().limit(MOST + 1).collect()}
    if None in got or len(got) > MOST:
        raise ValueError("an analysis has no id" if None in got else f"more than {MOST} analyses at once")
    return got


def save(spark: SparkSession, analyses: DataFrame, reviews: DataFrame, path: str, replace: bool = False) -> None:
    """Store `analyses` (analysis_id, nested columns; a row each) and their `reviews` (analysis_id, position, ...)."""
    analyses, reviews = (df.withColumn("analysis_id", F.col("analysis_id").cast("string")) for df in (analyses, reviews))
    ids, of = _ids(analyses), _ids(reviews)
    if of - ids:
        raise ValueError(f"reviews of unknown analyses: {sorted(of - ids)[:5]}")
    if analyses.groupBy("analysis_id").count().where("count > 1").limit(1).count():
        raise ValueError("an analysis has several rows")
    claimed: list[str] = []
    try:
        for name in sorted(ids):
            if _claim(spark, path, name):
                claimed.append(name)
            elif not replace:
                raise ValueError(f"an analysis with the id {name!r} is stored already")
        place = F.floor(F.col("position") / PART_ROWS)
        dealt = reviews.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "analysis_id", place).sortWithinPartitions("analysis_id", "position")
        for df, name in ((dealt, "reviews"), (analyses.repartition("analysis_id"), "analyses")):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(f"{path.rstrip('/')}/{name}")
    except Exception:
        _release(spark, path, claimed)
        raise
    for name in ids - of if replace else ():
        # The new analysis has no reviews: the earlier one's go.
        folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
        fs, p = _fs(spark, f"{path.rstrip('/')}/reviews/analysis_id={folder}")
        fs.delete(p, True)


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table whose ids are strings."""
    where = f"{path.rstrip('/')}/{name}"
    found = spark.read.parquet(where).schema
    kind = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "analysis_id" else f for f in found])
    return spark.read.schema(kind).parquet(where)


def get_analysis(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    """The row of one analysis, none if there is none."""
    return _table(spark, path, "analyses").where(F.col("analysis_id") == analysis_id)


def get_reviews(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    """The reviews of one analysis in order."""
    return _table(spark, path, "reviews").where(F.col("analysis_id") == analysis_id).orderBy("position")


def metrics_view(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    """What an analysis says of texts, stars, labels and phrases; columns that weren't stored are left out."""
    got = get_analysis(spark, path, analysis_id)
    return got.select("analysis_id", *[c for c in METRICS if c in got.columns])


def insights_view(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    """Themes and areas of an analysis."""
    got = get_analysis(spark, path, analysis_id)
    return got.select("analysis_id", *[c for c in INSIGHTS if c in got.columns])


def register(spark: SparkSession, path: str, prefix: str = "stored") -> None:
    """SQL table functions of this session: `<prefix>_analysis(id)`, `_reviews(id)`, `_metrics(id)`, `_insights(id)`."""
    for name in ("analyses", "reviews"):
        _table(spark, path, name).createOrReplaceTempView(f"{prefix}_{name}_table")
    analyses, reviews = spark.table(f"{prefix}_analyses_table"), spark.table(f"{prefix}_reviews_table")
    views = {"analysis": (analyses, analyses.columns), "metrics": (analyses, ["analysis_id", *[c for c in METRICS if c in analyses.columns]]), "insights": (analyses, ["analysis_id", *[c for c in INSIGHTS if c in analyses.columns]]), "reviews": (reviews, reviews.columns)}
    for name, (df, columns) in views.items():
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
        listed = ", ".join(f"`{c}`" for c in columns)
        table = f"{prefix}_{'reviews' if name == 'reviews' else 'analyses'}_table"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}(wanted STRING) RETURNS TABLE ({kinds}) RETURN SELECT {listed} FROM {table} WHERE analysis_id = wanted")
