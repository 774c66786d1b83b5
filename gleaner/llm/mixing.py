"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source's target is its share, by weight, of the words asked for, clamped at `max_epochs` times the words it has;
what a clamp leaves over is shared among the others by weight until no target is above its clamp. That fixed point is
min(clamp, level * weight): with sources sorted by clamp / weight, the level follows from prefix sums.

Each document is taken floor(target / words of its source) times whole. The rest of the target goes, whole, to
the first documents of the source in an order seeded by MD5, and the document on the border gives the words
that are still missing: a source's words differ from its target by the rounding to whole words only.
To find the border no source is gathered: MD5 buckets are summed first, and only documents of a source's
border bucket are put in order.

Null source: a source of its own, last. Null text: no words, taken 0. Of very long texts only sizes and keys are moved. Repeated rows: each is a document of its own;
which of two equal rows gives the border's words is the only thing left open. No documents: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, word_count, written

WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of MD5 that make a bucket: 65,536 buckets to a source.
BUCKET_DIGITS = 4
SALTS = 64


def order_key(seed: int) -> Column:
    """MD5 by which a source's documents are put in order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def plan(sizes: DataFrame, total_share: float, max_epochs: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets by source. `sizes`: a row for each source with source and source_size; so is the result."""
    named = Window.orderBy(F.col("source").asc_nulls_last())
    kept = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")))
    kept = kept.withColumn("clamp", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("wanted", F.lit(float(total_share)) * F.sum("source_size").over(Window.partitionBy()))
    filled = Window.orderBy((F.col("clamp") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("wanted") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    kept = kept.withColumn("level", level)
    # Below the first source that the level leaves under its clamp, all are clamped; from it on, the level is that one's.
    kept = kept.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("clamp"), F.struct(F.col("clamp") / F.col("weight"), F.coalesce(F.col("source"), F.lit("")), F.col("level").alias("level")))).over(Window.partitionBy())["level"])
    return kept.select("source", "source_size", F.coalesce(F.least("clamp", F.col("level") * F.col("weight")), F.col("clamp")).alias("target"))


def _settled(docs: DataFrame, total_share: float, max_epochs: float, weights: tuple[int, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and order keys, written, and the plan: a row for each source and salt."""
    seen = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(seed).alias("key")), "mixing")
    seen = seen.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = written(seen.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mixing-buckets")
    targets = plan(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), total_share, max_epochs, weights)
    targets = targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("more", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    # 65,536 sums for a source at most, whatever its share of the documents.
    lines = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    borders = buckets.withColumn("before", F.coalesce(F.sum("words").over(lines), F.lit(0)))
    borders = borders.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    borders = borders.where("before <= more AND more < before + words").groupBy(F.col("a.source").alias("source")).agg(F.min_by("bucket", "before").alias("border"), F.min("before").alias("before"))
    full = targets.alias("t").join(borders.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source")), "left").select("t.*", "b.border", "b.before")
    # A source may hold a third of all rows: its plan is repeated for each salt, its documents are dealt among them.
    return seen, full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _planned(seen: DataFrame, full: DataFrame, *more: str) -> DataFrame:
    """`seen` with its source's plan; Spark broadcasts the plan if it measures it small, and else deals both by source and salt."""
    dealt = seen.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    cols = [*more, "doc_id", "size", "d.source", "source_size", "target", "times", "more", "border", "before", "bucket", "key"]
    return dealt.alias("d").join(full.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.salt") == F.col("f.salt"))).select(*cols)


def _whole(of: str = "") -> Column:
    """Words beyond whole repetitions that a document outside its source's border bucket gives."""
    c = lambda name: F.col(f"{of}{name}")
    return F.when(c("border").isNull(), F.when(c("more") > 0, c("size")).otherwise(F.lit(0))).when(c("bucket") < c("border"), c("size")).otherwise(F.lit(0))


def _cut(joined: DataFrame) -> DataFrame:
    """The documents of border buckets, with `extra`: the words that each gives beyond whole repetitions."""
    run = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("more") - F.col("before") - F.coalesce(F.sum("size").over(run), F.lit(0))
    return joined.where("bucket = border").withColumn("extra", F.greatest(F.least(left, F.col("size")), F.lit(0)))


def mix(docs: DataFrame, total_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """doc_id, size, source, source_size, target and taken for each document of `docs` (doc_id, text, source)."""
    joined = _planned(*_settled(docs, total_share, max_epochs, weights, seed))
    out = ["doc_id", "size", "source", "source_size", "target"]
    whole = joined.where("border IS NULL OR bucket <> border").withColumn("extra", _whole())
    every = whole.select(*out, "times", "extra").unionByName(_cut(joined).select(*out, "times", "extra"))
    return every.select(*out, (F.col("times") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def repeated(docs: DataFrame, total_share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix itself: rows of `docs`, all columns, as often as it takes them; a part of a document counts if it is half or more.

    A document without words comes as often as its source is repeated whole.
    """
    seen, full = _settled(docs, total_share, max_epochs, weights, seed)
    # The borders' decisions are few, a bucket for each source; the documents themselves, whole rows whatever their columns' names, are
    # joined to the plan in place. Equal rows share a key: of `_n` such rows `_some` come once more.
    half = (F.col("size") > 0) & (2 * F.col("extra") >= F.col("size"))
    cut = written(_cut(_planned(seen, full)).groupBy("source", "key").agg(F.count("*").alias("_n"), F.count_if(half).alias("_some")), "mixing-borders")
    text = docs.select("doc_id", "source", order_key(seed).alias("key"), word_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    joined = _planned(text.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), full, "row").alias("j").join(cut.alias("c"), F.col("j.source").eqNullSafe(F.col("c.source")) & (F.col("j.key") == F.col("c.key")), "left")
    inside = (F.col("j.size") > 0) & (2 * _whole("j.") >= F.col("j.size"))
    once_more = F.when(F.col("j.bucket") == F.col("j.border"), F.coalesce(F.col("c._some") > 0, F.lit(False))).otherwise(inside)
    split = F.coalesce((F.col("j.bucket") == F.col("j.border")) & (F.col("c._some") > 0) & (F.col("c._some") < F.col("c._n")), F.lit(False))
    rows = joined.select("j.row", "j.source", "j.key", "j.times", "c._some", once_more.alias("_more"), split.alias("_split"))
    taken = rows.where("NOT _split").select("row", (F.col("times") + F.col("_more").cast("int")).alias("copies"))
    if not cut.where("_some > 0 AND _some < _n").isEmpty():
        # A border within equal rows, of one key a source at most: the rows are told apart by a number.
        number = F.row_number().over(Window.partitionBy("source", "key").orderBy(F.lit(0)))
        taken = taken.unionByName(rows.where("_split").withColumn("_i", number).select("row", (F.col("times") + (F.col("_i") <= F.col("_some")).cast("int")).alias("copies")))
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


ORACLE = r"""
WITH seen AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM seen GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
         2.0::DOUBLE * source_size AS clamp, 1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM sizes),
levels AS (
  SELECT *, (wanted - coalesce(sum(clamp) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level FROM weighed
  WINDOW below AS (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT level FROM levels WHERE level * weight <= clamp ORDER BY clamp / weight, coalesce(source, '') LIMIT 1),
targets AS (SELECT source, source_size, least(clamp, (SELECT level FROM level) * weight) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.times, CAST(round(p.target - p.times * p.source_size) AS BIGINT) AS more,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM seen s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(times * size + greatest(least(more - before, size), 0) AS BIGINT) AS taken FROM ordered
"""
