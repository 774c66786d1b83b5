"""Phrases of negative reviews: document frequencies, Fightin' Words, tables of common and distinctive ones.

A phrase's counts for the group and the rest come from one aggregation; evidence is aggregated along, never joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text, wordlists
from . import GROUP, grams
from .graph import stored

A0 = 100.0
MOST = 15
BLOCKED = wordlists.STOPWORDS + wordlists.NEGATIONS + wordlists.FILLERS + wordlists.APP_WORDS


def recent(reference: str, days: int = 365, column: str = "created_at") -> Column:
    """Whether a date is in the last `days` before the reference; null isn't."""
    return F.coalesce(F.col(column) >= F.lit(reference).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def phrase_counts(reviews: DataFrame, reference: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Documents with each phrase among negative (support) and other analysable reviews (rest), and of the negative ones the first rank,
    the newest date and how many are recent. Tasks count what they read (`grams`), so that few strings are made and shuffled.
    """
    return _counted(_flagged(reviews, reference, group), group)


def _flagged(reviews: DataFrame, reference: str, group: Sequence[str]) -> DataFrame:
    bad = F.coalesce(F.col("sentiment_label") == "negative", F.lit(False))
    neg = lambda c: F.when(bad, c)
    flags = (bad.alias("support"), (~bad).alias("rest"), neg(F.col("rank").cast("bigint")).alias("first_rank"), neg(F.col("created_at")).alias("newest"), (bad & recent(reference)).alias("_n_recent"))
    return reviews.where("analysable").select(*group, *flags, "lexical_text")


def _counted(rows: DataFrame, group: Sequence[str], screened: Broadcast | None = None) -> DataFrame:
    return grams.counted(rows, group, sums=["support", "rest", "_n_recent"], least=["first_rank"], greatest=["newest"], screened=screened)


def supported(reviews: DataFrame, reference: str, sizes: DataFrame, group: Sequence[str] = GROUP) -> tuple[DataFrame, DataFrame]:
    """Of `phrase_counts` the phrases with the least support of any group of `sizes` (of `totals`), stored, and the sums of all phrases that `fightin_words` takes.

    Few phrases have it: what negative reviews may have is found by hashes (`grams.screen`), and only that is spelled out and moved.
    """
    rows = _flagged(reviews, reference, group)
    least = sizes.where("status = 'ok'").agg(F.min("min_support")).first()[0] or 2
    screened = reviews.sparkSession.sparkContext.broadcast(grams.screen(rows.where("support"), group, least))
    found = stored(_counted(rows, group, screened).where((F.col("support") >= least) | F.col("phrase").isNull()))
    screened.destroy()
    return found.where("phrase IS NOT NULL"), found.where("phrase IS NULL").select(*group, F.col("support").alias("_ng"), F.col("rest").alias("_nr"))


def with_examples(rows: DataFrame, reviews: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """`rows` with example_review_id: the negative analysable review of rank first_rank. Ranks are a frame's places, one review each."""
    shown = reviews.where("analysable AND sentiment_label = 'negative' AND rank IS NOT NULL").groupBy(*group, F.col("rank").cast("bigint").alias("first_rank")).agg(F.min("source_review_id").alias("example_review_id"))
    return rows.join(shown, [*group, "first_rank"], "left")


def phrase_support(reviews: DataFrame, reference: str, group: Sequence[str] = GROUP) -> DataFrame:
    """`phrase_counts` with an example of each phrase."""
    return with_examples(phrase_counts(reviews, reference, group), reviews, group)


def totals(reviews: DataFrame, group: Sequence[str] = GROUP, apps: DataFrame | None = None) -> DataFrame:
    """n_negative, n_rest and the least support of each group; with `apps` (group, name) also the words of its app's name, which block phrases."""
    bad = F.coalesce(F.col("sentiment_label") == "negative", F.lit(False))
    got = reviews.where("analysable").groupBy(*group).agg(F.count_if(bad).alias("n_negative"), F.count_if(~bad).alias("n_rest"))
    if apps is not None:
        got = got.join(own_words(apps, group), list(group), "left")
    return got.withColumn("min_support", F.when(F.col("n_negative") >= 30, 3).otherwise(2)).withColumn("status", F.when(F.col("n_negative") < 5, "insufficient_negative_signal").otherwise("ok"))


def _sums(counts: DataFrame, group: Sequence[str], own: str = "support", rest: str = "rest") -> DataFrame:
    return counts.groupBy(*group).agg(F.sum(own).alias("_ng"), F.sum(rest).alias("_nr"))


def fightin_words(counts: DataFrame, group: Sequence[str] = GROUP, a0: float = A0, own: str = "support", rest: str = "rest", totals: DataFrame | None = None) -> DataFrame:
    """`counts` (group, phrase, own, rest) with z: log odds with a Dirichlet prior of weight a0, by their deviation.

    Rows whose logarithms have no argument above 0 are left out. Totals are sums of a group's counts, joined as small rows; `totals`
    gives those of a whole vocabulary where `counts` is a part of it.
    """
    sums = totals if totals is not None else _sums(counts, group, own, rest)
    y, x = F.col(own), F.col(rest)
    a = F.lit(a0) * (y + x) / (F.col("_ng") + F.col("_nr"))
    over, under = F.col("_ng") + a0 - y - a, F.col("_nr") + a0 - x - a
    # A row for each group is broadcast: a join dealt by a handful of groups would bring all phrases of one to a task.
    joined = counts.join(F.broadcast(sums), list(group)).where("_ng > 0").withColumns({"_a": a, "_o": over, "_u": under}).where("_o > 0 AND _u > 0").where((y + F.col("_a") > 0) & (x + F.col("_a") > 0))
    delta = F.log((y + F.col("_a")) / F.col("_o")) - F.log((x + F.col("_a")) / F.col("_u"))
    return joined.withColumn("z", delta / F.sqrt(1 / (y + F.col("_a")) + 1 / (x + F.col("_a")))).drop("_ng", "_nr", "_a", "_o", "_u")


def _parts(rows: DataFrame, group: Sequence[str], *more: str) -> DataFrame:
    """Every shorter phrase within a phrase of `rows`."""
    keys = list(dict.fromkeys([*group, *more, "phrase"]))
    cut = rows.select(*keys, F.split("phrase", " ").alias("_w"))
    return cut.select(*keys, F.explode(text.ngrams(F.col("_w"), 2)).alias("part")).where("part <> phrase").select(*group, *more, "part")


def drop_subsumed(rows: DataFrame, group: Sequence[str] = GROUP, prefer_longer: bool = True, same_support: bool = True) -> DataFrame:
    """Without phrases that a longer one (or, else, a shorter one) of the input makes redundant; by equi-joins on parts."""
    more = ["support"] if same_support else []
    if prefer_longer:
        inside = _parts(rows, group, *more).select(*group, *more, F.col("part").alias("phrase")).distinct()
        return rows.join(inside, [*group, *more, "phrase"], "left_anti")
    tagged = _parts(rows, group, *more, "phrase")
    there = rows.select(*group, *more, F.col("phrase").alias("part")).distinct()
    redundant = tagged.join(there, [*group, *more, "part"], "left_semi").select(*group, *more, "phrase").distinct()
    return rows.join(redundant, [*group, *more, "phrase"], "left_anti")


def _ranked(rows: DataFrame, order: Sequence[Column], most: int, group: Sequence[str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= most)


def own_words(apps: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """group, own_words: the words of each app's name (`apps`: group, name), which its phrases can't consist of alone. A row for each app."""
    words = F.array_distinct(F.flatten(F.collect_list(text.words(text.lexical(F.coalesce("name", F.lit("")))))))
    return apps.groupBy(*group).agg(words.alias("own_words"))


def _eligible(counts: DataFrame, sizes: DataFrame, blocked: Sequence[str], group: Sequence[str]) -> DataFrame:
    # Stored before phrases are looked at: Spark would move that test below the counting, to all that occur.
    rows = stored(counts.join(F.broadcast(sizes.where("status = 'ok'")), list(group)).where("support >= min_support"))
    if "own_words" in sizes.columns:
        listed = F.concat(F.array(*[F.lit(w) for w in blocked]).cast("array<string>"), F.coalesce("own_words", F.array().cast("array<string>")))
        rows = rows.where(text.displayable(F.col("phrase"), listed)).drop("own_words")
    else:
        rows = rows.where(text.displayable(F.col("phrase"), blocked))
    return rows.withColumn("share_last_12_months", stats.share(F.col("_n_recent"), F.col("support")))


OUT = ("phrase", "support", "n_negative", "rest", "n_rest", "first_rank", "newest", "share_last_12_months")


def common_phrases(counts: DataFrame, sizes: DataFrame, blocked: Sequence[str] = BLOCKED, most: int = MOST, group: Sequence[str] = GROUP) -> DataFrame:
    """The most supported displayable phrases; a part of a longer phrase with equal support is left out.

    `counts`: of `phrase_counts`; `with_examples` tells the reviews of the phrases that are left. What has support is stored, so that
    the corpus's phrases are counted once.
    """
    rows = drop_subsumed(_eligible(counts, sizes, blocked, group), group)
    return _ranked(rows, [F.col("support").desc(), F.col("phrase")], most, group).select(*group, "rank", *OUT)


def distinctive_phrases(counts: DataFrame, sizes: DataFrame, blocked: Sequence[str] = BLOCKED, most: int = MOST, group: Sequence[str] = GROUP, a0: float = A0, sums: DataFrame | None = None) -> DataFrame:
    """The phrases with the greatest positive z. `counts`: of `phrase_counts`, stored once and read for its totals and for what has support; or, with its sums, of `supported`."""
    if sums is None:
        counts = stored(counts)
        sums = _sums(counts, group)
    few = _eligible(counts, sizes, blocked, group)
    rows = drop_subsumed(stored(fightin_words(few, group, a0, totals=sums).where("z > 0")), group)
    return _ranked(rows, [F.col("z").desc(), F.col("support").desc(), F.col("phrase")], most, group).select(*group, "rank", *OUT, "z", (F.col("z") >= 1.96).alias("z_ge_1_96"))


def group_phrases(units: DataFrame, cluster: str = "cluster", blocked: Sequence[str] = BLOCKED, most: int = 5, group: Sequence[str] = GROUP) -> DataFrame:
    """Short labels of each cluster of `units` (lexical_text): its phrases against the other units', in one pass for all clusters.

    Units' words and the phrases of each cluster are stored, so that neither is made again for each sum.
    """
    keys = [*group, cluster]
    units = stored(units.select(*keys, "lexical_text"))
    own = stored(grams.counted(units, keys, count="support"))
    # z needs the vocabulary's totals: a cluster's own sum, and the group's less that. Stored, they are as small as Spark sees, and broadcast.
    sums = stored(units.groupBy(*keys).agg(F.count("*").alias("_units")).join(own.groupBy(*keys).agg(F.sum("support").alias("_ng")), keys))
    whole = own.groupBy(*group).agg(F.sum("support").alias("_nt"))
    few = own.join(sums, keys).where(F.col("support") >= F.when(F.col("_units") == 1, 1).otherwise(2))
    everywhere = own.groupBy(*group, "phrase").agg(F.sum("support").alias("_all"))
    joined = few.join(everywhere, [*group, "phrase"]).join(F.broadcast(whole), list(group))
    y, x, nr = F.col("support"), F.col("_all") - F.col("support"), F.col("_nt") - F.col("_ng")
    a = F.lit(A0) * (y + x) / F.col("_nt")
    z = (F.log((y + a) / (F.col("_ng") + A0 - y - a)) - F.log((x + a) / (nr + A0 - x - a))) / F.sqrt(1 / (y + a) + 1 / (x + a))
    rows = stored(joined.select(*keys, "phrase", "support", z.alias("z"))).where(text.displayable(F.col("phrase"), blocked))
    kept = drop_subsumed(rows, keys, prefer_longer=False, same_support=False)
    return _ranked(kept, [F.col("z").desc(), F.col("phrase")], most, keys).select(*keys, "rank", "phrase", "support", "z")
