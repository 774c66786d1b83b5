"""Rating statistics with intervals, by group and by merged years."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import GROUP
from .sketches import bottom_k

LEAST_IN_PERIOD = 15


def rating_summary(reviews: DataFrame, frames: DataFrame | None = None, group: Sequence[str] = GROUP) -> DataFrame:
    """n, mean, median, stddev and, with `frames` (group, reachable), sampling fraction and census.

    Where `frames` has store_mean, rating_count or histogram, they are passed through as store_benchmark: stores count star-only
    ratings too, so that is another population than the sampled reviews, to be shown beside their mean and never pooled with it.
    """
    got = reviews.groupBy(*group).agg(F.count("*").alias("n"), F.avg("rating").alias("mean"), F.median("rating").alias("median"), F.stddev_samp("rating").alias("stddev"))
    if frames is None:
        return got
    shown = [c for c in ("store_mean", "rating_count", "histogram") if c in frames.columns]
    got = got.join(frames.select(*group, "reachable", *shown), list(group))
    if shown:
        got = got.withColumn("store_benchmark", F.struct(*shown)).drop(*shown)
    return got.withColumn("sampling_fraction", stats.share(F.col("n"), F.col("reachable"))).withColumn("census", F.col("n") == F.col("reachable"))


def distribution(df: DataFrame, value: str, values: Sequence, population: str = "reachable", group: Sequence[str] = GROUP) -> DataFrame:
    """Count, share and interval of each of `values`, also of those that a group lacks. One aggregation, no join."""
    pick = [F.count_if(F.col(value) == v).alias(f"_{i}") for i, v in enumerate(values)]
    wide = df.groupBy(*group).agg(F.count_if(F.col(value).isNotNull()).alias("n"), F.max(population).alias("population"), *pick)
    long = wide.select(*group, "n", "population", F.explode(F.array(*[F.struct(F.lit(v).alias(value), F.col(f"_{i}").alias("count")) for i, v in enumerate(values)])).alias("x")).select(*group, "n", "population", "x.*")
    return long.withColumn("share", stats.share(F.col("count"), F.col("n"))).withColumn("ci95", stats.proportion(F.col("count"), F.col("n"), F.col("population")))


def store_mean(frames: DataFrame) -> DataFrame:
    """Mean of a five-bin histogram and whether it agrees with the mean looked up (columns histogram, looked_up)."""
    total = F.aggregate("histogram", F.lit(0).cast("bigint"), lambda s, x: s + x)
    weighed = F.aggregate(F.transform("histogram", lambda x, i: x * (i + 1)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return frames.withColumn("store_mean", F.try_divide(weighed, total)).withColumn("agrees", F.abs(F.col("store_mean") - F.col("looked_up")) <= 0.01)


def year_buckets(reviews: DataFrame, least: int = LEAST_IN_PERIOD, group: Sequence[str] = GROUP) -> DataFrame:
    """group, year and bucket: years from the newest on, merged until a bucket has enough; a rest joins the last bucket."""
    years = reviews.where(F.col("created_at").isNotNull()).groupBy(*group, F.year("created_at").alias("year")).agg(F.count("*").alias("n"))
    lists = years.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct((-F.col("year")).alias("y"), F.col("n").cast("int").alias("n")))).alias("all"))
    start = F.struct(F.lit(0).alias("bucket"), F.lit(0).alias("held"), F.array().cast("array<struct<year:int,bucket:int>>").alias("out"))

    def step(s, x):
        held = s["held"] + x["n"]
        full = held >= least
        return F.struct((s["bucket"] + full.cast("int")).alias("bucket"), F.when(full, 0).otherwise(held).alias("held"), F.concat(s["out"], F.array(F.struct((-x["y"]).alias("year"), s["bucket"].alias("bucket")))).alias("out"))

    done = lists.select(*group, F.aggregate("all", start, step).alias("s"))
    last = F.when(F.col("s.held") > 0, F.greatest(F.col("s.bucket") - 1, F.lit(0))).otherwise(F.col("s.bucket"))
    return done.select(*group, F.explode("s.out").alias("x"), last.alias("last")).select(*group, "x.year", F.least("x.bucket", "last").alias("bucket"))


def period_metrics(reviews: DataFrame, least: int = LEAST_IN_PERIOD, group: Sequence[str] = GROUP) -> DataFrame:
    """By merged years, newest first: n, mean, share of one and two stars with its interval. `reviews` has reachable."""
    dated = reviews.withColumn("year", F.year("created_at")).join(year_buckets(reviews, least, group), [*group, "year"])
    got = dated.groupBy(*group, "bucket").agg(F.min("year").alias("_a"), F.max("year").alias("_b"), F.count("*").alias("n"), F.avg("rating").alias("mean"), F.count_if(F.col("rating") <= 2).alias("low"), F.max("reachable").alias("_r"))
    label = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).otherwise(F.concat_ws("-", "_a", "_b"))
    # A census of the group is one of each period.
    whole = reviews.groupBy(*group).agg((F.count("*") == F.max("reachable")).alias("_census"))
    got = got.join(whole, list(group))
    ci = stats.proportion(F.col("low"), F.col("n"), F.when(F.col("_census"), F.col("n")).otherwise(F.greatest("_r", F.col("n") + 1)))
    return got.select(*group, "bucket", label.alias("label"), "n", "mean", stats.share(F.col("low"), F.col("n")).alias("low_share"), ci.alias("low_ci95"))


def population_walk(reviews: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Whole-frame aggregate: total, mean, histogram of stars, reviews by year."""
    by_year = reviews.where(F.col("created_at").isNotNull()).groupBy(*group, F.year("created_at").alias("y")).agg(F.count("*").alias("n")).groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("y", "n")))).alias("per_year"))
    stars = [F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in range(1, 6)]
    return reviews.groupBy(*group).agg(F.count("*").alias("total"), F.avg("rating").alias("mean"), *stars).join(by_year, list(group), "left")


def frame_weights(reviews: DataFrame, stratum: str = "rating", group: Sequence[str] = GROUP) -> DataFrame:
    """Counts and shares of strata."""
    counts = reviews.groupBy(*group, stratum).agg(F.count("*").alias("count"))
    totals = reviews.groupBy(*group).agg(F.count("*").alias("total"))
    return counts.join(totals, list(group)).withColumn("share", stats.share(F.col("count"), F.col("total")))


def population_compare(sample: DataFrame, population: DataFrame, group: Sequence[str] = GROUP, window_days: int | None = None) -> DataFrame:
    """Do a sample's intervals cover the population's shares? Both: group, rating, share; the sample with ci95, and population where the frame's size is known.

    `skipped` says why there is no comparison: the sample's frame is a window, no walk of this app and storefront, a walk of another frame
    (`population` with total), or no interval.
    """
    total = F.max("total") if "total" in population.columns else F.lit(None).cast("long")
    walked = population.groupBy(*group).agg(F.lit(True).alias("_walk"), total.alias("_walked"))
    shares = population.select(*group, "rating", F.col("share").alias("_share"))
    both = sample.join(walked, list(group), "left").join(shares, [*group, "rating"], "left")
    both = both.withColumn("true_share", F.when(F.col("_walk"), F.coalesce("_share", F.lit(0.0))))  # a star that the walk lacks has none of it
    frame = F.col("population") if "population" in sample.columns else F.lit(None).cast("long")
    skipped = F.when(F.lit(bool(window_days)), "window_frame").when(F.col("true_share").isNull(), "no_population").when(frame != F.col("_walked"), "other_frame").when(F.col("ci95.reason").isNotNull(), F.col("ci95.reason"))
    return both.withColumn("skipped", skipped).withColumn("covers", F.when(F.col("skipped").isNull(), F.col("true_share").between(F.col("ci95.low"), F.col("ci95.high")))).drop("_walk", "_walked", "_share")


def replicate_counts(reviews: DataFrame, replicates: int, k: int, seed: int, group: Sequence[str] = GROUP, id_col: str = "source_review_id") -> DataFrame:
    """group, replicate, s1 to s5, reachable (the group's rows): stars of seeded subsamples of k rows, without replacement."""
    rows = reviews.where(F.col(id_col).isNotNull() & F.col("rating").between(1, 5))
    drawn = bottom_k(rows, k, replicates, seed, "rating", id_col, group)
    of = lambda s: F.size(F.filter("values", lambda x: x == s)).cast("long").alias(f"s{s}")
    counts = drawn.select(*group, "replicate", *[of(s) for s in range(1, 6)])
    return counts.join(rows.groupBy(*group).agg(F.count("*").alias("reachable")), list(group))


def _coverage(each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """evaluable, covered and rate of `each` (low, high, true); an interval without ends is not evaluable."""
    ok = F.col("true").between(F.col("low"), F.col("high"))
    return each.withColumn("_ok", ok).groupBy(*keys).agg(F.count("_ok").alias("evaluable"), F.count_if("_ok").alias("covered"), F.avg(F.col("_ok").cast("int")).alias("rate"))


def ci_coverage(reviews: DataFrame, replicates: int = 1000, k: int = 100, seed: int = 42, group: Sequence[str] = GROUP, id_col: str = "source_review_id", counts: DataFrame | None = None) -> DataFrame:
    """How often the share intervals of seeded subsamples of the table cover its own shares, by star. counts: of `replicate_counts`."""
    counts = replicate_counts(reviews, replicates, k, seed, group, id_col) if counts is None else counts
    rows = reviews.where(F.col(id_col).isNotNull() & F.col("rating").between(1, 5))
    true = rows.groupBy(*group).agg(F.array(*[F.avg((F.col("rating") == s).cast("int")) for s in range(1, 6)]).alias("_true"))
    n = F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4") + F.col("s5")
    stars = F.array(*[F.struct(F.lit(s).alias("rating"), F.col(f"s{s}").alias("k")) for s in range(1, 6)])
    each = counts.join(true, list(group)).select(*group, n.alias("n"), "reachable", "_true", F.explode(stars).alias("x")).select(*group, "n", "reachable", "x.*", F.get("_true", F.col("x.rating") - 1).alias("true"))
    ci = stats.proportion(F.col("k"), F.col("n"), F.col("reachable"))
    return _coverage(each.withColumn("ci", ci).select(*group, "rating", "true", "ci.low", "ci.high"), [*group, "rating"])


def mean_coverage(reviews: DataFrame, replicates: int = 1000, k: int = 100, seed: int = 42, group: Sequence[str] = GROUP, id_col: str = "source_review_id", counts: DataFrame | None = None, resamples: int = 9999) -> DataFrame:
    """How often the BCa interval of a subsample's mean rating covers the table's mean. counts: of `replicate_counts`."""
    counts = replicate_counts(reviews, replicates, k, seed, group, id_col) if counts is None else counts
    rows = reviews.where(F.col(id_col).isNotNull() & F.col("rating").between(1, 5))
    true = rows.groupBy(*group).agg(F.avg("rating").alias("true"))
    # A replicate's interval is some milliseconds of work on five numbers: deal them over all cores, whatever their bytes.
    dealt = counts.repartition(counts.sparkSession.sparkContext.defaultParallelism, *group, "replicate")
    return _coverage(mean_intervals(dealt, seed, 0, [*group, "replicate"], "replicate", resamples).join(true, list(group)), group)


def bca(cells: np.ndarray, statistic, seed: Sequence[int], resamples: int = 9999) -> tuple[float, float] | None:
    """BCa 95 % interval of a statistic of cell counts: resampling rows is one multinomial draw of the cells.

    `statistic` maps counts (..., cells) to values. None for a degenerate distribution.
    """
    from statistics import NormalDist

    n = int(cells.sum())
    drawn = np.random.default_rng(seed).multinomial(n, cells / n, size=resamples)
    with np.errstate(divide="ignore", invalid="ignore"):
        theta, at = statistic(drawn), float(statistic(cells[None, :])[0])
        full = np.flatnonzero(cells)
        less = np.stack([cells - (np.arange(len(cells)) == c) for c in full])
        jack, w = statistic(less), cells[full]
    if not np.isfinite(theta).all() or np.ptp(theta) == 0 or not np.isfinite(jack).all():
        return None
    below = ((theta < at).sum() + (theta <= at).sum()) / (2 * resamples)
    if not 0 < below < 1:
        return None
    nd = NormalDist()
    d = (w * jack).sum() / w.sum() - jack
    down = 6 * ((w * d**2).sum()) ** 1.5
    a, z0 = (w * d**3).sum() / down if down else 0.0, nd.inv_cdf(below)
    ends = []
    for z in (nd.inv_cdf(0.025), nd.inv_cdf(0.975)):
        ends.append(float(np.quantile(theta, nd.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))))))
    return ends[0], ends[1]


def period_means(reviews: DataFrame, seed: int = 42, least: int = LEAST_IN_PERIOD, group: Sequence[str] = GROUP) -> DataFrame:
    """BCa intervals of the mean rating of each merged period (group, bucket); stage 100 and the bucket's number. A census of the group is one of each period."""
    dated = reviews.withColumn("year", F.year("created_at")).join(year_buckets(reviews, least, group), [*group, "year"])
    whole = reviews.groupBy(*group).agg((F.count("*") == F.max("reachable")).alias("_census"))
    sizes = dated.groupBy(*group, "bucket").agg(F.count("*").alias("_n"), F.max("reachable").alias("_r")).join(whole, list(group))
    sizes = sizes.select(*group, "bucket", F.when(F.col("_census"), F.col("_n")).otherwise(F.greatest("_r", F.col("_n") + 1)).alias("reachable"))
    return mean_bca_ci(dated.drop("reachable").join(sizes, [*group, "bucket"]), seed, 100, [*group, "bucket"], "bucket")


def mean_bca_ci(reviews: DataFrame, seed: int = 42, stage: int = 0, group: Sequence[str] = GROUP, stage_col: str | None = None) -> DataFrame:
    """BCa interval of the mean rating by group, from its five counts; `reviews` has reachable. Only counts reach Python.

    Each group has draws of its own: the seed is `seed`, the stage (and `stage_col`) and a checksum of the group.
    """
    counts = reviews.groupBy(*group).agg(F.max("reachable").cast("long").alias("reachable"), *[F.count_if(F.col("rating") == s).alias(f"s{s}") for s in range(1, 6)])
    return mean_intervals(counts, seed, stage, group, stage_col)


def mean_intervals(counts: DataFrame, seed: int = 42, stage: int = 0, group: Sequence[str] = GROUP, stage_col: str | None = None, resamples: int = 9999) -> DataFrame:
    """n, mean, low, high and reason of each row of counts (group, s1 to s5, reachable)."""
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema if f.name in group) + ", n long, mean double, low double, high double, reason string"
    names = list(group)

    def work(batches):
        values = np.arange(1, 6)
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                cells = np.array([r[f"s{s}"] for s in range(1, 6)])
                n, population = int(cells.sum()), int(r["reachable"])
                mean = float((cells * values).sum() / n) if n else None
                reason = "no_reviews" if not n else "census" if n == population else "degenerate" if n < 2 or (cells > 0).sum() == 1 else None
                ends = None if reason else bca(cells, lambda c: (c * values).sum(-1) / c.sum(-1), [seed, stage + (int(r[stage_col]) if stage_col else 0), zlib.crc32(repr([str(r[g]) for g in names if g != stage_col]).encode())], resamples)
                if not reason and ends is None:
                    reason = "degenerate"
                if ends and population > 1 and n / population > stats.FPC_ABOVE:
                    by = max(0.0, (population - n) / (population - 1)) ** 0.5
                    ends = mean - (mean - ends[0]) * by, mean + (ends[1] - mean) * by
                rows.append([r[g] for g in names] + [n, mean, *(ends or (None, None)), reason])
            yield pd.DataFrame(rows, columns=[*names, "n", "mean", "low", "high", "reason"])

    return counts.mapInPandas(work, out)
