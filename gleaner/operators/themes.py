"""Themes: exact average-linkage clusters of unit vectors, their distances, sizes, representatives and statistics.

Pairs go through `similarity`, clusters through the merge trees of `linkage`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from . import GROUP, linkage, similarity
from .phrases import recent

EDGES = (0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 2.0)
THRESHOLDS = (0.30, 0.40, 0.50, 0.60)
GRID = tuple(round(0.20 + 0.05 * i, 2) for i in range(10))


def near_pairs(units: DataFrame, below: float, id_col: str = "unit_id", vec_col: str = "vector", group: Sequence[str] = GROUP) -> DataFrame:
    """left_id < right_id and their cosine distance, for pairs nearer than `below`."""
    return similarity.near_pairs(similarity.cells(units, id_col, vec_col, group), below)


def pair_report(units: DataFrame, below: float, id_col: str = "unit_id", vec_col: str = "vector", group: Sequence[str] = GROUP) -> DataFrame:
    """How much of the work of `near_pairs` the bounds of cells save: blocks and pairs compared and skipped."""
    return similarity.report(similarity.cells(units, id_col, vec_col, group), below)


def distance_histogram(units: DataFrame, id_col: str = "unit_id", vec_col: str = "vector", group: Sequence[str] = GROUP) -> DataFrame:
    """Counts of pairs by distance; bins are closed below, the last on both sides. Distances just under 0 count as 0. All bins are there for a group with vectors."""
    found = similarity.cells(units, id_col, vec_col, group)
    got = similarity.histogram(found, EDGES)
    bins = found.blocks.select(*group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(EDGES) - 2))))
    low = F.element_at(F.array(*[F.lit(e) for e in EDGES]), F.col("bin") + 1)
    high = F.element_at(F.array(*[F.lit(e) for e in EDGES]), F.col("bin") + 2)
    return bins.join(got, [*group, "bin"], "left").select(*group, low.alias("low"), high.alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def merge_tree(units: DataFrame, below: float, id_col: str = "unit_id", vec_col: str = "vector", group: Sequence[str] = GROUP, max_component: int = linkage.REST) -> DataFrame:
    """group, child, parent, height: the merges of average linkage nearer than `below`, stored once, for cuts at any threshold up to it."""
    return linkage.merge_tree(units, below, id_col, vec_col, group, max_component)


def cluster_units(units: DataFrame, below: float, id_col: str = "unit_id", vec_col: str = "vector", group: Sequence[str] = GROUP, max_component: int = linkage.REST, tree: DataFrame | None = None) -> DataFrame:
    """`units` with column cluster: the least id of its cluster. tree: a stored merge tree of at least this threshold."""
    tree = merge_tree(units, below, id_col, vec_col, group, max_component) if tree is None else tree
    found = linkage.cut(tree, [below], group).select(*group, F.col("node").alias(id_col), F.col("cluster").alias("_cluster"))
    return units.join(found, [*group, id_col], "left").withColumn("cluster", F.coalesce("_cluster", id_col)).drop("_cluster")


def cluster_sizes(units: DataFrame, thresholds: Sequence[float] = THRESHOLDS, id_col: str = "unit_id", vec_col: str = "vector", group: Sequence[str] = GROUP, max_component: int = linkage.REST) -> DataFrame:
    """group, threshold, size, count: how many clusters of each size each threshold gives; one merge tree for all of them."""
    tree = merge_tree(units, max(thresholds), id_col, vec_col, group, max_component)
    sizes = linkage.cut(tree, thresholds, group).groupBy(*group, "threshold", "cluster").agg((F.count("*") + 1).alias("size"))
    large = sizes.groupBy(*group, "threshold", "size").agg(F.count("*").alias("count"))
    # What no merge names is alone.
    n = units.where(F.col(id_col).isNotNull()).groupBy(*group).agg(F.countDistinct(id_col).alias("_n")).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    inside = large.groupBy(*group, "threshold").agg(F.sum(F.col("size") * F.col("count")).alias("_in"))
    alone = n.join(inside, [*group, "threshold"], "left").select(*group, "threshold", F.lit(1).cast("long").alias("size"), (F.col("_n") - F.coalesce("_in", F.lit(0))).alias("count")).where("count > 0")
    return large.unionByName(alone)


def theme_policy(clustered: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """`clustered` with theme_id (null: the rest) and status of the group.

    Under 5 units a group has no themes; under 15 a cluster needs 2 units, else 3. Themes go by units, then first review.
    """
    n = clustered.groupBy(*group).agg(F.count("*").alias("_n"))
    sizes = clustered.groupBy(*group, "cluster").agg(F.count("*").alias("_size"), F.min("review_id").alias("_first")).join(F.broadcast(n), list(group))
    ok = sizes.where((F.col("_n") >= 5) & (F.col("_size") >= F.when(F.col("_n") < 15, 2).otherwise(3)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_size").desc(), "_first", "cluster"))
    named = ok.select(*group, "cluster", F.format_string("theme_%02d", rank).alias("theme_id"))
    any_ = named.groupBy(*group).agg(F.count("*").alias("_themes"))
    status = F.when(F.col("_n") < 5, "insufficient_units").when(F.col("_themes").isNull(), "no_supported_clusters").otherwise("ok")
    return clustered.join(named, [*group, "cluster"], "left").join(F.broadcast(n.join(any_, list(group), "left").select(*group, status.alias("status"))), list(group))


def theme_stats(themed: DataFrame, n_analysable: DataFrame, reference: str, group: Sequence[str] = GROUP) -> DataFrame:
    """Of each theme: units, reviews, shares with intervals, mean stars of its reviews, dates. `n_analysable`: group, n_analysable."""
    total = themed.groupBy(*group).agg(F.countDistinct("review_id").alias("n_complaint_reviews"))
    per_review = themed.where("theme_id IS NOT NULL").groupBy(*group, "theme_id", "review_id").agg(F.count("*").alias("u"), F.min_by("rating", "unit_id").alias("r"), F.max("created_at").alias("newest"), F.min("created_at").alias("oldest"), F.max(recent(reference)).alias("recent"))
    got = per_review.groupBy(*group, "theme_id").agg(F.sum("u").alias("unit_count"), F.count("*").alias("review_count"), F.avg("r").alias("mean_star_rating"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest"), F.count_if("recent").alias("n_recent"))
    got = got.join(F.broadcast(total), list(group)).join(F.broadcast(n_analysable), list(group))
    return got.withColumns({"share": stats.share(F.col("review_count"), F.col("n_complaint_reviews")), "ci95": stats.wilson(F.col("review_count"), F.col("n_complaint_reviews")), "share_of_analysable": stats.share(F.col("review_count"), F.col("n_analysable")), "share_last_12_months": stats.share(F.col("n_recent"), F.col("review_count")), "historical": F.col("n_recent") == 0})


def theme_coverage(themed: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """How many units and reviews the themes hold, and whether that is under half."""
    inside = F.col("theme_id").isNotNull()
    got = themed.groupBy(*group).agg(F.count_if(inside).alias("units_clustered"), F.count("*").alias("units_total"), F.countDistinct(F.when(inside, F.col("review_id"))).alias("reviews_in_themes"), F.countDistinct("review_id").alias("n_complaint_reviews"))
    got = got.withColumns({"unit_share": stats.share(F.col("units_clustered"), F.col("units_total")), "review_share": stats.share(F.col("reviews_in_themes"), F.col("n_complaint_reviews"))})
    return got.withColumn("coverage_warning", F.coalesce(F.least("unit_share", "review_share") < 0.5, F.lit(False)))


def representatives(themed: DataFrame, most: int = 3, vec_col: str = "vector", cluster: str = "theme_id", group: Sequence[str] = GROUP) -> DataFrame:
    """The units nearest to each cluster's centroid, those of under 40 characters last."""
    keys = [*group, cluster]
    rows = themed.where(F.col(cluster).isNotNull())
    dims = rows.select(*keys, F.posexplode(vec_col).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    centre = dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("_c"))
    scored = rows.join(centre, keys).withColumn("distance", 1 - stats.dot(stats.unit(F.col(vec_col)), stats.unit(F.col("_c"))))
    order = Window.partitionBy(*keys).orderBy(F.length(F.trim("sentence")) < 40, F.round("distance", 8), "review_id", "unit_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*keys, "rank", "unit_id", "review_id", text.excerpt(F.col("sentence")).alias("excerpt"), "distance")


def threshold_table(pairs: DataFrame, grid: Sequence[float] = GRID, minimum: float = 0.80, group: Sequence[str] = ()) -> DataFrame:
    """Precision of "same issue" under each threshold, and the greatest that reaches the minimum. `pairs`: distance, same."""
    sums = [x for i, t in enumerate(grid) for x in (F.count_if(F.col("distance") <= t).alias(f"_p{i}"), F.count_if((F.col("distance") <= t) & F.col("same")).alias(f"_s{i}"))]
    wide = pairs.groupBy(*group).agg(*sums)
    long = wide.select(*group, F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_p{i}").alias("predicted_same"), F.col(f"_s{i}").alias("true_same")) for i, t in enumerate(grid)])).alias("x")).select(*group, "x.*")
    long = long.withColumn("precision", stats.share(F.col("true_same"), F.col("predicted_same"))).withColumn("eligible", F.coalesce(F.col("precision") >= minimum, F.lit(False)))
    return long.withColumn("selected", F.max(F.when(F.col("eligible"), F.col("threshold"))).over(Window.partitionBy(*group)))


def pair_strata(pairs: DataFrame, each: int = 15, seed: int = 7, edges: Sequence[float] = (0.20, 0.35, 0.50, 0.65)) -> DataFrame:
    """Seeded pairs of each distance bin; `short` marks bins without enough. `pairs`: left_id, right_id, distance."""
    from .sampling import stratified_draw

    b = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        b = F.when((F.col("distance") >= edges[i]) & (F.col("distance") < edges[i + 1]), i).otherwise(b)
    binned = pairs.withColumn("stratum", b).where("stratum IS NOT NULL").withColumn("pair_id", F.concat_ws("|", "left_id", "right_id"))
    return stratified_draw(binned, {i: each for i in range(len(edges) - 1)}, seed, "stratum", "pair_id")
