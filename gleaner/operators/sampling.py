"""Seeded sampling without replacement: the rows with the least MD5 of seed and id, whatever their partitions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import GROUP
from .order import positions

#: Rows that a task looks at before it leaves out what can't be drawn.
HELD = 50_000


def priority(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def uniform_sample(df: DataFrame, k: int, seed: int, id_col: str = "source_review_id", group: Sequence[str] = GROUP) -> DataFrame:
    """k rows of each group, all if it has no more; the window keeps k rows a task before it shuffles."""
    order = Window.partitionBy(*group).orderBy(priority(seed, id_col), id_col)
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def seeded_order(df: DataFrame, seed: int, id_col: str, group: Sequence[str] = ()) -> DataFrame:
    """Column `position`: from 1, in the seeded order of each group, by a distributed sort; no group has to fit in a task."""
    return positions(df, [priority(seed, id_col), F.col(id_col)], group)


def replay_ranks(frame: DataFrame, samples: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Rows of a frame whose rank a recorded sample (group, ranks) names."""
    ranks = samples.select(*group, F.explode("ranks").alias("rank")).distinct()
    return frame.join(ranks, [*group, "rank"], "left_semi")


def exclude_ids(df: DataFrame, shown: DataFrame, id_col: str = "source_review_id") -> DataFrame:
    return df.join(shown.select(id_col).distinct(), id_col, "left_anti")


def backfilled_sample(df: DataFrame, k: int, seed: int, most_replaced: int = 20, id_col: str = "source_review_id", valid: str = "valid", group: Sequence[str] = GROUP) -> tuple[DataFrame, DataFrame]:
    """k valid rows of different ids, and what was passed over for them, with its reason.

    Rows are drawn in the seeded order of their rank; a row that is invalid or repeats an id drawn before is replaced by the next
    draw, `most_replaced` times at most. So only the first k + `most_replaced` draws of a group are looked at, which tasks pick before
    rows are moved. A null `valid` is invalid; null ids repeat each other.
    """
    draw = Window.partitionBy(*group).orderBy(priority(seed, "rank"), "rank")
    again = Window.partitionBy(*group, id_col).orderBy("_draw")
    drawn = df.withColumn("_draw", F.row_number().over(draw)).where(F.col("_draw") <= k + most_replaced)
    first = F.row_number().over(again) == 1
    reason = F.when(~F.coalesce(F.col(valid), F.lit(False)), "invalid_row").when(~first, "duplicate_review")
    seen = drawn.withColumn("reason", reason)
    upto = Window.partitionBy(*group).orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("_good", F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(upto)).withColumn("_bad", F.sum(F.when(F.col("reason").isNull(), 0).otherwise(1)).over(upto))
    kept = seen.where((F.col("_good") <= k) & (F.col("_bad") <= most_replaced))
    taken = kept.where("reason IS NULL").drop("_draw", "reason", "_good", "_bad")
    passed = kept.where(F.col("reason").isNotNull() & (F.col("_good") < k)).select(*group, F.col("rank").alias("replaced_rank"), "reason", F.col("_bad").alias("replacement"))
    return taken, passed


def least(df: DataFrame, keys: Sequence[str], by: str, most: int) -> DataFrame:
    """Of each task's rows those that may be among the `most` with the least `by` of equal `keys`: what is left out is neither sorted nor moved."""
    keys = list(keys)

    def best(rows: pa.Table) -> pa.Table:
        code = np.zeros(rows.num_rows, np.int64)
        for k in keys:
            c = pc.dictionary_encode(rows.column(k).combine_chunks(), null_encoding="encode")
            code = np.unique(code * len(c.dictionary) + c.indices.to_numpy(), return_inverse=True)[1]
        order = pc.sort_indices(pa.table({"c": code, "p": rows.column(by)}), [("c", "ascending"), ("p", "ascending")], null_placement="at_start").to_numpy()
        code = code[order]
        place = np.arange(len(code)) - np.searchsorted(code, code)
        return rows.take(pa.array(order[place < most]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                held = best(pa.Table.from_batches(held)).combine_chunks().to_batches()
                # With very many keys little can be left out, and what is held is passed on.
                n = sum(b.num_rows for b in held)
                if n > HELD // 2:
                    yield from held
                    held, n = [], 0
        if n:
            yield from best(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(work, df.schema)


def stratified_draw(df: DataFrame, quotas: Mapping[int, int], seed: int, stratum: str = "rating", id_col: str = "source_review_id", group: Sequence[str] = ()) -> DataFrame:
    """Each stratum's quota, drawn on its own; a stratum without enough rows has `short` true on its rows."""
    order = Window.partitionBy(*group, stratum).orderBy(priority(seed, id_col), id_col)
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col(stratum).cast("int"))
    few = least(df.withColumn("_p", priority(seed, id_col)), [*group, stratum], "_p", max(quotas.values(), default=0)).drop("_p")
    ranked = few.withColumn("_n", F.row_number().over(order)).withColumn("_quota", quota).where("_n <= _quota")
    return ranked.withColumn("short", F.count("*").over(Window.partitionBy(*group, stratum)) < F.col("_quota")).drop("_n", "_quota")


def sampling_metadata(sample: DataFrame, frames: DataFrame, requested: int, group: Sequence[str] = GROUP) -> DataFrame:
    """A row for each group: what was asked for, got, and warnings. `frames`: group and reachable."""
    got = sample.groupBy(*group).agg(F.count("*").alias("actual"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))
    both = frames.join(got, list(group), "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    warnings = F.array_compact(F.array(F.when(F.col("reachable") == 0, "empty_frame"), F.when((F.col("reachable") > 0) & (F.col("reachable") < requested), "frame_below_request"), F.when(F.col("actual") < F.least(F.lit(requested), F.col("reachable")), "incomplete")))
    return both.select(*group, F.lit(requested).alias("requested"), "actual", "reachable", (F.col("actual") >= F.least(F.lit(requested), F.col("reachable"))).alias("complete"), F.try_divide("actual", "reachable").alias("sampling_fraction"), "oldest", "newest", warnings.alias("warnings"))


def blind_sheet(df: DataFrame, id_col: str = "review_id", text_col: str = "text", label: str = "human_label") -> DataFrame:
    """A sheet to label: id, text and an empty label; stars, distances and earlier labels stay hidden."""
    return df.select(id_col, text_col, F.lit("").alias(label))


def relabel_sample(gold: DataFrame, k: int = 30, seed: int = 42, id_col: str = "review_id", text_col: str = "text") -> DataFrame:
    """k seeded items of all, as a blind sheet."""
    return blind_sheet(uniform_sample(gold, k, seed, id_col, ()), id_col, text_col)


def unit_candidates(reviews: DataFrame, seed: int, positives: int = 20, group: Sequence[str] = ()) -> DataFrame:
    """Sentences of all negative and mixed reviews and of some sampled positive ones. Columns source_review_id, human_label, analysis_text."""
    from ..functions import text

    some = uniform_sample(reviews.where("human_label = 'positive'"), positives, seed, group=group)
    return reviews.where("human_label IN ('negative', 'mixed')").unionByName(some).select("source_review_id", "human_label", F.posexplode(text.sentences(F.col("analysis_text"))).alias("sentence_index", "sentence"))
