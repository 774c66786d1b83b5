"""Evaluation against labels: confusion, precision, recall, F1, kappa, intervals by contingency bootstrap, audits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .ratings import bca

LABELS = stats.LABELS


def attach_labels(gold: DataFrame, labels: DataFrame, key: str = "review_id") -> DataFrame:
    """gold with its labels; raises an error at run time unless each row has exactly one label and each label a row."""
    g = gold.join(gold.groupBy(key).agg(F.count("*").alias("_g")), key)
    l = labels.join(labels.groupBy(key).agg(F.count("*").alias("_l")), key)
    both = g.join(l, key, "full_outer")
    bad = F.col("_g").isNull() | F.col("_l").isNull() | (F.col("_g") > 1) | (F.col("_l") > 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("labels and rows don't match one to one: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(checked).drop("_g", "_l")


def confusion(df: DataFrame, true: str = "true", predicted: str = "predicted", group: Sequence[str] = ()) -> DataFrame:
    """Counts of all nine cells, also of empty ones."""
    cells = [F.count_if((F.col(true) == a) & (F.col(predicted) == b)).alias(f"_{i}{j}") for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)]
    rows = F.array(*[F.struct(F.lit(a).alias("true"), F.lit(b).alias("predicted"), F.col(f"_{i}{j}").alias("count")) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS)])
    return df.groupBy(*group).agg(*cells).select(*group, F.explode(rows).alias("x")).select(*group, "x.*")


def classification_metrics(df: DataFrame, true: str = "true", predicted: str = "predicted", group: Sequence[str] = ()) -> DataFrame:
    """By label: precision, recall, F1, support; with accuracy, macro F1 and the negative label's F1 on every row."""
    t, p = F.col(true), F.col(predicted)
    sums = [x for i, a in enumerate(LABELS) for x in (F.count_if((t == a) & (p == a)).alias(f"_tp{i}"), F.count_if(p == a).alias(f"_p{i}"), F.count_if(t == a).alias(f"_t{i}"))]
    wide = df.groupBy(*group).agg(F.count("*").alias("n"), *sums)
    div = lambda a, b: F.coalesce(stats.share(a, b), F.lit(0.0))
    f1 = [div(2.0 * F.col(f"_tp{i}"), F.col(f"_p{i}") + F.col(f"_t{i}")) for i in range(3)]
    rows = F.array(*[F.struct(F.lit(a).alias("label"), div(F.col(f"_tp{i}"), F.col(f"_p{i}")).alias("precision"), div(F.col(f"_tp{i}"), F.col(f"_t{i}")).alias("recall"), f1[i].alias("f1"), F.col(f"_t{i}").alias("support")) for i, a in enumerate(LABELS)])
    return wide.select(*group, "n", div(F.col("_tp0") + F.col("_tp1") + F.col("_tp2"), F.col("n")).alias("accuracy"), ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"), f1[0].alias("negative_f1"), F.explode(rows).alias("x")).select(*group, "x.*", "n", "accuracy", "macro_f1", "negative_f1")


def _f1(tp: np.ndarray, predicted: np.ndarray, true: np.ndarray) -> np.ndarray:
    down = predicted + true
    return np.where(down > 0, 2 * tp / np.maximum(down, 1), 0.0)


def _metric(name: str):
    def value(counts: np.ndarray) -> np.ndarray:
        c = counts.reshape(*counts.shape[:-1], 3, 3)
        f = np.stack([_f1(c[..., i, i], c[..., :, i].sum(-1), c[..., i, :].sum(-1)) for i in range(3)], -1)
        return {"accuracy": np.trace(c, axis1=-2, axis2=-1) / c.sum((-1, -2)), "macro_f1": f.mean(-1), "negative_f1": f[..., 0]}[name]

    return value


def _difference(counts: np.ndarray) -> np.ndarray:
    c = counts.reshape(*counts.shape[:-1], 3, 3, 3)  # true, shipping, challenger
    one = lambda m: _f1(m[..., 0, 0], m[..., :, 0].sum(-1), m[..., 0, :].sum(-1))
    return one(c.sum(-2)) - one(c.sum(-1))


def _kappa(counts: np.ndarray) -> np.ndarray:
    k = int(round(counts.shape[-1] ** 0.5))
    c = counts.reshape(*counts.shape[:-1], k, k)
    n = c.sum((-1, -2))
    po = np.trace(c, axis1=-2, axis2=-1) / n
    pe = (c.sum(-1) * c.sum(-2)).sum(-1) / n**2
    return np.where(pe < 1, (po - pe) / np.where(pe < 1, 1 - pe, 1), 1.0)


def _cells(df: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """The contingency table: labels ** columns rows at most."""
    return df.where(F.col(columns[0]).isin(*labels)).groupBy(*columns).agg(F.count("*").alias("n"))


def _bootstrap(table: DataFrame, columns: Sequence[str], labels: Sequence[str], statistics: dict, seed: Sequence[int], resamples: int) -> DataFrame:
    shape, names = (len(labels),) * len(columns), list(columns)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(shape, np.int64)
        for row in pdf.itertuples(index=False):
            cells[tuple(labels.index(getattr(row, c)) for c in names)] = row.n
        flat, rows = cells.ravel(), []
        for i, (name, f) in enumerate(statistics.items()):
            ends = bca(flat, f, [*seed, i], resamples) if flat.sum() > 1 else None
            rows.append((name, float(f(flat[None, :])[0]) if flat.sum() else None, *(ends or (None, None)), None if ends else "degenerate"))
        return pd.DataFrame(rows, columns=["metric", "value", "low", "high", "reason"])

    # One group, of the table's few cells.
    return table.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(work, "metric string, value double, low double, high double, reason string")


def metric_bca_ci(df: DataFrame, true: str = "true", predicted: str = "predicted", seed: int = 42, resamples: int = 9999) -> DataFrame:
    """Accuracy, macro F1 and negative F1 with BCa intervals from the nine cells."""
    return _bootstrap(_cells(df, [true, predicted], LABELS), [true, predicted], list(LABELS), {m: _metric(m) for m in ("accuracy", "macro_f1", "negative_f1")}, [seed], resamples)


def paired_f1_diff_ci(df: DataFrame, true: str = "true", shipping: str = "shipping", challenger: str = "challenger", seed: int = 42, resamples: int = 9999) -> DataFrame:
    """Negative F1 of the challenger less the shipping model's, and whether to switch: only if the interval is above 0."""
    cols = [true, shipping, challenger]
    got = _bootstrap(_cells(df, cols, LABELS), cols, list(LABELS), {"negative_f1_difference": _difference}, [seed, 1], resamples)
    return got.withColumn("switch", F.coalesce(F.col("low") > 0, F.lit(False)))


def cohen_kappa(df: DataFrame, first: str = "first", second: str = "second", labels: Sequence[str] = (*LABELS, "mixed"), group: Sequence[str] = ()) -> DataFrame:
    """n, observed and expected agreement, kappa and a reason where it is undefined or perfect."""
    a, b = F.col(first), F.col(second)
    sums = [x for i, v in enumerate(labels) for x in (F.count_if(a == v).alias(f"_a{i}"), F.count_if(b == v).alias(f"_b{i}"))]
    got = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(a == b).alias("agreeing"), *sums)
    expected = sum(F.col(f"_a{i}") * F.col(f"_b{i}") for i in range(len(labels))) / (F.col("n") * F.col("n"))
    observed = stats.share(F.col("agreeing"), F.col("n"))
    reason = F.when(F.col("n") < 2, "insufficient_items").when(expected == 1, "undefined_single_class").when(F.col("agreeing") == F.col("n"), "degenerate_perfect_agreement")
    kappa = F.when((F.col("n") >= 2) & (expected < 1), (observed - expected) / (1 - expected))
    return got.select(*group, "n", observed.alias("observed"), expected.alias("expected"), kappa.alias("kappa"), reason.alias("reason"))


def kappa_ci(df: DataFrame, first: str = "first", second: str = "second", labels: Sequence[str] = (*LABELS, "mixed"), seed: int = 42, resamples: int = 9999) -> DataFrame:
    return _bootstrap(_cells(df, [first, second], labels), [first, second], list(labels), {"kappa": _kappa}, [seed, 2], resamples)


def reweighted_accuracy(df: DataFrame, shares: DataFrame, true: str = "true", predicted: str = "predicted", star: str = "star") -> DataFrame:
    """Accuracy by stars, weighted by the frame's shares (star, share); a share without items raises an error, a null one is left out."""
    acc = df.groupBy(star).agg(F.avg((F.col(true) == F.col(predicted)).cast("int")).alias("_a"))
    both = shares.where("share IS NOT NULL").join(acc, star, "left")
    a = F.when(F.col("_a").isNull(), F.raise_error(F.lit("a star with a share has no items")).cast("double")).otherwise(F.col("_a"))
    return both.agg((F.sum(a * F.col("share")) / F.sum("share")).alias("reweighted_accuracy"))


def unit_pr(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Precision and recall of complaint sentences with Wilson intervals. `df`: truth and kept, both boolean."""
    got = df.groupBy(*group).agg(F.count_if(F.col("truth") & F.col("kept")).alias("tp"), F.count_if("kept").alias("predicted"), F.count_if("truth").alias("complaints"))
    for name, n in (("precision", "predicted"), ("recall", "complaints")):
        got = got.withColumn(name, stats.share(F.col("tp"), F.col(n))).withColumn(f"{name}_ci", stats.wilson(F.col("tp"), F.col(n)))
    return got


def unit_pr_subgroups(df: DataFrame) -> DataFrame:
    """`unit_pr` overall, for mixed reviews and for four and five stars. `df` has mixed and happy, both boolean."""
    tagged = df.withColumn("subgroup", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("mixed"), "mixed"), F.when(F.col("happy"), "four_five_stars")))))
    return unit_pr(tagged, ["subgroup"])


def audit_precision(df: DataFrame) -> DataFrame:
    """Precision of judged matches by category and overall. `df`: category, review_id, human_label (correct, incorrect)."""
    right = F.when(F.col("human_label") == "correct", True).when(F.col("human_label") == "incorrect", False).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce("human_label", F.lit("null")))).cast("boolean"))
    got = df.groupBy("category", "review_id").agg(F.count("*").alias("_n"), F.min(right).alias("_ok")).rollup("category").agg(F.count_if("_ok").alias("correct"), F.count("*").alias("n"), F.max("_n").alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("a category and review is judged twice")).cast("long")).otherwise(F.col("n"))
    got = got.select(F.coalesce("category", F.lit("overall")).alias("category"), "correct", checked.alias("n"))
    return got.withColumn("precision", stats.share(F.col("correct"), F.col("n"))).withColumn("ci95", stats.wilson(F.col("correct"), F.col("n")))


def error_examples(df: DataFrame, most: int = 8, order: str = "review_id") -> DataFrame:
    """The first rows that either model gets wrong. `df`: true, shipping, challenger."""
    return df.where("shipping <> `true` OR challenger <> `true`").orderBy(order).limit(most)


def evaluate_model(scored: DataFrame, shares: DataFrame) -> DataFrame:
    """Metrics of a scored gold table without mixed labels, with the reweighted accuracy on every row."""
    pure = scored.where("`true` <> 'mixed'")
    one = reweighted_accuracy(pure, shares).withColumn("_k", F.lit(1))
    return classification_metrics(pure).withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")


def compare_models(df: DataFrame, shares: DataFrame, shipping: str = "shipping", challenger: str = "challenger", seed: int = 42, resamples: int = 9999) -> DataFrame:
    """Accuracy, macro F1 and negative F1 of both models with BCa intervals and the reweighted accuracy, without mixed labels, and whether to switch."""
    pure = df.where("`true` <> 'mixed'")
    rows = None
    for name, column in (("shipping", shipping), ("challenger", challenger)):
        one = metric_bca_ci(pure, predicted=column, seed=seed, resamples=resamples).withColumn("model", F.lit(name))
        one = one.crossJoin(F.broadcast(reweighted_accuracy(pure, shares, predicted=column)))  # one row
        rows = one if rows is None else rows.unionByName(one)
    rule = paired_f1_diff_ci(pure, shipping=shipping, challenger=challenger, seed=seed, resamples=resamples).select("switch")
    return rows.crossJoin(F.broadcast(rule)).select("model", "metric", "value", "low", "high", "reason", "reweighted_accuracy", "switch")


def binary_reference(scored: DataFrame) -> DataFrame:
    """Accuracy on items whose label is positive or negative."""
    return scored.where("`true` IN ('positive', 'negative')").agg(F.count("*").alias("n"), F.avg((F.col("true") == F.col("predicted")).cast("int")).alias("accuracy"))
