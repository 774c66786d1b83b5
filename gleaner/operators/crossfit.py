"""Cross-fitted predictions: every labelled row is scored by a model that was fitted without it.

Rows are dealt into folds by MD5 of seed and text, so that copies of a text are in one fold and none is scored by a model that saw it. For each
fold a pipeline is fitted on the others, stored in the shared folder, read back, and scores its fold alone.

Rows without a label are not fitted on, but scored. Null texts count as empty. Repeated rows count each. Fewer than two labels outside a fold, or an
empty table: ValueError, as nothing can be fitted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_folder, stored
from .sentiment import hashed_words, trained_scorer


def fold_of(text_col: str, folds: int, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(text_col), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % folds).cast("int")


def scored(model: PipelineModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    """`df` with the label that a pipeline of `trained_scorer` predicts."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    # Without the first stage, which needs the label and drops rows that have none.
    got = PipelineModel(model.stages[1:]).transform(df).withColumn(out, F.get(labels, F.col("prediction").cast("int")))
    return got.select(*df.columns, out)


def cross_fitted(labelled: DataFrame, folds: int = 5, seed: int = 42, text_col: str = "lexical_text", label_col: str = "label", fit: Callable[[DataFrame], PipelineModel] | None = None) -> DataFrame:
    """`labelled` with fold and predicted. fit: a table of all other folds' rows to a fitted pipeline whose first stage indexes the label."""
    taken = {c.lower() for c in labelled.columns} & {"fold", "predicted", "prediction", "probability", "rawprediction"}
    if taken:
        raise ValueError(f"the input has columns named {', '.join(sorted(taken))}")
    if folds < 2:
        raise ValueError("at least two folds are needed")
    rows = labelled.withColumn(text_col, F.coalesce(text_col, F.lit(""))).withColumn("fold", fold_of(text_col, folds, seed))
    names = rows.columns
    if fit is None:
        # Words are cut and hashed once, not for each stage of each fold.
        rows, fit = hashed_words(rows, text_col), lambda df: trained_scorer(df, text_col, label_col, hashed_col="_tf")
    rows = stored(rows)
    kinds = rows.where(F.col(label_col).isNotNull()).groupBy("fold", label_col).agg(F.count("*").alias("n")).collect()  # a row for each fold and label
    out = None
    for f in range(folds):
        if len({r[label_col] for r in kinds if r["fold"] != f}) < 2:
            raise ValueError(f"outside of fold {f} there are fewer than two labels")
        path = shared_folder(rows.sparkSession, "model")
        fit(rows.where((F.col("fold") != f) & F.col(label_col).isNotNull())).write().save(path)
        some = scored(PipelineModel.load(path), rows.where(F.col("fold") == f)).select(*names, "predicted")
        out = some if out is None else out.unionByName(some)
    return out
