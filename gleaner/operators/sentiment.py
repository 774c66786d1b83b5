"""Scorers of sentiment, language and embeddings as columns, and summaries of their labels."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text, wordlists
from . import GROUP

MOST_WORDS = 512


def _says(value: Column, words: Sequence[str]) -> Column:
    """Whether one of `words` is among `text.stripped_words`: one search, which stops at the first. Words that no stripped word can be are never found."""
    can = [re.escape(w) for w in words if w and not re.search(rf"^[{text.PUNCTUATION}]|[{text.PUNCTUATION}]$|[ \t\n\x0b\f\r]", w)]
    if not can:
        return F.lit(False)
    return F.lower(F.trim(value)).rlike(rf"(?<!\S)[{text.PUNCTUATION}]*+(?:{'|'.join(can)})[{text.PUNCTUATION}]*+(?!\S)")


def lexicon_scorer(value: Column, negative: Sequence[str] = wordlists.SCORER_NEGATIVE, positive: Sequence[str] = wordlists.SCORER_POSITIVE) -> Column:
    """Struct label, scores, truncated: negative words win over positive ones, which win over none."""
    label = F.when(_says(value, negative), "negative").when(_says(value, positive), "positive").otherwise("neutral")
    score = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in wordlists.SCORER_SCORES.items() for x in (k, v[i])]), label)
    scores = F.create_map(*[x for i, n in enumerate(stats.LABELS) for x in (F.lit(n), score(i))])
    return F.struct(label.alias("label"), scores.alias("scores"), (F.size(F.split(F.trim(value), r"\s+")) > MOST_WORDS).alias("truncated"))


def score_sentiment(df: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, dict[str, float], bool]]]], text_col: str = "analysis_text", batch: int = 32) -> DataFrame:
    """Any model as scorer: `load` runs once a worker, batches are sorted by length. Filter before, not after.

    Adds sentiment_label, class_scores and truncated.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", sentiment_label string, class_scores map<string,double>, truncated boolean"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for pdf in batches:
            order = pdf[text_col].fillna("").str.len().sort_values().index
            found: dict = {}
            for i in range(0, len(order), batch):
                part = order[i : i + batch]
                results = predict(pdf.loc[part, text_col].fillna("").tolist())
                if len(results) != len(part):
                    raise ValueError("the model returned an unexpected number of predictions")
                found |= dict(zip(part, results, strict=True))
            rows = [found[i] for i in pdf.index]
            yield pdf.assign(sentiment_label=[r[0] for r in rows], class_scores=[r[1] for r in rows], truncated=[r[2] for r in rows])

    return df.mapInPandas(work, schema)


def hashed_words(df: DataFrame, text_col: str = "lexical_text", out: str = "_tf", features: int = 1 << 16) -> DataFrame:
    """`df` with the counts of each text's hashed words, which no fit changes."""
    from pyspark.ml.feature import HashingTF, Tokenizer

    return HashingTF(inputCol="_w", outputCol=out, numFeatures=features).transform(Tokenizer(inputCol=text_col, outputCol="_w").transform(df)).drop("_w")


def trained_scorer(labelled: DataFrame, text_col: str = "lexical_text", label_col: str = "label", features: int = 1 << 16, hashed_col: str | None = None):
    """A Spark ML pipeline (hashed words, logistic regression) fitted on labels; transform() adds prediction and probability.

    hashed_col: a column of `hashed_words`, which then stands for the text, here and in what is scored.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, StringIndexer, Tokenizer

    cut = [] if hashed_col else [Tokenizer(inputCol=text_col, outputCol="_w"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features)]
    stages = [StringIndexer(inputCol=label_col, outputCol="_y", handleInvalid="skip"), *cut, IDF(inputCol=hashed_col or "_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(labelled)


def hash_embed(value: Column, terms: Sequence[Sequence[str]] = wordlists.EMBED_TERMS) -> Column:
    """Unit vector of the hits of each group of terms and a constant 1."""
    hits = lambda low, w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)

    def sums(low: Column) -> Column:
        totals = []
        for group in terms:
            total = F.lit(0.0)
            for w in group:
                total = total + hits(low, w)
            totals.append(total)
        return F.array(*totals, F.lit(1.0))

    return stats.unit(stats.let(F.lower(value), sums))


def rating_consistency(reviews: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Do stars and labels agree? Three stars and rows without a label are left out; disagreements are named."""
    s, l = F.col("rating"), F.col("sentiment_label")
    cell = lambda stars, label: F.count_if(stars & (l == label))
    low, high = s <= 2, s >= 4
    got = reviews.where(l.isNotNull() & (s != 3)).groupBy(*group).agg(F.count("*").alias("compared"), F.count_if(l == stats.star_class(s)).alias("agreeing"), cell(low, "positive").alias("low_stars_positive"), cell(low, "neutral").alias("low_stars_neutral"), cell(high, "negative").alias("high_stars_negative"), cell(high, "neutral").alias("high_stars_neutral"))
    return got.withColumn("agreement", stats.share(F.col("agreeing"), F.col("compared")))


def preprocessing_summary(reviews: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """n, n_analysable and the counts of flags and languages as JSON objects with sorted keys."""
    base = reviews.groupBy(*group).agg(F.count("*").alias("n"), F.count_if("analysable").alias("n_analysable"))
    packed = lambda df, key, name: df.groupBy(*group, key).agg(F.count("*").alias("k")).groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "k")))).alias(name))
    flags = packed(reviews.select(*group, F.explode("flags").alias("flag")), "flag", "flags")
    langs = packed(reviews.select(*group, F.coalesce("language", F.lit("und")).alias("language")), "language", "languages")
    return base.join(flags, list(group), "left").join(langs, list(group), "left")


def preprocessing_examples(reviews: DataFrame, k: int = 5, group: Sequence[str] = GROUP) -> DataFrame:
    """Some rows before and after, flagged ones first."""
    order = Window.partitionBy(*group).orderBy((F.size("flags") == 0), "source_review_id")
    return reviews.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*group, "rank", "source_review_id", F.concat_ws("\n", "title", "body").alias("before"), F.col("analysis_text").alias("after"), "flags")
