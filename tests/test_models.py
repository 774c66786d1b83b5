"""Cross-fitted predictions, language profiles against brute force, scorers from outside."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import crossfit, evaluate, language, sentiment


def labelled(spark, n=160):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        label = rng.choice(["negative", "positive", "neutral"])
        rows.append((i, " ".join(rng.choices([f"{label[:3]}{k}" for k in range(6)], k=5) + rng.choices(["the", "a", "of"], k=5)), label))
    rows += [(1000 + i, f"copied text {i % 3}", rng.choice(["negative", "positive"])) for i in range(30)] + [(2000, None, "neutral"), (2001, "neg1 neg2", None)]
    return spark.createDataFrame(rows, "id long, lexical_text string, label string")


def test_no_row_is_scored_by_a_model_that_saw_its_text(spark):
    seen = []

    def fit(df):
        seen.append((df.select("fold").distinct().collect(), {r["lexical_text"] for r in df.select("lexical_text").collect()}))
        return sentiment.trained_scorer(df, features=256)

    got = crossfit.cross_fitted(labelled(spark), 3, fit=fit).collect()
    assert len(got) == 192 and {r["fold"] for r in got} == {0, 1, 2}
    for f, (folds, texts) in enumerate(seen):
        assert f not in {r["fold"] for r in folds}
        assert not texts & {r["lexical_text"] for r in got if r["fold"] == f}
    fresh = [r for r in got if r["id"] < 1000]
    assert sum(r["predicted"] == r["label"] for r in fresh) > 0.9 * len(fresh)
    assert len({r["fold"] for r in got if r["lexical_text"] == "copied text 1"}) == 1
    metrics = evaluate.metric_bca_ci(spark.createDataFrame([(r["label"], r["predicted"]) for r in fresh], "true string, predicted string")).collect()
    assert all(r["value"] > 0.9 for r in metrics)


def test_cross_fitting_needs_labels_and_free_names(spark):
    one = labelled(spark).where("label = 'neutral'")
    with pytest.raises(ValueError, match="fewer than two"):
        crossfit.cross_fitted(one, 2)
    with pytest.raises(ValueError, match="fold"):
        crossfit.cross_fitted(one.withColumn("Fold", F.lit(1)), 2)
    with pytest.raises(ValueError, match="two folds"):
        crossfit.cross_fitted(one, 1)


WORDS = {"aa": ["ona", "bole", "mira", "sulen"], "bb": ["zwek", "trolx", "schund", "krat"], "cc": ["你好", "世界", "中文", "ona"]}


def texts_of(n=150, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang := rng.choice(list(WORDS))], k=rng.randint(5, 30))), lang) for i in range(n)]


def brute_runs(t, buckets):
    """Runs of one text by their definition; buckets by the module's own hash of each run alone."""
    plain = f" {' '.join(t.lower().split())} "
    out = []
    for n in range(1, language.LONGEST + 1):
        for i in range(len(plain) - n + 1):
            h = 0
            for k, c in enumerate(plain[i : i + n]):
                h = (h * 1_000_003 % 2**64) ^ (ord(c) + k + 1)
            m = h * 0x9E3779B97F4A7C15 % 2**64
            out.append(((m ^ (m >> 29)) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % buckets)
    return out


def test_profiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "CHARS", 100)
    rows = texts_of() + [(900, None, "aa"), (901, "", "aa"), (902, "no language", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    got = language.profiles(df, buckets=512, held_out=0.0)
    counts = {x: collections.Counter() for x in WORDS}
    for _, t, x in rows:
        if t is not None and x:
            counts[x].update(brute_runs(t, 512))
    for i, x in enumerate(sorted(WORDS)):
        total = sum(counts[x].values()) + 512 * language.PRIOR
        assert np.allclose(got.logs[i], [math.log((counts[x][b] + language.PRIOR) / total) for b in range(512)], atol=1e-5)
    got.temperature = 2.0
    told = {r["id"]: r for r in language.detect(df, got, floor=0.5).collect()}
    for i, t, _ in rows:
        if t is None or len(t.strip()) < 20:
            assert told[i]["language"] == "und" and told[i]["confidence"] is None
            continue
        found = brute_runs(t, 512)
        s = [sum(float(got.logs[k][b]) for b in found) / len(found) for k in range(3)]
        e = [math.exp((x - max(s)) * 2.0) for x in s]
        assert told[i]["confidence"] == pytest.approx(max(e) / sum(e), abs=1e-4)
        assert told[i]["language"] == (got.languages[int(np.argmax(s))] if max(e) / sum(e) >= 0.5 else "und")


def test_temperature_comes_from_held_out_rows(spark):
    df = spark.createDataFrame(texts_of(400), "id long, text string, lang string")
    got = language.profiles(df, buckets=4096, held_out=0.3)
    assert got.temperature in language.TEMPERATURES and got.temperature > 1
    fresh = spark.createDataFrame(texts_of(200, 9), "id long, text string, lang string").where("length(text) > 25")
    told = language.detect(fresh, got, floor=0.8).collect()
    assert sum(r["language"] == r["lang"] for r in told) > 0.95 * len(told)


def test_no_labelled_texts(spark):
    df = spark.createDataFrame([(1, "a text that is long enough to tell", None)], "id long, text string, lang string")
    got = language.profiles(df)
    assert [(r["language"], r["confidence"]) for r in language.detect(df, got).collect()] == [("und", None)]
    with pytest.raises(ValueError, match="language"):
        language.detect(df.withColumn("language", F.lit("x")), got)
