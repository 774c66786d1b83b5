from gleaner.operators import crossfit, sentiment


def test_words_are_hashed_once_for_all_folds(spark, monkeypatch):
    """Each fold's pipeline cut and hashed all texts again; predictions are those of such pipelines."""
    rows = [(i, f"w{i % 7} {'good' if i % 2 else 'bad'} x{i % 5} {i}", "pos" if i % 2 else "neg") for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, None), (61, "good", None)], "i int, lexical_text string, label string")
    plain = crossfit.cross_fitted(df, 2, fit=lambda d: sentiment.trained_scorer(d))
    fitted = []
    monkeypatch.setattr(crossfit, "trained_scorer", lambda *a, **k: fitted.append(sentiment.trained_scorer(*a, **k)) or fitted[-1])
    got = crossfit.cross_fitted(df, 2)
    assert got.columns == plain.columns == [*df.columns, "fold", "predicted"]
    assert sorted(got.collect(), key=lambda r: r["i"]) == sorted(plain.collect(), key=lambda r: r["i"])
    assert [[type(s).__name__ for s in m.stages] for m in fitted] == [["StringIndexerModel", "IDFModel", "LogisticRegressionModel"]] * 2
