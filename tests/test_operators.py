import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import categories, evaluate, phrases, ratings, sampling, themes, units
from gleaner.sources import reviews as source
from gleaner.sources import sinks


def reviews(spark, stars, years=None, reachable=1000):
    rows = [(1, "us", f"r{i}", i, s, dt.datetime((years or [2026] * len(stars))[i], 1, 1), reachable) for i, s in enumerate(stars)]
    return spark.createDataFrame(rows, "app_id long, country string, source_review_id string, rank long, rating int, created_at timestamp, reachable long")


STARS = [1] * 14 + [2] * 4 + [3] * 6 + [4] * 12 + [5] * 64


def test_rating_summary_and_distribution(spark):
    df = reviews(spark, STARS)
    assert ratings.rating_summary(df).first()["mean"] == pytest.approx(4.08)
    got = {r["rating"]: r for r in ratings.distribution(df, "rating", [1, 2, 3, 4, 5]).collect()}
    assert got[5]["count"] == 64 and got[5]["ci95"]["low"] > 0.54235
    assert ratings.rating_summary(reviews(spark, [3])).first()["stddev"] is None


def test_periods(spark):
    df = reviews(spark, [5] * 15 + [1] * 15, [2026] * 15 + [2025] * 15)
    got = [(r["label"], r["mean"]) for r in ratings.period_metrics(df).orderBy("bucket").collect()]
    assert got == [("2026", 5.0), ("2025", 1.0)]
    df = reviews(spark, [5] * 15 + [1] * 3, [2026] * 15 + [2024] * 3)
    assert [r["label"] for r in ratings.period_metrics(df).collect()] == ["2024-2026"]


def test_mean_interval(spark):
    df = reviews(spark, [1] * 39 + [2] * 4 + [3] * 3 + [4] * 6 + [5] * 48, reachable=15002)
    r = ratings.mean_bca_ci(df).first()
    assert (r["low"], r["high"]) == (pytest.approx(2.82, abs=0.03), pytest.approx(3.56, abs=0.03))
    assert ratings.mean_bca_ci(reviews(spark, [4, 4, 4])).first()["reason"] == "degenerate"
    assert ratings.mean_bca_ci(reviews(spark, [4, 5], reachable=2)).first()["reason"] == "census"


def test_sampling_is_seeded_and_independent_of_partitions(spark):
    df = reviews(spark, STARS)
    a, b = ({r["source_review_id"] for r in sampling.uniform_sample(d, 10, 42).collect()} for d in (df.repartition(1), df.repartition(7)))
    assert a == b and len(a) == 10
    assert sampling.uniform_sample(df, 1000, 42).count() == 100
    taken, passed = sampling.backfilled_sample(df.withColumn("valid", F.col("rank") % 2 == 0), 20, 1)
    assert taken.count() == 20 and passed.where("reason = 'invalid_row'").count() <= 20


def test_fightin_words_by_hand(spark):
    df = spark.createDataFrame([(1, "us", "refund", 4, 1), (1, "us", "app", 5, 5)], "app_id long, country string, phrase string, support long, rest long")
    got = {r["phrase"]: r["z"] for r in phrases.fightin_words(df).collect()}
    a = 100 * 5 / 15
    delta = np.log((4 + a) / (9 + 100 - 4 - a)) - np.log((1 + a) / (6 + 100 - 1 - a))
    assert got["refund"] == pytest.approx(delta / np.sqrt(1 / (4 + a) + 1 / (1 + a)))


def test_subsumption(spark):
    rows = [(1, "us", p, s) for p, s in (("a b", 3), ("a", 3), ("b", 5), ("a b c", 2))]
    df = spark.createDataFrame(rows, "app_id long, country string, phrase string, support long")
    kept = lambda **k: {r["phrase"] for r in phrases.drop_subsumed(df, **k).collect()}
    assert kept() == {"a b", "b", "a b c"}
    assert kept(prefer_longer=False, same_support=False) == {"a", "b"}


def unit_rows(spark, said):
    rows = [(1, "us", f"r{i}", f"r{i}:s0", s, s.lower().rstrip("."), 1, None, 0.9) for i, s in enumerate(said)]
    return spark.createDataFrame(rows, "app_id long, country string, review_id string, unit_id string, sentence string, lexical_text string, rating int, created_at timestamp, negative_score double")


def test_lexicon_and_guards(spark):
    u = unit_rows(spark, ["this is a scam", "not a scam", "it is not really a scam", "no ads here", "i want my money back", "scammers all"])
    got = {(r["unit_id"], r["category_id"]) for r in categories.lexicon_match(u, categories.lexicon(spark)).collect()}
    assert got == {("r0:s0", "scam_trust"), ("r2:s0", "scam_trust"), ("r4:s0", "refunds")}


def test_category_stats(spark):
    u = unit_rows(spark, ["refund please", "money back", "crash", "nothing"])
    m = categories.category_match(u, categories.lexicon_match(u, categories.lexicon(spark)))
    got = categories.category_stats(m, units.complaint_totals(u), "2026-09-30").collect()
    assert [(r["category_id"], r["share"], r["historical"]) for r in got] == [("refunds", 0.5, True)]
    assert got[0]["ci95"]["low"] == pytest.approx(0.15003898915214947)
    assert {r["review_id"] for r in categories.uncategorised(u, m).collect()} == {"r2", "r3"}


def test_gate(spark):
    rows = [(1, "us", 5, "negative", 0.8, "x"), (1, "us", 1, "negative", 0.5, "x"), (1, "us", 1, "positive", 0.0, "x")]
    df = spark.createDataFrame(rows, "app_id long, country string, rating int, label string, negative_score double, sentence string")
    r = units.gate_accounting(df).first()
    assert (r["candidates"], r["kept"], r["removed_positive"], r["removed_other"]) == (2, 1, 1, 0)
    with pytest.raises(ValueError, match="thresholds"):
        units.passes(1.5)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("negative", "negative"), ("negative", "positive"), ("neutral", "neutral"), ("positive", "positive")], "true string, predicted string")
    r = evaluate.classification_metrics(df).first()
    assert (r["accuracy"], r["macro_f1"]) == (0.75, pytest.approx((2 / 3 + 1 + 2 / 3) / 3))
    k = evaluate.cohen_kappa(spark.createDataFrame([("positive", "positive"), ("negative", "negative")], "first string, second string")).first()
    assert (k["kappa"], k["reason"]) == (1.0, "degenerate_perfect_agreement")


def test_labels_have_to_match(spark):
    gold, labels = spark.createDataFrame([("a",), ("b",)], "review_id string"), spark.createDataFrame([("a", "x")], "review_id string, human_label string")
    with pytest.raises(Exception, match="one to one"):
        evaluate.attach_labels(gold, labels).collect()


def test_threshold_table(spark):
    pairs = spark.createDataFrame([(0.2, True), (0.3, True), (0.35, True), (0.38, True), (0.39, False), (0.41, False)], "distance double, same boolean")
    assert themes.threshold_table(pairs).first()["selected"] == 0.40


def test_feed_entries(spark):
    one = '{"feed": {"entry": {"id": {"label": "7"}, "title": {"label": "t"}, "content": {"label": "c"}, "im:rating": {"label": "4"}}}}'
    two = '{"feed": {"entry": [{"id": {"label": "meta"}}, {"id": {"label": "7"}, "im:rating": {"label": "4"}}, {"id": {"label": "8"}, "im:rating": {"label": "1"}}]}}'
    pages = spark.createDataFrame([(1, "us", 1, one), (1, "us", 2, two), (1, "us", 3, '{"feed": {}}')], "app_id long, country string, page long, value string")
    got = source.feed_frame(source.feed_entries(pages)).orderBy("rank").collect()
    assert [(r["source_review_id"], r["rank"], r["rating"]) for r in got] == [("7", 0, 4), ("8", 1, 1)]


def test_store_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"start": 10, "country": "us", "app_id": 5, "userReviewList": [{"userReviewId": "a", "title": " ", "body": "b", "rating": 5, "date": "Jan 3, 2024", "name": "secret", "developerResponse": {"id": 1, "body": "no"}}, {"title": "x", "rating": 9}]}\n')
    rows = source.read_store_rows(spark, str(tmp_path)).orderBy("rank").collect()
    assert (rows[0]["rank"], rows[0]["valid"], rows[0]["created_at"].year, rows[0]["has_developer_response"]) == (10, True, 2024, True)
    assert rows[0]["source_flags"] == ["missing_or_blank_title"] and not rows[1]["valid"]
    assert not {"name", "voteUrl"} & set(rows[0].asDict())


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", 1, '=HYPERLINK("x")')], "source_review_id string, rank long, title string")
    sinks.write_reviews_csv(df.coalesce(1), str(tmp_path / "o"), ("source_review_id", "title"))
    raw = next((tmp_path / "o").glob("part-*.csv")).read_bytes()
    assert b'r,"\t=HYPERLINK(""x"")"\r\n' in raw


def test_stream(spark, tmp_path):
    from gleaner.streaming import ingest

    (tmp_path / "in").mkdir()
    line = '{{"source_review_id": "{}", "country": "us", "rating": {}, "created_at": "2024-0{}-01T00:00:00Z"}}\n'
    (tmp_path / "in/a.json").write_text("".join(line.format(*x) for x in (("a", 5, 1), ("a", 5, 1), ("b", 1, 1), ("c", 2, 6))))
    windows = ingest.rating_windows(ingest.once(ingest.read_stream(spark, str(tmp_path / "in"))))
    ingest.write_windows(windows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sum(r["n"] for r in got) == 2


def test_means_of_periods(spark):
    df = reviews(spark, [5, 4, 4, 3] * 10 + [1, 2, 2, 3] * 10, [2026] * 40 + [2025] * 40)
    got = {r["bucket"]: r for r in ratings.period_means(df).collect()}
    assert got[0]["low"] < 4.0 < got[0]["high"] and got[1]["low"] < 2.0 < got[1]["high"] and got[0]["low"] > got[1]["high"]
    assert {r["reason"] for r in ratings.period_means(reviews(spark, [5, 4, 4, 3] * 10, reachable=40)).collect()} == {"census"}
    two = df.union(df.withColumn("app_id", F.lit(2).cast("long")))
    ends = {(r["low"], r["high"]) for r in ratings.mean_bca_ci(two).collect()}
    assert len(ends) == 2 and max(a for a, _ in ends) - min(a for a, _ in ends) < 0.1  # draws of their own


def test_comparison_with_a_walk(spark):
    df = reviews(spark, [1] * 10 + [5] * 90, reachable=100)
    dist = ratings.distribution(reviews(spark, [1] * 5 + [5] * 45, reachable=100), "rating", [1, 2, 3, 4, 5])
    got = {r["rating"]: r for r in ratings.population_compare(dist, ratings.frame_weights(df)).collect()}
    assert got[1]["covers"] and got[3]["true_share"] == 0.0 and got[3]["skipped"] is None
    why = lambda **k: {r["skipped"] for r in ratings.population_compare(dist, ratings.frame_weights(k.pop("walk", df)), **k).collect()}
    assert why(window_days=30) == {"window_frame"} and why(walk=df.limit(90)) == {"other_frame"} and why(walk=df.limit(0)) == {"no_population"}


def test_sheets_hide_what_they_should(spark):
    df = spark.createDataFrame([(f"r{i}", "text", 1, "negative") for i in range(50)], "review_id string, text string, star int, prior string")
    got = sampling.relabel_sample(df, 30, 1)
    assert got.columns == ["review_id", "text", "human_label"] and got.count() == 30 and {r["human_label"] for r in got.collect()} == {""}


def test_booleans_of_whole_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("2", "-1", "00", " Yes ", "no", "x", None)], "v string").select(source.optional_bool(F.col("v")).alias("b"))
    assert [r["b"] for r in df.collect()] == [True, True, False, True, False, None, None]


def test_normalised_pages_equal_python(spark):
    import html
    import re
    import unicodedata

    said = ["<p>ﬁne &amp; &eacute;t&#233; ½ x²</p>\r\n\x07 Ａ　b", "&lt;b&gt; &nbsp; &unknown; \u2028 end", "", None]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in said], "v string").select(text.normalise(F.col("v")).alias("t")).collect()]
    plain = lambda x: re.sub(r"\s+", " ", "".join(c for c in unicodedata.normalize("NFKC", html.unescape(x or "")) if c >= " " and c != "\x7f" or c in "\t\n\r")).strip()
    assert got == [plain(x) for x in said]


def test_rows_of_a_group_are_broadcast_and_phrases_are_not_dealt_by_group(spark):
    """A join dealt by a handful of groups would bring all phrases of one to a task, however large the tables are by Spark's measure."""
    from gleaner.operators import phrases

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = spark.range(100).selectExpr("id % 2 AS app_id", "'us' AS country", "CAST(id AS STRING) AS phrase", "id AS support", "id + 1 AS rest")
        plan = phrases.fightin_words(counts)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert phrases.fightin_words(counts).count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_units_are_stored_before_they_are_matched(spark):
    from gleaner.plans import demo

    u, m = demo.matched(spark, "/root/testdata/sf0.001")
    assert all("documents" not in f for df in (u, m) for f in df.inputFiles()) and u.count() > 0
