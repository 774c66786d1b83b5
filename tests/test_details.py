"""Small operators that no SQL query shows: order by labels, names that block, documents of collections, subgroups."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions import stats, text
from gleaner.operators import categories, evaluate, insights, phrases, ratings
from gleaner.sources import reviews as source
from gleaner.sources import sinks


def test_ties_of_categories_go_by_label(spark):
    matched = spark.createDataFrame([(1, "us", c, r, 3, None) for c in ("a", "b", "c") for r in ("x", "y")], "app_id int, country string, category_id string, review_id string, rating int, created_at timestamp")
    complaint = spark.createDataFrame([(1, "us", 4)], "app_id int, country string, n_complaint_reviews long")
    labels = spark.createDataFrame([("a", "Zeta", "p"), ("a", "Zeta", "q"), ("b", "Alpha", "r"), ("c", "Alpha", "s")], "category_id string, label string, phrase string")
    order = lambda df: [r["category_id"] for r in df.orderBy("rank").collect()]
    assert order(categories.category_stats(matched, complaint, "2026-01-01", labels=labels)) == ["b", "c", "a"]
    assert order(categories.category_stats(matched, complaint, "2026-01-01")) == ["a", "b", "c"]


def test_an_apps_name_blocks_for_it_alone(spark):
    rows = [(a, "us", str(i), i, "negative", "spark mail is slow", True, None) for a in (1, 2, 3) for i in range(6)]
    r = spark.createDataFrame(rows, "app_id int, country string, source_review_id string, rank long, sentiment_label string, lexical_text string, analysable boolean, created_at timestamp")
    apps = spark.createDataFrame([(1, "us", "Spark Mail!"), (1, "us", "Slow"), (2, "us", None)], "app_id int, country string, name string")
    assert {tuple(x) for x in phrases.own_words(apps).select("app_id", F.concat_ws(",", F.array_sort("own_words"))).collect()} == {(1, "mail,slow,spark"), (2, "")}
    got = phrases.common_phrases(phrases.phrase_counts(r, "2026-01-01"), phrases.totals(r, apps=apps))
    shown = {a: {x["phrase"] for x in got.where(F.col("app_id") == a).collect()} for a in (1, 2, 3)}
    assert shown[1] == set() and shown[2] == shown[3] != set() and any("spark" in p for p in shown[3])


def test_flags_after_scoring(spark):
    df = spark.createDataFrame([(["short"], True), (None, True), (["truncated"], True), (["short"], None), (None, False)], "flags array<string>, cut boolean")
    assert [r[0] for r in df.select(text.scored_flags(F.col("flags"), F.col("cut"))).collect()] == [["short", "truncated"], ["truncated"], ["truncated"], ["short"], []]


def test_store_benchmark_is_passed_through(spark):
    r = spark.createDataFrame([(1, "us", 4), (1, "us", 5)], "app_id int, country string, rating int")
    frames = spark.createDataFrame([(1, "us", 9, 3.9, 70, [1, 2, 3, 4, 60])], "app_id int, country string, reachable long, store_mean double, rating_count long, histogram array<long>")
    row = ratings.rating_summary(r, frames).first()
    assert row["store_benchmark"].asDict() == {"store_mean": 3.9, "rating_count": 70, "histogram": [1, 2, 3, 4, 60]} and row["mean"] == 4.5
    assert "store_benchmark" not in ratings.rating_summary(r, frames.select("app_id", "country", "reachable")).columns


def test_phrases_are_areas_only_where_there_is_no_other(spark):
    kind = "app_id int, country string, rank int, phrase string, support long, n_negative long, newest timestamp, share_last_12_months double, example_review_id string"
    found = spark.createDataFrame([(a, "us", i, f"p{i}", 5 - i, 10, None, 1.0, "r") for a in (1, 2) for i in (1, 2, 3, 4)], kind)
    others = spark.createDataFrame([(1, "us")], "app_id int, country string")
    shown = spark.createDataFrame([(2, "us", "r", "a text")], "app_id int, country string, source_review_id string, analysis_text string")
    got = insights.areas_of_improvement([insights.phrase_areas(found, others, shown)]).orderBy("rank").collect()
    assert [(r["app_id"], r["area"]) for r in got] == [(2, "p1"), (2, "p2"), (2, "p3")]
    assert got[0]["text"] == "Investigate p1: 4 of 10 complaint reviews (40.0%), for example 'a text'."
    status = insights.area_status(spark.createDataFrame([(2, "us"), (3, "us")], "app_id int, country string"), insights.areas_of_improvement([insights.phrase_areas(found, others, shown)]))
    assert {(r["app_id"], r["status"], r["n_areas"]) for r in status.collect()} == {(2, "ok", 3), (3, "insufficient_signal", 0)}


def test_subgroups_of_units(spark):
    df = spark.createDataFrame([(True, True, True, False), (True, False, False, True), (False, True, False, False)], "truth boolean, kept boolean, mixed boolean, happy boolean")
    got = {r["subgroup"]: (r["precision"], r["recall"]) for r in evaluate.unit_pr_subgroups(df).collect()}
    assert got == {"all": (0.5, 0.5), "mixed": (1.0, 1.0), "four_five_stars": (None, 0.0)}


def test_countries_in_the_supported_set(spark):
    df = spark.createDataFrame([(" US ",), ("usa",), ("de",), ("xx",), (None,)], "c string")
    supported = spark.createDataFrame([("us",), ("de",)], "country string")
    assert sorted(r[0] for r in source.normalise_country(df, supported, "c").collect()) == ["de", "us"]


def test_documents_of_collections(spark, tmp_path):
    r = spark.createDataFrame([(1, "us", i, f"r{i}", 5, "hidden") for i in range(5)], "app_id int, country string, rank long, source_review_id string, rating int, reviewer string")
    apps = spark.createDataFrame([(1, "us", "An app")], "app_id int, country string, name string")
    path = str(tmp_path / "docs")
    sinks.write_collection_json(sinks.collection_documents(r, apps, part_rows=3), path)
    docs = [json.loads(line) for p in (tmp_path / "docs").glob("*.json") for line in p.read_text().splitlines()]
    assert sorted((d["part"], len(d["reviews"]), d["name"]) for d in docs) == [(0, 3, "An app"), (1, 2, "An app")]
    assert "hidden" not in json.dumps(docs)


def test_labels_of_pairs(spark):
    df = spark.createDataFrame([(" Same ",), ("0",), ("different_issue",)], "label string")
    assert [r[0] for r in df.select(stats.same_issue(F.col("label"))).collect()] == [True, False, False]
    with pytest.raises(Exception, match="not a label: maybe"):
        spark.createDataFrame([("maybe",)], "label string").select(stats.same_issue(F.col("label"))).collect()


def test_distance_of_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.6, 0.8], [0.6, 0.8])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(stats.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
