import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import grams, phrases, sentiment

TEXTS = [(1, "a b c a b", 4, 2.0), (1, "b  c", None, 1.0), (2, "a b c", 1, None), (2, None, 7, 7.0), (None, "", 7, 7.0), (None, "é b", 0, 3.0), (1, "a b", 9, 0.5)]


def plain(words: str | None) -> set[str]:
    w = [x for x in (words or "").split(" ") if x]
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def test_counted_against_plain_sets(spark):
    df = spark.createDataFrame(TEXTS, "k int, lexical_text string, a bigint, d double").repartition(3)
    got = grams.counted(df.withColumn("b", F.col("a")), ["k"], sums=["a"], least=["b"], greatest=["d"], count="n").collect()
    wanted = {}
    for k, words, a, d in TEXTS:
        for g in plain(words):
            wanted.setdefault((k, g), []).append((a, d))
    assert {(r["k"], r["phrase"]): (r["a"], r["b"], r["d"], r["n"]) for r in got} == {
        key: (sum(a or 0 for a, _ in v), min((a for a, _ in v if a is not None), default=None), max((d for _, d in v if d is not None), default=None), len(v)) for key, v in wanted.items()
    }


def test_sizes_of_texts(spark):
    df = spark.createDataFrame([(i, t[1]) for i, t in enumerate(TEXTS)], "i int, lexical_text string")
    assert {r["i"]: r["n_grams"] for r in grams.sizes(df).collect()} == {i: len(plain(t[1])) for i, t in enumerate(TEXTS)}


def test_chunks_hold_all_rows(monkeypatch):
    monkeypatch.setattr(grams, "CHUNK", 10)
    batches = [pa.record_batch({"t": ["abc", "de", "x" * 30, "", "y"]}), pa.record_batch({"t": ["z" * 4, None, "q"]})]
    got = [c.column("t").to_pylist() for c in grams._chunks(iter(batches), "t")]
    assert sum(got, []) == ["abc", "de", "x" * 30, "", "y", "z" * 4, None, "q"] and len(got) > 1


def test_words_are_cut_once(spark):
    """The n-grams of a text were built of nine copies of its cleaning, and again for the filter on their number."""
    from gleaner.plans import registry

    plan = registry.ngrams(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 20 and "zip_with" not in plan


def test_phrases_are_tested_after_they_are_counted(spark):
    rows = [("a", "us", f"r{i}", i, "neg pos x", "negative", True, None) for i in range(6)]
    r = spark.createDataFrame(rows, "app_id string, country string, source_review_id string, rank int, lexical_text string, sentiment_label string, analysable boolean, created_at timestamp")
    got = phrases._eligible(phrases.phrase_counts(r, "2026-01-01"), phrases.totals(r), ["neg"], ["app_id", "country"])
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(x["phrase"] for x in got.collect()) == ["neg pos", "neg pos x", "pos", "pos x", "x"]


@pytest.mark.parametrize("said", ["Bad", "so (bad)!", "bad-ish", "badly", "x\tbad\n", "'bad", "...bad...", "b.ad", " bad", "bad bad", "", "né bad,", "bad ", "bad. x", None])
def test_labels_are_those_of_stripped_words(spark, said):
    value = F.lit(said).cast("string")
    row = spark.range(1).select(sentiment.lexicon_scorer(value, ("bad", "two words", "x."), ())["label"].alias("label"), F.arrays_overlap(text.stripped_words(value), F.array(F.lit("bad"))).alias("found")).first()
    assert row["label"] == ("negative" if row["found"] else "neutral")


def test_phrases_of_clusters_are_counted_once(spark):
    u = spark.createDataFrame([("a", "us", c, t) for c, t in ((1, "red car"), (1, "red car"), (2, "blue car"), (2, "blue sky"), (3, "one"))], "app_id string, country string, cluster int, lexical_text string")
    got = phrases.group_phrases(u)
    assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["cluster"], r["phrase"], r["support"]) for r in got.collect()} >= {(1, "red", 2), (2, "blue", 2)}


def test_the_screen_lets_through_what_has_support_and_little_else(spark):
    """Every n-gram of every chunk was spelled out, moved and stored, though few have support."""
    import random

    rng = random.Random(3)
    rows = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(30)), 1) for k in (1, 2, None) for _ in range(60)] + [(4, None, 1), (4, "", 1)]
    df = spark.createDataFrame(rows, "k int, lexical_text string, a bigint").repartition(5)
    plainly = {(r["k"], r["phrase"]): (r["a"], r["n"]) for r in grams.counted(df, ["k"], sums=["a"], count="n").collect()}
    for least in (1, 2, 3, 70):
        bits = spark.sparkContext.broadcast(grams.screen(df, ["k"], least))
        got = {(r["k"], r["phrase"]): (r["a"], r["n"]) for r in grams.counted(df, ["k"], sums=["a"], count="n", screened=bits).collect()}
        totals = {k: v for (k, p), v in got.items() if p is None}
        got = {k: v for k, v in got.items() if k[1] is not None}
        assert {k: v for k, v in plainly.items() if v[1] >= least}.items() <= got.items() <= plainly.items()
        assert totals == {k: (n := sum(v[1] for (g, _), v in plainly.items() if g == k), n) for k in (1, 2, None)} | {4: (0, 0)}
        assert least == 1 or len(got) < len(plainly) / 2


def test_packed_codes_come_back():
    for codes, n in (([], []), ([0], [1]), ([5, 5, (1 << 30) - 1], [300, 2, 255])):
        got = grams._unpacked(grams._packed(np.array(codes, np.int64), np.array(n, np.int64)), len(codes))
        assert got[0].tolist() == codes and got[1].tolist() == [min(x, 255) for x in n]


def test_distinctive_phrases_of_what_has_support(spark):
    rows = [("a", "us", f"r{i}", i, f"neg slow app x{i} bug{i % 3} y{i} stuck{i % 7}" if i % 2 else f"good app x{i} z bug{i % 5}", "negative" if i % 2 else "positive", True, None) for i in range(40)]
    rows += [("b", "us", f"s{i}", i, "so bad here", "negative", True, None) for i in range(6)] + [("c", "us", "t", 0, "one", None, True, None), ("c", None, "t", 1, "neg", "negative", True, None)]
    r = spark.createDataFrame(rows, "app_id string, country string, source_review_id string, rank int, lexical_text string, sentiment_label string, analysable boolean, created_at timestamp")
    sizes = phrases.totals(r)
    counts, sums = phrases.supported(r, "2026-01-01", sizes)
    assert "MapInArrow" not in counts._jdf.queryExecution().optimizedPlan().toString() and counts.where("support < 2").isEmpty()
    one, other = (sorted(map(tuple, phrases.distinctive_phrases(c, sizes, ["neg"], **more).collect()), key=str) for c, more in ((phrases.phrase_counts(r, "2026-01-01"), {}), (counts, {"sums": sums})))
    assert one == other and len(one) > 2


def test_areas_by_phrases_only_count_groups_without_others(spark, tmp_path, monkeypatch):
    """Phrases of all groups were counted and stored, whether they were looked at or not."""
    import duckdb

    from gleaner.plans import registry

    said = {0: "Ther of the thing was slow and bad and it did not work at all today again.", 1: "All is fine with than here.", 2: "Ther of the thing was slow and bad and it did not work at all today again.", 3: "Die slow login broke again les {}.", 4: "Nothing to say."}
    docs = [(i, said[i % 5].format(i), "en") for i in range(80)] + [(83, "Than good login.", "en"), (88, None, "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counted, supported = set(), phrases.supported

    def watched(reviews, *more):
        counted.update(r["app_id"] for r in reviews.select("app_id").distinct().collect())
        return supported(reviews, *more)

    monkeypatch.setattr(phrases, "supported", watched)
    got = registry.all_areas(spark, str(tmp_path)).collect()
    assert counted == {1, 3, 4} and {r["source"] for r in got} == {"issue_category", "theme", "phrase", None}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(registry.SQL["all_areas"]).fetchall(), key=str)
