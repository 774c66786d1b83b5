import pytest
from pyspark.sql import functions as F

from gleaner.functions import stats, text, wordlists


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "wanted"),
    [
        ("I don’t like it and can't cancel; it’s odd", "i do not like it and cannot cancel its odd"),
        ("They won't, we've, you'll, I'm, he'd, they're", "they will not we have you will i am he would they are"),
        ("façade x² naïve", "façade x naïve"),
        ("", ""),
    ],
)
def test_lexical(spark, said, wanted):
    got = one(spark, text.lexical(F.lit(said)))
    assert got == wanted or (said.startswith("façade") and got.replace("²", "") == wanted)


def test_normalise_and_null(spark):
    assert one(spark, text.normalise(F.lit(" a&amp;b　 \x07c\n"))) == "a&b c"
    assert one(spark, text.normalise(F.lit(None).cast("string"))) == ""


@pytest.mark.parametrize(
    ("title", "body", "wanted"),
    [("Great", "Great app", "Great app"), ("Scam", "Scammers took my money", "Scam. Scammers took my money"), ("Wow!", "Nice", "Wow! Nice"), ("", "b", "b"), ("t", "", "t"), ("SAME", "same", "same")],
)
def test_joined(spark, title, body, wanted):
    assert one(spark, text.joined(F.lit(title), F.lit(body))) == wanted


def test_ngrams_and_sentences(spark):
    assert set(one(spark, text.ngrams(F.split(F.lit("a b c a b"), " ")))) == {"a", "b", "c", "a b", "b c", "c a", "a b c", "b c a", "c a b"}
    assert one(spark, text.ngrams(F.split(F.lit("a"), " "))) == ["a"]
    assert one(spark, text.sentences(F.lit("One. Two!  Three?x 4."))) == ["One.", "Two!", "Three?x 4."]


def test_flags(spark):
    none = F.array().cast("array<string>")
    assert one(spark, text.flags(F.lit("😀"), F.lit("😀"), F.lit(""), F.lit("und"), none)) == ["empty_body", "title_only", "emoji_only", "short"]
    assert one(spark, text.flags(F.lit(""), F.lit(""), F.lit(""), F.lit("und"), none)) == ["empty_body", "short", "no_text"]


@pytest.mark.parametrize("said", ["=HYPERLINK", "+x", "-x", "@x", "\tx", "\rx", "\nx", "＝x"])
def test_csv_safe(spark, said):
    assert one(spark, text.csv_safe(F.lit(said))) == "\t" + said


def test_wilson(spark):
    w = one(spark, stats.wilson(F.lit(64), F.lit(100)))
    assert (round(w["low"], 5), round(w["high"], 5)) == (0.54235, 0.72729)
    w = one(spark, stats.wilson(F.lit(2), F.lit(4)))
    assert (w["low"], w["high"]) == (pytest.approx(0.15003898915214947), pytest.approx(0.8499610108478506))
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))) is None
    assert one(spark, stats.wilson(F.lit(0), F.lit(9)))["low"] == 0.0
    assert one(spark, stats.wilson(F.lit(9), F.lit(9)))["high"] == 1.0


def test_proportion_reasons(spark):
    assert one(spark, stats.proportion(F.lit(0), F.lit(0), F.lit(10)))["reason"] == "no_reviews"
    assert one(spark, stats.proportion(F.lit(3), F.lit(10), F.lit(10)))["reason"] == "census"
    wide, narrow = (one(spark, stats.proportion(F.lit(30), F.lit(100), F.lit(n))) for n in (10**6, 120))
    assert wide["low"] < narrow["low"] < 0.3 < narrow["high"] < wide["high"]


def test_wordlists_are_lexical(spark):
    phrases = [p.strip() for _, _, said in wordlists.LEXICON for p in said.split(",")]
    got = spark.createDataFrame([(p,) for p in phrases], "p string").select(text.lexical(F.col("p")).alias("q")).collect()
    assert [r["q"] for r in got] == phrases
    assert max(len(p.split()) for p in phrases) == 5


def test_a_title_that_ends_with_a_line_end_gets_its_mark(spark):
    from gleaner.functions import text

    df = spark.createDataFrame([("Bad.\n", "It broke"), ("Bad.", "It broke"), ("Bad\n", "It broke")], "title string, body string")
    assert [r[0] for r in df.select(text.joined(F.col("title"), F.col("body"))).collect()] == ["Bad.\n. It broke", "Bad. It broke", "Bad\n. It broke"]


def test_a_unit_vector_is_computed_once(spark):
    """However many components it has, the plan names the text once, and so evaluates it once."""
    from gleaner.operators import sentiment

    df = spark.createDataFrame([("the of the", 0), (None, 1), ("", 2)], "text string, n int")
    got = df.select("n", sentiment.hash_embed(F.col("text"), (("the", "of"), ("zz",))).alias("v"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1
    rows = {r["n"]: r["v"] for r in got.collect()}
    assert [round(x, 6) for x in rows[0]] == [0.948683, 0.0, 0.316228] and rows[2] == [0.0, 0.0, 1.0] and rows[1] == [0.0] * 3
