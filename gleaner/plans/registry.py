"""Queries of the review-analytics operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators.graph import shared_folder, stored
from ..operators import categories, crossfit, embedding, evaluate, grams, insights, language, order, phrases, ratings, sampling, sentiment, themes, units
from ..sources import reviews as source
from ..sources import analyses, records, sinks, snapshots
from . import demo, oracle
from .demo import REFERENCE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _light(spark: SparkSession, sf: str) -> DataFrame:
    return demo.light(demo.reviews(spark, sf))



def _reachable(df: DataFrame) -> DataFrame:
    return df.join(demo.frames(df), ["app_id", "country"])




# Ratings


@query(oracle.q(oracle.LIGHT, "SELECT app_id, count(*) AS n, round(avg(rating), 6) AS mean, median(rating) AS median, round(stddev_samp(rating), 6) AS stddev, round(1.0 / (app_id + 1), 6) AS sampling_fraction, app_id = 0 AS census FROM light GROUP BY app_id"))
def rating_summary(spark, sf):
    df = _light(spark, sf)
    got = ratings.rating_summary(df, demo.frames(df))
    return got.select("app_id", "n", r6("mean"), F.col("median"), r6("stddev"), r6("sampling_fraction"), "census")


@query(oracle.q(oracle.LIGHT, f"""SELECT app_id, star AS rating, k AS count, round(k::DOUBLE / n, 6) AS share, round({oracle.shrunk(oracle.low('k', 'n'), 'k', 'n', 'pop', 'low')}, 6) AS low, round({oracle.shrunk(oracle.high('k', 'n'), 'k', 'n', 'pop', 'high')}, 6) AS high,
  CASE WHEN n = pop THEN 'census' END AS reason
FROM (SELECT a.app_id, s.star, n, pop, count(l.rating) AS k FROM (SELECT app_id, count(*) AS n, count(*) * (app_id + 1) AS pop FROM light GROUP BY app_id) a CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS star) s LEFT JOIN light l ON l.app_id = a.app_id AND l.rating = s.star GROUP BY ALL)"""))
def rating_distribution(spark, sf):
    got = ratings.distribution(_reachable(_light(spark, sf)), "rating", [1, 2, 3, 4, 5])
    return got.select("app_id", "rating", "count", r6("share"), r6("ci95.low", "low"), r6("ci95.high", "high"), F.col("ci95.reason").alias("reason"))


@query(oracle.q(oracle.REVIEWS, f"""SELECT app_id, label AS sentiment_label, k AS count, round(k::DOUBLE / n, 6) AS share, round({oracle.shrunk(oracle.low('k', 'n'), 'k', 'n', 'pop', 'low')}, 6) AS low, round({oracle.shrunk(oracle.high('k', 'n'), 'k', 'n', 'pop', 'high')}, 6) AS high
FROM (SELECT a.app_id, s.label, n, pop, count(r.sentiment_label) AS k FROM (SELECT app_id, count(*) AS n, count(*) * (app_id + 1) AS pop FROM reviews GROUP BY app_id) a CROSS JOIN (SELECT unnest(['negative', 'neutral', 'positive']) AS label) s LEFT JOIN reviews r ON r.app_id = a.app_id AND r.sentiment_label = s.label GROUP BY ALL)"""))
def sentiment_distribution(spark, sf):
    got = ratings.distribution(_reachable(demo.reviews(spark, sf).select("app_id", "country", "sentiment_label")), "sentiment_label", stats.LABELS)
    return got.select("app_id", "sentiment_label", "count", r6("share"), r6("ci95.low", "low"), r6("ci95.high", "high"))


@query(oracle.q(oracle.LIGHT, """SELECT app_id, round(sum(rating * 1.0) / count(*), 6) AS store_mean, true AS agrees FROM light GROUP BY app_id"""))
def store_mean(spark, sf):
    walk = ratings.population_walk(_light(spark, sf))
    frames = walk.select("app_id", F.array(*[f"stars_{s}" for s in range(1, 6)]).alias("histogram"), F.col("mean").alias("looked_up"))
    return ratings.store_mean(frames).select("app_id", r6("store_mean"), "agrees")


@query(oracle.q(oracle.LIGHT.replace("light AS", "RECURSIVE_light AS").replace("RECURSIVE_", "") + f""",
years AS (SELECT app_id, country, year(created_at) AS y, count(*) AS n, count(*) FILTER (rating <= 2) AS low, sum(rating) AS s FROM light WHERE created_at IS NOT NULL GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY y DESC) AS i FROM years),
folded(app_id, i, y, n, low, s, bucket, held) AS (
  SELECT app_id, i, y, n, low, s, 0, CASE WHEN n >= 15 THEN 0 ELSE n END FROM ordered WHERE i = 1
  UNION ALL SELECT o.app_id, o.i, o.y, o.n, o.low, o.s, f.bucket + CASE WHEN f.held = 0 THEN 1 ELSE 0 END, CASE WHEN f.held + o.n >= 15 THEN 0 ELSE f.held + o.n END FROM folded f JOIN ordered o ON o.app_id = f.app_id AND o.i = f.i + 1),
last AS (SELECT app_id, max(bucket) AS b, arg_max(held, i) AS held FROM folded GROUP BY app_id),
placed AS (SELECT f.*, CASE WHEN l.held > 0 AND f.bucket = l.b THEN greatest(l.b - 1, 0) ELSE f.bucket END AS bk FROM folded f JOIN last l USING (app_id)),
got AS (SELECT app_id, bk AS bucket, min(y) AS a, max(y) AS b, sum(n)::BIGINT AS n, sum(s)::DOUBLE / sum(n) AS mean, sum(low)::BIGINT AS low FROM placed GROUP BY ALL),
pops AS (SELECT app_id, count(*) * (app_id + 1) AS r FROM light GROUP BY app_id),
whole AS (SELECT g.*, CASE WHEN app_id = 0 THEN n ELSE greatest(r, n + 1) END AS pop FROM got g JOIN pops USING (app_id))""",
    f"SELECT app_id, CAST(bucket AS INTEGER) AS bucket, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END AS label, n, round(mean, 6) AS mean, round(low::DOUBLE / n, 6) AS low_share, round({oracle.shrunk(oracle.low('low', 'n'), 'low', 'n', 'pop', 'low')}, 6) AS low, round({oracle.shrunk(oracle.high('low', 'n'), 'low', 'n', 'pop', 'high')}, 6) AS high FROM whole").replace("WITH", "WITH RECURSIVE", 1))
def period_metrics(spark, sf):
    got = ratings.period_metrics(_reachable(_light(spark, sf)))
    return got.select("app_id", "bucket", "label", "n", r6("mean"), r6("low_share"), r6("low_ci95.low", "low"), r6("low_ci95.high", "high"))


@query(oracle.q(oracle.LIGHT, """SELECT app_id, count(*) AS total, round(avg(rating), 6) AS mean, count(*) FILTER (rating = 1) AS stars_1, count(*) FILTER (rating = 2) AS stars_2, count(*) FILTER (rating = 3) AS stars_3, count(*) FILTER (rating = 4) AS stars_4, count(*) FILTER (rating = 5) AS stars_5,
  (SELECT string_agg(y || ':' || n, ',' ORDER BY y) FROM (SELECT year(created_at) AS y, count(*) AS n FROM light l WHERE l.app_id = o.app_id AND created_at IS NOT NULL GROUP BY 1)) AS per_year FROM light o GROUP BY app_id"""))
def population_walk(spark, sf):
    got = ratings.population_walk(_light(spark, sf))
    years = F.array_join(F.transform(F.map_entries("per_year"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    return got.select("app_id", "total", r6("mean"), *[f"stars_{s}" for s in range(1, 6)], years.alias("per_year"))


@query(oracle.q(oracle.LIGHT, "SELECT app_id, CAST(rating AS INTEGER) AS rating, count(*) AS count, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY app_id), 6) AS share FROM light GROUP BY app_id, rating"))
def frame_weights(spark, sf):
    return ratings.frame_weights(_light(spark, sf)).select("app_id", "rating", "count", r6("share"))


@query(oracle.q(oracle.LIGHT, f"""SELECT app_id, star AS rating, round(k::DOUBLE / n, 6) AS share, round(t::DOUBLE / pop, 6) AS true_share,
  CASE WHEN n < pop THEN t::DOUBLE / pop BETWEEN {oracle.shrunk(oracle.low('k', 'n'), 'k', 'n', 'pop', 'low')} AND {oracle.shrunk(oracle.high('k', 'n'), 'k', 'n', 'pop', 'high')} END AS covers, CASE WHEN n = pop THEN 'census' END AS skipped
FROM (SELECT a.app_id, s.star, count(*) AS pop, least(100, count(*)) AS n, count(*) FILTER (rating = star) AS t, count(*) FILTER (rating = star AND i <= 100) AS k
  FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY md5('42:' || source_review_id), source_review_id) AS i FROM light) a CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS star) s GROUP BY a.app_id, s.star)"""))
def population_compare(spark, sf):
    df = _light(spark, sf)
    drawn = sampling.uniform_sample(df, 100, 42)
    dist = ratings.distribution(drawn.join(df.groupBy(*ratings.GROUP).agg(F.count("*").alias("reachable")), list(ratings.GROUP)), "rating", [1, 2, 3, 4, 5])
    return ratings.population_compare(dist, ratings.frame_weights(df)).select("app_id", "rating", r6("share"), r6("true_share"), "covers", "skipped")


@query(oracle.COVERAGE)
def ci_coverage(spark, sf):
    """1000 replicates of 100 reviews an app."""
    return ratings.ci_coverage(_light(spark, sf)).select("app_id", "rating", "evaluable", "covered", r6("rate"))


@query()
def ci_coverage_mean(spark, sf):
    return ratings.mean_coverage(_light(spark, sf)).select("app_id", "evaluable", "covered", r6("rate"))


@query()
def mean_bca_ci(spark, sf):
    return ratings.mean_bca_ci(_reachable(_light(spark, sf))).select("app_id", "n", r6("mean"), r6("low"), r6("high"), "reason")


# Text


@query(r"""SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)""")
def split_sentences(spark, sf):
    s = text.sentences(F.coalesce("text", F.lit("")))
    return demo.table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"SELECT doc_id, md5({oracle.LEXICAL.format('text')}) AS digest FROM documents")
def lexical_text(spark, sf):
    return demo.table(spark, sf, "documents").select("doc_id", F.md5(text.lexical(F.col("text"))).alias("digest"))


@query(oracle.q(oracle.PHRASES.split("counts AS")[0].rstrip().rstrip(","), "SELECT source_review_id, count(*) AS n_grams FROM grams GROUP BY source_review_id"))
def ngrams(spark, sf):
    r = demo.reviews(spark, sf).where("analysable").select("source_review_id", "lexical_text")
    return grams.sizes(r).where("n_grams > 0")


@query("SELECT page_id, md5(trim(regexp_replace(url, '[\\s\\p{Z}]+', ' ', 'g'))) AS digest FROM pages".replace("\\\\", "\\"))
def normalise_text(spark, sf):
    # Addresses have no characters that NFKC changes; entities in them would have to be of the kind that needs a semicolon.
    return demo.table(spark, sf, "pages").select("page_id", F.md5(text.normalise(F.col("url"))).alias("digest"))


@query()
def normalise_html(spark, sf):
    """Whole pages, entities and all; SQL has no NFKC, so a test compares it with Python."""
    return demo.table(spark, sf, "pages").select("page_id", F.md5(text.normalise(F.col("html"))).alias("digest"))


@query(r"""SELECT doc_id, array_to_string(list_filter([
  CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty_body' END, CASE WHEN text <> '' AND NOT regexp_matches(text, '[\p{L}\p{N}]') THEN 'emoji_only' END,
  CASE WHEN length(coalesce(text, '')) < 20 THEN 'short' END, CASE WHEN length(text) > 2000 THEN 'long_text' END, CASE WHEN coalesce(text, '') = '' THEN 'no_text' END,
  CASE WHEN text <> '' AND lang NOT IN ('en', 'und') THEN 'non_english' END], lambda x: x IS NOT NULL), ',') AS flags, text <> '' AND lang IN ('en', 'und') AS analysable FROM documents""")
def text_flags(spark, sf):
    t = F.coalesce("text", F.lit(""))
    flags = text.flags(t, F.lit(""), t, F.col("lang"), F.array().cast("array<string>"))
    return demo.table(spark, sf, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"), text.analysable(t, F.col("lang")).alias("analysable"))


@query(r"""WITH t AS (SELECT doc_id, text AS body, left(text, CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 0 END) || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END AS title FROM documents)
SELECT doc_id, md5(CASE WHEN title = '' OR (lower(title) = lower(body) OR starts_with(lower(body), lower(title)) AND NOT regexp_matches(substr(lower(body), length(title) + 1, 1), '[\p{L}\p{N}]')) THEN body
  WHEN regexp_matches(title, '[.!?\p{So}\p{Sk}]$') THEN title || ' ' || body ELSE title || '. ' || body END) AS digest FROM t""")
def analysis_text(spark, sf):
    d = demo.table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), F.concat(F.left("text", F.when(F.col("doc_id") % 2 == 0, 12).otherwise(0)), F.when(F.col("doc_id") % 3 == 0, "!").otherwise("")).alias("title"))
    return d.select("doc_id", F.md5(text.joined(F.col("title"), F.col("body"))).alias("digest"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(v, '^[=+\-@\t\r\n＝＋－＠]') THEN chr(9) || v ELSE v END AS safe FROM (SELECT page_id, list_element(['=', '+', '-', '@', '', 'a', '＝'], CAST(page_id % 7 + 1 AS INTEGER)) || url AS v FROM pages)")
def csv_escape(spark, sf):
    v = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "", "a", "＝")]), (F.col("page_id") % 7 + 1).cast("int")), F.col("url"))
    return demo.table(spark, sf, "pages").select("page_id", text.csv_safe(v).alias("safe"))


@query("SELECT page_id, CASE WHEN regexp_matches(v, '^[0-9]{1,19}$') THEN TRY_CAST(v AS BIGINT) ELSE TRY_CAST(nullif(regexp_extract(v, '/id([0-9]{1,19})$', 1), '') AS BIGINT) END AS app_id FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN CAST(page_id + 1 AS VARCHAR) WHEN 1 THEN 'https://apps.apple.com/us/app/some-name/id' || (page_id + 5) ELSE 'no number' END AS v FROM pages)")
def parse_app_id(spark, sf):
    n = lambda k: (F.col("page_id") + k).cast("string")
    v = F.when(F.col("page_id") % 3 == 0, n(1)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://apps.apple.com/us/app/some-name/id"), n(5))).otherwise("no number")
    return demo.table(spark, sf, "pages").select("page_id", source.parse_app_id(v).alias("app_id"))


@query("SELECT conv_id, turn, role, CASE WHEN length(trim(text)) > 300 THEN rtrim(left(trim(text), 297)) || '...' ELSE trim(text) END AS excerpt FROM conversations")
def truncate_excerpt(spark, sf):
    return demo.table(spark, sf, "conversations").select("conv_id", "turn", "role", text.excerpt(F.col("text")).alias("excerpt"))


@query(f"SELECT doc_id, {oracle.label('text', demo.NEGATIVE, demo.POSITIVE)} AS label, len(string_split_regex(trim(text), '\\s+')) > 512 AS truncated FROM documents".replace("\\\\", "\\"))
def lexicon_scorer(spark, sf):
    s = sentiment.lexicon_scorer(F.col("text"), demo.NEGATIVE, demo.POSITIVE)
    return demo.table(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.label", "s.truncated")


TERMS = (("the", "of"), ("ing", "er"), ("en", "de"), ("que", "la"))
_HITS = ", ".join("(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) / {len(w)}.0" for w in g) + ")" for g in TERMS)


@query(f"SELECT doc_id, list_transform([h[1] / n, h[2] / n, h[3] / n, h[4] / n, h[5] / n], lambda x: round(x, 6)) AS vector FROM (SELECT doc_id, h, sqrt(list_dot_product(h, h)) AS n FROM (SELECT doc_id, [{_HITS}, 1.0]::DOUBLE[] AS h FROM (SELECT doc_id, lower(text) AS t FROM documents)))")
def hash_embed(spark, sf):
    return demo.table(spark, sf, "documents").select("doc_id", F.transform(sentiment.hash_embed(F.col("text"), TERMS), lambda x: F.round(x, 6)).alias("vector"))


@query()
def lang_profile(spark, sf):
    """Profiles of all texts of the given languages, and the language that they give each text."""
    d = demo.table(spark, sf, "documents").select("doc_id", "text", "lang")
    return language.detect(d, language.profiles(d)).select("doc_id", "language", r6("confidence"))


# Consistency and preparation


@query(oracle.q(oracle.REVIEWS, f"""SELECT app_id, count(*) AS compared, count(*) FILTER (sentiment_label = {oracle.STAR}) AS agreeing, count(*) FILTER (rating <= 2 AND sentiment_label = 'positive') AS low_stars_positive, count(*) FILTER (rating <= 2 AND sentiment_label = 'neutral') AS low_stars_neutral,
  count(*) FILTER (rating >= 4 AND sentiment_label = 'negative') AS high_stars_negative, count(*) FILTER (rating >= 4 AND sentiment_label = 'neutral') AS high_stars_neutral, round(count(*) FILTER (sentiment_label = {oracle.STAR})::DOUBLE / count(*), 6) AS agreement FROM reviews WHERE rating <> 3 GROUP BY app_id"""))
def rating_consistency(spark, sf):
    return sentiment.rating_consistency(demo.reviews(spark, sf)).drop("country").withColumn("agreement", F.round("agreement", 6))


@query(oracle.q(oracle.LIGHT, """SELECT app_id, count(*) AS n, count(*) FILTER (analysable) AS n_analysable,
  (SELECT string_agg(f || ':' || k, ',' ORDER BY f) FROM (SELECT f, count(*) AS k FROM (SELECT CASE WHEN length(body) > 2000 THEN 'long_text' END AS f, app_id FROM light UNION ALL SELECT CASE WHEN language <> 'en' THEN 'non_english' END, app_id FROM light) x WHERE x.app_id = o.app_id AND f IS NOT NULL GROUP BY f)) AS flags,
  (SELECT string_agg(language || ':' || k, ',' ORDER BY language) FROM (SELECT language, count(*) AS k FROM light x WHERE x.app_id = o.app_id GROUP BY language)) AS languages FROM light o GROUP BY app_id"""))
def preprocessing_summary(spark, sf):
    got = sentiment.preprocessing_summary(demo.reviews(spark, sf).select("app_id", "country", "analysable", "flags", "language"))
    said = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias(c)
    return got.select("app_id", "n", "n_analysable", said("flags"), said("languages"))


@query(oracle.q(oracle.LIGHT, """SELECT app_id, rank, source_review_id FROM (SELECT app_id, source_review_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY NOT (length(body) > 2000 OR language <> 'en'), source_review_id) AS INTEGER) AS rank FROM light) WHERE rank <= 5"""))
def preprocessing_examples(spark, sf):
    return sentiment.preprocessing_examples(demo.reviews(spark, sf)).select("app_id", "rank", "source_review_id")


# Phrases


@query(oracle.q(oracle.PHRASES, "SELECT app_id, phrase, support, rest, example_review_id, strftime(newest, '%Y-%m-%d') AS newest FROM counts"))
def phrase_support(spark, sf):
    got = phrases.phrase_support(demo.reviews(spark, sf), REFERENCE)
    return got.select("app_id", "phrase", "support", "rest", "example_review_id", _day("newest"))


@query(oracle.q(oracle.PHRASES, "SELECT app_id, phrase, round(z, 6) AS z FROM words"))
def fightin_words(spark, sf):
    got = phrases.fightin_words(phrases.phrase_counts(demo.reviews(spark, sf), REFERENCE))
    return got.select("app_id", "phrase", r6("z"))


_LONGER = "NOT EXISTS (SELECT 1 FROM {t} o WHERE o.app_id = e.app_id AND o.support = e.support AND length(o.phrase) > length(e.phrase) AND contains(' ' || o.phrase || ' ', ' ' || e.phrase || ' '))"


@query(oracle.q(oracle.PHRASES, f"SELECT app_id, rank, phrase, support, n_negative, rest, n_rest, example_review_id, round(share_last_12_months, 6) AS share_last_12_months FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY support DESC, phrase) AS INTEGER) AS rank FROM eligible e WHERE {_LONGER.format(t='eligible')}) WHERE rank <= 15"))
def common_phrases(spark, sf):
    r = demo.reviews(spark, sf)
    got = phrases.with_examples(phrases.common_phrases(phrases.phrase_counts(r, REFERENCE), phrases.totals(r), demo.BLOCKED), r)
    return got.select("app_id", "rank", "phrase", "support", "n_negative", "rest", "n_rest", "example_review_id", r6("share_last_12_months"))


def _distinctive(r: DataFrame) -> DataFrame:
    sizes = stored(phrases.totals(r))
    counts, sums = phrases.supported(r, REFERENCE, sizes)
    return phrases.with_examples(phrases.distinctive_phrases(counts, sizes, demo.BLOCKED, sums=sums), r)


@query(oracle.q(oracle.PHRASES + ", positive AS (SELECT * FROM eligible WHERE z > 0)", f"SELECT app_id, rank, phrase, support, rest, round(z, 6) AS z, z >= 1.96 AS z_ge_1_96 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY round(z, 9) DESC, support DESC, phrase) AS INTEGER) AS rank FROM positive e WHERE {_LONGER.format(t='positive')}) WHERE rank <= 15"))
def distinctive_phrases(spark, sf):
    r = demo.reviews(spark, sf)
    got = _distinctive(r)
    return got.select("app_id", "rank", "phrase", "support", "rest", r6("z"), "z_ge_1_96")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinctive phrases of negative reviews, end to end."""
    return distinctive_phrases(spark, sf_dir)


_GROUPED = oracle.UNITS + f""",
words_ AS (SELECT app_id, rating AS cluster, list_filter(string_split(lexical_text, ' '), lambda x: x <> '') AS w FROM units),
grams AS (SELECT app_id, cluster, unnest({oracle.GRAMS}) AS phrase FROM words_),
own AS (SELECT app_id, cluster, phrase, count(*) AS support FROM grams GROUP BY ALL),
whole AS (SELECT app_id, phrase, sum(support) AS everywhere FROM own GROUP BY ALL),
sizes AS (SELECT app_id, rating AS cluster, count(*) AS n_units FROM units GROUP BY ALL),
sums AS (SELECT app_id, cluster, sum(support) AS ng, sum(sum(support)) OVER (PARTITION BY app_id) AS nt FROM own GROUP BY app_id, cluster),
prior AS (SELECT o.*, everywhere - support AS rest, ng, nt - ng AS nr, n_units, 100.0::DOUBLE * everywhere / nt AS a FROM own o JOIN whole USING (app_id, phrase) JOIN sums USING (app_id, cluster) JOIN sizes USING (app_id, cluster)),
kept AS (
  SELECT *, (ln((support + a) / (ng + 100 - support - a)) - ln((rest + a) / (nr + 100 - rest - a))) / sqrt(1 / (support + a) + 1 / (rest + a)) AS z FROM prior
  WHERE support >= CASE WHEN n_units = 1 THEN 1 ELSE 2 END AND len(list_filter(string_split(phrase, ' '), lambda x: NOT list_contains({oracle.listed(demo.BLOCKED)}, x) AND regexp_matches(x, '\\p{{L}}'))) > 0)"""


@query(oracle.q(_GROUPED, """SELECT app_id, cluster, rank, phrase, support, round(z, 6) AS z FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, cluster ORDER BY z DESC, phrase) AS INTEGER) AS rank FROM kept e
  WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE o.app_id = e.app_id AND o.cluster = e.cluster AND length(o.phrase) < length(e.phrase) AND contains(' ' || e.phrase || ' ', ' ' || o.phrase || ' '))) WHERE rank <= 5"""))
def group_phrases(spark, sf):
    u = demo.kept_units(spark, sf).withColumn("cluster", F.col("rating"))
    return phrases.group_phrases(u, blocked=demo.BLOCKED).select("app_id", "cluster", "rank", "phrase", "support", r6("z"))


# Units and categories


@query(oracle.q(oracle.UNITS, "SELECT app_id, review_id, unit_id, md5(sentence) AS digest, negative_score FROM units"))
def unit_gate(spark, sf):
    return demo.kept_units(spark, sf).select("app_id", "review_id", "unit_id", F.md5("sentence").alias("digest"), "negative_score")


@query(oracle.q(oracle.UNITS, "SELECT app_id, count(*) AS candidates, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok AND rating >= 4) AS removed_positive, count(*) FILTER (NOT ok AND rating < 4) AS removed_other FROM (SELECT *, negative_score >= CASE WHEN rating >= 4 THEN 0.85 ELSE 0.50 END AS ok FROM scored WHERE label = 'negative') GROUP BY app_id"))
def gate_accounting(spark, sf):
    return units.gate_accounting(demo.scored_units(spark, sf)).drop("country")


@query(oracle.q(oracle.MATCHED, "SELECT unit_id, category_id, phrase FROM hits"))
def lexicon_match(spark, sf):
    u = demo.kept_units(spark, sf)
    return categories.lexicon_match(u, categories.lexicon(spark, demo.LEXICON), demo.GUARDED, demo.GUARDS)


@query(oracle.q(oracle.MATCHED, "SELECT app_id, category_id, review_id, array_to_string(phrases, ',') AS phrases, unit_id FROM matched"))
def category_match(spark, sf):
    return demo.matched(spark, sf)[1].select("app_id", "category_id", "review_id", F.array_join("phrases", ",").alias("phrases"), "unit_id")


@query(oracle.q(oracle.MATCHED, f"SELECT app_id, category_id, review_count, denominator, round(share, 6) AS share, round({oracle.low('review_count', 'denominator')}, 6) AS low, round({oracle.high('review_count', 'denominator')}, 6) AS high, round(mean_star_rating, 6) AS mean_star_rating, strftime(newest, '%Y-%m-%d') AS newest, round(share_last_12_months, 6) AS share_last_12_months, historical, CAST(row_number() OVER (PARTITION BY app_id ORDER BY historical, share DESC, category_id) AS INTEGER) AS rank FROM stats"))
def category_stats(spark, sf):
    u, m = demo.matched(spark, sf)
    got = categories.category_stats(m, units.complaint_totals(u), REFERENCE)
    return got.select("app_id", "category_id", "review_count", "denominator", r6("share"), r6("ci95.low", "low"), r6("ci95.high", "high"), r6("mean_star_rating"), _day("newest"), r6("share_last_12_months"), "historical", "rank")


@query(oracle.q(oracle.MATCHED, "SELECT app_id, category_id, phrase, count, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, category_id ORDER BY count DESC, len(string_split(phrase, ' ')) DESC, phrase) AS INTEGER) AS rank FROM (SELECT app_id, category_id, phrase, count(*) AS count FROM (SELECT app_id, category_id, unnest(phrases) AS phrase FROM matched) GROUP BY ALL)) WHERE rank <= 5"))
def category_top_phrases(spark, sf):
    return categories.top_phrases(demo.matched(spark, sf)[1]).select("app_id", "category_id", "phrase", "count", "rank")


@query(oracle.q(oracle.MATCHED, f"SELECT app_id, category_id, rank, review_id, {oracle.excerpt('sentence')} AS excerpt FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, category_id ORDER BY len(phrases) DESC, created_at DESC NULLS LAST, review_id) AS INTEGER) AS rank FROM matched) WHERE rank <= 3"))
def evidence_top3(spark, sf):
    return categories.evidence(demo.matched(spark, sf)[1]).drop("country")


@query(oracle.q(oracle.MATCHED, "SELECT app_id, count(r.review_id) AS review_count, c.n_complaint_reviews AS denominator, round(count(r.review_id)::DOUBLE / c.n_complaint_reviews, 6) AS share FROM complaint c LEFT JOIN rest r USING (app_id, country) GROUP BY app_id, c.n_complaint_reviews"))
def uncategorised(spark, sf):
    u, m = demo.matched(spark, sf)
    got = categories.uncategorised_summary(categories.uncategorised(u, m), units.complaint_totals(u))
    return got.select("app_id", "review_count", "denominator", r6("share"))


@query(oracle.q(oracle.MATCHED, f"SELECT app_id, rank, review_id, {oracle.excerpt('sentence')} AS excerpt FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY created_at DESC NULLS LAST, review_id) AS INTEGER) AS rank FROM rest) WHERE rank <= 3"))
def uncategorised_top3(spark, sf):
    u, m = demo.matched(spark, sf)
    return categories.uncategorised_top(categories.uncategorised(u, m)).drop("country")


@query(oracle.q(oracle.MATCHED, "SELECT app_id, category_id AS category, review_id, list_sort(list_transform(best_found, lambda p: {'n': -len(string_split(p, ' ')), 'p': p}))[1].p AS matched_phrase, md5(sentence) AS digest FROM matched"))
def audit_sheet(spark, sf):
    got = categories.audit_sheet(demo.matched(spark, sf)[1])
    return got.select("app_id", "category", "review_id", "matched_phrase", F.md5("sentence").alias("digest"))


# Sampling

PRIO = "md5('{seed}:' || {id})"


@query(oracle.q(oracle.LIGHT, f"SELECT app_id, source_review_id FROM light QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY {PRIO.format(seed=42, id='source_review_id')}, source_review_id) <= 20"))
def uniform_sample(spark, sf):
    return sampling.uniform_sample(_light(spark, sf), 20, 42).select("app_id", "source_review_id")


@query(oracle.q(oracle.LIGHT, f"SELECT source_review_id, row_number() OVER (PARTITION BY app_id ORDER BY {PRIO.format(seed=7, id='source_review_id')}, source_review_id) AS position, app_id FROM light"))
def seeded_order(spark, sf):
    got = sampling.seeded_order(_light(spark, sf), 7, "source_review_id", ["app_id"])
    return got.select("source_review_id", F.col("position").cast("long").alias("position"), "app_id")


@query(oracle.q(oracle.LIGHT, "SELECT app_id, rank, source_review_id FROM light WHERE rank IN (0, 7, 14, 21, 28, 35, 42, 49)"))
def replay_ranks(spark, sf):
    df = _light(spark, sf)
    recorded = df.select("app_id", "country").distinct().withColumn("ranks", F.array(*[F.lit(7 * i).cast("long") for i in range(8)]))
    return sampling.replay_ranks(df, recorded).select("app_id", "rank", "source_review_id")


@query(oracle.q(oracle.LIGHT, "SELECT source_review_id, app_id FROM light WHERE source_review_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"))
def exclude_ids(spark, sf):
    shown = demo.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("source_review_id"))
    return sampling.exclude_ids(_light(spark, sf), shown).select("source_review_id", "app_id")


QUOTAS = {1: 40, 2: 25, 3: 25, 4: 25, 5: 35}


@query(oracle.q(oracle.LIGHT, f"SELECT CAST(rating AS INTEGER) AS rating, source_review_id FROM (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {PRIO.format(seed=42, id='source_review_id')}, source_review_id) AS i FROM light WHERE analysable) WHERE i <= CASE rating WHEN 1 THEN 40 WHEN 5 THEN 35 ELSE 25 END"))
def stratified_draw(spark, sf):
    return sampling.stratified_draw(_light(spark, sf).where("analysable"), QUOTAS, 42).select("rating", "source_review_id")


@query(oracle.q(oracle.LIGHT, f"""SELECT app_id, source_review_id FROM (
  SELECT *, count(*) FILTER (rank % 10 <> 3) OVER w AS good, count(*) FILTER (rank % 10 = 3) OVER w AS bad FROM light WINDOW w AS (PARTITION BY app_id ORDER BY {PRIO.format(seed=5, id='rank')}, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  WHERE good <= 50 AND bad <= 20 AND rank % 10 <> 3"""))
def backfilled_sample(spark, sf):
    taken, _ = sampling.backfilled_sample(_light(spark, sf).withColumn("valid", F.col("rank") % 10 != 3), 50, 5)
    return taken.select("app_id", "source_review_id")


@query(oracle.q(oracle.LIGHT, """SELECT app_id, CAST(100 AS INTEGER) AS requested, least(100, n) AS actual, n * (app_id + 1) AS reachable, least(100, n) >= least(100, n * (app_id + 1)) AS complete, round(least(100, n)::DOUBLE / (n * (app_id + 1)), 6) AS sampling_fraction,
  array_to_string(list_filter([CASE WHEN n * (app_id + 1) < 100 THEN 'frame_below_request' END, CASE WHEN least(100, n) < least(100, n * (app_id + 1)) THEN 'incomplete' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (SELECT app_id, count(*) AS n FROM light GROUP BY app_id)"""))
def sampling_metadata(spark, sf):
    df = _light(spark, sf)
    got = sampling.sampling_metadata(sampling.uniform_sample(df, 100, 42), demo.frames(df), 100)
    return got.select("app_id", "requested", "actual", "reachable", "complete", r6("sampling_fraction"), F.array_join("warnings", ",").alias("warnings"))


@query(oracle.q(oracle.LIGHT, f"SELECT source_review_id FROM light WHERE created_at >= TIMESTAMP '{REFERENCE}' - INTERVAL 730 DAY"))
def window_frame(spark, sf):
    return source.window_frame(_light(spark, sf), REFERENCE, 730).select("source_review_id")


# Evaluation


@query(oracle.q(oracle.JUDGED, "SELECT a.label AS true, b.label AS predicted, count(j.star) AS count FROM labels3 a CROSS JOIN labels3 b LEFT JOIN judged j ON j.true_ = a.label AND j.shipping = b.label GROUP BY ALL"))
def confusion(spark, sf):
    return evaluate.confusion(demo.judged(spark, sf), predicted="shipping")


@query(oracle.q(oracle.JUDGED + """, c AS (SELECT label, count(*) FILTER (true_ = label AND shipping = label) AS tp, count(*) FILTER (shipping = label) AS p, count(*) FILTER (true_ = label) AS t, count(*) AS n FROM judged, labels3 GROUP BY label),
f AS (SELECT *, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0 END AS precision, CASE WHEN t > 0 THEN tp::DOUBLE / t ELSE 0 END AS recall, CASE WHEN p + t > 0 THEN 2.0 * tp / (p + t) ELSE 0 END AS f1 FROM c)""", "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, t AS support, round((SELECT sum(tp)::DOUBLE / max(n) FROM f), 6) AS accuracy, round((SELECT avg(f1) FROM f), 6) AS macro_f1 FROM f"))
def classification_metrics(spark, sf):
    got = evaluate.classification_metrics(demo.judged(spark, sf), predicted="shipping")
    return got.select("label", r6("precision"), r6("recall"), r6("f1"), "support", r6("accuracy"), r6("macro_f1"))


@query(oracle.q(oracle.JUDGED, """SELECT n, round(po, 6) AS observed, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (shipping = challenger)::DOUBLE / count(*) AS po,
  (count(*) FILTER (shipping = 'negative') * count(*) FILTER (challenger = 'negative') + count(*) FILTER (shipping = 'neutral') * count(*) FILTER (challenger = 'neutral') + count(*) FILTER (shipping = 'positive') * count(*) FILTER (challenger = 'positive'))::DOUBLE / (count(*) * count(*)) AS pe FROM judged)"""))
def cohen_kappa(spark, sf):
    return evaluate.cohen_kappa(demo.judged(spark, sf), "shipping", "challenger").select("n", r6("observed"), r6("kappa"))


@query(oracle.q(oracle.JUDGED, "SELECT round(sum(acc * share) / sum(share), 6) AS reweighted_accuracy FROM (SELECT star, avg(CASE WHEN shipping = true_ THEN 1 ELSE 0 END) AS acc, star / 15.0 AS share FROM judged GROUP BY star)"))
def reweighted_accuracy(spark, sf):
    shares = spark.range(1, 6).select(F.col("id").cast("int").alias("star"), (F.col("id") / 15.0).alias("share"))
    got = evaluate.reweighted_accuracy(demo.judged(spark, sf), shares, predicted="shipping")
    return got.select(r6("reweighted_accuracy"))


@query()
def metric_bca_ci(spark, sf):
    got = evaluate.metric_bca_ci(demo.judged(spark, sf), predicted="shipping")
    return got.select("metric", r6("value"), r6("low"), r6("high"), "reason")


@query()
def paired_f1_diff_ci(spark, sf):
    got = evaluate.paired_f1_diff_ci(demo.judged(spark, sf))
    return got.select("metric", r6("value"), r6("low"), r6("high"), "switch")


@query()
def kappa_ci(spark, sf):
    got = evaluate.kappa_ci(demo.judged(spark, sf), "shipping", "challenger", stats.LABELS)
    return got.select("metric", r6("value"), r6("low"), r6("high"))


@query(oracle.q(oracle.JUDGED, "SELECT source_review_id, true_ AS true, shipping, challenger FROM judged WHERE shipping <> true_ OR challenger <> true_ ORDER BY source_review_id LIMIT 8"))
def error_examples(spark, sf):
    return evaluate.error_examples(demo.judged(spark, sf), order="source_review_id").select("source_review_id", "true", "shipping", "challenger")


@query(oracle.q(oracle.UNITS, f"SELECT round(tp::DOUBLE / p, 6) AS precision, round({oracle.low('tp', 'p')}, 6) AS precision_low, round(tp::DOUBLE / t, 6) AS recall, round({oracle.high('tp', 't')}, 6) AS recall_high FROM (SELECT count(*) FILTER (truth AND kept) AS tp, count(*) FILTER (kept) AS p, count(*) FILTER (truth) AS t FROM (SELECT rating <= 2 AS truth, label = 'negative' AND negative_score >= CASE WHEN rating >= 4 THEN 0.85 ELSE 0.50 END AS kept FROM scored))"))
def unit_pr(spark, sf):
    df = demo.scored_units(spark, sf).select((F.col("rating") <= 2).alias("truth"), ((F.col("label") == "negative") & units.passes()).alias("kept"))
    return evaluate.unit_pr(df).select(r6("precision"), r6("precision_ci.low", "precision_low"), r6("recall"), r6("recall_ci.high", "recall_high"))


@query(oracle.q(oracle.MATCHED, f"SELECT coalesce(category_id, 'overall') AS category, correct, n, round(correct::DOUBLE / n, 6) AS precision, round({oracle.low('correct', 'n')}, 6) AS low, round({oracle.high('correct', 'n')}, 6) AS high FROM (SELECT category_id, count(*) FILTER (rating <= 3) AS correct, count(*) AS n FROM matched GROUP BY ROLLUP (category_id))"))
def audit_precision(spark, sf):
    m = demo.matched(spark, sf)[1]
    sheet = categories.audit_sheet(m).join(m.select("app_id", F.col("category_id").alias("category"), "review_id", "rating"), ["app_id", "category", "review_id"])
    got = evaluate.audit_precision(sheet.withColumn("human_label", F.when(F.col("rating") <= 3, "correct").otherwise("incorrect")))
    return got.select("category", "correct", "n", r6("precision"), r6("ci95.low", "low"), r6("ci95.high", "high"))


@query(oracle.q(oracle.VECTORS, "SELECT CAST(g / 100.0 AS DOUBLE) AS threshold, count(*) FILTER (distance <= g / 100.0) AS predicted_same, count(*) FILTER (distance <= g / 100.0 AND same) AS true_same, round(count(*) FILTER (distance <= g / 100.0 AND same)::DOUBLE / nullif(count(*) FILTER (distance <= g / 100.0), 0), 6) AS precision FROM pairs, (SELECT unnest(range(20, 70, 5)) AS g) GROUP BY g"))
def threshold_table(spark, sf):
    v = demo.vectors(spark, sf)
    near = themes.near_pairs(v, 0.66)
    of = lambda c: v.select(F.col("unit_id").alias(f"{c}_id"), F.col("cluster").alias(f"{c}_label"))
    pairs = near.join(of("left"), "left_id").join(of("right"), "right_id").withColumn("same", F.col("left_label") == F.col("right_label"))
    return themes.threshold_table(pairs).select("threshold", "predicted_same", "true_same", r6("precision"))


# Themes


@query(oracle.q(oracle.VECTORS, "SELECT left_id, right_id, round(distance, 5) AS distance FROM pairs WHERE distance < 0.60"))
def pair_join(spark, sf):
    return themes.near_pairs(demo.vectors(spark, sf), 0.60).select("left_id", "right_id", F.round("distance", 5).alias("distance"))


@query(oracle.q(oracle.VECTORS + f", bins AS (SELECT unnest({list(themes.EDGES[:-1])}) AS low, unnest({list(themes.EDGES[1:])}) AS high)", "SELECT CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(distance) AS count FROM bins LEFT JOIN pairs ON distance >= low AND (distance < high OR high = 2.0 AND distance <= high) GROUP BY low, high"))
def distance_histogram(spark, sf):
    return themes.distance_histogram(demo.vectors(spark, sf)).select("low", "high", "count")


@query()
def cluster_units(spark, sf):
    got = themes.cluster_units(demo.vectors(spark, sf).drop("cluster"), 0.60)
    return got.select("unit_id", "cluster")


@query()
def cluster_sizes(spark, sf):
    """At the thresholds of the diagnostics, under which few of the given vectors meet, and at that of `theme_areas`, under which nearly all do."""
    got = themes.cluster_sizes(demo.vectors(spark, sf).drop("cluster"), (*themes.THRESHOLDS, 0.75))
    return got.select("threshold", "size", "count")


@query(oracle.q(oracle.VECTORS, "SELECT CAST(count(*) AS BIGINT) AS pairs FROM pairs"))
def pair_report(spark, sf):
    """Pairs that are compared and pairs that bounds skip are all pairs."""
    got = themes.pair_report(demo.vectors(spark, sf), 0.60)
    return got.select((F.col("pairs_compared") + F.col("pairs_skipped")).alias("pairs"))


_NAMED = """, sized AS (SELECT cluster, count(*) AS k, min(review_id) AS f FROM vectors GROUP BY cluster),
named AS (SELECT cluster, printf('theme_%02d', row_number() OVER (ORDER BY k DESC, f, cluster)) AS theme_id FROM sized WHERE k >= CASE WHEN (SELECT count(*) FROM vectors) < 15 THEN 2 ELSE 3 END),
themed AS (SELECT v.*, n.theme_id FROM vectors v LEFT JOIN named n USING (cluster))"""


@query(oracle.q(oracle.VECTORS + _NAMED, "SELECT unit_id, theme_id FROM themed"))
def theme_policy(spark, sf):
    return themes.theme_policy(demo.vectors(spark, sf)).select("unit_id", "theme_id")


@query(oracle.q(oracle.VECTORS + _NAMED + f""", per AS (SELECT theme_id, review_id, count(*) AS u, arg_min(rating, unit_id) AS r, max(created_at) AS newest, bool_or({oracle.RECENT}) AS rec FROM themed WHERE theme_id IS NOT NULL GROUP BY ALL),
got AS (SELECT theme_id, CAST(sum(u) AS BIGINT) AS unit_count, count(*) AS k, avg(r) AS mean_star_rating, max(newest) AS newest, count(*) FILTER (rec) AS nr, (SELECT count(DISTINCT review_id) FROM themed) AS n FROM per GROUP BY theme_id)""", f"SELECT theme_id, unit_count, k AS review_count, round(k::DOUBLE / n, 6) AS share, round({oracle.low('k', 'n')}, 6) AS low, round({oracle.high('k', 'n')}, 6) AS high, round(mean_star_rating, 6) AS mean_star_rating, strftime(newest, '%Y-%m-%d') AS newest, round(nr::DOUBLE / k, 6) AS share_last_12_months FROM got"))
def theme_stats(spark, sf):
    t = themes.theme_policy(demo.vectors(spark, sf))
    n = t.groupBy("app_id", "country").agg(F.countDistinct("review_id").alias("n_analysable"))
    got = themes.theme_stats(t, n, REFERENCE)
    return got.select("theme_id", "unit_count", "review_count", r6("share"), r6("ci95.low", "low"), r6("ci95.high", "high"), r6("mean_star_rating"), _day("newest"), r6("share_last_12_months"))


@query(oracle.q(oracle.VECTORS + _NAMED, "SELECT count(theme_id) AS units_clustered, count(*) AS units_total, round(count(theme_id)::DOUBLE / count(*), 6) AS unit_share, count(DISTINCT review_id) FILTER (theme_id IS NOT NULL) AS reviews_in_themes, coalesce(least(count(theme_id)::DOUBLE / count(*), count(DISTINCT review_id) FILTER (theme_id IS NOT NULL)::DOUBLE / count(DISTINCT review_id)) < 0.5, false) AS coverage_warning FROM themed"))
def theme_coverage(spark, sf):
    got = themes.theme_coverage(themes.theme_policy(demo.vectors(spark, sf)))
    return got.select("units_clustered", "units_total", r6("unit_share"), "reviews_in_themes", "coverage_warning")


@query(oracle.q(oracle.VECTORS + _NAMED + """, dims AS (SELECT theme_id, i, avg(embedding[i]::DOUBLE) AS x FROM themed, unnest(range(1, len(embedding) + 1)) AS t(i) WHERE theme_id IS NOT NULL GROUP BY ALL),
centres AS (SELECT theme_id, list(x ORDER BY i) AS c FROM dims GROUP BY theme_id),
far AS (SELECT t.theme_id, t.unit_id, t.review_id, t.sentence, 1 - list_dot_product(list_transform(t.embedding, lambda x: x::DOUBLE), c) / sqrt(list_dot_product(list_transform(t.embedding, lambda x: x::DOUBLE), list_transform(t.embedding, lambda x: x::DOUBLE)) * list_dot_product(c, c)) AS distance FROM themed t JOIN centres USING (theme_id))""",
    "SELECT theme_id, CAST(rank AS INTEGER) AS rank, unit_id, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY length(trim(sentence)) < 40, round(distance, 8), review_id, unit_id) AS rank FROM far) WHERE rank <= 3"))
def representatives(spark, sf):
    got = themes.representatives(themes.theme_policy(demo.vectors(spark, sf)))
    return got.select("theme_id", "rank", "unit_id", F.round("distance", 5).alias("distance"))


@query(oracle.q(oracle.VECTORS + ", strata AS (SELECT *, CASE WHEN distance < 0.35 THEN 0 WHEN distance < 0.5 THEN 1 ELSE 2 END AS stratum FROM pairs WHERE distance >= 0.2 AND distance < 0.65), drawn AS (SELECT * FROM strata QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || left_id || '|' || right_id), left_id || '|' || right_id) <= 15)",
    "SELECT CAST(stratum AS INTEGER) AS stratum, left_id, right_id, round(distance, 5) AS distance, count(*) OVER (PARTITION BY stratum) < 15 AS short FROM drawn"))
def pair_strata(spark, sf):
    return themes.pair_strata(themes.near_pairs(demo.vectors(spark, sf), 0.65)).select("stratum", "left_id", "right_id", F.round("distance", 5).alias("distance"), "short")


@query()
def embedded_themes(spark, sf):
    """Units to TF-IDF, a fitted decomposition, vectors, clusters, themes and their statistics, end to end."""
    u = stored(demo.turns(spark, sf))
    v = stored(embedding.transform(u, embedding.fit(u, rank=32)))
    t = stored(themes.theme_policy(themes.cluster_units(v, 0.40)))
    n = t.groupBy("app_id", "country").agg(F.countDistinct("review_id").alias("n_analysable"))
    got = themes.theme_stats(t, n, REFERENCE)
    return got.select("app_id", "theme_id", "unit_count", "review_count", r6("share"), r6("mean_star_rating"), _day("newest"))


@query()
def encoded_units(spark, sf):
    """Any encoder, loaded once a task: here one of letters' shares."""
    def load():
        import numpy as np

        return lambda texts: np.array([[t.lower().count(c) / max(len(t), 1) for c in "etaoinshrd"] for t in texts])

    got = embedding.embed(demo.turns(spark, sf).select("unit_id", "sentence"), load)
    return got.select("unit_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


# Insights and marts


def _bars(sql: str, label: str) -> str:
    return f"SELECT app_id, {label} AS label, share AS value, coalesce(low, share) AS low, coalesce(high, share) AS high, count FROM ({sql})"


def _areas(spark, sf):
    u, m = demo.matched(spark, sf)
    totals = units.complaint_totals(u)
    labels = categories.lexicon(spark, demo.LEXICON)
    cats = categories.category_stats(m, totals, REFERENCE, labels=labels)
    return insights.areas_of_improvement([insights.category_areas(cats, categories.evidence(m), labels)]), cats, labels, totals, u, m


@query(oracle.q(oracle.MATCHED, f"SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY historical, share DESC, upper(left(category_id, 1)) || category_id[2:]) AS INTEGER) AS rank, 'issue_category' AS source, upper(left(category_id, 1)) || category_id[2:] AS area, review_count AS count, denominator AS total, round(share, 6) AS share FROM stats"))
def areas_of_improvement(spark, sf):
    return _areas(spark, sf)[0].select("app_id", "rank", "source", "area", "count", "total", r6("share"))


_THEMED = oracle.MATCHED + f""", worded AS (SELECT *, string_split(lexical_text, ' ')[1] AS cluster FROM units),
heads AS (SELECT app_id, count(*) AS n FROM worded GROUP BY app_id),
sized AS (SELECT app_id, cluster, count(*) AS k, min(review_id) AS f, n FROM worded JOIN heads USING (app_id) GROUP BY ALL),
named AS (SELECT app_id, cluster, printf('theme_%02d', row_number() OVER (PARTITION BY app_id ORDER BY k DESC, f, cluster)) AS theme_id FROM sized WHERE n >= 5 AND k >= CASE WHEN n < 15 THEN 2 ELSE 3 END),
seen AS (SELECT app_id, cluster, count(DISTINCT review_id) AS review_count, count(DISTINCT review_id) FILTER ({oracle.RECENT}) AS nr FROM worded JOIN named USING (app_id, cluster) GROUP BY ALL),
areas AS (
  SELECT app_id, 'issue_category' AS source, upper(left(category_id, 1)) || category_id[2:] AS area, review_count AS count, denominator AS total, historical FROM stats
  UNION ALL SELECT app_id, 'theme', cluster, review_count, n_complaint_reviews, nr = 0 FROM seen JOIN complaint USING (app_id)
  UNION ALL SELECT app_id, 'phrase', phrase, support, n_negative, false FROM ({SQL['distinctive_phrases']}) JOIN (SELECT app_id, count(*) FILTER ({oracle.label('body', demo.NEGATIVE, demo.POSITIVE)} = 'negative') AS n_negative FROM light WHERE analysable GROUP BY app_id) USING (app_id) WHERE rank <= 3 AND app_id NOT IN (SELECT app_id FROM stats UNION SELECT app_id FROM seen)),
ranked AS (SELECT *, count::DOUBLE / total AS share FROM areas)"""


@query(oracle.q(_THEMED, "SELECT l.app_id, CASE WHEN r.area IS NULL THEN 'insufficient_signal' ELSE 'ok' END AS status, CAST(CASE WHEN r.area IS NOT NULL THEN row_number() OVER (PARTITION BY l.app_id ORDER BY CASE source WHEN 'issue_category' THEN 0 ELSE 1 END, historical, share DESC, area) END AS INTEGER) AS rank, source, area, count, total, round(share, 6) AS share FROM (SELECT DISTINCT app_id FROM light) l LEFT JOIN ranked r ON l.app_id = r.app_id"))
def all_areas(spark, sf):
    """Categories, themes (units by their first word) and, for apps that have neither, phrases, in one order, with each app's status."""
    _, cats, labels, _, u, m = _areas(spark, sf)
    t = stored(themes.theme_policy(u.withColumn("cluster", F.split("lexical_text", " ")[0])))
    of_themes = t.where("theme_id IS NOT NULL")
    names = of_themes.select("app_id", "country", "theme_id", F.lit(1).alias("rank"), F.col("cluster").alias("phrase")).distinct()
    shown = of_themes.groupBy("app_id", "country", "theme_id").agg(F.lit(1).alias("rank"), text.excerpt(F.min("sentence")).alias("excerpt"))
    r = demo.reviews(spark, sf)
    n = r.where("analysable").groupBy("app_id", "country").agg(F.count("*").alias("n_analysable"))
    first = stored(insights.category_areas(cats, categories.evidence(m), labels).unionByName(insights.theme_areas(themes.theme_stats(t, n, REFERENCE), names, shown)))
    # A group's phrases depend on its own reviews alone, so only those of groups that have no other area are counted.
    left = r.join(F.broadcast(first.select("app_id", "country").distinct()), ["app_id", "country"], "left_anti")
    areas = insights.areas_of_improvement([first, insights.phrase_areas(_distinctive(left), first, left)])
    status = insights.area_status(_light(spark, sf), areas)
    return status.join(areas, ["app_id", "country"], "left").select("app_id", "status", "rank", "source", "area", "count", "total", r6("share"))


def _percent(x: str) -> str:
    """A share as SQL says it, rounded half up at one digit."""
    return f"CAST(CAST(round(CAST(100 * ({x}) AS DECIMAL(18, 9)), 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%'"


_SHOWN = f"shown AS (SELECT app_id, category_id, {oracle.excerpt('sentence')} AS excerpt FROM matched QUALIFY row_number() OVER (PARTITION BY app_id, category_id ORDER BY len(phrases) DESC, created_at DESC NULLS LAST, review_id) = 1)"


@query(oracle.q(oracle.MATCHED + ", " + _SHOWN, f"""SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY historical, share DESC, category_id) AS INTEGER) AS rank,
  'Investigate ' || upper(left(category_id, 1)) || category_id[2:] || ': ' || review_count || ' of ' || denominator || ' complaint reviews (' || {_percent('share')} || ', 95% CI ' || {_percent(oracle.low('review_count', 'denominator'))}
  || '-' || {_percent(oracle.high('review_count', 'denominator'))} || '), for example ' || chr(39) || excerpt || chr(39) || '.' AS text FROM stats JOIN shown USING (app_id, category_id)"""))
def area_text(spark, sf):
    return _areas(spark, sf)[0].select("app_id", "rank", "text")


@query(oracle.q(oracle.MATCHED, f"SELECT app_id, upper(left(category_id, 1)) || category_id[2:] AS label, round(share, 6) AS value, round({oracle.low('review_count', 'denominator')}, 6) AS low, review_count AS count FROM stats"))
def mart_category_support(spark, sf):
    _, cats, labels, *_ = _areas(spark, sf)
    return insights.mart_category_support(cats, labels).select("app_id", "label", r6("value"), r6("low"), "count")


@query(oracle.q(oracle.MATCHED + ", sampled AS (SELECT app_id, count(*) AS n FROM light GROUP BY app_id), un AS (SELECT app_id, count(*) AS k FROM rest GROUP BY app_id)", "SELECT app_id, CAST(step AS INTEGER) AS step, count FROM (SELECT s.app_id, unnest([1, 2, 3]) AS step, unnest([n, coalesce(n_complaint_reviews, 0), greatest(0, coalesce(n_complaint_reviews, 0) - coalesce(k, 0))]) AS count FROM sampled s LEFT JOIN complaint USING (app_id) LEFT JOIN un USING (app_id))"))
def mart_funnel(spark, sf):
    _, _, _, totals, u, m = _areas(spark, sf)
    sampled = _light(spark, sf).groupBy("app_id", "country").agg(F.count("*").alias("n"))
    return insights.mart_funnel(sampled, totals, categories.uncategorised_summary(categories.uncategorised(u, m), totals)).select("app_id", "step", "count")


@query(_bars(SQL["rating_distribution"], "CAST(rating AS VARCHAR)"))
def mart_rating_distribution(spark, sf):
    got = insights.mart_distribution(ratings.distribution(_reachable(_light(spark, sf)), "rating", [1, 2, 3, 4, 5]), "rating")
    return got.select("app_id", "label", r6("value"), r6("low"), r6("high"), "count")


@query(_bars(SQL["sentiment_distribution"], "sentiment_label"))
def mart_sentiment_distribution(spark, sf):
    got = insights.mart_distribution(ratings.distribution(_reachable(demo.reviews(spark, sf).select("app_id", "country", "sentiment_label")), "sentiment_label", stats.LABELS), "sentiment_label")
    return got.select("app_id", "label", r6("value"), r6("low"), r6("high"), "count")


@query(f"SELECT app_id, bucket, label, mean AS value, n FROM ({SQL['period_metrics']})")
def mart_period_values(spark, sf):
    """What SQL can tell of mart_periods: all but the intervals."""
    return insights.mart_periods(ratings.period_metrics(_reachable(_light(spark, sf)))).select("app_id", "bucket", "label", r6("value"), "n")


@query()
def mart_periods(spark, sf):
    df = _reachable(_light(spark, sf))
    return insights.mart_periods(ratings.period_metrics(df), ratings.period_means(df)).select("app_id", "bucket", "label", r6("value"), r6("low"), r6("high"), "n")


@query(f"SELECT app_id, rank, phrase AS label, round(support::DOUBLE / n_negative, 6) AS value, support AS count FROM ({SQL['common_phrases']}) WHERE rank <= 12")
def mart_negative_phrases(spark, sf):
    r = demo.reviews(spark, sf)
    got = insights.mart_negative_phrases(phrases.common_phrases(phrases.phrase_counts(r, REFERENCE), phrases.totals(r), demo.BLOCKED))
    return got.select("app_id", "rank", "label", r6("value"), "count")


@query(oracle.q(oracle.MATCHED, f"""SELECT app_id, 1 AS tile, 'mean rating' AS label, CAST(CAST(round(CAST(avg(rating) AS DECIMAL(18, 9)), 2) AS DECIMAL(18, 2)) AS VARCHAR) AS value FROM light GROUP BY app_id
UNION ALL SELECT app_id, 2, 'negative reviews', CAST(CAST(round(CAST(100.0 * count(*) FILTER ({oracle.label('body', demo.NEGATIVE, demo.POSITIVE)} = 'negative') / count(*) AS DECIMAL(18, 9)), 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%' FROM light GROUP BY app_id
UNION ALL SELECT app_id, 3, 'reviews with complaints', CAST(n_complaint_reviews AS VARCHAR) FROM complaint WHERE n_complaint_reviews > 0
UNION ALL SELECT app_id, 4, 'first area', upper(left(category_id, 1)) || category_id[2:] FROM stats QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY historical, share DESC, category_id) = 1"""))
def mart_summary(spark, sf):
    areas, _, _, totals, _, _ = _areas(spark, sf)
    df = demo.reviews(spark, sf).select("app_id", "country", "rating", "sentiment_label")
    dist = ratings.distribution(_reachable(df), "sentiment_label", stats.LABELS)
    return insights.mart_summary(ratings.rating_summary(df), dist, totals, areas).select("app_id", "tile", "label", "value")


# Sources and sinks


@query("""WITH e AS (SELECT conv_id % 3 AS app_id, CAST(turn AS BIGINT) AS page, conv_id AS pos, 'r' || (conv_id % 40) AS id, CAST(conv_id % 5 + 1 AS INTEGER) AS rating FROM conversations),
once AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY app_id, id ORDER BY page, pos) = 1)
SELECT app_id, id AS source_review_id, rating, row_number() OVER (PARTITION BY app_id ORDER BY page, pos) - 1 AS rank FROM once""")
def feed_frame(spark, sf):
    """conversations as pages of a feed, read back."""
    return source.feed_frame(source.feed_entries(demo.feed_pages(spark, sf))).select("app_id", "source_review_id", "rating", "rank")


@query("""WITH e AS (SELECT conv_id % 3 AS app_id, CAST(turn AS BIGINT) * 1099511627776 + conv_id // 150 AS page, conv_id, 'r' || conv_id AS id, CAST(conv_id % 5 + 1 AS INTEGER) AS rating FROM conversations),
once AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY app_id, id ORDER BY page, conv_id) = 1),
ranked AS (SELECT app_id, id AS source_review_id, rating, row_number() OVER (PARTITION BY app_id ORDER BY page, conv_id) - 1 AS rank FROM once)
SELECT * FROM ranked WHERE rank < 2000000000""")
def feed_frame_whole(spark, sf):
    """Every conversation an entry of its own, so that the frame grows with the table; no limit on a feed's length."""
    return source.feed_frame(source.feed_entries(demo.feed_pages(spark, sf, None)), 2_000_000_000).select("app_id", "source_review_id", "rating", "rank")


@query(oracle.q(oracle.LIGHT, f"SELECT source_review_id, row_number() OVER (ORDER BY {PRIO.format(seed=7, id='source_review_id')}, source_review_id) AS position FROM light"))
def seeded_order_whole(spark, sf):
    """All reviews in one order: ranges of it are sorted apart."""
    return sampling.seeded_order(_light(spark, sf), 7, "source_review_id").select("source_review_id", "position")


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_review_id, CASE WHEN doc_id % 7 BETWEEN 1 AND 5 AND doc_id % 11 <> 0 THEN true ELSE false END AS valid, CAST(doc_id % 7 AS INTEGER) AS rating,
  CASE doc_id % 3 WHEN 0 THEN DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) END AS day, doc_id % 2 = 0 AS is_edited, doc_id % 4 = 0 AS has_developer_response, md5(trim(coalesce(text, ''))) AS digest,
  array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'missing_or_blank_body' END, CASE WHEN doc_id % 3 <> 0 THEN 'missing_or_unparseable_date' END], lambda x: x IS NOT NULL), ',') AS flags,
  3::BIGINT AS vote_count, NULL::BIGINT AS vote_sum, CASE WHEN doc_id % 4 = 0 THEN '7' END AS developer_response_id FROM documents""".replace("CAST(doc_id AS VARCHAR) AS source_review_id", "CASE WHEN doc_id % 11 = 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS source_review_id"))
def typed_review(spark, sf):
    d = demo.table(spark, sf, "documents")
    n = F.col("doc_id")
    raw = d.select(F.lit(1).alias("app_id"), F.lit("us").alias("country"), n.alias("rank"), F.when(n % 11 == 0, "").otherwise(n.cast("string")).alias("userReviewId"), F.lit("t").alias("title"), F.col("text").alias("body"), (n % 7).cast("string").alias("rating"), F.when(n % 3 == 0, F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int")).cast("string"), F.lit("T08:00:00Z"))).when(n % 3 == 1, "2024").otherwise("soon").alias("date"), F.when(n % 2 == 0, "true").otherwise("no").alias("isEdited"), F.lit("3").alias("voteCount"), F.lit("").alias("voteSum"), F.when(n % 4 == 0, '{"id": "7", "modified": "2024-02-03T00:00:00Z"}').otherwise("{}").alias("developerResponse"))
    return source.typed_reviews(raw).select("source_review_id", "valid", "rating", F.to_date("created_at").alias("day"), "is_edited", "has_developer_response", F.md5("body").alias("digest"), F.array_join("source_flags", ",").alias("flags"), "vote_count", "vote_sum", "developer_response_id")


@query(oracle.q(oracle.LIGHT, "SELECT source_review_id, rank, rating, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS created_at FROM light"))
def export_rows(spark, sf):
    got = sinks.export_rows(_light(spark, sf).withColumn("source_flags", F.array().cast("array<string>")))
    return got.select("source_review_id", "rank", "rating", "created_at")


@query(oracle.q(oracle.REVIEWS, f"""SELECT source_review_id, rank, country, '' AS title, md5(CASE WHEN regexp_matches(body, '^[=+\\-@\\t\\r\\n＝＋－＠]') THEN chr(9) || body ELSE body END) AS body, rating, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || 'Z' AS created_at,
  NULL::VARCHAR AS is_edited, NULL::VARCHAR AS vote_count, NULL::VARCHAR AS vote_sum, NULL::VARCHAR AS has_developer_response, NULL::VARCHAR AS app_version, NULL::VARCHAR AS provider, '["' || language || '"]' AS source_flags,
  md5(CASE WHEN regexp_matches(analysis_text, '^[=+\\-@\\t\\r\\n＝＋－＠]') THEN chr(9) || analysis_text ELSE analysis_text END) AS analysis_text, language, analysable, sentiment_label FROM reviews""".replace("\\\\", "\\")))
def export_analysed(spark, sf):
    """The analysed shape, all columns of the raw one among them, texts as digests."""
    r = demo.reviews(spark, sf).withColumn("source_flags", F.array("language"))
    got = sinks.export_rows(r, [c for c in sinks.ANALYSED if c not in ("class_scores", "flags")])
    return got.withColumns({c: F.md5(c) for c in ("body", "analysis_text")})


@query(r"""SELECT doc_id, CASE WHEN len(string_split_regex(trim(coalesce(text, '')), '\s+')) > 512 THEN 'truncated' ELSE '' END AS flags FROM documents""")
def scored_flags(spark, sf):
    """The flag that scoring adds."""
    scored = sentiment.lexicon_scorer(F.coalesce("text", F.lit("")))["truncated"]
    return demo.table(spark, sf, "documents").select("doc_id", F.array_join(text.scored_flags(F.array().cast("array<string>"), scored), ",").alias("flags"))


@query(oracle.q(oracle.LIGHT, "SELECT app_id, count(*) AS n, round(avg(rating), 6) AS mean, count(*) * 3 AS rating_count, 3.5::DOUBLE AS store_mean FROM light GROUP BY app_id"))
def store_benchmark(spark, sf):
    """Stores' own numbers beside the reviews'."""
    df = _light(spark, sf)
    f = demo.frames(df).join(df.groupBy("app_id", "country").agg((F.count("*") * 3).alias("rating_count"), F.lit(3.5).alias("store_mean")), ["app_id", "country"])
    return ratings.rating_summary(df, f).select("app_id", "n", r6("mean"), F.col("store_benchmark.rating_count").alias("rating_count"), F.col("store_benchmark.store_mean").alias("store_mean"))


_NAMED_APPS = "list_filter(string_split(e.phrase, ' '), lambda x: NOT list_contains([['ther'], ['this'], ['thes'], ['with'], ['ther']][e.app_id + 1], x) AND NOT list_contains({blocked}, x) AND regexp_matches(x, '\\p{{L}}'))".format(blocked=oracle.listed(demo.BLOCKED)).replace("\\\\", "\\")
_NAMED_ELIGIBLE = oracle.PHRASES + f", kept AS (SELECT * FROM eligible e WHERE len({_NAMED_APPS}) > 0)"


@query(oracle.q(_NAMED_ELIGIBLE, f"SELECT app_id, rank, phrase, support FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY support DESC, phrase) AS INTEGER) AS rank FROM kept e WHERE {_LONGER.format(t='kept')}) WHERE rank <= 15"))
def named_app_phrases(spark, sf):
    """Common phrases of apps whose own names are words of the texts: each app's name blocks for that app alone."""
    r = demo.reviews(spark, sf)
    apps = r.select("app_id", "country").distinct().withColumn("name", F.get(F.array(*[F.lit(x) for x in ("Ther", "This!", "THES", "with", "Ther ther")]), F.col("app_id").cast("int")))
    got = phrases.common_phrases(phrases.phrase_counts(r, REFERENCE), phrases.totals(r, apps=apps), demo.BLOCKED)
    return got.select("app_id", "rank", "phrase", "support")


# Small columns


@query(f"SELECT o_orderkey AS k, round({oracle.low('s', 'n')}, 9) AS low, round({oracle.high('s', 'n')}, 9) AS high FROM (SELECT o_orderkey, o_orderkey % 51 AS s, 50 AS n FROM orders)")
def wilson_interval(spark, sf):
    w = stats.wilson(F.col("k") % 51, F.lit(50))
    return demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).select("k", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


@query("SELECT event_id, CASE WHEN s <= 2 THEN 'negative' WHEN s = 3 THEN 'neutral' ELSE 'positive' END AS label, event_id % 2 = 0 AS same FROM (SELECT event_id, event_id % 5 + 1 AS s FROM events)")
def star_class(spark, sf):
    return demo.table(spark, sf, "events").select("event_id", stats.star_class(F.col("event_id") % 5 + 1).alias("label"), stats.same_issue(F.when(F.col("event_id") % 2 == 0, " Yes ").otherwise("different_issue")).alias("same"))


@query("SELECT event_id, CASE WHEN neg >= neu AND neg >= pos THEN 'negative' WHEN neu >= pos THEN 'neutral' ELSE 'positive' END AS label FROM (SELECT event_id, (event_id % 7 + event_id % 3) / 10.0 AS neg, (event_id % 5) / 10.0 AS neu, (event_id % 4 + event_id % 6) / 10.0 AS pos FROM events)")
def five_to_three(spark, sf):
    e = F.col("event_id")
    scores = F.array(*[(e % m) / F.lit(10.0) for m in (7, 3, 5, 4, 6)])
    return demo.table(spark, sf, "events").select("event_id", stats.three_classes(F.transform(scores, lambda x: F.round(x * 10).cast("int")))["label"].alias("label"))


# Sheets, audits and model comparison


@query(oracle.q(oracle.LIGHT, f"SELECT app_id, k AS successes, n, round(k::DOUBLE / n, 6) AS value, round({oracle.low('k', 'n')}, 6) AS low, round({oracle.high('k', 'n')}, 6) AS high FROM (SELECT app_id, count(*) FILTER (rating <= 2) AS k, count(*) AS n FROM light GROUP BY app_id)"))
def wilson_summary(spark, sf):
    n = _light(spark, sf).groupBy("app_id").agg(F.count_if(F.col("rating") <= 2).alias("k"), F.count("*").alias("n"))
    got = n.select("app_id", stats.wilson_summary(F.col("k"), F.col("n")).alias("w")).select("app_id", "w.*")
    return got.select("app_id", "successes", "n", r6("value"), r6("low"), r6("high"))


@query(oracle.q(oracle.LIGHT, "SELECT source_review_id AS review_id, md5(body) AS digest, '' AS human_label FROM light"))
def blind_sheet(spark, sf):
    got = sampling.blind_sheet(demo.reviews(spark, sf), "source_review_id", "body")
    return got.select(F.col("source_review_id").alias("review_id"), F.md5("body").alias("digest"), "human_label")


@query(oracle.q(oracle.LIGHT, f"SELECT source_review_id AS review_id, md5(body) AS digest, '' AS human_label FROM light QUALIFY row_number() OVER (ORDER BY {PRIO.format(seed=9, id='source_review_id')}, source_review_id) <= 30"))
def relabel_sample(spark, sf):
    got = sampling.relabel_sample(demo.reviews(spark, sf), 30, 9, "source_review_id", "body")
    return got.select(F.col("source_review_id").alias("review_id"), F.md5("body").alias("digest"), "human_label")


@query(oracle.q(oracle.LIGHT, f"SELECT source_review_id AS review_id, app_id, {oracle.STAR} AS human_label FROM light"))
def attach_labels(spark, sf):
    gold = _light(spark, sf).select(F.col("source_review_id").alias("review_id"), "app_id")
    labels = _light(spark, sf).select(F.col("source_review_id").alias("review_id"), stats.star_class(F.col("rating")).alias("human_label"))
    return evaluate.attach_labels(gold, labels).select("review_id", "app_id", "human_label")


@query(oracle.q(oracle.LIGHT + rf""",
labelled AS (SELECT source_review_id, {oracle.STAR} AS human_label, body FROM light),
chosen AS (SELECT * FROM labelled WHERE human_label = 'negative' UNION ALL SELECT * FROM (SELECT * FROM labelled WHERE human_label = 'positive' QUALIFY row_number() OVER (ORDER BY md5('3:' || source_review_id), source_review_id) <= 20)),
cut_ AS (SELECT source_review_id, human_label, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s FROM chosen)""",
    "SELECT source_review_id, human_label, CAST(i AS INTEGER) AS sentence_index, md5(s[i + 1]) AS digest FROM cut_, unnest(range(0, len(s))) AS t(i)"))
def unit_candidates(spark, sf):
    r = demo.reviews(spark, sf).select("source_review_id", stats.star_class(F.col("rating")).alias("human_label"), "analysis_text")
    return sampling.unit_candidates(r, 3).select("source_review_id", "human_label", "sentence_index", F.md5("sentence").alias("digest"))


@query(oracle.q(oracle.JUDGED, "SELECT count(*) AS n, round(avg(CASE WHEN true_ = shipping THEN 1 ELSE 0 END), 6) AS accuracy FROM judged WHERE true_ <> 'neutral'"))
def binary_reference(spark, sf):
    return evaluate.binary_reference(demo.judged(spark, sf).withColumn("predicted", F.col("shipping"))).select("n", r6("accuracy"))


@query(oracle.q(oracle.REVIEWS, f"SELECT source_review_id, {oracle.label('body', demo.NEGATIVE, demo.POSITIVE)} AS sentiment_label, length(body) > 4000 AS truncated FROM reviews WHERE analysable"))
def score_sentiment(spark, sf):
    """A model from outside, loaded once a task and given sorted batches: here one that looks for words."""
    def load():
        strip = ".,!?;:\"'()[]{}"

        def predict(texts):
            out = []
            for t in texts:
                words = {w.strip(strip) for w in t.strip().lower().split()}
                label = "negative" if words & set(demo.NEGATIVE) else "positive" if words & set(demo.POSITIVE) else "neutral"
                out.append((label, {label: 1.0}, len(t) > 4000))
            return out

        return predict

    r = demo.reviews(spark, sf).where("analysable").select("source_review_id", "analysis_text")
    return sentiment.score_sentiment(r, load).select("source_review_id", "sentiment_label", "truncated")


def _labelled(spark, sf):
    d = demo.table(spark, sf, "documents").join(demo.table(spark, sf, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return d.select("doc_id", text.lexical(F.coalesce("text", F.lit(""))).alias("lexical_text"), label.alias("label"))


@query()
def cross_fitted_metrics(spark, sf):
    """Labelled documents, each scored by a pipeline that was fitted without its fold: metrics with intervals."""
    got = stored(crossfit.cross_fitted(_labelled(spark, sf), 4).select(F.col("label").alias("true"), "predicted"))
    return evaluate.metric_bca_ci(got).select("metric", r6("value"), r6("low"), r6("high"), "reason")


@query()
def compare_models(spark, sf):
    shares = spark.range(1, 6).select(F.col("id").cast("int").alias("star"), (F.col("id") / 15.0).alias("share"))
    got = evaluate.compare_models(demo.judged(spark, sf), shares)
    return got.select("model", "metric", r6("value"), r6("low"), r6("high"), r6("reweighted_accuracy"), "switch")


_AUDIT = f"SELECT category, upper(left(category, 1)) || category[2:] AS label, precision, low, high, n FROM ({SQL['audit_precision']}) WHERE category <> 'overall'"


def _audited(spark, sf):
    m = demo.matched(spark, sf)[1]
    sheet = categories.audit_sheet(m).join(m.select("app_id", F.col("category_id").alias("category"), "review_id", "rating"), ["app_id", "category", "review_id"])
    return evaluate.audit_precision(sheet.withColumn("human_label", F.when(F.col("rating") <= 3, "correct").otherwise("incorrect")))


@query(f"SELECT CAST(row_number() OVER (ORDER BY precision DESC, n DESC, label) AS INTEGER) AS rank, category, label, precision AS value, low, high, n FROM ({_AUDIT})")
def mart_category_precision(spark, sf):
    got = insights.mart_category_precision(_audited(spark, sf), categories.lexicon(spark, demo.LEXICON))
    return got.select("rank", "category", "label", r6("value"), r6("low"), r6("high"), "n")


@query(f"SELECT category, precision, n FROM ({_AUDIT}) WHERE precision < 0.8")
def weak_categories(spark, sf):
    return insights.weak_categories(_audited(spark, sf)).select("category", r6("precision"), "n")


@query(oracle.q(oracle.MATCHED, "SELECT l.app_id, count(s.category_id) AS n_areas, CASE WHEN count(s.category_id) > 0 THEN 'ok' ELSE 'insufficient_signal' END AS status FROM (SELECT DISTINCT app_id FROM light) l LEFT JOIN stats s USING (app_id) GROUP BY l.app_id"))
def area_status(spark, sf):
    return insights.area_status(_light(spark, sf), _areas(spark, sf)[0]).select("app_id", "n_areas", "status")


@query()
def theme_areas(spark, sf):
    """Units to clusters, themes, their statistics, names and areas, end to end."""
    clustered = stored(themes.cluster_units(demo.vectors(spark, sf).drop("cluster"), 0.75).withColumn("lexical_text", text.lexical(F.col("sentence"))))
    t = themes.theme_policy(clustered)
    n = t.groupBy("app_id", "country").agg(F.countDistinct("review_id").alias("n_analysable"))
    named = phrases.group_phrases(t.where("theme_id IS NOT NULL"), "theme_id", demo.BLOCKED)
    areas = insights.theme_areas(themes.theme_stats(t, n, REFERENCE), named, themes.representatives(t))
    return insights.areas_of_improvement([areas]).select("app_id", "rank", "source", "area", "count", "total", r6("share"))


@query(oracle.q(oracle.PHRASES + ", positive AS (SELECT * FROM eligible WHERE z > 0), first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY round(z, 9) DESC, support DESC, phrase) AS i FROM positive e WHERE " + _LONGER.format(t="positive") + ") WHERE i <= 3)", "SELECT app_id, CAST(row_number() OVER (PARTITION BY app_id ORDER BY share_last_12_months = 0, support::DOUBLE / n_negative DESC, phrase) AS INTEGER) AS rank, 'phrase' AS source, phrase AS area, support AS count, n_negative AS total, round(support::DOUBLE / n_negative, 6) AS share FROM first"))
def phrase_areas(spark, sf):
    """Areas of groups that have neither categories nor themes: here of all, as the others are left out."""
    r = demo.reviews(spark, sf)
    found = _distinctive(r)
    areas = insights.phrase_areas(found, r.limit(0), r)
    return insights.areas_of_improvement([areas]).select("app_id", "rank", "source", "area", "count", "total", r6("share"))


# Sources and sinks, written and read back


@query("""SELECT CAST(doc_id AS VARCHAR) AS source_review_id, (doc_id // 50) * 50 + row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS rank, md5(trim(coalesce(text, ''))) AS digest, CAST(doc_id % 5 + 1 AS INTEGER) AS rating, doc_id % 4 = 0 AS has_developer_response, true AS valid FROM documents""")
def store_rows(spark, sf):
    """documents as pages of 50 store rows in JSON, personal fields among them, written to the shared folder and read back."""
    n = F.col("doc_id")
    row = F.struct(n.cast("string").alias("userReviewId"), F.lit("t").alias("title"), F.coalesce("text", F.lit("")).alias("body"), (n % 5 + 1).alias("rating"), F.lit("someone").alias("name"), F.when(n % 4 == 0, F.struct(F.lit("7").alias("id"), F.lit("hidden").alias("body"))).alias("developerResponse"))
    pages = demo.table(spark, sf, "documents").groupBy(F.floor(n / 50).alias("page")).agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), row.alias("r")))).alias("rows"))
    value = F.to_json(F.struct((F.col("page") * 50).alias("start"), F.lit("us").alias("country"), F.lit(1).alias("app_id"), F.transform("rows", lambda x: x["r"]).alias("userReviewList")))
    path = shared_folder(spark, "store")
    pages.select(value.alias("value")).write.text(path)
    return source.read_store_rows(spark, path).select("source_review_id", "rank", F.md5("body").alias("digest"), "rating", "has_developer_response", "valid")


_BROKEN = "CASE WHEN doc_id % 11 = 0 THEN '{\"source_review_id\": ' || doc_id WHEN doc_id % 13 = 0 THEN '{\"rating\": 3}' WHEN doc_id % 17 = 0 THEN '{\"source_review_id\":\"' || doc_id || '\",\"rating\":9}' END"


@query(f"""SELECT CASE WHEN b IS NULL THEN CAST(doc_id AS VARCHAR) ELSE md5(b) END AS key, CASE WHEN b IS NULL THEN CAST(doc_id % 5 + 1 AS INTEGER) END AS rating, CASE WHEN b IS NULL THEN md5(coalesce(text, '')) END AS digest,
  CASE WHEN doc_id % 11 = 0 THEN 'no review' WHEN doc_id % 13 = 0 THEN 'no id' WHEN doc_id % 17 = 0 THEN 'no stars from 1 to 5' END AS reason FROM (SELECT *, {_BROKEN} AS b FROM documents)""")
def read_population(spark, sf):
    """documents as lines of JSON, some broken, blank lines between them, written to the shared folder; good rows and rejects are read back in one."""
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("source_review_id"), (F.col("doc_id") % 5 + 1).alias("rating"), F.coalesce("text", F.lit("")).alias("body")))
    path = shared_folder(spark, "population")
    demo.table(spark, sf, "documents").select(F.concat(F.coalesce(F.expr(_BROKEN), good), F.when(F.col("doc_id") % 3 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    got = records.read_population(spark, path)
    fine = F.col("reason").isNull()
    return got.select(F.when(fine, F.col("source_review_id")).otherwise(F.md5("record")).alias("key"), F.when(fine, F.col("rating")).alias("rating"), F.when(fine, F.md5("body")).alias("digest"), "reason")


@query("""WITH d AS (SELECT *, doc_id // 2 AS k FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS i FROM d)
SELECT CAST(k AS VARCHAR) AS review_id, md5(coalesce(text, '')) AS digest, CASE WHEN doc_id % 7 = 0 THEN 'blank cell: human_label' WHEN i > 1 THEN 'repeated key' END AS reason FROM f WHERE length(coalesce(text, '')) > 0""")
def read_label_sheet(spark, sf):
    """documents as a label sheet: cells with quotes, commas and line ends, blank labels, each key twice. A row for each file would have its own header, so all rows go in one by their keys' order."""
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", F.floor(F.col("doc_id") / 2).cast("string"), cell, F.when(F.col("doc_id") % 7 == 0, " ").otherwise("x"))
    path = shared_folder(spark, "sheet")
    docs = demo.table(spark, sf, "documents").where("length(coalesce(text, '')) > 0")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").select(row.alias("value"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    dealt.select(F.when(F.col("m") == F.shiftleft(F.col("p").cast("long"), 33), F.concat(F.lit("\ufeffreview_id,text,human_label\n"), "value")).otherwise(F.col("value")).alias("value")).write.text(path)
    got = records.read_label_sheet(spark, path, "review_id string, text string, human_label string", ["human_label"], ["review_id"])
    return got.select("review_id", F.md5("text").alias("digest"), "reason")


@query("""SELECT conv_id % 7 AS app_id, 42::BIGINT AS seed, 'c' || conv_id || ':' || turn AS source_review_id, CAST(conv_id % 5 + 1 AS INTEGER) AS rating, md5(coalesce(text, '')) AS digest, DATE '2024-01-01' + CAST(conv_id % 300 AS INTEGER) AS day
  FROM conversations WHERE conv_id % 7 IN (2, 3) AND conv_id % 2 = 0""")
def read_snapshots(spark, sf):
    """conversations as recorded collections of seven apps and two seeds, written to the shared folder; of two apps and one seed the files are read back."""
    at = F.col("conv_id")
    review = F.struct(F.concat(F.lit("c"), at, F.lit(":"), "turn").alias("source_review_id"), F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("body"), (at % 5 + 1).alias("rating"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (at % 300).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'").alias("created_at"), F.lit("someone").alias("reviewer"))
    keyed = demo.table(spark, sf, "conversations").select((at % 7).alias("app_id"), F.lit("us").alias("country"), (42 + at % 2).cast("long").alias("seed"), F.lit(100).cast("long").alias("requested"), F.floor(at / 200).alias("part"), review.alias("review"))
    lists = keyed.groupBy(*snapshots.KEYS, "part").agg(F.collect_list("review").alias("reviews"))  # 200 ids a document
    document = F.to_json(F.struct(F.struct("app_id", "country").alias("app"), F.struct("seed", "requested").alias("sampling"), "reviews"))
    path = shared_folder(spark, "snapshots")
    snapshots.record(lists.withColumn("document", document), path)
    got = snapshots.read_snapshots(spark, path).where("app_id IN (2, 3) AND seed = 42")
    return got.select("app_id", "seed", "source_review_id", "rating", F.md5("body").alias("digest"), F.to_date("created_at").alias("day"))


@query(r'''SELECT CAST(page_id AS VARCHAR) AS source_review_id, page_id AS rank, md5(CASE WHEN regexp_matches(v, '^[=+\-@＝]') THEN chr(9) || v ELSE v END) AS digest FROM (SELECT page_id, list_element(['=', '+', '-', '@', '"', 'a,;', '＝'], CAST(page_id % 7 + 1 AS INTEGER)) || url AS v FROM pages)''')
def reviews_csv(spark, sf):
    """Addresses of pages behind what a spreadsheet could take for formulas, written as CSV to the shared folder and read back."""
    v = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", '"', "a,;", "＝")]), (F.col("page_id") % 7 + 1).cast("int")), F.col("url"))
    rows = demo.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source_review_id"), F.col("page_id").alias("rank"), v.alias("body"))
    path = shared_folder(spark, "csv")
    sinks.write_reviews_csv(rows, path, ("source_review_id", "rank", "body"))
    got = spark.read.schema("source_review_id string, rank long, body string").options(header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return got.select("source_review_id", "rank", F.md5("body").alias("digest"))


# Stored analyses


def _stored_analyses(spark, sf):
    """Analyses of the five apps with their reviews, written to the shared folder, as SQL table functions."""
    r = demo.reviews(spark, sf)
    df = r.select("app_id", "country", "source_review_id", "rating", "created_at", "language", "analysable", "sentiment_label")
    name = F.concat(F.lit("app "), F.col("app_id")).alias("analysis_id")
    numbers = df.groupBy("app_id").agg(F.struct(F.count("*").alias("n"), F.count_if("analysable").alias("n_analysable")).alias("preprocessing"), F.struct(F.count("*").alias("n"), F.avg("rating").alias("mean")).alias("metrics"), F.struct(F.count_if(F.col("sentiment_label") == "negative").alias("negative")).alias("sentiment"))
    areas = _areas(spark, sf)[0].groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "area", "count", "total"))).alias("areas"))  # as many as the lexicon has categories
    whole = numbers.join(areas, "app_id", "left").select(name, "preprocessing", "metrics", "sentiment", F.struct("areas").alias("insights"))
    path = shared_folder(spark, "analyses")
    placed = order.positions(df.withColumn("analysis_id", name), [F.col("source_review_id").cast("long")], ["analysis_id"])
    analyses.save(spark, stored(whole), placed, path)
    analyses.register(spark, path)


def _of_all_apps(spark, function, select):
    parts = [spark.sql(f"SELECT {select} FROM {function}('app {i}')") for i in range(5)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(oracle.q(oracle.REVIEWS, "SELECT 'app ' || app_id AS analysis_id, count(*) AS n, count(*) FILTER (analysable) AS n_analysable, round(avg(rating), 6) AS mean, count(*) FILTER (sentiment_label = 'negative') AS negative FROM reviews GROUP BY app_id"))
def metrics_view(spark, sf):
    _stored_analyses(spark, sf)
    return _of_all_apps(spark, "stored_metrics", "analysis_id, metrics.n, preprocessing.n_analysable, round(metrics.mean, 6) AS mean, sentiment.negative")


@query(f"SELECT 'app ' || app_id AS analysis_id, rank, area, count, total FROM ({SQL['areas_of_improvement']})")
def insights_view(spark, sf):
    _stored_analyses(spark, sf)
    return _of_all_apps(spark, "stored_insights", "analysis_id, inline(insights.areas)").select("analysis_id", "rank", "area", "count", "total")


@query(oracle.q(oracle.LIGHT, "SELECT 'app ' || app_id AS analysis_id, source_review_id, rating, row_number() OVER (PARTITION BY app_id ORDER BY rank) AS position FROM light"))
def get_analysis(spark, sf):
    """The reviews of each stored analysis, by position."""
    _stored_analyses(spark, sf)
    return _of_all_apps(spark, "stored_reviews", "analysis_id, source_review_id, rating, position")
