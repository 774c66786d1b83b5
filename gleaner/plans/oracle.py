"""SQL of the queries for DuckDB. Views are those of the given tables."""

from __future__ import annotations

from . import demo

Z = "1.959963984540054::DOUBLE"


def low(k: str, n: str) -> str:
    return f"(CASE WHEN {n} <= 0 THEN NULL WHEN {k} <= 0 THEN 0.0 ELSE greatest(0.0, {_centre(k, n)} - {_half(k, n)}) END)"


def high(k: str, n: str) -> str:
    return f"(CASE WHEN {n} <= 0 THEN NULL WHEN {k} >= {n} THEN 1.0 ELSE least(1.0, {_centre(k, n)} + {_half(k, n)}) END)"


def _centre(k: str, n: str) -> str:
    return f"(({k}::DOUBLE / {n} + {Z} * {Z} / (2 * {n})) / (1 + {Z} * {Z} / {n}))"


def _half(k: str, n: str) -> str:
    return f"({Z} * sqrt(({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) + {Z} * {Z} / (4 * {n})) / {n}) / (1 + {Z} * {Z} / {n}))"


def shrunk(end: str, k: str, n: str, pop: str, bound: str) -> str:
    p = f"({k}::DOUBLE / {n})"
    by = f"(CASE WHEN {pop} > 1 AND {n}::DOUBLE / {pop} > 0.05 THEN sqrt(greatest(0.0, ({pop} - {n})::DOUBLE / ({pop} - 1))) ELSE 1.0 END)"
    value = f"{p} - ({p} - {end}) * {by}"
    return f"(CASE WHEN {n} = 0 OR {n} = {pop} THEN NULL ELSE {'greatest(0.0' if bound == 'low' else 'least(1.0'}, {value}) END)"


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STRIPPED = r"""list_transform(string_split_regex(lower(trim({0})), '\s+'), lambda w: regexp_replace(w, '^[.,!?;:"''()\[\]{{}}]+|[.,!?;:"''()\[\]{{}}]+$', '', 'g'))"""


def label(text: str, negative, positive) -> str:
    s = STRIPPED.format(text)
    return f"CASE WHEN list_has_any({s}, {listed(negative)}) THEN 'negative' WHEN list_has_any({s}, {listed(positive)}) THEN 'positive' ELSE 'neutral' END"


LEXICAL = r"array_to_string(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), ' ')"
#: Reviews without what only texts tell.
LIGHT = f"""
light AS (
  SELECT d.doc_id % 5 AS app_id, 'us' AS country, CAST(d.doc_id AS VARCHAR) AS source_review_id, d.doc_id AS rank, coalesce(d.text, '') AS body,
    CAST(CASE WHEN l.toxic = 1 THEN 1 WHEN l.quality = 0 THEN 2 WHEN l.quality IS NOT NULL THEN d.doc_id % 3 + 3 ELSE d.doc_id % 5 + 1 END AS INTEGER) AS rating,
    CASE WHEN d.doc_id % 97 <> 0 THEN TIMESTAMP '{demo.REFERENCE}' - to_days(CAST(d.doc_id * 37 % 2500 AS INTEGER)) END AS created_at,
    d.lang AS language, d.lang = 'en' AS analysable
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
REVIEWS = LIGHT + f""",
reviews AS (SELECT *, body AS analysis_text, {LEXICAL.format('body')} AS lexical_text, {label('body', demo.NEGATIVE, demo.POSITIVE)} AS sentiment_label FROM light)"""
RECENT = f"coalesce(created_at >= TIMESTAMP '{demo.REFERENCE}' - INTERVAL 365 DAY, false)"
GRAMS = "list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))))"
PHRASES = REVIEWS + f""",
toks AS (SELECT app_id, country, source_review_id, rank, created_at, sentiment_label = 'negative' AS bad, {RECENT} AS recent, list_filter(string_split(lexical_text, ' '), lambda x: x <> '') AS w FROM reviews WHERE analysable),
grams AS (SELECT * EXCLUDE (w), unnest({GRAMS}) AS phrase FROM toks),
counts AS (
  SELECT app_id, country, phrase, count(*) FILTER (bad) AS support, count(*) FILTER (NOT bad) AS rest, arg_min(source_review_id, rank) FILTER (bad) AS example_review_id,
    max(created_at) FILTER (bad) AS newest, count(*) FILTER (bad AND recent) AS n_recent FROM grams GROUP BY ALL),
sizes AS (
  SELECT app_id, country, count(*) FILTER (bad) AS n_negative, count(*) FILTER (NOT bad) AS n_rest FROM toks GROUP BY ALL),
sums AS (SELECT app_id, country, sum(support) AS ng, sum(rest) AS nr FROM counts GROUP BY ALL),
prior AS (SELECT c.*, ng, nr, 100.0::DOUBLE * (support + rest) / (ng + nr) AS a FROM counts c JOIN sums USING (app_id, country)),
words AS (
  SELECT *, (ln((support + a) / (ng + 100 - support - a)) - ln((rest + a) / (nr + 100 - rest - a))) / sqrt(1 / (support + a) + 1 / (rest + a)) AS z
  FROM prior WHERE ng > 0 AND ng + 100 - support - a > 0 AND nr + 100 - rest - a > 0),
eligible AS (
  SELECT w.*, n_negative, n_rest, n_recent::DOUBLE / support AS share_last_12_months FROM words w JOIN sizes USING (app_id, country)
  WHERE n_negative >= 5 AND support >= CASE WHEN n_negative >= 30 THEN 3 ELSE 2 END
    AND len(list_filter(string_split(phrase, ' '), lambda x: NOT list_contains({listed(demo.BLOCKED)}, x) AND regexp_matches(x, '\\p{{L}}'))) > 0)""".replace("\\\\p", "\\p")
SENTENCES = LIGHT + r""",
cuts AS (
  SELECT app_id, country, source_review_id AS review_id, rating, created_at, list_filter(list_transform(string_split(regexp_replace(body, '([.!?])[\s\p{Z}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s
  FROM light WHERE analysable),
sentences AS (
  SELECT app_id, country, review_id, rating, created_at, unnest(s) AS sentence, unnest(range(0, len(s))) AS sentence_index FROM cuts)"""
UNITS = SENTENCES + f""",
labelled AS (SELECT *, review_id || ':s' || sentence_index AS unit_id, {label('sentence', demo.UNIT_NEGATIVE, demo.UNIT_POSITIVE)} AS label FROM sentences),
scored AS (SELECT *, round(CASE WHEN label = 'negative' THEN 0.4 + (length(sentence) % 60) / 100.0 ELSE 0.05 END, 2)::DOUBLE AS negative_score FROM labelled),
units AS (SELECT *, {LEXICAL.format('sentence')} AS lexical_text FROM scored WHERE label = 'negative' AND negative_score >= CASE WHEN rating >= 4 THEN 0.85 ELSE 0.50 END)"""
MATCHED = UNITS + f""",
lexicon(category_id, label, phrase) AS (VALUES {', '.join(f"('{c}', '{l}', '{p.strip()}')" for c, l, ps in demo.LEXICON for p in ps.split(','))}),
tokens AS (SELECT unit_id, list_filter(string_split(lexical_text, ' '), lambda x: x <> '') AS w FROM units),
starts AS (SELECT unit_id, w, unnest(range(1, len(w) + 1)) AS i FROM tokens),
marked AS (SELECT unit_id, i, len(w) AS n, CASE WHEN list_contains({listed(demo.GUARDED)}, w[i]) AND (list_contains({listed(demo.GUARDS)}, w[i - 1]) OR i > 2 AND list_contains({listed(demo.GUARDS)}, w[i - 2])) AND i > 1 THEN chr(0) ELSE w[i] END AS w FROM starts),
guarded AS (SELECT unit_id, list(w ORDER BY i) AS w FROM marked GROUP BY unit_id),
places AS (SELECT unit_id, w, unnest(range(1, len(w) + 1)) AS i FROM guarded),
hits AS (SELECT DISTINCT unit_id, category_id, phrase FROM places, lexicon WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
per_unit AS (SELECT unit_id, category_id, list_sort(list(phrase)) AS found FROM hits GROUP BY ALL),
rows_ AS (SELECT u.*, p.category_id, p.found, row_number() OVER (PARTITION BY app_id, country, category_id, review_id ORDER BY len(found) DESC, negative_score DESC, unit_id) AS best FROM per_unit p JOIN units u USING (unit_id)),
matched AS (
  SELECT app_id, country, category_id, review_id, list_sort(list_distinct(flatten(list(found)))) AS phrases, max(unit_id) FILTER (best = 1) AS unit_id, max(sentence) FILTER (best = 1) AS sentence,
    any_value(found) FILTER (best = 1) AS best_found, any_value(rating) AS rating, max(created_at) AS created_at FROM rows_ GROUP BY ALL),
complaint AS (SELECT app_id, country, count(*) AS n_units, count(DISTINCT review_id) AS n_complaint_reviews FROM units GROUP BY ALL),
cats AS (
  SELECT app_id, country, category_id, count(*) AS review_count, avg(rating) AS mean_star_rating, max(created_at) AS newest, count(*) FILTER ({RECENT}) AS n_recent FROM matched GROUP BY ALL HAVING count(*) >= 2),
stats AS (SELECT c.*, n_complaint_reviews AS denominator, review_count::DOUBLE / n_complaint_reviews AS share, n_recent::DOUBLE / review_count AS share_last_12_months, n_recent = 0 AS historical FROM cats c JOIN complaint USING (app_id, country)),
covered AS (SELECT DISTINCT app_id, country, review_id FROM matched JOIN cats USING (app_id, country, category_id)),
rest AS (SELECT app_id, country, review_id, arg_min(unit_id, (-negative_score, unit_id)) AS unit_id, arg_min(sentence, (-negative_score, unit_id)) AS sentence, max(created_at) AS created_at FROM units u
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.app_id = u.app_id AND c.review_id = u.review_id) GROUP BY ALL)"""
STAR = "CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END"
JUDGED = REVIEWS + f""",
judged AS (SELECT source_review_id, rating AS star, {STAR} AS true_, sentiment_label AS shipping, {label('analysis_text', ('thes',), ('than',))} AS challenger FROM reviews),
labels3(label) AS (VALUES ('negative'), ('neutral'), ('positive'))"""
VECTORS = f"""
vectors AS (
  SELECT 1 AS app_id, 'us' AS country, vec_id AS unit_id, CAST(floor(vec_id / 2) AS BIGINT) AS review_id, label AS cluster, CAST(vec_id % 5 + 1 AS INTEGER) AS rating, embedding,
    CASE WHEN vec_id % 13 <> 0 THEN TIMESTAMP '{demo.REFERENCE}' - to_days(CAST(vec_id * 53 % 1200 AS INTEGER)) END AS created_at,
    'sentence number ' || vec_id || CASE WHEN vec_id % 3 = 0 THEN ' of a text that is long enough' ELSE '' END AS sentence
  FROM embeddings WHERE embedding IS NOT NULL),
plain AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM vectors),
unit AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM plain),
pairs AS (SELECT a.unit_id AS left_id, b.unit_id AS right_id, a.app_id, a.country, greatest(0.0, 1 - list_dot_product(a.u, b.u)) AS distance, a.cluster = b.cluster AS same FROM unit a JOIN unit b ON a.unit_id < b.unit_id)"""


def excerpt(c: str) -> str:
    return f"CASE WHEN length(trim({c})) > 300 THEN rtrim(left(trim({c}), 297)) || '...' ELSE trim({c}) END"


def q(base: str, select: str) -> str:
    return f"WITH {base.strip()}\n{select}"


def _hex(text: str, start: int, n: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {start}, {n}) AS BIGINT)"


#: Every replicate ranks all rows by a window; see `sketches` for the ranks.
COVERAGE = q(LIGHT + f""",
known AS (SELECT app_id, rating, {_hex("'42:' || source_review_id", 1, 8)} % 2147483647 AS x, {_hex("'42:' || source_review_id", 9, 7)} * 8 + rating AS low FROM light),
totals AS (SELECT app_id, count(*) AS population, {', '.join(f'avg(CASE WHEN rating = {i} THEN 1.0 ELSE 0.0 END) AS t{i}' for i in range(1, 6))} FROM known GROUP BY app_id),
reps AS (SELECT r, 1 + {_hex("'42:a:' || r", 1, 8)} % 2147483646 AS a, {_hex("'42:b:' || r", 1, 8)} % 2147483647 AS b FROM range(1000) AS t(r)),
drawn AS (SELECT app_id, r, rating FROM known CROSS JOIN reps QUALIFY row_number() OVER (PARTITION BY app_id, r ORDER BY ((a * x + b) % 2147483647) * 4294967296 + low) <= 100),
counts AS (SELECT app_id, r, count(*) AS n, {', '.join(f'count(*) FILTER (rating = {i}) AS k{i}' for i in range(1, 6))} FROM drawn GROUP BY ALL),
stars AS (SELECT app_id, r, n, population, s AS rating, [k1, k2, k3, k4, k5][s] AS k, [t1, t2, t3, t4, t5][s] AS true_ FROM counts JOIN totals USING (app_id), range(1, 6) AS u(s)),
ends AS (SELECT *, {shrunk(low('k', 'n'), 'k', 'n', 'population', 'low')} AS lo, {shrunk(high('k', 'n'), 'k', 'n', 'population', 'high')} AS hi FROM stars)""",
    "SELECT app_id, CAST(rating AS INTEGER) AS rating, count(lo) AS evaluable, count(*) FILTER (true_ BETWEEN lo AND hi) AS covered, round(avg(CASE WHEN lo IS NOT NULL THEN CASE WHEN true_ BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END END), 6) AS rate FROM ends GROUP BY ALL")
