"""Personal data by weak supervision, with DataFrame functions only.

Base patterns (email, ip, card, phone) keep every match that passes their checks. Beyond them, candidates are matches that
failed a check and those of wider patterns: secrets behind a cue, local telephone numbers, titled names. Labelers vote
on every span, base or not: its format (regex), word lists on the span (gazetteer), cues before it and what stands at its
edges (context), each 1 for, -1 against, 0 for no vote. Expectation-maximisation over the counts of vote patterns, a
few hundred rows whatever the corpus, estimates each labeler's reliability. With the resulting posteriors a log-linear span
classifier is trained on kind, length, cue and edge; a candidate it gives 0.5 or more becomes a span. Base spans stay; a
candidate that overlaps one, or an earlier candidate, does not become one.

Positions are code points, ends exclusive. Null or empty text: no spans. Repeated rows: each gives its spans. Very long texts are searched whole. Empty table:
no rows. No candidates: no training, base spans only. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. A match of email or ip starts where a run of its first characters does, or where the last match ended:
#: saying so, and not giving back what a run has taken, finds the same matches in one pass over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "secret": r"(?i)\b(?:token|password|passwd|secret|api[_-]?key)\x20?[=:]\x20?\x22?[A-Za-z0-9_+/-]{8,}+",
    "local": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++",
}
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]?)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]?)){3}$"
LABELERS = ("format", "gazetteer", "cue", "edge")
CUE = r"(?i)(?:token|password|secret|key|mail|e-mail|tel|phone|call|fax|card|visa|iban|account|ip|host|dear|contact)[\x20:=.\x22]*$"
LISTED = r"(?i)(?:@(?:mail[0-9]*|gmail|yahoo|outlook|hotmail|post)\.|\b(?:token|password|passwd|secret|api[_-]?key)\b|\b555[\x20-]|^(?:4|5[1-5]|3[47])[0-9\x20-]{11,}|^(?:10|127|192\.168)\.|^(?:Mr|Mrs|Ms|Dr|Prof)\b)"
FEATURES = ("kind", "length", "cue", "edge")


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern, leftmost and apart, as structs start, kind, end, said; linear but for the copying of references."""
    said, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.arrays_zip(between.alias("gap"), said.alias("said"))
    empty = F.array().cast("array<struct<start:int,kind:string,end:int,said:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["said"]), F.lit(0))
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["said"].alias("said"))
        return F.struct(end.alias("at"), F.when(x["said"].isNotNull(), F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(x: Column) -> Column:
    """Whether a match holds as base span of its kind."""
    digits = F.regexp_replace(x["said"], "[^0-9]", "")
    n = F.length(digits)
    card = F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(x["kind"] == "email", F.lit(True)).when(x["kind"] == "ip", x["said"].rlike(OCTETS)).when(x["kind"] == "card", card).when(x["kind"] == "phone", n.between(9, 15)).otherwise(F.lit(False))


def spans(docs: DataFrame, *kept: str) -> DataFrame:
    """Columns `kept` and found (structs start, kind, end, base, votes, features; base tells base spans) of each document."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,kind:string,end:int,said:string>>")
    digit, at = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    only = {"email": at, "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")), "local": digit}
    docs = docs.select(*kept, F.col("text").alias("_text"))
    found = docs.select(*kept, text.alias("_text")).withColumns({f"_{k}": F.when(only[k], matches(text, p, k)).otherwise(none) if k in only else F.when(text.rlike(p), matches(text, p, k)).otherwise(none) for k, p in (BASE | WIDER).items()})
    every = F.concat(*[F.col(f"_{k}") for k in (*BASE, *WIDER)])

    def judged(x: Column) -> Column:
        before = F.substring("_text", F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
        around = F.concat(F.when(x["start"] > 0, F.substring("_text", F.greatest(x["start"], F.lit(1)), F.lit(1))).otherwise(F.lit(" ")), F.substring("_text", x["end"] + 1, F.lit(1)))
        good, size = passes(x), x["end"] - x["start"]
        digits = F.length(F.regexp_replace(x["said"], "[^0-9]", ""))
        strict = F.when(x["kind"] == "secret", size >= 24).when(x["kind"] == "local", digits == 10).when(x["kind"] == "name", size >= 6).otherwise(good)
        form = F.when(strict, 1).when(x["kind"].isin("secret", "name"), 0).otherwise(-1)
        listed = F.when(x["said"].rlike(LISTED), 1).otherwise(0)
        cue = F.when(before.rlike(CUE), 1).when(before.rlike(r"(?i)(?:version|page|no\.|nr\.|\$|#)[\x20]*$"), -1).otherwise(0)
        edge = F.when(around.rlike(r"[\p{L}\p{N}_]"), -1).otherwise(1)
        length = F.when(size < 8, "short").when(size < 16, "middle").when(size < 32, "long").otherwise("longest")
        votes = [form.alias("format"), listed.alias("gazetteer"), cue.alias("cue"), edge.alias("edge")]
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), good.alias("base"), F.struct(*votes).alias("votes"), F.struct(F.concat_ws(":", x["kind"], F.when(good, "passed").otherwise("wider")).alias("kind"), length.alias("length"), cue.cast("string").alias("cue"), edge.cast("string").alias("edge")).alias("features"))

    return found.select(*kept, F.transform(every, judged).alias("found"))


def reliabilities(patterns: list[dict], rounds: int = 100) -> tuple[float, dict[str, dict[int, tuple[float, float]]]]:
    """Prior and, by labeler and vote, the chances of that vote on true and on false spans, by expectation-maximisation.

    `patterns`: by labeler a vote, and n, for each pattern of votes: 3 ** labelers at most, so rounds are plain arithmetic.
    """
    prior, chance = 0.5, {a: {1: (0.7, 0.2), 0: (0.2, 0.3), -1: (0.1, 0.5)} for a in LABELERS}
    n = sum(x["n"] for x in patterns)
    if not n:
        return prior, chance
    for _ in range(rounds):
        odds = [math.log(prior / (1 - prior)) + sum(math.log(chance[a][x[a]][0] / chance[a][x[a]][1]) for a in LABELERS) for x in patterns]
        post = [1 / (1 + math.exp(-o)) for o in odds]
        true = sum(x["n"] * p for x, p in zip(patterns, post, strict=True))
        after = {}
        for a in LABELERS:
            of = {v: [(x["n"] * p, x["n"] * (1 - p)) for x, p in zip(patterns, post, strict=True) if x[a] == v] for v in (1, 0, -1)}
            after[a] = {v: ((sum(t for t, _ in c) + 1) / (true + 3), (sum(f for _, f in c) + 1) / (n - true + 3)) for v, c in of.items()}
        moved = max(abs(x - y) for a in LABELERS for v in (1, 0, -1) for x, y in zip(after[a][v], chance[a][v], strict=True))
        prior, chance = (true + 1) / (n + 2), after
        if moved < 1e-5:
            break
    return prior, chance


def posterior(prior: float, chance: dict[str, dict[int, tuple[float, float]]], votes: dict[str, Column]) -> Column:
    """The chance that a span is true, given its votes."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for a, column in votes.items():
        odds = odds + reduce(lambda c, v: c.when(column == v, math.log(chance[a][v][0] / chance[a][v][1])), (0, -1), F.when(column == 1, math.log(chance[a][1][0] / chance[a][1][1])))
    return 1 / (1 + F.exp(-odds))


def train(judged: DataFrame) -> tuple[float, dict[tuple[str, str], float]]:
    """Bias and weights, by feature and value, of the span classifier, from the posteriors of all spans of `judged`."""
    each = judged.select(F.explode("found").alias("x"))
    # 81 rows at most: three votes of four labelers.
    patterns = each.groupBy(*[F.col(f"x.votes.{a}").alias(a) for a in LABELERS]).agg(F.count("*").alias("n")).collect()
    prior, chance = reliabilities([r.asDict() for r in patterns])
    p = posterior(prior, chance, {a: F.col(f"x.votes.{a}") for a in LABELERS})
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"x.features.{f}").alias("value")) for f in FEATURES]))
    # Sums by feature value, at most some twenty rows.
    sums = each.select(pairs.alias("f"), p.alias("p")).groupBy("f").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("u")).collect()
    n = sum(r["t"] + r["u"] for r in sums if r["f"]["feature"] == "kind")
    if not n:
        return 0.0, {}
    true = sum(r["t"] for r in sums if r["f"]["feature"] == "kind")
    bias = math.log((true + 1) / (n - true + 1))
    return bias, {(r["f"]["feature"], r["f"]["value"]): math.log((r["t"] + 1) / (true + 2)) - math.log((r["u"] + 1) / (n - true + 2)) for r in sums}


def _text_of(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def settled(judged: DataFrame, bias: float, weights: dict[tuple[str, str], float]) -> DataFrame:
    """`judged` with base and spans (structs start, place, kind, end; by start, then kind as listed) in place of found."""
    kept = [c for c in judged.columns if c != "found"]

    def score(x: Column) -> Column:
        odds = F.lit(bias)
        for (feature, value), w in sorted(weights.items()):
            odds = odds + F.when(x["features"][feature] == value, w).otherwise(0.0)
        return odds

    place = lambda k: reduce(lambda c, i: c.when(k == [*BASE, *WIDER][i], i), range(1, len(BASE) + len(WIDER)), F.when(k == KINDS[0], 0))
    plain = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(x["start"].alias("start"), place(x["kind"]).alias("place"), x["kind"].alias("kind"), x["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    base = plain(F.filter("found", lambda x: x["base"]))
    more = plain(F.filter("found", lambda x: ~x["base"] & (score(x) >= 0))) if weights else none
    # Of overlapping candidates the first stays; they are in order, so the end so far decides.
    apart = F.aggregate(
        F.filter(F.col("more"), lambda x: ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s),
    )["out"]
    return judged.select(*kept, base.alias("base"), more.alias("more")).select(*kept, "base", F.sort_array(F.concat("base", apart)).alias("spans"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of each row of `docs` (doc_id, text)."""
    judged = written(spans(docs, "doc_id"), "spans")
    return settled(judged, *train(judged))


def redacted(text: Column, spans_: Column) -> Column:
    """The text with each span, in order and apart, replaced by its kind in brackets; overlapping parts go once."""
    state = F.aggregate(
        spans_,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(x["end"].alias("at"), F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out")),
        ).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
    )
    return F.when(F.size(spans_) > 0, F.concat(F.array_join(state["out"], ""), F.substring(text, state["at"] + 1, F.length(text)))).otherwise(text)


def without_spans(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with the spans of their texts redacted; null texts stay null."""
    # Whole rows are carried along in one column, whatever their columns' names, and what is found is computed once.
    judged = written(spans(docs.select("text", F.struct(*docs.columns).alias("_row")), "_row"), "spans")
    found = settled(judged, *train(judged))
    return found.select(*[redacted(F.col("_row.text"), F.col("spans")).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))
