"""Whole results of operators that only parts were compared of: edited counts, features of stored media, reliabilities."""

import hashlib
import math
import random
import statistics

import pytest

from gleaner.llm import counting, media, pii, tokens
from test_llm_operators import DOCS, corpus


@pytest.fixture(scope="module")
def docs(spark):
    more = [(800, "x" * 50_000, "en", None, None), (801, "a b " * 9000, "en", None, None), (801, "a b " * 9000, "en", None, None), (802, "same same same", "en", None, None)]
    return spark.createDataFrame(corpus() + more, DOCS).select("doc_id", "text").repartition(3)


def after(text, edits):
    for e in edits:
        start = min(max(e["start"] or 0, 0), len(text))
        stop = min(max(e["stop"] or 0, start), len(text))
        text = text[:start] + (e["text"] or "") + text[stop:]
    return text


def test_every_count_of_edited_documents(docs):
    """Trees with and without copies, very long texts, and a second round of edits on the trees that the first has kept."""
    encoder = tokens.Encoder(tokens.default_tokenizer())
    count = lambda t: len(encoder.exactly([t])[0]) if t else 0
    first = counting.with_edits(counting.with_leaves(docs)).cache()
    wanted = {}
    for r in first.collect():
        wanted.setdefault((r["doc_id"], r["text"]), (count(r["text"]), after(r["text"] or "", r["edits"])))
    ends = sorted((str(i), n, count(t), len(t)) for (i, _), (n, t) in wanted.items())
    got = counting.edited(first).collect()
    assert sorted({(str(r["doc_id"]), r["tokens_before"], r["tokens_after"], r["chars_after"]) for r in got}) == sorted(set(ends)) and len(got) == docs.count()
    kept = counting.edited(first, keep=True).cache()
    assert {(r["doc_id"], r["text"] or "") for r in kept.collect()} == {(i, t) for (i, _), (_, t) in wanted.items()}
    again = counting.with_edits(kept.select("doc_id", "text", "leaves"), edits=2).cache()
    assert all(sum(x["chars"] for x in r["leaves"]) == len(r["text"] or "") and sum(x["tokens"] for x in r["leaves"]) == count(r["text"]) for r in again.collect())
    told = {(r["doc_id"], count(after(r["text"] or "", r["edits"]))) for r in again.collect()}
    assert {(r["doc_id"], r["tokens_after"]) for r in counting.edited(again).collect()} == told
    with pytest.raises(ValueError, match="edits"):
        counting.with_edits(again)


def test_features_of_stored_media(docs):
    stored = docs.select(media.padded(docs["text"]).alias("p")).selectExpr("sha2(p, 256) AS digest", "p")
    got = {r["digest"]: r for r in media.read_features(stored.select("digest", media.as_image(stored["p"]).alias("media"))).collect()}
    seen = set()
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        one = got[hashlib.sha256(payload).hexdigest()]
        seen.add(one["digest"])
        high = len(payload) // 64
        image = f"P5\n64 {high}\n255\n".encode() + payload
        assert (one["media_bytes"], one["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        columns = [statistics.fmean(payload[k::64]) for k in range(64)]
        said = dict(x.split("=") for x in one["feature"].split(" ")[1:])
        assert one["feature"].startswith(f"64x{high} ")
        assert float(said["mean"]) == pytest.approx(statistics.fmean(payload), abs=1e-4) and float(said["std"]) == pytest.approx(statistics.pstdev(payload), abs=1e-4)
        bits, middle = int(said["ahash"], 16), statistics.fmean(columns)
        assert all((bits >> (63 - k) & 1 == 1) == (c > middle) for k, c in enumerate(columns) if abs(c - middle) > 1e-9)
    assert seen == set(got)


def test_reliabilities_equal_a_plain_loop_over_spans():
    """Expectation-maximisation over counted patterns is that over single spans."""
    rng = random.Random(5)
    spans = []
    for _ in range(400):
        true = rng.random() < 0.3
        spans.append({a: rng.choices([1, 0, -1], [7, 2, 1] if true else [2, 3, 5])[0] for a in pii.LABELERS})
    counted = {}
    for s in spans:
        counted[tuple(s.items())] = counted.get(tuple(s.items()), 0) + 1
    prior, chance = pii.reliabilities([dict(k) | {"n": n} for k, n in counted.items()], rounds=40)
    p, c = 0.5, {a: {1: (0.7, 0.2), 0: (0.2, 0.3), -1: (0.1, 0.5)} for a in pii.LABELERS}
    for _ in range(40):
        post = []
        for s in spans:
            yes, no = p, 1 - p
            for a in pii.LABELERS:
                yes, no = yes * c[a][s[a]][0], no * c[a][s[a]][1]
            post.append(yes / (yes + no))
        t, n = math.fsum(post), len(spans)
        c = {a: {v: ((sum(x for x, s in zip(post, spans, strict=True) if s[a] == v) + 1) / (t + 3), (sum(1 - x for x, s in zip(post, spans, strict=True) if s[a] == v) + 1) / (n - t + 3)) for v in (1, 0, -1)} for a in pii.LABELERS}
        p = (t + 1) / (n + 2)
    assert prior == pytest.approx(p, abs=1e-3)
    assert all(x == pytest.approx(y, abs=2e-3) for a in pii.LABELERS for v in (1, 0, -1) for x, y in zip(chance[a][v], c[a][v], strict=True))
