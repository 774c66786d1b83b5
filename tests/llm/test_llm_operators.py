"""The training-data operators against brute force, on small tables that hold the awkward cases."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import common, components, counting, jaccard, katz, media, mixing, packing, pii, tokens, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(n=60, seed=1):
    """Copies, near copies, passages that many share, long, blank and null texts, a hot source, null ids, a repeated row."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeABé") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(80)]
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "  \n", "one two", "One TWO", " ".join(base), " ".join(base), passage]
    for _ in range(n):
        kind = rng.random()
        own = [word() for _ in range(rng.randint(1, 120))]
        if kind < 0.35:
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
        elif kind < 0.6:
            own.insert(rng.randrange(len(own)), passage)
        texts.append(" ".join(own))
    texts.append(" ".join(word() for _ in range(6000)))
    rows = [(i, t, "en", rng.choice(["hot", "hot", "a", "b", None]), None) for i, t in enumerate(texts)]
    return [*rows, (3, "one two", "en", "hot", None), (None, "no id at all here", "en", None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens_of(text):
    return WORD.findall((text or "").translate(LOWER))


def test_words_equal_regex_on_slices():
    texts = [t for _, t, *_ in corpus(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    seen = []
    for part in common.slices(batch, "text", 2000):
        ends, codes, words = common.word_codes(common.texts_of(part, "text"))
        words = words.to_pylist()
        seen += [[words[c] for c in codes[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert seen == [tokens_of(t) for t in texts]


# 1


def test_media_round_trip(spark, docs, rows):
    media_table = docs.select(media.padded(docs["text"]).alias("p")).selectExpr("sha2(p, 256) AS digest", "p")
    stored = media_table.select("digest", media.as_image(media_table["p"]).alias("media"))
    got = media.resolved(media.sequences(media.as_pages(docs)), media.read_features(stored)).collect()
    assert len(got) == len(rows)
    wanted = collections.Counter()
    for i, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        wanted[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == wanted
    assert media.sequences(media.as_pages(empty(spark))).count() == 0


def test_html_items():
    items = media.items_of('<p>a <b>b</b></p><figure><img src="urn:sha256:x" alt="old"><figcaption>cap &amp; tion</figcaption></figure><script>no</script>tail<img src="y" alt="alt">')
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [(0, "text", "a b", None, None), (1, "media", None, "x", "cap & tion"), (2, "text", "tail", None, None), (3, "media", None, "y", "alt")]
    assert media.items_of(None) == []


# 2

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def ok(kind, s):
        d = re.sub("[^0-9]", "", s)
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return sorted((m.start(), k, m.end(), n) for k, (n, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "", re.ASCII) if ok(n, m[0]))


def test_pii_base_spans(spark):
    rng = random.Random(2)
    parts = [*"0123456789.@+-() aZ_%é😀", "4111111111111111", "a@b.cd", "1.2.3.4", "+1 (619) 555-0053", 'token = "abcdef0123456789abcdef012"', "256."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts += [None, "", "1" * 5000, "a" * 20000, "a." * 5000 + "@x.y", "1 " * 2000, "+1 " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        wanted = base_spans(texts[r["doc_id"]])
        assert [(x["start"], x["kind"], x["end"]) for x in r["base"]] == [(a, n, b) for a, _, b, n in wanted]
        assert {(x["start"], x["kind"], x["end"]) for x in r["base"]} <= {(x["start"], x["kind"], x["end"]) for x in r["spans"]}
    assert pii.detect(df.limit(0)).count() == 0
    long_ = pii.without_spans(spark.createDataFrame([(1, "my password = " + "aB3" * 200 + " and 4111111111111111")], "doc_id long, text string")).first()["text"]
    assert "aB3" not in long_ and "4111" not in long_
    clean = pii.without_spans(df).collect()
    assert len(clean) == len(texts) and all("4111111111111111" != r["text"] for r in clean)


# 3


def test_archives(spark, tmp_path):
    html = ["same", "same", None, "", "öther 日本 \r\n\r\n 💩", "same"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)] + [(0, "http://again", "same"), (None, None, "same")], "page_id long, url string, html string")
    folder = f"file:{tmp_path}/packages"
    manifest = warc.write_packages(warc.with_first(pages), folder, package_bytes=200)
    got = warc.read_packages(manifest, folder).collect()
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == collections.Counter({(0, "response", None): 2, (1, "revisit", 0): 1, (2, "response", None): 1, (3, "revisit", 2): 1, (4, "response", None): 1, (5, "revisit", 0): 1, (None, "revisit", 0): 1})
    for r in got:
        body = (html[r["page_id"]] if r["page_id"] is not None else "same") or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body.encode()), base64.b32encode(hashlib.sha1(body.encode()).digest()).decode())
    assert warc.read_packages(warc.write_packages(warc.with_first(pages.limit(0)), folder), folder).count() == 0


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        for i in range(70_000):
            z.writestr(f"{i}", b"")
        z.writestr("last", b"payload")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    data = raw.getvalue()
    members = warc.stored_members(lambda n, at: data[at : at + n], len(data))
    at, n = members["last"]
    assert data[at : at + n] == b"payload" and len(members) == 70_001 and "packed" not in members


# 4


def test_mix_fills_to_targets(spark, docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
    targets = {r["source"]: r["target"] for r in got}
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items())
    assert sum(targets.values()) == pytest.approx(1.5 * sum(size.values()))
    free = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    levels = {round(t / free[s], 6) for s, t in targets.items() if t < 2 * size[s]}
    assert len(levels) == 1 and all(2 * size[s] <= free[s] * max(levels) + 1e-6 for s, t in targets.items() if t == 2 * size[s])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["taken"]) for r in again) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["taken"]) for r in got)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_repeats_rows(docs):
    got = mixing.repeated(docs)
    assert got.columns == docs.columns and got.groupBy("doc_id", "text").count().where("count > 4").count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8, 1.5])
def test_repeated_rows_give_the_words_that_the_mix_takes(spark, rows, share):
    """Equal rows, of which a source's border takes some: by source the words differ by half a document at most."""
    equal = [(7, "one two three four five six seven eight", "en", "s", None)] * 6 + [(8, " ".join(["w"] * 40), "en", "t", None)] * 9 + [(9, "x y", "en", "t", None)]
    for some in (equal[:6], equal, rows + equal):
        df = spark.createDataFrame(some, DOCS).repartition(3)
        taken, sizes = collections.Counter(), collections.Counter()
        for r in mixing.mix(df, total_share=share).collect():
            taken[r["source"]] += r["taken"]
            sizes[r["source"]] = max(sizes[r["source"]], r["size"])
        given = collections.Counter()
        for r in mixing.repeated(df, total_share=share).collect():
            given[r["source"]] += len(WORD.findall(r["text"] or ""))
        assert all(2 * abs(given[s] - taken[s]) <= sizes[s] for s in taken)



# 5


def katz_by_hand(rows):
    seen = lambda t: [*tokens_of(t), None]
    one, two, context = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        if not katz.is_held_out(i):
            w = seen(t)
            p = ["<s>", *w[:-1]]
            one.update(w), two.update(zip(p, w, strict=True)), context.update(p)
    n, coc = sum(one.values()), lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(coc(one)), katz.discounts(coc(two))
    less = lambda c, d: d[c - 1] * c if c <= katz.K else c - katz.BIG
    p1 = {w: less(c, d1) / n for w, c in one.items()}
    unknown, follow = 1 - sum(p1.values()), collections.defaultdict(dict)
    for (h, w), c in two.items():
        follow[h][w] = less(c, d2) / context[h]
    alpha = {h: (1 - sum(f.values())) / (1 - sum(p1[w] for w in f)) for h, f in follow.items()}
    for h, f in follow.items():
        assert sum(f.values()) + alpha[h] * (1 - sum(p1[w] for w in f)) == pytest.approx(1)
    out = []
    for i, t, *_ in rows:
        w = seen(t)
        s = sum(math.log10(follow[h][x] if h in follow and x in follow[h] else alpha.get(h, 1.0) * p1.get(x, unknown)) for h, x in zip(["<s>", *w[:-1]], w, strict=True))
        base = sum(math.log10((one.get(x, 0) + 0.1) / (n + 0.1 * (len(one) + 1))) for x in w)
        out.append((i, katz.is_held_out(i), len(w), sum(x in one for x in w), n, base, s))
    return out


def test_katz(spark, docs, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, wanted = sorted(map(tuple, katz.scores(docs).collect()), key=key), sorted(katz_by_hand(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in wanted], rtol=0, atol=1e-8)
    assert katz.scores(empty(spark)).count() == 0


def test_katz_deals_a_frequent_word_evenly(spark):
    """A word that is half of all tokens, by different words: an entry for each of its bigrams in a chunk, spread over the buckets."""
    rows = [(i, " ".join(f"the w{i * 100 + j}" for j in range(100)), "en", None, None) for i in range(40)]
    df = spark.createDataFrame(rows, DOCS).coalesce(1)
    dealt = katz.dealt(katz.chunks(df.select("doc_id", "text")), 16).toArrow()
    sizes = [len(katz._unpack_sorted(x)) for x in dealt.column("pairs")]
    assert sum(sizes) == 1 + 4000 + 3960 + 40 and max(sizes) < 2 * sum(sizes) / 16
    assert sum(len(katz._unpack_sorted(x)) for x in dealt.column("words")) == 1 + 4000 + 1


# 6


def jaccard_by_hand(rows):
    sets = []
    for _, t, *_ in rows:
        w = tokens_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_FROM", 3)
    rows = corpus(90, seed)
    df = spark.createDataFrame(rows, DOCS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, jaccard.clusters(df).collect()), key=key) == sorted(jaccard_by_hand(rows), key=key)
    if seed == 1:
        kept = jaccard.without_duplicates(df)
        classes = {c for _, n, c in jaccard_by_hand(rows) if n}
        blank = sum(not tokens_of(r[1]) for r in rows)
        assert kept.count() == len(classes) + blank and kept.columns == df.columns
        assert jaccard.clusters(empty(spark)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (7, 8), (5, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}


# 7


def test_toxicity(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "er", "th", "in", "ou", "st"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(700):
        bad = rng.random() < 0.3
        rows.append((i, " ".join(rng.choice(["zorgish", "blaxum"]) if bad and rng.random() < 0.1 else word() for _ in range(rng.randint(30, 120)))))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame([*rows, (9000, None), (9001, ""), (None, "x")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, toxicity.fit(docs, marks)).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9000]["predicted"] == got[9001]["predicted"] == 0
    again = toxicity.scored(docs.union(docs.limit(3)).repartition(5), toxicity.fit(docs.repartition(3), marks)).collect()
    assert all(r["score"] == pytest.approx(got[r["doc_id"]]["score"]) for r in again) and len(again) == len(got) + 3
    nothing = toxicity.fit(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, nothing).collect()} == {0.0}


def test_window_lengths_equal_plain_zstandard():
    """Distances, one window at a time by hand, of blank, short, multi-byte and very long texts."""
    import zstandard

    words = {f"zorg{i % 7}ish{i % 3}": 5 for i in range(40)} | {"blaxum": 9}
    toxic, ordinary = toxicity.trained(words, 512), toxicity.trained({f"plain{i}er": 2 for i in range(200)}, 1024)
    rng = random.Random(9)
    texts = ["", " \n.,", "x", "zorg1ish1", "é" * 31, "plain7er zorg0ish0, blaxum! " * 3, " ".join(rng.choice([*words, "plain9er", "日本"]) for _ in range(60_000))]
    coders = []
    for content in (toxic + ordinary, ordinary):
        d = zstandard.ZstdCompressionDict(toxicity.SENTINEL + b"\n" + content + b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=toxicity._parameters())
        coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=toxicity._parameters()))
    d, counts = toxicity.Distances(toxic, ordinary).of([t.encode() for t in texts])
    assert counts[0] == counts[1] == 0 and counts[2] == 1
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        plain = b" " + bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in text.encode())
        assert n == (-(-len(plain) // 32) if plain.strip() else 0)
        for k in range(0, n, max(1, n // 50)):
            piece = toxicity.SENTINEL + plain[32 * k : 32 * k + 48].ljust(48)
            long_, short = (len(c.compress(piece)) for c in reversed(coders))
            assert d[at + k] == long_ - short
        at += n
    m = toxicity.Distances(toxic, ordinary).measured(pa.array(texts))
    assert m[:, 0].tolist() == counts.tolist() and m[0].tolist() == [0] * m.shape[1] and m[3, 2] > 0


def test_toxicity_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "x", 0.5)], "doc_id long, text string, score double")
    with pytest.raises(ValueError, match="score"):
        toxicity.with_score(df, toxicity.Model(b"", b""))
    assert toxicity.without_toxic(df, toxicity.Model(b"", b"")).columns == df.columns
    assert toxicity.scored(df.limit(0), toxicity.Model(b"", b"")).count() == 0


# 8 and 9


def texts_for_tokens(n=400, seed=5):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "1", "23", "!", "　", "\xa0", "'s", "<|endoftext|>", "日本", ".", "​", "\x1c", "\x85", " word", "💩", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", None, " ", "  a"]


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    exact, texts = Tokenizer.from_file(tokens.default_tokenizer()), texts_for_tokens()
    ends, ids = tokens.Encoder(tokens.default_tokenizer()).ids(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == exact.encode(t or "", add_special_tokens=False).ids


def test_edits_equal_full_counts():
    encode = tokens.Encoder(tokens.default_tokenizer())
    count = lambda s: len(encode.encode([s])[0]) if s else 0
    rng, texts = random.Random(6), texts_for_tokens(60)
    long = " ".join(t for t in texts if t) * 20
    for text in [*[t or "" for t in texts[:40]], long]:
        ends, piece, said, n = encode.counts(pa.array([text]))
        leaves = [(sum(len(said[p]) for p in piece[i : i + 8]), int(n[piece[i : i + 8]].sum())) for i in range(0, len(piece), 8)]
        tree = counting.CountTree(text, leaves)
        assert tree.tokens == count(text)
        for _ in range(12):
            a = rng.randint(0, len(tree.text))
            b = a + rng.randint(0, 20)
            put = rng.choice(texts) or ""
            wanted = tree.text[:a] + put + tree.text[b:]
            tree.edit(a, b, put, count)
            assert tree.text == wanted and tree.tokens == count(wanted)


def test_edited_counts_on_spark(spark, docs):
    got = counting.edited(counting.with_leaves(counting.with_edits(docs.select("doc_id", "text")))).collect()
    assert len(got) == docs.count() and all(r["tokens_after"] >= 0 and r["edits"] == 3 for r in got)
    assert counting.edited(counting.with_leaves(counting.with_edits(empty(spark)))).count() == 0


def test_packing(spark, docs, rows):
    got = packing.pack(docs, max_tokens=256).collect()
    encode = tokens.Encoder(tokens.default_tokenizer())
    wanted = collections.Counter()
    for i, t, *_ in rows:
        ids = np.array([*encode.encode([t or ""])[0], 0], "<u4")
        start, first = 0, len(ids) % 256 or 256
        for k in range(-(-len(ids) // 256)):
            stop = first + 256 * k
            wanted[(i, k, start, stop - start, zlib.crc32(ids[start:stop]))] += 1
            start = stop
    assert collections.Counter(tuple(r)[:5] for r in got) == wanted
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 256 + 1
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_keeps_every_capacity(score):
    histogram = {10: 30, 7: 11, 3: 100, 1: 5}
    runs = packing.plan(histogram, max_tokens=20, max_docs=3, max_cost=150, score=score)
    bins = collections.defaultdict(list)
    for n, parts in runs.items():
        assert sum(p[1] for p in parts) == histogram[n]
        for _, count, first, offset in parts:
            for b in range(first, first + count):
                bins[b].append((offset, n))
    for held in bins.values():
        assert sum(n for _, n in held) <= 20 and len(held) <= 3 and sum(n * n for _, n in held) <= 150
        ends = sorted(held)
        assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    with pytest.raises(ValueError, match="beyond"):
        packing.plan({30: 1}, max_tokens=20)


# 10


def test_topk(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(5)] + [(500, None), (501, [1.0, None]), (502, [float("nan")]), (503, [float("inf")])]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = collections.defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 50 = 0"), 5, slice_rows=40, block_rows=3).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i < 500}
    for q in (i for i in whole if i % 50 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_large_components_ties_and_repeats(spark):
    """Components past 2**24 and 2**53, ties across slices, repeated ids, vectors of unequal length."""
    rows = [(0, [70000.0, -1e12]), (1, [1e13, 3.0]), (2, [1e13, 3.0]), (3, [-1e13, 2.0, 1e10]), (4, [0.5]), (4, [0.5]), (5, [1e300, 0.0]), (6, [])]
    rows += [(i, [1.0, -1.0]) for i in range(10, 30)]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    clip = lambda x: min(max(x, topk.LEAST), topk.MOST)
    whole = [(i, [clip(math.floor(256 * x)) for x in v]) for i, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    got = collections.defaultdict(list)
    for r in topk.search(df, df.where("vec_id IN (0, 1, 20)"), 5, slice_rows=3, block_rows=1).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, v in whole:
        if q in (0, 1, 20):
            best = sorted((-clip(dot(v, c)), i) for i, c in whole if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


# All of them


def test_columns_that_clash(spark):
    """Extra columns keep their values whatever their names, or ValueError says which one is in the way."""
    mine = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _key string, bucket string, found string, _row string, times int, extra int"
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text if i < 2 else f"{i} mail a{i}@b.org " + text[: 10 * i], "en", "s", 1, 9, "k", "mine", "b", "f", "r", 5, 6) for i in range(6)]
    df = spark.createDataFrame(rows, mine)
    for got in (mixing.repeated(df), jaccard.without_duplicates(df), pii.without_spans(df), toxicity.without_toxic(df, toxicity.Model(b"", b""))):
        assert got.columns == df.columns and got.count() > 0
        assert {tuple(r[5:]) for r in got.collect()} == {rows[0][5:]}
    trees = counting.with_leaves(counting.with_edits(df.select("doc_id", "text")))
    for taken in ("digest", "position", "caption", "Payload_bytes"):
        with pytest.raises(ValueError, match=taken.lower()):
            media.resolved(media.sequences(media.as_pages(df)).withColumn(taken, media.F.lit(1)), media.read_features(df.select(media.F.lit("x").alias("digest"), media.as_image(media.padded(media.F.col("text"))).alias("media"))))
    with pytest.raises(ValueError, match="tokens_before"):
        counting.edited(trees.withColumn("tokens_before", media.F.lit(1)))
    with pytest.raises(ValueError, match="leaves"):
        counting.with_leaves(trees)


def test_shared_folder_on_a_cluster(monkeypatch):
    """No machine-local folder where executors are elsewhere."""

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
