"""Exact deduplication, centroid clustering and token alignment against brute force, on small tables that hold the awkward cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from gleaner.llm import alignment, centroids, fuse, snapshots, tokens

DOCS = "doc_id long, text string"


# Binary-fuse filters and exact deduplication


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50, 1000, 60_000])
def test_fuse_filters_hold_their_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert made.has(keys).all()
    other = rng.integers(0, 2**64, 50_000, dtype=np.uint64)
    assert made.has(other).mean() < 2 / 256
    if n >= 60_000:
        assert len(made.cells) < 1.3 * n


def texts_with_copies():
    rng = random.Random(4)
    base = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(150)]
    rows += [(200 + i, "one hot text") for i in range(80)] + [(300 + i, "one  hot\ttext" + "\x0b" * (i % 3)) for i in range(9)]
    rows += [(400, None), (401, ""), (402, " \r\n"), (None, "one hot text"), (None, "nobody else"), (403, "x" * 200_000), (404, "x" * 200_000 + " "), (405, "x" * 200_001), (406, "é"), (407, "é"), (408, "a　b")]
    return [*rows, rows[3], rows[3], (-(2**63), "least id"), (2**63 - 1, "least id")]


def brute_copies(rows):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    by = collections.defaultdict(list)
    for i, t in rows:
        by[plain(t)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        best = min(by[plain(t)])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(by[plain(t)]), i == keep, hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("arrivals", "width"), [(2, 32), (3, 1), (1, 1)])
def test_copies_equal_brute_force(spark, arrivals, width):
    """With digests of one byte most filters' positives and most joins of digests are false, and texts have to tell."""
    rows = texts_with_copies()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", Digest string").repartition(3)
    got = snapshots.deduplicated(docs, arrivals, width)
    assert sorted(map(tuple, got.collect()), key=str) == brute_copies(rows)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_a_batch_meets_an_earlier_snapshot(spark):
    old = snapshots.snapshot(snapshots.collapsed(spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], DOCS)), 3)
    new = snapshots.snapshot(snapshots.collapsed(spark.createDataFrame([(4, "a\tb"), (5, "d"), (6, "d")], DOCS)), 3)
    digest = hashlib.sha256(b"ab").digest()
    assert [bytes(r["digest"]) for r in snapshots.known(new, old).collect()] == [digest]
    assert digest in {bytes(r["digest"]) for r in snapshots.screened(new.classes.select("digest"), old).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # stored texts are not dealt anew, however large they are
        assert snapshots.known(new, old)._jdf.queryExecution().executedPlan().toString().count("Bucketed: true") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_documents_no_copies(spark):
    assert snapshots.deduplicated(spark.createDataFrame([], DOCS)).collect() == []


# Centroid clustering


def brute_kmeans(rows, k, rounds, size, seed=2):
    fit = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(fit, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        by = collections.defaultdict(list)
        for _, v in fit:
            by[near(v)[1]].append(v)
        cents = [[sum(x) // len(by[j]) for x in zip(*by[j], strict=True)] if by[j] else c for j, c in enumerate(cents)]
    each = [(i, *near(v)[::-1]) for i, v in fit]
    total = collections.Counter()
    for _, j, d in each:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    clamp = lambda x: min(x, 2**63 - 1)
    return sorted([(i, j, clamp(d), clamp(total[j]), clamp(sum(total.values())), sha[j]) for i, j, d in each], key=str)


def vectors(n=300, size=6, seed=3, top=3):
    """Small whole steps, so that ties and equal vectors are many; unfit ones of each kind."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-top, top) / 256 for _ in range(size)]) for i in range(n)]
    rows += [(1000 + i, [0.0] * size) for i in range(60)]
    rows += [(2000, None), (2001, [1.0] * (size - 1)), (2002, [float("nan")] * size), (2003, [float("inf")] + [0.0] * (size - 1)), (2004, [None] * size), (None, [0.25] * size), (None, [0.5] * size), (5, [0.0] * size), (5, [0.0] * size)]
    return rows


@pytest.mark.parametrize("k", [1, 4, 40])
def test_centroids_equal_brute_force(spark, k):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = centroids.clusters(df, k=k, size=6)
    assert sorted(map(tuple, got.collect()), key=str) == brute_kmeans(rows, k, 5, 6)


def test_centroids_of_few_vectors_and_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, -1.0])]
    assert sorted(map(tuple, centroids.clusters(spark.createDataFrame(few, kind), size=2).collect()), key=str) == brute_kmeans(few, 40, 5, 2)
    assert centroids.clusters(spark.createDataFrame([], kind), size=2).collect() == []


def test_centroids_beyond_64_bits(spark):
    rows = [(i, [float(x), float(-x)]) for i, x in enumerate([2.0**40, 2.0**40 + 2**9, -(2.0**41), 3.0, 2.0**50])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, centroids.clusters(df, k=3, size=2).collect()), key=str) == brute_kmeans(rows, 3, 5, 2)


@pytest.mark.parametrize("leaf", [1, 4, 100])
def test_tree_finds_the_nearest_and_prunes(leaf):
    rng = np.random.default_rng(5)
    cents = np.concatenate([rng.integers(-40, 40, (60, 3)), np.zeros((5, 3), int), rng.integers(4000, 4040, (60, 3))])
    v = np.concatenate([rng.integers(-40, 40, (200, 3)), rng.integers(3900, 4100, (200, 3))])
    best, near, seen = centroids.Tree(cents, leaf).nearest(v)
    far = np.square(v[:, None, :] - cents[None]).sum(-1)
    assert (best == far.argmin(1)).all()
    assert (near == far.min(1)).all()
    if leaf == 4:
        assert seen < 0.5 * far.size


# Alignment of tokens


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one, two, byte = Tokenizer.from_file(tokens.default_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=alignment.default_second()), tokens._alphabet()
    one.encode_special_tokens = True
    counts, each = collections.Counter(), []
    for i, t in rows:
        a = one.encode(" " + t, add_special_tokens=False).ids if t else []
        b = two.encode(t) if t else []
        raw_a = [bytes(byte[c] for c in one.id_to_token(x)) for x in a]
        raw_b = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            each.append((i, [], [], [], []))
            continue
        span = lambda raw: [(sum(map(len, raw[:k])), sum(map(len, raw[: k + 1]))) for k in range(len(raw))]
        at_a, at_b, groups, low = span(raw_a), span(raw_b), [], 0
        for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            groups.append("|".join(",".join(str(x) for x, (_, e) in zip(ids, at, strict=True) if low < e <= cut) for ids, at in ((a, at_a), (b, at_b))))
            low = cut
        linked = [(x, y) for x, (s, e) in zip(a, at_a, strict=True) for y, (u, v) in zip(b, at_b, strict=True) if s < v and u < e]
        counts.update(set(linked))
        each.append((i, a, b, groups, linked))
    top = collections.Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return sorted([(i, len(a), len(b), len(g), len(p), sum(counts[q] == top[q[0]] for q in p), sum(counts[q] for q in p), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, p in each], key=str)


def awkward_texts():
    rng = random.Random(3)
    rows = [None, "", " ", "a <|endoftext|> b <s> c</s>", "x▁y", "  two  spaces \n\n tab\t", "日本語テキスト émigré naïve ﬁ 👩‍👩‍👧 Ünïcödé", "hello world hello", "hello world hello", "　 a b   c", "don't 'll ''s 1234567 ab12cd", "x" * 1500, "\x00\x01 a", " a ̈b", "a\r\n b"]
    rows += ["".join(rng.choice("ab \n\t é日.'0　") for _ in range(rng.randint(1, 60))) for _ in range(120)]
    return [(i, t) for i, t in enumerate(rows)] + [(None, "hello world"), (7, "hello world hello")]


def test_alignment_equals_brute_force(spark):
    rows = awkward_texts()
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", chunk int").repartition(3)
    assert sorted(map(tuple, alignment.align(docs, most=300).collect()), key=str) == brute_alignment(rows)
    assert alignment.align(docs.limit(0)).collect() == []


def test_pointers_reach_the_terminal_token():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        cut = lambda: np.append(np.flatnonzero(rng.random(n - 1) < rng.random()) + 1, n) if n > 1 else np.array([1])
        a, b = cut(), cut()
        both = np.intersect1d(a, b)
        want = lambda ends: np.searchsorted(a, both[np.searchsorted(both, ends)])
        assert (alignment.groups(a, b) == np.concatenate([want(a), want(b)])).all()
        left, right = alignment.links(a, b)
        start = lambda ends: np.concatenate([[0], ends[:-1]])
        assert set(zip(left.tolist(), right.tolist(), strict=True)) == {(i, j) for i in range(len(a)) for j in range(len(b)) if start(a)[i] < b[j] and start(b)[j] < a[i]}


def test_pieces_are_aligned_some_at_a_time(monkeypatch):
    """All pieces of a chunk were tokens as Python's numbers and strings at once."""
    a, b = tokens.default_tokenizer(), alignment.default_second()
    texts = [" " + "".join(chr(97 + (i * 7 + k * k) % 26) for k in range(1 + i % 11)) + ("é" if i % 5 == 0 else "") for i in range(60)] + [" \u0000x"]
    whole, sizes = alignment.Aligned(texts, a, b), []
    encode, of = alignment.first(a)
    monkeypatch.setattr(alignment, "first", lambda path: (lambda some: (sizes.append(len(some)), encode(some))[1], of))
    monkeypatch.setattr(alignment, "PIECES", 8, raising=False)
    got = alignment.Aligned(texts, a, b)
    assert max(sizes) == 8 and sum(sizes) == len(texts)
    for name in ("good", "n_a", "n_b", "n_groups", "n_links", "pairs"):
        assert getattr(got, name).tolist() == getattr(whole, name).tolist() and getattr(got, name).dtype == getattr(whole, name).dtype
    assert got.said == whole.said and alignment.Aligned([], a, b).said == []


def test_stored_chunks_lie_in_small_row_groups(spark, monkeypatch):
    """A file's chunks were one row group, held whole by its writer and by each task that read it."""
    import pyarrow.parquet as pq

    paths, written = [], alignment.written

    def watched(df, name, **options):
        out = written(df, name, **options)
        paths.extend(out.inputFiles() if name == "aligned" else [])
        return out

    monkeypatch.setattr(alignment, "written", watched)
    monkeypatch.setattr(alignment, "GROUPED", getattr(alignment, "GROUPED", {}) | {"parquet.block.size": 4096}, raising=False)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(400))) for i in range(12)], "doc_id long, text string").coalesce(1)
    assert alignment.align(docs, most=1).count() == 12
    groups = [pq.ParquetFile(p.removeprefix("file:")).metadata for p in paths]
    assert sum(m.num_rows for m in groups) == 12 and sum(m.num_row_groups for m in groups) >= 6
