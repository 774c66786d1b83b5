"""Katz backoff scores of texts with bigrams learnt from the corpus itself.

Tokens are words (A-Z in lower case) and one end to each text; a text's first token follows a begin. Counts come from the
training texts, texts whose crc32 of doc_id is no multiple of 10. Good-Turing discounts counts of 1 to 5, larger counts
give up a tenth, and what a context's seen tokens leave goes to the others by their unigram share:

    P(w | h) = d(c) * c(h, w) / c(h) if c(h, w) > 0, else alpha(h) * P(w);  P(w) alike, without h; unknown words share what it leaves.
    alpha(h) = (1 - sum of P(w | h) over seen w) / (1 - sum of P(w) over the same w), so that P(. | h) sums to 1.

Texts are put into chunks of about `CHUNK_TOKENS` tokens, which are written. A chunk gives each of its words and bigrams once, with
its count, dealt by the hash of the word or of the whole bigram; a bucket sums them and tells each chunk the corpus's counts, in
the chunk's own order, and one chunk of each bigram that it stands for it. So no task holds the occurrences of a word, however
frequent: a word or bigram is one entry for each chunk that has it. Chunks then score their texts and give, for the bigrams that
they stand for, sums by context, which make the backoff weights. Only what a text backs off to is joined by its context, a row
for each chunk and context: of training texts, nothing.

Null or empty text: the end alone. Null doc_id: a training text. Repeated rows: each counts and is scored. No training
texts: every word is unknown. A very long text may be a chunk of its own. Empty table: no rows. Words are told apart by 64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, hashes, mixed, slices, table, texts_of, word_codes, written

K = 5
BIG = 0.1
BEGIN, END = np.uint64(1), np.uint64(2)
BUCKET_BYTES = 16 << 20
CHUNK_TOKENS = 1_500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Of a chunk: doc_ids with a flag for null ones, which texts are held out, tokens of each text, words (sorted hashes), their places by token.
CHUNKS = "chunk long, names binary, held binary, sizes binary, words binary, codes binary"
DEALT = "bucket int, chunk long, words binary, word_counts binary, pairs binary, pair_counts binary"
#: nums: counts of counts of a bucket; else a chunk's counts in the corpus, of its words and bigrams of a bucket.
COUNTED = "bucket int, chunk long, nums array<long>, words binary, pairs binary"
#: kind 1: sums of a context h, see `judged`; 2: a text; 4: texts of a chunk that back off behind h, and how often.
MADE = "kind int, chunk long, idx int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, nums array<double>, texts array<int>, times array<long>"


def _pack(x: np.ndarray) -> bytes:
    """The bytes of `x`, those of each place of a number together."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _unpack(x, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(x) -> np.ndarray:
    return np.cumsum(_unpack(x, np.uint64), dtype=np.uint64)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def chunks(docs: DataFrame) -> DataFrame:
    """Tokens of chunks of texts."""
    schema = to_arrow_schema(T._parse_datatype_string(CHUNKS))

    def emit(parts: list[np.ndarray], sizes: list[np.ndarray], names: list[int | None]) -> pa.RecordBatch:
        words, codes = np.unique(np.concatenate(parts), return_inverse=True)
        flagged = np.array([[-1 if n is None else 1, n or 0] for n in names], np.int64).ravel()
        held = np.array([is_held_out(n) for n in names], np.uint8)
        row = (uuid.uuid4().int >> 65, _pack(flagged), _pack(held), _pack(np.concatenate(sizes).astype(np.int64)), _pack_sorted(words), _pack(codes.astype(np.uint32)))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes, names, tokens = [], [], [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ends, codes, words = word_codes(texts_of(batch, "text"))
                n = np.diff(ends)
                of = mixed(hashes(words) | np.uint64(4)) if len(words) else np.zeros(0, np.uint64)
                at = np.concatenate([[0], np.cumsum(n + 1)])
                w = np.full(at[-1], END)
                inside = np.ones(at[-1], bool)
                inside[at[1:] - 1] = False
                w[inside] = of[codes]
                parts.append(w)
                sizes.append(n + 1)
                names += batch.column("doc_id").to_pylist()
                tokens += int(at[-1])
                if tokens >= CHUNK_TOKENS:
                    yield emit(parts, sizes, names)
                    parts, sizes, names, tokens = [], [], [], 0
                    give_back()
        if names:
            yield emit(parts, sizes, names)
            parts, sizes = [], []
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, CHUNKS)


class Chunk:
    """A chunk's words and bigrams, these in the order of their hashes."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, i: int) -> None:
        get = lambda c, kind: _unpack(rows.column(c)[i], kind)
        self.chunk = rows.column("chunk")[i].as_py()
        self.held, sizes = get("held", np.uint8), get("sizes", np.int64)
        self.words = _unpack_sorted(rows.column("words")[i])
        self.w = get("codes", np.uint32).astype(np.int64)
        n = len(self.words)
        h = np.concatenate([[n], self.w[:-1]])
        h[np.cumsum(sizes) - sizes] = n
        self.text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.contexts = np.append(self.words, BEGIN)
        pairs, at = np.unique(self.w * (n + 1) + h, return_inverse=True)
        del h
        w, h = np.divmod(pairs, n + 1)
        pairs = mixed(self.words[w] * _STEP + self.contexts[h])
        order = np.argsort(pairs, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.pairs, self.pair_w, self.pair_h, self.at = pairs[order], w[order], h[order], rank[at]


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)


def dealt(made: DataFrame, buckets: int) -> DataFrame:
    """The words and bigrams of `chunks`, once each, and how often training texts of the chunk have them."""
    schema = to_arrow_schema(T._parse_datatype_string(DEALT))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c, rows = Chunk(batch, i), []
                train = c.held[c.text] == 0
                counts = [np.bincount(x[train], minlength=n).astype(np.uint32) for x, n in ((c.w, len(c.words)), (c.at, len(c.pairs)))]
                cuts = [np.searchsorted(_bucket(x, buckets), np.arange(buckets + 1)) for x in (c.words, c.pairs)]
                for b in range(buckets):
                    (p, q), (s, t) = cuts[0][b : b + 2], cuts[1][b : b + 2]
                    if p < q or s < t:
                        rows.append((b, c.chunk, _pack_sorted(c.words[p:q]), _pack(counts[0][p:q]), _pack_sorted(c.pairs[s:t]), _pack(counts[1][s:t])))
                del c, train, counts
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return made.mapInArrow(deal, DEALT)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each distinct key; for each entry twice its key's sum, and one more at the key's first entry."""
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    starts = np.flatnonzero(first)
    counts = np.concatenate(counts).astype(np.int64)[order]
    sums = np.add.reduceat(counts, starts) if len(starts) else counts
    told = np.empty(len(keys), np.uint64)
    told[order] = (2 * np.repeat(sums, np.diff(np.append(starts, len(keys)))) + first).astype(np.uint64)
    return sums, told


def counted(rows: pa.Table, schema: pa.Schema) -> pa.Table:
    """What a bucket tells; see COUNTED."""
    n, nums, told = rows.num_rows, [], []
    for name, of in (("words", "word_counts"), ("pairs", "pair_counts")):
        keys = [_unpack_sorted(x) for x in rows.column(name)]
        sums, each = _summed(keys, [_unpack(x, np.uint32) for x in rows.column(of)])
        ends = np.cumsum([len(k) for k in keys])
        told.append([_pack(x) for x in np.split(each, ends[:-1])])
        if name == "words":
            nums += [int(sums.sum()), int((sums > 0).sum())]
        nums += np.bincount(np.minimum(sums, K + 2), minlength=K + 3)[1 : K + 2].tolist()
    b = rows.column("bucket")[0].as_py()
    columns = [[b] * (n + 1), [None, *rows.column("chunk").to_pylist()], [nums] + [None] * n, [None, *told[0]], [None, *told[1]]]
    return pa.table([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _less(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts after their discount."""
    return np.where(c > K, c - BIG, np.array([0.0, *(d[r - 1] * r for r in range(1, K + 1))])[np.minimum(c, K)])


def judged(chunk: pa.Table, told: pa.Table, schema: pa.Schema, total: int, d1: list[float], d2: list[float], unknown: float) -> pa.Table:
    """Texts, contexts and misses of a chunk; see MADE. A context's sums are its bigrams' counts, what these lose, and their words' discounted counts."""
    c, order = Chunk(chunk, 0), np.argsort(told.column("bucket").to_numpy())
    of_word, of_pair = (np.concatenate([_unpack(told.column(name)[int(i)], np.uint64) for i in order]) for name in ("words", "pairs"))
    of_word, mine, of_pair = (of_word >> np.uint64(1)).astype(np.int64), (of_pair & np.uint64(1)) == 1, (of_pair >> np.uint64(1)).astype(np.int64)
    n, texts = len(c.words), len(c.held)
    # Every word is a context as often as it occurs, the begin as often as the end.
    of_context = np.append(of_word, of_word[c.words == END])
    one = np.where(of_word > 0, _less(of_word, d1), 1.0)
    one = np.where(of_word > 0, np.log10(one / max(total, 1)), unknown)
    seen = of_pair > 0
    two = np.where(seen, np.log10(np.where(seen, _less(of_pair, d2), 1.0) / np.maximum(of_context[c.pair_h], 1)), one[c.pair_w])
    sums = lambda x: np.bincount(c.text, x, texts)
    flagged = _unpack(chunk.column("names")[0], np.int64).reshape(-1, 2)

    def part(m: int, **given) -> pa.Table:
        return pa.table([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(m, f.type) for f in schema], schema=schema)

    def lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))

    known = sums(of_word[c.w] > 0).astype(np.int64)
    out = [part(texts, kind=np.full(texts, 2), chunk=np.full(texts, c.chunk), idx=np.arange(texts), doc_id=[int(i) if ok > 0 else None for ok, i in flagged], held_out=c.held == 1, n_tokens=np.bincount(c.text, minlength=texts), n_known=known, base=sums(np.log10(of_word + 0.1)[c.w]), score=sums(two[c.at]))]

    own = seen & mine
    h, p, lost = c.pair_h[own], of_pair[own], of_pair[own] - _less(of_pair[own], d2)
    used = np.unique(h)
    table_ = np.stack([np.bincount(h, x, n + 1)[used] for x in (p, lost, _less(of_word[c.pair_w[own]], d1))], 1)
    out.append(part(len(used), kind=np.full(len(used), 1), h=c.contexts[used].view(np.int64), nums=lists(np.arange(0, 3 * len(used) + 1, 3), table_.ravel()).cast(schema.field("nums").type)))

    missed = (~seen & (of_context[c.pair_h] > 0))[c.at]
    keys, times = np.unique(c.pair_h[c.at[missed]] * texts + c.text[missed], return_counts=True)
    h, text = np.divmod(keys, texts)
    starts = np.flatnonzero(np.diff(h, prepend=-1))
    ends = np.append(starts, len(h))
    out.append(part(len(starts), kind=np.full(len(starts), 4), chunk=np.full(len(starts), c.chunk), h=c.contexts[h[starts]].view(np.int64), texts=lists(ends, text.astype(np.int32)).cast(schema.field("texts").type), times=lists(ends, times.astype(np.int64)).cast(schema.field("times").type)))
    return pa.concat_tables(out)


def discounts(n: list[int]) -> list[float]:
    """Katz's Good-Turing factors of the counts 1 to K from the counts of counts 1 to K + 1; absolute ones where those don't hold."""
    top = (K + 1) * n[K] / n[0] if n[0] else 1.0
    out = []
    for r in range(1, K + 1):
        star = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        d = (star - top) / (1 - top) if top < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs` (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted_schema, made_schema = (to_arrow_schema(T._parse_datatype_string(x)) for x in (COUNTED, MADE))
    cut = written(chunks(docs), "chunks")

    def counts_of(rows: pa.Table) -> pa.Table:
        give_back()  # what the bucket before has left
        return counted(rows, counted_schema)

    told = written(dealt(cut, max(8, -(-size // BUCKET_BYTES))).groupBy("bucket").applyInArrow(counts_of, COUNTED), "counts")
    # A row for each bucket, summed to one: the counts of counts.
    width = 2 + 2 * (K + 1)
    got = told.where("nums IS NOT NULL").agg(*[F.sum(F.col("nums")[i]) for i in range(width)]).first()
    total, distinct, *counts = [int(x or 0) for x in got] if got else [0] * width
    d1, d2 = discounts(counts[: K + 1]), discounts(counts[K + 1 :])
    # Mass of unknown words: what the known ones leave. Its parts need sums over words by count; Good-Turing's are the counts of counts.
    known = sum(d1[r - 1] * r * counts[r - 1] for r in range(1, K + 1))
    big_words = distinct - sum(counts[:K])
    big_tokens = total - sum(r * counts[r - 1] for r in range(1, K + 1))
    unknown = 1 - (known + big_tokens - BIG * big_words) / total if total else 1.0
    unknown = math.log10(unknown) if unknown > 0 else 0.0

    def judge(chunk: pa.Table, of: pa.Table) -> pa.Table:
        give_back()
        return judged(chunk, of, made_schema, total, d1, d2, unknown)

    of_chunks = told.where("nums IS NULL").select("bucket", "chunk", "words", "pairs")
    made = written(cut.groupBy("chunk").cogroup(of_chunks.groupBy("chunk")).applyInArrow(judge, MADE), "scored")
    sums = made.where("kind = 1").groupBy("h").agg(*[F.sum(F.col("nums")[i]).alias(f"s{i}") for i in range(3)])
    lower = 1 - F.col("s2") / F.lit(float(max(total, 1)))
    model = sums.select("h", F.log10(F.col("s1") / F.col("s0") / lower).alias("alpha"))
    missed = made.where("kind = 4").select("chunk", "h", F.arrays_zip("texts", "times").alias("x")).join(model, "h")
    back = missed.select("chunk", "alpha", F.explode("x").alias("x")).groupBy("chunk", F.col("x.texts").alias("idx")).agg(F.sum(F.col("x.times") * F.col("alpha")).alias("back"))
    each = made.where("kind = 2").select("chunk", "idx", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(back, ["chunk", "idx"], "left")
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + 0.1 * (distinct + 1)))
    return each.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("back", F.lit(0.0))).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
