"""Cross-tokenizer alignment: tokens of two tokenizers grouped by pointer jumping, and links that count corpus-wide.

Both tokenizers cut the same bytes. Every token points to its farthest-right overlapping token: the other side's token that holds its last byte,
if that one ends farther right, or else, where both end together, to the first tokenizer's token that ends there, which points to
itself. Doubling (each pointer takes its target's pointer) ends after a number of rounds that is logarithmic in the longest chain;
then every token points to the terminal token of its component, which labels the group. All tokens of a batch jump at once.

Texts are taken apart into pieces that neither tokenizer crosses (see `tokens`; no piece of the second vocabulary has a space behind another
character, which `second` checks), and each distinct piece of a chunk is encoded and aligned once. A chunk is stored as one row: its texts as pieces'
numbers, its pieces as numbers of id pairs, its distinct pairs. A chunk gives each pair once, with the number of its documents that
hold it linked; Spark sums these by pair, and gives each chunk its own pairs' counts back, so no pair's occurrences, and no table of
all pairs, ever meet in one task. The greatest count of each id of the first tokenizer is a row for each entry of its vocabulary.

Null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros and an empty digest. Very long texts without spaces
are one piece. Repeated rows count each. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tokens
from .common import give_back, slices, table, texts_of, written

SPACE = "▁"
CHUNK_BYTES = 5 << 20
#: Distinct pieces that are encoded and aligned at once.
PIECES = 16_384
#: A row group for some chunks, looked at after each: else a file's chunks are all held by its writer, and again by who reads it.
GROUPED = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Of a chunk: its documents (ids, what the pieces give), ends and numbers of their pieces, ends and pair numbers of the pieces, its pairs, how many documents hold each.
CHUNKS = "chunk long, doc_id array<long>, sums binary, groups_sha256 array<string>, ends binary, pieces binary, link_ends binary, links binary, pairs binary, docs binary"
PAIRS = "chunk long, code int, pair long, n long"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_second() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
def first(path: str):
    """Encoder of lists of texts by a byte-level vocabulary, strings of special tokens being plain text, and the bytes of each id."""
    from tokenizers import Tokenizer

    tokenizer, byte = Tokenizer.from_file(path), tokens._alphabet()
    tokenizer.encode_special_tokens = True
    of = [b""] * tokenizer.get_vocab_size()
    for t, i in tokenizer.get_vocab().items():
        of[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
    fast = tokens._fast(path)
    if fast is not None:
        return lambda texts: [fast.encode_ordinary(t) for t in texts], of
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], of


@functools.lru_cache(maxsize=2)
def second(path: str):
    """Encoder of lists of texts by a SentencePiece model that sets a space before each, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("the vocabulary has pieces that go on behind a space")
    of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
    return lambda texts: model.encode(texts, num_threads=1), of


def groups(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The terminal token, a number of `a`, of each token of `a` and then of `b`; both are ends of tokens of the same bytes."""
    n = len(a_end)
    over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    to = np.concatenate([np.where(b_end[over_a] > a_end, n + over_a, np.arange(n)), over_b]) if n else np.zeros(0, np.int64)
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            return to
        to = farther


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of `a` and `b` whose bytes overlap, a row for each such two, in order of `a`, then `b`."""
    a_start = np.concatenate([[0], a_end[:-1]])
    low, high = np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_end, a_end)
    count = high - low + 1
    left = np.repeat(np.arange(len(a_end)), count)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(count) - count - low, count)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of each text, and all tokens."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return n, np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))


def _keeps(ids: list[list[int]], of: list[bytes], texts: list[str]) -> np.ndarray:
    """Whether the tokens of each text have its bytes."""
    return np.array([b"".join([of[i] for i in x]) == t.encode() for x, t in zip(ids, texts, strict=True)], bool)


def _spans(ends: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of `x` between consecutive `ends`."""
    total = np.concatenate([[0], np.cumsum(x)])
    return total[ends[1:]] - total[ends[:-1]]


class Aligned:
    """Distinct pieces aligned: numbers of tokens, groups and links, the groups as a string; `good`: both tokenizers keep the bytes.

    Pieces are aligned some at a time, as tokens as Python's numbers and strings would be several times the texts.
    """

    def __init__(self, texts: list[str], a_path: str, b_path: str) -> None:
        parts = [_Part(texts[i : i + PIECES], a_path, b_path) for i in range(0, len(texts), PIECES)] or [_Part([], a_path, b_path)]
        for name in ("good", "n_a", "n_b", "n_groups", "n_links", "pairs"):
            setattr(self, name, np.concatenate([getattr(p, name) for p in parts]))
        self.said = list(chain.from_iterable(p.said for p in parts))


class _Part:
    def __init__(self, texts: list[str], a_path: str, b_path: str) -> None:
        (encode_a, bytes_a), (encode_b, bytes_b) = first(a_path), second(b_path)
        a, b = encode_a(texts), encode_b([t[1:] for t in texts])
        self.good = np.ones(len(texts), bool)
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            n, flat = _flat(ids)
            size = np.fromiter(map(len, of), np.int64, len(of))[flat]
            want = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts))
            if not np.array_equal(_spans(np.concatenate([[0], np.cumsum(n)]), size), want) or b"".join(map(of.__getitem__, flat.tolist())) != "".join(texts).encode():
                self.good &= _keeps(ids, of, texts)  # some are changed: look at each
        if not self.good.all():
            a, b = ([x if ok else [] for x, ok in zip(ids, self.good.tolist(), strict=True)] for ids in (a, b))
        (self.n_a, flat_a), (self.n_b, flat_b) = _flat(a), _flat(b)
        del a, b
        # All pieces lie one behind the other on one axis of bytes, where both sides end together.
        a_end, b_end = (np.cumsum(np.fromiter(map(len, of), np.int64, len(of))[flat]) for flat, of in ((flat_a, bytes_a), (flat_b, bytes_b)))
        of_a = np.repeat(np.arange(len(texts)), self.n_a)
        top = groups(a_end, b_end)
        terminal = np.flatnonzero(top[: len(flat_a)] == np.arange(len(flat_a)))
        self.n_groups = np.bincount(of_a[terminal], minlength=len(texts))
        left, right = links(a_end, b_end)
        self.n_links = np.bincount(of_a[left], minlength=len(texts))
        self.pairs = (flat_a[left] << 32) | flat_b[right]
        stop_a, stop_b = terminal + 1, np.searchsorted(top[len(flat_a) :], terminal, side="right")
        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        parts, p, q = [], 0, 0
        for s, t in zip(stop_a.tolist(), stop_b.tolist(), strict=True):
            parts.append(",".join(said_a[p:s]) + "|" + ",".join(said_b[q:t]))
            p, q = s, t
        ends = np.concatenate([[0], np.cumsum(self.n_groups)]).tolist()
        self.said = [";".join(parts[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _taken(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the spans `which` one behind the other, and the number of each span's entry in `which`."""
    size = (ends[1:] - ends[:-1])[which]
    owner = np.repeat(np.arange(len(which)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - ends[:-1][which], size), owner


def chunks(docs: DataFrame, a_path: str, b_path: str, most: int = CHUNK_BYTES) -> DataFrame:
    """A row for each chunk of texts; see CHUNKS."""
    schema = to_arrow_schema(T._parse_datatype_string(CHUNKS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(a_path)
        for whole in batches:
            for batch in slices(whole, "text", most):
                plain = texts_of(batch, "text")
                empty = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
                ends, codes, said = encoder.pieces(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), plain, pa.scalar(" ", pa.large_string())))
                del plain
                of = Aligned(said, a_path, b_path)
                n = len(empty)
                bad = empty | (_spans(ends, ~of.good[codes]) > 0)
                keep = np.repeat(~bad, np.diff(ends))
                codes = codes[keep].astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(ends)))])
                sums = np.stack([_spans(ends, x[codes]) for x in (of.n_a, of.n_b, of.n_groups, of.n_links)])
                digests = ["" if b else hashlib.sha256(";".join([of.said[c] for c in codes[i:j].tolist()]).encode()).hexdigest() for b, i, j in zip(bad, ends[:-1], ends[1:], strict=True)]
                pairs, link = np.unique(of.pairs, return_inverse=True)
                link_ends = np.concatenate([[0], np.cumsum(of.n_links)])
                # Documents that hold a pair: distinct pieces of each document, then distinct pairs of these.
                held = np.unique(np.repeat(np.arange(n, dtype=np.int64), np.diff(ends)) * len(said) + codes)
                doc, piece = np.divmod(held, max(len(said), 1))
                at, owner = _taken(link_ends, piece)
                held = np.unique(doc[owner] * max(len(pairs), 1) + link[at])
                docs_of = np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
                row = (uuid.uuid4().int >> 65, batch.column("doc_id").to_pylist(), sums.tobytes(), digests, ends.astype(np.int64).tobytes(), codes.tobytes(), link_ends.astype(np.int64).tobytes(), link.astype(np.int32).tobytes(), pairs.tobytes(), docs_of.astype(np.int64).tobytes())
                del of, held, doc, piece, at, owner
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
                give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, CHUNKS)


def pair_rows(stored: DataFrame) -> DataFrame:
    """The pairs of each chunk that documents of it hold, with their number in the chunk and that of the documents."""

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, docs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "docs")), strict=True):
                pairs, n = np.frombuffer(pairs, np.int64), np.frombuffer(docs, np.int64)
                code = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), chunk)), pa.array(code.astype(np.int32)), pa.array(pairs[code]), pa.array(n[code])], names=["chunk", "code", "pair", "n"])

    return stored.select("chunk", "pairs", "docs").mapInArrow(unroll, PAIRS)


def judged(chunk: pa.Table, told: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of a chunk's documents; `told`: code, docs (of the whole corpus), best, for each pair of the chunk."""
    get = lambda name, kind: np.frombuffer(chunk.column(name)[0].as_py(), kind)
    n_pairs = len(get("pairs", np.int64))
    count, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, np.int64)
    code = told.column("code").to_numpy()
    count[code], best[code] = told.column("docs").to_numpy(), told.column("best").to_numpy()
    link, link_ends, codes, ends = get("links", np.int32), get("link_ends", np.int64), get("pieces", np.int32), get("ends", np.int64)
    of_piece = [_spans(link_ends, x[link]) for x in (best, count)]
    n_a, n_b, n_groups, n_links = get("sums", np.int64).reshape(4, -1)
    out = [chunk.column("doc_id")[0].values, n_a, n_b, n_groups, n_links, *[_spans(ends, x[codes]) for x in of_piece], chunk.column("groups_sha256")[0].values]
    return pa.table([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of `docs` (doc_id, text)."""
    stored = written(chunks(docs, a_path or tokens.default_tokenizer(), b_path or default_second(), most), "aligned", **GROUPED)
    each = pair_rows(stored)
    total = written(each.groupBy("pair").agg(F.sum("n").alias("docs")), "pairs").withColumn("a", F.shiftright("pair", 32))
    # A row for each id of the first tokenizer at most: its vocabulary bounds what is broadcast.
    top = total.groupBy("a").agg(F.max("docs").alias("most"))
    known = total.join(F.broadcast(top), "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))
    told = each.join(known, "pair").select("chunk", "code", "docs", "best")

    schema = to_arrow_schema(T._parse_datatype_string(OUT))

    def judge(chunk: pa.Table, of: pa.Table) -> pa.Table:
        give_back()
        return judged(chunk, of, schema)

    return stored.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(judge, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
