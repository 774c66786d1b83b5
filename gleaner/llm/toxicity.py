"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one for each class, on words of a bounded sample of labelled documents: the ordinary one
on ordinary text, each word weighed by the logarithm of its documents; the toxic one on the words by which toxic text stands out
from ordinary text, weighed by their documents. Toxic text is ordinary text too, so the ordinary dictionary's content follows the
toxic one's in the toxic dictionary: what both hold saves alike. Every window of a text is compressed with both; how much shorter
the toxic dictionary makes it is the window's distance. The threshold from which a window counts, and the weights of four figures
of a text's distances (their mean excess, their greatest, share and number at the threshold), are calibrated on the
sample's other half by logistic regression, with weights that restore the labels' own proportions.

Windows start with a sentinel that both dictionaries hold, so that zstandard never stores one raw, and are short enough to leave
literals uncompressed; a length thus tells what was matched.

Bound of the fit: `SAMPLE_TOXIC` and `SAMPLE_OTHER` labelled documents, those with the least MD5 of doc_id among the rows
to learn from (crc32 of doc_id mod 5 is not 0), and of their words the `TRAINED_WORDS` with the most documents in each class.
Labels of null doc_id or null toxic are not learnt from; of several labels of a document the greatest counts. No labels of either
class, or no word that stands out: every score is the share of toxic ones (0 without any). Null or empty text: no window, scored
like a text without distance. A text of any length is cut into windows whole. Repeated rows: each is scored, alike. Empty table: no rows. Extra columns
are ignored, or kept by `with_score` and `without_toxic`, which raise ValueError where their own column's name is taken.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free, slices, table, texts_of, written

SAMPLE_TOXIC, SAMPLE_OTHER = 1500, 3000
TRAINED_WORDS = 50_000
#: Standard deviations and occurrences by which a beginning of words has to stand out in toxic text.
STANDS_OUT, LEAST_TIMES = 5.0, 5
WINDOW, STEP = 48, 32
SENTINEL = bytes(range(1, 17))
TOXIC_BYTES, ORDINARY_BYTES = 8 << 10, 32 << 10
#: Thresholds that calibration chooses from.
NEAR = (2, 3, 4, 5, 6, 8)
FEATURES = 4
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(compression_level=6, window_log=17, strategy=zstandard.STRATEGY_LAZY2, min_match=4, hash_log=15, chain_log=15, search_log=4, target_length=64, write_content_size=0, write_checksum=0, write_dict_id=0)


def trained(words: dict[str, int], size: int) -> bytes:
    """A zstandard dictionary of up to `size` bytes trained on words, each a sample as often as it says; too few: all of them.

    Training takes the best segment of each run of samples, so they are mixed, by checksum.
    """
    order = sorted((zlib.crc32(f"{i}:{w}".encode()), w) for w, times in words.items() for i in range(times))
    samples = [f" {w} ".encode() for _, w in order]
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:  # zstandard trains on no fewer than some hundred bytes
        return "".join(f" {w} " for w in sorted(words)).encode()[-size:]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    near: int = NEAR[0]
    weights: tuple[float, ...] = ()  # bias and one for each feature; empty: `share` is every score
    centre: tuple[float, ...] = (0.0,) * FEATURES
    scale: tuple[float, ...] = (1.0,) * FEATURES
    share: float = 0.0

    def scores(self, measured: np.ndarray) -> np.ndarray:
        """Scores from what `Distances.measured` tells."""
        if not self.weights:
            return np.full(len(measured), self.share)
        x = (features(measured, self.near) - np.array(self.centre)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


class Distances:
    """Window distances under a pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.coders = []
        for content in (toxic + ordinary, ordinary):
            d = zstandard.ZstdCompressionDict(SENTINEL + b"\n" + content + b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=_parameters())
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=_parameters()))

    @staticmethod
    def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of all texts, a row each behind the sentinel, and how many each text has; a blank text has none."""
        plain = [b" " + t.translate(_SPACED) for t in texts]
        counts = np.array([-(-len(p) // STEP) if p.strip() else 0 for p in plain], np.int64)
        joined = np.frombuffer(b"".join(p.ljust(n * STEP + WINDOW - STEP) for p, n in zip(plain, counts.tolist(), strict=True) if n) + b" " * WINDOW, np.uint8)
        # A text's windows begin at every STEP bytes of it; what is behind the last one belongs to the next text.
        begins = np.cumsum(counts * STEP + (counts > 0) * (WINDOW - STEP)) - (counts * STEP + (counts > 0) * (WINDOW - STEP))
        total = int(counts.sum())
        within = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(begins, counts) + within * STEP
        out = np.empty((total, len(SENTINEL) + WINDOW), np.uint8)
        out[:, : len(SENTINEL)] = np.frombuffer(SENTINEL, np.uint8)
        out[:, len(SENTINEL) :] = np.lib.stride_tricks.sliding_window_view(joined, WINDOW)[starts]
        return out, counts

    def of(self, texts: list[bytes], at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """For each window of each text, in order, how many bytes the toxic dictionary saves over the ordinary one; windows of each text."""
        rows, counts = self.windows(texts)
        found = [np.zeros(0, np.int64)]
        for i in range(0, len(rows), at_once):
            part = rows[i : i + at_once]
            place = np.stack([np.arange(len(part)) * part.shape[1], np.full(len(part), part.shape[1])], 1).astype(np.uint64)
            source = zstandard.BufferWithSegments(part.tobytes(), place.tobytes())
            toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(source)), np.int64, len(part)) for c in self.coders)
            found.append(ordinary - toxic)
        return np.concatenate(found), counts

    def measured(self, texts: pa.Array) -> np.ndarray:
        """Of each text: windows, excess of the distances over 1, the greatest (0 at least), and windows at each threshold."""
        d, counts = self.of(pc.utf8_lower(texts).cast(pa.large_binary()).to_pylist())
        out = np.zeros((len(texts), 3 + len(NEAR)))
        out[:, 0] = counts
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            out[full, 1] = np.add.reduceat(np.maximum(d - 1, 0), starts)
            out[full, 2] = np.maximum(np.maximum.reduceat(d, starts), 0)
            for i, t in enumerate(NEAR):
                out[full, 3 + i] = np.add.reduceat((d >= t).astype(np.int64), starts)
        return out


def features(measured: np.ndarray, near: int) -> np.ndarray:
    n, at = measured[:, 0], measured[:, 3 + NEAR.index(near)]
    return np.stack([measured[:, 1] / (n + 3), measured[:, 2], at / np.maximum(n, 1), np.log1p(at)], 1)


def _measured(docs: DataFrame, toxic: bytes, ordinary: bytes) -> DataFrame:
    """`docs` (columns, text) with what its distances tell in place of the text."""
    rest = [f for f in docs.schema if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("measured", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(toxic, ordinary)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = pa.array(distances.measured(texts_of(batch, "text")).tolist(), arrow.field("measured").type)
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(arrow.field(f.name).type) for f in rest] + [found], schema=arrow)

    return docs.mapInArrow(measure, schema)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    beta = np.zeros(a.shape[1])
    pull = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + pull + 1e-9 * np.eye(len(beta)), a.T @ (w * (y - p)) - pull @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train dictionaries and calibration on a bounded sample of `docs` (doc_id, text) with `labels` (doc_id, toxic)."""
    learnt = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learnt = written(learnt.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0), "labels")
    n_all = {r["toxic"]: r["n"] for r in learnt.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = n_all.get(1, 0) / max(1, sum(n_all.values()))
    key = F.md5(F.col("doc_id").cast("string"))
    first = lambda kind, most: learnt.where(F.col("toxic") == kind).orderBy(key, "doc_id").limit(most)
    chosen = first(1, SAMPLE_TOXIC).union(first(0, SAMPLE_OTHER))
    # 4,500 ids at most: the one broadcast, bounded by SAMPLE_TOXIC + SAMPLE_OTHER.
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.when(F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string"))) % 2 == 0, 0).otherwise(1).alias("half"), "text")
    sample = written(sample, "labelled")
    toxic_words, ordinary_words = _words(sample.where("half = 0"))
    if not toxic_words or not ordinary_words:
        return Model(b"", b"", share=share)
    toxic = trained(toxic_words, TOXIC_BYTES)
    ordinary = trained({w: 1 + int(math.log2(n)) for w, n in ordinary_words.items()}, ORDINARY_BYTES)
    rows = _measured(sample.where("half = 1").select("toxic", "text"), toxic, ordinary).collect()  # of the sample's half
    m, y = np.array([r["measured"] for r in rows]).reshape(-1, 3 + len(NEAR)), np.array([r["toxic"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(toxic, ordinary, share=share)
    weight = np.where(y == 1, n_all[1] / y.sum(), n_all[0] / (len(y) - y.sum()))
    weight *= len(y) / weight.sum()
    best = None
    for near in NEAR:
        x = features(m, near)
        centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        beta = _logistic((x - centre) / scale, y, weight)
        odds = np.clip(beta[0] + (x - centre) / scale @ beta[1:], -30, 30)
        loss = float((weight * np.log1p(np.exp(np.where(y == 1, -odds, odds)))).sum())
        if best is None or loss < best[0]:
            best = loss, Model(toxic, ordinary, near, tuple(beta), tuple(centre), tuple(scale), share)
    return best[1]


def _words(sample: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Documents by word: of the words by which toxic text of `sample` (toxic, text) stands out, and of ordinary text's words in two documents or more.

    A word stands out if one of its beginnings, or it itself, does so by `STANDS_OUT` standard deviations of what the class would hold
    of it by chance. It counts once behind each other word: copies of a text, or of a part of it, say nothing new.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    sample = written(sample.select("toxic", found.alias("_w")), "sample-words")
    docs = sample.select("toxic", F.explode(F.array_distinct("_w")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("toxic_docs"), F.sum(1 - F.col("toxic")).alias("other_docs"))
    pairs = F.zip_with("_w", F.concat(F.array(F.lit("")), F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0)))), lambda w, p: F.struct(w.alias("word"), p.alias("prior")))
    times = sample.select("toxic", F.explode(F.array_distinct(pairs)).alias("x")).select("toxic", "x.word", "x.prior").distinct().groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    words = written(docs.join(times, "word"), "words")
    whole = F.concat(F.lit(" "), "word", F.lit(" "))
    begins = F.concat(F.transform(F.sequence(F.lit(4), F.greatest(F.least(F.length("word") + 1, F.lit(12)), F.lit(4))), lambda n: F.left(whole, n)), F.array(whole))
    spans = words.select("a", "b", F.explode(F.array_distinct(begins)).alias("span")).groupBy("span").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = words.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not n["a"] or not n["b"]:
        return {}, {}
    part, both = n["a"] / (n["a"] + n["b"]), F.col("a") + F.col("b")
    stands_out = (F.col("a") >= LEAST_TIMES) & (F.col("a") - both * part >= STANDS_OUT * F.sqrt(both * part * (1 - part))) & (F.col("a") > 2 * F.col("b") * (n["a"] / n["b"]))
    toxic = words.where("a > 0").select("word", F.col("toxic_docs").alias("n"), F.explode(F.array_distinct(begins)).alias("span")).join(spans.where(stands_out).select("span"), "span", "left_semi").select("word", "n").distinct()
    top = lambda df: {r["word"]: r["n"] for r in df.orderBy(F.col("n").desc(), "word").limit(TRAINED_WORDS).collect()}
    return top(toxic), top(words.where("other_docs >= 2").select("word", F.col("other_docs").alias("n")))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with a column for the score of its `text`."""
    free(docs, name)
    columns, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model.toxic, model.ordinary)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = pa.array(model.scores(distances.measured(texts_of(batch, "text"))))
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in columns] + [found], schema=arrow)

    return docs.mapInArrow(score, schema)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs` (doc_id, text)."""
    found = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that score under 0.5."""
    return with_score(docs, model, "_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
