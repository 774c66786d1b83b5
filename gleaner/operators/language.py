"""Languages of texts by whole character profiles.

Runs of one to `LONGEST` characters of lower-cased texts are hashed to `buckets` counters for each language; all runs of all texts count, none is cut.
Tasks count into a table of their own, tables are summed level by level, and the log shares, `buckets` numbers a language whatever the corpus, are
broadcast and looked up by batches of texts: no run of a text is ever moved. Scores are mean log shares; how sharply they decide, the
temperature, is chosen on held-out rows (by a hash of the text) by the likelihood of their labels.

Texts of under `FEWEST_LETTERS` characters, null and empty ones, and those whose confidence is under the floor, are und; short ones have no confidence. Ties go to
the first language in order. Without labelled texts there are no languages and all is und. Very long texts are rows as others. Repeated rows count each.
Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import FEWEST_LETTERS
from .embedding import _summed

LONGEST = 3
#: Added to every counter, and temperatures to choose from.
PRIOR = 0.1
TEMPERATURES = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
#: Characters that are looked up at once.
CHARS = 1 << 19
MOST_LANGUAGES = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Profiles:
    """languages; logs: languages x buckets, log shares; temperature."""

    languages: list[str]
    logs: np.ndarray
    temperature: float = 1.0


def runs(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of the texts, and the text of each. White space counts as one space, and stands at both ends."""
    plain = [f" {' '.join(t.lower().split())} " for t in texts]
    size = np.array([len(p) for p in plain], np.int64)
    chars = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    found, whose, h = [], [], np.zeros(len(chars), np.uint64)
    for n in range(LONGEST):
        last = len(chars) - n
        if last <= 0:
            break
        h = (h[:last] * np.uint64(1_000_003)) ^ (chars[n:] + np.uint64(n + 1))
        mixed = h * _ODD
        inside = owner[:last] == owner[n:]
        found.append(((mixed ^ (mixed >> np.uint64(29))) * _ODD >> np.uint64(40))[inside] % np.uint64(buckets))
        whose.append(owner[:last][inside])
    return (np.concatenate(found).astype(np.int64), np.concatenate(whose)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Spans of consecutive texts of about `CHARS` characters, or one text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _held_out(text_col: str, share: float):
    return F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1000)) < int(1000 * share)


def profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 18, held_out: float = 0.1) -> Profiles:
    """Profiles of the languages of `df`'s labelled texts, with a temperature chosen on held-out ones."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_l"))
    names = sorted(r["_l"] for r in rows.select("_l").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not names:
        return Profiles([], np.zeros((0, buckets)))
    number, kind = {n: i for i, n in enumerate(names)}, "part int, block int, m binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), buckets))
        for batch in batches:
            texts, langs = batch.column("_t").to_pylist(), np.array([number[x] for x in batch.column("_l").to_pylist()], np.int64)
            for i, j in _pieces(texts):
                bucket, owner = runs(texts[i:j], buckets)
                total += np.bincount(langs[i:j][owner] * buckets + bucket, minlength=total.size).reshape(total.shape)
        part = TaskContext.get().partitionId()
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tobytes()])], names=["part", "block", "m"])

    train = rows.where(~_held_out("_t", held_out))
    got = _summed(train.mapInArrow(count, kind), max(1, train.rdd.getNumPartitions()), kind).collect()  # a row for each language
    counts = np.zeros((len(names), buckets))
    for r in got:
        counts[r["block"]] = np.frombuffer(r["m"])
    counts += PRIOR
    made = Profiles(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
    # Held-out rows choose the temperature: the sums of their log likelihoods under each.
    some = detect(rows.where(_held_out("_t", held_out)).withColumnRenamed("_t", "text"), made, "text", 0.0, scores=True)
    told = some.where("scores IS NOT NULL").select(F.col("_l"), F.transform("scores", lambda s: s.cast("double")).alias("s"))
    own = F.get("s", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_l")).cast("int") - 1)
    top = F.array_max("s")
    best = told.agg(*_losses(own, top)).first()
    values = [best[f"l{i}"] for i in range(len(TEMPERATURES))]
    if all(v is not None for v in values):
        made.temperature = TEMPERATURES[int(np.argmax(values))]
    return made


def _losses(own, top) -> list:
    """Mean log likelihood of the labels under each temperature."""

    def one(i: int, t: float):
        total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max("s")) * t))
        return F.avg((own - top) * t - F.log(total)).alias(f"l{i}")

    return [one(i, t) for i, t in enumerate(TEMPERATURES)]


def detect(df: DataFrame, known: Profiles, text_col: str = "text", floor: float = 0.80, scores: bool = False) -> DataFrame:
    """`df` with language and confidence; with `scores`, the scores of all languages instead. The profiles' size is bounded by languages and buckets."""
    added = [T.StructField("scores", T.ArrayType(T.FloatType()))] if scores else [T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())]
    taken = {c.lower() for c in df.columns} & {f.name for f in added}
    if taken:
        raise ValueError(f"the input has columns named {', '.join(sorted(taken))}")
    kind = T.StructType([*df.schema.fields, *added])
    schema, shared = to_arrow_schema(kind), df.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        buckets, languages = p.logs.shape[1], len(p.languages)
        by_bucket = np.ascontiguousarray(p.logs.T)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            s = np.zeros((len(texts), languages))
            for i, j in _pieces(texts) if languages else ():
                bucket, owner = runs(texts[i:j], buckets)
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                # Runs of one length lie together, so a text has up to LONGEST stretches.
                part = np.add.reduceat(by_bucket[bucket], starts, axis=0, dtype=float) if len(starts) else np.zeros((0, languages))
                np.add.at(s, i + owner[starts], part)
                s[i:j] /= np.maximum(np.bincount(owner, minlength=j - i), 1)[:, None]
            short = np.array([len(t.strip()) < FEWEST_LETTERS for t in texts], bool) | (languages == 0)
            if scores:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x else row.astype(np.float32) for x, row in zip(short, s, strict=True)], schema.field("scores").type)], schema=schema)
                continue
            if languages:
                e = np.exp((s - s.max(axis=1, keepdims=True)) * p.temperature)
                sure, best = e.max(axis=1) / e.sum(axis=1), s.argmax(axis=1)
            else:
                sure, best = np.zeros(len(texts)), np.zeros(len(texts), int)
            language = ["und" if x or c < floor else p.languages[b] for x, c, b in zip(short, sure, best, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(language, pa.string()), pa.array([None if x else float(c) for x, c in zip(short, sure, strict=True)], pa.float64())], schema=schema)

    return df.mapInArrow(work, kind)
