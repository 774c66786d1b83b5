"""Exact deduplication of texts against immutable snapshots.

Texts are equal when they are so after all white space (U+0020, U+0009 to U+000D) is deleted. Documents arrive in batches. A batch's own
duplicates are grouped first: copies that lie in one slice of a task become one row there, so that a frequent text sends a row for
each slice, not for each document; then all rows of a digest meet in its bucket, where texts are compared whole. The batch's classes are
stored in exact buckets (a bucketed table, sorted by digest) and never change: a snapshot. For each cell of a snapshot's digests a static
binary-fuse filter is built. A later batch's digests are screened by the filters, cell by cell; what a filter lets through joins
the snapshot's exact buckets, digest with digest and text with text, without moving the stored texts.
A class is one with the class of the earliest snapshot that holds its text, and gets its size and the row that stays from all of them.

Of equal texts, the row of most code points in the original text stays, then the smallest id (null: last). Different texts of one digest
stay apart, whatever the digest's width. Null text: empty; empty and blank texts are all equal. Rows repeated with the id that
stays are all marked kept. Very long texts are rows as others. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fuse
from .common import give_back, new_folder, slices, table, tasks, written

BLANK = b" \t\n\x0b\x0c\r"
#: Keys of one filter, and bytes of text of one exact bucket, about.
CELL_KEYS = 1 << 20
BUCKET_BYTES = 64 << 20
DIGESTS = "doc_id long, part int, chars long, bytes long, sha binary"
TEXTS = "digest binary, text binary, n long, chars long, keep_id long"
FILTERS = "cell int, seed int, segment int, starts int, cells binary"


def _plain(text: str | None) -> bytes:
    return (text or "").encode().translate(None, BLANK)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, part, code points, bytes and SHA-256 of each text (doc_id, part, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                plain = [_plain(t) for t in texts]
                columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in plain], pa.int64()), pa.array([hashlib.sha256(p).digest() for p in plain], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *columns], names=["doc_id", "part", "chars", "bytes", "sha"])

    return docs.select("doc_id", "part", "text").mapInArrow(work, DIGESTS)


def collapsed(docs: DataFrame, width: int = 32) -> DataFrame:
    """A row for each text of each slice of a task: digest, text without white space, how many rows have it, and of the one that stays code points and id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 16 << 20):
                found: dict[bytes, list] = {}
                for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    # Most code points first, then the smallest id, null ids last.
                    rank = (-len(text or ""), name is None, name or 0)
                    held = found.setdefault(_plain(text), [0, rank])
                    held[0] += 1
                    held[1] = min(held[1], rank)
                columns = [[hashlib.sha256(p).digest()[:width] for p in found], list(found), [h[0] for h in found.values()], [-h[1][0] for h in found.values()], [None if h[1][1] else h[1][2] for h in found.values()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["digest", "text", "n", "chars", "keep_id"])
                del found, columns
                give_back()

    return docs.select("doc_id", "text").mapInArrow(work, TEXTS)


def _best() -> Column:
    """The greatest of these among equal texts is the row that stays; a bitwise complement turns ids' order around without overflow."""
    return F.struct("chars", F.bitwise_not("keep_id").alias("back"))


@dataclass
class Snapshot:
    """classes: digest, twin (numbers different texts of one digest), text, n, chars, keep_id, in exact buckets by digest; filters: see FILTERS."""

    classes: DataFrame
    filters: DataFrame
    cells: int


def _cell(cells: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(cells)).cast("int")


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(d[:8].ljust(8, b"\0") for d in raw), "<u8").astype(np.uint64)


def filters(found: DataFrame, cells: int) -> DataFrame:
    """The binary-fuse filter of each cell of the distinct digests of `found`."""
    kinds = pa.schema([("cell", pa.int32()), ("seed", pa.int32()), ("segment", pa.int32()), ("starts", pa.int32()), ("cells", pa.binary())])

    def work(rows: pa.Table) -> pa.Table:
        made = fuse.build(_keys(rows.column("digest")))
        return pa.table([[rows.column("cell")[0].as_py()], [made.seed], [made.segment], [made.starts], [made.cells.tobytes()]], schema=kinds)

    return found.select("digest", _cell(cells).alias("cell")).groupBy("cell").applyInArrow(work, FILTERS)


def snapshot(texts: DataFrame, buckets: int) -> Snapshot:
    """Group `texts` (see `collapsed`) and store their classes with their filters."""
    spark = texts.sparkSession
    grouped = texts.repartition(buckets, "digest").groupBy("digest", "text").agg(F.sum("n").alias("n"), F.max(_best()).alias("best"))
    twin = F.row_number().over(Window.partitionBy("digest").orderBy("text")) - 1
    rows = grouped.select("digest", twin.alias("twin"), "text", "n", F.col("best.chars").alias("chars"), F.bitwise_not("best.back").alias("keep_id"))
    name, path = f"gleaner_snapshot_{uuid.uuid4().hex}", new_folder(spark, "snapshot")
    rows.write.bucketBy(buckets, "digest").sortBy("digest").option("path", path).option("compression", "zstd").saveAsTable(name)

    def forget() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  the session has ended, and its catalogue with it
            pass

    atexit.register(forget)
    classes = spark.table(name)
    cells = max(1, -(-classes.count() // CELL_KEYS))
    return Snapshot(classes, written(filters(classes, cells), "filters"), cells)


def screened(incoming: DataFrame, against: Snapshot) -> DataFrame:
    """The digests of `incoming` (digest) that the filters of a snapshot let through: all that it holds, and 1 in 256 others."""

    def work(rows: pa.Table, held: pa.Table) -> pa.Table:
        if not rows.num_rows or not held.num_rows:
            return rows.select(["digest"]).slice(0, 0)
        f = {c: held.column(c)[0].as_py() for c in ("seed", "segment", "starts", "cells")}
        known = fuse.Fuse(f["seed"], f["segment"], f["starts"], np.frombuffer(f["cells"], np.uint8)).has(_keys(rows.column("digest")))
        return rows.select(["digest"]).filter(pa.array(known))

    dealt = incoming.select("digest", _cell(against.cells).alias("cell"))
    return dealt.groupBy("cell").cogroup(against.filters.groupBy("cell")).applyInArrow(work, "digest binary")


def known(batch: Snapshot, against: Snapshot) -> DataFrame:
    """digest, twin, old_twin: the classes of a batch that a snapshot holds."""
    through = written(screened(batch.classes.select("digest"), against).distinct(), "positives")
    mine = batch.classes.join(through, "digest", "left_semi").select("digest", "twin", "text")
    theirs = against.classes.join(through, "digest", "left_semi").select(F.col("digest"), F.col("twin").alias("old_twin"), F.col("text").alias("old_text"))
    # Not an equality, which would become a key of the join and have the stored buckets dealt anew.
    return mine.join(theirs, "digest").where(F.col("text").between(F.col("old_text"), F.col("old_text"))).select("digest", "twin", "old_twin")


def resolved(stores: list[Snapshot]) -> DataFrame:
    """part, digest, twin, keep_id and group_size of every class of every store, classes of one text taken together."""
    rows = []
    for part, store in enumerate(stores):
        own = store.classes.select(F.lit(part).alias("part"), "digest", "twin", "n", "chars", "keep_id")
        if part:
            links = None
            for old in range(part):
                some = known(store, stores[old]).select("digest", "twin", F.struct(F.lit(old).alias("part"), F.col("old_twin").alias("twin")).alias("root"))
                links = some if links is None else links.unionByName(some)
            first = links.groupBy("digest", "twin").agg(F.min("root").alias("root"))
            own = own.join(first, ["digest", "twin"], "left")
        else:
            own = own.withColumn("root", F.lit(None).cast("struct<part:int,twin:int>"))
        rows.append(own.withColumn("root", F.coalesce("root", F.struct(F.col("part"), F.col("twin")))))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every = written(every, "classes")
    whole = every.groupBy("digest", "root").agg(F.sum("n").alias("group_size"), F.max(_best()).alias("best"))
    return every.select("part", "digest", "twin", "root").join(whole, ["digest", "root"]).select("part", "digest", "twin", F.bitwise_not("best.back").alias("keep_id"), "group_size")


def deduplicated(docs: DataFrame, arrivals: int = 2, width: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of `docs` (doc_id, text), which arrive in `arrivals` batches by hash of their id.

    width: bytes of the SHA-256 that digests keep; with few, more texts are compared that differ.
    """
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("part", part)
    each = written(digests(docs), "digests").withColumn("digest", F.substring("sha", 1, width))
    size = each.agg(F.sum("bytes")).first()[0] or 0
    buckets = tasks(spark, -(-size // arrivals), BUCKET_BYTES)
    stores = [snapshot(collapsed(docs.where(F.col("part") == i), width), buckets) for i in range(arrivals)]
    facts = written(resolved(stores), "resolved")
    several = facts.where("twin > 0").select("part", "digest").distinct()
    rows = each.withColumn("twin", F.lit(0)).select("doc_id", "part", "digest", "sha", "twin")
    if not several.isEmpty():
        rows = rows.join(several, ["part", "digest"], "left_anti").unionByName(_told_apart(docs, several, stores, width))
    got = rows.join(facts, ["part", "digest", "twin"])
    return got.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _told_apart(docs: DataFrame, several: DataFrame, stores: list[Snapshot], width: int) -> DataFrame:
    """The documents of digests that several texts share, with their text's number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                plain = [_plain(t) for t in batch.column("text").to_pylist()]
                sha = [hashlib.sha256(p).digest() for p in plain]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(plain, pa.binary()), pa.array(sha, pa.binary()), pa.array([s[:width] for s in sha], pa.binary())], names=["doc_id", "part", "text", "sha", "digest"])

    rows = docs.select("doc_id", "part", "text").mapInArrow(work, "doc_id long, part int, text binary, sha binary, digest binary").join(several, ["part", "digest"], "left_semi")
    texts = None
    for part, store in enumerate(stores):
        some = store.classes.select(F.lit(part).alias("part"), "digest", "text", "twin")
        texts = some if texts is None else texts.unionByName(some)
    return rows.join(texts, ["part", "digest", "text"]).select("doc_id", "part", "digest", "sha", "twin")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS p FROM documents),
g AS (SELECT p, count(*) AS n, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY p)
SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.p) AS text_sha256
FROM d JOIN g ON d.p = g.p
"""
