"""Interleaved document sequences with media columns.

A page of HTML becomes an ordered sequence of items, each a piece of text or a reference to media with its
caption. References name payloads by digest; payloads live in a media table that keeps them losslessly as 8-bit
grey samples (binary PGM, 64 to a row), and a join on the digest resolves them without moving their bytes:
payloads are read where they are stored, and only their digests and features are shuffled.

Null html: no items. A reference whose digest the media table lacks stays, unresolved (null features).
Copies of a payload share a digest and so their features. Very long pages and payloads are rows as others. Empty tables of pages
or of media: no rows, or none that resolves. Extra columns of the input are carried along under
their own names; the operator's own columns have to be free in it, or ValueError says which is not.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free, slices, table, written

WIDTH = 64
ITEM = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("caption", T.StringType()),
    ]
)
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_MEDIA = {"img", "video", "audio", "source", "embed"}
_BLOCK = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "figure", "figcaption", "header", "footer", "nav", "blockquote", "pre", "td", "th", "title", "body"}
_HIDDEN = {"script", "style", "noscript", "template"}


class _Items(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None  # where the items of the open figure begin
        self.hidden = 0

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.items.append({"kind": "text", "text": said, "digest": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        if tag in _BLOCK or tag in _MEDIA:
            if self.caption is None:
                self.flush()
            else:
                self.caption.append(" ")
        if tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in _MEDIA:
            a = {k: v or "" for k, v in reversed(attrs)}
            if a.get("src"):
                said = " ".join(a.get("alt", "").split())
                self.items.append({"kind": "media", "text": None, "digest": a["src"].removeprefix("urn:sha256:"), "caption": said or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure or 0 :] if self.figure is not None else []:
                if item["kind"] == "media" and said:
                    item["caption"] = said
        elif tag in _BLOCK:
            self.flush()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[dict]:
    """The ordered items of a page; a figure's caption goes to each of its media."""
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    if parser.caption:
        parser.text += parser.caption
    parser.flush()
    return [{"position": i} | x for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with column `items` (ordered structs position, kind, text, digest, caption) in place of `html`."""
    free(pages, "items")
    rest = [c for c in pages.columns if c != html]
    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField("items", T.ArrayType(ITEM))])
    arrow = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html):
                found = pa.array([items_of(x) for x in batch.column(html).to_pylist()], arrow.field("items").type)
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in rest] + [found], schema=arrow)

    return pages.mapInArrow(parse, schema)


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty) with bytes 0 up to a positive multiple of 64."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = (F.greatest(F.ceil(F.octet_length(raw) / F.lit(WIDTH)), F.lit(1)) * WIDTH).cast("int")
    return F.rpad(raw, size, F.lit(bytearray(b"\0")))


def as_image(payload: Column) -> Column:
    """A payload, a multiple of 64 bytes long, as a binary PGM of 8-bit grey samples."""
    head = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), payload)


def samples_of(image: bytes) -> np.ndarray:
    """The samples of a binary PGM, a row of the picture in each row."""
    kind, shape, most, data = image.split(b"\n", 3)
    wide, high = map(int, shape.split())
    if kind != b"P5" or most != b"255" or len(data) != wide * high:
        raise ValueError("not an 8-bit binary PGM")
    return np.frombuffer(data, np.uint8).reshape(high, wide)


def feature_of(samples: np.ndarray) -> str:
    """Shape, mean, deviation and a 64-bit average hash over the picture's columns."""
    columns = samples.mean(axis=0, dtype=np.float64)
    bits = int("".join("1" if x else "0" for x in columns > columns.mean()), 2)
    return f"{samples.shape[1]}x{samples.shape[0]} mean={samples.mean(dtype=np.float64):.4f} std={samples.std(dtype=np.float64):.4f} ahash={bits:016x}"


def read_features(media: DataFrame) -> DataFrame:
    """Features of each stored payload, one row for each digest. `media`: columns digest, media."""
    schema = to_arrow_schema(T._parse_datatype_string(FEATURES))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
                raw = image.as_buffer()
                samples = samples_of(bytes(raw))
                payload = samples.tobytes()
                rows.append({"digest": digest, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": raw.size, "media_sha256": hashlib.sha256(raw).hexdigest(), "feature": feature_of(samples)})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    each = media.mapInArrow(read, FEATURES)
    return each.groupBy("digest").agg(*[F.first(c).alias(c) for c in each.columns if c != "digest"])


def resolved(sequence: DataFrame, features: DataFrame) -> DataFrame:
    """A row for each media item of each sequence, in place, with the features its digest resolves to."""
    free(sequence, "n_items", "caption", *features.columns, "position", "_n", "_item")
    items = sequence.withColumn("_n", F.size("items")).withColumn("_item", F.explode(F.filter("items", lambda x: x["kind"] == "media")))
    refs = items.select(*[c for c in sequence.columns if c != "items"], F.col("_n").alias("n_items"), F.col("_item.position").alias("position"), F.col("_item.caption").alias("caption"), F.col("_item.digest").alias("digest"))
    return refs.join(features, "digest", "left")


def as_pages(docs: DataFrame) -> DataFrame:
    """Each document as a page of HTML whose figure refers to the document's text as media by digest."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))
    html = F.concat(F.lit("<article><p>Document "), name, F.lit('</p><figure><img src="urn:sha256:'), F.sha2(padded(F.col("text")), 256), F.lit('"><figcaption>'), safe(F.coalesce("source", F.lit(""))), F.lit("</figcaption></figure></article>"))
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), html.alias("html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    payloads = docs.select(padded(F.col("text")).alias("payload"))
    media = written(payloads.select(F.sha2("payload", 256).alias("digest"), as_image(F.col("payload")).alias("media")), "media")
    return resolved(sequences(as_pages(docs)), read_features(media)).drop("digest")
