"""Edit-aware token counts.

A document's count tree has leaves of consecutive pre-token pieces (see `tokens`) with their characters and tokens; every node
above sums up to `FAN` below it. An edit finds its leaves from the top, takes their text with the change in it, and
re-encodes that alone, with a neighbouring leaf as context wherever the changed text no longer begins or ends where a text
may be cut. Only the sums above changed leaves are updated. The count is that of a full re-encoding.

Null or empty text: no leaves, 0 tokens. Edits (start, stop, text) are applied in order, each to the text the ones before
have left; starts and stops beyond it are clamped, null parts of an edit count as 0 and empty. No edits: the count stays.
Repeated rows: each has its tree. A very long text is a tree of as many leaves as it needs. Empty table: no rows. Extra columns are carried along; `leaves` and the names of the counts must
be free, or ValueError says which is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free, slices, table, written
from .tokens import SPECIAL, Encoder, default_tokenizer

LEAF_PIECES, FAN = 64, 8
LEAVES = T.ArrayType(T.StructType([T.StructField("chars", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))
EDITED = "tokens_before long, tokens_after long, chars_after long, edits int, reencoded_chars long"


class CountTree:
    """Sums of characters and tokens over the leaves of one document, and the document's text."""

    def __init__(self, text: str, leaves: list[tuple[int, int]]) -> None:
        self.text = text
        self.levels = [[list(x) for x in leaves] or [[0, 0]]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([[sum(x[0] for x in below[i : i + FAN]), sum(x[1] for x in below[i : i + FAN])] for i in range(0, len(below), FAN)])

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1]

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one behind the end) and where it begins."""
        at, begin = 0, 0
        for level in self.levels[-2::-1]:
            at *= FAN
            while at + 1 < min(len(level), at - at % FAN + FAN) and begin + level[at][0] <= char:
                begin += level[at][0]
                at += 1
        return at, begin

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        more = chars - self.levels[0][leaf][0], tokens - self.levels[0][leaf][1]
        for level in self.levels:
            level[leaf][0] += more[0]
            level[leaf][1] += more[1]
            leaf //= FAN

    def edit(self, start: int, stop: int, said: str, count) -> int:
        """Replace text[start:stop]; `count` gives the tokens of a text. Returns the characters that were re-encoded."""
        size = len(self.text)
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        leaves = self.levels[0]
        first, begin = self.leaf_at(start)
        last, end = self.leaf_at(stop)
        end += leaves[last][0]
        whole = self.text[:start] + said + self.text[stop:]
        grown = len(said) - (stop - start)
        while first > 0 and not may_cut(whole, begin):
            first -= 1
            begin -= leaves[first][0]
        while last + 1 < len(leaves) and not may_cut(whole, end + grown):
            last += 1
            end += leaves[last][0]
        region = whole[begin : end + grown]
        self.text = whole
        self.update(first, len(region), count(region))
        for leaf in range(first + 1, last + 1):
            self.update(leaf, 0, 0)
        return len(region)


def may_cut(text: str, at: int) -> bool:
    """Whether the text's pre-tokens are those of its two parts: before one space between characters that aren't white space."""
    if at <= 0 or at >= len(text) - 1 or text[at] != " " or text[at - 1].isspace() or text[at + 1].isspace():
        return False
    near = text[max(0, at - len(SPECIAL)) : at + 1 + len(SPECIAL)]
    return SPECIAL not in near


def with_leaves(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """`docs` with its trees' lowest level in column `leaves`."""
    free(docs, "leaves")
    path, columns = tokenizer or default_tokenizer(), docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("leaves", LEAVES)])
    arrow = to_arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for whole in batches:
            for batch in slices(whole, text, 8 << 20):
                ends, piece, said, tokens = encode.counts(batch.column(text))
                chars = np.array([len(s) for s in said], np.int64)
                # A leaf begins with each text and after every LEAF_PIECES pieces of it.
                of = np.repeat(ends[:-1], np.diff(ends))
                heads = np.flatnonzero((np.arange(len(piece)) - of) % LEAF_PIECES == 0)
                sums = [np.add.reduceat(x[piece], heads) if len(heads) else np.zeros(0, np.int64) for x in (chars, tokens)]
                values = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in sums], fields=list(arrow.field("leaves").type.value_type))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(heads, ends).astype(np.int32)), values, type=arrow.field("leaves").type)
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(arrow.field(c).type) for c in columns] + [lists], schema=arrow)

    return docs.mapInArrow(build, schema)


def edited(trees: DataFrame, tokenizer: str | None = None, text: str = "text", edits: str = "edits", keep: bool = False) -> DataFrame:
    """Counts before and after `edits` (array of structs start, stop, text), with the text, leaves and edits left out.

    keep: with the edited text and its leaves, in which regions that edits touched are one leaf, to be stored and edited again.
    """
    path = tokenizer or default_tokenizer()
    rest = [f for f in trees.schema if f.name not in (text, "leaves", edits)]
    added = T._parse_datatype_string(EDITED)
    free(trees.drop(text, "leaves", edits), *added.names)
    kept = [T.StructField(text, T.StringType()), T.StructField("leaves", LEAVES)] if keep else []
    schema = T.StructType([*rest, *kept, *added])
    arrow = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        count = lambda s: len(encode.encode([s])[0]) if s else 0
        for whole in batches:
            for batch in slices(whole, text):
                rows = []
                for said, leaves, wanted in zip(*(batch.column(c).to_pylist() for c in (text, "leaves", edits)), strict=True):
                    tree = CountTree(said or "", [(x["chars"], x["tokens"]) for x in leaves or []])
                    before = tree.tokens
                    work = sum(tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "", count) for e in wanted or [] if e)
                    tree_now = [tree.text if said is not None or tree.text else None, [{"chars": c, "tokens": t} for c, t in tree.levels[0] if c]] if keep else []
                    rows.append((*tree_now, before, tree.tokens, len(tree.text), len(wanted or []), work))
                columns = [pa.array(list(c), arrow.field(len(rest) + i).type) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(arrow.field(f.name).type) for f in rest] + columns, schema=arrow)

    return trees.mapInArrow(apply, schema)


def with_edits(docs: DataFrame, edits: int = 3, longest: int = 40) -> DataFrame:
    """`docs` with edits that its own rows give: parts of the text, by checksums of doc_id, replaced by other parts of it."""
    size = F.length(F.coalesce("text", F.lit("")))
    draw = lambda k, n: F.pmod(F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(k))), n + 1).cast("int")

    def one(k: int) -> Column:
        start = draw(f"{k}:at", size)
        return F.struct(start.alias("start"), (start + draw(f"{k}:long", F.lit(longest))).alias("stop"), F.substring("text", draw(f"{k}:from", size) + 1, draw(f"{k}:size", F.lit(longest))).alias("text"))

    free(docs, "edits")
    return docs.withColumn("edits", F.array(*[one(k) for k in range(edits)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trees = written(with_leaves(docs), "trees")  # kept: later edits find them
    return edited(with_edits(trees))
