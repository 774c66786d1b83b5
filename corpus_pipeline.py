"""A corpus pipeline of five training-data operators; each stage works on all that the one before has kept.

1. toxicity: documents that the compression-distance classifier rejects go.
2. near_duplicates: of each component of the 5-word-shingle Jaccard join (0.75), the document with the least doc_id stays.
3. personal_data: spans of personal data are replaced by their kind in brackets; n_chars follows the text.
4. mixing: each document is repeated as often as the mix takes it; a part of a document counts if it is half or more. A
   document that it does not take leaves the corpus.
5. packing: the documents' pieces with sequence and offset, of at most `MOST_DOCS` documents a sequence. A cost limit that leaves room for
   a whole piece of 2048 tokens never binds, as the squares of lengths add up to no more than the square of their sum; none is given.

A document that the mix takes twice is two rows with one doc_id; packing packs each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import jaccard, mixing, packing, pii, toxicity
from gleaner.llm.common import table, written

MOST_DOCS = 64
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5; null and empty texts score like texts without distance, without labels all rows stay or go alike."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component; rows without words all stay."""
    return jaccard.without_duplicates(docs).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; null texts stay null, with a null n_chars."""
    return pii.without_spans(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; a null source is a source of its own."""
    return mixing.repeated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows; a null text is its end token alone, an empty table gives no rows."""
    return packing.pack(docs, max_docs=MOST_DOCS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Compression distances and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each on the rows that the one before has returned."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, name) if name != STAGES[-1][0] else docs
    return docs
