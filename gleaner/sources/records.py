"""Records of text files with their file and line, good rows and rejects from one lazy read.

Files are read in splits. A pass over them counts each split's lines and quotes; sums of the splits before give every line its number
in the file, and, for CSV, tell whether a split begins inside a quoted cell (an odd number of quotes lies before it), so that cells may
hold line ends and a file may be cut anywhere. What is broadcast is a row for each split of a file. No job runs before the result is asked for.

Lines end in LF or CRLF. A byte-order mark at a file's beginning doesn't count. Blank lines between records don't count, but keep their numbers.
Empty files have no records. `reason` is null for a good row; `checked` makes the first reject an error instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reviews import REVIEW

LINE = "file string, block long, local long, s0 long, s1 long, value string"
SPLIT = "file string, block long, lines long, quotes long, last0 long, last1 long"
BOM = "﻿"


def _numbers(batches: Iterator[pa.RecordBatch], quoted: bool) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Each run of lines of one split in a batch, with their numbers in the split and the last line at or before each that
    begins a record, if the split begins outside (0) or inside (1) of quotes; 0: none yet. Then what the split holds so far."""
    state: dict = {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        codes = files.dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        for i, j in zip([0, *cuts], [*cuts, n], strict=True):
            part = batch.slice(i, j - i)
            name = (part.column("file")[0].as_py(), int(part.column("block")[0].as_py()))
            if state.get("name") != name:
                state = {"name": name, "lines": 0, "quotes": 0, "last": [0, 0]}
            local = np.arange(state["lines"] + 1, state["lines"] + j - i + 1)
            marks = pc.count_substring(part.column("value"), '"').to_numpy(zero_copy_only=False).astype(np.int64) if quoted else np.zeros(j - i, np.int64)
            before = state["quotes"] + np.cumsum(marks) - marks
            starts = []
            for inside in (0, 1):
                own = np.where((before + inside) % 2 == 0, local, 0)
                own[0] = own[0] or state["last"][inside]
                starts.append(np.maximum.accumulate(own))
            state |= {"lines": int(local[-1]), "quotes": state["quotes"] + int(marks.sum()), "last": [int(s[-1]) for s in starts]}
            yield part, {"local": local, "s0": starts[0], "s1": starts[1], **state}


def records(spark: SparkSession, path: str, quoted: bool = False) -> DataFrame:
    """file, line (where the record begins, from 1) and record of each record that isn't blank. quoted: double quotes may hold line ends."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s in _numbers(batches, quoted):
            yield pa.RecordBatch.from_arrays([part.column("file"), part.column("block"), *[pa.array(s[c]) for c in ("local", "s0", "s1")], part.column("value")], names=["file", "block", "local", "s0", "s1", "value"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for _, s in _numbers(batches, quoted):
            seen[s["name"]] = (*s["name"], s["lines"], s["quotes"], *s["last"])
        kinds = (pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in seen.values()], k) for i, k in enumerate(kinds)], names=["file", "block", "lines", "quotes", "last0", "last1"])

    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.mapInArrow(count, SPLIT)
    splits = splits.withColumns({"before": F.coalesce(F.sum("lines").over(earlier), F.lit(0)), "inside": F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2})
    last = F.when(F.col("inside") == 0, F.col("last0")).otherwise(F.col("last1"))
    splits = splits.withColumn("_last", F.when(last > 0, F.col("before") + last)).withColumn("carried", F.max("_last").over(earlier))
    placed = lines.mapInArrow(number, LINE).join(F.broadcast(splits.select("file", "block", "before", "inside", "carried")), ["file", "block"])
    start = F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1"))
    line = F.col("before") + F.col("local")
    value = F.when(line == 1, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value"))
    placed = placed.select("file", line.alias("_at"), F.when(start > 0, F.col("before") + start).otherwise(F.coalesce("carried", F.lit(1))).alias("line"), value.alias("value"))
    if quoted:
        # A record's lines are few; each group is one record.
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n")
        placed = placed.groupBy("file", "line").agg(whole.alias("value"))
    return placed.select("file", "line", F.regexp_replace("value", "\r$", "").alias("record")).where(F.trim("record") != "")


def _reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """The first reason whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for when, reason in reversed(pairs):
        out = F.when(F.coalesce(when, F.lit(True)), reason).otherwise(out)
    return out


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """file, line, record, reason and the fields of a review, from lines of JSON. Rejects: what is no JSON object, has no id, or no stars from 1 to 5."""
    kind = T.StructType([*T._parse_datatype_string(REVIEW).fields, T.StructField("_broken", T.StringType())])
    parsed = records(spark, path).withColumn("r", F.from_json("record", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    reason = _reasons((F.col("r").isNull() | F.col("r._broken").isNotNull(), "no review"), (F.trim(F.coalesce("r.source_review_id", F.lit(""))) == "", "no id"), (~F.col("r.rating").between(1, 5), "no stars from 1 to 5"))
    return parsed.select("file", "line", "record", reason.alias("reason"), *[F.col(f"r.{f.name}") for f in kind if f.name != "_broken"])


def read_label_sheet(spark: SparkSession, path: str, schema: str, required: Sequence[str], key: Sequence[str], sep: str = ",") -> DataFrame:
    """file, line, record, reason and a sheet's columns. Rejects: another header, broken rows, blank cells that are required, keys that an earlier row has."""
    kind = T._parse_datatype_string(schema)
    names = [f.name for f in kind]
    taken = {n.lower() for n in names} & {"file", "line", "record", "reason"}
    if taken:
        raise ValueError(f"the sheet has columns named {', '.join(sorted(taken))}")
    wide = T.StructType([*kind.fields, T.StructField("_broken", T.StringType())])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "enforceSchema": "true"}
    parsed = records(spark, path, quoted=True)
    head = F.split(F.regexp_replace("record", '"', ""), sep) == F.array(*[F.lit(n) for n in names])
    rows = parsed.where("line > 1").withColumn("r", F.from_csv("record", wide.simpleString()[7:-1].replace(":", " "), options))
    blank = [(F.trim(F.coalesce(F.col(f"r.{c}").cast("string"), F.lit(""))) == "", f"blank cell: {c}") for c in required]
    own, keys = [F.col(f"r.{c}").alias(f"_k{i}") for i, c in enumerate(key)], [f"_k{i}" for i in range(len(key))]
    # A key's first row is found in each task before rows are moved. Only keys and lines are joined here, and rows, which
    # lie by file and line already, meet the repeated lines where they are.
    slim = rows.select(*own, "file", "line")
    first = slim.groupBy(*keys).agg(F.min(F.struct("file", "line")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    again = slim.alias("s").join(first.alias("f"), same).where(F.struct("s.file", "s.line") != F.col("f._first")).select("s.file", "s.line", F.lit(True).alias("_again"))
    rows = rows.join(again, ["file", "line"], "left")
    reason = _reasons((F.col("r").isNull() | F.col("r._broken").isNotNull(), "broken row"), *blank, (F.coalesce("_again", F.lit(False)), "repeated key"))
    good = rows.select("file", "line", "record", reason.alias("reason"), *[F.col(f"r.{n}") for n in names])
    # The reason depends on the record, so that `checked` can't be moved to where the record isn't known yet.
    heads = parsed.where("line = 1").select("file", "line", "record", F.when(~head, "another header").alias("reason"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind]).where("reason IS NOT NULL")
    return good.unionByName(heads)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL").drop("record", "reason")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").select("file", "line", "reason", "record")


def checked(rows: DataFrame) -> DataFrame:
    """The rows; if one is a reject, running the query is an error that names its file, line and reason."""
    said = F.concat("file", F.lit(", line "), F.col("line").cast("string"), F.lit(": "), "reason")
    return rows.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(said).cast("boolean"))).drop("record", "reason")
