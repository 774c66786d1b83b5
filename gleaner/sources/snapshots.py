"""Recorded collections as a data source: a partition for each file, and files ruled out by filters before they are opened.

A collection is a JSON document of an app, how it was sampled, and its reviews, on a line of a file below `app_id=/country=/seed=/requested=`, as
`record` writes them. Equality and IN filters on these four columns are pushed down: the path rules a file out, and of a file
whose path doesn't say, documents are. Spark sees no such filter again. Files elsewhere below the path are read too.

Fields that the schema doesn't name are never kept. Blank lines don't count, a broken document fails the read with its file and line.
A null app, sample or list of reviews has no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .reviews import REVIEW

KEYS = ("app_id", "country", "seed", "requested")
NUMBERS = ("app_id", "seed", "requested")
COLUMNS = "app_id bigint, seed bigint, requested bigint, reachable bigint, " + REVIEW
FORMAT = "gleaner_snapshots"


def record(collections: DataFrame, path: str) -> None:
    """Write collections (app_id, country, seed, requested, document: JSON text), each to a folder of its own."""
    collections.select(*KEYS, "document").repartition(*KEYS).write.mode("errorifexists").partitionBy(*KEYS).text(path)


class Document(InputPartition):
    """One file of collections, its path and what that says of the keys."""

    def __init__(self, path: str, keys: dict) -> None:
        super().__init__(path)
        self.path, self.keys = path, keys


def _named(path: str) -> dict:
    """The keys that a path names."""
    found = {k: v for k, v in re.findall(r"(\w+)=([^/]*)/", path) if k in KEYS}
    return {k: int(v) if k in NUMBERS and re.fullmatch(r"-?\d+", v) else v for k, v in found.items() if v != "__HIVE_DEFAULT_PARTITION__"}


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", path)) if ":" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[Document]:
    """The files below a path, with what their folders below it say."""
    fs, top = _opened(path)
    found = fs.get_file_info(pafs.FileSelector(top, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(top) :].split("/") if x)
    return [Document(p, _named(p[len(top) :])) for p in sorted(i.path for i in found if i.is_file and not hidden(i.path))]


def _when(value: object) -> datetime | None:
    if not isinstance(value, str):
        return None
    try:
        at = datetime.fromisoformat(value.strip())
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def _typed(value: object, kind: pa.DataType) -> object:
    """A JSON value as its column's type, null if it is none."""
    if value is None:
        return None
    if pa.types.is_timestamp(kind):
        return _when(value)
    if pa.types.is_boolean(kind):
        return value if isinstance(value, bool) else None
    if pa.types.is_integer(kind):
        return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) < 2**63 else None
    if pa.types.is_list(kind):
        return [str(x) for x in value if x is not None] if isinstance(value, list) else None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


class SnapshotReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema, self.wanted = path, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                self.wanted.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[Document]:
        return [d for d in _files(self.path) if all(d.keys.get(k, values[0] if values else None) in values for k, values in self.wanted)]

    def read(self, partition: Document) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so for a source without partitions
            return
        fs, _ = _opened(self.path)
        arrow = to_arrow_schema(self.schema)
        with fs.open_input_stream(partition.path) as f:
            for number, line in enumerate(_lines(f), 1):
                if not line.strip():
                    continue
                try:
                    doc = json.loads(line)
                except ValueError as e:
                    raise ValueError(f"{partition.path}, line {number}: {e}") from None
                app, sampling = doc.get("app") or {}, doc.get("sampling") or {}
                own = {"app_id": app.get("app_id"), "country": app.get("country"), "seed": sampling.get("seed"), "requested": sampling.get("requested"), "reachable": sampling.get("reachable")}
                if any(own[k] not in values for k, values in self.wanted):
                    continue
                rows = [{**r, **{k: own[k] for k in ("app_id", "country", "seed", "requested", "reachable")}} for r in doc.get("reviews") or [] if isinstance(r, dict)]
                columns = [pa.array([_typed(r.get(c.name), c.type) for r in rows], c.type) for c in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)


def _lines(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines of a stream, which is read a piece at a time."""
    rest = b""
    while piece := stream.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


class Snapshots(DataSource):
    """Rows of `COLUMNS`; option path."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: T.StructType) -> SnapshotReader:
        return SnapshotReader(self.options["path"], schema)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of recorded collections. Sets the session's switch for pushing filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Snapshots)
    return spark.read.format(FORMAT).load(path)


def snapshot_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """What there is, by the folders' names alone: app_id, country, seed, requested."""
    rows = sorted({tuple(d.keys.get(k) for k in KEYS) for d in _files(path)}, key=str)
    return spark.createDataFrame(rows, "app_id bigint, country string, seed bigint, requested bigint")


def replay(spark: SparkSession, path: str, app_id: int, country: str, seed: int, requested: int) -> DataFrame:
    """One recorded collection; ValueError with some of what there is if there is none like it."""
    got = read_snapshots(spark, path).where((F.col("app_id") == app_id) & (F.col("country") == country) & (F.col("seed") == seed) & (F.col("requested") == requested))
    if got.isEmpty():
        there = snapshot_catalogue(spark, path).where(F.col("app_id") == app_id).limit(20).collect()
        raise ValueError(f"no recorded collection of app {app_id} in {country}, seed {seed}, {requested} reviews; of this app there are {[tuple(r) for r in there]}")
    return got
