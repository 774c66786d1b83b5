"""Positions in a distributed total order.

Rows are dealt by ranges of group and order, sorted in each partition, numbered there and stored; only a partition's first group can have
begun before it, so at most one offset for each partition is added to the numbers. No task holds more than a range of the rows, however large
a group is, and none waits for the one before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import stored

ADDED = ("_part", "_local")


def positions(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "position", partitions: int | None = None) -> DataFrame:
    """`df` with a column of numbers from 1 in each group, in the order given; rows that are equal in it are numbered as they come.

    partitions: ranges to deal the rows into, the session's number if not given. A null group is a group. ValueError if `df` has the column.
    """
    group = list(group)
    taken = {c.lower() for c in df.columns} & {name.lower(), *ADDED}
    if taken:
        raise ValueError(f"the input has columns named {', '.join(sorted(taken))}")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    schema = dealt.withColumns({"_part": F.lit(0), "_local": F.lit(0).cast("long")}).schema
    arrow = to_arrow_schema(schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # Where a row's group differs from the one before it; nulls are equal to nulls.
            starts = np.zeros(batch.num_rows, bool)
            for g in group:
                c = batch.column(g)
                if batch.num_rows > 1:
                    a, b = c.slice(1), c.slice(0, batch.num_rows - 1)
                    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                    starts[1:] |= ~same.to_numpy(zero_copy_only=False)
            first = tuple(batch.column(g)[0].as_py() for g in group)
            starts[0] = last is None or first != last
            begins = np.flatnonzero(starts)
            at = np.arange(batch.num_rows)
            owner = np.searchsorted(begins, at, side="right") - 1
            local = np.where(owner >= 0, at - (begins[np.maximum(owner, 0)] if len(begins) else 0), at + seen) + 1
            last, seen = tuple(batch.column(g)[batch.num_rows - 1].as_py() for g in group), int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local.astype(np.int64))], schema=arrow)

    numbered = stored(dealt.mapInArrow(number, schema))
    counts = numbered.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    # A row for each group and partition that it reaches into; those with something before them are one for each partition at most.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL").select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_before")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = numbered.join(F.broadcast(offsets), same, "left")
    return out.select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name))
