"""Interval joins: a sweep over starts and points in order, in slices of the line that are dealt out by group."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a slice, in mean lengths of the intervals: so many intervals are copied at most for each one copy into a second slice.
SLICE = 64


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Point rows with the name of their innermost interval. Rows come in order of group, slice and place, starts before
    points; open intervals wait in a heap, the shortest first, and leave it when one that has ended comes to its top.
    """
    now, open_ = None, []
    for b in batches:
        names, take = [], []
        columns = (b.column(k).to_pylist() for k in ("_g", "_slice", "_at", "_end", "_name", "_point"))
        for i, (group, slice_, at, end, name, point) in enumerate(zip(*columns)):
            if (group, slice_) != now:
                now, open_ = (group, slice_), []
            if not point:
                heappush(open_, (end - at, at, name, end))
                continue
            while open_ and open_[0][3] < at:
                heappop(open_)
            take.append(i)
            names.append(open_[0][2] if open_ else None)
        rows = b.column("_row").take(pa.array(take, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(names, b.column("_name").type)], [*(f.name for f in rows.type), "innermost"])


def innermost(points: DataFrame, intervals: DataFrame, group: str, at: str, start: str, end: str, name: str) -> DataFrame:
    """For each point (group, at) the shortest interval of its group that holds it, ends included; of equal ones the
    least start, then the least name, as `innermost`. Points outside all have NULL; equal points are rows of their own, and a point
    without a group or place has NULL. Intervals without a group, start or end hold nothing.

    A slice is SLICE mean lengths of an interval, so that intervals are copied into all slices they touch at little more than one
    row each, and a group with very many points or intervals is dealt to as many tasks as it has slices. A task holds the intervals open at one place.
    """
    spans = intervals.where(F.col(start) <= F.col(end)).where(F.col(group).isNotNull())
    spans = spans.select(F.col(group).alias("_g"), F.col(start).alias("_at"), F.col(end).alias("_end"), F.col(name).alias("_name"))
    mean = spans.agg(F.avg(F.col("_end") - F.col("_at") + 1)).first()[0]
    width = SLICE * max(1.0, float(mean or 1.0))
    slice_ = lambda c: F.floor(c / F.lit(width)).cast("long")
    row = F.struct(*points.columns)
    spans = spans.withColumn("_slice", F.explode(F.sequence(slice_(F.col("_at")), slice_(F.col("_end"))))).withColumn("_point", F.lit(False))
    rows = points.select(F.col(group).alias("_g"), F.col(at).alias("_at"), slice_(F.col(at)).alias("_slice"), F.lit(True).alias("_point"), row.alias("_row"))
    dealt = spans.unionByName(rows, allowMissingColumns=True).repartition("_g", "_slice").sortWithinPartitions("_g", "_slice", "_at", "_point")
    kind = dict(spans.dtypes)["_name"]
    return dealt.mapInArrow(swept, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + f", innermost {kind}")
