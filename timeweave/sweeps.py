"""The smallest interval around each point, by one sorted sweep a group instead of a join of all pairs."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def smallest_containing(points: DataFrame, spans: DataFrame, group: str, point_id: str, point: str, span: tuple[str, str], name: str) -> DataFrame:
    """(group, point_id, ``name``): each point with a struct of the smallest span ``start <= point <= end``.

    Of equally long spans the first to start is taken, then the least of their other columns.  Rows of a group are streamed in order;
    the open spans wait in a heap by length, so that the smallest is on top, and leave it once they
    have ended and come up.  A task holds the spans open at one place, whatever their number in all; no
    point meets a span but the one it gets.  Points in no span, and rows with a null group or place, are left out.
    """
    start, end = span
    fields = [f for f in spans.schema.fields if f.name not in (group, start, end)]
    held = F.struct((F.col(end) - F.col(start)).alias("__length"), start, *[f.name for f in fields], end)
    fine = spans.filter(F.col(group).isNotNull() & (F.col(start) <= F.col(end)))
    opened = fine.select(group, F.col(start).cast("long").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(points.schema[point_id].dataType).alias(point_id), held.alias(name))
    asked = points.filter(F.col(group).isNotNull() & F.col(point).isNotNull()).select(
        group, F.col(point).cast("long").alias("__at"), F.lit(1).alias("__kind"), point_id, F.lit(None).cast(opened.schema[name].dataType).alias(name))
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    events = opened.unionByName(asked).repartition(parts, group).sortWithinPartitions(group, "__at", "__kind")
    shape = T.StructType([points.schema[group], points.schema[point_id], opened.schema[name]])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap = None, []
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            for key, at, kind, own, value in zip(*(batch.column(c).to_pylist() for c in (group, "__at", "__kind", point_id, name))):
                if key != current:
                    current, heap = key, []
                if not kind:
                    heapq.heappush(heap, tuple((v is not None, v) for v in value.values()))
                    continue
                while heap and heap[0][-1][1] < at:
                    heapq.heappop(heap)
                if heap:
                    for column, x in zip(found, (key, own, dict(zip(shape[name].dataType.names, (v for _, v in heap[0]))))):
                        column.append(x)
            types = [batch.schema.field(c).type for c in (group, point_id, name)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names=[group, point_id, name])

    return events.mapInArrow(sweep, shape)
