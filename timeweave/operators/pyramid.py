"""Multi-resolution time pyramids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.session import cut_lineage

STOP_WIDTH = 2048
# So many cells of all levels one task folds; their number, not their bytes, takes its memory.
TASK_CELLS = 1_000_000


def base_buckets(samples: DataFrame, bucket_size: int, group: str = "chapter_id") -> DataFrame:
    """Min and max per bucket, scaled to 16 bits."""
    def scaled(value):
        return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(value * 32767))).cast("int")

    return samples.groupBy(group, F.floor(F.col("sample_no") / bucket_size).alias("bucket")).agg(
        scaled(F.min("value")).alias("min_v"), scaled(F.max("value")).alias("max_v"))


def _leveled(base: DataFrame, group: str, stop: int) -> DataFrame:
    """Every base row once for each ``level``, dealt by the last level's cell ``__top``, in which all its ancestors lie."""
    base = cut_lineage(base)
    width = base.groupBy(group).agg((F.max("bucket") + 1).alias("width"))
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.col("width") / F.lit(float(stop))))).cast("int")
    spread = base.join(width, group).withColumn("__levels", levels).drop("width")
    cells = spread.agg(F.sum(F.col("__levels") + 1)).first()[0] or 0
    tasks = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // TASK_CELLS))
    dealt = spread.withColumn("__top", _ancestor(F.col("__levels"))).repartition(tasks, group, "__top")
    return dealt.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__levels"))))


def _ancestor(level: Column) -> Column:
    return F.floor(F.col("bucket") / F.pow(F.lit(2), level))


def pyramid(base: DataFrame, group: str = "chapter_id", stop: int = STOP_WIDTH) -> DataFrame:
    """Every level at once: halve until at most ``stop`` columns.

    Each base bucket is folded into all its ancestors behind one shuffle of the base rows, in tasks of
    bounded size.  A missing right sibling leaves the left one alone, like a repeated edge.
    """
    return _leveled(base, group, stop).groupBy(group, "__top", "level", _ancestor(F.col("level")).alias("bucket")).agg(
        F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v")).drop("__top")


def max_pyramid(bands: DataFrame, group: str = "chapter_id", stop: int = STOP_WIDTH) -> DataFrame:
    """Max-pool pyramid of band values ``(chapter_id, bucket, band, value)``."""
    return _leveled(bands, group, stop).groupBy(group, "__top", "level", _ancestor(F.col("level")).alias("bucket"), "band").agg(
        F.max("value").alias("value")).drop("__top")


def read_range(levels: DataFrame, start: int, end: int, pixels: int) -> DataFrame:
    """The level that gives about one column per pixel, limited to the range (I4).

    ``level`` and ``bucket`` are plain filters: they prune partitions and row groups.
    """
    start, end = max(0, start), max(0, end)
    level = max(0, int(math.log2(max(1, end - start) / max(1, pixels)))) if end > start else 0
    step = 1 << level
    return levels.filter((F.col("level") == level) & (F.col("bucket") >= start // step) & (F.col("bucket") <= max(start, end - 1) // step))


def concatenated(samples: DataFrame, parts: DataFrame) -> DataFrame:
    """Samples of several media slices on one chapter line.

    ``samples(audio_id, t_ms, value)``, ``parts`` from ``chapter_parts``.
    """
    from timeweave.intervals import point_join

    hits = point_join(samples, parts.select("chapter_id", "audio_id", "source_start_ms", "source_end_ms", "local_start"),
                      ["audio_id"], "t_ms", ("source_start_ms", "source_end_ms"))
    return hits.select("chapter_id", (F.col("local_start") + F.col("t_ms") - F.col("source_start_ms")).alias("sample_no"), "value")
