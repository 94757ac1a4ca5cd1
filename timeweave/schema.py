"""Canonical tables and their constraint report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    kinds = {"long": T.LongType, "int": T.IntegerType, "string": T.StringType, "double": T.DoubleType, "boolean": T.BooleanType}
    fields = (part.strip().split(" ") for part in spec.split(","))
    return T.StructType([T.StructField(name, kinds[kind](), True) for name, kind in fields])


SCHEMAS = {
    "chapters": _table("book_id long, chapter_id long, title string, position int, source_html string"),
    "fragments": _table("chapter_id long, position long, kind string, text string, source_start_char long, source_end_char long, dom_locator string"),
    "segments": _table("chapter_id long, segment_id long, position long, text string, start_ms long, end_ms long, confidence double, "
                       "status string, locked boolean, origin string, source_fragment_id long, source_start_char long, source_end_char long"),
    "tokens": _table("chapter_id long, token_pos long, text string, start_ms long, end_ms long, probability double"),
    "anchors": _table("chapter_id long, segment_id long, source_start_char long, source_end_char long, start_ms long, end_ms long, confidence double, method string"),
    "silences": _table("chapter_id long, position long, time_ms long, score double, kind string, start_ms long, end_ms long"),
    "assets": _table("book_id long, audio_id long, position long, title string, path string, fingerprint string, duration_ms long"),
    "markers": _table("audio_id long, position long, title string, start_ms long, end_ms long"),
    "links": _table("chapter_id long, audio_id long, position long, source_start_ms long, source_end_ms long, confidence double"),
    "media_state": _table("chapter_id long, mapping_signature string, needs_review boolean"),
    "runs": _table("run_id long, cache_key string, chapter_id long, backend string, model string, status string"),
    "chunks": _table("run_id long, position long, source_start_ms long, source_end_ms long, core_start_ms long, core_end_ms long, status string"),
    "frames": _table("chapter_id long, frame_no long, t_ms long, rms double"),
    "cues": _table("chapter_id long, idx int, start_ms long, end_ms long, text string, raw_text string"),
    "pyramid": _table("chapter_id long, level int, bucket long, min_v int, max_v int"),
}
STATUSES = ("auto", "manual", "locked", "low_confidence", "unmatched")
ORIGINS = ("source", "asr", "user", "subtitle")


def segment_rules() -> dict[str, Column]:
    """Predicates every segment row must satisfy."""
    return {
        "time range": (F.col("start_ms") >= 0) & (F.col("end_ms") >= F.col("start_ms")),
        "confidence": F.col("confidence").between(0.0, 1.0),
        "status": F.col("status").isin(*STATUSES),
        "origin": F.col("origin").isin(*ORIGINS),
    }


def setting_rules() -> dict[str, Column]:
    """Predicates of detector settings."""
    return {
        "vad_threshold": F.col("vad_threshold").between(0.0, 1.0),
        "min_silence_ms": F.col("min_silence_ms") >= 20,
        "snap_window_ms": F.col("snap_window_ms") >= 0,
        "energy_percentile": F.col("energy_percentile").between(0.0, 100.0),
    }


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """One row per broken rule; a single pass over the table."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()
    ]))
    return df.select(*keys, F.explode(broken).alias("violation"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit("duplicate key").alias("violation"))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent, keys, "left_anti").select(*keys, F.lit("missing parent").alias("violation"))


def check_constraints(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Range, enum, uniqueness and foreign-key findings of a segments table."""
    parts = [
        violations(segments, segment_rules(), ["chapter_id", "position"]),
        duplicate_keys(segments, ["chapter_id", "position"]),
        orphans(segments, chapters, ["chapter_id"]).withColumn("position", F.lit(None).cast("long")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
