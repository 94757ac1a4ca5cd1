"""Subtitle source: cues, quarantine, and import as a chapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import SPACE, subtitle_text
from timeweave.functions.timecode import parse_srt_time
from timeweave.ordered import Seq, number_rows

CLOCK = r"[0-9]{1,3}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}"
TIMING = rf"^\s*({CLOCK})\s*-->\s*({CLOCK})(?:\s+.*)?$"


def cue_blocks(text: Column) -> Column:
    """Blocks between blank lines as ``array<struct<idx,timing,raw>>``."""
    clean = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(clean, rf"\n[{SPACE}]*(?:\n[{SPACE}]*)+", -1), lambda b: F.btrim(b) != "")

    def read(block: Column, i: Column) -> Column:
        body = F.regexp_replace(block, r"^\n+|\n+$", "")
        declared = F.regexp_extract(body, r"^\s*([0-9]+)[ \t]*(?:\n|$)", 1)
        rest = F.when(declared != "", F.regexp_replace(body, r"^\s*[0-9]+[ \t]*\n?", "")).otherwise(body)
        return F.struct(
            F.coalesce(F.nullif(declared, F.lit("")).cast("int"), i + 1).alias("idx"),
            F.regexp_extract(rest, r"^([^\n]*)", 1).alias("timing"),
            F.regexp_replace(rest, r"^[^\n]*\n?", "").alias("raw"))

    return F.transform(blocks, read)


def parse_cues(texts: DataFrame, key: str = "chapter_id") -> tuple[DataFrame, DataFrame]:
    """Cues in (start, end, index) order, and rejected blocks with the reason."""
    rows = texts.select(key, F.posexplode_outer(cue_blocks(F.col("text"))).alias("block", "c")).filter(F.col("block").isNotNull()).select(key, "block", "c.*")
    rows = rows.withColumn("start_ms", parse_srt_time(F.regexp_extract("timing", TIMING, 1))).withColumn(
        "end_ms", parse_srt_time(F.regexp_extract("timing", TIMING, 2)))
    problem = (
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), F.lit("invalid timing"))
        .when(F.col("end_ms") <= F.col("start_ms"), F.lit("ends before it starts")).when(F.col("raw") == "", F.lit("no text")))
    rows = rows.withColumn("problem", problem)
    good = rows.filter("problem is null").select(key, "idx", "start_ms", "end_ms", subtitle_text(F.col("raw")).alias("text"), F.col("raw").alias("raw_text"))
    ordered = number_rows(good, Seq((key,), ("start_ms", "end_ms", "idx")), "position")
    empty = texts.select(key).join(rows.select(key).distinct(), key, "left_anti").withColumn("block", F.lit(None).cast("int")).withColumn("problem", F.lit("no cues"))
    return ordered, rows.filter("problem is not null").select(key, "block", "problem").unionByName(empty)


def cues_as_chapter(cues: DataFrame, key: str = "chapter_id") -> DataFrame:
    """Each cue as a fragment and a manual segment with a ``cue:n`` locator."""
    from timeweave.operators.timeline import text_offsets

    placed = text_offsets(cues, Seq((key,), ("position",)))
    return placed.select(
        key, "position", "text", "start_ms", "end_ms", F.lit(1.0).alias("confidence"), F.lit("manual").alias("status"), F.lit(False).alias("locked"),
        F.lit("subtitle").alias("origin"), F.col("position").alias("source_fragment_id"), F.col("start_char").alias("source_start_char"),
        F.col("end_char").alias("source_end_char"), F.concat(F.lit("cue:"), F.col("idx").cast("string")).alias("dom_locator"))
