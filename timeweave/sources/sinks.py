"""Subtitle, JSON, overlay, silence and keyed-table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import safe_name
from timeweave.functions.timecode import format_srt_time, format_time
from timeweave.operators.timeline import enforce_monotonic, timed
from timeweave.ordered import CHAPTER, Seq, finish, number_rows, prepare, prev, scan


class OverlapError(ValueError):
    """Adjacent timed cues overlap although overlaps are allowed to stay."""


def overlapping_cues(segments: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Timed rows that end after the next timed row starts."""
    rows, seq = prepare(segments.filter(timed()), seq)
    return finish(scan(rows, seq, None, {"__next": prev("start_ms")})).filter(F.col("end_ms") > F.col("__next.start_ms")).drop("__next")


def subtitle_lines(segments: DataFrame, kind: str = "srt", overlap_policy: str = "clamp_current", seq: Seq = CHAPTER) -> DataFrame:
    """One rendered cue per row: ``(chapter_id, cue_no, line)``."""
    if kind not in {"srt", "vtt"}:
        raise ValueError("kind must be srt or vtt")
    live = segments.filter(timed())
    if overlap_policy == "allow_overlap" and not overlapping_cues(live, seq).isEmpty():
        raise OverlapError("resolve overlapping cues first")
    fixed = number_rows(enforce_monotonic(live, seq), seq, "cue_no", 1)
    show = format_srt_time if kind == "srt" else format_time
    times = F.concat(show(F.col("start_ms")), F.lit(" --> "), show(F.col("end_ms")))
    body = F.concat(times, F.lit("\n"), F.col("text"), F.lit("\n"))
    line = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), body) if kind == "srt" else F.concat(
        F.when(F.col("cue_no") == 1, F.lit("WEBVTT\n\n")).otherwise(F.lit("")), body)
    return fixed.select(*seq.group, "cue_no", line.alias("line"))


def file_names(chapters: DataFrame) -> DataFrame:
    """``NNN-title`` per chapter (A15), longer numbers in full; where chapters name a book, it goes first."""
    number = (F.col("position") + 1).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    name = F.concat(padded, F.lit("-"), safe_name(F.col("title"), "chapter"))
    if "book_id" in chapters.columns:
        name = F.concat(safe_name(F.col("book_id").cast("string"), "book"), F.lit("-"), name)
    return chapters.withColumn("file_name", name)


def write_subtitles(segments: DataFrame, chapters: DataFrame, path: str, kind: str = "srt", **options: str) -> None:
    """A folder per chapter with ordered text parts.

    Rows are range-partitioned by (chapter, cue), so a long chapter becomes several parts
    in name order instead of one task.
    """
    lines = subtitle_lines(segments, kind, **options).join(file_names(chapters).select("chapter_id", "file_name"), "chapter_id")
    lines.repartitionByRange("file_name", "cue_no").sortWithinPartitions("file_name", "cue_no").select("file_name", "line").write.mode(
        "overwrite").partitionBy("file_name").text(path)


def project_documents(chapters: DataFrame, links: DataFrame, assets: DataFrame, segments: DataFrame, part_rows: int = 65_536) -> DataFrame:
    """Nested chapter documents with ordered audio links and segments.

    A chapter with more than ``part_rows`` segments continues in documents with the same id
    and the next ``part``, so that no document outgrows a task.
    """
    audio = links.join(assets.select("audio_id", "path", "duration_ms", "fingerprint"), "audio_id", "left").groupBy("chapter_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "audio_id", "path", "duration_ms", "fingerprint", "source_start_ms", "source_end_ms"))).alias("audio_links"))
    rows = segments.withColumn("confidence", F.bround("confidence", 4)).groupBy("chapter_id", F.floor(F.col("position") / part_rows).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("position", "text", "start_ms", "end_ms", "confidence", "status", "locked", "origin"))).alias("segments"))
    return chapters.select("chapter_id", "title", "position").join(audio, "chapter_id", "left").join(rows, "chapter_id", "left").withColumn(
        "part", F.coalesce("part", F.lit(0))).withColumn("audio", F.get(F.col("audio_links"), F.lit(0)))


def write_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_silences(silences: DataFrame, path: str) -> None:
    """Detected silences as JSON lines."""
    silences.write.mode("overwrite").json(path)


def write_by_chapter(df: DataFrame, path: str, group: str = "chapter_id", buckets: int = 1) -> None:
    """Replace only the chapters present in ``df``.

    ``buckets`` spreads a large chapter over several files of its partition.
    """
    spread = df.repartition(F.col(group), F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def publish(tokens: DataFrame, segments: DataFrame, anchors: DataFrame, state: DataFrame, root: str, run_label: str) -> None:
    """Write one result set under its own run folder, the manifest row last.

    Readers take the run named by the newest manifest row, so a lost job leaves nothing half
    visible; ``state`` is the media state with its review flags cleared.
    """
    for name, df in (("tokens", tokens), ("segments", segments), ("anchors", anchors)):
        df.write.mode("overwrite").parquet(f"{root}/{name}/run={run_label}")
    chapters = segments.select("chapter_id").distinct()
    cleared = chapters.withColumn("__done", F.lit(True))
    state.join(cleared, "chapter_id", "left").withColumn(
        "needs_review", F.when(F.col("__done"), F.lit(False)).otherwise(F.col("needs_review"))).drop("__done").write.mode("overwrite").parquet(
        f"{root}/media_state/run={run_label}")
    chapters.select("chapter_id", F.lit(run_label).alias("run_label"), F.current_timestamp().alias("published_at")).write.mode("append").parquet(f"{root}/manifest")


def read_published(spark, root: str, name: str, run_label: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Ordered reader of one published table."""
    df = spark.read.parquet(f"{root}/{name}/run={run_label}")
    return df.orderBy(*order) if order else df
