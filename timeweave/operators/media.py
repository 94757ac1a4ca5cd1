"""Chapter-local time against media: parts, overlaps, clips and locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.intervals import asof_join, overlap_join, point_join
from timeweave.ordered import Agg, Seq, finish, prepare, scan

LINKS = Seq(order=("position",))


def chapter_parts(links: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with running chapter-local start and end, and chapters that cannot be used."""
    joined = links.join(assets.select("audio_id", "fingerprint"), "audio_id", "left").withColumn(
        "duration_ms", F.greatest(F.lit(0), F.col("source_end_ms") - F.col("source_start_ms")))
    bad = joined.groupBy("chapter_id").agg(
        F.when(F.max(F.col("fingerprint").isNull()), F.lit("missing media"))
        .when(F.min("duration_ms") <= 0, F.lit("empty slice")).alias("problem")).filter("problem is not null")
    good = joined.join(bad, "chapter_id", "left_anti")
    good, seq = prepare(good, LINKS)
    parts = finish(scan(good, seq, {"local_end": Agg("sum", F.col("duration_ms"))})).withColumn(
        "local_start", F.col("local_end") - F.col("duration_ms"))
    return parts, bad


def media_of_intervals(cues: DataFrame, parts: DataFrame) -> DataFrame:
    """Overlap of chapter-local cues with media slices in asset time."""
    p = parts.select("chapter_id", "audio_id", F.col("position").alias("part_no"), "source_start_ms", "local_start", "local_end")
    hits = overlap_join(cues, p, ["chapter_id"], ("start_ms", "end_ms"), ("local_start", "local_end"))
    begin = F.greatest("start_ms", "local_start")
    finish_ = F.least("end_ms", "local_end")
    return hits.withColumn("clip_begin", F.col("source_start_ms") + begin - F.col("local_start")).withColumn(
        "clip_end", F.col("source_start_ms") + finish_ - F.col("local_start")).drop("source_start_ms", "local_start", "local_end")


def to_asset_time(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Chapter-local ``at_ms`` in asset time; the last part is closed at its end."""
    ends = parts.groupBy("chapter_id").agg(F.max("local_end").alias("__last"))
    p = parts.select("chapter_id", "audio_id", "source_start_ms", "local_start", "local_end").join(ends, "chapter_id").withColumn(
        "__until", F.when(F.col("local_end") == F.col("__last"), F.col("local_end") + 1).otherwise(F.col("local_end")))
    hits = point_join(points, p, ["chapter_id"], "at_ms", ("local_start", "__until"))
    return hits.withColumn("asset_ms", F.col("source_start_ms") + F.col("at_ms") - F.col("local_start")).drop(
        "source_start_ms", "local_start", "local_end", "__until", "__last")


def to_local_time(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Asset time back to chapter-local time (C7 inverse)."""
    p = parts.select("chapter_id", "audio_id", "source_start_ms", "source_end_ms", "local_start")
    hits = point_join(points, p, ["chapter_id", "audio_id"], "asset_ms", ("source_start_ms", "source_end_ms"), closed=True)
    return hits.groupBy(*points.columns).agg(F.min(F.col("local_start") + F.col("asset_ms") - F.col("source_start_ms")).alias("local_ms"))


def part_at_or_after(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Containing part, else the next part's start, else nothing."""
    p = parts.select("chapter_id", "audio_id", "local_start", "local_end", F.col("position").alias("part_no"))
    before = asof_join(points, p, ("chapter_id",), "at_ms", "local_start", ["audio_id", "local_end", "part_no"], name="here")
    both = asof_join(before, p, ("chapter_id",), "at_ms", "local_start", ["audio_id", "local_end", "part_no"], backward=False, name="next")
    inside = F.coalesce(F.col("at_ms") < F.col("here.local_end"), F.lit(False))
    pick = F.when(inside, F.struct(F.col("here.audio_id"), F.col("here.part_no"), F.col("at_ms").alias("local_ms"))).otherwise(
        F.struct(F.col("next.audio_id"), F.col("next.part_no"), F.col("next.local_start").alias("local_ms")))
    return both.withColumn("__p", pick).select(
        *points.columns, F.col("__p.audio_id").alias("audio_id"), F.col("__p.part_no").alias("part_no"),
        F.coalesce("__p.local_ms", F.when(F.col("__p.part_no").isNull(), F.col("at_ms"))).alias("local_ms"))


def source_texts(segments: DataFrame, fragments: DataFrame) -> DataFrame:
    """Original text of each cue from the fragments its character range overlaps."""
    seg = segments.filter("source_start_char is not null and source_end_char is not null").select(
        "chapter_id", "position", "source_start_char", "source_end_char")
    frag = fragments.select("chapter_id", F.col("position").alias("frag_no"), "text",
                            F.col("source_start_char").alias("f_start"), F.col("source_end_char").alias("f_end"))
    hits = overlap_join(seg, frag, ["chapter_id"], ("source_start_char", "source_end_char"), ("f_start", "f_end"), width=4096)
    begin = F.greatest("source_start_char", "f_start")
    end = F.least("source_end_char", "f_end")
    piece = F.substring("text", (begin - F.col("f_start") + 1).cast("int"), (end - begin).cast("int"))
    return hits.groupBy("chapter_id", "position").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("frag_no", piece.alias("p")))), lambda x: x["p"]), "").alias("target"))


def overlay_clips(units: DataFrame, cues: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audio clip of every text unit, and cues outside their media.

    ``units(chapter_id, position, node_no, node_start, node_end)`` are the located pieces
    of a cue in document order.  A cue's characters are shared over its media chunks by
    duration, a chunk's time over its pieces by characters; every clip lasts at least 1 ms.
    """
    clips = media_of_intervals(cues.select("chapter_id", "position", "start_ms", "end_ms"), parts)
    clips = clips.withColumn("len", F.col("clip_end") - F.col("clip_begin"))
    key = ["chapter_id", "position"]
    covered = clips.groupBy(*key).agg(F.sum("len").alias("covered"), F.max("part_no").alias("last_part"))
    outside = cues.join(covered, key, "left").filter(
        F.coalesce("covered", F.lit(0)) < F.col("end_ms") - F.col("start_ms") - 2).select(*key)
    spans = units.groupBy(*key).agg(F.min("node_start").alias("from_char"), F.max("node_end").alias("to_char"))
    shares = clips.join(covered, key).join(outside, key, "left_anti").join(spans, key).withColumn(
        "share", F.greatest(F.lit(1), F.bround((F.col("to_char") - F.col("from_char")) * F.col("len") / F.col("covered"))).cast("long"))
    shares, seq = prepare(shares, Seq(tuple(key), ("part_no",)))
    shares = finish(scan(shares, seq, {"__upto": Agg("sum", F.col("share"))}))
    shares = shares.withColumn("c_from", F.least("to_char", F.col("from_char") + F.col("__upto") - F.col("share"))).withColumn(
        "c_to", F.when(F.col("part_no") == F.col("last_part"), F.col("to_char")).otherwise(F.least("to_char", F.col("from_char") + F.col("__upto"))))
    pieces = overlap_join(units, shares.select(*key, "part_no", "audio_id", "clip_begin", "clip_end", "c_from", "c_to"), key,
                          ("node_start", "node_end"), ("c_from", "c_to"), width=4096)
    pieces = pieces.withColumn("chars", F.least("node_end", "c_to") - F.greatest("node_start", "c_from"))
    part = [*key, "part_no"]
    totals = pieces.groupBy(*part).agg(F.sum("chars").alias("all_chars"), F.max("node_no").alias("last_node"))
    pieces = pieces.join(totals, part).withColumn("ms", F.bround(
        (F.col("clip_end") - F.col("clip_begin")) * F.col("chars") / F.col("all_chars")).cast("long"))
    pieces, seq = prepare(pieces, Seq(tuple(part), ("node_no",)))
    out = finish(scan(pieces, seq, {"__upto": Agg("sum", F.col("ms"))}))
    begin = F.col("clip_begin") + F.col("__upto") - F.col("ms")
    end = F.when(F.col("node_no") == F.col("last_node"), F.col("clip_end")).otherwise(F.col("clip_begin") + F.col("__upto"))
    return out.select(*key, "part_no", "node_no", "audio_id", begin.alias("begin_ms"),
                      F.greatest(begin + 1, end).alias("end_ms")), outside


def audio_signature(parts: DataFrame, rows: int = 4096) -> DataFrame:
    """sha256 over the ordered ``id:fingerprint:start:end:localstart:localend`` joined by ``|``."""
    line = F.concat_ws(":", "audio_id", "fingerprint", "source_start_ms", "source_end_ms", "local_start", "local_end")
    from timeweave.operators.incremental import ordered_digest

    return ordered_digest(parts.withColumn("__line", line), LINKS, "__line", "|", "audio_signature", rows=rows)


def relink(links: DataFrame, replacements: DataFrame) -> DataFrame:
    """Move links of one asset to another, keep the first of identical links and clip to
    a changed duration (C33): ``replacements(audio_id, new_audio_id, new_duration_ms)``."""
    moved = links.join(replacements, "audio_id", "left").withColumn("audio_id", F.coalesce("new_audio_id", "audio_id")).withColumn(
        "source_end_ms", F.coalesce(F.least("source_end_ms", "new_duration_ms"), "source_end_ms")).drop("new_audio_id", "new_duration_ms")
    return moved.groupBy("chapter_id", "audio_id", "source_start_ms", "source_end_ms").agg(
        F.min_by(F.struct("position", "confidence"), "position").alias("k")).select(
        "chapter_id", "audio_id", "source_start_ms", "source_end_ms", "k.*")
