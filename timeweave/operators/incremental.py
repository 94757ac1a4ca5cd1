"""Signatures, duplicate media, keyed replacement and change detection."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.ordered import CHAPTER, Seq, number_rows

DIGEST_ROWS = 4096


def ordered_digest(df: DataFrame, seq: Seq, line: str, separator: str, name: str,
                   prefix: str = "", suffix: str = "", rows: int = DIGEST_ROWS, bits: int = 256) -> DataFrame:
    """Digest of the ordered lines of a group, by one rule for every length.

    Lines are joined and digested in blocks of ``rows``; a group of several blocks is the digest
    of its joined block digests.  No block of lines is ever joined with another one.
    """
    def digest(text: Column) -> Column:
        return F.sha2(text, 256) if bits == 256 else F.sha1(text)

    def joined(order: str, value: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), separator)

    lines = number_rows(df.select(*seq.group, *seq.order, F.col(line).alias("__text")), seq, "__i")
    blocks = lines.groupBy(*seq.group, F.floor(F.col("__i") / rows).alias("__b")).agg(
        digest(F.concat(F.lit(prefix), joined("__i", "__text"), F.lit(suffix))).alias("__h"))
    return blocks.groupBy(*seq.group).agg(
        F.when(F.count(F.lit(1)) == 1, F.min("__h")).otherwise(digest(joined("__b", "__h"))).alias(name))


def alignment_text_hash(segments: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Hash of the alignment inputs of a chapter; timing is left out."""
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    text = F.substring(quoted, 6, F.length(quoted))
    text = F.left(text, F.length(text) - 1)
    null = F.lit("null")
    line = F.concat(
        F.lit("["), text, F.lit(","), F.when(F.col("locked"), F.lit("true")).otherwise(F.lit("false")), F.lit(',"'), F.col("origin"), F.lit('",'),
        F.coalesce(F.col("source_fragment_id").cast("string"), null), F.lit(","), F.coalesce(F.col("source_start_char").cast("string"), null),
        F.lit(","), F.coalesce(F.col("source_end_char").cast("string"), null), F.lit("]"))
    return ordered_digest(segments.withColumn("__line", line), seq, "__line", ",", "text_hash", "[", "]")


def silence_signature(parts: DataFrame, vad: float = 0.5, min_ms: int = 350, padding_ms: int = 80, snap_ms: int = 250,
                      percentile: float = 18.0, group: str = "chapter_id") -> DataFrame:
    """sha1 over the ordered parts and the detector settings."""
    line = F.concat_ws(":", "audio_id", "source_start_ms", "source_end_ms")
    settings = f"|vad={vad:.3f}|min={min_ms}|pad={padding_ms}|snap={snap_ms}|energy={percentile:.3f}"
    return ordered_digest(parts.withColumn("__line", line), Seq((group,), ("position",)), "__line", "|", "silence_signature", suffix=settings, bits=160)


def recognition_parameters(**options: object) -> str:
    """Canonical JSON of the recognition options."""
    fixed = {"backend": "default", "model": "small", "language": "auto", "device": "auto", "compute_type": "auto",
             "mode": "balanced", "vad_threshold": 0.5, "min_silence_ms": 350, "chunker": "vad-core-v1"}
    merged = {**fixed, **options}
    merged["vad_threshold"] = round(float(merged["vad_threshold"]), 4)
    return json.dumps(merged, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def recognition_key(signature: Column, parameters: str) -> Column:
    return F.sha2(F.concat(signature, F.lit("|" + parameters)), 256)  # D12


def owned_key(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Keep a key when unused or owned by the same chapter, else salt it with the chapter."""
    owners = runs.groupBy("cache_key").agg(F.lit(True).alias("__used"))
    own = runs.select("cache_key", "chapter_id", F.lit(True).alias("__own")).distinct()
    foreign = F.col("__used").isNotNull() & F.col("__own").isNull()
    salted = F.sha2(F.concat(F.col("cache_key"), F.lit("|chapter="), F.col("chapter_id").cast("string")), 256)
    return wanted.join(owners, "cache_key", "left").join(own, ["cache_key", "chapter_id"], "left").withColumn(
        "owned_key", F.when(foreign, salted).otherwise(F.col("cache_key"))).drop("__used", "__own")


def quick_fingerprint(content: Column) -> Column:
    """sha256(size ‖ first MiB ‖ last MiB when larger)."""
    mib = 1 << 20
    size = F.octet_length(content)
    head = F.substring(content, 1, mib)
    tail = F.when(size > mib, F.substring(content, -mib, mib)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.encode(size.cast("string"), "utf-8"), head, tail), 256)


def full_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicate_media(assets: DataFrame) -> DataFrame:
    """Assets whose quick and full fingerprints both repeat, with the first asset of the copy
    group (C19). ``assets(audio_id, path, quick, full)``."""
    groups = assets.groupBy("quick", "full").agg(F.count(F.lit(1)).alias("copies"), F.min("audio_id").alias("original")).filter("copies > 1")
    return assets.join(groups, ["quick", "full"]).filter(F.col("audio_id") != F.col("original")).select(
        "audio_id", "original", "copies", F.col("full").alias("fingerprint"))


def duplicate_paths(assets: DataFrame) -> DataFrame:
    return assets.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("audio_id").alias("first")).filter("n > 1")


def current_alignments(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted (chapter, run, text hash, algorithm, silence signature) that are recorded."""
    return wanted.join(done, ALIGNMENT_KEY, "left_semi")


def pending_alignments(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """The incremental work list."""
    return wanted.join(done, ALIGNMENT_KEY, "left_anti")


ALIGNMENT_KEY = ["chapter_id", "run_id", "text_hash", "algorithm", "silence_signature"]


def ensure_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Get or create runs by cache key."""
    fresh = wanted.join(runs, "cache_key", "left_anti").groupBy("cache_key").agg(F.min("chapter_id").alias("chapter_id"))
    return runs.unionByName(fresh.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def complete_runs(runs: DataFrame, keys: DataFrame) -> DataFrame:
    marked = keys.select("cache_key").distinct().withColumn("__done", F.lit(True))
    return runs.join(marked, "cache_key", "left").withColumn(
        "status", F.when(F.col("__done"), F.lit("complete")).otherwise(F.col("status"))).drop("__done")


def delete_runs(runs: DataFrame, tokens: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """Runs and their tokens without the doomed ones."""
    kept = runs.filter(~doomed)
    return kept, tokens.join(kept.select("cache_key"), "cache_key", "left_semi")


def replace_groups(existing: DataFrame, incoming: DataFrame, group: str = "chapter_id") -> DataFrame:
    """Every group present in ``incoming`` replaces its old rows."""
    return existing.join(incoming.select(group).distinct(), group, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_chunks(existing: DataFrame, incoming: DataFrame, version: str = "version") -> DataFrame:
    """Latest row per (run, position) (A19); partial aggregation, no per-key sort."""
    both = existing.unionByName(incoming)
    fields = [c for c in both.columns if c not in ("run_id", "position")]
    return both.groupBy("run_id", "position").agg(F.max_by(F.struct(*fields), version).alias("r")).select("run_id", "position", "r.*")


def mapping_changes(old: DataFrame, new: DataFrame, flagged: DataFrame) -> DataFrame:
    """Chapters whose ordered media list changed; the review flag is sticky.

    ``old``/``new`` are ``(chapter_id, position, fingerprint, start_ms, end_ms)``.
    """
    def signature(links: DataFrame, name: str) -> DataFrame:
        line = F.concat_ws(":", "fingerprint", "start_ms", "end_ms")
        return ordered_digest(links.withColumn("__line", line), CHAPTER, "__line", "|", name)

    sides = signature(old, "before").join(signature(new, "after"), "chapter_id", "full")
    changed = F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("after"))
    return sides.join(flagged.select("chapter_id", F.col("needs_review").alias("__was")), "chapter_id", "full").select(
        "chapter_id", (F.coalesce(changed, F.lit(False)) | F.coalesce("__was", F.lit(False))).alias("needs_review"))


def media_usage(assets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets in use, and assets that may be removed."""
    return assets.join(links, "audio_id", "left_semi"), assets.join(links, "audio_id", "left_anti")


def apply_library(assets: DataFrame, staged: DataFrame, markers: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """Apply a staged media library.

    Staged assets with temporary negative ids get ids after the largest existing one;
    markers and links follow.  ``problems`` lists duplicate paths and unknown ids; links
    are renumbered per chapter.  Assets absent from ``staged`` disappear.
    """
    problems = staged.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("audio_id").alias("audio_id")).filter("n > 1").select(
        "audio_id", F.lit("duplicate path").alias("problem")).unionByName(
        staged.filter("audio_id > 0").join(assets, "audio_id", "left_anti").select("audio_id", F.lit("unknown id").alias("problem")))
    fresh = number_rows(staged.filter("audio_id < 0").select(F.lit(0).alias("g"), "position", "audio_id"),
                        Seq(("g",), ("position", "audio_id"), by="position"), "k", 1)
    top = assets.agg(F.coalesce(F.max("audio_id"), F.lit(0)).alias("top"))
    ids = fresh.crossJoin(F.broadcast(top)).select(F.col("audio_id").alias("__old"), (F.col("top") + F.col("k")).alias("__new"))

    def rewrite(df: DataFrame) -> DataFrame:
        return df.join(ids, df["audio_id"] == ids["__old"], "left").withColumn(
            "audio_id", F.coalesce("__new", "audio_id")).drop("__old", "__new")

    final = rewrite(staged)
    live = rewrite(links).join(final.select("audio_id"), "audio_id", "left_semi")
    renumbered = number_rows(live.withColumnRenamed("position", "__was"), Seq(order=("__was", "audio_id", "source_start_ms"), by="__was"), "position").drop("__was")
    return {"assets": final, "markers": rewrite(markers).join(final.select("audio_id"), "audio_id", "left_semi"),
            "links": renumbered, "problems": problems}


def snapshot_audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows missing, changed or moved in a new snapshot.

    Both sides are ``(segment_id, chapter_id, text, start_ms, end_ms)``.
    """
    new = actual.select("segment_id", F.col("chapter_id").alias("c"), F.col("text").alias("t"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    j = expected.join(new, "segment_id", "left")
    verdict = (
        F.when(F.col("c").isNull(), F.lit("missing")).when(~F.col("text").eqNullSafe(F.col("t")), F.lit("text changed"))
        .when((F.col("start_ms") != F.col("s")) | (F.col("end_ms") != F.col("e")), F.lit("time changed"))
        .when(F.col("c") != F.col("chapter_id"), F.lit("moved")))
    return j.withColumn("finding", verdict).filter("finding is not null").select("segment_id", "chapter_id", "finding")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of named tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_fragments(chapters: DataFrame, fragments: DataFrame) -> DataFrame:
    """Chapters without fragments, to be back-filled."""
    return chapters.join(fragments, "chapter_id", "left_anti")


def assign_fragments(segments: DataFrame, fragments: DataFrame) -> DataFrame:
    """Owning fragment of each segment by its running text offset."""
    from timeweave.intervals import point_join
    from timeweave.operators.timeline import text_offsets

    placed = text_offsets(segments)
    frags = fragments.select("chapter_id", F.col("position").alias("fragment_position"), F.col("source_start_char").alias("f_start"),
                             F.col("source_end_char").alias("f_end"))
    own = point_join(placed, frags, ["chapter_id"], "start_char", ("f_start", "f_end"), width=4096).filter(
        "end_char <= f_end").groupBy("chapter_id", "position").agg(F.min("fragment_position").alias("fragment_position"))
    return placed.join(own, ["chapter_id", "position"], "left")
