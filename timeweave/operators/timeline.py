"""Timeline rules over ordered cues: neighbours, allocation and batch edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import join_cue_texts, spoken_units
from timeweave.intervals import within_join
from timeweave.functions.timecode import silence_edges
from timeweave.ordered import CHAPTER, Agg, Seq, finish, number_rows, prepare, prev, refine, scan


def timed(prefix: str = "") -> Column:
    """A row occupies a real interval (B1)."""
    return F.col(f"{prefix}end_ms") > F.col(f"{prefix}start_ms")


def timed_neighbours(df: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Nearest timed rows on both sides as ``before`` and ``after``; untimed rows are skipped."""
    df, seq = prepare(df, seq)
    row = F.when(timed(), F.struct(*seq.order, "start_ms", "end_ms", "locked"))
    return finish(scan(
        df, seq, {"before": Agg("last", row, False)}, {"after": Agg("last", row, False)},
    ))


def flag_conflicts(df: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Overlap with the nearest timed neighbour on either side."""
    near = timed_neighbours(df, seq)
    clash = timed() & (
        F.coalesce(F.col("before.end_ms") > F.col("start_ms"), F.lit(False))
        | F.coalesce(F.col("end_ms") > F.col("after.start_ms"), F.lit(False))
    )
    return near.withColumn("conflict", clash).drop("before", "after")


def review_class(conflict: Column) -> Column:
    """Review priority: conflict, low confidence, unmatched, locked."""
    return (
        F.when(conflict, F.lit("conflict"))
        .when(F.col("status") == "low_confidence", F.lit("low_confidence"))
        .when(F.col("status") == "unmatched", F.lit("unmatched"))
        .when(F.col("locked"), F.lit("locked"))
    )


def review_intervals(df: DataFrame) -> DataFrame:
    """Low-confidence and unmatched rows as drawable intervals."""
    return df.filter(F.col("status").isin("low_confidence", "unmatched")).withColumn(
        "end_ms", F.greatest(F.col("start_ms") + 40, F.col("end_ms"))
    )


def enforce_monotonic(df: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """No cue starts before an earlier one has ended.

    The sequential cursor is a running maximum, so no fold is needed.
    """
    df, seq = prepare(df, seq)
    reach = F.greatest(F.col("start_ms"), F.col("end_ms"), F.lit(0))
    out = scan(df, seq, {"__cursor": Agg("max", reach, False)})
    start = F.greatest(F.coalesce(F.col("__cursor"), F.lit(0)), F.col("start_ms"))
    return finish(
        out.withColumn("start_ms", start).withColumn("end_ms", F.greatest(F.col("start_ms"), F.col("end_ms")))
    ).drop("__cursor")


def fill_gaps(df: DataFrame, language: str = "auto", seq: Seq = CHAPTER) -> DataFrame:
    """Give whole untimed runs between two timed rows proportional times (E5).

    Every row gets at least one millisecond.  With targets ``m`` capped so that the
    rest still fits, ``end_i = i + max(gap_start, max_{j<=i}(m_j - j))``.
    """
    df, seq = prepare(df, seq)
    base = df.withColumn("__w", spoken_units(F.col("text"), language).cast("long")).withColumn("__open", ~timed())
    marked = scan(
        base, seq,
        {
            "__run": Agg("sum", timed().cast("long")),
            "__n": Agg("sum", F.col("__open").cast("long")),
            "__cum": Agg("sum", F.when(F.col("__open"), F.col("__w")).otherwise(F.lit(0))),
            "__from": Agg("last", F.when(timed(), F.col("end_ms")), False),
        },
        {"__to": Agg("last", F.when(timed(), F.col("start_ms")), False)},
    )
    marked = finish(marked)
    keys = [*seq.group, "__run"]
    runs = marked.filter("__open").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum("__w").alias("__total"),
        F.min("__n").alias("__first"), F.min(F.col("__cum") - F.col("__w")).alias("__base"),
        F.max("locked").alias("__locked"),
        F.min("__from").alias("__lo"), F.min("__to").alias("__hi"),
    ).filter(~F.col("__locked") & (F.col("__hi") - F.col("__lo") >= F.col("__rows")))
    joined = marked.join(runs, keys, "left").withColumn(
        "__i", F.when(F.col("__open"), F.col("__n") - F.col("__first") + 1)
    )
    target = F.when(F.col("__i") == F.col("__rows"), F.col("__hi")).otherwise(
        F.col("__lo") + F.bround(
            (F.col("__hi") - F.col("__lo")) * (F.col("__cum") - F.col("__base")) / F.col("__total")
        ).cast("long")
    )
    capped = F.least(F.col("__hi") - (F.col("__rows") - F.col("__i")), target) - F.col("__i")
    joined = joined.withColumn("__m", F.greatest(F.col("__lo"), capped))
    inner, inner_seq = prepare(joined, refine(seq, tuple(keys)))
    out = finish(scan(inner, inner_seq, {
        "__end": Agg("max", F.col("__m")), "__prior": Agg("max", F.col("__m"), False),
    }))
    hit = F.col("__rows").isNotNull() & F.col("__open")
    out = out.withColumn("filled", hit).withColumn(
        "start_ms", F.when(hit, F.coalesce(F.col("__prior") + F.col("__i") - 1, F.col("__lo"))).otherwise(F.col("start_ms"))
    ).withColumn("end_ms", F.when(hit, F.col("__end") + F.col("__i")).otherwise(F.col("end_ms"))).withColumn(
        "status", F.when(hit, F.lit("manual")).otherwise(F.col("status"))
    )
    return out.select(*df.drop("__block").columns, "filled")


def distribute(
    df: DataFrame, span_start: Column, span_end: Column, proportional: bool = False, seq: Seq = CHAPTER,
) -> DataFrame:
    """Share an interval equally or by current duration; the last row takes the end.

    ``span_start``/``span_end`` must be constant within a group.  Locked rows consume
    their share unchanged.
    """
    df, seq = prepare(df, seq)
    weight = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")) if proportional else F.lit(1).cast("long")
    df = df.withColumn("__w", weight).withColumn("__lo", span_start).withColumn("__hi", span_end)
    totals = df.groupBy(*seq.group).agg(F.sum("__w").alias("__total"))
    df = df.join(totals, list(seq.group)).withColumn("__share", F.bround(
        (F.col("__hi") - F.col("__lo")) * F.col("__w") / F.col("__total")
    ).cast("long"))
    out = finish(scan(
        df, seq, {"__before": Agg("sum", F.col("__share"), False)}, {"__next": prev(*seq.order)},
    ))
    start = F.col("__lo") + F.coalesce(F.col("__before"), F.lit(0))
    end = F.when(F.col("__next").isNull(), F.col("__hi")).otherwise(start + F.col("__share"))
    free = ~F.col("locked")
    return out.withColumn("__s", start).withColumn("__e", end).withColumn(
        "start_ms", F.when(free, F.col("__s")).otherwise(F.col("start_ms"))
    ).withColumn("end_ms", F.when(free, F.col("__e")).otherwise(F.col("end_ms"))).withColumn(
        "status", F.when(free, F.lit("manual")).otherwise(F.col("status"))
    ).drop("__w", "__lo", "__hi", "__total", "__share", "__before", "__next", "__s", "__e")


def renumber(df: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Dense positions after inserts, deletes, moves or merges."""
    numbered = number_rows(df, seq, "__position")
    return numbered.withColumn(seq.order[0], F.col("__position").cast("long")).drop("__position")


def text_offsets(df: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Running character offsets of the row texts."""
    df, seq = prepare(df, seq)
    out = finish(scan(df, seq, {"end_char": Agg("sum", F.length("text").cast("long"))}))
    return out.withColumn("start_char", F.col("end_char") - F.length("text"))


def timing_anchors(df: DataFrame, method: str = "silence-length-estimate", seq: Seq = CHAPTER) -> DataFrame:
    """One anchor per timed row over its running text range."""
    return text_offsets(df, seq).filter(timed()).select(
        *seq.group, *seq.order, F.col("start_char").alias("source_start_char"),
        F.col("end_char").alias("source_end_char"), "start_ms", "end_ms", "confidence",
        F.lit(method).alias("method"),
    )


def extend_ends(df: DataFrame, maximum_ms: int = 500, seq: Seq = CHAPTER) -> DataFrame:
    """Close short gaps between directly adjacent timed rows; timed rows only."""
    df, seq = prepare(df, seq)
    out = finish(scan(df, seq, None, {"__next": prev("start_ms", "end_ms")}))
    gap = F.col("__next.start_ms") - F.col("end_ms")
    close = (F.col("__next.end_ms") > F.col("__next.start_ms")) & (gap > 0) & (gap <= maximum_ms)
    return out.filter(timed()).withColumn(
        "end_ms", F.when(F.coalesce(close, F.lit(False)), F.col("__next.start_ms")).otherwise(F.col("end_ms"))
    ).drop("__next")


def nearest_silence(edits: DataFrame, silences: DataFrame, window_ms: int = 250, group: str = "chapter_id") -> DataFrame:
    """Snap ``at_ms`` to the nearest silence edge: the trailing edge for starts, the
    leading edge for ends, unchanged when none is inside the window (C10)."""
    edges = silences.select(group, silence_edges(F.col("time_ms"), F.col("start_ms"), F.col("end_ms")).alias("e"))
    targets = edges.select(group, F.explode(F.array(
        F.struct(F.lit("start").alias("for_kind"), F.col("e.following_start").alias("edge_ms")),
        F.struct(F.lit("end").alias("for_kind"), F.col("e.previous_end").alias("edge_ms")),
    )).alias("t")).select(group, "t.*").distinct()
    keyed = edits.select(group, "position", "kind", "at_ms")
    pairs = within_join(keyed, targets, [group], "at_ms", "edge_ms", window_ms).filter("kind = for_kind")
    best = pairs.groupBy(group, "position", "kind").agg(
        F.min(F.struct(F.abs(F.col("edge_ms") - F.col("at_ms")).alias("d"), "edge_ms")).alias("b")
    ).select(group, "position", "kind", F.col("b.edge_ms").alias("__edge"))
    return edits.join(best, [group, "position", "kind"], "left").withColumn(
        "snapped_ms", F.coalesce("__edge", "at_ms")
    ).drop("__edge")


def _settle_neighbours(joined: DataFrame, policy: str, minimum: int = 100) -> DataFrame:
    """Overlap policy for the edited row and, when trimming, its neighbours.

    Expects ``before``/``after`` neighbours, edited ``start_ms``/``end_ms`` and ``kind``.
    Adds ``before_end``/``after_start`` with trimmed neighbour edges.
    """
    before_end, after_start = F.col("before.end_ms"), F.col("after.start_ms")
    low = F.col("kind").isin("start", "body") & (F.col("start_ms") < before_end)
    low = F.coalesce(low, F.lit(False))
    trim_low = (
        F.lit(policy == "trim_neighbors") & ~F.col("before.locked")
        & (F.col("before.start_ms") + minimum <= F.col("start_ms"))
    )
    out = joined.withColumn("before_end", F.when(low & trim_low, F.col("start_ms"))).withColumn(
        "start_ms", F.when(low & ~trim_low & (F.lit(policy != "allow_overlap")), before_end).otherwise(F.col("start_ms"))
    )
    high = F.coalesce(F.col("kind").isin("end", "body") & (F.col("end_ms") > after_start), F.lit(False))
    trim_high = (
        F.lit(policy == "trim_neighbors") & ~F.col("after.locked")
        & (F.col("after.end_ms") - minimum >= F.col("end_ms"))
    )
    out = out.withColumn("after_start", F.when(high & trim_high, F.col("end_ms"))).withColumn(
        "end_ms", F.when(high & ~trim_high & (F.lit(policy != "allow_overlap")), after_start).otherwise(F.col("end_ms"))
    )
    inverted = (F.col("end_ms") < F.col("start_ms")) & F.lit(policy != "allow_overlap")
    return out.withColumn(
        "__s", F.when(inverted & (F.col("kind") == "start"), F.col("end_ms")).otherwise(F.col("start_ms"))
    ).withColumn(
        "end_ms", F.when(inverted & (F.col("kind") != "start"), F.col("start_ms")).otherwise(F.col("end_ms"))
    ).withColumn("start_ms", F.col("__s")).drop("__s")


def _write_back(segments: DataFrame, settled: DataFrame, seq: Seq) -> DataFrame:
    """Apply edited rows and trimmed neighbours to the table."""
    keys = [*seq.group, *seq.order]
    pos = seq.order[0]
    own = settled.select(*keys, F.col("start_ms").alias("new_start"), F.col("end_ms").alias("new_end"))
    left = settled.filter("before_end is not null").select(
        *seq.group, F.col(f"before.{pos}").alias(pos), F.lit(None).cast("long").alias("new_start"),
        F.col("before_end").alias("new_end"))
    right = settled.filter("after_start is not null").select(
        *seq.group, F.col(f"after.{pos}").alias(pos), F.col("after_start").alias("new_start"),
        F.lit(None).cast("long").alias("new_end"))
    changes = own.unionByName(left).unionByName(right).groupBy(*keys).agg(
        F.max("new_start").alias("new_start"), F.max("new_end").alias("new_end")
    ).withColumn("__changed", F.lit(True))
    return segments.join(changes, keys, "left").withColumn(
        "start_ms", F.coalesce("new_start", "start_ms")
    ).withColumn("end_ms", F.coalesce("new_end", "end_ms")).withColumn(
        "status", F.when(F.col("__changed"), F.lit("manual")).otherwise(F.col("status"))
    ).drop("new_start", "new_end", "__changed")


def move_boundaries(
    segments: DataFrame, edits: DataFrame, policy: str = "clamp_current", seq: Seq = CHAPTER,
) -> DataFrame:
    """Move one boundary per chapter and pass: ``edits(chapter_id, position, kind, at_ms)``.

    A pass holds at most one edit per chapter, as every edit sees the one before it.
    """
    near = timed_neighbours(segments, seq)
    joined = near.join(edits, [*seq.group, *seq.order]).filter(~F.col("locked"))
    joined = joined.withColumn("__s", F.when(
        F.col("kind") == "start", F.greatest(F.lit(0), F.least(F.col("end_ms"), F.col("at_ms")))
    ).otherwise(F.col("start_ms"))).withColumn("end_ms", F.when(
        F.col("kind") == "end", F.greatest(F.col("start_ms"), F.col("at_ms"))
    ).otherwise(F.col("end_ms"))).withColumn("start_ms", F.col("__s")).drop("__s")
    return _write_back(segments, _settle_neighbours(joined, policy), seq)


def shift_cues(
    segments: DataFrame, shifts: DataFrame, policy: str = "clamp_current", seq: Seq = CHAPTER,
) -> DataFrame:
    """Move whole cues by ``delta_ms`` inside their neighbours and the chapter.

    ``shifts(chapter_id, position, delta_ms, chapter_end_ms)``, one per chapter and pass.
    """
    near = timed_neighbours(segments, seq)
    duration = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    joined = near.join(shifts, [*seq.group, *seq.order]).filter(~F.col("locked") & (F.col("delta_ms") != 0))
    joined = joined.withColumn("__d", duration)
    end = F.col("chapter_end_ms")
    start = F.greatest(F.lit(0), F.least(
        F.greatest(F.lit(0), end - F.col("__d")), F.col("start_ms") + F.col("delta_ms"),
    ))
    if policy == "clamp_current":
        low = F.coalesce(F.col("before.end_ms"), F.lit(0))
        high = F.coalesce(F.col("after.start_ms") - F.col("__d"), end - F.col("__d"))
        start = F.greatest(low, F.least(F.greatest(low, high), start))
    joined = joined.withColumn("start_ms", start).withColumn(
        "end_ms", F.col("start_ms") + F.col("__d")
    ).withColumn("kind", F.lit("body"))
    return _write_back(segments, _settle_neighbours(joined, policy), seq)


def shift_following(segments: DataFrame, points: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Shift every later unlocked timed row: ``points(chapter_id, after_position, delta_ms)``."""
    joined = segments.join(points, list(seq.group), "left")
    moved = F.coalesce(
        (F.col(seq.order[0]) > F.col("after_position")) & ~F.col("locked") & timed(), F.lit(False)
    )
    start = F.greatest(F.lit(0), F.col("start_ms") + F.col("delta_ms"))
    return joined.withColumn("__s", F.when(moved, start).otherwise(F.col("start_ms"))).withColumn(
        "end_ms", F.when(moved, F.greatest(F.col("__s"), F.col("end_ms") + F.col("delta_ms"))).otherwise(F.col("end_ms"))
    ).withColumn("start_ms", F.col("__s")).drop("__s", "after_position", "delta_ms")


def bind_selection(segments: DataFrame, selection: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Set chosen unlocked rows to a selected interval."""
    chosen = selection.select(*seq.group, *seq.order, F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    joined = segments.join(chosen, [*seq.group, *seq.order], "left")
    hit = F.col("__s").isNotNull() & ~F.col("locked")
    return joined.withColumn("start_ms", F.when(hit, F.col("__s")).otherwise(F.col("start_ms"))).withColumn(
        "end_ms", F.when(hit, F.col("__e")).otherwise(F.col("end_ms"))
    ).withColumn("status", F.when(hit, F.lit("manual")).otherwise(F.col("status"))).drop("__s", "__e")


def clear_timing(segments: DataFrame, chosen: Column) -> DataFrame:
    """Chosen unlocked rows lose their times and become unmatched."""
    hit = chosen & ~F.col("locked")
    zero = {"start_ms": F.lit(0).cast("long"), "end_ms": F.lit(0).cast("long"),
            "confidence": F.lit(0.0), "status": F.lit("unmatched")}
    return segments.withColumn("__hit", hit).withColumns({
        name: F.when(F.col("__hit"), value).otherwise(F.col(name)) for name, value in zero.items()
    }).drop("__hit")


def drop_anchors_of(anchors: DataFrame, segments: DataFrame, chosen: Column) -> DataFrame:
    """Anchors without those of cleared rows."""
    cleared = segments.filter(chosen & ~F.col("locked")).select("chapter_id", "segment_id")
    return anchors.join(cleared, ["chapter_id", "segment_id"], "left_anti")


def delete_rows(segments: DataFrame, chosen: Column, seq: Seq = CHAPTER) -> DataFrame:
    """Delete: recognised and user rows go, source and subtitle rows become unmatched,
    locked rows stay; positions are renumbered (E31)."""
    removable = chosen & ~F.col("locked") & F.col("origin").isin("asr", "user")
    kept = clear_timing(
        segments.filter(~removable), chosen & F.col("origin").isin("source", "subtitle"),
    )
    return renumber(kept, seq)


def merge_rows(segments: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Merge rows that share ``merge_group`` (null: untouched) into one.

    Groups with a locked row or with holes in their positions are refused and kept.
    """
    pos = seq.order[0]
    keys = [*seq.group, "merge_group"]
    facts = segments.filter("merge_group is not null").groupBy(*keys).agg(
        (~F.max("locked") & (F.max(pos) - F.min(pos) + 1 == F.count(F.lit(1)))).alias("__ok")
    )
    marked = segments.join(facts, keys, "left").withColumn(
        "__key", F.when(F.col("__ok"), F.col("merge_group"))
    )
    parts = F.array_sort(F.collect_list(F.struct(pos, "text")))
    single = marked.filter("__key is null").drop("__key", "__ok", "merge_group")
    merged = marked.filter("__key is not null").groupBy(*seq.group, "__key").agg(
        F.min(pos).alias(pos), join_cue_texts(F.transform(parts, lambda p: p["text"])).alias("text"),
        F.coalesce(F.min(F.when(timed(), F.col("start_ms"))), F.lit(0)).alias("start_ms"),
        F.coalesce(F.max(F.when(timed(), F.col("end_ms"))), F.lit(0)).alias("end_ms"),
        F.min("confidence").alias("confidence"),
        F.when(F.max(timed()), F.lit("manual")).otherwise(F.lit("unmatched")).alias("status"),
        F.lit(False).alias("locked"), F.min_by("origin", pos).alias("origin"),
    ).drop("__key")
    return renumber(single.unionByName(merged, allowMissingColumns=True), seq)


def shift_pairings(links: DataFrame, chapters: DataFrame, amount: int) -> DataFrame:
    """Move every pairing by ``amount`` chapters in chapter order."""
    book = Seq(("book_id",), ("position", "chapter_id"), by="position")
    ranked = number_rows(chapters.select("book_id", "chapter_id", "position"), book, "__rank")
    here = ranked.select("book_id", "chapter_id", "__rank")
    there = ranked.select(
        "book_id", F.col("chapter_id").alias("__target"), (F.col("__rank") - amount).alias("__rank")
    )
    return links.join(here, ["book_id", "chapter_id"]).join(there, ["book_id", "__rank"]).select(
        F.col("__target").alias("chapter_id"), *[c for c in links.columns if c != "chapter_id"]
    )


def changed_rows(before: DataFrame, after: DataFrame, seq: Seq = CHAPTER) -> DataFrame:
    """Number of rows whose times a retiming changed, per group."""
    old = before.select(*seq.group, *seq.order, F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    same = F.col("start_ms").eqNullSafe(F.col("__s")) & F.col("end_ms").eqNullSafe(F.col("__e"))
    return after.join(old, [*seq.group, *seq.order]).groupBy(*seq.group).agg(
        F.count_if(~same).alias("changed")
    )


def rows_at(segments: DataFrame, times: DataFrame) -> DataFrame:
    """First row containing a time, half-open."""
    from timeweave.intervals import point_join

    pairs = point_join(times, segments.select(
        "chapter_id", "position", "start_ms", "end_ms"
    ), ["chapter_id"], "at_ms", ("start_ms", "end_ms"))
    return pairs.groupBy("chapter_id", "at_ms").agg(F.min("position").alias("position"))
