"""Restoring, splitting and rebinding cues, and page-level merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.sentences import split_sentences
from timeweave.functions.text import BLANKS, collapse, normalize_for_match, normalize_title, preferred_split, strip
from timeweave.intervals import asof_join, overlap_join, point_join
from timeweave.ordered import CHAPTER, Agg, Seq, finish, number_rows, prepare, prev, refine, scan
from timeweave.sweeps import smallest_containing


def restore_chapters(fragments: DataFrame, anchors: DataFrame) -> DataFrame:
    """Re-split the source fragments and give every sentence the times of the anchors that
    touch its characters (C11)."""
    pieces = fragments.select("chapter_id", F.col("position").alias("fragment_position"), "source_start_char",
                              F.posexplode_outer(split_sentences(F.col("text"))).alias("n", "s")).filter(F.col("n").isNotNull())
    pieces = pieces.select("chapter_id", "fragment_position", "n", F.col("s.text").alias("text"),
                           (F.col("source_start_char") + F.col("s.start_char")).alias("p_start"),
                           (F.col("source_start_char") + F.col("s.end_char")).alias("p_end"))
    keys = ["chapter_id", "fragment_position", "n"]
    hits = overlap_join(pieces.select(*keys, "p_start", "p_end"), anchors.select(
        "chapter_id", "source_start_char", "source_end_char", "start_ms", "end_ms", "confidence"), ["chapter_id"],
        ("p_start", "p_end"), ("source_start_char", "source_end_char"), width=4096).groupBy(*keys).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("confidence").alias("confidence"))
    out = pieces.join(hits, keys, "left").withColumn("status", F.when(F.col("start_ms").isNull(), F.lit("unmatched")).otherwise(F.lit("auto"))).na.fill(
        {"start_ms": 0, "end_ms": 0, "confidence": 0.0})
    return number_rows(out, Seq(order=("fragment_position", "n"), by="fragment_position"), "position").select(
        "chapter_id", "position", "fragment_position", "text", F.col("p_start").alias("source_start_char"),
        F.col("p_end").alias("source_end_char"), "start_ms", "end_ms", "confidence", "status")


def rebind_anchors(anchors: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Anchors bound to new rows: the row at the old position, else the row whose
    character range contains the anchor (C12)."""
    by_place = old.select("chapter_id", "segment_id", "position").join(
        new.select("chapter_id", "position", F.col("segment_id").alias("__a")), ["chapter_id", "position"]).drop("position")
    ranges = new.filter("source_start_char is not null and source_end_char is not null").select(
        "chapter_id", "position", F.col("segment_id").alias("__b"), F.col("source_start_char").alias("r_start"), F.col("source_end_char").alias("r_end"))
    keyed = anchors.join(by_place, ["chapter_id", "segment_id"], "left")
    inside = point_join(keyed.filter("__a is null").select("chapter_id", "anchor_id", "source_start_char", "source_end_char"), ranges,
                        ["chapter_id"], "source_start_char", ("r_start", "r_end"), width=4096, closed=True).filter(
        "source_end_char <= r_end").groupBy("chapter_id", "anchor_id").agg(F.min_by("__b", "position").alias("__b"))
    return keyed.join(inside, ["chapter_id", "anchor_id"], "left").withColumn(
        "segment_id", F.coalesce("__a", "__b")).drop("__a", "__b")


def bind_by_offsets(anchors: DataFrame, segments: DataFrame) -> DataFrame:
    """Anchors bound by running text offsets, as when publishing a result."""
    from timeweave.operators.timeline import text_offsets

    spans = text_offsets(segments).select("chapter_id", "position", F.col("segment_id").alias("__id"), F.col("start_char").alias("r_start"),
                                          F.greatest(F.col("start_char") + 1, F.col("end_char")).alias("r_end"))
    hit = point_join(anchors.select("chapter_id", "anchor_id", "source_start_char"), spans, ["chapter_id"], "source_start_char",
                     ("r_start", "r_end"), width=4096).groupBy("chapter_id", "anchor_id").agg(F.min_by("__id", "position").alias("__id"))
    return anchors.drop("segment_id").join(hit, ["chapter_id", "anchor_id"], "left").withColumnRenamed("__id", "segment_id")


def bind_to_children(anchors: DataFrame, children: DataFrame) -> DataFrame:
    """Anchors of a split cue bound to a child: by character midpoint, else the last child
    around the time midpoint, else the first child (C12).

    ``anchors(cue_id, anchor_id, …)``, ``children(cue_id, child_no, …)``.
    """
    pairs = anchors.join(children.select("cue_id", "child_no", F.col("source_start_char").alias("c0"), F.col("source_end_char").alias("c1"),
                                         F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1")), "cue_id")
    by_char = (F.col("source_start_char") + F.col("source_end_char")) / 2
    by_time = (F.col("start_ms") + F.col("end_ms")) / 2
    return pairs.groupBy("cue_id", "anchor_id").agg(F.coalesce(
        F.min(F.when((F.col("c0") <= by_char) & (by_char <= F.col("c1")), F.col("child_no"))),
        F.max(F.when((F.col("t0") <= by_time) & (by_time <= F.col("t1")), F.col("child_no"))), F.lit(0)).alias("child_no"))


def replace_anchors(anchors: DataFrame, affected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop anchors that overlap an affected source range and add new ones shifted by it.

    ``affected(chapter_id, position, range_start, range_end)``; ``fresh`` carries
    ``position`` and cue-local characters.
    """
    hit = overlap_join(anchors.select("chapter_id", "anchor_id", "source_start_char", "source_end_char"),
                       affected.select("chapter_id", "range_start", "range_end"), ["chapter_id"],
                       ("source_start_char", "source_end_char"), ("range_start", "range_end"), width=4096).select("chapter_id", "anchor_id").distinct()
    kept = anchors.join(hit, ["chapter_id", "anchor_id"], "left_anti")
    moved = fresh.join(affected.select("chapter_id", "position", "range_start"), ["chapter_id", "position"]).withColumn(
        "source_start_char", F.col("source_start_char") + F.col("range_start")).withColumn(
        "source_end_char", F.col("source_end_char") + F.col("range_start")).drop("position", "range_start")
    return kept.unionByName(moved, allowMissingColumns=True)


def offset_times(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Time of a text offset inside a cue.

    ``points(cue_id, point_id, at_char, fallback_ms, start_ms, end_ms)``,
    ``anchors(cue_id, a_start, a_end, t_start, t_end)`` in the same characters.  The smallest
    containing anchor (of equal ones the first) is interpolated; else the next anchor's start; else the previous
    one's end; times outside the cue are projected back by the anchors' overall span.
    """
    key = ("cue_id",)
    place = F.struct("point_id", "at_char").alias("__point")
    inside = smallest_containing(points.select("cue_id", place, "at_char"), anchors.select("cue_id", "a_start", "a_end", "t_start", "t_end"),
                                 "cue_id", "__point", "at_char", ("a_start", "a_end"), "__s")
    ratio = (F.col("__point.at_char") - F.col("__s.a_start")) / F.greatest(F.lit(1), F.col("__s.a_end") - F.col("__s.a_start"))
    within = inside.select("cue_id", "__point.point_id", F.bround(F.col("__s.t_start") + ratio * (F.col("__s.t_end") - F.col("__s.t_start"))).cast("long").alias("__in"))
    before = asof_join(points, anchors, key, "at_char", "a_end", ["t_end"], name="__before")
    both = asof_join(before, anchors, key, "at_char", "a_start", ["t_start"], backward=False, name="__after")
    span = anchors.groupBy("cue_id").agg(F.min("t_start").alias("__lo"), F.max("t_end").alias("__hi"))
    j = both.join(within, ["cue_id", "point_id"], "left").join(span, "cue_id", "left")
    j = j.withColumn("__t", F.coalesce("__in", "__after.t_start", "__before.t_end", "fallback_ms"))
    stray = F.col("__lo").isNotNull() & (F.col("__hi") > F.col("__lo")) & ~((F.col("__t") > F.col("start_ms")) & (F.col("__t") < F.col("end_ms")))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("__t") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))))
    time = F.when(stray, F.col("start_ms") + F.bround(share * (F.col("end_ms") - F.col("start_ms"))).cast("long")).otherwise(F.col("__t"))
    bounded = F.when(F.col("end_ms") - F.col("start_ms") < 2, F.lit(0)).otherwise(
        F.greatest(F.col("start_ms") + 1, F.least(F.col("end_ms") - 1, time)))
    return j.select(*points.columns, bounded.cast("long").alias("time_ms"))


def split_by_punctuation(segments: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """Unlocked cues with several sentences become one cue per sentence.

    Child ends follow ``offset_times`` (or the text share), at least ``minimum`` ms apart and
    early enough for the rest: the same closed form as gap filling.
    """
    rows = segments.filter("not locked").withColumn("__p", split_sentences(F.col("text"))).filter(F.size("__p") > 1)
    rows = rows.withColumn("__n", F.size("__p")).withColumn("__d", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).withColumn(
        "__timed", F.col("__d") >= F.col("__n")).withColumn(
        "__min", F.greatest(F.lit(1), F.least(F.lit(200), F.floor(F.col("__d") / F.greatest(F.lit(1), F.col("__n") * 4)))).cast("long"))
    flat = rows.select("chapter_id", "position", "start_ms", "end_ms", "confidence", "origin", F.length("text").alias("__len"),
                       F.col("source_start_char").alias("__b0"), F.col("source_end_char").alias("__b1"), "__n", "__d", "__timed", "__min",
                       F.posexplode("__p").alias("i", "s"))
    share = F.col("start_ms") + F.bround(F.col("__d") * F.col("s.end_char") / F.greatest(F.lit(1), F.col("__len"))).cast("long")
    flat = flat.withColumn("__fallback", share).withColumn("cue_id", F.concat_ws(":", "chapter_id", "position"))
    if anchors is None:
        flat = flat.withColumn("__t", F.greatest(F.col("start_ms") + 1, F.least(F.col("end_ms") - 1, F.col("__fallback"))))
    else:
        points = flat.select("cue_id", F.col("i").alias("point_id"), F.col("s.end_char").alias("at_char"), F.col("__fallback").alias("fallback_ms"), "start_ms", "end_ms")
        flat = flat.join(offset_times(points, anchors).select("cue_id", F.col("point_id").alias("i"), F.col("time_ms").alias("__t")), ["cue_id", "i"])
    last = F.col("i") == F.col("__n") - 1
    latest = F.col("end_ms") - (F.col("__n") - F.col("i") - 1) * F.col("__min")
    flat = flat.withColumn("__m", F.when(last, F.col("end_ms")).otherwise(F.least(latest, F.col("__t"))) - (F.col("i") + 1) * F.col("__min"))
    flat, seq = prepare(flat, Seq(("chapter_id", "position"), ("i",)))
    out = finish(scan(flat, seq, {"__run": Agg("max", F.col("__m"))}))
    end = F.when(F.col("i") == F.col("__n") - 1, F.col("end_ms")).otherwise(
        F.greatest(F.col("start_ms"), F.col("__run")) + (F.col("i") + 1) * F.col("__min"))
    out = out.withColumn("__e", F.when(F.col("__timed"), end).otherwise(F.lit(0)))
    out, seq = prepare(out, refine(seq, ("chapter_id", "position")))
    out = finish(scan(out, seq, {"__prev": prev("__e")}))
    span = F.col("__b1") - F.col("__b0")

    def source(at: str) -> Column:
        return F.when(span == F.col("__len"), F.col("__b0") + F.col(at)).otherwise(
            F.col("__b0") + F.bround(span * F.col(at) / F.greatest(F.lit(1), F.col("__len"))).cast("long"))

    return out.select(
        "chapter_id", "position", F.col("i").alias("child_no"), F.col("s.text").alias("text"),
        F.when(F.col("__timed"), F.coalesce(F.col("__prev.__e"), F.col("start_ms"))).otherwise(F.lit(0)).cast("long").alias("start_ms"),
        F.col("__e").cast("long").alias("end_ms"), "confidence", F.when(F.col("__timed"), F.lit("manual")).otherwise(F.lit("unmatched")).alias("status"),
        "origin", source("s.start_char").alias("source_start_char"), source("s.end_char").alias("source_end_char"))


def split_at_time(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Split unlocked cues at a time, at the readable text offset nearest to its share.

    ``cuts(chapter_id, position, at_ms)``; both children keep provenance.
    """
    rows = segments.join(cuts, ["chapter_id", "position"]).filter(
        ~F.col("locked") & (F.col("start_ms") < F.col("at_ms")) & (F.col("at_ms") < F.col("end_ms")))
    near = F.bround(F.length("text") * (F.col("at_ms") - F.col("start_ms")) / (F.col("end_ms") - F.col("start_ms"))).cast("int")
    rows = rows.withColumn("__o", preferred_split(F.col("text"), near)).filter((F.col("__o") > 0) & (F.col("__o") < F.length("text")))
    left = F.rtrim(F.substring("text", F.lit(1), F.col("__o")), F.lit(BLANKS))
    tail = F.substring(F.col("text"), F.col("__o") + 1, F.length("text"))
    right = F.ltrim(tail, F.lit(BLANKS))
    rows = rows.withColumn("__l", left).withColumn("__r", right).withColumn("__skip", F.length(tail) - F.length(right)).filter("__l <> '' and __r <> ''")
    return rows.select("chapter_id", "position", "confidence", "origin", F.lit("manual").alias("status"), F.explode(F.array(
        F.struct(F.lit(0).alias("child_no"), F.col("__l").alias("text"), F.col("start_ms"), F.col("at_ms").alias("end_ms"), F.col("source_start_char"),
                 (F.col("source_start_char") + F.length("__l")).alias("source_end_char")),
        F.struct(F.lit(1).alias("child_no"), F.col("__r").alias("text"), F.col("at_ms").alias("start_ms"), F.col("end_ms"),
                 (F.col("source_start_char") + F.col("__o") + F.col("__skip")).alias("source_start_char"), F.col("source_end_char")),
    )).alias("c")).select("chapter_id", "position", "confidence", "origin", "status", "c.*")


def merge_title_pages(pages: DataFrame) -> DataFrame:
    """Mark pages that merge into the next one.

    ``pages(book_id, spine_pos, title, text, n_fragments, headings_only)``, covers already
    dropped.  ``merge`` is ``title`` (the next page's first line repeats this page),
    ``label`` (a spoken chapter label page) or null; merged pairs never overlap: in a run
    of candidates every second page starts a pair.
    """
    rows = number_rows(pages, Seq(("book_id",), ("spine_pos",)), "__i")
    rows = rows.withColumn("__key", normalize_for_match(F.col("text"))).withColumn("__first", normalize_for_match(
        F.regexp_extract("text", r"^\s*([^\n]*)", 1))).withColumn("__len", F.length("text"))
    rows, seq = prepare(rows, Seq(("book_id",), ("__i",)))
    rows = scan(rows, seq, None, {"__next": prev("__first", "__len", "title", "spine_pos")})
    big = (F.col("__len") > 0) & (F.col("__next.__len") >= F.col("__len") * 5)
    title = big & (F.col("__len") <= 200) & (F.col("__key") != "") & (F.col("__key") == F.col("__next.__first"))
    label = big & (F.col("__len") <= 120) & F.col("__key").startswith("chapter") & (F.col("n_fragments") <= 3) & F.col("headings_only")
    rows = rows.withColumn("__kind", F.coalesce(F.when(label, F.lit("label")).when(title, F.lit("title")), F.lit("")))
    rows = scan(rows, seq, {"__stop": Agg("last", F.when(F.col("__kind") == "", F.col("__i")))})
    rows = rows.withColumn("__start", (F.col("__kind") != "") & ((F.col("__i") - F.coalesce("__stop", F.lit(-1)) - 1) % 2 == 0))
    rows = finish(scan(rows, seq, {"__prev": prev("__start", "__kind", "__len", "title", "spine_pos")}))
    absorbed = F.coalesce(F.col("__prev.__start"), F.lit(False))
    kind = F.when(absorbed, F.col("__prev.__kind"))
    rows = rows.filter(~F.col("__start"))
    return rows.select(
        "book_id", F.when(absorbed, F.col("__prev.spine_pos")).otherwise(F.col("spine_pos")).alias("spine_pos"), F.col("spine_pos").alias("body_spine_pos"),
        F.when(kind == "label", F.concat(F.col("__prev.title"), F.lit(" — "), F.col("title"))).when(kind == "title", F.col("__prev.title")).otherwise(F.col("title")).alias("title"),
        F.when(kind == "label", F.col("__prev.__len") + 2).otherwise(F.lit(0)).cast("long").alias("offset_shift"), kind.alias("merged"))


def head_title_rows(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Rows that repeat an invisible document title and have no source provenance."""
    heads = chapters.select("chapter_id", collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("__t")).filter("__t <> ''")
    return segments.join(heads, "chapter_id").filter(
        (collapse(F.col("text")) == F.col("__t")) & F.col("source_fragment_id").isNull() & F.col("source_start_char").isNull()).drop("__t")


def heading_rows(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Timed rows at the top of a chapter that speak its title."""
    keys = chapters.select("chapter_id", normalize_title(F.col("title")).alias("__t")).filter("__t <> ''")
    return segments.filter("position <= 1 and end_ms > start_ms").join(keys, "chapter_id").filter(
        normalize_title(F.col("text")) == F.col("__t")).drop("__t")


def page_hits(cues: DataFrame, pages: DataFrame) -> DataFrame:
    """Where the text of a cue first occurs in each page, in characters of the normalised page.

    ``cues(item_id, text)``, ``pages(doc_id, text)``.
    """
    from timeweave.operators.location import locate_passages

    return locate_passages(cues, pages, minimum=1.0, short=1.0).select("item_id", "doc_id", F.col("start_char").alias("offset"))


def backfill_fragments(segments: DataFrame, missing: DataFrame) -> DataFrame:
    """One fragment per segment for chapters that lack fragments."""
    from timeweave.operators.timeline import text_offsets

    rows = segments.join(missing.select("chapter_id"), "chapter_id", "left_semi")
    return text_offsets(rows).select("chapter_id", "position", F.lit("segment").alias("kind"), "text",
                                     F.col("start_char").alias("source_start_char"), F.col("end_char").alias("source_end_char"))


def key_of(text: Column) -> Column:
    return F.sha2(normalize_for_match(strip(text)), 256)
