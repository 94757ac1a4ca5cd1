"""Plausibility of aligned blocks and their consolidation into one timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import CJK_LANGUAGES, spoken_units
from timeweave.functions.timecode import clamp01
from timeweave.intervals import within_join
from timeweave.operators.timeline import timed
from timeweave.ordered import CHAPTER, Agg, Seq, finish, fold, prepare, prev, scan


def usable_coverage(segments: DataFrame, minimum: float = 0.70, maximum_suffix: int = 2, group: str = "chapter_id") -> DataFrame:
    """Timed share of non-blank rows and length of the untimed tail (D3)."""
    content = segments.filter(F.trim("text") != "")
    last = content.groupBy(group).agg(F.max(F.when(timed(), F.col("position"))).alias("last_timed"))
    facts = content.join(last, group).groupBy(group).agg(
        F.avg(timed().cast("double")).alias("coverage"),
        F.count_if(F.col("last_timed").isNull() | (F.col("position") > F.col("last_timed"))).alias("trailing"),
        F.max("last_timed").alias("last_timed"),
    )
    return facts.select(group, "coverage", "trailing", (
        F.col("last_timed").isNotNull() & (F.col("coverage") >= minimum) & (F.col("trailing") <= maximum_suffix)
    ).alias("usable"))


def evaluate_progress(segments: DataFrame, tokens: DataFrame, windows: DataFrame, group: str = "chapter_id") -> DataFrame:
    """Accepted prefix, ratios and score of a block alignment.

    ``windows(chapter_id, window_ms)``.
    """
    bad = (F.col("status") == "unmatched") | ~timed()
    first_bad = segments.groupBy(group).agg(F.min(F.when(bad, F.col("position"))).alias("first_bad"))
    prefix = segments.join(first_bad, group).groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("first_bad").isNull() | (F.col("position") < F.col("first_bad"))).alias("accepted"),
        F.avg(F.when(F.col("first_bad").isNull() | (F.col("position") < F.col("first_bad")), clamp01(F.col("confidence")))).alias("mean_conf"),
    )
    toks = tokens.groupBy(group).agg(
        F.count(F.lit(1)).alias("tokens"), F.count_if(timed()).alias("timed_tokens"), F.max("end_ms").alias("last_end"),
    )
    j = prefix.join(toks, group, "left").join(windows, group).withColumn("w", F.greatest(F.lit(1), F.col("window_ms")))
    last = F.coalesce("last_end", F.lit(0))
    timed_ratio = F.coalesce("timed_tokens", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("tokens", F.lit(0)))
    used = clamp01(last / F.col("w"))
    touches = F.coalesce(F.col("tokens") > 0, F.lit(False)) & (last >= F.col("w") - 220)
    score = (
        F.col("accepted") / F.greatest(F.lit(1), F.col("rows")) * 0.55 + F.coalesce("mean_conf", F.lit(0.0)) * 0.25
        + timed_ratio * 0.15 + F.least(F.lit(1.0), used / 0.72) * 0.05
    ) - F.when(touches, 0.08).otherwise(0.0)
    return j.select(
        group, clamp01(score).alias("score"), F.col("accepted").alias("accepted_count"), timed_ratio.alias("timed_token_ratio"),
        used.alias("used_window_ratio"), touches.alias("touches_window_end"),
        ((F.col("accepted") < F.col("rows")) | touches).alias("needs_more_audio"),
        ((F.col("accepted") == F.col("rows")) & (F.greatest(F.lit(0), F.col("w") - last) >= F.greatest(
            F.lit(2000), F.bround(F.col("w") * 0.28)))).alias("may_contain_more_text"),
    )


REASONS = {
    "invalid": "invalid or out-of-range times", "order": "times are not monotone", "none": "no usable row times",
    "coverage": "some text has no time", "end": "may be cut at the end", "window": "unusual use of the window",
    "rate": "unusual speaking rate", "edge": "no strong silence at the end", "outlier": "row lengths do not fit the text",
}


def score_blocks(blocks: DataFrame, segments: DataFrame, tokens: DataFrame, silences: DataFrame, language: str = "auto") -> DataFrame:
    """Structural and acoustic plausibility of block alignments.

    ``blocks(block_id, chapter_id, audio_start_ms, audio_end_ms, rate, weak)`` with a
    nullable reference ``rate``; segments and tokens are keyed by ``block_id``.
    """
    base = blocks.withColumn("duration", F.greatest(F.lit(1), F.col("audio_end_ms") - F.col("audio_start_ms")))
    toks = tokens.join(base.select("block_id", "duration"), "block_id")
    broken = (F.col("start_ms") < 0) | (F.col("end_ms") < F.col("start_ms")) | (F.col("end_ms") > F.col("duration") + 250)
    order = Seq(("block_id",), ("token_pos",))
    live, order = prepare(toks.filter(timed()), order)
    live = finish(scan(live, order, {"__p": prev("end_ms")})).groupBy("block_id").agg(
        F.max("end_ms").alias("last_end"), F.count_if(F.col("__p.end_ms") > F.col("end_ms")).alias("inversions"))
    bad = toks.groupBy("block_id").agg(F.count_if(broken).alias("broken"))
    units = spoken_units(F.col("text"), language)
    rows = segments.withColumn("__u", units).withColumn("__rate", F.when(timed(), (F.col("end_ms") - F.col("start_ms")) / F.col("__u")))
    facts = rows.groupBy("block_id").agg(
        F.count_if(timed()).alias("aligned"), F.count_if(F.trim("text") != "").alias("expected"),
        F.sum(F.when(timed(), F.col("__u"))).alias("units"),
        F.max_by("end_ms", F.when(timed(), F.col("position"))).alias("seg_end"),
        F.min_by("start_ms", F.when(timed(), F.col("position"))).alias("seg_start"),
        F.expr("percentile_disc(0.5) within group (order by __rate desc)").alias("median_rate"),
    )
    outliers = rows.join(facts.select("block_id", "median_rate"), "block_id").groupBy("block_id").agg(F.count_if(
        (F.col("__rate") < F.col("median_rate") * 0.35) | (F.col("__rate") > F.col("median_rate") * 2.8)).alias("outliers"))
    j = base.join(facts, "block_id").join(outliers, "block_id").join(live, "block_id", "left").join(bad, "block_id", "left")
    ends = j.select("block_id", "chapter_id", (F.col("audio_start_ms") + F.col("last_end")).alias("abs_end")).filter("abs_end is not null")
    near = within_join(ends, silences.select("chapter_id", F.col("time_ms").alias("t")), ["chapter_id"], "abs_end", "t", 800).groupBy(
        "block_id").agg(F.min(F.abs(F.col("t") - F.col("abs_end"))).alias("nearest"))
    j = j.join(near, "block_id", "left")
    default = 175.0 if language.casefold() in CJK_LANGUAGES else 360.0
    measured = (F.col("seg_end") - F.col("seg_start")) / F.greatest(F.lit(1), F.col("units"))
    ratio = measured / F.greatest(F.lit(1.0), F.coalesce("rate", F.lit(default)))
    coverage = F.col("aligned") / F.greatest(F.lit(1), F.col("expected"))
    touches = F.col("last_end") >= F.col("duration") - 250
    used = F.col("last_end") / F.col("duration")
    fatal = (
        F.when(F.col("last_end").isNull() | (F.coalesce("broken", F.lit(0)) > 0), F.lit(REASONS["invalid"]))
        .when(F.col("inversions") > 0, F.lit(REASONS["order"])).when(F.col("aligned") == 0, F.lit(REASONS["none"]))
    )
    score = (
        F.lit(0.35) + F.when(touches, 0.0).otherwise(0.15) + F.when(used.between(0.35, 0.98), 0.10).otherwise(0.0)
        + F.when(ratio.between(0.55, 1.80), (1 - F.least(F.lit(1.0), F.abs(1 - ratio) / 0.80)) * 0.20).otherwise(0.0)
        + F.when(F.col("nearest").isNotNull(), (1 - F.col("nearest") / 1000) * 0.10).otherwise(0.0)
        + F.when(F.col("outliers") == 0, 0.10).otherwise(0.0)
    ) * (coverage * 0.35 + 0.65)
    score = clamp01(F.when(touches, F.least(score, F.lit(0.69))).otherwise(score))
    reasons = F.array_compact(F.array(
        F.when(coverage < 1, F.lit(REASONS["coverage"])), F.when(touches, F.lit(REASONS["end"])),
        F.when(~used.between(0.35, 0.98), F.lit(REASONS["window"])), F.when(~ratio.between(0.55, 1.80), F.lit(REASONS["rate"])),
        F.when(F.col("nearest").isNull() & F.col("weak"), F.lit(REASONS["edge"])),
        F.when(F.col("outliers") > 0, F.lit(REASONS["outlier"])),
    ))
    return j.select("block_id", "chapter_id", F.when(fatal.isNotNull(), 0.0).otherwise(score).alias("score"),
                    F.when(fatal.isNotNull(), F.array(fatal)).otherwise(reasons).alias("reasons"),
                    F.when(fatal.isNotNull(), F.col("rate")).otherwise(measured).alias("measured_rate"))


def overlap_agreement(block_rows: DataFrame, shared_rows: int = 2) -> DataFrame:
    """Agreement of each block with the one before on their last shared rows.

    ``block_rows(chapter_id, block_no, position, start_ms, end_ms)``.
    """
    keys = ["chapter_id", "block_no", "position"]
    before = block_rows.select("chapter_id", (F.col("block_no") + 1).alias("block_no"), "position",
                               F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
    both = block_rows.select(*keys, "start_ms", "end_ms").join(before, keys)
    rows, seq = prepare(both, Seq(("chapter_id", "block_no"), ("position",)))
    rows = finish(scan(rows, seq, None, {"__from_end": Agg("sum", F.lit(1).cast("long"))})).filter(
        F.col("__from_end") <= max(1, shared_rows))
    tolerance = F.greatest(F.lit(250), F.bround(F.greatest(F.col("pe") - F.col("ps"), F.col("end_ms") - F.col("start_ms")) * 0.05))
    error = F.greatest(F.abs(F.col("ps") - F.col("start_ms")), F.abs(F.col("pe") - F.col("end_ms")))
    both_timed = timed() & (F.col("pe") > F.col("ps"))
    scored = rows.withColumn("__miss", both_timed & (error > tolerance)).withColumn(
        "__score", F.when(both_timed, F.greatest(F.lit(0.0), 1 - error / tolerance)))
    return scored.groupBy("chapter_id", "block_no").agg(F.when(F.max("__miss"), 0.0).otherwise(
        F.coalesce(F.avg("__score"), F.lit(0.0))).alias("agreement"))


def hypothesis_priority(score: Column, coverage: Column, span: Column, stable: float = 0.72) -> Column:
    """Stable first, then coverage, span (stable only) and score."""
    good = score >= stable
    return F.struct(good.alias("stable"), coverage.alias("coverage"), F.when(good, span).otherwise(0).alias("span"), score.alias("score"))


def beam(hypotheses: DataFrame, width: int = 3, group: tuple[str, ...] = ("chapter_id", "block_no"), tie: str = "hyp_no") -> DataFrame:
    """The best ``width`` hypotheses per block, first wins on ties.

    Each pass takes one winner per block with a partial aggregation, so no block is sorted.
    """
    fields = [c for c in hypotheses.columns if c not in group]
    rest, kept = hypotheses, None
    for rank in range(1, width + 1):
        best = rest.groupBy(*group).agg(F.max(F.struct(
            hypothesis_priority(F.col("score"), F.col("coverage"), F.col("span")).alias("p"), (-F.col(tie)).alias("t"),
            F.struct(*fields).alias("row"),
        ))["row"].alias("row")).select(*group, "row.*", F.lit(rank).alias("beam_rank"))
        kept = best if kept is None else kept.unionByName(best)
        rest = rest.join(best.select(*group, tie), [*group, tie], "left_anti")
    return kept


def split_regressive(rows: DataFrame, tolerance_ms: int = 250, seq: Seq = CHAPTER) -> DataFrame:
    """Accept rows that do not fall behind the confirmed cursor.

    Rejected rows leave the cursor alone, so a running maximum over all rows would be
    wrong; the fold keeps the exact cursor.
    """
    def accepts(cursor: Column, row: Column) -> Column:
        return (row["end_ms"] > row["start_ms"]) & (row["start_ms"] >= cursor - max(0, tolerance_ms))

    return fold(
        rows, seq, F.lit(0).cast("long"),
        lambda cursor, row: F.when(accepts(cursor, row), F.greatest(cursor, row["end_ms"].cast("long"))).otherwise(cursor),
        lambda cursor, row, _: F.struct(accepts(cursor, row).alias("accepted")),
    )


def consolidate(segments: DataFrame, blocks: DataFrame, block_rows: DataFrame, stable: float = 0.72) -> DataFrame:
    """Merge block results into the chapter.

    ``blocks(chapter_id, block_no, start_index, end_index, status)``: ``failed`` blocks
    only downgrade, ``review`` blocks cap confidence; the earliest block owns a row;
    rows that would run backwards are refused.
    """
    failed = blocks.filter("status = 'failed'").withColumn("position", F.explode(
        F.sequence(F.col("start_index"), F.greatest(F.col("start_index"), F.col("end_index") - 1)))).select(
        "chapter_id", "position").distinct().withColumn("__failed", F.lit(True))
    good = block_rows.join(blocks.filter("status <> 'failed'").select("chapter_id", "block_no", F.col("status").alias("b")),
                           ["chapter_id", "block_no"]).filter(timed())
    open_rows = segments.filter("not locked").select("chapter_id", "position")
    owner = good.join(open_rows, ["chapter_id", "position"], "left_semi").groupBy("chapter_id", "position").agg(
        F.min_by(F.struct("start_ms", "end_ms", "confidence", "b"), "block_no").alias("r")).select("chapter_id", "position", "r.*")
    review = F.col("b") == "review"
    owner = owner.withColumn("status", F.when(review, F.lit("low_confidence")).otherwise(F.lit("auto"))).withColumn(
        "confidence", F.when(review, F.least(F.col("confidence"), F.lit(stable - 0.01))).otherwise(F.col("confidence")))
    safe = split_regressive(owner).filter("accepted").select(
        "chapter_id", "position", F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"),
        F.col("confidence").alias("__c"), F.col("status").alias("__st"))
    out = segments.join(failed, ["chapter_id", "position"], "left").join(safe, ["chapter_id", "position"], "left")
    down = F.coalesce("__failed", F.lit(False)) & ~F.col("locked") & (F.col("status") != "unmatched")
    return out.withColumn("__down", down).withColumn("start_ms", F.coalesce("__s", "start_ms")).withColumn(
        "end_ms", F.coalesce("__e", "end_ms")
    ).withColumn("confidence", F.coalesce("__c", F.when(F.col("__down"), F.least(F.col("confidence"), F.lit(0.49))).otherwise(F.col("confidence")))
    ).withColumn("status", F.coalesce("__st", F.when(F.col("__down"), F.lit("low_confidence")).otherwise(F.col("status")))
    ).withColumn("affected", F.col("__s").isNotNull() | F.col("__down")).drop("__s", "__e", "__c", "__st", "__failed", "__down")


def run_summary(block_rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct timed rows and distinct rows for review."""
    done = block_rows.filter(timed()).groupBy("chapter_id").agg(F.count_distinct("position").alias("timed_rows"))
    rows = blocks.filter("status in ('failed', 'review')").withColumn("position", F.explode(
        F.sequence(F.col("start_index"), F.greatest(F.col("start_index"), F.col("end_index") - 1)))).select("chapter_id", "position").distinct()
    review = rows.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("review_rows"))
    return done.join(review, "chapter_id", "full").na.fill(0, ["timed_rows", "review_rows"])


def unedited_chapters(segments: DataFrame) -> DataFrame:
    """Chapters whose rows are all recognised, unlocked and automatic."""
    return segments.groupBy("chapter_id").agg(F.bool_and(
        (F.col("origin") == "asr") & ~F.col("locked") & F.col("status").isin("auto", "low_confidence")).alias("unedited"))
