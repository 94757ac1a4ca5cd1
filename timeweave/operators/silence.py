"""Low-energy intervals: detection, thinning, snapping and silence-only alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import normalize_for_match
from timeweave.functions.timecode import clamp01, silence_edges
from timeweave.intervals import asof_join, point_join
from timeweave.operators.timeline import timed
from timeweave.ordered import CHAPTER, Agg, Seq, finish, fold, number_rows, prepare, prev, refine, scan
from timeweave.session import cut_lineage

FRAME_MS = 20
FRAMES = Seq(order=("frame_no",))
BY_TIME = Seq(order=("time_ms",))


def frame_energy(samples: DataFrame, size: int) -> DataFrame:
    """RMS per frame of ``size`` samples, the last one zero-padded."""
    return samples.groupBy("chapter_id", F.floor(F.col("sample_no") / size).alias("frame_no")).agg(
        F.sqrt(F.sum(F.col("value") * F.col("value")) / size + 1e-12).alias("rms")
    )


def samples_between(samples: DataFrame, rate: int, start_ms: int = 0, end_ms: int | None = None) -> DataFrame:
    """Only the samples of ``[start_ms, end_ms)`` (A13): constant bounds, so the scan skips the rest."""
    wanted = samples.filter(F.col("sample_no") >= max(0, start_ms * rate // 1000))
    return wanted if end_ms is None else wanted.filter(F.col("sample_no") < max(start_ms, end_ms) * rate // 1000)


def exact_percentile(df: DataFrame, value: str, fraction: float, name: str, group: str = "chapter_id",
                     bins: int = 4096) -> DataFrame:
    """Linear-interpolated percentile per group that never gathers a group.

    A histogram finds the bins holding the two neighbouring ranks; only the distinct
    values of those bins are counted and ranked.  The few rows a group that all rows meet are written
    before, so that their size is known and no group is sent to one task for them.
    """
    stats = df.groupBy(group).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
    ).withColumn("rank", (F.col("n") - 1) * F.lit(fraction)).withColumn("r0", F.floor("rank")).withColumn(
        "r1", F.ceil("rank")
    )
    stats = cut_lineage(stats)
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    binned = df.select(group, F.col(value).alias("v")).filter("v is not null").join(stats, group).withColumn(
        "bin", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width))
    )
    counts = binned.groupBy(group, "bin").agg(F.count(F.lit(1)).alias("c"))
    running = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(group).orderBy("bin")))
    wanted = running.join(stats.select(group, "r0", "r1"), group).filter(
        (F.col("upto") > F.col("r0")) & (F.col("upto") - F.col("c") <= F.col("r1"))
    ).select(group, "bin", (F.col("upto") - F.col("c")).alias("below"))
    wanted = cut_lineage(wanted)
    values = binned.join(wanted, [group, "bin"]).groupBy(group, "bin", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    ranked = values.withColumn(
        "upto", F.col("below") + F.sum("c").over(Window.partitionBy(group, "bin").orderBy("v"))
    ).withColumn("from", F.col("upto") - F.col("c")).join(stats.select(group, "rank", "r0", "r1"), group)

    def at(rank: str) -> Column:
        return F.min(F.when((F.col("from") <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))

    # The formula of Spark's percentile(), so that both ways agree to the last bit.
    between = F.col("over") * F.col("v0") + F.col("t") * F.col("v1")
    return ranked.groupBy(group).agg(
        at("r0").alias("v0"), at("r1").alias("v1"), F.max(F.col("rank") - F.col("r0")).alias("t"), F.max(F.col("r1") - F.col("rank")).alias("over"),
    ).select(group, F.when((F.col("t") == 0) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise(between).alias(name))


def silence_threshold(frames: DataFrame, percentile: float = 18.0) -> DataFrame:
    """Energy percentile per chapter (D18); the exact histogram way only for huge chapters."""
    _, seq = prepare(frames.select("chapter_id", "frame_no"), FRAMES)
    if seq.width is None:
        return frames.groupBy("chapter_id").agg(F.percentile("rms", percentile / 100).alias("threshold"))
    return exact_percentile(frames, "rms", percentile / 100, "threshold")


def energy_silences(frames: DataFrame, percentile: float = 18.0, min_silence_ms: int = 350) -> DataFrame:
    """Maximal runs of quiet frames, with valley, score and interval."""
    least = max(1, -(-min_silence_ms // FRAME_MS))
    quiet = frames.join(silence_threshold(frames, percentile), "chapter_id").filter("rms <= threshold")
    quiet, seq = prepare(quiet, FRAMES)
    runs = finish(scan(quiet, seq, {"__rank": Agg("sum", F.lit(1).cast("long"))})).withColumn(
        "__run", F.col("frame_no") - F.col("__rank")
    )
    found = runs.groupBy("chapter_id", "__run").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_no").alias("first"), F.max("frame_no").alias("last"),
        F.min_by("frame_no", F.struct("rms", "frame_no")).alias("valley"),
    ).filter(F.col("n") >= least)
    return found.select(
        "chapter_id", (F.col("valley") * FRAME_MS).cast("long").alias("time_ms"),
        F.least(F.lit(1.0), F.col("n") / (least * 3)).alias("score"), F.lit("energy-silence").alias("kind"),
        (F.col("first") * FRAME_MS).cast("long").alias("start_ms"),
        ((F.col("last") + 1) * FRAME_MS).cast("long").alias("end_ms"),
    )


def speech_gaps(speech: DataFrame, durations: DataFrame, frames: DataFrame, min_silence_ms: int = 350) -> DataFrame:
    """Gaps between speech ranges, scored by duration and quietness.

    ``speech(chapter_id, start_ms, end_ms)``, ``durations(chapter_id, duration_ms)``.
    """
    ends = durations.select("chapter_id", F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    rows = speech.select("chapter_id", "start_ms", "end_ms").unionByName(ends)
    rows, seq = prepare(rows, Seq(order=("start_ms", "end_ms")))
    gaps = finish(scan(rows, seq, {"__c": Agg("max", F.col("end_ms"), False)})).select(
        "chapter_id", F.greatest(F.coalesce("__c", F.lit(0)), F.lit(0)).cast("long").alias("gap_start"),
        F.col("start_ms").alias("gap_end"),
    ).filter(F.col("gap_end") - F.col("gap_start") >= min_silence_ms)
    from timeweave.intervals import point_join

    overall = frames.groupBy("chapter_id").agg(F.sqrt(F.avg(F.col("rms") * F.col("rms")) + 1e-12).alias("overall"))
    inside = point_join(frames.withColumn("t_ms", F.col("frame_no") * FRAME_MS), gaps, ["chapter_id"], "t_ms",
                        ("gap_start", "gap_end")).groupBy("chapter_id", "gap_start", "gap_end").agg(
        F.min("rms").alias("floor"), F.min_by("t_ms", F.struct("rms", "t_ms")).alias("valley"),
    ).join(overall, "chapter_id")
    length = F.col("gap_end") - F.col("gap_start")
    quiet = 1 - F.least(F.lit(1.0), F.col("floor") / F.greatest(F.col("overall"), F.lit(1e-7)))
    return inside.select(
        "chapter_id", F.least(F.col("gap_end") - 1, F.col("valley") + FRAME_MS // 2).alias("time_ms"),
        clamp01(F.least(F.lit(1.0), length / max(min_silence_ms * 3, 1)) * 0.65 + quiet * 0.35).alias("score"),
        F.lit("vad-silence").alias("kind"), F.col("gap_start").alias("start_ms"), F.col("gap_end").alias("end_ms"),
    )


def strong_silences(silences: DataFrame) -> DataFrame:
    """At least 500 ms long or scored 0.78."""
    length = F.coalesce("end_ms", "time_ms") - F.coalesce("start_ms", "time_ms")
    return silences.filter((length >= 500) | (F.col("score") >= 0.78))


def key_eligible(silences: DataFrame, min_silence_ms: int = 350) -> DataFrame:
    """Silences clear enough to draw or plan with."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    clear = max(500, round(max(1, min_silence_ms) * 1.5))
    return silences.filter("start_ms is not null and end_ms is not null").filter(
        (length >= clear) | ((length >= min_silence_ms) & (F.col("score") >= 0.78))
    )


def key_silences(silences: DataFrame, min_silence_ms: int = 350, spacing_ms: int = 800, order: tuple[str, ...] = ("time_ms",)) -> DataFrame:
    """Thinned key silences: 800 ms apart, the higher score·duration wins inside.

    The reference point moves with a replacement, so this is a fold; its state forgets
    the past at every silence that opens a new group.
    """
    rank = F.col("score") * F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    rows = key_eligible(silences, min_silence_ms).withColumn("__rank", rank)
    seq = Seq(order=order)
    none = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("double").alias("rank"))

    def opens(state: Column, row: Column) -> Column:
        return state["at"].isNull() | (row["time_ms"] - state["at"] >= spacing_ms)

    def takes(state: Column, row: Column) -> Column:
        return opens(state, row) | (row["__rank"] > state["rank"])

    def step(state: Column, row: Column) -> Column:
        return F.when(takes(state, row), F.struct(row["time_ms"].cast("long").alias("at"), row["__rank"].alias("rank"))).otherwise(state)

    def emit(before: Column, row: Column, _: Column) -> Column:
        return F.struct(opens(before, row).alias("__opens"), takes(before, row).alias("__takes"))

    folded = fold(rows, seq, none, step, emit)
    folded, seq = prepare(folded, seq)
    groups = finish(scan(folded, seq, {"__grp": Agg("sum", F.col("__opens").cast("long"))}))
    fields = [c for c in silences.columns if c != "chapter_id"]
    return groups.filter("__takes").groupBy("chapter_id", "__grp").agg(
        F.max_by(F.struct(*fields), seq.order_struct()).alias("k")
    ).select("chapter_id", "k.*")


def chapter_silences(parts: DataFrame, silences: DataFrame) -> DataFrame:
    """Silences of several parts in chapter time, numbered in part order.

    ``parts(chapter_id, part_no, audio_id, local_start)``, silences keyed by ``audio_id``.
    """
    moved = parts.join(silences, "audio_id").select(
        "chapter_id", "part_no", (F.col("time_ms") + F.col("local_start")).alias("time_ms"), "score", "kind",
        (F.col("start_ms") + F.col("local_start")).alias("start_ms"), (F.col("end_ms") + F.col("local_start")).alias("end_ms"),
    )
    return number_rows(moved, Seq(order=("part_no", "time_ms", "start_ms"), by="part_no"), "position")


def snap_boundaries(segments: DataFrame, silences: DataFrame, window_ms: int = 1000, padding_ms: int = 80) -> DataFrame:
    """Move each boundary between neighbouring timed, unlocked cues into one silence.

    Which silence a pair takes depends only on values that pair itself edits: three
    silences before and three after its target are candidates.  The clamps that follow
    see the edit of the pair before, so they run as a fold over the pairs.
    """
    segs, seq = prepare(segments, CHAPTER)
    pairs = finish(scan(segs, seq, None, {"__right": prev("start_ms", "end_ms", "locked")}))
    target = F.when(F.col("__right.start_ms") != 0, F.floor((F.col("end_ms") + F.col("__right.start_ms")) / 2)).otherwise(F.col("end_ms"))
    usable = ~F.col("locked") & ~F.col("__right.locked") & F.col("__right").isNotNull()
    targets = pairs.filter(usable).select("chapter_id", "position", target.cast("long").alias("target_ms"))
    ordered = number_rows(silences, Seq(order=("time_ms", "position"), by="time_ms"), "__k", 1)
    before = asof_join(targets, ordered.select("chapter_id", "time_ms", "__k"), ("chapter_id",), "target_ms", "time_ms", ["__k"])
    ranks = before.select("chapter_id", "position", "target_ms", F.explode(F.sequence(
        F.coalesce(F.col("hit.__k"), F.lit(0)) - 2, F.coalesce(F.col("hit.__k"), F.lit(0)) + 3,
    )).alias("__k"))
    low = F.least(F.coalesce("start_ms", "time_ms"), F.coalesce("end_ms", "time_ms"))
    high = F.greatest(F.coalesce("start_ms", "time_ms"), F.coalesce("end_ms", "time_ms"))
    away = F.greatest(F.lit(0), low - F.col("target_ms"), F.col("target_ms") - high)
    chosen = ranks.join(ordered.drop("position"), ["chapter_id", "__k"]).groupBy("chapter_id", "position").agg(
        F.min(F.struct(away.alias("d"), (-F.col("score")).alias("s"), "__k", "time_ms", "start_ms", "end_ms")).alias("c")
    ).filter(F.col("c.d") <= window_ms).select(
        "chapter_id", "position", silence_edges(F.col("c.time_ms"), F.col("c.start_ms"), F.col("c.end_ms"), padding_ms).alias("__edge"),
    )
    rows = segments.join(chosen, ["chapter_id", "position"], "left")
    rows, seq = prepare(rows, CHAPTER)
    rows = finish(scan(rows, seq, {"__from": prev("__edge")}, {"__right": prev("start_ms", "end_ms", "locked")}))
    # State: what the pair before did to this row's start, if anything.
    state0 = F.struct(F.lit(None).cast("long").alias("start"))

    def start_of(state: Column, row: Column) -> Column:
        return F.coalesce(state["start"], row["start_ms"])

    def fires(state: Column, row: Column) -> Column:
        return (
            row["__edge"].isNotNull() & (row["end_ms"] > start_of(state, row))
            & (row["__right"]["end_ms"] > row["__right"]["start_ms"])
        )

    def left_end(state: Column, row: Column) -> Column:
        return F.greatest(start_of(state, row), F.least(row["__edge"]["previous_end"], row["__right"]["end_ms"]))

    def step(state: Column, row: Column) -> Column:
        moved = F.least(row["__right"]["end_ms"], F.greatest(left_end(state, row), row["__edge"]["following_start"]))
        return F.struct(F.when(fires(state, row), moved).alias("start"))

    def emit(state: Column, row: Column, _: Column) -> Column:
        hit = F.coalesce(fires(state, row), F.lit(False))
        return F.struct(
            start_of(state, row).alias("__s"),
            F.when(hit, left_end(state, row)).otherwise(row["end_ms"]).alias("__e"),
            (hit | state["start"].isNotNull()).alias("__touched"),
        )

    out = fold(rows, CHAPTER, state0, step, emit)
    return out.withColumn("start_ms", F.col("__s")).withColumn("end_ms", F.col("__e")).withColumn(
        "status", F.when(F.col("__touched") & (F.col("status") == "auto"), F.lit("manual")).otherwise(F.col("status"))
    ).select(segments.columns)


def align_by_silence(
    segments: DataFrame, silences: DataFrame, spans: DataFrame, padding_ms: int = 80, low_confidence: float = 0.58,
) -> DataFrame:
    """Times from pauses and text length alone.

    ``spans(chapter_id, from_ms, to_ms)``.  Unlocked runs between locked rows share
    their interval by text weight; each cumulative target takes the nearest silence that
    keeps the boundaries increasing, otherwise an estimated point.  After more than three
    unreliable rows in a row the rest of the chapter keeps its old values.
    """
    segs, seq = prepare(segments.join(spans, "chapter_id"), CHAPTER)
    marks = F.length(F.regexp_replace("text", "[^，、；：,.!?。！？]", ""))
    weight = (F.greatest(F.lit(1), F.length(normalize_for_match(F.col("text")))) + marks * 2).cast("long")
    base = scan(
        segs.withColumn("__w", weight), seq,
        {
            "__run": Agg("sum", F.col("locked").cast("long")),
            "__cum": Agg("sum", F.when(~F.col("locked"), F.col("__w")).otherwise(F.lit(0))),
            "__n": Agg("sum", (~F.col("locked")).cast("long")),
            "__lo": Agg("max", F.when(F.col("locked"), F.col("end_ms")), False),
        },
        {"__hi": Agg("last", F.when(F.col("locked"), F.col("start_ms")), False)},
    )
    base = finish(base)
    lo = F.greatest(F.col("from_ms"), F.coalesce("__lo", F.lit(0)))
    hi = F.when(F.col("__hi") > lo, F.least("to_ms", "__hi")).otherwise(F.col("to_ms"))
    free = base.filter("not locked").withColumn("__lo", lo).withColumn("__hi", hi).filter("__hi > __lo")
    keys = ["chapter_id", "__run"]
    facts = free.groupBy(*keys).agg(
        F.sum("__w").alias("__total"), F.count(F.lit(1)).alias("__rows"),
        F.min(F.col("__cum") - F.col("__w")).alias("__base"), F.min("__n").alias("__first"),
    )
    free = free.join(facts, keys).withColumn("__i", F.col("__n") - F.col("__first"))
    free = free.withColumn("__target", F.when(F.col("__i") < F.col("__rows") - 1, F.col("__lo") + F.bround(
        (F.col("__hi") - F.col("__lo")) * (F.col("__cum") - F.col("__base")) / F.col("__total")
    ).cast("long"))).withColumn("__reach", F.greatest(F.lit(2000), F.bround(
        (F.col("__hi") - F.col("__lo")) / F.col("__rows") * 0.8
    ).cast("long")))
    wanted = free.filter("__target is not null").select(
        *keys, "position", "__target", "__reach", "__lo", "__hi",
        (F.col("__target") - F.col("__reach")).alias("__from"), (F.col("__target") + F.col("__reach")).alias("__upto"))
    sil = silences.select("chapter_id", F.col("time_ms").alias("c_time"), F.col("score").alias("c_score"),
                          F.coalesce("start_ms", "time_ms").alias("c_start"), F.coalesce("end_ms", "time_ms").alias("c_end"))
    # Every row looks as far as its own reach.
    near = point_join(sil, wanted, ["chapter_id"], "c_time", ("__from", "__upto"), closed=True).filter(
        (F.abs(F.col("c_time") - F.col("__target")) <= F.col("__reach")) & (F.col("c_score") >= 0.25)
        & (F.col("__lo") < F.col("c_time")) & (F.col("c_time") < F.col("__hi"))
    )
    # A silence serves the target nearest to it; a target takes its nearest such silence.
    served = near.groupBy("chapter_id", "__run", "c_time").agg(F.min(F.struct(
        F.abs(F.col("c_time") - F.col("__target")).alias("d"), "position", "c_score", "c_start", "c_end",
    )).alias("m")).groupBy("chapter_id", "__run", F.col("m.position").alias("position")).agg(F.min(F.struct(
        F.col("m.d").alias("d"), (-F.col("m.c_score")).alias("s"), "c_time", F.col("m.c_start").alias("c_start"), F.col("m.c_end").alias("c_end"),
    )).alias("b"))
    placed = free.join(served, [*keys, "position"], "left")
    center = F.coalesce(F.col("b.c_time"), F.col("__target"))
    run_seq = refine(seq, tuple(keys))
    placed, run_seq = prepare(placed.withColumn("__c", center), run_seq)
    mono = scan(placed, run_seq, {"__max": Agg("max", F.col("__c"), False)}, {"__min": Agg("min", F.col("__c"), False)})
    ordered = (F.coalesce(F.col("__max"), F.lit(-1)) < F.col("__c")) & (F.col("__min").isNull() | (F.col("__c") < F.col("__min")))
    reliable = F.coalesce(F.col("b").isNotNull() & ordered, F.lit(False))
    mono = mono.withColumn("__ok", reliable).withColumn("__score", F.when(F.col("__ok"), -F.col("b.s")).otherwise(F.lit(0.35)))
    edges = F.when(F.col("__ok"), silence_edges(F.col("b.c_time"), F.col("b.c_start"), F.col("b.c_end"), padding_ms)).otherwise(
        silence_edges(F.col("__target"), F.lit(None).cast("long"), F.lit(None).cast("long"), padding_ms)
    )
    mono = mono.withColumn("__edge", F.when(F.col("__target").isNotNull(), edges))
    both = finish(scan(mono, run_seq, {"__left": prev("__edge", "__ok", "__score")}))
    s = F.greatest(F.col("__lo"), F.least(F.col("__hi"), F.coalesce(F.col("__left.__edge.following_start"), F.col("__lo"))))
    both = both.withColumn("__s", s).withColumn("__e", F.greatest(
        F.col("__s"), F.least(F.col("__hi"), F.coalesce(F.col("__edge.previous_end"), F.col("__hi")))
    ))
    last = F.col("__target").isNull()
    first = F.col("__left").isNull()
    good = F.coalesce(F.col("__left.__ok"), F.lit(True)) & (last | F.col("__ok"))
    score = F.when(first & last, F.lit(0.7)).when(first, F.col("__score")).when(last, F.col("__left.__score")).otherwise(
        (F.col("__left.__score") + F.col("__score")) / 2
    )
    expected = F.greatest(F.lit(1.0), (F.col("__hi") - F.col("__lo")) * F.col("__w") / F.col("__total"))
    actual = F.greatest(F.lit(1), F.col("__e") - F.col("__s"))
    both = both.withColumn("__good", good).withColumn("__conf", clamp01(
        score * 0.65 + 0.35 * F.least(expected, actual) / F.greatest(expected, actual)
    ))
    proposals = both.select("chapter_id", "__run", "position", "__s", "__e", "__conf", "__good")
    # Unreliable streaks: rows since the last reliable one in the same run.
    proposals, run_seq2 = prepare(proposals, refine(seq, tuple(keys)))
    streak = finish(scan(proposals, run_seq2, {"__lastgood": Agg("last", F.when(F.col("__good"), F.col("position"))),
                                              "__rank": Agg("sum", F.lit(1).cast("long")),
                                              "__goodrank": Agg("sum", F.col("__good").cast("long"))}))
    firsts = streak.groupBy("chapter_id", "__run").agg(F.min("position").alias("__p0"))
    streak = streak.join(firsts, keys).withColumn(
        "__bad", F.col("position") - F.coalesce(F.col("__lastgood"), F.col("__p0") - 1)
    )
    stops = streak.filter("__bad > 3").groupBy("chapter_id").agg(F.min("position").alias("__stop"))
    final = streak.join(stops, "chapter_id", "left").filter("__stop is null or position < __stop").select(
        "chapter_id", "position", "__s", "__e", "__conf", "__good"
    )
    return segments.join(final, ["chapter_id", "position"], "left").withColumn(
        "proposed", F.col("__s").isNotNull()
    ).withColumn("start_ms", F.coalesce("__s", "start_ms")).withColumn("end_ms", F.coalesce("__e", "end_ms")).withColumn(
        "confidence", F.coalesce("__conf", "confidence")
    ).withColumn("status", F.when(F.col("proposed"), F.when(
        F.col("__good") & (F.col("__conf") >= low_confidence), F.lit("auto")
    ).otherwise(F.lit("low_confidence"))).otherwise(F.col("status"))).drop("__s", "__e", "__conf", "__good")


def next_silence(times: DataFrame, silences: DataFrame) -> DataFrame:
    """The first silence strictly after a time."""
    return asof_join(
        times.withColumn("__after", F.col("at_ms") + 1), silences.select("chapter_id", "time_ms", "score"),
        ("chapter_id",), "__after", "time_ms", ["score"], backward=False, name="silence",
    ).drop("__after")
