"""Text groups, audio windows and chunk plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import empty_array, let, spoken_duration_ms
from timeweave.intervals import bucket, within_join
from timeweave.ordered import BLOCK, CHAPTER, Agg, Seq, finish, prepare, scan, settle
from timeweave.session import cut_lineage


@dataclass(frozen=True)
class BlockLimits:
    """Fixed values of the block planner."""

    minimum: int = 4
    maximum: int = 20
    target_ms: int = 80_000
    window_ms: int = 90_000


def text_groups(segments: DataFrame, starts: DataFrame, minimum: int = 2, maximum: int = 6,
                target_ms: int = 12_000, language: str = "auto") -> DataFrame:
    """Exclusive end of the text group that begins at each start position.

    ``starts(chapter_id, start_position)``.  At most ``maximum`` rows are looked at, so
    a start meets its rows through an equi join on positions.
    """
    window = starts.withColumn("position", F.explode(F.sequence(
        F.col("start_position"), F.col("start_position") + maximum - 1)))
    rows = window.join(segments.select("chapter_id", "position", "text", "locked"), ["chapter_id", "position"])
    seq = Seq(("chapter_id", "start_position"), ("position",))
    spoken = F.trim("text") != ""
    rows = rows.withColumn("__ms", F.when(spoken, spoken_duration_ms(F.col("text"), language)).otherwise(F.lit(0))).withColumn(
        "__spoken", spoken.cast("long"))
    rows, seq = prepare(rows, seq)
    run = finish(scan(rows, seq, {
        "__lock": Agg("max", F.col("locked")), "__count": Agg("sum", F.col("__spoken")), "__sum": Agg("sum", F.col("__ms")),
    })).filter(~F.col("__lock"))
    full = (F.col("__count") >= minimum) & (F.col("__sum") >= max(1000, target_ms))
    ends = run.groupBy("chapter_id", "start_position").agg(
        F.min(F.when(full, F.col("position") + 1)).alias("hit"), F.max(F.col("position") + 1).alias("available"),
    )
    return starts.join(ends, ["chapter_id", "start_position"], "left").select(
        "chapter_id", "start_position", F.coalesce("hit", "available", "start_position").alias("end_position"),
    )


def block_group_ends(segments: DataFrame, starts: DataFrame, limits: BlockLimits = BlockLimits(),
                     language: str = "auto") -> DataFrame:
    """Candidate block ends, nearest to the preferred one first: preferred ±1 and the minimum."""
    window = starts.withColumn("position", F.explode(F.sequence(
        F.col("start_position"), F.col("start_position") + limits.maximum - 1)))
    rows = window.join(segments.select("chapter_id", "position", "text", "locked"), ["chapter_id", "position"])
    rows = rows.withColumn("__ms", F.when(F.trim("text") != "", spoken_duration_ms(F.col("text"), language)).otherwise(F.lit(0)))
    rows, seq = prepare(rows, Seq(("chapter_id", "start_position"), ("position",)))
    run = finish(scan(rows, seq, {"__lock": Agg("max", F.col("locked")), "__sum": Agg("sum", F.col("__ms"))})).filter(~F.col("__lock"))
    size = F.col("position") + 1 - F.col("start_position")
    facts = run.groupBy("chapter_id", "start_position").agg(
        F.max(F.col("position") + 1).alias("available"),
        F.min(F.when((size >= limits.minimum) & (F.col("__sum") >= limits.target_ms), F.col("position") + 1)).alias("hit"),
    )
    preferred = F.coalesce("hit", "available")
    least = F.least(F.col("available"), F.col("start_position") + limits.minimum)
    facts = facts.withColumn("preferred", preferred).withColumn("least", least)
    options = F.array_distinct(F.concat(
        F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.greatest(
            F.col("least"), F.least(F.col("available"), F.col("preferred") + o))),
        F.array("least"),
    ))
    ranked = F.array_sort(F.transform(options, lambda e: F.struct(F.abs(e - F.col("preferred")).alias("d"), e.alias("e"))))
    return facts.select("chapter_id", "start_position", F.transform(ranked, lambda r: r["e"]).alias("ends"))


def expanding_windows(requests: DataFrame, silences: DataFrame, attempts: int = 4, max_window_ms: int = 90_000) -> DataFrame:
    """Expanding silence-bounded window ends for one known sentence.

    ``requests(chapter_id, request_id, start_ms, limit_ms, expected_ms)``.  A window spans
    at most ``max_window_ms`` plus a constant, so silences meet requests by time bucket.
    """
    hard = F.least(F.col("limit_ms"), F.col("start_ms") + F.greatest(
        F.lit(8000), F.least(F.lit(max_window_ms), F.col("expected_ms") * 3 + 4000)))
    req = requests.filter(F.col("limit_ms") > F.col("start_ms")).withColumn("__hard", hard).withColumn(
        "__target", F.col("start_ms") + F.col("expected_ms") + 600
    ).withColumn("__min", F.col("start_ms") + F.greatest(F.lit(750), F.bround(F.col("expected_ms") * 0.55)))
    times = silences.select("chapter_id", F.col("time_ms").alias("t")).distinct()
    hits = within_join(req.select("chapter_id", "request_id", "start_ms", "__hard", "__target", "__min"), times,
                       ["chapter_id"], "start_ms", "t", max(8000, max_window_ms)).filter(
        (F.col("t") >= F.col("__min")) & (F.col("t") <= F.col("__hard")))
    ranked = hits.groupBy("chapter_id", "request_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("t") >= F.col("__target"), F.col("t")))).alias("after"),
        F.max("t").alias("latest"),
    )
    picked = F.when(F.size("after") > 0, F.slice("after", 1, max(1, attempts))).when(
        F.col("latest").isNotNull(), F.array("latest")).otherwise(empty_array("bigint"))
    joined = req.join(ranked, ["chapter_id", "request_id"], "left").withColumn("after", F.coalesce(
        "after", empty_array("bigint"))).withColumn("ends", picked)
    more = (F.size("ends") == 0) | (F.col("__hard") - F.element_at(F.concat(F.array(F.lit(0).cast("long")), "ends"), -1) >= 500)
    return joined.select("chapter_id", "request_id", F.slice(
        F.when(more, F.concat("ends", F.array(F.col("__hard").cast("long")))).otherwise(F.col("ends")), 1, max(1, attempts),
    ).alias("ends"))


def block_windows(requests: DataFrame, silences: DataFrame, limits: BlockLimits = BlockLimits()) -> DataFrame:
    """Strong-silence window ends first, then bounded fallbacks; 250 ms de-dup, at most five."""
    expected = F.least(F.lit(limits.window_ms), F.greatest(F.lit(4000), F.col("expected_ms")))
    latest = F.least(F.col("limit_ms"), F.col("start_ms") + limits.window_ms)
    req = requests.filter(F.col("limit_ms") > F.col("start_ms")).withColumn("__x", expected).withColumn("__late", latest)
    req = req.withColumn("__early", F.least("__late", F.col("start_ms") + F.greatest(
        F.lit(2000), F.bround(F.col("__x") * 0.55)).cast("long")))
    req = req.withColumn("__target", F.least("limit_ms", F.col("start_ms") + F.col("__x")))
    from timeweave.operators.silence import strong_silences

    strong = strong_silences(silences).select("chapter_id", F.coalesce("end_ms", "time_ms").alias("t"))
    hits = within_join(req.select("chapter_id", "request_id", "start_ms", "__early", "__late", "__target"), strong,
                       ["chapter_id"], "start_ms", "t", limits.window_ms).filter(
        (F.col("t") >= F.col("__early")) & (F.col("t") <= F.col("__late")))
    # Only the three nearest matter: rank as we aggregate instead of sorting everything.
    near = hits.groupBy("chapter_id", "request_id", F.floor(F.col("t") / 1000).alias("__sec")).agg(
        F.slice(F.array_sort(F.collect_list(F.struct(F.abs(F.col("t") - F.col("__target")).alias("d"), "t"))), 1, 3).alias("c")
    ).groupBy("chapter_id", "request_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, 3).alias("c"))
    joined = req.join(near, ["chapter_id", "request_id"], "left").withColumn(
        "c", F.transform(F.coalesce("c", empty_array("struct<d:bigint,t:bigint>")), lambda s: F.struct(s["t"].alias("t"), F.lit(False).alias("weak"))))

    def weak(value: Column) -> Column:
        return F.array(F.struct(value.cast("long").alias("t"), F.lit(True).alias("weak")))

    wide = F.least("__late", F.greatest(F.col("__early"), F.col("start_ms") + F.bround(F.col("__x") * 1.35).cast("long")))
    plan = F.concat(F.slice("c", 1, 1), weak(wide), F.slice("c", 2, 2),
                    weak(F.least("__late", F.greatest("__early", "__target"))), weak(F.col("__late")))
    kept = F.aggregate(plan, empty_array("struct<t:bigint,weak:boolean>"), lambda acc, item: F.when(
        (item["t"] <= F.col("start_ms")) | F.exists(acc, lambda x: F.abs(x["t"] - item["t"]) < 250), acc,
    ).otherwise(F.concat(acc, F.array(item))))
    return joined.select("chapter_id", "request_id", F.slice(kept, 1, 5).alias("ends"))


def next_starts(ends: DataFrame, silences: DataFrame, padding_ms: int = 80, max_gap_ms: int = 2000) -> DataFrame:
    """Start after the pause nearest to an aligned end.

    ``ends(chapter_id, request_id, end_at, limit_ms)``.  Long pauses are found through
    every bucket they touch.
    """
    sil = silences.select("chapter_id", F.col("time_ms").alias("t"), "score",
                          F.coalesce("start_ms", "time_ms").alias("p_start"), F.coalesce("end_ms", "time_ms").alias("p_end"))
    width = 10_000
    a = ends.select("chapter_id", "request_id", "end_at").withColumn("__b", F.explode(F.sequence(
        bucket(F.col("end_at") - 250, width), bucket(F.col("end_at") + max_gap_ms, width))))
    b = sil.withColumn("__b", F.explode(F.sequence(bucket(F.col("p_start"), width), bucket(F.greatest("p_start", "p_end"), width))))
    hits = a.join(b, ["chapter_id", "__b"]).filter(
        (F.col("p_end") >= F.col("end_at") - 250) & (F.col("p_start") <= F.col("end_at") + max_gap_ms))
    best = hits.groupBy("chapter_id", "request_id").agg(F.min(F.struct(
        F.abs(F.col("t") - F.col("end_at")).alias("d"), (-F.col("score")).alias("s"), "t", "p_end"))["p_end"].alias("pause_end"))
    start = F.coalesce(F.greatest(F.col("end_at"), F.col("pause_end") + padding_ms), F.col("end_at"))
    return ends.join(best, ["chapter_id", "request_id"], "left").select(
        "chapter_id", "request_id", F.least(start, F.col("limit_ms")).alias("next_start"))


def plan_chunks(spans: DataFrame, silences: DataFrame, target_ms: int = 120_000, maximum_ms: int = 180_000,
                overlap_ms: int = 1500, minimum_tail_ms: int = 0, block_ms: int = 3_600_000) -> DataFrame:
    """Bounded chunks whose cores meet at pauses.

    ``spans(audio_id, from_ms, to_ms)``.  The span is cut into blocks of ``block_ms``; a
    block holds its own pauses plus one window beyond.  The first boundary inside each
    block is settled by the block fixed point, then every block plans on its own.
    """
    floor_ms = max(30_000, target_ms // 2)
    use = spans.filter(F.col("to_ms") > F.col("from_ms"))
    blocks = use.withColumn(BLOCK, F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("to_ms") - F.col("from_ms") - 1) / block_ms))))
    inner = silences.join(use, "audio_id").filter(
        (F.col("time_ms") > F.col("from_ms") + 20_000) & (F.col("time_ms") < F.col("to_ms") - 20_000)
    ).select("audio_id", "time_ms", (F.col("time_ms") - F.col("from_ms")).alias("__at"))
    lent = inner.withColumn(BLOCK, F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col("__at") - maximum_ms) / block_ms)), F.floor(F.col("__at") / block_ms))))
    pauses = lent.groupBy("audio_id", BLOCK).agg(F.array_sort(F.collect_set("time_ms")).alias("pauses"))
    packed = blocks.join(pauses, ["audio_id", BLOCK], "left").withColumn(
        "pauses", F.coalesce("pauses", empty_array("bigint"))
    ).withColumn("__until", F.least(F.col("to_ms"), F.col("from_ms") + (F.col(BLOCK) + 1) * block_ms))
    tail = F.col("to_ms") - minimum_tail_ms if minimum_tail_ms else F.col("to_ms")

    def following(cursor: Column) -> Column:
        upper = F.least(tail, cursor + maximum_ms)
        target = F.least(upper, cursor + target_ms)
        options = F.filter("pauses", lambda p: (p >= cursor + floor_ms) & (p <= upper))
        best = F.array_min(F.transform(options, lambda p: F.struct(F.abs(p - target).alias("d"), p.alias("p"))))["p"]
        return F.coalesce(best, target if minimum_tail_ms else upper)

    def advance(acc: Column, _: Column) -> Column:
        going = acc["open"] & (acc["at"] < F.col("__until")) & (F.col("to_ms") - acc["at"] > maximum_ms)
        return F.when(going, let(following(acc["at"]), lambda nxt: F.when(nxt > acc["at"], F.struct(
            nxt.cast("long").alias("at"), F.lit(True).alias("open"),
            F.concat(acc["cuts"], F.array(nxt.cast("long"))).alias("cuts"),
        )).otherwise(F.struct(acc["at"].alias("at"), F.lit(False).alias("open"), acc["cuts"].alias("cuts"))))).otherwise(acc)

    steps = F.sequence(F.lit(1), F.lit(block_ms // floor_ms + 2))

    def run(waiting: DataFrame) -> DataFrame:
        start = F.struct(F.col("entry").alias("at"), F.lit(True).alias("open"), empty_array("bigint").alias("cuts"))
        return waiting.withColumn("__done", F.aggregate(steps, start, advance)).withColumn("exit", F.col("__done.at"))

    seq = Seq(("audio_id",), (BLOCK,), prepared=True, width=float(block_ms))
    guess = F.col("from_ms") + F.col(BLOCK) * block_ms
    several = not blocks.filter(F.col(BLOCK) > 0).isEmpty()
    entered = settle(cut_lineage(packed), seq, guess, run) if several else packed.withColumn("entry", F.col("from_ms"))
    cuts = run(entered).select("audio_id", F.explode_outer("__done.cuts").alias("core_start_ms")).filter(F.col("core_start_ms").isNotNull())
    starts = use.select("audio_id", F.col("from_ms").cast("long").alias("core_start_ms")).unionByName(cuts)
    starts, cseq = prepare(starts, Seq(("audio_id",), ("core_start_ms",)))
    rows = finish(scan(starts, cseq, {"position": Agg("sum", F.lit(1).cast("long"))},
                       {"__next": Agg("last", F.col("core_start_ms"), False)})).join(use, "audio_id")
    core_end = F.coalesce("__next", "to_ms")
    return rows.select(
        "audio_id", (F.col("position") - 1).alias("position"),
        F.greatest(F.col("from_ms"), F.col("core_start_ms") - F.when(F.col("position") > 1, overlap_ms).otherwise(0)).alias("source_start_ms"),
        F.least(F.col("to_ms"), core_end + F.when(F.col("__next").isNotNull(), overlap_ms).otherwise(0)).alias("source_end_ms"),
        "core_start_ms", core_end.alias("core_end_ms"),
    )


# Fixed values of the limited model: the plan that keeps every request under its input.
LIMITED_PLAN = {"target_ms": 150_000, "maximum_ms": 177_000, "minimum_tail_ms": 30_000}


def limited_parts(spans: DataFrame, silences: DataFrame) -> DataFrame:
    """Over-limit inputs split at pauses without overlap (E24, limited model)."""
    return plan_chunks(spans, silences, target_ms=150_000, maximum_ms=180_000, overlap_ms=0, minimum_tail_ms=30_000)


def plan_recognition(spans: DataFrame, silences: DataFrame, limited: bool = False) -> DataFrame:
    """Default plan, or the limited model's plan."""
    return plan_chunks(spans, silences, **(LIMITED_PLAN if limited else {}))


def speaking_rates(blocks: DataFrame) -> DataFrame:
    """Speaking rate per block and its running blend .7 old / .3 new.

    ``blocks(chapter_id, block_no, spoken_ms, units)``; order-dependent, hence a fold.
    """
    from timeweave.ordered import fold

    rate = F.col("spoken_ms") / F.greatest(F.lit(1), F.col("units"))
    rows = blocks.withColumn("rate", F.when(F.col("units") > 0, rate))
    none = F.lit(None).cast("double")

    def step(state: Column, row: Column) -> Column:
        return F.when(row["rate"].isNull(), state).when(state.isNull(), row["rate"]).otherwise(
            state * 0.7 + row["rate"] * 0.3)

    return fold(rows, Seq(order=("block_no",)), none, step, lambda _, row, after: F.struct(after.alias("blended_rate")))
