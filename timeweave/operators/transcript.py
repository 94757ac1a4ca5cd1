"""Recognised tokens: sentences, blocks, chunk merging and clipping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import BLANKS, join_token_text, terminal_mark
from timeweave.functions.timecode import clamp01
from timeweave.ordered import Agg, Seq, finish, fold, number_rows, prepare, prev, scan
from timeweave.session import cut_lineage

TOKENS = Seq(order=("token_pos",))


def sentence_starts(tokens: DataFrame, max_duration_ms: int = 12_000, pause_ms: int = 700,
                    max_visible: int = 90, seq: Seq = TOKENS) -> DataFrame:
    """Mark the first token of every sentence.

    A sentence ends at terminal punctuation, before a pause, or when it grows too long.
    The length caps depend on where the sentence began, hence the fold; its state is
    empty after every natural break.
    """
    rows, seq = prepare(tokens, seq)
    rows = finish(scan(rows, seq, None, {"__next": prev("start_ms")}))
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumn("__ends", F.col("__next").isNull() | trimmed.rlike("[。！？!?；;]$") | F.coalesce(
        F.col("__next.start_ms") - F.col("end_ms") >= pause_ms, F.lit(False)
    )).withColumn("__len", F.length(F.btrim("text", F.lit(BLANKS)))).drop("__next")
    closed = F.struct(F.lit(None).cast("long").alias("since"), F.lit(0).alias("len"))

    def step(state: Column, row: Column) -> Column:
        since = F.coalesce(state["since"], row["start_ms"])
        size = state["len"] + row["__len"]
        full = row["__ends"] | (row["end_ms"] - since >= max_duration_ms) | (size >= max_visible)
        return F.when(full, closed).otherwise(F.struct(since.alias("since"), size.alias("len")))

    return fold(rows, Seq(seq.group, seq.order, seq.by), closed, step,
                lambda state, row, after: F.struct(state["since"].isNull().alias("starts"))).drop("__ends", "__len")


def tokens_to_sentences(tokens: DataFrame, language: str = "auto", seq: Seq = TOKENS, **limits: int) -> DataFrame:
    """Editable sentences from tokens: joined text, times, mean probability, status."""
    marked, seq = prepare(sentence_starts(tokens, seq=seq, **limits), seq)
    groups = finish(scan(marked, seq, {"position": Agg("sum", F.col("starts").cast("long"))}))
    parts = F.array_sort(F.collect_list(F.struct(*seq.order, "text", "start_ms", "end_ms")))
    built = groups.groupBy(*seq.group, "position").agg(
        parts.alias("parts"), F.min("start_ms").alias("__s"), F.count(F.lit(1)).alias("n_tokens"),
        F.max_by("end_ms", seq.order_struct()).alias("end_ms"), F.min_by("start_ms", seq.order_struct()).alias("start_ms"),
        F.avg("probability").alias("p"),
    )
    return built.select(
        *seq.group, (F.col("position") - 1).alias("position"),
        terminal_mark(join_token_text(F.col("parts"), language), language).alias("text"),
        "start_ms", "end_ms", "n_tokens", clamp01(F.col("p")).alias("confidence"),
        F.when(F.col("p") >= 0.58, F.lit("auto")).otherwise(F.lit("low_confidence")).alias("status"),
        F.lit(False).alias("locked"), F.lit("asr").alias("origin"),
    )


def token_blocks(tokens: DataFrame, pause_ms: int = 900, maximum: int = 36, seq: Seq = TOKENS) -> DataFrame:
    """Readable blocks of unassigned tokens: pause, 36 tokens, or a strong ending."""
    rows, seq = prepare(tokens, seq)
    rows = scan(rows, seq, {"__prev": prev("end_ms", "text"), "__idx": Agg("sum", F.lit(1).cast("long"))})
    strong = F.rtrim(F.col("__prev.text"), F.lit(BLANKS)).rlike("[.。！？!?…]$")
    starts = F.col("__prev").isNull() | (F.col("start_ms") - F.col("__prev.end_ms") >= pause_ms) | strong
    rows = rows.withColumn("__start", starts).drop("__prev")
    rows = finish(scan(rows, seq, {
        "island": Agg("sum", F.col("__start").cast("long")),
        "__first": Agg("last", F.when(F.col("__start"), F.col("__idx"))),
    }))
    return rows.withColumn("part", F.floor((F.col("__idx") - F.col("__first")) / maximum)).drop("__idx", "__first", "__start")


def merge_chunks(chunk_tokens: DataFrame, chunks: DataFrame, dedup: bool = False) -> DataFrame:
    """Chunk-local tokens in run time, kept when their midpoint is in the closed core, renumbered.

    Closed cores keep a token of both chunks when its midpoint equals the seam;
    ``dedup`` makes the core half-open instead.
    """
    joined = chunk_tokens.join(chunks.select(
        "run_id", F.col("position").alias("chunk_position"), F.col("source_start_ms"), "core_start_ms", "core_end_ms",
    ), ["run_id", "chunk_position"]).withColumn(
        "start_ms", F.col("start_ms") + F.col("source_start_ms")
    ).withColumn("end_ms", F.col("end_ms") + F.col("source_start_ms"))
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    inside = (mid >= F.col("core_start_ms")) & ((mid < F.col("core_end_ms")) if dedup else (mid <= F.col("core_end_ms")))
    # Written once: numbering measures the runs first, which would join all tokens a second time.
    kept = cut_lineage(joined.filter(inside).drop("source_start_ms", "core_start_ms", "core_end_ms"))
    return number_rows(kept, Seq(("run_id",), ("chunk_position", "token_pos"), by="chunk_position"), "position")


def run_tokens(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tokens of completed chunks in (chunk, token) order, renumbered."""
    done = chunks.filter("status = 'complete'").select("run_id", F.col("position").alias("chunk_position"))
    return number_rows(tokens.join(done, ["run_id", "chunk_position"], "left_semi"),
                       Seq(("run_id",), ("chunk_position", "token_pos"), by="chunk_position"), "position")


def bounded_tokens(tokens: DataFrame, durations: DataFrame | None = None, seq: Seq = TOKENS) -> DataFrame:
    """Tokens clipped to ``[0, duration_ms]``; empty and late ones dropped, renumbered."""
    rows = tokens if durations is None else tokens.join(durations, list(seq.group), "left")
    limit = F.lit(None).cast("long") if durations is None else F.greatest(F.lit(0), F.col("duration_ms"))
    start = F.greatest(F.lit(0), F.col("start_ms"))
    end = F.coalesce(F.least(F.greatest(F.lit(0), F.col("end_ms")), limit), F.greatest(F.lit(0), F.col("end_ms")))
    rows = rows.withColumn("__late", F.coalesce(start >= limit, F.lit(False))).withColumn("__e", end).withColumn(
        "start_ms", start
    ).withColumn("end_ms", F.col("__e")).filter(~F.col("__late") & (F.col("end_ms") > F.col("start_ms")))
    return number_rows(rows.drop("__late", "__e", "duration_ms"), seq, "position")


def work_totals(chapters: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chapters, chunks, audio milliseconds and cache hits of a planned run."""
    per_book = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("chapter_total"))
    work = chunks.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chunk_total"), F.sum(F.col("core_end_ms") - F.col("core_start_ms")).alias("total_audio_ms"),
        F.count_if(F.col("status") == "complete").alias("cache_hits"),
    )
    return per_book.join(work, "book_id", "left").na.fill(0, ["chunk_total", "total_audio_ms", "cache_hits"])


# Fixed value: backends whose token times come from the model itself.
MODEL_TIMED = ("qwen3-asr",)


def snaps_to_silence(backend: Column) -> Column:
    """Whether times of a backend may be moved to pauses (H37); not if the model timed them itself."""
    return ~F.coalesce(backend.isin(*MODEL_TIMED), F.lit(False))
