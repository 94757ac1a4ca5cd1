"""Clock text to milliseconds and back, and silence edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_time(ms: Column, separator: str = ".") -> Column:
    """``HH:MM:SS.mmm``; negatives become zero."""
    value = F.greatest(ms.cast("long"), F.lit(0))

    def part(unit: int, modulo: int | None = None) -> Column:
        whole = F.floor(value / unit)
        return whole if modulo is None else whole % modulo

    return F.format_string(
        f"%02d:%02d:%02d{separator}%03d",
        part(3_600_000), part(60_000, 60), part(1000, 60), value % 1000,
    )


def format_srt_time(ms: Column) -> Column:
    return format_time(ms, ",")


def _clock(hours: Column, minutes: Column, seconds: Column, fraction: Column) -> Column:
    h, m, s = (F.coalesce(F.nullif(x, F.lit("")), F.lit("0")).cast("long") for x in (hours, minutes, seconds))
    milli = F.rpad(F.coalesce(F.nullif(fraction, F.lit("")), F.lit("0")), 3, "0").cast("long")
    return F.when((m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1000 + milli)


def parse_srt_time(text: Column) -> Column:
    """Subtitle clock to milliseconds, null when invalid."""
    pattern = r"^\s*([0-9]{1,3}):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})\s*$"
    parts = [F.regexp_extract(text, pattern, i) for i in range(1, 5)]
    return F.when(text.rlike(pattern), _clock(*parts))


def parse_display_time(text: Column) -> Column:
    """Clock with optional hours and fraction, null when invalid."""
    pattern = r"^\s*(?:([0-9]{1,3}):)?([0-9]{1,2}):([0-9]{2})(?:[,.]([0-9]{1,3}))?\s*$"
    parts = [F.regexp_extract(text, pattern, i) for i in range(1, 5)]
    return F.when(text.rlike(pattern), _clock(*parts))


def silence_edges(time_ms: Column, start_ms: Column, end_ms: Column, padding_ms: int = 0) -> Column:
    """``struct<previous_end, following_start>`` of a silence."""
    center = F.greatest(F.lit(0), time_ms)
    first = F.greatest(F.lit(0), F.coalesce(start_ms, time_ms))
    second = F.greatest(F.lit(0), F.coalesce(end_ms, time_ms))
    low, high = F.least(first, second), F.greatest(first, second)
    inside = F.least(F.lit(max(0, padding_ms)).cast("long"), F.floor((high - low) / 2))
    point = high <= low
    pad = F.lit(max(0, padding_ms))
    return F.struct(
        F.when(point, F.greatest(F.lit(0), center - pad)).otherwise(low + inside).cast("long").alias("previous_end"),
        F.when(point, center + pad).otherwise(high - inside).cast("long").alias("following_start"),
    )


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
