"""Interval, point, nearest and as-of joins keyed by (group, time bucket).

Intervals are copied once per bucket they touch.  For intervals that lie along one
timeline the copies add at most ``timeline / width`` rows, and no bucket holds more
than ``width`` milliseconds of one group, so a hot group spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.ordered import Agg, Seq, finish, prepare, scan

BUCKET = "__bucket"
WIDTH_MS = 60_000


def bucket(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width))


def spread(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """One copy per touched bucket."""
    low, high = bucket(start, width), bucket(F.greatest(start, end), width)
    return df.withColumn(BUCKET, F.explode(F.sequence(low, high)))


def overlap_join(
    left: DataFrame, right: DataFrame, group: list[str],
    left_span: tuple[str, str], right_span: tuple[str, str], width: int = WIDTH_MS,
) -> DataFrame:
    """Pairs with ``left.start < right.end AND right.start < left.end`` (half-open).

    Span columns must have different names on both sides.  A pair that meets in
    several buckets is kept only in the bucket of the later start.
    """
    (ls, le), (rs, re_) = left_span, right_span
    a = spread(left, F.col(ls), F.col(le), width)
    b = spread(right, F.col(rs), F.col(re_), width)
    joined = a.join(b, [*group, BUCKET])
    return joined.filter(
        (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
        & (F.col(BUCKET) == bucket(F.greatest(F.col(ls), F.col(rs)), width))
    ).drop(BUCKET)


def point_join(
    points: DataFrame, spans: DataFrame, group: list[str], point: str,
    span: tuple[str, str], width: int = WIDTH_MS, closed: bool = False, how: str = "inner",
) -> DataFrame:
    """Pairs with ``start <= point < end`` (``<= end`` when closed)."""
    start, end = span
    a = points.withColumn(BUCKET, bucket(F.col(point), width))
    b = spread(spans, F.col(start), F.col(end), width)
    inside = (F.col(point) >= F.col(start)) & (
        F.col(point) <= F.col(end) if closed else F.col(point) < F.col(end)
    )
    # Renamed keys keep joins of related tables unambiguous.
    condition = inside
    for c in [*group, BUCKET]:
        b = b.withColumnRenamed(c, f"__right_{c}")
        condition = condition & (F.col(c) == F.col(f"__right_{c}"))
    joined = a.join(b, condition, how)
    return joined.drop(BUCKET, *[f"__right_{c}" for c in [*group, BUCKET]])


def within_join(
    left: DataFrame, right: DataFrame, group: list[str], at: str, other: str, window: int,
) -> DataFrame:
    """Pairs with ``|left.at - right.other| <= window``; the right side is copied three times."""
    width = max(1, window)
    a = left.withColumn(BUCKET, bucket(F.col(at), width))
    home = bucket(F.col(other), width)
    b = right.withColumn(BUCKET, F.explode(F.array(home - 1, home, home + 1)))
    joined = a.join(b, [*group, BUCKET])
    return joined.filter(F.abs(F.col(at) - F.col(other)) <= window).drop(BUCKET)


def asof_join(
    left: DataFrame, right: DataFrame, group: tuple[str, ...], at: str, other: str,
    values: list[str], backward: bool = True, name: str = "hit",
) -> DataFrame:
    """Attach the right row at or before (or at or after) ``at`` as a struct column.

    Both sides are laid on one sequence and the last (next) right row is carried
    along it, so no pairs are formed at all.
    """
    side = F.lit(0 if backward else 1)
    hit = F.struct(F.col(other).alias(other), *[F.col(v).alias(v) for v in values])
    points = left.select(
        *group, F.col(at).alias("__t"), (F.lit(1) - side).alias("__side"),
        F.struct(*[c for c in left.columns]).alias("__row"),
        F.lit(None).cast(right.select(hit.alias("h")).schema["h"].dataType).alias("__hit"),
    )
    rows = right.select(
        *group, F.col(other).alias("__t"), side.alias("__side"),
        F.lit(None).cast(points.schema["__row"].dataType).alias("__row"), hit.alias("__hit"),
    )
    # ties: right rows come first going backward, last going forward; then by value
    both = points.unionByName(rows)
    both, seq = prepare(both, Seq(tuple(group), ("__t", "__side", "__hit"), by="__t"))
    carried = Agg("last", F.col("__hit"), inclusive=True)
    both = scan(both, seq, **({"forward": {name: carried}} if backward else {"backward": {name: carried}}))
    return finish(both).filter(F.col("__row").isNotNull()).select("__row.*", name)
