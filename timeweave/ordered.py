"""Ordered scans over (group, order) sequences that survive one huge group.

Every timeline rule in this library reads the rows of one chapter in order.  A
window ``PARTITION BY chapter_id`` does that, but puts a whole chapter into one
task.  ``prepare`` measures the largest group with one partially aggregated pass:

* no group above the limit -> plain windows, one exchange on the group key;
* otherwise -> the rows are range-partitioned by group and order, by Spark's own sample of the whole keys, into
  partitions of about ``limit`` rows, which become the blocks of the sequences.  So neither an outlier nor ties
  in the first order column nor small groups beside a large one make blocks uneven.  ``scan`` runs the window inside (group, block), reduces each block to one summary
  row, carries the summaries forward over the blocks, and joins them back on
  (group, block).  No task ever sees more than one block of rows.

``fold`` is for rules whose next state is not an associative reduction.  Blocks are
folded in parallel from a guessed entry state, the exit states are passed on to the
following blocks, and only blocks whose entry changed are folded again until nothing
changes.  The fixed point is exactly the sequential result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.session import cut_lineage

BLOCK = "__block"
SCAN_ROWS = 65_536
FOLD_ROWS = 2_048
ROWS_SETTING = "timeweave.block.rows"


@dataclass(frozen=True)
class Seq:
    """How rows are grouped and ordered.

    ``by`` is a numeric SQL expression that never decreases along ``order``; it
    defaults to the first order column and defines the block boundaries.
    """

    group: tuple[str, ...] = ("chapter_id",)
    order: tuple[str, ...] = ("position",)
    by: str | None = None
    prepared: bool = False
    width: float | None = None
    limit: int = SCAN_ROWS

    @property
    def by_expr(self) -> Column:
        return F.expr(self.by or self.order[0]).cast("double")

    @property
    def keys(self) -> list[str]:
        return [*self.group, BLOCK] if self.width is not None else list(self.group)

    def order_struct(self) -> Column:
        return F.struct(*[F.col(name) for name in self.order])


CHAPTER = Seq()


def block_rows(df: DataFrame, default: int) -> int:
    return int(df.sparkSession.conf.get(ROWS_SETTING, str(default)))


def measure(df: DataFrame, seq: Seq, rows: int = SCAN_ROWS) -> Seq:
    """Decide once for a sequence whether plain windows do; one partially aggregated pass.

    The decision also holds for any subset of the measured rows.
    """
    limit = block_rows(df, rows)
    sizes = df.groupBy(*seq.group).agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(seq.by_expr) - F.min(seq.by_expr)).alias("span"),
    )
    width = sizes.filter(F.col("n") > limit).agg(
        F.min(F.greatest(F.col("span"), F.lit(1.0)) * limit / F.col("n"))
    ).first()[0]
    return replace(seq, prepared=True, limit=limit, width=None if width is None else float(max(width, 1e-9)))


def bounded(seq: Seq, sizes: DataFrame, upper: Column) -> Seq:
    """Skip measuring when a cheap upper bound on every group's rows already fits.

    ``sizes`` is a table that is cheaper to read than the rows themselves.
    """
    limit = block_rows(sizes, SCAN_ROWS)
    most = sizes.agg(F.max(upper)).first()[0]
    return replace(seq, prepared=True, limit=limit) if (most or 0) <= limit else seq


def refine(seq: Seq, group: tuple[str, ...], order: tuple[str, ...] | None = None) -> Seq:
    """The sequence of smaller groups inside measured ones: plain windows stay plain."""
    plain = seq.prepared and seq.width is None
    return Seq(group, order or seq.order, seq.by, prepared=plain, limit=seq.limit)


def prepare(df: DataFrame, seq: Seq, rows: int = SCAN_ROWS) -> tuple[DataFrame, Seq]:
    """Plain windows or blocks; in block mode the rows are written once, with their block."""
    if seq.prepared and (seq.width is not None or seq.limit <= max(rows, block_rows(df, rows))):
        return place(df, seq), seq
    seq = measure(df, replace(seq, prepared=False), rows)
    return (df, seq) if seq.width is None else (deal(df, seq), seq)


def deal(df: DataFrame, seq: Seq) -> DataFrame:
    """The rows written in blocks of about ``limit`` rows, even ones whatever the order columns look like.

    The rows are written before, so that sampling them does not run the plan above again.
    """
    df = cut_lineage(finish(df))
    n = -(-df.count() // seq.limit)
    dealt = df.repartitionByRange(n, *seq.group, *seq.order)
    return cut_lineage(dealt.withColumn(BLOCK, F.spark_partition_id().cast("long")))


def place(df: DataFrame, seq: Seq) -> DataFrame:
    """Add the block number of a measured sequence where it is missing."""
    if seq.width is None or BLOCK in df.columns:
        return df
    return df.withColumn(BLOCK, F.floor(seq.by_expr / F.lit(seq.width)))


def finish(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK)


@dataclass(frozen=True)
class Agg:
    """One running value: ``kind`` over ``value``, with or without the current row."""

    kind: str
    value: Column
    inclusive: bool = True

    def over_rows(self) -> Column:
        return {
            "sum": F.sum, "max": F.max, "min": F.min,
            "last": lambda value: F.last(value, ignorenulls=True),
            "first": lambda value: F.first(value, ignorenulls=True),
        }[self.kind](self.value)

    def of_block(self, seq: Seq, backward: bool) -> Column:
        if self.kind in {"sum", "max", "min"}:
            return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self.value)
        key = F.when(self.value.isNotNull(), seq.order_struct())
        latest = (self.kind == "last") != backward
        return (F.max_by if latest else F.min_by)(self.value, key)

    def combine(self, carried: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.when(
                carried.isNotNull() | local.isNotNull(),
                F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0)),
            )
        if self.kind == "max":
            return F.greatest(carried, local)
        if self.kind == "min":
            return F.least(carried, local)
        return F.coalesce(local, carried) if self.kind == "last" else F.coalesce(carried, local)


def prev(*columns: Column | str) -> Agg:
    """The directly preceding row's values as a struct (following row when backward)."""
    return Agg("last", F.struct(*columns), inclusive=False)


def scan(
    df: DataFrame,
    seq: Seq,
    forward: dict[str, Agg] | None = None,
    backward: dict[str, Agg] | None = None,
) -> DataFrame:
    """Add running values in both directions; ``df``/``seq`` come from ``prepare``."""
    assert seq.prepared, "call prepare() first"
    sides = [(name, agg, False) for name, agg in (forward or {}).items()]
    sides += [(name, agg, True) for name, agg in (backward or {}).items()]

    def window(keys: list[str], order: list[str], backwards: bool, inclusive: bool):
        ordering = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
        return Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(
            Window.unboundedPreceding, 0 if inclusive else -1,
        )

    local = df.select("*", *[
        agg.over_rows().over(window(seq.keys, list(seq.order), back, agg.inclusive)).alias(name)
        for name, agg, back in sides
    ])
    if seq.width is None:
        return local
    summary = df.groupBy(*seq.keys).agg(*[
        agg.of_block(seq, back).alias(name) for name, agg, back in sides
    ])
    carried = summary.select(*seq.keys, *[
        Agg(agg.kind, F.col(name), False).over_rows()
        .over(window(list(seq.group), [BLOCK], back, False)).alias(f"__carry_{name}")
        for name, agg, back in sides
    ])
    # Blocks that receive nothing are left out: at most rows/limit rows remain.
    carried = carried.filter(reduce(
        lambda x, y: x | y, [F.col(f"__carry_{name}").isNotNull() for name, _, _ in sides],
    ))
    joined = local.join(carried, seq.keys, "left")
    names = {name for name, _, _ in sides}
    return joined.select(
        *[c for c in local.columns if c not in names],
        *[agg.combine(F.col(f"__carry_{name}"), F.col(name)).alias(name) for name, agg, _ in sides],
    )


def number_rows(df: DataFrame, seq: Seq, name: str, start: int = 0) -> DataFrame:
    """Dense row numbers along the sequence."""
    df, seq = prepare(df, seq)
    numbered = scan(df, seq, {name: Agg("sum", F.lit(1).cast("long"))})
    return finish(numbered.withColumn(name, F.col(name) + F.lit(start - 1)))


def fold(
    df: DataFrame,
    seq: Seq,
    init: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column, Column], Column],
    columns: list[str] | None = None,
) -> DataFrame:
    """Run a sequential rule exactly; one output row per input row.

    ``step(state, row) -> state`` and ``emit(before, row, after) -> struct`` build
    Catalyst expressions.  Output: the columns of ``row`` plus the emitted struct's.
    """
    if seq.width is not None and seq.limit > block_rows(df, FOLD_ROWS):
        df, seq = finish(df), replace(seq, prepared=False, width=None)
    df, seq = prepare(df, seq, FOLD_ROWS)
    payload = columns or [c for c in df.columns if c != BLOCK]
    rest = [c for c in payload if c not in seq.order and c not in seq.group]
    packed = df.groupBy(*seq.keys).agg(
        F.array_sort(F.collect_list(F.struct(*seq.order, *rest))).alias("rows")
    )
    if seq.width is None:
        blocks = packed.withColumn("entry", init)
    else:
        blocks = settle(cut_lineage(packed), seq, init, lambda waiting: waiting.withColumn(
            "exit", F.aggregate("rows", F.col("entry"), step),
        ))

    def advance(acc: Column, row: Column) -> Column:
        after = F.transform(F.array(step(acc["s"], row)), lambda s: F.struct(
            s.alias("s"), F.concat(acc["o"], F.array(emit(acc["s"], row, s))).alias("o"),
        ))
        return F.element_at(after, 1)

    empty = F.filter(
        F.transform("rows", lambda row: emit(F.col("entry"), row, F.col("entry"))),
        lambda _: F.lit(False),
    )
    folded = blocks.select(
        *seq.group, "rows",
        F.aggregate("rows", F.struct(F.col("entry").alias("s"), empty.alias("o")), advance)["o"].alias("out"),
    )
    zipped = folded.select(
        *seq.group, F.explode_outer(F.arrays_zip("rows", "out")).alias("z"),
    ).filter(F.col("z").isNotNull())
    return zipped.select(*seq.group, "z.rows.*", "z.out.*")


def settle(
    packed: DataFrame, seq: Seq, init: Column, run: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Iterate block entry states to their fixed point.

    ``packed`` holds one row per block and should be materialised; ``run`` adds
    ``exit`` to blocks that carry an ``entry``.  The first block of a group enters
    with ``init``, every other block with the exit of the block before it.
    """
    keys = seq.keys
    over = Window.partitionBy(*seq.group).orderBy(BLOCK)

    def exits(state: DataFrame) -> DataFrame:
        return run(packed.join(state, keys)).select(*keys, "entry", "exit")

    known = exits(packed.select(*keys, init.alias("entry")))
    while True:
        checked = cut_lineage(known.select(
            *keys, "entry", "exit",
            F.when(F.row_number().over(over) == 1, F.col("entry")).otherwise(F.lag("exit").over(over)).alias("wanted"),
        ))
        stale = ~F.col("wanted").eqNullSafe(F.col("entry"))
        if checked.filter(stale).isEmpty():
            return packed.join(checked.select(*keys, "entry"), keys)
        known = checked.filter(~stale).select(*keys, "entry", "exit").unionByName(
            exits(checked.filter(stale).select(*keys, F.col("wanted").alias("entry")))
        )
