"""Where a cursor stands before each block of a long sequence, without walking the blocks one by one.

A sequential rule moves a cursor over the rows of another sequence.  The rows are cut into blocks; a block
maps the cursor it is entered with to the cursor it is left with.  These transfer maps are computed for many
possible entries at once, all blocks in parallel, and then composed, so that the real entries follow from
the first one.

* Entries are asked in pieces of ``PIECE`` neighbouring cursors.  Trajectories that start side by side soon
  meet, so a piece costs little more than its first rows.
* Which entries are asked is a guess: a band around the straight line to the end and one around the line of
  the stretch settled before.  Where the path leaves the band, the next round starts there with a band
  four times as wide.  Where cursors always go on, one piece a block is asked before; the mean way of these gives the
  line, and the band widens with the root of the blocks, as the path strays from it.  As no band can miss that is as wide as the other sequence, the rounds are at most the
  logarithm of its length to the base four; a round settles all blocks that its bands cover.
* Composition is by a tree with ``FAN`` maps a node: no task holds more than ``FAN`` blocks of one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.ordered import BLOCK
from timeweave.session import cut_lineage

PIECE = 32
FAN = 256
WIDER = 4
STRAY = 3


def _floor(value: Column, by: int) -> Column:
    return F.floor(value / by).cast("long")


def _follow(at: Column, step: Column) -> Column:
    """The cursor behind a block for the cursor before it; null if that entry was not asked."""
    piece = F.get(F.filter(step["pieces"], lambda p: p["piece"] == _floor(at["entry"], PIECE)), 0)
    return F.struct((step[BLOCK] + 1).alias(BLOCK), F.get(piece["exits"], (at["entry"] % PIECE).cast("int")).alias("entry"))


def _trace(at: Column, steps: Column) -> Column:
    """The entries of consecutive blocks, as far as they are known."""
    def one(path: Column, step: Column) -> Column:
        last = F.element_at(path, -1)
        after = _follow(last, step)
        return F.when((last[BLOCK] == step[BLOCK]) & after["entry"].isNotNull(), F.concat(path, F.array(after))).otherwise(path)
    return F.aggregate(steps, F.array(at), one)


def follow(maps: DataFrame, front: DataFrame, group: str, top: int | None = None) -> DataFrame:
    """(group, block, entry) from the front on, as far as the maps lead.

    ``maps(group, block, piece, exits)``, ``front(group, block, entry)``; blocks before a group's front are
    left out of ``maps``.
    """
    top = maps.agg(F.max(BLOCK)).first()[0] if top is None else top
    steps = maps.groupBy(group, BLOCK).agg(F.collect_list(F.struct("piece", "exits")).alias("pieces")).groupBy(group, _floor(F.col(BLOCK), FAN).alias("__node")).agg(
        F.array_sort(F.collect_list(F.struct(BLOCK, "pieces"))).alias("steps"))
    if (top or 0) < FAN:
        starts = front.select(group, F.struct(F.col(BLOCK).cast("long").alias(BLOCK), F.col("entry").cast("long").alias("entry")).alias("at"))
        found = steps.join(starts, group)
    else:
        steps = cut_lineage(steps)
        first, last = F.get("steps", 0), F.element_at("steps", -1)
        piece = F.explode(first["pieces"]["piece"]).alias("piece")

        def whole(entry: Column) -> Column:
            end = F.element_at(_trace(F.struct(first[BLOCK].alias(BLOCK), entry.alias("entry")), F.col("steps")), -1)
            return F.when(end[BLOCK] == last[BLOCK] + 1, end["entry"])

        nodes = steps.select(group, F.col("__node").alias(BLOCK), piece, "steps").withColumn(
            "exits", F.transform(F.sequence(F.col("piece") * PIECE, F.col("piece") * PIECE + (PIECE - 1)), whole)).drop("steps")
        above = follow(cut_lineage(nodes), front.select(group, _floor(F.col(BLOCK), FAN).alias(BLOCK), "entry"), group, top // FAN)
        found = steps.join(above.withColumnRenamed(BLOCK, "__node"), [group, "__node"]).withColumn("at", F.struct(first[BLOCK].alias(BLOCK), F.col("entry").alias("entry")))
    return found.select(group, F.explode_outer(_trace(F.col("at"), F.col("steps"))).alias("p")).filter(F.col("p").isNotNull()).select(group, "p.*").distinct()


def entries(blocks: DataFrame, sizes: DataFrame, group: str, reach: int, maps: Callable[[DataFrame], DataFrame],
            probe: bool = False) -> tuple[DataFrame, int]:
    """(group, block, entry) of every block, and the rounds it took.

    ``blocks(group, block)`` are numbered from 0, ``sizes(group, blocks, last)`` hold their number and the last row a
    cursor can stand at; a cursor starts at 0, never goes back, and goes on by at most ``reach`` a block.
    ``maps`` adds to rows (group, block, piece) the ``exits`` for the entries of the piece.
    """
    front = sizes.select(group, F.lit(0).cast("long").alias(BLOCK), F.lit(0).cast("long").alias("entry"), F.lit(0.0).alias("speed"))
    if probe:
        line = _floor(F.col(BLOCK) * (F.col("last") + 1) / F.col("blocks"), PIECE)
        asked = blocks.join(sizes, group).select(group, F.col(BLOCK).cast("long").alias(BLOCK), line.alias("piece"))
        tried = maps(asked).join(sizes, group).select(group, "last", F.posexplode("exits").alias("i", "exit"), "piece")
        speeds = tried.filter(F.col("exit") <= F.col("last")).groupBy(group).agg(F.avg(F.col("exit") - F.col("piece") * PIECE - F.col("i")).alias("__speed"))
        front = front.join(speeds, group, "left").select(group, BLOCK, "entry", F.coalesce("__speed", "speed").alias("speed"))
    front = cut_lineage(front)
    known, width, rounds = front.select(group, BLOCK, "entry"), PIECE, 0
    while True:
        rounds += 1
        here = front.select(group, F.col(BLOCK).alias("__at"), F.col("entry").alias("__entry"), "speed")
        ahead = blocks.join(here, group).join(sizes, group).filter(F.col(BLOCK) >= F.col("__at"))
        steps = F.col(BLOCK) - F.col("__at")
        least, most = F.col("__entry"), F.least(F.col("last") + 1, F.col("__entry") + steps * reach)

        def band(speed: Column) -> Column:
            middle = F.col("__entry") + steps * speed
            limit = lambda x: F.least(F.greatest(x, least.cast("double")), most.cast("double"))
            half = STRAY * F.sqrt(steps) * width if probe else F.lit(width)
            return F.sequence(_floor(limit(middle - half), PIECE), _floor(limit(middle + half), PIECE))

        straight = (F.col("last") + 1 - F.col("__entry")) / F.greatest(F.lit(1), F.col("blocks") - F.col("__at"))
        lines = band(F.col("speed")) if probe else F.array_distinct(F.concat(band(straight), band(F.col("speed"))))
        pieces = F.explode(lines).alias("piece")
        found = cut_lineage(maps(ahead.select(group, F.col(BLOCK).cast("long").alias(BLOCK), pieces)))
        path = cut_lineage(follow(found, front.select(group, BLOCK, "entry"), group))
        known = known.unionByName(path.join(front.select(group, F.col(BLOCK).alias("__at")), group).filter(F.col(BLOCK) > F.col("__at")).drop("__at"))
        ends = path.groupBy(group).agg(F.max(F.struct(BLOCK, "entry")).alias("e")).join(here, group).join(sizes, group).filter(F.col(f"e.{BLOCK}") < F.col("blocks"))
        speed = (F.col("e.entry") - F.col("__entry")) / F.greatest(F.lit(1), F.col(f"e.{BLOCK}") - F.col("__at"))
        front = cut_lineage(ends.select(group, F.col(f"e.{BLOCK}").alias(BLOCK), F.col("e.entry").alias("entry"), speed.alias("speed")))
        if front.isEmpty():
            return known.join(blocks, [group, BLOCK], "left_semi"), rounds
        width *= WIDER
