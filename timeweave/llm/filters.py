"""A bounded filter for ids: rows that surely have no partner need not be shuffled with their texts.

The filter is a bit for each of ``BITS`` hash values, kept as at most ``BITS / 64`` rows of 64 bits, so
its broadcast has a fixed bound whatever the input.  It never misses an id it was made from; others
pass with a chance that grows with the number of ids, up to all of them for very many.  So an exact
join always follows, and only its cost depends on the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm.tables import cut_lineage

BITS = 1 << 26


def _bit(column: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(BITS)), F.lit(0))


class IdFilter:
    """Made from the ``column`` of a DataFrame."""

    def __init__(self, ids: DataFrame, column: str):
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), (_bit(column) % 64).cast("int"))
        words = ids.select(F.shiftright(_bit(column), 6).alias("__word"), mask.alias("__mask"))
        self.words = cut_lineage(words.groupBy("__word").agg(F.bit_or("__mask").alias("__mask")))

    def rows(self, df: DataFrame, column: str, inside: bool) -> DataFrame:
        """The rows whose id may be in the filter, or those whose id surely isn't."""
        word, place = F.shiftright(_bit(column), 6), (_bit(column) % 64).cast("int")
        marked = df.withColumns({"__w": word, "__p": place}).join(F.broadcast(self.words), F.col("__w") == F.col("__word"), "left")
        has = F.coalesce(F.call_function("shiftright", F.col("__mask"), F.col("__p")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
        return marked.filter(has if inside else ~has).select(*df.columns)
