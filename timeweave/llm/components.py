"""Connected components of very many links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.tables import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component): every linked id with the least id it can reach; ``links`` has long a and b.

    The large-star step hangs the greater neighbours of an id under its least neighbour, the
    small-star step hangs its lesser neighbours and itself there.  Rounds grow with the logarithm of
    the longest path.  Minima are partly aggregated, and no id's neighbours are ever collected.
    """
    state = cut_lineage(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not state.join(state.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(
            both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        state = cut_lineage(
            near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
