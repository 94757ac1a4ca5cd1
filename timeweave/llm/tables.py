"""Reading input tables and cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timeweave.session import cut_lineage

__all__ = ["cut_lineage", "read", "spread"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> int:
    """Partitions for an exchange whose rows a Python task streams through."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
