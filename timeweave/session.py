"""Session helpers: tuned local sessions and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    shuffle = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("timeweave")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
    )
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the written copy.

    A lost executor then costs one file read instead of the whole lineage, and the copy
    has true sizes for the planner and prunes columns.
    """
    path = f"{shared_folder(df.sparkSession)}/timeweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Cut = Callable[..., DataFrame]
# Off while a dealt table is written: joins by more keys than the buckets' would be dealt anew, buckets be read in splits.
DEALT = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.sources.bucketing.autoBucketedScan.enabled")


def cut_by(key: str, buckets: int) -> Cut:
    """As ``cut_lineage``, for steps that all work by ``key``: the rows of all parts in one table in buckets of the key.

    Windows, groupings and joins whose keys contain ``key`` then move no rows, if their result is written in the same
    way.  No union: it would forget the buckets.  The table leaves the catalog at once, its files stay in the shared folder.
    """
    def cut(*parts: DataFrame) -> DataFrame:
        spark, name = parts[0].sparkSession, f"timeweave_{uuid.uuid4().hex}"
        before = {setting: spark.conf.get(setting) for setting in DEALT}
        try:
            for setting in DEALT:
                spark.conf.set(setting, "false")
            for part in parts:
                part.select(*parts[0].columns).repartition(buckets, key).write.mode("append").bucketBy(buckets, key).options(
                    path=f"{shared_folder(spark)}/{name}", compression="zstd").saveAsTable(name)
        finally:
            for setting, value in before.items():
                spark.conf.set(setting, value)
        table = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
        return table

    cut.buckets = buckets  # rows dealt out so before are written where they are
    return cut
