"""From raw documents to token ids: the stages of a training corpus, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder and reads it again, so a
lost executor costs at most one stage.

Defined results: documents without an id pass the stages that judge by id; extra columns stay as
they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeweave.llm import decontamination, language_id, near_duplicates, secrets, sentence_pieces
from timeweave.llm.filters import IdFilter
from timeweave.llm.tables import cut_lineage, read


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter go, and those that no language's model codes better than plain bytes."""
    model = language_id.train(docs)
    # The other columns travel as one, so that none of them can clash with the added ones.
    others = [c for c in docs.columns if c != "text"]
    marked = language_id.identify(docs.select(F.struct(*others).alias("__row"), "text"), model)
    kept = marked.filter(language_id.accepted())
    return kept.select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the least id stays; of repeated ids one row."""
    groups = cut_lineage(near_duplicates.near_duplicates(docs).select(F.col("doc_id").alias("__of"), F.col("class_id").alias("__class")))
    groups = groups.filter(F.col("__of").isNotNull()).groupBy("__of").agg(F.min("__class").alias("__class"), F.count(F.lit(1)).alias("__rows"))
    # Only these have to meet their group; all others stay where they are.
    judged = cut_lineage(groups.filter((F.col("__class") != F.col("__of")) | (F.col("__rows") > 1)))
    asked = IdFilter(judged, "__of")
    joined = asked.rows(docs, "doc_id", inside=True).join(judged, F.col("doc_id") == F.col("__of"), "left")
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    kept = joined.filter(F.coalesce(F.col("__class") == F.col("doc_id"), F.lit(True))).withColumn("__n", F.row_number().over(same))
    kept = kept.filter(F.col("doc_id").isNull() | (F.col("__n") == 1)).select(*docs.columns)
    return kept.unionByName(asked.rows(docs, "doc_id", inside=False))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = cut_lineage(decontamination.contaminated(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    asked = IdFilter(found, "doc_id")
    kept = asked.rows(docs, "doc_id", inside=True).join(found, "doc_id", "left_anti").select(*docs.columns)
    return kept.unionByName(asked.rows(docs, "doc_id", inside=False))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, with its new length."""
    found = secrets.redact(secrets.scan(docs, secrets.train(docs)))
    size = F.when(F.size("secret_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left."""
    done = sentence_pieces.encode(docs.select("doc_id", "lang", "source", "text"), sentence_pieces.load_model())
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("language_id", identified),
    ("near_duplicates", one_of_each_group),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("sentence_pieces", tokenised),
]

# SQL cannot say the first stage; the whole is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
