"""Allow and block rules for urls by a sort-merge range join.

A host is written backwards by labels, so a rule for a host and a path prefix is an interval of
(reversed host, path) keys.  As a rule also fits all subdomains, a url asks under every suffix of
its host: its keys are the reversed suffix and its path.  Keys and intervals are dealt by ranges of
the key, an interval to every range it touches; inside a range they are read in order, and a stack
holds the rules that are open.  They are nested, so its top is the longest one that fits.

Distinct urls are judged once and joined back to their rows.  Range limits come from a sample of
at most ``SAMPLE_KEYS`` distinct keys.  The winner over all suffixes is the longest rule (host and
path together), then the one with the longer host.

Defined results: without a rule the verdict is ``allow``; host and path of a null url, or one
without ``://``, are empty and only fitted by rules for the empty host; of rules for one host and
path a block goes before an allow.  Rules with a null host or path never fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.registry import query
from timeweave.llm.tables import cut_lineage, read, spread

DEFAULT = "allow"
SAMPLE_KEYS = 20_000
# The rules of the query.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels last to first, each ended by a dot, so that no host's key is a prefix of another label."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def _limits(keys: DataFrame, ranges: int) -> list[tuple[str, str]]:
    """Keys that cut the sampled ones into about equal ranges; at most ``SAMPLE_KEYS`` are brought here."""
    total = keys.count()
    share = min(1.0, SAMPLE_KEYS / 2 / max(total, 1))
    taken = keys.filter(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(SAMPLE_KEYS)
    rows = sorted((row["host"].encode(), row["path"].encode()) for row in taken.collect())
    step = max(1, len(rows) // ranges)
    return [*dict.fromkeys(rows[step::step])]


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_id, rule, verdict) for every (url_id, host, path) that some rule fits."""
    spark = urls.sparkSession
    keys = cut_lineage(urls.select("url_id", F.explode(suffixes(F.col("host"))).alias("suffix"), "path").select(
        "url_id", reversed_host(F.col("suffix")).alias("host"), "path"))
    opened = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).groupBy("host", "path").agg(
        F.max("verdict").alias("verdict")).select(reversed_host(F.col("host")).alias("host"), "path", F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict")
    limits = spark.sparkContext.broadcast(_limits(keys.select("host", "path"), spread(urls)))

    def deal(batches):
        from bisect import bisect_right

        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            first, last = [], []
            for host, path in zip(hosts, paths):
                low = (host.encode(), path.encode())
                first.append(bisect_right(limits.value, low))
                # 0xFF is greater than every byte of a text, so this is behind every path that begins so.
                last.append(bisect_right(limits.value, (low[0], low[1] + b"\xff")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=[*batch.schema.names, "first", "last"])

    asked = keys.mapInArrow(deal, "url_id long, host string, path string, first int, last int").select(
        F.col("first").alias("range"), "host", "path", F.lit(1).alias("kind"), "url_id", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("host_chars"), F.lit(None).cast("string").alias("verdict"))
    begun = opened.mapInArrow(deal, "host string, path string, rule string, host_chars int, verdict string, first int, last int").select(
        F.explode(F.sequence("first", "last")).alias("range"), "host", "path", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("url_id"), "rule", "host_chars", "verdict")
    dealt = asked.unionByName(begun).repartition(spread(urls), "range").sortWithinPartitions("range", "host", "path", "kind")

    def sweep(batches):
        stack, place = [], None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "host", "path", "kind", "url_id", "rule", "host_chars", "verdict"))):
                at, host, path, kind, url_id, rule, chars, verdict = row
                if (at, host) != place:
                    stack, place = [], (at, host)
                while stack and not path.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    stack.append((path, rule, chars, verdict))
                elif stack:
                    out.append((url_id, *stack[-1][1:]))
            if out:
                ids, names, chars, verdicts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(chars, pa.int32()), pa.array(verdicts, pa.string())], names=["url_id", "rule", "host_chars", "verdict"])

    hits = dealt.mapInArrow(sweep, "url_id long, rule string, host_chars int, verdict string")
    best = F.max(F.struct(F.length("rule").alias("n"), "host_chars", "rule", "verdict"))
    return hits.groupBy("url_id").agg(best.alias("b")).select("url_id", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """All rows and columns, with ``host``, ``path``, ``rule`` and ``verdict`` (replaced if there)."""
    pages = pages.drop(*({"host", "path", "rule", "verdict"} - {url}))
    parts = cut_lineage(
        pages.select(F.col(url).alias("__url")).filter(F.col("__url").isNotNull()).distinct()
        .select("__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path")))
    # One id for each (host, path); a hash of 64 bits is checked by joining on host and path too.
    distinct = parts.select("host", "path").distinct().withColumn("url_id", F.xxhash64("host", "path"))
    found = match(distinct, rules)
    judged = parts.withColumn("url_id", F.xxhash64("host", "path")).join(found, "url_id", "left").drop("url_id")
    return pages.join(judged, F.col(url) == F.col("__url"), "left").select(
        *[pages[c] for c in pages.columns],
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))


SQL = """
WITH parts AS (
    SELECT page_id,
        CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages
), judged AS (
    SELECT *, CASE
        WHEN ('.' || host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
        WHEN ('.' || host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
        WHEN ('.' || host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
        WHEN ('.' || host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
        WHEN ('.' || host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' END AS rule
    FROM parts
)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


@query("op7_url_rules", SQL)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, longest rule and verdict."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
