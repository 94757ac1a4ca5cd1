"""Secrets in texts: fixed patterns, and strings that look random to character Markov models.

Base kinds are found leftmost and without overlap, each kind by itself.  The method adds ``markov``
spans: long strings whose characters follow each other as in random strings rather than as in
ordinary identifiers, by the log-likelihood ratio of two first-order models.  Both are trained from
labelled samples: random are hexadecimal, base-64 and upper-case digests of numbers, and values
that base patterns found in the sample; ordinary are the other strings of the sampled documents.
The sample is at most about ``SAMPLE_DOCS`` documents, by a hash of the id.  The ratio of a pair of
characters is kept in thousandths, so sums are exact.

Everything is Spark SQL: no Python runs on executors.  Defined results: a null text is empty and has
no span; positions are code points; an end is exclusive; spans of different kinds may overlap, but
a markov span never overlaps a base span.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.registry import query
from timeweave.llm.tables import read

# The base patterns and the least lengths of what they must hold.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

ASSIGN = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in KEYWORDS) + ")" + ASSIGN_TAIL
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STRINGS = "[A-Za-z0-9+/_=-]"
LEAST_MARKOV = 20
LEAST_ORDINARY = 6
LEAST_RATIO = 8_000
SAMPLE_DOCS = 4_000
RANDOM_ROWS = 4_096
MASK = "<secret>"


def find(text: Column, pattern: str, value_group: int, least: int) -> Column:
    """Array of (start, end) of the matches of ``pattern`` whose group has ``least`` characters.

    What lies between matches is what ``split`` leaves, so positions are running lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.arrays_zip(
        whole.alias("m"), value.alias("v"),
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("g"),
    )
    empty = F.lit(None).cast("array<struct<s:int,e:int,ok:boolean>>")
    run = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.coalesce(empty, F.array().cast("array<struct<s:int,e:int,ok:boolean>>")).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["g"])).alias("s"),
                (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("e"),
                (F.length(x["v"]) >= least).alias("ok"),
            ))).alias("out"),
        ),
    )["out"]
    kept = F.transform(F.filter(run, lambda x: x["ok"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Adds ``__assign``, ``__access`` and ``__hex``: arrays of (s, e)."""
    # The least lengths of access keys and hex runs can be put in the pattern: a match takes a whole
    # run of its characters, so a short run has no longer match inside it.
    return df.select(
        "*",
        find(F.col(text), ASSIGN, 2, LEAST["assign"]).alias("__assign"),
        find(F.col(text), ACCESS.replace("+", "{%d,}" % (LEAST["access"] - 4)), 0, LEAST["access"]).alias("__access"),
        find(F.col(text), HEX.replace("+", "{%d,}" % LEAST["hex"]), 0, LEAST["hex"]).alias("__hex"),
    )


@dataclass(frozen=True)
class Ratios:
    """Log-likelihood ratio, in thousandths, of every pair of characters; first the character before."""

    table: tuple[int, ...]

    def column(self) -> Column:
        # One literal that Spark folds; a fixed number of entries.
        return F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<int>")

    def of(self, string: Column) -> Column:
        """The ratio of a whole string of the alphabet."""
        codes = F.transform(F.regexp_extract_all(string, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        width, table = len(ALPHABET), self.column()
        return F.aggregate(
            codes, F.struct(F.lit(-1).alias("before"), F.lit(0).cast("long").alias("sum")),
            lambda acc, c: F.struct(
                c.cast("int").alias("before"),
                (acc["sum"] + F.when(acc["before"] < 0, F.lit(0)).otherwise(F.get(table, acc["before"] * width + c)).cast("long")).alias("sum"),
            ),
        )["sum"]


def pair_counts(strings: DataFrame) -> DataFrame:
    """(label, pair, n) of neighbouring characters of labelled ``string`` rows."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("string") - 1), lambda i: F.substring("string", i, F.lit(2)))
    return strings.filter(F.length("string") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Ratios:
    """Fit both models on labelled strings of a bounded sample of (doc_id, text) rows."""
    total = docs.count()
    share = min(1.0, sample_docs / max(total, 1))
    taken = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(
        F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = base_spans(taken, "text")
    hits = F.concat("__assign", "__access", "__hex")
    values = found.select(F.explode(F.transform(hits, lambda x: F.expr("text").substr(x["s"] + 1, x["e"] - x["s"]))).alias("hit"))
    positive = values.select(F.regexp_extract("hit", f"({STRINGS}+)$", 1).alias("string"), F.lit(1).alias("label"))
    # Ordinary strings: base hits are blanked first.
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX.replace("+", "{%d,}" % LEAST["hex"]), " ")
    negative = taken.select(F.explode(F.regexp_extract_all(plain, F.lit(STRINGS + "{%d,}" % LEAST_ORDINARY), F.lit(0))).alias("string"), F.lit(0).alias("label"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = docs.sparkSession.range(RANDOM_ROWS).select(F.explode(F.array(
        digest, F.base64(F.unhex(digest)), F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 20)),
    )).alias("string"), F.lit(1).alias("label"))
    counts = {(row["label"], row["pair"]): row["n"] for row in pair_counts(positive.unionByName(negative).unionByName(made)).collect()}
    width, table = len(ALPHABET), []
    for a in ALPHABET:
        sums = [sum(counts.get((label, a + b), 0) for b in ALPHABET) for label in (0, 1)]
        for b in ALPHABET:
            of = [(counts.get((label, a + b), 0) + 0.5) / (sums[label] + 0.5 * width) for label in (0, 1)]
            table.append(round(1000 * math.log(of[1] / of[0])))
    return Ratios(tuple(table))


def scan(df: DataFrame, ratios: Ratios, text: str = "text", least_ratio: int = LEAST_RATIO) -> DataFrame:
    """All rows and columns, with ``secret_spans``: (s, k, e) by start and kind, k the place in ``KINDS``.

    An existing column of that name is replaced.
    """
    df = base_spans(df.drop("secret_spans").withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text")
    base = F.concat("__assign", "__access", "__hex")
    long_strings = find(F.col("__text"), STRINGS + "{%d,}" % LEAST_MARKOV, 0, LEAST_MARKOV)
    markov = F.filter(
        long_strings,
        lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        & (ratios.of(F.col("__text").substr(x["s"] + 1, x["e"] - x["s"])) >= least_ratio),
    )
    spans = [of_kind(F.col(f"__{kind}"), k) for k, kind in enumerate(KINDS)]
    return (
        df.withColumn("__markov", markov)
        .withColumn("secret_spans", F.array_sort(F.concat(*spans)))
        .drop("__text", "__assign", "__access", "__hex", "__markov")
    )


def of_kind(spans: Column, k: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def counted(k: int) -> Column:
    return F.size(F.filter("secret_spans", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts with every span of ``secret_spans`` replaced by ``MASK``; touching the rest in nothing."""
    run = F.aggregate(
        F.col("secret_spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            # A span that begins inside the one before only lengthens it.
            F.when(x["s"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.col(text).substr(acc["at"] + 1, x["s"] - acc["at"]), F.lit(MASK))).alias("out"),
        ),
    )
    clean = F.concat(run["out"], F.col(text).substr(run["at"] + 1, F.length(text)))
    return df.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text)))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text: base kinds and those of the Markov models."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs)).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda x: x["k"] < 3)
    return found.select(
        "doc_id",
        *[counted(k) for k in range(3)],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("secret_spans")).alias("spans"),
    )
