"""Search in cues, link targets and resource references."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.functions.text import empty_array, strip


def find_pattern(query: str, regex: bool = False, case: bool = False, whole: bool = False) -> str:
    """The regular expression of a search."""
    body = query if regex else re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", query)
    if whole:
        body = rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"
    return body if case else f"(?iu){body}"


def find_all(rows: DataFrame, pattern: str, keys: list[str]) -> DataFrame:
    """All non-empty matches with code-point offsets.

    Rows without a match are dropped by ``rlike`` before anything is split; offsets are
    running lengths of the text between the matches.
    """
    hits = F.regexp_extract_all(F.col("text"), F.lit(f"({pattern})"), 1)
    gaps = F.split(F.col("text"), pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("g"), F.length(h).alias("n")))
    zero = F.struct(F.lit(0).alias("at"), empty_array("struct<start_char:int,end_char:int,hit:string>").alias("out"))
    spans = F.aggregate(pairs, zero, lambda acc, p: F.struct(
        (acc["at"] + p["g"] + p["n"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + p["g"]).alias("start_char"), (acc["at"] + p["g"] + p["n"]).alias("end_char"),
                                              p["h"].alias("hit")))).alias("out")))["out"]
    return rows.filter(F.col("text").rlike(pattern)).select(*keys, F.explode_outer(spans).alias("m")).filter(F.col("m").isNotNull()).select(*keys, "m.*")


def next_match(matches: DataFrame, anchor: tuple, order: list[str], backwards: bool = False) -> DataFrame:
    """Next (previous) match after the anchor with wrap-around (B6): one ordered top-1."""
    here = F.struct(*[F.col(c) for c in order])
    at = F.struct(*[F.lit(v).alias(c) for c, v in zip(order, anchor)])
    wrapped = (here >= at) if backwards else (here < at)
    pick = F.max_by if backwards else F.min_by
    row = F.struct(*matches.columns)
    best = matches.agg(
        pick(row, F.when(~wrapped, here)).alias("first"), pick(row, here).alias("again"))
    return best.select(F.coalesce("first", "again").alias("r"), F.col("first").isNull().alias("wrapped")).filter(
        "r is not null").select("r.*", "wrapped")


RESOURCE_TAGS = {"link": "href", "img": "src", "source": "src", "audio": "src", "video": "src"}


def html_references(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Local resource references of pages, with an escape warning."""
    found = []
    for tag, attribute in RESOURCE_TAGS.items():
        tags = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)(<{tag}\b[^>]*>)"), 1)
        found.append(F.transform(tags, lambda t, a=attribute: F.regexp_extract(t, rf"(?is)\b{a}\s*=\s*[\"']?([^\"'\s>]+)", 1)))
    css = F.regexp_extract_all(F.col(html), F.lit(r"(?i)(?:url\(\s*|@import\s+)[\"']?([^)'\"\s;]+)"), 1)
    return local_references(pages.select(key, F.explode_outer(F.concat(*found, css)).alias("reference")).filter(F.col("reference").isNotNull()), key)


def markdown_references(texts: DataFrame, key: str) -> DataFrame:
    links = F.regexp_extract_all(F.col("text"), F.lit(r"!?\[[^\]]*\]\(([^)\s]+)(?:\s+['\"][^'\"]*['\"])?\)"), 1)
    return local_references(texts.select(key, F.explode_outer(links).alias("reference")).filter(F.col("reference").isNotNull()), key)


def local_references(references: DataFrame, key: str) -> DataFrame:
    """Without fragments and queries; remote schemes dropped; ``escapes`` when ``..`` leaves the root."""
    clean = F.regexp_replace(F.regexp_replace(F.col("reference"), "^<|>$", ""), r"[#?].*$", "")
    rows = references.withColumn("reference", clean).filter(
        (F.col("reference") != "") & ~F.col("reference").rlike(r"^(data:|http:|https:|//|mailto:)"))
    depth = F.aggregate(F.split("reference", "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda acc, part: F.when(
        part == "..", F.struct((acc["d"] - 1).alias("d"), F.least(acc["low"], acc["d"] - 1).alias("low")),
    ).when(part.isin("", "."), acc).otherwise(F.struct((acc["d"] + 1).alias("d"), acc["low"].alias("low"))))
    return rows.withColumn("escapes", F.col("reference").startswith("/") | (depth["low"] < 0)).distinct().select(key, "reference", "escapes")


def normal_path(path: Column) -> Column:
    """Path without ``.`` and ``..`` steps."""
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, part: F.when(
        part.isin("", "."), acc).when((part == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."),
                                      F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part))))
    return F.array_join(steps, "/")


def link_targets(chapters: DataFrame) -> DataFrame:
    """Keys that lead to exactly one chapter: entry path, ``@basename``, ``#id``.

    ``chapters(chapter_id, entry_path, html)``.
    """
    path = normal_path(F.col("entry_path"))
    ids = F.regexp_extract_all("html", F.lit(r"(?is)<[a-z][^>]*?\sid\s*=\s*[\"']?([^\"'\s>]+)"), 1)
    names = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\sname\s*=\s*[\"']?([^\"'\s>]+)"), 1)
    marks = F.transform(F.concat(ids, names), lambda i: F.concat(F.lit("#"), i))
    keys = F.array_distinct(F.concat(F.array(path, F.concat(F.lit("@"), F.regexp_extract(path, "([^/]*)$", 1))), marks))
    return chapters.select("chapter_id", F.explode(keys).alias("key")).filter("key <> '' and key <> '@'").groupBy("key").agg(
        F.min("chapter_id").alias("target"), F.max("chapter_id").alias("__other")).filter("target = __other").drop("__other")


def resolve_links(chapters: DataFrame, targets: DataFrame) -> DataFrame:
    """Internal links of every chapter with their unique target chapter.

    Fragment first, then resolved path, then base name; each key meets the targets once.
    """
    hrefs = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']?([^\"'\s>]+)"), 1)
    rows = chapters.select("chapter_id", "entry_path", F.explode(F.array_distinct(F.transform(hrefs, strip))).alias("href")).filter(
        (F.col("href") != "") & ~F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//"))
    fragment = F.regexp_extract("href", "#(.*)$", 1)
    raw = F.regexp_extract("href", "^([^#?]*)", 1)
    folder = F.regexp_extract("entry_path", "^(.*)/[^/]*$", 1)
    full = normal_path(F.when(raw.startswith("/"), raw).otherwise(F.concat_ws("/", folder, raw)))
    options = F.array_compact(F.array(
        F.when(fragment != "", F.struct(F.lit(1).alias("rank"), F.concat(F.lit("#"), fragment).alias("key"))),
        F.when(raw != "", F.struct(F.lit(2).alias("rank"), full.alias("key"))),
        F.when(raw != "", F.struct(F.lit(3).alias("rank"), F.concat(F.lit("@"), F.regexp_extract(full, "([^/]*)$", 1)).alias("key")))))
    keyed = rows.select("chapter_id", "href", F.explode(options).alias("o")).select("chapter_id", "href", "o.*")
    return keyed.join(targets, "key").groupBy("chapter_id", "href").agg(F.min_by("target", "rank").alias("target"))
