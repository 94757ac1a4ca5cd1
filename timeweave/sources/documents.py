"""Text, Markdown, HTML and page sources as chapters and fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from timeweave.functions.sentences import CUT, chapter_sentences
from timeweave.functions.text import (
    authored_blocks, empty_array, fold_case, html_to_text, infer_title, let, paragraphs, strip, unescape, with_offsets,
)
from timeweave.ordered import Seq, number_rows

# Decoding order for texts that are not UTF-8.
LEGACY = ("utf-16", "gb18030", "shift_jis", "cp1252")


@F.pandas_udf(StringType())
def _legacy_text(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Strict cascade of legacy charsets; UTF-8 rows arrive as null."""
    def read(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for charset in LEGACY:
            try:
                return bytes(raw).decode(charset)
            except UnicodeDecodeError:
                continue
        return bytes(raw).decode("utf-8", errors="replace")

    for batch in content:
        yield batch.map(read)


@F.pandas_udf(StringType())
def _declared_text(content: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    """Decode with the declared charset; null when unknown or wrong."""
    def read(raw: bytes | None, charset: str | None) -> str | None:
        if raw is None or not charset:
            return None
        try:
            return bytes(raw).decode(charset)
        except (LookupError, UnicodeDecodeError):
            return None

    for raw, charset in content:
        yield pd.Series([read(r, c) for r, c in zip(raw, charset)])


def decode_text(content: Column) -> Column:
    """UTF-8 inside the JVM; only failing rows pay for the legacy cascade (A1)."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    return F.when(valid, F.regexp_replace(text, "^﻿", "")).otherwise(_legacy_text(F.when(~valid, content)))


def declared_charset(content: Column) -> Column:
    """Charset named in the first 4096 bytes, Latin-1 aliases as cp1252 (A2)."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    name = F.lower(F.regexp_extract(head, r"(?i)(?:charset\s*=\s*['\"]?\s*|encoding\s*=\s*['\"])([a-zA-Z0-9._-]+)", 1))
    return F.when(name.isin("iso-8859-1", "iso8859-1", "latin-1", "latin1"), F.lit("cp1252")).otherwise(F.nullif(name, F.lit("")))


def decode_html(content: Column) -> Column:
    """Declared charset first, then the text cascade (A2)."""
    charset = declared_charset(content)
    native = charset.isNull() | charset.isin("utf-8", "utf8")
    foreign = F.when(~native, content)
    return F.coalesce(_declared_text(foreign, charset), decode_text(content))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Raw files with their base name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", "content")


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(.)\.[^.]*$", "$1")


def text_chapters(files: DataFrame) -> DataFrame:
    """One chapter per text file (A1)."""
    text = strip(F.regexp_replace(decode_text(F.col("content")), "\r\n", "\n"))
    return files.select("path", stem(F.col("name")).alias("title"), text.alias("text"), F.lit("txt").alias("source_kind"))


def markdown_sections(text: Column, fallback: Column) -> Column:
    """``array<struct<title,text>>`` split at level-one headings outside fences (A3)."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    zero = F.struct(F.lit(False).alias("fenced"), F.lit(0).alias("n"), empty_array("string").alias("out"))

    def mark(acc: Column, line: Column) -> Column:
        fenced = acc["fenced"] != F.regexp_replace(line, r"^\s+", "").rlike("^(```|~~~)")
        heading = ~fenced & line.rlike(r"^#\s+\S")
        return let(F.struct(fenced.alias("f"), heading.alias("h")), lambda s: F.struct(
            s["f"].alias("fenced"), (acc["n"] + s["h"].cast("int")).alias("n"),
            F.concat(acc["out"], F.array(F.when(s["h"], F.concat(F.lit(CUT), line)).otherwise(line))).alias("out")))

    def sections(marked: Column) -> Column:
        parts = F.split(F.array_join(marked["out"], "\n"), CUT, -1)
        built = F.transform(parts, lambda p, i: F.struct(
            F.when(i == 0, fallback).otherwise(F.coalesce(F.nullif(strip(F.regexp_replace(strip(F.regexp_replace(
                F.regexp_extract(p, r"^([^\n]*)", 1), r"^#\s+", "")), "#+$", "")), F.lit("")), F.concat(F.lit("章节 "), i.cast("string")))).alias("title"),
            strip(p).alias("text")))
        return F.when(marked["n"] == 0, built).otherwise(F.filter(built, lambda s, i: (i > 0) | (s["text"] != "")))

    return let(F.aggregate(lines, zero, mark), sections)


def markdown_chapters(files: DataFrame, one_chapter: bool = False) -> DataFrame:
    """Markdown sections as chapters, or one chapter per file (A3, A5)."""
    rows = files.select("path", stem(F.col("name")).alias("stem"), decode_text(F.col("content")).alias("md"))
    whole = F.array(F.struct(F.col("stem").alias("title"), strip(F.col("md")).alias("text")))
    parts = whole if one_chapter else markdown_sections(F.col("md"), F.col("stem"))
    return rows.select("path", F.posexplode_outer(parts).alias("section", "s")).filter(F.col("section").isNotNull()).select(
        "path", "section", F.col("s.title").alias("title"), F.col("s.text").alias("text"), F.lit("markdown").alias("source_kind")).filter("text <> ''")


def html_sections(html: Column, fallback: Column) -> Column:
    """``array<struct<title,html,text>>``: articles, else runs of ``<h1>``, else the body (A4)."""
    clean = F.regexp_replace(html, r"(?is)<(?:script|noscript)\b[^>]*>.*?</(?:script|noscript)\s*>", "")

    def build(page: Column) -> Column:
        articles = F.regexp_extract_all(page, F.lit(r"(?is)(<article\b[^>]*>.*?</article\s*>)"), 1)
        body = F.regexp_replace(F.regexp_replace(page, r"(?is)^.*?<body\b[^>]*>", ""), r"(?is)</body\s*>.*$", "")
        runs = F.filter(F.split(F.regexp_replace(body, r"(?i)(<h1\b)", f"{CUT}$1"), CUT, -1), lambda p: strip(p) != "")
        nodes = F.when(F.size(articles) > 0, articles).otherwise(runs)
        title = strip(unescape(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)))

        def section(node: Column, i: Column) -> Column:
            def head(pattern: str) -> Column:
                return F.nullif(strip(html_to_text(F.regexp_extract(node, pattern, 1))), F.lit(""))
            return F.struct(F.coalesce(head(r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"), head(r"(?is)<h[23]\b[^>]*>(.*?)</h[23]\s*>"),
                                       F.when(i == 0, F.nullif(title, F.lit(""))),
                                       F.when(F.size(nodes) == 1, fallback).otherwise(F.concat(F.lit("章节 "), (i + 1).cast("string")))).alias("title"),
                            node.alias("html"), html_to_text(node).alias("text"))

        return F.filter(F.transform(nodes, section), lambda s: s["text"] != "")

    return let(clean, build)


def html_chapters(pages: DataFrame, key: str, html: str = "html", fallback: Column | None = None, one_chapter: bool = False,
                  closed: bool = False) -> DataFrame:
    """HTML sections as chapters, or the whole page as one (A4, A5); ``closed``, for whole pages, as in ``unescape``."""
    default = fallback if fallback is not None else F.col(key).cast("string")
    if one_chapter:
        title = strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), closed=closed))
        rows = pages.select(key, F.lit(0).alias("section"), F.coalesce(F.nullif(title, F.lit("")), default).alias("title"),
                            F.col(html).alias("html"), html_to_text(F.col(html), closed).alias("text"))
    else:
        rows = pages.select(key, F.posexplode_outer(html_sections(F.col(html), default)).alias("section", "s")).filter(F.col("section").isNotNull()).select(key, "section", "s.*")
    return rows.filter("text <> ''").withColumn("source_kind", F.lit("html"))


def spine_chapters(pages: DataFrame) -> DataFrame:
    """Spine pages in order without empty pages and covers, titled.

    ``pages(book_id, spine_pos, html)``.
    """
    text = html_to_text(F.col("html"))
    blocks = authored_blocks(F.col("html"))
    rows = pages.withColumn("text", text).filter((F.col("text") != "") & (fold_case(F.col("text")) != "cover")).withColumn(
        "title", infer_title(F.col("html"), F.col("text"), F.concat(F.lit("章节 "), (F.col("spine_pos") + 1).cast("string")))).withColumn(
        "__b", blocks).withColumn("n_fragments", F.size("__b")).withColumn("headings_only", F.forall("__b", lambda b: b["kind"].startswith("h"))).drop("__b")
    return number_rows(rows, Seq(("book_id",), ("spine_pos",)), "position")


def page_fragments(html: Column, text: Column) -> Column:
    """Authored blocks with offsets, blank-line paragraphs when there are none (A10)."""
    return let(authored_blocks(html), lambda b: with_offsets(F.when(F.size(b) > 0, b).otherwise(paragraphs(text))))


def line_fragments(text: Column) -> Column:
    """Non-blank lines with offsets, for texts that break at every paragraph."""
    return with_offsets(F.filter(F.transform(F.split(text, "\n", -1), lambda p: F.struct(
        F.lit("line").alias("kind"), strip(p).alias("text"))), lambda b: b["text"] != ""))


def explode_fragments(chapters: DataFrame, fragments: Column, key: str = "chapter_id") -> DataFrame:
    return chapters.select(key, F.posexplode_outer(fragments).alias("position", "f")).filter(F.col("position").isNotNull()).select(
        key, F.col("position").cast("long").alias("position"), "f.kind", "f.text", "f.source_start_char", "f.source_end_char")


def explode_segments(chapters: DataFrame, fragments: Column, key: str = "chapter_id") -> DataFrame:
    """Sentences of the fragments as segments, without any shuffle."""
    # Two steps, for the analyzer's rounds grow with nested functions.
    blocks = chapters.select(key, fragments.alias("__blocks"))
    return blocks.select(key, F.posexplode_outer(chapter_sentences(F.col("__blocks"))).alias("position", "s")).filter(F.col("position").isNotNull()).select(
        key, F.col("position").cast("long").alias("position"), "s.*")


def append_chapters(existing: DataFrame, incoming: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Imported chapters numbered after the existing ones of their book."""
    last = existing.groupBy("book_id").agg((F.max("position") + 1).alias("__from"))
    fresh = number_rows(incoming.drop("position"), Seq(("book_id",), order, by="0"), "__n").join(last, "book_id", "left").withColumn(
        "position", F.coalesce("__from", F.lit(0)) + F.col("__n")).drop("__from", "__n")
    return existing.unionByName(fresh, allowMissingColumns=True)
