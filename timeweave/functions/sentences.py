"""Sentence splitting with source offsets, entirely inside one row.

Periods that do not end a sentence are swapped for a same-length placeholder, a cut
mark is put behind every boundary, and the text is split at the marks.  Offsets are
running lengths of the pieces.  No row leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions.text import (
    BLANKS, LETTER, SPACE, empty_array, has_text, is_cjk, let, measure, preferred_split, with_offsets,
)

KEEP = "﷐"  # noncharacters: never part of real text
CUT = "﷑"
# Titles and name prefixes whose period does not end a sentence
# ("miss" has its own rule below), closing marks and opening quotes.
ABBREVIATIONS = (
    "adm", "brig", "capt", "cmdr", "col", "cpl", "det", "dr", "fr", "gen", "gov", "hon", "insp",
    "lt", "maj", "mlle", "mme", "mmes", "mr", "mrs", "ms", "mt", "pres", "prof", "pvt", "rep",
    "rev", "sen", "sgt", "sr", "st", "supt",
)
CLOSERS = "”’」』】》）)\\]}\""
PIECES = "struct<text:string,start_char:bigint,end_char:bigint>"
OPENERS = "‘“「『《〈«‹\""
WORD_LIMIT, CJK_LIMIT = 35, 80


def mark_boundaries(text: Column) -> Column:
    """Insert ``CUT`` behind every sentence end; two passes, each led by its mark."""
    follow = rf"(?=[{SPACE}]*[^{SPACE}])"
    kept = "|".join([
        r"(?<=\p{Nd}\.)(?=\p{Nd})",
        rf"(?<=(?<!\p{{L}})(?i:{'|'.join(ABBREVIATIONS)})\.){follow}",
        rf"(?<=(?<!\p{{L}})(?<!,[{SPACE}]{{0,16}})(?i:miss)\.){follow}",
        rf"(?<=(?<!\p{{L}})[\p{{L}}&&[^I]]\.)(?=[{SPACE}]*\p{{L}})",
        rf"(?<=(?:^|[^\p{{L}}\p{{N}}_])\p{{L}}\.\p{{L}}\.){follow}",
    ])
    text = F.regexp_replace(text, rf"\.(?:{kept})", KEEP)
    ends = rf"[。！？!?…⋯][{CLOSERS}]*+|\.(?=[{SPACE}{OPENERS}]|$)[{CLOSERS}]*+(?=[{SPACE}{OPENERS}]|$)"
    return F.regexp_replace(text, f"({ends})", f"$1{CUT}")


def _strip_span(raw: Column, at: Column) -> Column:
    left = F.ltrim(raw, F.lit(BLANKS))
    body = F.rtrim(left, F.lit(BLANKS))
    start = at + F.length(raw) - F.length(left)
    return F.struct(
        F.replace(body, F.lit(KEEP), F.lit(".")).alias("text"), start.cast("long").alias("start_char"),
        (start + F.length(body)).cast("long").alias("end_char"),
    )


def _pieces(text: Column) -> Column:
    parts = F.transform(
        F.split(mark_boundaries(text), CUT, -1),
        lambda p: F.struct(F.lit("").alias("kind"), p.alias("text")),
    )
    spans = F.transform(with_offsets(parts), lambda p: _strip_span(p["text"], p["source_start_char"]))
    return F.filter(spans, lambda p: p["text"] != "")


def _too_long(text: Column, cjk: Column) -> Column:
    words = rf"^(?:[^{LETTER}]*+[{LETTER}][{LETTER}'’\-]*+){{{WORD_LIMIT + 1}}}"
    return F.when(cjk, measure(text, cjk) > CJK_LIMIT).otherwise(
        (F.length(text) > 2 * WORD_LIMIT) & text.rlike(words)
    )


def _balance(piece: Column, cjk: Column) -> Column:
    """Cut an over-long piece at punctuation near every 35 words or 80 CJK characters."""
    text = piece["text"]
    # The state holds places only: it is copied in every round, so texts are cut out at the end.
    start = F.struct(
        F.lit(0).alias("at"), F.lit(True).alias("open"), empty_array("struct<at:int,n:int>").alias("out"),
    )
    # Up to the end of the word that fills the limit; only evaluated on longer pieces.
    filled = (
        rf"^(?:[^{LETTER}]*+[{LETTER}][{LETTER}'’\-]*+){{{WORD_LIMIT - 1}}}"
        rf"[^{LETTER}]*+[{LETTER}](?:['’\-]*+[{LETTER}])*+"
    )

    def part(at: Column, n: Column) -> Column:
        return F.substring(text, at + 1, n)

    def cut(acc: Column, _: Column) -> Column:
        closed = F.struct(acc["at"].alias("at"), F.lit(False).alias("open"), acc["out"].alias("out"))

        def apply(rest: Column, split: Column) -> Column:
            tail = F.ltrim(F.substring(rest, split + 1, F.length(rest)), F.lit(BLANKS))
            good = (split > 0) & (split < F.length(rest)) & has_text(F.substring(rest, F.lit(1), split))
            return F.when(good, F.struct(
                (acc["at"] + F.length(rest) - F.length(tail)).alias("at"), F.lit(True).alias("open"),
                F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), split.alias("n")))).alias("out"),
            )).otherwise(closed)

        def further(rest: Column) -> Column:
            near = F.when(cjk, F.least(F.length(rest) - 1, F.lit(CJK_LIMIT))).otherwise(
                F.length(F.regexp_extract(rest, filled, 0))
            )
            return F.when(_too_long(rest, cjk), let(
                preferred_split(rest, near, punctuation_only=True), lambda split: apply(rest, split),
            )).otherwise(closed)

        return F.when(acc["open"], let(part(acc["at"], F.length(text)), further)).otherwise(acc)

    rounds = F.sequence(F.lit(1), F.floor(F.length(text) / 16).cast("int") + 1)
    done = F.aggregate(rounds, start, cut)

    def spans(places: Column) -> Column:
        cuts = F.concat(places["out"], F.array(F.struct(places["at"].alias("at"), F.length(text).alias("n"))))
        found = F.transform(cuts, lambda c: _strip_span(part(c["at"], c["n"]), piece["start_char"] + c["at"]))
        return F.filter(found, lambda p: p["text"] != "")

    return F.when(~_too_long(text, cjk), F.array(piece)).otherwise(let(done, spans))


def _glue(pieces: Column) -> Column:
    """Pieces without letters or digits join the piece before them."""
    def joined(found: Column) -> Column:
        def run(first: Column, after: Column) -> Column:
            return F.struct(
                F.array_join(F.transform(F.slice(found, first, after - first), lambda p: p["text"]), "").alias("text"),
                F.get(found, first - 1)["start_char"].alias("start_char"), F.get(found, after - 2)["end_char"].alias("end_char"),
            )

        places = F.filter(F.sequence(F.lit(1), F.size(found)), lambda i: has_text(F.get(found, i - 1)["text"]))
        return let(places, lambda firsts: F.transform(firsts, lambda i, k: run(
            i, F.coalesce(F.get(firsts, k + 1), F.size(found) + 1))))

    return let(pieces, lambda found: F.when(
        F.exists(found, lambda p: ~has_text(p["text"])), joined(found),
    ).otherwise(found))


def split_sentences(text: Column) -> Column:
    """``array<struct<text,start_char,end_char>>`` of one text's sentences."""
    def paragraph(block: Column) -> Column:
        return let(is_cjk(block["text"]), lambda cjk: F.transform(
            F.flatten(F.transform(_pieces(block["text"]), lambda piece: _balance(piece, cjk))),
            lambda s: F.struct(
                s["text"].alias("text"),
                (s["start_char"] + block["source_start_char"]).alias("start_char"),
                (s["end_char"] + block["source_start_char"]).alias("end_char"),
            ),
        ))

    # Blank lines separate paragraphs; the separators keep their length in the offsets.
    marked = F.regexp_replace(text, rf"(\n[{SPACE}]*\n)", f"$1{CUT}")
    blocks = with_offsets(F.transform(
        F.split(marked, CUT, -1), lambda p: F.struct(F.lit("").alias("kind"), p.alias("text")),
    ))
    return _glue(F.flatten(F.transform(blocks, paragraph)))


def chapter_sentences(blocks: Column) -> Column:
    """Sentences of ordered blocks in chapter coordinates.

    ``blocks`` is ``array<struct<kind,text,source_start_char,source_end_char>>``.
    """
    return F.flatten(F.transform(blocks, lambda b, i: F.transform(
        split_sentences(b["text"]), lambda s: F.struct(
            i.cast("long").alias("fragment_position"), s["text"].alias("text"),
            (s["start_char"] + b["source_start_char"]).alias("source_start_char"),
            (s["end_char"] + b["source_start_char"]).alias("source_end_char"),
        ),
    )))
