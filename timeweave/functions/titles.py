"""Chapter titles: body test, numbers, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timeweave.functions.text import fold_case, visible_title

# Titles that are not body text, and English number words by value.
NON_BODY = r"cover|copyright|contents?|table of contents|title page|portada|indice|目录|版权|封面"
UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
         "sixteen seventeen eighteen nineteen").split()
TENS = {20: "twenty", 30: "thirty"}
NUMBER_WORDS = {word: n for n, word in enumerate(UNITS)} | {
    word + (UNITS[u] if u else ""): ten + u for ten, word in TENS.items() for u in range(10)
} | {"forty": 40}


def is_body(title: Column) -> Column:
    """Not a cover, contents or copyright page (B2)."""
    edge = r"[\p{L}\p{N}_]"
    return ~visible_title(title).rlike(rf"(?i)(?<!{edge})({NON_BODY})(?!{edge})")


def _word_value(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in (pair[0], str(pair[1]))])
    return F.get(F.filter(F.array(table[word]), lambda v: v.isNotNull()), F.lit(0))


def _plain(number: Column) -> Column:
    return F.when(number.rlike("^[0-9]+$"), number.cast("decimal(38,0)").cast("string")).otherwise(F.lower(number))


def chapter_number(title: Column) -> Column:
    """Number of a chapter title as text: digits, roman letters, or empty (H9)."""
    visible = visible_title(title)
    compact = F.regexp_replace(fold_case(visible), r"[^\p{L}\p{N}]", "")
    words = "|".join(sorted(NUMBER_WORDS, key=lambda w: (-len(w), w)))
    whole = F.regexp_extract(compact, f"^({words})$", 1)
    suffix = F.regexp_extract(compact, f"^.*?chapter({words})", 1)
    # The first "chapter" decides: its suffix must begin with the word.
    suffix = F.when(F.regexp_extract(compact, "^(.*?)chapter", 0) != "", F.regexp_extract(
        F.regexp_replace(compact, "^.*?chapter", ""), f"^({words})", 1)).otherwise(F.lit(""))
    edge = r"[\p{L}\p{N}_]"
    named = F.regexp_extract(visible, rf"(?iu)(?<!{edge})(?:chapter|cap[ií]tulo|chapitre)\s*([0-9]+|[ivxlcdm]+)(?!{edge})", 1)
    cjk = F.regexp_extract(visible, r"第\s*([0-9]+)\s*章", 1)
    leading = F.regexp_extract(visible, rf"(?i)^\s*([0-9]+|[ivxlcdm]+)(?:(?!{edge})|[._-])", 1)
    return (
        F.when(whole != "", _word_value(whole)).when(suffix != "", _word_value(suffix))
        .when(named != "", _plain(named)).when(cjk != "", _plain(cjk))
        .when(leading != "", _plain(leading)).otherwise(F.lit(""))
    )


def generic_marker_number(title: Column) -> Column:
    """Ordinal of an unlabelled ``Chapter 003`` marker, else null (H9)."""
    found = F.regexp_extract(title, r"(?i)^\s*chapter\s*0*([0-9]+)(?:\s|[-–—:]|$)", 1)
    return F.when(found != "", found.cast("long"))


def similarity(left: Column, right: Column) -> Column:
    """1 − edit distance / longer length; 0 when a side is empty.

    Equal texts are seen first: the distance alone would fill the whole table of a text against itself.
    """
    longer = F.greatest(F.length(left), F.length(right))
    return F.when((left == "") | (right == ""), F.lit(0.0)).when(left == right, F.lit(1.0)).otherwise(1 - F.levenshtein(left, right) / longer)
