"""Text normalisation, units, joining, HTML and naming rules as Column functions."""

from __future__ import annotations

import json
import unicodedata
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes shared by the text rules.
CJK = r"\x{3400}-\x{9fff}\x{3040}-\x{30ff}"
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LETTER = r"\p{L}\p{N}_"
WORD = r"[\p{L}\p{N}]+(?:[’'\-][\p{L}\p{N}]+)*"
NO_SPACE_BEFORE = "，。！？；：、,.!?;:%)]}〉》」』】〗〕’”»…"
NO_SPACE_AFTER = "([{〈《「『【〖〔‘“«¿¡"
PUNCTUATION_PAUSES = "，、；：,.!?。！？…"
CJK_LANGUAGES = ("zh", "yue", "ja", "ko", "chinese", "japanese", "korean", "cantonese")
# Full-width ASCII block U+FF01..U+FF5E and the ideographic space, folded by rule.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
# Latin letters whose canonical decomposition is one base letter, found by rule.
_ACCENTED = "".join(
    chr(c) for c in range(0xC0, 0x250)
    if len(unicodedata.normalize("NFD", chr(c))[0:1]) == 1
    and unicodedata.normalize("NFD", chr(c)) != chr(c)
)
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def escape_class(characters: str) -> str:
    """Characters as the inside of a regular-expression class."""
    return "".join("\\" + c if c in r"\]^-[&" else c for c in characters)


def let(value: Column, build) -> Column:
    """Evaluate ``value`` once inside ``build`` (a local variable for expressions)."""
    return F.element_at(F.transform(F.array(value), build), 1)


def empty_array(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def fold_width(text: Column) -> Column:
    return F.translate(text, _WIDE, _NARROW)


def fold_case(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


# Texts without such characters need no table: ASCII, Latin-1 and Latin Extended-A but for their
# compatibility characters.
_SIMPLE_UPTO = 0x17E
_GATE = "[" + "".join(
    f"\\x{{{c:x}}}" for c in range(0x80, _SIMPLE_UPTO + 1) if unicodedata.normalize("NFKC", chr(c)) != chr(c)
) + f"\\x{{{_SIMPLE_UPTO + 1:x}}}-\\x{{10ffff}}]"
_MARKS = r"\x{300}-\x{36f}\x{3099}\x{309a}"


def _nfkc(c: str) -> str:
    return unicodedata.normalize("NFKC", c)


def _matched(c: str) -> str:
    return _nfkc(_nfkc(c).casefold())


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", _matched(c)) if not unicodedata.combining(x))


@cache
def _table(rule) -> tuple[str, str]:
    """All characters that a rule changes as a regular-expression class, and their images as JSON.

    Hangul syllables, which only fall apart, are left as they are.
    """
    changed = {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if not (0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3) and rule(c) not in (c, c.lower()):
            changed[c] = rule(c)
    codes, ranges = sorted(map(ord, changed)), []
    for code in codes:
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in ranges) + "]", json.dumps(changed)


@cache
def _composed() -> str:
    """Base letters with one mark and the character they make, as JSON."""
    pairs = {}
    for code in range(0xC0, 0x10000):
        apart = unicodedata.normalize("NFD", chr(code))
        if len(apart) == 2 and _nfkc(apart) == chr(code):
            pairs[apart] = chr(code)
    return json.dumps(pairs)


def _through(text: Column, rule) -> Column:
    """``text`` with every character replaced by its image, then letters and marks put together.

    Only the different characters that occur are looked up.
    """
    pattern, table = _table(rule)

    def replaced(value: Column, found: str, images: str) -> Column:
        lookup = F.from_json(F.lit(images), "map<string,string>")
        parts = F.array_distinct(F.regexp_extract_all(value, F.lit(found), F.lit(0)))
        return F.aggregate(parts, value, lambda acc, x: F.replace(acc, x, F.coalesce(F.try_element_at(lookup, x), x)))

    whole = replaced(text, pattern, table)
    return F.when(whole.rlike(f"[{_MARKS}]"), replaced(whole, f"[^{_MARKS}][{_MARKS}]", _composed())).otherwise(whole)


def compatible(text: Column) -> Column:
    """Compatibility normal form of characters and of letters with one mark."""
    return F.when(text.rlike(_GATE), _through(text, _nfkc)).otherwise(text)


def _fold_all(text: Column, rule) -> Column:
    """Lower case has a final sigma; folded case has one sigma."""
    return F.replace(fold_case(_through(text, rule)), F.lit("ς"), F.lit("σ"))


def _simple_match(text: Column) -> Column:
    return F.regexp_replace(fold_case(fold_width(text)), r"[\p{P}\p{Z}\p{C}]", "")


def normalize_for_match(text: Column) -> Column:
    """Compatibility- and case-folded text without punctuation, separators and controls (H1)."""
    full = F.regexp_replace(_fold_all(text, _matched), r"[\p{P}\p{Z}\p{C}]", "")
    return F.when(text.rlike(_GATE), full).otherwise(_simple_match(text))


def normalize_title(text: Column) -> Column:
    """Accent-free, case-folded letters and digits only (H2)."""
    plain = F.translate(fold_case(fold_width(text)), _ACCENTED, _PLAIN)
    full = _fold_all(text, _plain)
    return F.regexp_replace(F.when(text.rlike(_GATE), full).otherwise(plain), r"[^\p{L}\p{N}]", "")


def visible_title(text: Column) -> Column:
    return F.regexp_replace(compatible(text), r"\p{Cf}", "")


def has_text(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")  # H13


def cjk_ratio(text: Column) -> Column:
    kept = F.regexp_replace(text, f"[^{CJK}]", "")
    return F.length(kept) / F.greatest(F.length(text), F.lit(1))


def is_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]") & (cjk_ratio(text) > 0.2)  # H3


def measure(text: Column, cjk: Column) -> Column:
    """Visible characters for CJK text, words otherwise."""
    return F.when(cjk, F.length(F.regexp_replace(text, f"[{SPACE}]", ""))).otherwise(
        F.regexp_count(text, F.lit(rf"[{LETTER}][{LETTER}'’\-]*"))
    )


def match_units(text: Column, character_mode: Column | bool = False) -> Column:
    """Normalised lexical units, or characters in character mode (H4)."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    units = F.when(text.rlike(_GATE), F.transform(found, normalize_for_match)).otherwise(F.transform(found, _simple_match))
    words = F.filter(units, lambda unit: unit != "")
    if character_mode is False:
        return words
    characters = F.filter(F.split(normalize_for_match(text), ""), lambda c: c != "")
    if character_mode is True:
        return characters
    return F.when(character_mode, characters).otherwise(words)


def word_spans(text: Column) -> Column:
    """Units with code-point spans: ``array<struct<unit,start_char,end_char>>`` (H4).

    The text between words is the split of the text at the words, so the spans are
    running lengths of gaps and words.
    """
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    gaps = F.split(text, WORD, -1)
    steps = F.zip_with(words, F.slice(gaps, 1, F.size(words)), lambda w, g: F.struct(
        w.alias("w"), F.length(g).alias("g"), F.length(w).alias("n"),
    ))
    zero = F.struct(
        F.lit(0).alias("at"),
        empty_array("struct<unit:string,start_char:int,end_char:int>").alias("items"),
    )
    spans = F.aggregate(steps, zero, lambda acc, s: F.struct(
        (acc["at"] + s["g"] + s["n"]).alias("at"),
        F.concat(acc["items"], F.array(F.struct(
            normalize_for_match(s["w"]).alias("unit"),
            (acc["at"] + s["g"]).alias("start_char"),
            (acc["at"] + s["g"] + s["n"]).alias("end_char"),
        ))).alias("items"),
    ))["items"]
    return F.filter(spans, lambda s: s["unit"] != "")


def spoken_units(text: Column, language: str = "auto") -> Column:
    """Speaking-length unit count, at least one."""
    if language.casefold() in CJK_LANGUAGES:
        return F.greatest(F.lit(1), F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")))
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(WORD)))


def spoken_duration_ms(text: Column, language: str = "auto", ms_per_unit: Column | None = None) -> Column:
    """Estimated spoken duration."""
    cjk = language.casefold() in CJK_LANGUAGES
    default, low, high = (175.0, 70.0, 500.0) if cjk else (360.0, 140.0, 1000.0)
    rate = F.lit(default)
    if ms_per_unit is not None:
        rate = F.coalesce(F.least(F.lit(high), F.greatest(F.lit(low), ms_per_unit)), F.lit(default))
    marks = F.length(F.regexp_replace(text, f"[^{escape_class(PUNCTUATION_PAUSES)}]", ""))
    estimate = F.bround(spoken_units(text, language) * rate + marks * 70).cast("long")
    return F.greatest(F.lit(900), F.least(F.lit(60_000), estimate)).cast("long")


def join_cue_text(left: Column, right: Column) -> Column:
    """Join two cue texts without gluing words or spacing CJK punctuation."""
    edge = F.concat(F.right(left, F.lit(1)), F.left(right, F.lit(1)))
    glue = (
        edge.rlike(f"^[{SPACE}].|^.[{SPACE}]$|^.[{escape_class(NO_SPACE_BEFORE)}]$|^[{escape_class(NO_SPACE_AFTER)}].$")
        | edge.rlike(f"^[{CJK}]{{2}}$")
    )
    return (
        F.when(F.coalesce(left, F.lit("")) == "", right)
        .when(F.coalesce(right, F.lit("")) == "", left)
        .when(glue, F.concat(left, right))
        .otherwise(F.concat(left, F.lit(" "), right))
    )


def join_cue_texts(texts: Column) -> Column:
    return F.aggregate(texts, F.lit("").cast("string"), join_cue_text)


def needs_word_space(previous: Column, current: Column) -> Column:
    """Whether two tokens need a space between them."""
    han = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{f900}-\x{faff}"
    # Closing and opening marks.
    closing = escape_class(",.!?;:，。！？；：、)]}〉》」』】’”…")
    opening = escape_class("([{〈《「『【‘“")
    edge = F.concat(F.right(previous, F.lit(1)), F.left(current, F.lit(1)))
    blocked = edge.rlike(
        f"^.[{SPACE}]$|^[{SPACE}].$|^.[{closing}]$|^[{opening}].$|[{han}]"
    )
    spaced = edge.rlike(rf"^[\p{{L}}\p{{N}}{closing}][\p{{L}}\p{{N}}]$")
    return (F.length(previous) > 0) & (F.length(current) > 0) & ~blocked & spaced


def uses_cjk_punctuation(text: Column, language: str = "auto") -> Column:
    code = (language or "auto").casefold().split("-")[0]
    if code in {"zh", "zho", "cmn", "yue", "ja", "jpn", "ko", "kor"}:
        return F.lit(True)
    return text.rlike(f"[{CJK}]") if code == "auto" else F.lit(False)


def terminal_mark(text: Column, language: str = "auto") -> Column:
    """Add a sentence end before trailing closers when the text has none."""
    closers = escape_class("”’\"'」』】》）)]}»")
    stripped = F.regexp_replace(text, f"[{SPACE}]+$", "")
    core = F.regexp_replace(F.regexp_replace(stripped, f"[{closers}]+$", ""), f"[{SPACE}]+$", "")
    closing = F.substring(stripped, F.length(core) + 1, F.length(stripped))
    mark = F.when(uses_cjk_punctuation(text, language), F.lit("。")).otherwise(F.lit("."))
    unfinished = (core != "") & ~core.rlike("[.。!?！？…;；]$")
    return F.when(unfinished, F.concat(core, mark, closing)).otherwise(stripped)


def join_token_text(tokens: Column, language: str = "auto", pause_commas: bool = True) -> Column:
    """Join ordered tokens ``array<struct<text,start_ms,end_ms>>`` into one line."""
    texts = F.transform(tokens, lambda t: t["text"])
    sample = F.array_join(texts, "")
    pieces = texts
    if pause_commas:
        comma = F.when(uses_cjk_punctuation(sample, language), F.lit("，")).otherwise(F.lit(","))
        marks = escape_class(",，.!?。！？;；:：…")

        def with_comma(token: Column, i: Column) -> Column:
            after = F.get(tokens, i + 1)
            gap = after["start_ms"] - token["end_ms"]
            body = F.regexp_replace(token["text"], f"[{SPACE}]+$", "")
            tail = F.substring(token["text"], F.length(body) + 1, F.length(token["text"]))
            nxt = F.regexp_replace(after["text"], f"^[{SPACE}]+", "")
            wanted = (
                (gap >= 420) & (gap < 700) & (body != "") & (nxt != "")
                & ~body.rlike(f"[{marks}]$") & ~nxt.rlike(f"^[{marks}]")
            )
            return F.when(F.coalesce(wanted, F.lit(False)), F.concat(body, comma, tail)).otherwise(token["text"])

        pieces = F.transform(tokens, with_comma)
    code = (language or "auto").casefold().split("-")[0]
    spaced = F.exists(pieces, lambda p: p.rlike(f"^[{SPACE}]|[{SPACE}]$"))
    compact = (
        F.lit(True) if code in {"zh", "zho", "cmn", "yue", "ja", "jpn", "ko", "kor"}
        else sample.rlike(f"[{CJK}]") if code == "auto" else F.lit(False)
    )
    before = escape_class(",.!?;:%)]}»”’…")
    after_ = escape_class("([{«“‘¿¡")

    def append(line: Column, piece: Column) -> Column:
        word = strip(piece)
        tight = (
            (line == "") | word.rlike(f"^[{before}]") | line.rlike(f"[{after_}]$")
            | word.rlike("^('s|'re|'ve|'ll|'d|'m|n't)")
        )
        return F.when(word == "", line).when(tight, F.concat(line, word)).otherwise(
            F.concat(line, F.lit(" "), word)
        )

    return F.when(spaced | compact, strip(F.array_join(pieces, ""))).otherwise(
        F.aggregate(pieces, F.lit("").cast("string"), append)
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Whitespace runs become one blank, ends trimmed (H7)."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def editable_text(text: Column) -> Column:
    return collapse(F.replace(compatible(text), F.lit("­"), F.lit("")))  # H26


# What the rules write for these references instead of their usual character.
OWN_REFERENCES = {"nbsp;": " ", "nbsp": " "}
# Stands for a decoded ampersand until the pass is over, so that it begins no reference; a noncharacter.
_AMP = "\ufdd0"


def _image(code: int) -> str:
    """What HTML makes of a numeric reference: Windows-1252 for the upper controls, nothing for what is no text."""
    if code == 0 or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
        return "\ufffd"
    if 0x80 <= code <= 0x9F:
        return bytes([code]).decode("cp1252", "ignore") or chr(code)
    if code == 0x0D:
        return "\r"
    if code < 0x20 and code not in (9, 10, 12) or code == 0x7F or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE:
        return ""
    return chr(code)


@cache
def _references() -> tuple[str, str, str]:
    """Images of named references as JSON, those that need no semicolon as a pattern, numeric images that are not the character itself."""
    names = {name: _AMP if character == "&" else character for name, character in (html5 | OWN_REFERENCES).items()}
    open_ = sorted((name for name in names if not name.endswith(";")), key=lambda name: (-len(name), name))
    planes = [plane << 16 | end for plane in range(17) for end in (0xFFFE, 0xFFFF)]
    numeric = {str(code): _AMP if code == 38 else _image(code) for code in [*range(0xA0), *range(0xFDD0, 0xFDF0), *planes]}
    return json.dumps(names), "&(?:" + "|".join(open_) + ")", json.dumps(numeric)


def _numeric(reference: Column) -> Column:
    """Character of ``&#N;`` or ``&#xN;``, with or without the semicolon."""
    digits = F.regexp_replace(F.regexp_extract(reference, "&#[xX]?([0-9a-fA-F]+)", 1), "^0+(?=.)", "")
    short = F.when(F.length(digits) <= 8, digits).otherwise(F.lit("99999999"))
    code = F.when(reference.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short).cast("long")
    special = F.try_element_at(F.from_json(F.lit(_references()[2]), "map<string,string>"), code.cast("string"))
    real = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.coalesce(special, F.when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd")))


def unescape(text: Column, passes: int = 1, closed: bool = False) -> Column:
    """Character references by the rules of HTML 5, those without a semicolon too; unknown names stay.

    ``closed`` decodes only references that end in a semicolon.
    """
    names_json, open_, _ = _references()
    names = F.from_json(F.lit(names_json), "map<string,string>")

    def replaced(value: Column, pattern: str, character) -> Column:
        def some(v: Column) -> Column:
            found = F.array_distinct(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)))
            # Longer ones first: "&#15" also begins "&#150".
            longest = F.array_sort(F.transform(found, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
            return F.when(v.rlike(pattern), F.aggregate(longest, v, lambda acc, x: F.replace(acc, x["x"], character(x["x"])))).otherwise(v)
        return let(value, some)

    named = lambda x: F.coalesce(F.try_element_at(names, F.substring(x, F.lit(2), F.length(x))), x)
    for _ in range(passes):
        text = replaced(text, "&#(?:[0-9]+|[xX][0-9a-fA-F]+);" + ("" if closed else "?"), _numeric)
        text = replaced(text, "&[A-Za-z][A-Za-z0-9]*;", named)
        text = F.replace(text if closed else replaced(text, open_, named), F.lit(_AMP), F.lit("&"))
    return text


def html_to_text(html: Column, closed: bool = False) -> Column:
    """Visible text of a page: no head/script/style/ruby, block tags become lines (H6); ``closed`` as in ``unescape``."""
    for tag in ("head", "script", "style", "svg", "rt", "rp"):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, r"(?i)</?(?:p|div|h[1-4]|li|br|blockquote)\b[^>]*>", "\n")
    html = F.regexp_replace(html, r"(?s)</?[a-zA-Z!?][^>]*>", "")
    value = unescape(html, passes=2, closed=closed)
    value = F.regexp_replace(value, r"[\t\r\f\x0B ]+", " ")
    value = F.regexp_replace(value, rf"\n[{SPACE}]*\n+", "\n\n")
    return strip(value)


# Fixed value: the block tags that become authored fragments.
BLOCK_PATTERN = "|".join(
    rf"<{tag}\b[^>]*>.*?</{tag}\s*>" for tag in ("p", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")
)


def authored_blocks(html: Column) -> Column:
    """Authored blocks of a page in order: ``array<struct<kind,text>>`` (A10)."""
    clean = html
    for tag in ("script", "style", "svg", "rt", "rp"):
        clean = F.regexp_replace(clean, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    clean = F.regexp_replace(clean, r"(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all(clean, F.lit(f"(?is)({BLOCK_PATTERN})"), 1)

    def read(block: Column) -> Column:
        kind = F.lower(F.regexp_extract(block, r"^<([A-Za-z0-9]+)", 1))
        body = F.regexp_replace(block, r"(?i)<br\b[^>]*>", "\n")
        body = unescape(F.regexp_replace(body, r"(?s)</?[a-zA-Z!?][^>]*>", ""), passes=2)
        body = F.regexp_replace(F.regexp_replace(body, r"[\t\r\f\x0B ]+", " "), r" *\n *", "\n")
        return F.struct(kind.alias("kind"), strip(body).alias("text"))

    return F.filter(F.transform(blocks, read), lambda b: b["text"] != "")


def paragraphs(text: Column) -> Column:
    """Blank-line paragraphs as blocks, the fallback of ``authored_blocks``."""
    parts = F.split(text, rf"\n[{SPACE}]*\n+", -1)
    return F.filter(
        F.transform(parts, lambda p: F.struct(F.lit("paragraph").alias("kind"), strip(p).alias("text"))),
        lambda b: b["text"] != "",
    )


# Numbers in one part of an array that is summed along: ``aggregate`` copies what it has built at every step.
_PART = 256


def running_starts(lengths: Column) -> Column:
    """Sum of the numbers before each one, by parts, so that no long array is built number by number."""
    def along(numbers: Column, start: Column) -> Column:
        zero = F.struct(start.cast("long").alias("at"), empty_array("bigint").alias("out"))
        return F.aggregate(numbers, zero, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def whole(found: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(found)), F.lit(_PART))
        parts = F.transform(firsts, lambda i: F.slice(found, i, F.lit(_PART)))
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda acc, n: acc + n))
        return F.when(F.size(found) <= _PART, along(found, F.lit(0))).otherwise(
            F.flatten(F.zip_with(parts, along(totals, F.lit(0)), along)))

    return let(lengths, whole)


def with_offsets(blocks: Column) -> Column:
    """Running character offsets over blocks with a ``text`` field."""
    def placed(found: Column) -> Column:
        return F.zip_with(found, running_starts(F.transform(found, lambda b: F.length(b["text"]))), lambda b, at: F.struct(
            b["kind"].alias("kind"), b["text"].alias("text"), at.alias("source_start_char"),
            (at + F.length(b["text"])).alias("source_end_char")))

    return let(blocks, placed)


def infer_title(html: Column, text: Column, fallback: Column, closed: bool = False) -> Column:
    """First heading, else document title, else a short first line (H8); ``closed`` as in ``unescape``."""
    heading = html_to_text(F.regexp_extract(html, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1), closed)
    title = strip(unescape(F.regexp_replace(
        F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", "",
    ), closed=closed))
    first = strip(F.regexp_extract(text, rf"(?:^|\n)[{SPACE}]*([^\n]*[^\n{SPACE}])", 1))
    return F.coalesce(
        F.nullif(heading, F.lit("")), F.nullif(title, F.lit("")),
        F.when(F.length(first).between(1, 160), first), fallback,
    )


def display_title(title: Column, html: Column) -> Column:
    """Replace only generated numeric names (H8)."""
    generated = strip(title).rlike(r"^章节\s*[0-9]+$") & (F.coalesce(html, F.lit("")) != "")
    return F.when(generated, infer_title(html, html_to_text(html), title)).otherwise(title)


FURIGANA = r"([\x{3400}-\x{9fff}々〆ヶ]+)\[([\x{3040}-\x{30ff}ー・]+)\]"


def contains_furigana(text: Column) -> Column:
    return text.rlike(FURIGANA)


def furigana_base(text: Column) -> Column:
    return F.regexp_replace(text, FURIGANA, "$1")  # H10, aligned text


def furigana_ruby(text: Column) -> Column:
    return F.regexp_replace(text, FURIGANA, "<ruby>$1<rt>$2</rt></ruby>")  # H10, display


def subtitle_text(raw: Column) -> Column:
    """Cue text without override blocks and styling tags."""
    value = F.regexp_replace(raw, r"\{\\[^}]+\}", "")
    value = F.regexp_replace(value, r"(?i)</?(?:b|i|u|font|ruby|rt|c)(?:\s+[^>]*)?>", "")
    return F.regexp_replace(unescape(value), r"\r\n?", "\n")


def match_projection(text: Column) -> Column:
    """Punctuation-free characters with their raw offsets."""
    raw = F.split(text, "")
    pairs = F.transform(raw, lambda c, i: F.struct(normalize_for_match(c).alias("c"), i.alias("at")))
    return F.filter(pairs, lambda p: p["c"] != "")


def safe_name(text: Column, fallback: str, limit: int = 80) -> Column:
    """File-system-safe name."""
    clean = F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.substring(F.regexp_replace(clean, r"^[ .]+|[ .]+$", ""), 1, limit)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def project_name(text: Column) -> Column:
    """Safe project name; device names are suffixed."""
    # Names the file system reserves.
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
    name = safe_name(text, "book")
    return F.when(name.rlike(reserved), F.concat(name, F.lit("_"))).otherwise(name)


def display_label(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?is)^\s*(chapter\s+\S+)", 1))  # H28


def preferred_split(
    text: Column, approximate: Column, punctuation_only: bool = False, radius: Column | None = None,
) -> Column:
    """Readable split offset nearest to ``approximate``; 0 when there is none."""
    size = F.length(text)

    def choose(b: Column) -> Column:
        window = F.split(F.substring(text, b["low"], b["high"] - b["low"] + 1), "")

        def candidate(before: Column, j: Column) -> Column:
            rule = F.when(F.instr(F.lit("，,、；;：:"), before) > 0, 0).when(
                F.instr(F.lit("。！？!?…⋯\n"), before) > 0, 1,
            )
            if not punctuation_only:
                rule = rule.when(F.instr(F.lit(BLANKS), before) > 0, 2)
            i = (b["low"] + j).cast("int")
            return F.struct(rule.alias("p"), F.abs(i - b["near"]).alias("d"), i.alias("i"))

        found = F.filter(
            F.transform(window, candidate),
            lambda c: c["p"].isNotNull()
            & has_text(F.substring(text, F.lit(1), c["i"]))
            & has_text(F.substring(text, c["i"] + 1, size)),
        )
        return F.coalesce(F.array_min(found)["i"], F.lit(0) if punctuation_only else b["near"])

    def bounds(near: Column) -> Column:
        reach = radius if radius is not None else F.greatest(
            F.lit(12), F.least(F.lit(48), F.floor(size / 3).cast("int")),
        )
        return let(F.struct(
            F.greatest(F.lit(1), near - reach).alias("low"),
            F.least(size - 1, near + reach).alias("high"), near.alias("near"),
        ), choose)

    near = F.greatest(F.lit(1), F.least(size - 1, approximate.cast("int")))
    return F.when(size < 2, F.lit(0)).otherwise(let(near, bounds))
