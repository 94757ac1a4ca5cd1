"""The timeline relations derived from the given tables, in Spark and in SQL.

documents play chapters (one line per authored block), their units the tokens, events the
energy frames, pauses and silences, conversations the ordered cues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.functions.sentences import (
    ABBREVIATIONS, CLOSERS, CUT, KEEP, WORD_LIMIT, chapter_sentences,
)
from timeweave.functions.text import BLANKS, LETTER, match_units
from timeweave.ordered import CHAPTER, SCAN_ROWS, Agg, Seq, block_rows, bounded, finish, number_rows, prepare, scan
from timeweave.session import Cut, cut_by
from timeweave.sources.documents import explode_fragments, explode_segments, line_fragments


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores enough partitions; large scans keep theirs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), "text", "lang"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_fragments(chapters(spark, sf_dir), line_fragments(F.col("text")))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_segments(chapters(spark, sf_dir), line_fragments(F.col("text")))


def cue_seq(spark: SparkSession, sf_dir: str) -> Seq:
    """Cue order of the documents; a cue or unit takes two characters, so lengths bound the rows."""
    return bounded(CHAPTER, table(spark, sf_dir, "documents"), F.length("text") / 2 + 1)


# A bucket of this many characters holds about half a million units.
BUCKET_CHARS = 2_500_000


def by_chapter(spark: SparkSession, sf_dir: str, chars: int = BUCKET_CHARS) -> Cut | None:
    """How tables of cues and units are written: in buckets of chapters; none where a chapter is too large for one task."""
    rows = table(spark, sf_dir, "documents")
    size = rows.agg(F.max(F.length("text")).alias("most"), F.sum(F.length("text")).alias("all")).first()
    if (size["most"] or 0) / 2 + 1 > block_rows(rows, SCAN_ROWS):
        return None
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut_by("chapter_id", max(least, -(-(size["all"] or 0) // chars)))


def dealt_segments(spark: SparkSession, sf_dir: str, cut: Cut) -> DataFrame:
    """Cues for a table that ``cut`` writes: the texts are dealt out before they are split, for they are fewer rows."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chapter_id"), "text").repartition(cut.buckets, "chapter_id")
    return explode_segments(texts, line_fragments(F.col("text")))


def units_of(cues: DataFrame, small: bool = False) -> DataFrame:
    """Units of cues with dense ``at``, and ``heard_at`` among those the recogniser hears; ``small``: no chapter need be measured."""
    words = cues.select("chapter_id", "position", F.posexplode_outer(match_units(F.col("text"))).alias("unit_no", "unit")).filter(F.col("unit_no").isNotNull())
    rows, seq = prepare(words, Seq(order=("position", "unit_no"), prepared=small))
    rows = finish(scan(rows, seq, {"n": Agg("sum", F.lit(1).cast("long")), "h": Agg("sum", heard(F.col("unit")).cast("long"))}))
    return rows.select("chapter_id", (F.col("n") - 1).alias("at"), "position", "unit", F.when(heard(F.col("unit")), F.col("h") - 1).alias("heard_at"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical units ``(chapter_id, at, position, unit)``; dense ``at``, built inside the row."""
    blocks = chapters(spark, sf_dir).select("chapter_id", line_fragments(F.col("text")).alias("blocks"))
    cues = blocks.select("chapter_id", chapter_sentences(F.col("blocks")).alias("cues"))
    per_cue = F.flatten(F.transform(
        "cues", lambda c, i: F.transform(match_units(c["text"]), lambda u: F.struct(i.cast("long").alias("position"), u.alias("unit")))))
    return cues.select("chapter_id", F.posexplode_outer(per_cue).alias("at", "u")).filter(F.col("at").isNotNull()).select(
        "chapter_id", F.col("at").cast("long").alias("at"), "u.position", "u.unit")


def heard(unit: Column) -> Column:
    """The recogniser drops the two-letter words."""
    return F.length(unit) != 2


def tokens(unit_rows: DataFrame) -> DataFrame:
    """Recognised tokens: one per heard unit, 300 ms apart."""
    return unit_rows.filter(heard(F.col("unit"))).select(
        "chapter_id", F.col("at").alias("token_pos"), F.col("unit").alias("text"), (F.col("at") * 300).alias("start_ms"),
        (F.col("at") * 300 + 250).alias("end_ms"), (F.lit(0.5) + F.length("unit") % 5 / 10.0).alias("probability"))


def _cue_columns(df: DataFrame, spacing: int, longest: int, least: int) -> DataFrame:
    n = F.length("text")
    live = n >= least
    confidence = F.least(n / 400.0, F.lit(1.0))
    return df.withColumn("start_ms", F.when(live, F.col("position") * spacing).otherwise(0).cast("long")).withColumn(
        "end_ms", F.when(live, F.col("position") * spacing + F.least(n * 60, F.lit(longest))).otherwise(0).cast("long")
    ).withColumn("confidence", confidence).withColumn("status", F.when(~live, "unmatched").when(
        confidence < 0.58, "low_confidence").otherwise("auto"))


def talk_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as cues: overlapping when long, untimed when short, system turns locked."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chapter_id"), F.col("turn").alias("position"), (F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"),
        "text", (F.col("role") == "system").alias("locked"),
        F.when(F.col("role") == "user", "source").when(F.col("role") == "assistant", "asr").otherwise("subtitle").alias("origin"))
    return _cue_columns(rows, 15_000, 24_000, 80)


def page_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document sentences as cues: 4 s apart, short ones untimed."""
    rows = segments(spark, sf_dir).withColumn("locked", F.lit(False)).withColumn("origin", F.lit("source"))
    return _cue_columns(rows, 4_000, 6_000, 30)


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as low-energy intervals of the chapter with the user's number."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chapter_id"), "event_id", F.bround(F.col("value") * 300).cast("long").alias("time_ms"), (k / 100.0).alias("score"),
        F.col("event_type").alias("kind"), k.alias("k"))
    rows = rows.select("chapter_id", "event_id", "time_ms", "score", "kind", F.greatest(F.lit(0), F.col("time_ms") - F.col("k") * 5).alias("start_ms"),
                       (F.col("time_ms") + F.col("k") * 5).alias("end_ms"))
    return number_rows(rows, Seq(order=("time_ms", "event_id"), by="time_ms"), "position")


# Milliseconds of a time stamp without time zone, whatever the session's zone is.
MILLIS = ("(unix_date(cast(ts as date)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L"
          " + cast(floor(extract(SECOND FROM ts) * 1000) as bigint))")
EVENT_ORDER = Seq(order=("ts", "event_id"), by=MILLIS)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as frame energies in time order."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("chapter_id"), "ts", "event_id", F.col("value").alias("rms"))
    return number_rows(rows, EVENT_ORDER, "frame_no").drop("ts", "event_id")


def spoken_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens with pauses: a minute becomes a millisecond, purchases end sentences."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    minute = F.expr(f"{MILLIS} div 60000")  # towards zero also before 1970, as in SQL
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("chapter_id"), "ts", "event_id",
        F.concat("event_type", F.when(F.col("event_type") == "purchase", ".").otherwise("")).alias("text"),
        minute.alias("start_ms"), (minute + F.floor("value")).alias("end_ms"), (k / 100.0).alias("probability"))
    return number_rows(rows, EVENT_ORDER, "token_pos").drop("ts", "event_id")


# ---------------------------------------------------------------- the same in SQL

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_OPEN = "‘“「『《〈«‹"


def _chain(expression: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expression = f"regexp_replace({expression}, {q(pattern)}, {q(replacement)}, 'g')"
    return expression


def mark_sql(text: str) -> str:
    """Sentence boundary marks without look-around; overlapping contexts run twice."""
    abbreviations = "|".join(ABBREVIATIONS)
    steps = []
    for _ in range(2):
        steps += [
            (r"(\p{Nd})\.(\p{Nd})", rf"\1{KEEP}\2"),
            (rf"(?i)(^|[^\p{{L}}])({abbreviations})\.([{WS}]*[^{WS}])", rf"\1\2{KEEP}\3"),
            (rf"(?i)(^|[^\p{{L}},{WS}]|[^,{WS}][{WS}]+)(miss)\.([{WS}]*[^{WS}])", rf"\1\2{KEEP}\3"),
            (rf"(^|[^\p{{L}}])([A-HJ-Za-z\x{{aa}}-\x{{ff}}\x{{100}}-\x{{24f}}])\.([{WS}]*\p{{L}})", rf"\1\2{KEEP}\3"),
            (rf"((?:^|[^\p{{L}}\p{{N}}_])\p{{L}}[.{KEEP}]\p{{L}})\.([{WS}]*[^{WS}])", rf"\1{KEEP}\2"),
        ]
    steps += [
        (f"([。！？!?…⋯][{CLOSERS}]*)", rf"\1{CUT}"),
        (rf"(\.\"[{CLOSERS}]*)([{WS}{_OPEN}]|$)", rf"\1{CUT}\2"),
        (rf"(\.)([{WS}{_OPEN}]|$)", rf"\1{CUT}\2"),
    ]
    return _chain(text, steps)


_BL = q(BLANKS)
_RUN = rf"[{LETTER}'’\-]"
_WORDS = q(rf"[{LETTER}]{_RUN}*")
# Up to the end of the 35th word: 34 words each closed by a character outside words.
_FILLED = q(rf"^(?:[^{LETTER}]*[{LETTER}]{_RUN}*[^{LETTER}'’\-]){{34}}[^{LETTER}]*[{LETTER}](?:['’\-]*[{LETTER}])*")


def too_long_sql(text: str) -> str:
    return f"(length({text}) > {2 * WORD_LIMIT} AND len(regexp_extract_all({text}, {_WORDS})) > {WORD_LIMIT})"

FRAG = f"""
lines AS (SELECT doc_id AS chapter_id, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
frag AS (SELECT chapter_id, row_number() OVER w - 1 AS position, 'line' AS kind, body AS text,
                (sum(length(body)) OVER w - length(body))::BIGINT AS source_start_char,
                (sum(length(body)) OVER w)::BIGINT AS source_end_char
         FROM (SELECT chapter_id, i, trim(line, {_BL}) AS body FROM lines) WHERE body <> ''
         WINDOW w AS (PARTITION BY chapter_id ORDER BY i))"""

SEG = FRAG + f""",
mk AS (SELECT chapter_id, position AS f, source_start_char AS f0, {mark_sql('text')} AS m FROM frag),
pc AS (SELECT chapter_id, f, f0, unnest(string_split(m, {q(CUT)})) AS raw, unnest(range(len(string_split(m, {q(CUT)})))) AS j FROM mk),
po AS (SELECT *, sum(length(raw)) OVER (PARTITION BY chapter_id, f ORDER BY j) - length(raw) AS off FROM pc),
ps AS (SELECT chapter_id, f, f0, j, replace(trim(raw, {_BL}), {q(KEEP)}, '.') AS text,
              (off + length(raw) - length(ltrim(raw, {_BL})))::BIGINT AS s FROM po WHERE trim(raw, {_BL}) <> ''),
bal AS (
  SELECT chapter_id, f, j, 0 AS k, text AS rest, s AS off, NULL::VARCHAR AS txt, NULL::BIGINT AS s, NULL::BIGINT AS e,
         {too_long_sql('text')} AS going FROM ps
  UNION ALL
  SELECT chapter_id, f, j, k + 1, CASE WHEN ok THEN tail ELSE rest END,
         CASE WHEN ok THEN off + length(rest) - length(tail) ELSE off END,
         CASE WHEN ok THEN ltxt END, CASE WHEN ok THEN off + cut - length(ltrim(substring(rest, 1, cut), {_BL})) END,
         CASE WHEN ok THEN off + cut - length(ltrim(substring(rest, 1, cut), {_BL})) + length(ltxt) END,
         ok AND {too_long_sql('tail')}
  FROM (SELECT *, cut > 0 AND cut < length(rest) AND regexp_matches(ltxt, '[\\p{{L}}\\p{{N}}]') AS ok
        FROM (SELECT *, ltrim(substring(rest, cut + 1), {_BL}) AS tail, trim(substring(rest, 1, cut), {_BL}) AS ltxt
              FROM (SELECT *, coalesce(list_min(list_transform(list_filter(range(lo, hi + 1), lambda i:
                            (substring(rest, i, 1) IN ('，', ',', '、', '；', ';', '：', ':', '。', '！', '？', '!', '?', '…', '⋯', chr(10)))
                            AND regexp_matches(substring(rest, 1, i), '[\\p{{L}}\\p{{N}}]') AND regexp_matches(substring(rest, i + 1), '[\\p{{L}}\\p{{N}}]')),
                          lambda i: (CASE WHEN substring(rest, i, 1) IN ('，', ',', '、', '；', ';', '：', ':') THEN 0 ELSE 1 END) * 1000000000000
                                    + abs(i - near) * 1000000 + i)) % 1000000, 0) AS cut
                    FROM (SELECT *, greatest(1, near - greatest(12, least(48, length(rest) // 3))) AS lo,
                                 least(length(rest) - 1, near + greatest(12, least(48, length(rest) // 3))) AS hi
                          FROM (SELECT *, greatest(1, least(length(rest) - 1, length(regexp_extract(rest, {_FILLED})))) AS near FROM bal WHERE going)))))),
allp AS (SELECT b.chapter_id, b.f, b.j, b.k, b.txt AS text, b.s, b.e FROM bal b WHERE b.txt IS NOT NULL
         UNION ALL
         SELECT chapter_id, f, j, k + 1, trim(rest, {_BL}), off + length(rest) - length(ltrim(rest, {_BL})),
                off + length(rest) - length(ltrim(rest, {_BL})) + length(trim(rest, {_BL})) FROM bal WHERE NOT going AND trim(rest, {_BL}) <> ''),
gl AS (SELECT *, sum(CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 0 END) OVER (PARTITION BY chapter_id, f ORDER BY j, k) AS g FROM allp),
seg AS (SELECT x.chapter_id, row_number() OVER (PARTITION BY x.chapter_id ORDER BY x.f, x.g) - 1 AS position, x.f AS fragment_position, x.text,
               (fr.source_start_char + x.s)::BIGINT AS source_start_char, (fr.source_start_char + x.e)::BIGINT AS source_end_char
        FROM (SELECT chapter_id, f, g, string_agg(text, '' ORDER BY j, k) AS text, min(s) AS s, max(e) AS e FROM gl WHERE g > 0 GROUP BY ALL) x
        JOIN frag fr ON fr.chapter_id = x.chapter_id AND fr.position = x.f)"""

WORD_SQL = q(r"[\p{L}\p{N}]+(?:[’'\-][\p{L}\p{N}]+)*")


def norm_sql(text: str) -> str:
    return f"regexp_replace(replace(lower({text}), 'ß', 'ss'), '[\\p{{P}}\\p{{Z}}\\p{{C}}]', '', 'g')"


UNITS = SEG + f""",
words AS (SELECT chapter_id, position, unnest(regexp_extract_all(text, {WORD_SQL})) AS w,
                 unnest(range(len(regexp_extract_all(text, {WORD_SQL})))) AS unit_no FROM seg),
units AS (SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY position, unit_no) - 1 AS "at", position, {norm_sql('w')} AS unit FROM words)"""

TOKENS = UNITS + """,
tokens AS (SELECT chapter_id, "at" AS token_pos, unit AS text, "at" * 300 AS start_ms, "at" * 300 + 250 AS end_ms,
                  0.5::DOUBLE + (length(unit) % 5)::DOUBLE / 10.0::DOUBLE AS probability FROM units WHERE length(unit) <> 2)"""


def _cue_sql(source: str, spacing: int, longest: int, least: int) -> str:
    return f"""SELECT *, CASE WHEN length(text) < {least} THEN 'unmatched' WHEN confidence < 0.58 THEN 'low_confidence' ELSE 'auto' END AS status
      FROM (SELECT *, (CASE WHEN length(text) >= {least} THEN position * {spacing} ELSE 0 END)::BIGINT AS start_ms,
              (CASE WHEN length(text) >= {least} THEN position * {spacing} + least(length(text) * 60, {longest}) ELSE 0 END)::BIGINT AS end_ms,
              least(length(text) / 400.0, 1.0)::DOUBLE AS confidence FROM ({source}))"""


TALK = f"""
cue AS ({_cue_sql('''SELECT conv_id AS chapter_id, turn AS position, conv_id * 1000 + turn AS segment_id, text, role = 'system' AS locked,
      CASE role WHEN 'user' THEN 'source' WHEN 'assistant' THEN 'asr' ELSE 'subtitle' END AS origin FROM conversations''', 15000, 24000, 80)})"""
PAGE_CUES = SEG + f""",
cue AS ({_cue_sql("SELECT *, false AS locked, 'source' AS origin FROM seg", 4000, 6000, 30)})"""

SIL = """
sil AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY time_ms, event_id) - 1 AS position FROM (
  SELECT user_id AS chapter_id, event_id, round_even(value * 300, 0)::BIGINT AS time_ms, regexp_extract(props, '([0-9]+)', 1)::BIGINT / 100.0 AS score,
         event_type AS kind, greatest(0, round_even(value * 300, 0)::BIGINT - regexp_extract(props, '([0-9]+)', 1)::BIGINT * 5) AS start_ms,
         round_even(value * 300, 0)::BIGINT + regexp_extract(props, '([0-9]+)', 1)::BIGINT * 5 AS end_ms FROM events))"""
FRAMES = """
frames AS (SELECT user_id AS chapter_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, value AS rms FROM events)"""
EVENT_TOKENS = """
tok AS (SELECT user_id AS chapter_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS token_pos,
               event_type || CASE WHEN event_type = 'purchase' THEN '.' ELSE '' END AS text, epoch_ms(ts) // 60000 AS start_ms,
               epoch_ms(ts) // 60000 + floor(value)::BIGINT AS end_ms, regexp_extract(props, '([0-9]+)', 1)::BIGINT / 100.0 AS probability FROM events)"""


def with_sql(*relations: str) -> str:
    """``WITH`` clause from relation texts."""
    return "WITH RECURSIVE " + ",".join(relations)
