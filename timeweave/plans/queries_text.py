"""Queries over document text: fragments, sentences, units and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.plans import relations as r
from timeweave.plans.registry import query


@query("authored_lines", r.with_sql(r.FRAG) + " SELECT chapter_id, position, kind, text, source_start_char, source_end_char FROM frag")
def authored_lines(spark, sf):
    return r.fragments(spark, sf)


@query("sentence_segments", r.with_sql(r.SEG) + " SELECT chapter_id, position, fragment_position, text, source_start_char, source_end_char FROM seg")
def sentence_segments(spark, sf):
    return r.segments(spark, sf)


@query("match_units", r.with_sql(r.UNITS) + ' SELECT chapter_id, "at", position, unit FROM units')
def match_units(spark, sf):
    return r.units(spark, sf)


@query("speaking_estimate", r.with_sql(r.SEG) + f"""
SELECT chapter_id, count(*) AS cues, sum(greatest(1, len(regexp_extract_all(text, {r.WORD_SQL}))))::BIGINT AS spoken_units,
       sum(greatest(900, least(60000, round_even(greatest(1, len(regexp_extract_all(text, {r.WORD_SQL}))) * 360.0
           + 70 * length(regexp_replace(text, '[^，、；：,.!?。！？…]', '', 'g')), 0)::BIGINT)))::BIGINT AS estimated_ms FROM seg GROUP BY chapter_id""")
def speaking_estimate(spark, sf):
    from timeweave.functions.text import spoken_duration_ms, spoken_units

    return r.segments(spark, sf).groupBy("chapter_id").agg(
        F.count(F.lit(1)).alias("cues"), F.sum(spoken_units(F.col("text")).cast("long")).alias("spoken_units"),
        F.sum(spoken_duration_ms(F.col("text"))).alias("estimated_ms"))


@query("text_scalars", r.with_sql(r.SEG) + f"""
SELECT chapter_id, position, {r.norm_sql('text')} AS match_key, regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS has_text,
       len(regexp_extract_all(text, {r._WORDS})) AS words,
       lower(substring(trim(regexp_replace(substring(regexp_replace(text, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), 1), '^[ .]+|[ .]+$', '', 'g')), 1, 80)) AS safe_name,
       CASE WHEN regexp_matches(rtrim(rtrim(rtrim(text, {r._BL}), '”’"''」』】》）)]}}»'), {r._BL}), '[.。!?！？…;；]$') OR rtrim(rtrim(rtrim(text, {r._BL}), '”’"''」』】》）)]}}»'), {r._BL}) = '' THEN rtrim(text, {r._BL})
            ELSE rtrim(rtrim(rtrim(text, {r._BL}), '”’"''」』】》）)]}}»'), {r._BL}) || '.' || substring(rtrim(text, {r._BL}), 1 + length(rtrim(rtrim(rtrim(text, {r._BL}), '”’"''」』】》）)]}}»'), {r._BL}))) END AS terminal
FROM seg""")
def text_scalars(spark, sf):
    from timeweave.functions import text as t

    c = F.col("text")
    return r.segments(spark, sf).select(
        "chapter_id", "position", t.normalize_for_match(c).alias("match_key"), t.has_text(c).alias("has_text"),
        t.measure(c, F.lit(False)).alias("words"), F.lower(t.safe_name(c, "")).alias("safe_name"), t.terminal_mark(c).alias("terminal"))


@query("clock_text", """
SELECT l_orderkey, l_linenumber, ms, stamp, replace(stamp, '.', ',') AS srt, ms AS parsed_srt, ms AS parsed_display
FROM (SELECT l_orderkey, l_linenumber, ms, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' ||
             lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') AS stamp
      FROM (SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 1000, 0)::BIGINT AS ms FROM lineitem))""")
def clock_text(spark, sf):
    from timeweave.functions import timecode as c

    ms = F.bround(F.col("l_extendedprice") * 1000).cast("long")
    rows = r.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ms.alias("ms"))
    rows = rows.withColumn("stamp", c.format_time(F.col("ms"))).withColumn("srt", c.format_srt_time(F.col("ms")))
    return rows.withColumn("parsed_srt", c.parse_srt_time(F.col("srt"))).withColumn("parsed_display", c.parse_display_time(F.col("stamp")))


@query("cue_search", r.with_sql(r.SEG) + """,
m AS (SELECT chapter_id, position, text, unnest(regexp_extract_all(text, '(?i)tion[,.]')) AS hit, unnest(range(len(regexp_extract_all(text, '(?i)tion[,.]')))) AS i FROM seg),
g AS (SELECT chapter_id, position, unnest(regexp_split_to_array(text, '(?i)tion[,.]')) AS gap, unnest(range(len(regexp_split_to_array(text, '(?i)tion[,.]')))) AS i FROM seg),
j AS (SELECT m.chapter_id, m.position, m.i, m.hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY m.chapter_id, m.position ORDER BY m.i))::BIGINT AS end_char
      FROM m JOIN g ON g.chapter_id = m.chapter_id AND g.position = m.position AND g.i = m.i)
SELECT chapter_id, position, end_char - length(hit) AS start_char, end_char, hit FROM j""")
def cue_search(spark, sf):
    from timeweave.operators.search import find_all, find_pattern

    return find_all(r.segments(spark, sf), find_pattern("tion[,.]", regex=True), ["chapter_id", "position"])


@query("cue_search_next", r.with_sql(r.SEG) + """
SELECT chapter_id, position, (instr(text, 'the') - 1)::BIGINT AS start_char, (instr(text, 'the') + 2)::BIGINT AS end_char, 'the' AS hit, false AS wrapped FROM seg
WHERE contains(text, 'the') AND (chapter_id, position) >= (100, 2) ORDER BY chapter_id, position LIMIT 1""")
def cue_search_next(spark, sf):
    from timeweave.operators.search import find_all, find_pattern, next_match

    found = find_all(r.segments(spark, sf), find_pattern("the", case=True), ["chapter_id", "position"])
    return next_match(found, (100, 2, 0), ["chapter_id", "position", "start_char"])


@query("text_lengths", "SELECT doc_id AS chapter_id, length(text) AS chars, len(string_split(text, chr(10))) AS n_lines FROM documents")
def text_lengths(spark, sf):
    return r.table(spark, sf, "documents").select(F.col("doc_id").alias("chapter_id"), F.length("text").alias("chars"), F.size(F.split("text", "\n", -1)).alias("n_lines"))


@query("fused_units", r.with_sql(r.UNITS) + """,
l AS (SELECT chapter_id, "at", unit AS u0, lead(unit, 1) OVER w AS u1, lead(unit, 2) OVER w AS u2, lead(unit, 3) OVER w AS u3, lead(unit, 4) OVER w AS u4, lead(unit, 5) OVER w AS u5
      FROM units WINDOW w AS (PARTITION BY chapter_id, position ORDER BY "at")),
o AS (SELECT chapter_id, "at", 2 AS n, u0 || u1 AS fused, u0 || ' ' || u1 AS parts FROM l WHERE u1 IS NOT NULL
      UNION ALL SELECT chapter_id, "at", 3, u0 || u1 || u2, concat_ws(' ', u0, u1, u2) FROM l WHERE u2 IS NOT NULL
      UNION ALL SELECT chapter_id, "at", 4, u0 || u1 || u2 || u3, concat_ws(' ', u0, u1, u2, u3) FROM l WHERE u3 IS NOT NULL
      UNION ALL SELECT chapter_id, "at", 5, u0 || u1 || u2 || u3 || u4, concat_ws(' ', u0, u1, u2, u3, u4) FROM l WHERE u4 IS NOT NULL
      UNION ALL SELECT chapter_id, "at", 6, u0 || u1 || u2 || u3 || u4 || u5, concat_ws(' ', u0, u1, u2, u3, u4, u5) FROM l WHERE u5 IS NOT NULL)
SELECT chapter_id, fused, arg_min(parts, "at" * 10 + n) AS parts FROM o ANTI JOIN units u ON u.chapter_id = o.chapter_id AND u.unit = o.fused GROUP BY chapter_id, fused""")
def fused_units(spark, sf):
    from timeweave.operators.matching import fused_splits

    # A unit begins up to five words, so tasks are half as large as elsewhere.
    cut = r.by_chapter(spark, sf, r.BUCKET_CHARS // 2)
    units = r.units(spark, sf) if cut is None else cut(
        r.units_of(r.dealt_segments(spark, sf, cut), True).select("chapter_id", "at", "position", "unit"))
    return fused_splits(units).withColumn("parts", F.array_join("parts", " "))
