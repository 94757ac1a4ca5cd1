"""Queries over ordered cues: neighbours, allocation, edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave import schema
from timeweave.operators import timeline as t
from timeweave.plans import relations as r
from timeweave.plans.registry import query

TALK = r.with_sql(r.TALK)
PAGES = r.with_sql(r.PAGE_CUES)
COLS = "chapter_id, position, start_ms, end_ms, status"
NEAR = """,
near AS (SELECT *, last_value(CASE WHEN end_ms > start_ms THEN end_ms END IGNORE NULLS) OVER p AS b_end,
                   last_value(CASE WHEN end_ms > start_ms THEN start_ms END IGNORE NULLS) OVER p AS b_start,
                   last_value(CASE WHEN end_ms > start_ms THEN locked END IGNORE NULLS) OVER p AS b_locked,
                   last_value(CASE WHEN end_ms > start_ms THEN position END IGNORE NULLS) OVER p AS b_pos,
                   first_value(CASE WHEN end_ms > start_ms THEN start_ms END IGNORE NULLS) OVER f AS a_start,
                   first_value(CASE WHEN end_ms > start_ms THEN end_ms END IGNORE NULLS) OVER f AS a_end,
                   first_value(CASE WHEN end_ms > start_ms THEN locked END IGNORE NULLS) OVER f AS a_locked,
                   first_value(CASE WHEN end_ms > start_ms THEN position END IGNORE NULLS) OVER f AS a_pos
         FROM cue WINDOW p AS (PARTITION BY chapter_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                         f AS (PARTITION BY chapter_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""
CONFLICT = "(end_ms > start_ms AND (coalesce(b_end > start_ms, false) OR coalesce(end_ms > a_start, false)))"


@query("timed_cues", TALK + " SELECT chapter_id, position, start_ms, end_ms FROM cue WHERE end_ms > start_ms")
def timed_cues(spark, sf):
    return r.talk_cues(spark, sf).filter(t.timed()).select("chapter_id", "position", "start_ms", "end_ms")


@query("cue_conflicts", PAGES + NEAR + f" SELECT chapter_id, position, {CONFLICT} AS conflict FROM near")
def cue_conflicts(spark, sf):
    return t.flag_conflicts(r.page_cues(spark, sf), r.cue_seq(spark, sf)).select("chapter_id", "position", "conflict")


@query("review_classes", TALK + NEAR + f""" SELECT chapter_id, position, CASE WHEN {CONFLICT} THEN 'conflict' WHEN status = 'low_confidence' THEN 'low_confidence'
 WHEN status = 'unmatched' THEN 'unmatched' WHEN locked THEN 'locked' END AS review FROM near""")
def review_classes(spark, sf):
    rows = t.flag_conflicts(r.talk_cues(spark, sf))
    return rows.select("chapter_id", "position", t.review_class(F.col("conflict")).alias("review"))


@query("review_intervals", TALK + """ SELECT chapter_id, position, start_ms, greatest(start_ms + 40, end_ms) AS end_ms FROM cue WHERE status IN ('low_confidence', 'unmatched')""")
def review_intervals(spark, sf):
    return t.review_intervals(r.talk_cues(spark, sf)).select("chapter_id", "position", "start_ms", "end_ms")


MONO = """ SELECT chapter_id, position, s AS start_ms, greatest(s, end_ms) AS end_ms FROM (
  SELECT *, greatest(start_ms, coalesce(max(greatest(start_ms, end_ms)) OVER (PARTITION BY chapter_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM cue)"""


@query("monotonic_cues", PAGES + MONO)
def monotonic_cues(spark, sf):
    return t.enforce_monotonic(r.page_cues(spark, sf), r.cue_seq(spark, sf)).select("chapter_id", "position", "start_ms", "end_ms")


@query("gap_fill", PAGES + f""",
m AS (SELECT *, end_ms > start_ms AS ok, greatest(1, len(regexp_extract_all(text, {r.WORD_SQL}))) AS w FROM cue),
i AS (SELECT *, sum(ok::INT) OVER p AS run, last_value(CASE WHEN ok THEN end_ms END IGNORE NULLS) OVER b AS lo, first_value(CASE WHEN ok THEN start_ms END IGNORE NULLS) OVER f AS hi
      FROM m WINDOW p AS (PARTITION BY chapter_id ORDER BY position), b AS (PARTITION BY chapter_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    f AS (PARTITION BY chapter_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
u AS (SELECT *, row_number() OVER o AS n, count(*) OVER g AS rows_, sum(w) OVER g AS total, sum(w) OVER o AS cum, bool_or(locked) OVER g AS any_locked
      FROM i WHERE NOT ok WINDOW o AS (PARTITION BY chapter_id, run ORDER BY position), g AS (PARTITION BY chapter_id, run)),
v AS (SELECT *, least(hi - (rows_ - n), CASE WHEN n = rows_ THEN hi ELSE lo + round_even((hi - lo) * cum / total, 0)::BIGINT END) - n AS mm FROM u
      WHERE lo IS NOT NULL AND hi IS NOT NULL AND NOT any_locked AND hi - lo >= rows_),
x AS (SELECT *, n + greatest(lo, max(mm) OVER (PARTITION BY chapter_id, run ORDER BY position)) AS e FROM v),
y AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY chapter_id, run ORDER BY position), lo) AS s FROM x)
SELECT i.chapter_id, i.position, coalesce(y.s, i.start_ms) AS start_ms, coalesce(y.e, i.end_ms) AS end_ms, CASE WHEN y.e IS NULL THEN i.status ELSE 'manual' END AS status, y.e IS NOT NULL AS filled
FROM i LEFT JOIN y ON y.chapter_id = i.chapter_id AND y.position = i.position""")
def gap_fill(spark, sf):
    return t.fill_gaps(r.page_cues(spark, sf), seq=r.cue_seq(spark, sf)).select("chapter_id", "position", "start_ms", "end_ms", "status", "filled")


def _distribute_sql(weight: str) -> str:
    return TALK + f""",
w AS (SELECT *, {weight} AS w FROM cue),
s AS (SELECT *, round_even(100000 * w / sum(w) OVER (PARTITION BY chapter_id), 0)::BIGINT AS share FROM w),
c AS (SELECT *, sum(share) OVER (PARTITION BY chapter_id ORDER BY position) - share AS b, position = max(position) OVER (PARTITION BY chapter_id) AS last FROM s)
SELECT chapter_id, position, CASE WHEN locked THEN start_ms ELSE 1000 + b END AS start_ms, CASE WHEN locked THEN end_ms WHEN last THEN 101000 ELSE 1000 + b + share END AS end_ms,
       CASE WHEN locked THEN status ELSE 'manual' END AS status FROM c"""


@query("distribute_equal", _distribute_sql("1"))
def distribute_equal(spark, sf):
    return t.distribute(r.talk_cues(spark, sf), F.lit(1000).cast("long"), F.lit(101_000).cast("long")).select(*COLS.split(", "))


@query("distribute_proportional", _distribute_sql("greatest(1, end_ms - start_ms)"))
def distribute_proportional(spark, sf):
    return t.distribute(r.talk_cues(spark, sf), F.lit(1000).cast("long"), F.lit(101_000).cast("long"), True).select(*COLS.split(", "))


@query("order_item_allocation", """
WITH s AS (SELECT l_orderkey, l_linenumber, round_even(60000 * w / sum(w) OVER (PARTITION BY l_orderkey), 0)::BIGINT AS share, l_extendedprice, l_partkey FROM (SELECT *, greatest(1, l_quantity::BIGINT) AS w FROM lineitem)),
c AS (SELECT *, sum(share) OVER o - share AS b, row_number() OVER o = count(*) OVER (PARTITION BY l_orderkey) AS last FROM s WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey AS chapter_id, count(*) AS items, max(CASE WHEN last THEN 60000 ELSE b + share END)::BIGINT AS last_end, sum(b)::BIGINT AS starts FROM c GROUP BY l_orderkey""")
def order_item_allocation(spark, sf):
    """Order lines share one minute by quantity."""
    rows = r.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").cast("long").alias("position"), F.lit(0).cast("long").alias("start_ms"),
        F.greatest(F.lit(1), F.col("l_quantity").cast("long")).alias("end_ms"), F.lit(False).alias("locked"), F.lit("auto").alias("status"),
        "l_extendedprice", "l_partkey")
    seq = t.Seq(("chapter_id",), ("position", "l_extendedprice", "l_partkey"))
    return t.distribute(rows, F.lit(0).cast("long"), F.lit(60_000).cast("long"), True, seq).groupBy("chapter_id").agg(
        F.count(F.lit(1)).alias("items"), F.max("end_ms").alias("last_end"), F.sum("start_ms").alias("starts"))


@query("dense_positions", TALK + " SELECT chapter_id, segment_id, row_number() OVER (PARTITION BY chapter_id ORDER BY position) - 1 AS position FROM cue WHERE NOT locked")
def dense_positions(spark, sf):
    return t.renumber(r.talk_cues(spark, sf).filter("not locked")).select("chapter_id", "segment_id", "position")


@query("running_text_offsets", PAGES + """ SELECT chapter_id, position, (sum(length(text)) OVER w - length(text))::BIGINT AS start_char, (sum(length(text)) OVER w)::BIGINT AS end_char
 FROM cue WINDOW w AS (PARTITION BY chapter_id ORDER BY position)""")
def running_text_offsets(spark, sf):
    return t.text_offsets(r.page_cues(spark, sf), r.cue_seq(spark, sf)).select("chapter_id", "position", "start_char", "end_char")


@query("timing_anchors", TALK + """ SELECT * FROM (SELECT chapter_id, position, (sum(length(text)) OVER w - length(text))::BIGINT AS source_start_char, (sum(length(text)) OVER w)::BIGINT AS source_end_char,
 start_ms, end_ms, confidence, 'silence-length-estimate' AS method FROM cue WINDOW w AS (PARTITION BY chapter_id ORDER BY position)) WHERE end_ms > start_ms""")
def timing_anchors(spark, sf):
    return t.timing_anchors(r.talk_cues(spark, sf))


@query("extended_ends", PAGES + """ SELECT chapter_id, position, start_ms, CASE WHEN ne > ns AND ns - end_ms BETWEEN 1 AND 500 THEN ns ELSE end_ms END AS end_ms
 FROM (SELECT *, lead(start_ms) OVER w AS ns, lead(end_ms) OVER w AS ne FROM cue WINDOW w AS (PARTITION BY chapter_id ORDER BY position)) WHERE end_ms > start_ms""")
def extended_ends(spark, sf):
    return t.extend_ends(r.page_cues(spark, sf), 500, r.cue_seq(spark, sf)).select("chapter_id", "position", "start_ms", "end_ms")


# One boundary edit per conversation: the end of its second turn moves far right.
EDIT = ", edit AS (SELECT chapter_id, 1 AS position, 'end' AS kind, 55000 AS at_ms FROM (SELECT DISTINCT chapter_id FROM cue))"


def _edits(spark, sf):
    return r.talk_cues(spark, sf).select("chapter_id").distinct().select(
        "chapter_id", F.lit(1).cast("long").alias("position"), F.lit("end").alias("kind"), F.lit(55_000).cast("long").alias("at_ms"))


def _move_sql(policy: str) -> str:
    trim = "NOT a_locked AND a_end - 100 >= e" if policy == "trim_neighbors" else "false"
    clamp = "false" if policy == "allow_overlap" else f"NOT ({trim})"
    return TALK + NEAR + EDIT + f""",
j AS (SELECT near.chapter_id, near.position, near.start_ms AS s, greatest(near.start_ms, edit.at_ms) AS e, a_start, a_end, a_locked, a_pos
      FROM near JOIN edit ON edit.chapter_id = near.chapter_id AND edit.position = near.position WHERE NOT locked),
k AS (SELECT *, CASE WHEN coalesce(e > a_start, false) AND {clamp} THEN a_start ELSE e END AS e2, CASE WHEN coalesce(e > a_start, false) AND {trim} THEN e END AS push FROM j),
z AS (SELECT *, {"e2" if policy == "allow_overlap" else "greatest(e2, s)"} AS e3 FROM k),
ch AS (SELECT chapter_id, position, s AS ns, e3 AS ne FROM z UNION ALL SELECT chapter_id, a_pos, push, NULL FROM z WHERE push IS NOT NULL)
SELECT cue.chapter_id, cue.position, coalesce(ch.ns, cue.start_ms)::BIGINT AS start_ms, coalesce(ch.ne, cue.end_ms)::BIGINT AS end_ms, CASE WHEN ch.chapter_id IS NULL THEN status ELSE 'manual' END AS status
FROM cue LEFT JOIN ch ON ch.chapter_id = cue.chapter_id AND ch.position = cue.position"""


def _register_moves() -> None:
    for policy in ("clamp_current", "trim_neighbors", "allow_overlap"):
        def run(spark, sf, policy=policy):
            return t.move_boundaries(r.talk_cues(spark, sf), _edits(spark, sf), policy).select(*COLS.split(", "))
        query(f"move_boundary_{policy}", _move_sql(policy))(run)


_register_moves()


@query("shift_cues", TALK + NEAR + """,
e AS (SELECT chapter_id, max(end_ms) AS stop FROM cue GROUP BY chapter_id),
j AS (SELECT near.*, end_ms - start_ms AS d, e.stop FROM near JOIN e USING (chapter_id) WHERE position = 2 AND NOT locked),
k AS (SELECT *, greatest(0, least(greatest(0, stop - d), start_ms + 9000)) AS s0, coalesce(b_end, 0) AS low, coalesce(a_start - d, stop - d) AS high FROM j),
m AS (SELECT *, greatest(low, least(greatest(low, high), s0)) AS s1 FROM k),
n AS (SELECT *, CASE WHEN coalesce(s1 < b_end, false) THEN b_end ELSE s1 END AS s2, CASE WHEN coalesce(s1 + d > a_start, false) THEN a_start ELSE s1 + d END AS e2 FROM m)
SELECT cue.chapter_id, cue.position, coalesce(n.s2, cue.start_ms)::BIGINT AS start_ms, coalesce(greatest(n.e2, n.s2), cue.end_ms)::BIGINT AS end_ms, CASE WHEN n.chapter_id IS NULL THEN cue.status ELSE 'manual' END AS status
FROM cue LEFT JOIN n ON n.chapter_id = cue.chapter_id AND n.position = cue.position""")
def shift_cues(spark, sf):
    cues = r.talk_cues(spark, sf)
    shifts = cues.groupBy("chapter_id").agg(F.max("end_ms").alias("chapter_end_ms")).select(
        "chapter_id", F.lit(2).cast("long").alias("position"), F.lit(9000).cast("long").alias("delta_ms"), "chapter_end_ms")
    return t.shift_cues(cues, shifts).select(*COLS.split(", "))


@query("shift_following", TALK + """ SELECT chapter_id, position, CASE WHEN m THEN start_ms + 700 ELSE start_ms END AS start_ms, CASE WHEN m THEN end_ms + 700 ELSE end_ms END AS end_ms
 FROM (SELECT *, position > 1 AND NOT locked AND end_ms > start_ms AS m FROM cue)""")
def shift_following(spark, sf):
    cues = r.talk_cues(spark, sf)
    points = cues.select("chapter_id").distinct().select("chapter_id", F.lit(1).alias("after_position"), F.lit(700).cast("long").alias("delta_ms"))
    return t.shift_following(cues, points).select("chapter_id", "position", "start_ms", "end_ms")


@query("bind_selection", TALK + """ SELECT chapter_id, position, CASE WHEN position = 0 AND NOT locked THEN 500 ELSE start_ms END AS start_ms,
 CASE WHEN position = 0 AND NOT locked THEN 9500 ELSE end_ms END AS end_ms, CASE WHEN position = 0 AND NOT locked THEN 'manual' ELSE status END AS status FROM cue""")
def bind_selection(spark, sf):
    cues = r.talk_cues(spark, sf)
    chosen = cues.filter("position = 0").select("chapter_id", "position", F.lit(500).cast("long").alias("start_ms"), F.lit(9500).cast("long").alias("end_ms"))
    return t.bind_selection(cues, chosen).select(*COLS.split(", "))


@query("clear_timing", TALK + """ SELECT chapter_id, position, CASE WHEN c THEN 0 ELSE start_ms END AS start_ms, CASE WHEN c THEN 0 ELSE end_ms END AS end_ms,
 CASE WHEN c THEN 0.0 ELSE confidence END AS confidence, CASE WHEN c THEN 'unmatched' ELSE status END AS status FROM (SELECT *, origin = 'asr' AND NOT locked AS c FROM cue)""")
def clear_timing(spark, sf):
    return t.clear_timing(r.talk_cues(spark, sf), F.col("origin") == "asr").select("chapter_id", "position", "start_ms", "end_ms", "confidence", "status")


@query("delete_rows", TALK + """ SELECT chapter_id, segment_id, row_number() OVER (PARTITION BY chapter_id ORDER BY position) - 1 AS position,
 CASE WHEN u THEN 'unmatched' ELSE status END AS status, CASE WHEN u THEN 0 ELSE end_ms END AS end_ms FROM (SELECT *, confidence < 0.5 AND NOT locked AND origin IN ('source', 'subtitle') AS u FROM cue
 WHERE NOT (confidence < 0.5 AND NOT locked AND origin IN ('asr', 'user')))""")
def delete_rows(spark, sf):
    return t.delete_rows(r.talk_cues(spark, sf), F.col("confidence") < 0.5).select("chapter_id", "segment_id", "position", "status", "end_ms")


@query("merge_rows", TALK + r""",
g AS (SELECT *, position // 2 AS grp FROM cue),
k AS (SELECT chapter_id, grp, bool_or(locked) AS bad, min(position) AS p, min(CASE WHEN end_ms > start_ms THEN start_ms END) AS s, max(CASE WHEN end_ms > start_ms THEN end_ms END) AS e, min(confidence) AS c,
        arg_min(text, position) AS a, CASE WHEN count(*) = 2 THEN arg_max(text, position) END AS b, arg_min(origin, position) AS o FROM g GROUP BY chapter_id, grp),
m AS (SELECT chapter_id, p, CASE WHEN b IS NULL THEN a WHEN regexp_matches(right(a, 1), '\s') OR regexp_matches(left(b, 1), '\s') THEN a || b
        WHEN regexp_matches(left(b, 1), '[，。！？；：、,.!?;:%)\]}〉》」』】〗〕’”»…]') OR regexp_matches(right(a, 1), '[(\[{〈《「『【〖〔‘“«¿¡]') THEN a || b ELSE a || ' ' || b END AS text,
        coalesce(s, 0) AS start_ms, coalesce(e, 0) AS end_ms, c AS confidence FROM k WHERE NOT bad),
z AS (SELECT * FROM m UNION ALL SELECT g.chapter_id, g.position, g.text, g.start_ms, g.end_ms, g.confidence FROM g JOIN k ON k.chapter_id = g.chapter_id AND k.grp = g.grp WHERE k.bad)
SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY p) - 1 AS position, text, start_ms, end_ms, confidence FROM z""")
def merge_rows(spark, sf):
    rows = r.talk_cues(spark, sf).withColumn("merge_group", F.floor(F.col("position") / 2))
    return t.merge_rows(rows).select("chapter_id", "position", "text", "start_ms", "end_ms", "confidence")


@query("changed_rows", TALK + f""", m AS ({MONO}) SELECT cue.chapter_id, sum((cue.start_ms <> m.start_ms OR cue.end_ms <> m.end_ms)::INT)::BIGINT AS changed
 FROM cue JOIN m ON m.chapter_id = cue.chapter_id AND m.position = cue.position GROUP BY cue.chapter_id""")
def changed_rows(spark, sf):
    cues = r.talk_cues(spark, sf)
    return t.changed_rows(cues, t.enforce_monotonic(cues))


@query("row_at_time", TALK + "," + r.SIL + """ SELECT s.chapter_id, s.time_ms AS at_ms, min(cue.position) AS position FROM (SELECT DISTINCT chapter_id, time_ms FROM sil) s
 JOIN cue ON cue.chapter_id = s.chapter_id AND cue.start_ms <= s.time_ms AND s.time_ms < cue.end_ms GROUP BY ALL""")
def row_at_time(spark, sf):
    times = r.silences(spark, sf).select("chapter_id", F.col("time_ms").alias("at_ms")).distinct()
    return t.rows_at(r.talk_cues(spark, sf), times)


@query("nearest_silence_edge", TALK + "," + r.SIL + """,
w AS (SELECT chapter_id, position, kind, at_ms FROM (SELECT chapter_id, position, 'start' AS kind, start_ms AS at_ms FROM cue WHERE end_ms > start_ms UNION ALL SELECT chapter_id, position, 'end', end_ms FROM cue WHERE end_ms > start_ms)),
h AS (SELECT w.*, arg_min(edge, abs(edge - at_ms) * 10000000 + edge) AS hit FROM w JOIN (SELECT chapter_id, 'start' AS kind, end_ms AS edge FROM sil WHERE end_ms > start_ms UNION ALL SELECT chapter_id, 'end', start_ms FROM sil WHERE end_ms > start_ms
     UNION ALL SELECT chapter_id, unnest(['start', 'end']), time_ms FROM sil WHERE end_ms <= start_ms) e
     ON e.chapter_id = w.chapter_id AND e.kind = w.kind AND abs(e.edge - w.at_ms) <= 250 GROUP BY ALL)
SELECT w.chapter_id, w.position, w.kind, w.at_ms, coalesce(h.hit, w.at_ms) AS snapped_ms FROM w LEFT JOIN h ON h.chapter_id = w.chapter_id AND h.position = w.position AND h.kind = w.kind""")
def nearest_silence_edge(spark, sf):
    cues = r.talk_cues(spark, sf).filter(t.timed())
    edits = cues.select("chapter_id", "position", F.lit("start").alias("kind"), F.col("start_ms").alias("at_ms")).unionByName(
        cues.select("chapter_id", "position", F.lit("end").alias("kind"), F.col("end_ms").alias("at_ms")))
    return t.nearest_silence(edits, r.silences(spark, sf), 250)


@query("constraint_report", TALK + """ SELECT chapter_id, position, 'confidence' AS violation FROM (SELECT *, confidence * 2 AS c FROM cue) WHERE c > 1
 UNION ALL SELECT chapter_id, position, 'time range' FROM cue WHERE start_ms > 60000 UNION ALL SELECT chapter_id, NULL, 'missing parent' FROM cue WHERE chapter_id NOT IN (SELECT doc_id FROM labels)""")
def constraint_report(spark, sf):
    """Findings after confidence was doubled and late starts were made negative."""
    cues = r.talk_cues(spark, sf).withColumn("confidence", F.col("confidence") * 2).withColumn(
        "start_ms", F.when(F.col("start_ms") > 60_000, -1).otherwise(F.col("start_ms")))
    return schema.check_constraints(cues, r.table(spark, sf, "labels").select(F.col("doc_id").alias("chapter_id")))


@query("pairing_shift", """WITH c AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
SELECT b.source AS book_id, b.doc_id AS chapter_id, a.doc_id AS audio_id FROM c a JOIN c b ON a.source = b.source AND b.k - 2 = a.k""")
def pairing_shift(spark, sf):
    docs = r.table(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_id"), F.col("doc_id").alias("position"))
    links = docs.select("book_id", "chapter_id", F.col("chapter_id").alias("audio_id"))
    return t.shift_pairings(links, docs, 2).select("book_id", "chapter_id", "audio_id")
