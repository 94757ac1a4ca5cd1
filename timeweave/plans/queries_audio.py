"""Queries over energies, silences, recognised tokens, plans and block quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import planning, pyramid, quality, silence, transcript
from timeweave.ordered import Seq
from timeweave.plans import relations as r
from timeweave.plans.registry import query

THRESHOLD = r.FRAMES + ", th AS (SELECT chapter_id, quantile_cont(rms, 0.18) AS threshold FROM frames GROUP BY chapter_id)"


@query("frame_energy", """SELECT user_id AS chapter_id, event_id // 20 AS frame_no, round(sqrt(sum(value * value) / 20 + 1e-12), 6) AS rms FROM events GROUP BY ALL""")
def frame_energy(spark, sf):
    rows = r.table(spark, sf, "events").select(F.col("user_id").alias("chapter_id"), F.col("event_id").alias("sample_no"), "value")
    return silence.frame_energy(rows, 20).withColumn("rms", F.round("rms", 6))


@query("samples_between", "SELECT user_id AS chapter_id, event_id AS sample_no, value FROM events WHERE event_id >= 312 AND event_id < 4000")
def samples_between(spark, sf):
    rows = r.table(spark, sf, "events").select(F.col("user_id").alias("chapter_id"), F.col("event_id").alias("sample_no"), "value")
    return silence.samples_between(rows, 250, 1_249, 16_000)


@query("snap_policy", "SELECT doc_id, doc_id % 3 <> 2 AS snaps FROM documents")
def snap_policy(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("whisper", "other", *transcript.MODEL_TIMED)])
    return r.table(spark, sf, "documents").select("doc_id", transcript.snaps_to_silence(F.get(kinds, (F.col("doc_id") % 3).cast("int"))).alias("snaps"))


@query("silence_threshold", r.with_sql(THRESHOLD) + " SELECT chapter_id, round(threshold, 6) AS threshold FROM th")
def silence_threshold(spark, sf):
    return silence.silence_threshold(r.frames(spark, sf)).withColumn("threshold", F.round("threshold", 6))


@query("exact_percentile", "SELECT l_returnflag AS chapter_id, round(quantile_cont(l_extendedprice, 0.18), 4) AS threshold FROM lineitem GROUP BY 1")
def exact_percentile(spark, sf):
    """The histogram way on three huge groups."""
    rows = r.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("chapter_id"), F.col("l_extendedprice").alias("rms"))
    return silence.exact_percentile(rows, "rms", 0.18, "threshold").withColumn("threshold", F.round("threshold", 4))


def _energy_sql(least: int) -> str:
    return r.with_sql(THRESHOLD) + f""",
s AS (SELECT f.chapter_id, frame_no, rms, frame_no - row_number() OVER (PARTITION BY f.chapter_id ORDER BY frame_no) AS run FROM frames f JOIN th ON th.chapter_id = f.chapter_id WHERE rms <= threshold)
SELECT chapter_id, arg_min(frame_no, rms * 1e9 + frame_no) * 20 AS time_ms, round(least(1.0, count(*) / {least * 3}.0), 6) AS score, 'energy-silence' AS kind, min(frame_no) * 20 AS start_ms, (max(frame_no) + 1) * 20 AS end_ms
FROM s GROUP BY chapter_id, run HAVING count(*) >= {least}"""


@query("energy_silences", _energy_sql(2))
def energy_silences(spark, sf):
    return silence.energy_silences(r.frames(spark, sf), 18.0, 40).withColumn("score", F.round("score", 6))


@query("speech_gaps", """WITH RECURSIVE sp AS (SELECT o_custkey AS chapter_id, o_orderkey % 100000 AS start_ms, o_orderkey % 100000 + (o_totalprice::BIGINT % 700) AS end_ms FROM orders),
a AS (SELECT * FROM sp UNION ALL SELECT chapter_id, max(end_ms) + 1000, max(end_ms) + 1000 FROM sp GROUP BY chapter_id),
g AS (SELECT chapter_id, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY chapter_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gs, start_ms AS ge FROM a),
fr AS (SELECT user_id AS chapter_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 20 AS t, value AS rms FROM events),
al AS (SELECT chapter_id, sqrt(avg(rms * rms) + 1e-12) AS overall FROM fr GROUP BY chapter_id)
SELECT g.chapter_id, least(ge - 1, arg_min(t, rms * 1e9 + t) + 10) AS time_ms, round(least(1.0, (ge - gs) / 1050.0) * 0.65 + (1 - least(1.0, min(rms) / greatest(min(overall), 1e-7))) * 0.35, 6) AS score,
       'vad-silence' AS kind, gs AS start_ms, ge AS end_ms
FROM g JOIN fr ON fr.chapter_id = g.chapter_id AND gs <= t AND t < ge JOIN al ON al.chapter_id = g.chapter_id WHERE ge - gs >= 350 GROUP BY g.chapter_id, gs, ge""")
def speech_gaps(spark, sf):
    speech = r.table(spark, sf, "orders").select(F.col("o_custkey").alias("chapter_id"), (F.col("o_orderkey") % 100_000).alias("start_ms"),
                                                 (F.col("o_orderkey") % 100_000 + F.bround("o_totalprice").cast("long") % 700).alias("end_ms"))
    durations = speech.groupBy("chapter_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))
    return silence.speech_gaps(speech, durations, r.frames(spark, sf)).withColumn("score", F.round("score", 6))


SILX = r.with_sql(r.SIL)


@query("strong_silences", SILX + " SELECT chapter_id, position, time_ms FROM sil WHERE end_ms - start_ms >= 500 OR score >= 0.78")
def strong_silences(spark, sf):
    return silence.strong_silences(r.silences(spark, sf)).select("chapter_id", "position", "time_ms")


@query("key_silence_candidates", SILX + " SELECT chapter_id, position, time_ms FROM sil WHERE end_ms - start_ms >= 525 OR (end_ms - start_ms >= 350 AND score >= 0.78)")
def key_silence_candidates(spark, sf):
    return silence.key_eligible(r.silences(spark, sf)).select("chapter_id", "position", "time_ms")


@query("key_silences", SILX + """,
e AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY time_ms, position) AS n, score * greatest(1, end_ms - start_ms) AS rk FROM sil WHERE end_ms - start_ms >= 525 OR (end_ms - start_ms >= 350 AND score >= 0.78)),
f AS (SELECT chapter_id, n, time_ms AS cur_at, rk AS cur_rk, 1 AS grp, position AS cur FROM e WHERE n = 1
      UNION ALL SELECT e.chapter_id, e.n, CASE WHEN e.time_ms - f.cur_at >= 800 OR e.rk > f.cur_rk THEN e.time_ms ELSE f.cur_at END, CASE WHEN e.time_ms - f.cur_at >= 800 OR e.rk > f.cur_rk THEN e.rk ELSE f.cur_rk END,
             f.grp + (e.time_ms - f.cur_at >= 800)::INT, CASE WHEN e.time_ms - f.cur_at >= 800 OR e.rk > f.cur_rk THEN e.position ELSE f.cur END FROM f JOIN e ON e.chapter_id = f.chapter_id AND e.n = f.n + 1)
SELECT chapter_id, arg_max(cur, n) AS position, arg_max(cur_at, n) AS time_ms FROM f GROUP BY chapter_id, grp""")
def key_silences(spark, sf):
    return silence.key_silences(r.silences(spark, sf), order=("time_ms", "position")).select("chapter_id", "position", "time_ms")


@query("next_silence", r.with_sql(r.TALK, r.SIL) + """ SELECT c.chapter_id, c.position, c.end_ms AS at_ms, min(s.time_ms) AS silence_ms FROM cue c LEFT JOIN sil s ON s.chapter_id = c.chapter_id AND s.time_ms > c.end_ms GROUP BY ALL""")
def next_silence(spark, sf):
    times = r.talk_cues(spark, sf).select("chapter_id", "position", F.col("end_ms").alias("at_ms"))
    return silence.next_silence(times, r.silences(spark, sf)).select("chapter_id", "position", "at_ms", F.col("silence.time_ms").alias("silence_ms"))


@query("snapped_boundaries", r.with_sql(r.TALK, r.SIL) + """,
p AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY position) AS n, lead(start_ms) OVER w AS rs, lead(end_ms) OVER w AS re, lead(locked) OVER w AS rl FROM cue WINDOW w AS (PARTITION BY chapter_id ORDER BY position)),
t AS (SELECT *, CASE WHEN rs <> 0 THEN (end_ms + rs) // 2 ELSE end_ms END AS tg FROM p WHERE NOT locked AND NOT rl),
k AS (SELECT t.chapter_id, t.position, tg, count(s.position) AS c FROM t LEFT JOIN sil s ON s.chapter_id = t.chapter_id AND s.time_ms <= tg GROUP BY ALL),
d AS (SELECT k.chapter_id, k.position, tg, s.*EXCLUDE (chapter_id, position), s.position AS sp, greatest(0, s.start_ms - tg, tg - s.end_ms) AS away FROM k JOIN sil s ON s.chapter_id = k.chapter_id AND s.position BETWEEN c - 3 AND c + 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, position ORDER BY away, -score, sp) AS best FROM d) WHERE best = 1 AND away <= 1000),
e AS (SELECT chapter_id, position, CASE WHEN end_ms > start_ms THEN start_ms + least(80, (end_ms - start_ms) // 2) ELSE greatest(0, time_ms - 80) END AS pe,
             CASE WHEN end_ms > start_ms THEN end_ms - least(80, (end_ms - start_ms) // 2) ELSE time_ms + 80 END AS fs FROM b),
q AS (SELECT p.*, e.pe, e.fs FROM p LEFT JOIN e ON e.chapter_id = p.chapter_id AND e.position = p.position),
f AS (SELECT chapter_id, n, start_ms AS s, CASE WHEN hit THEN le ELSE end_ms END AS e, CASE WHEN hit THEN least(re, greatest(le, fs)) END AS nxt, hit AS touched
      FROM (SELECT *, coalesce(pe IS NOT NULL AND end_ms > start_ms AND re > rs, false) AS hit, greatest(start_ms, least(pe, re)) AS le FROM q WHERE n = 1)
      UNION ALL
      SELECT chapter_id, n, s, CASE WHEN hit THEN le ELSE end_ms END, CASE WHEN hit THEN least(re, greatest(le, fs)) END, hit OR moved
      FROM (SELECT *, coalesce(pe IS NOT NULL AND end_ms > s AND re > rs, false) AS hit, greatest(s, least(pe, re)) AS le
            FROM (SELECT q.*, coalesce(f.nxt, q.start_ms) AS s, f.nxt IS NOT NULL AS moved FROM f JOIN q ON q.chapter_id = f.chapter_id AND q.n = f.n + 1)))
SELECT q.chapter_id, q.position, f.s AS start_ms, f.e AS end_ms, CASE WHEN f.touched AND q.status = 'auto' THEN 'manual' ELSE q.status END AS status FROM f JOIN q ON q.chapter_id = f.chapter_id AND q.n = f.n""")
def snapped_boundaries(spark, sf):
    return silence.snap_boundaries(r.talk_cues(spark, sf), r.silences(spark, sf)).select("chapter_id", "position", "start_ms", "end_ms", "status")


@query("silence_only_alignment")
def silence_only_alignment(spark, sf):
    cues = r.talk_cues(spark, sf)
    spans = cues.select("chapter_id").distinct().select("chapter_id", F.lit(0).cast("long").alias("from_ms"), F.lit(120_000).cast("long").alias("to_ms"))
    return silence.align_by_silence(cues, r.silences(spark, sf), spans).select("chapter_id", "position", "start_ms", "end_ms", F.round("confidence", 4).alias("confidence"), "status", "proposed")


@query("part_silences", SILX + """, pt AS (SELECT c_custkey % 150 AS chapter_id, c_custkey AS part_no, c_nationkey AS audio_id, 1000 * c_nationkey AS local_start FROM customer)
SELECT pt.chapter_id, part_no, time_ms + local_start AS time_ms, start_ms + local_start AS start_ms, end_ms + local_start AS end_ms, row_number() OVER (PARTITION BY pt.chapter_id ORDER BY part_no, time_ms, start_ms) - 1 AS position
FROM pt JOIN (SELECT DISTINCT ON (chapter_id, time_ms, start_ms) * FROM sil) s ON s.chapter_id = pt.audio_id""")
def part_silences(spark, sf):
    parts = r.table(spark, sf, "customer").select((F.col("c_custkey") % 150).alias("chapter_id"), F.col("c_custkey").alias("part_no"),
                                                 F.col("c_nationkey").alias("audio_id"), (F.col("c_nationkey") * 1000).alias("local_start"))
    sil = r.silences(spark, sf).dropDuplicates(["chapter_id", "time_ms", "start_ms"]).withColumnRenamed("chapter_id", "audio_id")
    return silence.chapter_silences(parts, sil).select("chapter_id", "part_no", "time_ms", "start_ms", "end_ms", "position")


SENT = r.with_sql(r.EVENT_TOKENS) + """,
nx AS (SELECT *, lead(start_ms) OVER (PARTITION BY chapter_id ORDER BY token_pos) AS ns FROM tok),
en AS (SELECT *, ns IS NULL OR right(text, 1) IN ('。', '！', '？', '!', '?', '；', ';') OR ns - end_ms >= 700 AS ends FROM nx),
fo AS (SELECT chapter_id, token_pos, 1 AS grp, ends OR end_ms - start_ms >= 12000 OR length(text) >= 90 AS shut, start_ms AS since, length(text) AS len FROM en WHERE token_pos = 0
       UNION ALL
       SELECT e.chapter_id, e.token_pos, f.grp + f.shut::INT, e.ends OR e.end_ms - (CASE WHEN f.shut THEN e.start_ms ELSE f.since END) >= 12000 OR length(e.text) + (CASE WHEN f.shut THEN 0 ELSE f.len END) >= 90,
              CASE WHEN f.shut THEN e.start_ms ELSE f.since END, length(e.text) + (CASE WHEN f.shut THEN 0 ELSE f.len END) FROM fo f JOIN en e ON e.chapter_id = f.chapter_id AND e.token_pos = f.token_pos + 1)"""


@query("token_sentences", SENT + """,
g AS (SELECT e.*, fo.grp, lead(fo.grp) OVER (PARTITION BY e.chapter_id ORDER BY e.token_pos) = fo.grp AS more FROM en e JOIN fo ON fo.chapter_id = e.chapter_id AND fo.token_pos = e.token_pos),
j AS (SELECT chapter_id, grp, string_agg(text || CASE WHEN coalesce(more, false) AND ns - end_ms BETWEEN 420 AND 699 AND right(text, 1) <> '.' THEN ',' ELSE '' END, ' ' ORDER BY token_pos) AS line,
             arg_min(start_ms, token_pos) AS start_ms, arg_max(end_ms, token_pos) AS end_ms, count(*) AS n_tokens, avg(probability) AS p FROM g GROUP BY chapter_id, grp)
SELECT chapter_id, grp - 1 AS position, CASE WHEN right(line, 1) = '.' THEN line ELSE line || '.' END AS text, start_ms, end_ms, n_tokens, round(least(1.0, greatest(0.0, p)), 6) AS confidence,
       CASE WHEN p >= 0.58 THEN 'auto' ELSE 'low_confidence' END AS status FROM j""")
def token_sentences(spark, sf):
    out = transcript.tokens_to_sentences(r.spoken_events(spark, sf))
    return out.select("chapter_id", "position", "text", "start_ms", "end_ms", "n_tokens", F.round("confidence", 6).alias("confidence"), "status")


@query("token_blocks", r.with_sql(r.EVENT_TOKENS) + """,
p AS (SELECT *, row_number() OVER w AS idx, coalesce(lag(end_ms) OVER w IS NULL OR start_ms - lag(end_ms) OVER w >= 900 OR right(lag(text) OVER w, 1) = '.', true) AS st FROM tok WINDOW w AS (PARTITION BY chapter_id ORDER BY token_pos)),
i AS (SELECT *, sum(st::INT) OVER (PARTITION BY chapter_id ORDER BY token_pos) AS island FROM p),
k AS (SELECT *, (idx - min(idx) OVER (PARTITION BY chapter_id, island)) // 36 AS part FROM i)
SELECT chapter_id, island, part, count(*) AS n_tokens, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM k GROUP BY ALL""")
def token_blocks(spark, sf):
    return transcript.token_blocks(r.spoken_events(spark, sf)).groupBy("chapter_id", "island", "part").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


# Orders are chunks of a customer's run, their lines the chunk-local tokens.
CHUNKS = """ch AS (SELECT o_custkey AS run_id, o_orderkey AS position, o_orderkey * 10 AS source_start_ms, o_orderkey * 10 + 400 AS core_start_ms, o_orderkey * 10 + 2400 AS core_end_ms,
              CASE o_orderstatus WHEN 'O' THEN 'pending' ELSE 'complete' END AS status FROM orders),
ct AS (SELECT o_custkey AS run_id, o_orderkey AS chunk_position, l_linenumber * 100000 + l_partkey * 10 + l_suppkey % 10 AS token_pos, (l_quantity * 60)::BIGINT AS start_ms, (l_quantity * 60)::BIGINT + 100 AS end_ms, l_extendedprice AS tie
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _chunks(spark, sf):
    o = r.table(spark, sf, "orders")
    chunks = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("position"), (F.col("o_orderkey") * 10).alias("source_start_ms"),
                      (F.col("o_orderkey") * 10 + 3000).alias("source_end_ms"), (F.col("o_orderkey") * 10 + 400).alias("core_start_ms"),
                      (F.col("o_orderkey") * 10 + 2400).alias("core_end_ms"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("complete").alias("status"))
    toks = r.table(spark, sf, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("chunk_position"),
        (F.col("l_linenumber") * 100_000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("token_pos"), (F.col("l_quantity") * 60).cast("long").alias("start_ms"),
        ((F.col("l_quantity") * 60).cast("long") + 100).alias("end_ms"))
    return chunks, toks


@query("merged_chunks", f"""WITH {CHUNKS}, j AS (SELECT ct.run_id, chunk_position, token_pos, start_ms + source_start_ms AS s, end_ms + source_start_ms AS e, core_start_ms, core_end_ms FROM ct JOIN ch ON ch.run_id = ct.run_id AND ch.position = chunk_position),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY chunk_position, token_pos, s) - 1 AS position FROM j WHERE (s + e) // 2 BETWEEN core_start_ms AND core_end_ms)
SELECT run_id, count(*) AS tokens, max(position) AS last_position, sum(s)::BIGINT AS starts, sum(position * chunk_position)::BIGINT AS order_sum FROM n GROUP BY run_id""")
def merged_chunks(spark, sf):
    chunks, toks = _chunks(spark, sf)
    return transcript.merge_chunks(toks, chunks).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tokens"), F.max("position").alias("last_position"), F.sum("start_ms").alias("starts"), F.sum(F.col("position") * F.col("chunk_position")).alias("order_sum"))


@query("completed_run_tokens", f"""WITH {CHUNKS}, n AS (SELECT ct.run_id, chunk_position, row_number() OVER (PARTITION BY ct.run_id ORDER BY chunk_position, token_pos) - 1 AS position FROM ct JOIN ch ON ch.run_id = ct.run_id AND ch.position = chunk_position WHERE status = 'complete')
SELECT run_id, count(*) AS tokens, sum(position * chunk_position)::BIGINT AS order_sum FROM n GROUP BY run_id""")
def completed_run_tokens(spark, sf):
    chunks, toks = _chunks(spark, sf)
    return transcript.run_tokens(toks, chunks).groupBy("run_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("position") * F.col("chunk_position")).alias("order_sum"))


@query("bounded_tokens", r.with_sql(r.EVENT_TOKENS) + """, z AS (SELECT chapter_id, token_pos, text, start_ms - min(start_ms) OVER (PARTITION BY chapter_id) - 100 AS s, end_ms - min(start_ms) OVER (PARTITION BY chapter_id) - 100 AS e FROM tok),
b AS (SELECT chapter_id, token_pos, greatest(0, s) AS start_ms, least(greatest(0, e), 30000) AS end_ms FROM z)
SELECT chapter_id, row_number() OVER (PARTITION BY chapter_id ORDER BY token_pos) - 1 AS position, start_ms, end_ms FROM b WHERE start_ms < 30000 AND end_ms > start_ms""")
def bounded_tokens(spark, sf):
    toks = r.spoken_events(spark, sf)
    first = toks.groupBy("chapter_id").agg(F.min("start_ms").alias("base"))
    local = toks.join(first, "chapter_id").withColumn("start_ms", F.col("start_ms") - F.col("base") - 100).withColumn("end_ms", F.col("end_ms") - F.col("base") - 100)
    durations = first.select("chapter_id", F.lit(30_000).cast("long").alias("duration_ms"))
    return transcript.bounded_tokens(local, durations).select("chapter_id", "position", "start_ms", "end_ms")


@query("work_totals", f"""WITH {CHUNKS} SELECT c_nationkey AS book_id, count(DISTINCT c_custkey) AS chapter_total, count(ch.position) AS chunk_total, coalesce(sum(core_end_ms - core_start_ms), 0)::BIGINT AS total_audio_ms,
 count(CASE WHEN status = 'complete' THEN 1 END) AS cache_hits FROM customer LEFT JOIN ch ON run_id = c_custkey GROUP BY c_nationkey""")
def work_totals(spark, sf):
    chunks, _ = _chunks(spark, sf)
    customers = r.table(spark, sf, "customer").select(F.col("c_custkey").alias("chapter_id"), F.col("c_nationkey").alias("book_id"))
    return transcript.work_totals(customers, chunks.join(customers, chunks["run_id"] == customers["chapter_id"]))


@query("text_groups", r.with_sql(r.TALK) + f""",
d AS (SELECT *, greatest(900, least(60000, round_even(greatest(1, len(regexp_extract_all(text, {r.WORD_SQL}))) * 360.0 + 70 * length(regexp_replace(text, '[^，、；：,.!?。！？…]', '', 'g')), 0)::BIGINT)) AS ms FROM cue),
w AS (SELECT a.chapter_id, a.position AS start_position, b.position, bool_or(b.locked) OVER q AS lk, count(*) OVER q AS c, sum(b.ms) OVER q AS s FROM d a JOIN d b ON b.chapter_id = a.chapter_id AND b.position BETWEEN a.position AND a.position + 5
      WINDOW q AS (PARTITION BY a.chapter_id, a.position ORDER BY b.position))
SELECT chapter_id, start_position, coalesce(min(CASE WHEN NOT lk AND c >= 2 AND s >= 12000 THEN position + 1 END), max(CASE WHEN NOT lk THEN position + 1 END), start_position) AS end_position FROM w GROUP BY chapter_id, start_position""")
def text_groups(spark, sf):
    cues = r.talk_cues(spark, sf)
    return planning.text_groups(cues, cues.select("chapter_id", F.col("position").alias("start_position")))


@query("block_group_ends", r.with_sql(r.TALK) + f""",
d AS (SELECT *, greatest(900, least(60000, round_even(greatest(1, len(regexp_extract_all(text, {r.WORD_SQL}))) * 360.0 + 70 * length(regexp_replace(text, '[^，、；：,.!?。！？…]', '', 'g')), 0)::BIGINT)) AS ms FROM cue),
w AS (SELECT a.chapter_id, a.position AS start_position, b.position, bool_or(b.locked) OVER q AS lk, sum(b.ms) OVER q AS s FROM d a JOIN d b ON b.chapter_id = a.chapter_id AND b.position BETWEEN a.position AND a.position + 19
      WINDOW q AS (PARTITION BY a.chapter_id, a.position ORDER BY b.position)),
f AS (SELECT chapter_id, start_position, max(position + 1) AS av, coalesce(min(CASE WHEN position + 1 - start_position >= 4 AND s >= 80000 THEN position + 1 END), max(position + 1)) AS pf FROM w WHERE NOT lk GROUP BY ALL),
c AS (SELECT *, list_distinct([greatest(least(av, start_position + 4), least(av, pf - 1)), greatest(least(av, start_position + 4), least(av, pf)), greatest(least(av, start_position + 4), least(av, pf + 1)), least(av, start_position + 4)]) AS l FROM f)
SELECT chapter_id, start_position, array_to_string(list_transform(list_sort(list_transform(l, lambda e: abs(e - pf) * 1000 + e)), lambda x: x % 1000), ',') AS ends FROM c""")
def block_group_ends(spark, sf):
    cues = r.talk_cues(spark, sf)
    return planning.block_group_ends(cues, cues.select("chapter_id", F.col("position").alias("start_position"))).withColumn("ends", F.concat_ws(",", F.col("ends").cast("array<string>")))


REQ = r.with_sql(r.TALK, r.SIL) + """,
rq AS (SELECT chapter_id, position AS request_id, start_ms, 150000 AS limit_ms, greatest(900, length(text) * 15) AS expected_ms FROM cue WHERE end_ms > start_ms)"""


def _requests(spark, sf):
    return r.talk_cues(spark, sf).filter("end_ms > start_ms").select(
        "chapter_id", F.col("position").alias("request_id"), "start_ms", F.lit(150_000).cast("long").alias("limit_ms"), F.greatest(F.lit(900), F.length("text") * 15).cast("long").alias("expected_ms"))


@query("expanding_windows", REQ + """,
h AS (SELECT *, least(limit_ms, start_ms + greatest(8000, least(90000, expected_ms * 3 + 4000))) AS hard, start_ms + expected_ms + 600 AS tg, start_ms + greatest(750, round_even(expected_ms * 0.55::DOUBLE, 0)::BIGINT) AS mn FROM rq),
t AS (SELECT h.chapter_id, request_id, hard, list_sort(list_distinct(list(s.time_ms) FILTER (WHERE s.time_ms >= tg))) AS aft, max(s.time_ms) AS late FROM h LEFT JOIN sil s ON s.chapter_id = h.chapter_id AND s.time_ms BETWEEN mn AND hard GROUP BY ALL),
k AS (SELECT *, CASE WHEN len(aft) > 0 THEN aft[1:4] WHEN late IS NOT NULL THEN [late] ELSE [] END AS sel FROM t)
SELECT chapter_id, request_id, array_to_string((CASE WHEN len(sel) = 0 OR hard - sel[-1] >= 500 THEN list_append(sel, hard) ELSE sel END)[1:4], ',') AS ends FROM k""")
def expanding_windows(spark, sf):
    return planning.expanding_windows(_requests(spark, sf), r.silences(spark, sf)).withColumn("ends", F.concat_ws(",", F.col("ends").cast("array<string>")))


@query("block_windows", REQ + """,
a AS (SELECT *, least(90000, greatest(4000, expected_ms)) AS x, least(limit_ms, start_ms + 90000) AS late FROM rq),
b AS (SELECT *, least(late, start_ms + greatest(2000, round_even(x * 0.55::DOUBLE, 0)::BIGINT)) AS early, least(limit_ms, start_ms + x) AS tg FROM a),
c AS (SELECT b.*, (SELECT list_sort(list(abs(s.end_ms - tg) * 1000000000 + s.end_ms))[1:3] FROM sil s WHERE s.chapter_id = b.chapter_id AND (s.end_ms - s.start_ms >= 500 OR s.score >= 0.78) AND s.end_ms BETWEEN early AND late) AS near FROM b),
d AS (SELECT *, list_transform(coalesce(near, []), lambda v: v % 1000000000 * 2) AS st, least(late, greatest(early, start_ms + round_even(x * 1.35::DOUBLE, 0)::BIGINT)) * 2 + 1 AS wide, least(late, greatest(early, tg)) * 2 + 1 AS mid FROM c),
e AS (SELECT *, list_concat(list_concat(list_concat(st[1:1], [wide]), st[2:3]), [mid, late * 2 + 1]) AS plan FROM d),
k AS (SELECT chapter_id, request_id, list_reduce(list_transform(plan, lambda v: [v]), lambda acc, v: CASE WHEN v[1] // 2 <= start_ms OR len(list_filter(acc, lambda y: abs(y // 2 - v[1] // 2) < 250)) > 0 THEN acc ELSE list_concat(acc, v) END, []::BIGINT[])[1:5] AS ends FROM e)
SELECT chapter_id, request_id, array_to_string(list_transform(ends, lambda y: (y // 2)::VARCHAR || CASE WHEN y % 2 = 1 THEN 'w' ELSE 's' END), ',') AS ends FROM k""")
def block_windows(spark, sf):
    out = planning.block_windows(_requests(spark, sf), r.silences(spark, sf))
    return out.select("chapter_id", "request_id", F.concat_ws(",", F.transform("ends", lambda e: F.concat(e["t"].cast("string"), F.when(e["weak"], "w").otherwise("s")))).alias("ends"))


@query("next_starts", r.with_sql(r.TALK, r.SIL) + """,
h AS (SELECT c.chapter_id, c.position AS request_id, c.end_ms AS at_ms, s.time_ms, s.score, s.end_ms AS pe FROM cue c LEFT JOIN sil s ON s.chapter_id = c.chapter_id AND s.end_ms >= c.end_ms - 250 AND s.start_ms <= c.end_ms + 2000 WHERE c.end_ms > c.start_ms),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, request_id ORDER BY abs(time_ms - at_ms), -score, time_ms, pe) AS k FROM h) WHERE k = 1)
SELECT chapter_id, request_id, least(coalesce(greatest(at_ms, pe + 80), at_ms), 150000) AS next_start FROM b""")
def next_starts(spark, sf):
    ends = r.talk_cues(spark, sf).filter("end_ms > start_ms").select("chapter_id", F.col("position").alias("request_id"), F.col("end_ms").alias("end_at"), F.lit(150_000).cast("long").alias("limit_ms"))
    return planning.next_starts(ends, r.silences(spark, sf))


def _plan_sql(target: int, maximum: int, overlap: int, tail: int) -> str:
    lower = max(30_000, target // 2)
    return r.with_sql(r.SIL) + f""",
z AS (SELECT chapter_id AS audio_id, time_ms * 40 AS time_ms, max(time_ms * 40) OVER (PARTITION BY chapter_id) + 50000 AS stop FROM sil),
pz AS (SELECT audio_id, list_sort(list_distinct(list(time_ms) FILTER (WHERE time_ms > 20000 AND time_ms < stop - 20000))) AS p, any_value(stop) AS stop FROM z GROUP BY audio_id),
cuts AS (SELECT audio_id, 0::BIGINT AS c, 0 AS k, p, stop FROM pz
  UNION ALL SELECT audio_id, nxt, k + 1, p, stop FROM (SELECT *, coalesce(list_min(list_transform(list_filter(p, lambda x: x >= c + {lower} AND x <= up), lambda x: abs(x - tg) * 1000000000 + x)) % 1000000000, {'tg' if tail else 'up'}) AS nxt
    FROM (SELECT *, least(up, c + {target}) AS tg FROM (SELECT *, least(stop - {tail}, c + {maximum}) AS up FROM cuts WHERE stop - c > {maximum}))) WHERE nxt > c),
o AS (SELECT *, lead(c) OVER (PARTITION BY audio_id ORDER BY k) AS n FROM cuts)
SELECT audio_id, k AS position, greatest(0, c - CASE WHEN k > 0 THEN {overlap} ELSE 0 END) AS source_start_ms, least(stop, coalesce(n, stop) + CASE WHEN n IS NULL THEN 0 ELSE {overlap} END) AS source_end_ms, c AS core_start_ms, coalesce(n, stop) AS core_end_ms FROM o"""


def _long_audio(spark, sf):
    sil = r.silences(spark, sf).select(F.col("chapter_id").alias("audio_id"), (F.col("time_ms") * 40).alias("time_ms"))
    spans = sil.groupBy("audio_id").agg(F.lit(0).cast("long").alias("from_ms"), (F.max("time_ms") + 50_000).alias("to_ms"))
    return spans, sil


@query("chunk_plan", _plan_sql(120_000, 180_000, 1500, 0))
def chunk_plan(spark, sf):
    return planning.plan_chunks(*_long_audio(spark, sf), block_ms=600_000)


@query("chunk_plan_limited", _plan_sql(150_000, 177_000, 1500, 30_000))
def chunk_plan_limited(spark, sf):
    return planning.plan_recognition(*_long_audio(spark, sf), limited=True)


@query("limited_parts", _plan_sql(150_000, 180_000, 0, 30_000))
def limited_parts(spark, sf):
    return planning.limited_parts(*_long_audio(spark, sf))


@query("speaking_rates", """WITH RECURSIVE b AS (SELECT l_orderkey AS chapter_id, l_linenumber AS block_no, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS spoken_ms, sum(l_quantity)::BIGINT AS units FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY block_no) AS k, spoken_ms / greatest(1, units) AS rate FROM b),
f AS (SELECT chapter_id, block_no, k, rate AS blended FROM n WHERE k = 1 UNION ALL SELECT n.chapter_id, n.block_no, n.k, f.blended * 0.7 + n.rate * 0.3 FROM f JOIN n ON n.chapter_id = f.chapter_id AND n.k = f.k + 1)
SELECT chapter_id, block_no, floor(blended * 100 + 0.5)::BIGINT AS rate_hundredths FROM f""")
def speaking_rates(spark, sf):
    blocks = r.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("chapter_id"), F.col("l_linenumber").alias("block_no")).agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("spoken_ms"), F.sum("l_quantity").cast("long").alias("units"))
    return planning.speaking_rates(blocks).select("chapter_id", "block_no", F.floor(F.col("blended_rate") * 100 + 0.5).alias("rate_hundredths"))


@query("usable_coverage", r.with_sql(r.PAGE_CUES) + """, l AS (SELECT *, max(CASE WHEN end_ms > start_ms THEN position END) OVER (PARTITION BY chapter_id) AS lt FROM cue WHERE trim(text) <> '')
SELECT chapter_id, round(avg((end_ms > start_ms)::INT), 6) AS coverage, count(CASE WHEN lt IS NULL OR position > lt THEN 1 END) AS trailing,
       coalesce(any_value(lt) IS NOT NULL AND avg((end_ms > start_ms)::INT) >= 0.7 AND count(CASE WHEN position > lt THEN 1 END) <= 2, false) AS usable FROM l GROUP BY chapter_id""")
def usable_coverage(spark, sf):
    return quality.usable_coverage(r.page_cues(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query("progress_evaluation", r.with_sql(r.TALK, r.EVENT_TOKENS) + """,
b AS (SELECT *, min(CASE WHEN status = 'unmatched' OR end_ms <= start_ms THEN position END) OVER (PARTITION BY chapter_id) AS fb FROM cue),
p AS (SELECT chapter_id, count(*) AS rows_, count(CASE WHEN fb IS NULL OR position < fb THEN 1 END) AS acc, avg(CASE WHEN fb IS NULL OR position < fb THEN confidence END) AS mc FROM b GROUP BY chapter_id),
t AS (SELECT chapter_id, count(*) AS n, count(CASE WHEN e > s THEN 1 END) AS tm, max(e) AS le FROM (SELECT chapter_id, start_ms - min(start_ms) OVER w AS s, end_ms - min(start_ms) OVER w AS e FROM tok WINDOW w AS (PARTITION BY chapter_id)) GROUP BY chapter_id),
j AS (SELECT p.*, coalesce(t.n, 0) AS n, coalesce(tm, 0) AS tm, coalesce(le, 0) AS le, coalesce(t.n > 0 AND le >= 45000 - 220, false) AS touch, least(1.0, greatest(0.0, coalesce(le, 0) / 45000.0)) AS used FROM p LEFT JOIN t ON t.chapter_id = p.chapter_id)
SELECT chapter_id, round(least(1.0, greatest(0.0, acc / rows_::DOUBLE * 0.55 + coalesce(mc, 0) * 0.25 + tm / greatest(1, n)::DOUBLE * 0.15 + least(1.0, used / 0.72) * 0.05 - CASE WHEN touch THEN 0.08 ELSE 0 END)), 6) AS score, acc AS accepted_count,
       round(tm / greatest(1, n)::DOUBLE, 6) AS timed_token_ratio, round(used, 6) AS used_window_ratio, touch AS touches_window_end, acc < rows_ OR touch AS needs_more_audio, acc = rows_ AND greatest(0, 45000 - le) >= 12600 AS may_contain_more_text FROM j""")
def progress_evaluation(spark, sf):
    cues = r.talk_cues(spark, sf)
    toks = r.spoken_events(spark, sf)
    first = toks.groupBy("chapter_id").agg(F.min("start_ms").alias("base"))
    local = toks.join(first, "chapter_id").withColumn("start_ms", F.col("start_ms") - F.col("base")).withColumn("end_ms", F.col("end_ms") - F.col("base"))
    windows = cues.select("chapter_id").distinct().withColumn("window_ms", F.lit(45_000))
    out = quality.evaluate_progress(cues, local, windows)
    return out.select("chapter_id", *[F.round(c, 6).alias(c) if c in ("score", "timed_token_ratio", "used_window_ratio") else F.col(c) for c in out.columns if c != "chapter_id"])


BLOCKS = """bk AS (SELECT conv_id AS block_id, conv_id AS chapter_id, 0 AS audio_start_ms, max(turn) * 15000 + 20000 AS audio_end_ms FROM conversations GROUP BY conv_id),
tk AS (SELECT chapter_id AS block_id, position AS token_pos, start_ms + (length(text) % 50) AS start_ms, end_ms - (length(text) % 70) AS end_ms FROM cue WHERE end_ms > start_ms)"""


@query("block_scores", r.with_sql(r.TALK, r.SIL, BLOCKS) + f""",
b AS (SELECT *, greatest(1, audio_end_ms - audio_start_ms) AS d FROM bk),
m AS (SELECT tk.*, b.d, lag(end_ms) OVER (PARTITION BY tk.block_id ORDER BY token_pos) AS pe FROM tk JOIN b ON b.block_id = tk.block_id),
l AS (SELECT block_id, max(end_ms) FILTER (WHERE end_ms > start_ms) AS le, count(CASE WHEN pe > end_ms THEN 1 END) AS inv, count(CASE WHEN start_ms < 0 OR end_ms < start_ms OR end_ms > d + 250 THEN 1 END) AS broken FROM m GROUP BY block_id),
u AS (SELECT *, end_ms > start_ms AS ok, greatest(1, len(regexp_extract_all(text, {r.WORD_SQL}))) AS un FROM cue),
f AS (SELECT chapter_id AS block_id, count(CASE WHEN ok THEN 1 END) AS al, count(CASE WHEN trim(text) <> '' THEN 1 END) AS ex, sum(CASE WHEN ok THEN un END) AS units, arg_max(end_ms, position) FILTER (WHERE ok) AS se, arg_min(start_ms, position) FILTER (WHERE ok) AS ss,
             -quantile_disc(-(end_ms - start_ms) / un, 0.5) FILTER (WHERE ok) AS med FROM u GROUP BY chapter_id),
o AS (SELECT u.chapter_id AS block_id, count(CASE WHEN ok AND ((end_ms - start_ms) / un < med * 0.35 OR (end_ms - start_ms) / un > med * 2.8) THEN 1 END) AS outl FROM u JOIN f ON f.block_id = u.chapter_id GROUP BY ALL),
j AS (SELECT b.*, f.*EXCLUDE (block_id), o.outl, l.le, l.inv, coalesce(l.broken, 0) AS broken, (SELECT min(abs(s.time_ms - (b.audio_start_ms + l.le))) FROM sil s WHERE s.chapter_id = b.chapter_id) AS nr FROM b JOIN f ON f.block_id = b.block_id JOIN o ON o.block_id = b.block_id LEFT JOIN l ON l.block_id = b.block_id),
k AS (SELECT *, al / greatest(1, ex)::DOUBLE AS cov, le >= d - 250 AS touch, le / d::DOUBLE AS used, (se - ss) / greatest(1, units)::DOUBLE AS rate FROM j),
s AS (SELECT *, (0.35 + CASE WHEN touch THEN 0 ELSE 0.15 END + CASE WHEN used BETWEEN 0.35 AND 0.98 THEN 0.1 ELSE 0 END + CASE WHEN rate / 360 BETWEEN 0.55 AND 1.8 THEN (1 - least(1.0, abs(1 - rate / 360) / 0.8)) * 0.2 ELSE 0 END
        + CASE WHEN nr <= 800 THEN (1 - nr / 1000.0) * 0.1 ELSE 0 END + CASE WHEN outl = 0 THEN 0.1 ELSE 0 END) * (0.65 + 0.35 * cov) AS sc FROM k)
SELECT block_id, chapter_id, CASE WHEN le IS NULL OR broken > 0 OR inv > 0 OR al = 0 THEN 0 ELSE round(least(1.0, greatest(0.0, CASE WHEN touch THEN least(sc, 0.69) ELSE sc END)), 6) END AS score, round(CASE WHEN le IS NULL OR broken > 0 OR inv > 0 OR al = 0 THEN NULL ELSE rate END, 4) AS measured_rate FROM s""")
def block_scores(spark, sf):
    cues = r.talk_cues(spark, sf)
    blocks = cues.groupBy(F.col("chapter_id").alias("block_id")).agg(
        F.max("chapter_id").alias("chapter_id"), F.lit(0).cast("long").alias("audio_start_ms"), (F.max("position") * 15_000 + 20_000).alias("audio_end_ms"),
        F.lit(None).cast("double").alias("rate"), F.lit(True).alias("weak"))
    toks = cues.filter("end_ms > start_ms").select(F.col("chapter_id").alias("block_id"), F.col("position").alias("token_pos"),
                                                  (F.col("start_ms") + F.length("text") % 50).alias("start_ms"), (F.col("end_ms") - F.length("text") % 70).alias("end_ms"))
    segs = cues.withColumnRenamed("chapter_id", "block_id")
    return quality.score_blocks(blocks, segs, toks, r.silences(spark, sf)).select("block_id", "chapter_id", F.round("score", 6).alias("score"), F.round("measured_rate", 4).alias("measured_rate"))


# Blocks of four turns that repeat two; the repeat is shifted a little.
BLOCK_ROWS = """br AS (SELECT chapter_id, position // 2 AS block_no, position, start_ms, end_ms, confidence FROM cue
 UNION ALL SELECT chapter_id, position // 2 - 1, position, start_ms + length(text) % 500, end_ms + length(text) % 500, confidence FROM cue WHERE position >= 2)"""


def _block_rows(cues):
    rows = cues.select("chapter_id", F.floor(F.col("position") / 2).alias("block_no"), "position", "start_ms", "end_ms", "confidence")
    d = F.length("text") % 500
    again = cues.filter("position >= 2").select("chapter_id", (F.floor(F.col("position") / 2) - 1).alias("block_no"), "position", (F.col("start_ms") + d).alias("start_ms"), (F.col("end_ms") + d).alias("end_ms"), "confidence")
    return rows.unionByName(again)


@query("block_overlap_agreement", r.with_sql(r.TALK, BLOCK_ROWS) + """,
s AS (SELECT a.chapter_id, a.block_no, a.position, a.start_ms, a.end_ms, b.start_ms AS ps, b.end_ms AS pe, row_number() OVER (PARTITION BY a.chapter_id, a.block_no ORDER BY a.position DESC) AS k FROM br a JOIN br b ON b.chapter_id = a.chapter_id AND b.block_no + 1 = a.block_no AND b.position = a.position),
t AS (SELECT *, end_ms > start_ms AND pe > ps AS ok, greatest(250, round_even(greatest(pe - ps, end_ms - start_ms) * 0.05, 0)::BIGINT) AS tol, greatest(abs(ps - start_ms), abs(pe - end_ms)) AS err FROM s WHERE k <= 2)
SELECT chapter_id, block_no, round(CASE WHEN bool_or(ok AND err > tol) THEN 0 ELSE coalesce(avg(CASE WHEN ok THEN greatest(0, 1 - err / tol::DOUBLE) END), 0) END, 6) AS agreement FROM t GROUP BY ALL""")
def block_overlap_agreement(spark, sf):
    return quality.overlap_agreement(_block_rows(r.talk_cues(spark, sf))).select("chapter_id", "block_no", F.round("agreement", 6).alias("agreement"))


@query("hypothesis_beam", """WITH h AS (SELECT o_custkey % 100 AS chapter_id, o_custkey AS block_no, o_orderkey AS hyp_no, (o_totalprice::BIGINT % 101) / 100.0 AS score, (o_orderkey % 11) / 10.0 AS coverage, o_orderkey % 5 AS span FROM orders)
SELECT chapter_id, block_no, hyp_no, beam_rank FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, block_no ORDER BY score >= 0.72 DESC, coverage DESC, CASE WHEN score >= 0.72 THEN span ELSE 0 END DESC, score DESC, hyp_no) AS beam_rank FROM h) WHERE beam_rank <= 3""")
def hypothesis_beam(spark, sf):
    rows = r.table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("chapter_id"), F.col("o_custkey").alias("block_no"), F.col("o_orderkey").alias("hyp_no"),
                                               (F.bround("o_totalprice").cast("long") % 101 / 100.0).alias("score"), (F.col("o_orderkey") % 11 / 10.0).alias("coverage"), (F.col("o_orderkey") % 5).alias("span"))
    return quality.beam(rows).select("chapter_id", "block_no", "hyp_no", "beam_rank")


@query("regressive_rows", r.with_sql(r.EVENT_TOKENS) + """,
z AS (SELECT chapter_id, token_pos AS position, CASE WHEN text = 'error' THEN start_ms - 3000 ELSE start_ms END AS start_ms, CASE WHEN text = 'view' THEN start_ms ELSE end_ms END AS end_ms FROM tok),
f AS (SELECT chapter_id, position, end_ms > start_ms AND start_ms >= -250 AS ok, CASE WHEN end_ms > start_ms AND start_ms >= -250 THEN greatest(0, end_ms) ELSE 0 END AS cur FROM z WHERE position = 0
      UNION ALL SELECT z.chapter_id, z.position, z.end_ms > z.start_ms AND z.start_ms >= f.cur - 250, CASE WHEN z.end_ms > z.start_ms AND z.start_ms >= f.cur - 250 THEN greatest(f.cur, z.end_ms) ELSE f.cur END FROM f JOIN z ON z.chapter_id = f.chapter_id AND z.position = f.position + 1)
SELECT chapter_id, position, ok AS accepted FROM f""")
def regressive_rows(spark, sf):
    toks = r.spoken_events(spark, sf)
    rows = toks.select("chapter_id", F.col("token_pos").alias("position"), F.when(F.col("text") == "error", F.col("start_ms") - 3000).otherwise(F.col("start_ms")).alias("start_ms"),
                       F.when(F.col("text") == "view", F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"))
    return quality.split_regressive(rows).select("chapter_id", "position", "accepted")


BLOCK_STATE = """bs AS (SELECT chapter_id, block_no, block_no * 2 AS start_index, block_no * 2 + 4 AS end_index, CASE block_no WHEN 1 THEN 'review' WHEN 2 THEN 'failed' ELSE 'stable' END AS status FROM (SELECT DISTINCT chapter_id, position // 2 AS block_no FROM cue))"""


def _block_state(cues):
    b = F.floor(F.col("position") / 2)
    return cues.select("chapter_id", b.alias("block_no")).distinct().select(
        "chapter_id", "block_no", (F.col("block_no") * 2).alias("start_index"), (F.col("block_no") * 2 + 4).alias("end_index"),
        F.when(F.col("block_no") == 1, "review").when(F.col("block_no") == 2, "failed").otherwise("stable").alias("status"))


@query("consolidated_blocks", r.with_sql(r.TALK, BLOCK_ROWS, BLOCK_STATE) + """,
fl AS (SELECT DISTINCT chapter_id, unnest(range(start_index, end_index)) AS position FROM bs WHERE status = 'failed'),
ow AS (SELECT * FROM (SELECT br.*, bs.status AS b, row_number() OVER (PARTITION BY br.chapter_id, br.position ORDER BY br.block_no) AS k FROM br JOIN bs ON bs.chapter_id = br.chapter_id AND bs.block_no = br.block_no AND bs.status <> 'failed'
       JOIN cue ON cue.chapter_id = br.chapter_id AND cue.position = br.position AND NOT cue.locked WHERE br.end_ms > br.start_ms) WHERE k = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY position) AS i FROM ow),
f AS (SELECT chapter_id, i, true AS ok, greatest(0, end_ms) AS cur FROM n WHERE i = 1 UNION ALL SELECT n.chapter_id, n.i, n.start_ms >= f.cur - 250, CASE WHEN n.start_ms >= f.cur - 250 THEN greatest(f.cur, n.end_ms) ELSE f.cur END FROM f JOIN n ON n.chapter_id = f.chapter_id AND n.i = f.i + 1),
a AS (SELECT n.* FROM n JOIN f ON f.chapter_id = n.chapter_id AND f.i = n.i WHERE f.ok)
SELECT c.chapter_id, c.position, coalesce(a.start_ms, c.start_ms) AS start_ms, coalesce(a.end_ms, c.end_ms) AS end_ms,
  round(CASE WHEN a.position IS NOT NULL THEN CASE WHEN a.b = 'review' THEN least(a.confidence, 0.71) ELSE a.confidence END WHEN fl.position IS NOT NULL AND NOT c.locked AND c.status <> 'unmatched' THEN least(c.confidence, 0.49) ELSE c.confidence END, 6) AS confidence,
  CASE WHEN a.position IS NOT NULL THEN CASE WHEN a.b = 'review' THEN 'low_confidence' ELSE 'auto' END WHEN fl.position IS NOT NULL AND NOT c.locked AND c.status <> 'unmatched' THEN 'low_confidence' ELSE c.status END AS status
FROM cue c LEFT JOIN fl ON fl.chapter_id = c.chapter_id AND fl.position = c.position LEFT JOIN a ON a.chapter_id = c.chapter_id AND a.position = c.position""")
def consolidated_blocks(spark, sf):
    cues = r.talk_cues(spark, sf)
    out = quality.consolidate(cues, _block_state(cues), _block_rows(cues))
    return out.select("chapter_id", "position", "start_ms", "end_ms", F.round("confidence", 6).alias("confidence"), "status")


@query("alignment_summary", r.with_sql(r.TALK, BLOCK_ROWS, BLOCK_STATE) + """,
d AS (SELECT chapter_id, count(DISTINCT position) AS timed_rows FROM br WHERE end_ms > start_ms GROUP BY chapter_id),
v AS (SELECT chapter_id, count(*) AS review_rows FROM (SELECT DISTINCT chapter_id, unnest(range(start_index, end_index)) AS position FROM bs WHERE status IN ('failed', 'review')) GROUP BY chapter_id)
SELECT coalesce(d.chapter_id, v.chapter_id) AS chapter_id, coalesce(timed_rows, 0) AS timed_rows, coalesce(review_rows, 0) AS review_rows FROM d FULL JOIN v ON v.chapter_id = d.chapter_id""")
def alignment_summary(spark, sf):
    cues = r.talk_cues(spark, sf)
    return quality.run_summary(_block_rows(cues), _block_state(cues))


@query("unedited_chapters", r.with_sql(r.TALK) + " SELECT chapter_id, bool_and(origin = 'asr' AND NOT locked AND status IN ('auto', 'low_confidence')) AS unedited FROM cue GROUP BY chapter_id")
def unedited_chapters(spark, sf):
    return quality.unedited_chapters(r.talk_cues(spark, sf))


SAMPLES = "sm AS (SELECT l_suppkey AS chapter_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS sample_no, l_discount * 2 - 0.1 AS value FROM lineitem)"


def _samples(spark, sf):
    from timeweave.ordered import number_rows

    rows = r.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chapter_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_discount") * 2 - 0.1).alias("value"))
    return number_rows(rows, Seq(order=("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")), "sample_no").select("chapter_id", "sample_no", "value")


BASE = SAMPLES + ", ba AS (SELECT chapter_id, sample_no // 4 AS bucket, greatest(-32768, least(32767, floor(min(value) * 32767)))::INT AS min_v, greatest(-32768, least(32767, floor(max(value) * 32767)))::INT AS max_v FROM sm GROUP BY ALL)"


@query("base_buckets", f"WITH {BASE} SELECT chapter_id, bucket, min_v, max_v FROM ba")
def base_buckets(spark, sf):
    return pyramid.base_buckets(_samples(spark, sf), 4)


PYRAMID = BASE + """, pw AS (SELECT chapter_id, greatest(0, ceil(log2((max(bucket) + 1) / 16.0)))::INT AS top FROM ba GROUP BY chapter_id),
py AS (SELECT ba.chapter_id, lv.level, bucket >> lv.level AS bucket, min(min_v) AS min_v, max(max_v) AS max_v FROM ba JOIN pw ON pw.chapter_id = ba.chapter_id JOIN (SELECT unnest(range(0, 40))::INT AS level) lv ON lv.level <= top GROUP BY ALL)"""


@query("time_pyramid", f"WITH {PYRAMID} SELECT chapter_id, level, bucket, min_v, max_v FROM py")
def time_pyramid(spark, sf):
    return pyramid.pyramid(pyramid.base_buckets(_samples(spark, sf), 4), stop=16)


@query("pyramid_range", f"WITH {PYRAMID} SELECT chapter_id, level, bucket, min_v, max_v FROM py WHERE level = 2 AND bucket BETWEEN 2 AND 24")
def pyramid_range(spark, sf):
    return pyramid.read_range(pyramid.pyramid(pyramid.base_buckets(_samples(spark, sf), 4), stop=16), 10, 100, 20)


@query("band_pyramid", """WITH b AS (SELECT user_id AS chapter_id, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS bucket, event_type AS band, max(value) AS value FROM events GROUP BY ALL),
w AS (SELECT chapter_id, greatest(0, ceil(log2((max(bucket) + 1) / 64.0)))::INT AS top FROM b GROUP BY chapter_id)
SELECT b.chapter_id, lv.level, bucket >> lv.level AS bucket, band, max(value) AS value FROM b JOIN w ON w.chapter_id = b.chapter_id JOIN (SELECT unnest(range(0, 40))::INT AS level) lv ON lv.level <= top GROUP BY ALL""")
def band_pyramid(spark, sf):
    hours = F.floor((F.expr(r.MILLIS) - F.lit(1_704_067_200_000)) / 3_600_000)
    events = r.table(spark, sf, "events")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // pyramid.TASK_CELLS))
    rows = events.select(F.col("user_id").alias("chapter_id"), hours.alias("bucket"), F.col("event_type").alias("band"), "value")
    bands = rows.repartition(tasks, "chapter_id", "bucket", "band").groupBy("chapter_id", "bucket", "band").agg(F.max("value").alias("value"))
    return pyramid.max_pyramid(bands, stop=64)
