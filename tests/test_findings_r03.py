"""Cases of the findings of the third round."""

import compare
import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def same_as_sql(spark, folder, table, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    left, right = compare.rows_of_spark(QUERIES[name](spark, str(folder))), compare.rows_of_sql(con, SQL[name])
    assert left == right, compare.difference(left[1], right[1])


def test_chapter_numbers_of_many_digits(spark, tmp_path):
    spark.range(9_998, 10_002).unionByName(spark.range(99_999, 100_002)).unionByName(spark.range(5)).withColumnRenamed(
        "id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    same_as_sql(spark, tmp_path, "part", "chapter_numbers")


@pytest.mark.parametrize("name", ["page_texts", "page_titles", "whole_pages"])
def test_open_references_as_in_sql(spark, tmp_path, name):
    html = "<html><head><title>a &amp;&amp</title></head><body><h1>A&amp;&amp</h1><p>x &ltb &amp;amp; &#39; &quo</p></body></html>"
    spark.createDataFrame([(1, "http://a/b", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_as_sql(spark, tmp_path, "pages", name)


def test_units_dealt_by_chapter_match_alike(spark):
    """The same pairs as the rounds that move their rows, and every round's table in buckets of the chapter."""
    import random

    from timeweave.operators import matching
    from timeweave.session import cut_by

    random.seed(3)
    rows = []
    for chapter in range(30):
        units = [random.choice("abcdefghijklmnop") * random.randint(1, 6) for _ in range(random.randint(0, 120))]
        heard = [unit for unit in units if random.random() > 0.2]
        heard = heard[20:] + heard[:20] if chapter % 3 == 0 else heard
        rows += [(side, chapter, 0, at, unit) for side, words in ((0, units), (1, heard)) for at, unit in enumerate(words)]
    both = spark.createDataFrame(rows, "side int, chapter_id long, bracket long, at long, unit string")
    side = lambda n: both.filter(f"side = {n}").select("chapter_id", "at", "unit")
    cut = cut_by("chapter_id", 5)
    found = matching.match_sides(cut(both), cut=cut)
    assert sorted(found.collect()) == sorted(matching.monotone_match(side(0), side(1)).collect())
    assert "Bucketed: true" in found.groupBy("chapter_id").count()._jdf.queryExecution().executedPlan().toString()


def test_exact_passages_have_one_long_seed(spark):
    import numpy as np

    from timeweave.operators import edits, location

    assert location.seeds_of(200, 1.0) == (32, 1, 1) and location.seeds_of(9, 1.0) == (9, 1, 1)
    text = np.array([ord(c) for c in "abcabcabcd" * 9], np.uint32)
    for size in (1, 3, 6, 7, 32, 90, 91):
        same = {}
        for at, h in enumerate(location.gram_hashes(text, size).tolist()):
            same.setdefault(h, set()).add(bytes(text[at:at + size]))
        assert sum(map(len, same.values())) == len(same) == len({bytes(text[i:i + size]) for i in range(91 - size)})
    docs = spark.createDataFrame([(1, "x" + "lorem ipsum " * 9), (2, "lorem"), (3, "nothing")], "doc_id long, text string")
    cues = spark.createDataFrame([(1, "ipsum lorem " * 4), (2, "em"), (3, "!")], "item_id long, text string")
    assert sorted(map(tuple, edits.page_hits(cues, docs).collect())) == [(1, 1, 6), (2, 1, 4), (2, 2, 3)]


def test_fused_units_stay_in_their_buckets(spark):
    from timeweave.operators import matching
    from timeweave.session import cut_by

    rows = [(chapter, at, at // 7, "ab"[at % 2] * (1 + at % 3)) for chapter in range(9) for at in range(40)]
    units = spark.createDataFrame(rows, "chapter_id long, at long, position long, unit string")
    cut = cut_by("chapter_id", 4)
    found = cut(matching.fused_splits(cut(units)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, matching.fused_splits(units).collect()))


def test_percentile_of_huge_groups_sends_none_to_one_task(spark):
    from pyspark.sql import functions as F

    from timeweave.operators import silence

    rows = spark.range(6_000).select((F.col("id") % 2).alias("chapter_id"), (F.col("id") * 7919 % 6007 / 3.0).alias("rms"))
    found = silence.exact_percentile(rows, "rms", 0.18, "threshold")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    wanted = rows.groupBy("chapter_id").agg(F.percentile("rms", 0.18).alias("threshold"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_seeds_sent_and_joined_find_alike(spark, monkeypatch):
    from timeweave.operators import location

    docs = spark.createDataFrame([(i, "the quick brown fox jumps over a lazy dog and runs " * (i % 3) + f"far away {i} " * 9) for i in range(12)], "doc_id long, text string")
    passages = spark.createDataFrame([(1, "quick brown fox jumps ovr a lazy dog"), (2, "far away 5 far awai 5"), (3, "lazy"), (4, "dog and runs the quick brown")], "item_id long, text string")
    sent = sorted(map(tuple, location.locate_passages(passages, docs).collect()))
    monkeypatch.setattr(location, "SENT_SEEDS", 0)
    assert sent and sent == sorted(map(tuple, location.locate_passages(passages, docs).collect()))


def test_offsets_of_many_blocks(spark):
    """Arrays above one part are summed along alike, and a line of many short sentences isn't copied for each of them."""
    import time

    from pyspark.sql import functions as F

    from timeweave.functions import sentences
    from timeweave.functions.text import running_starts

    for n in (0, 1, 256, 257, 1_000):
        found = spark.range(1).select(running_starts(F.lit([i % 7 for i in range(n)]) if n else F.expr("array()").cast("array<int>")).alias("s")).first().s
        assert found == [sum(i % 7 for i in range(k)) for k in range(n)]
    text = "Some words here. ... " * 6_000
    rows = spark.createDataFrame([(text,)], "text string")
    rows.select(F.size(sentences.split_sentences(F.col("text")))).first()
    began = time.monotonic()
    found = rows.select(sentences.split_sentences(F.col("text")).alias("s")).first().s
    assert time.monotonic() - began < 30
    assert len(found) == 6_000 and all(s.text == "Some words here...." for s in found)
    assert [s.start_char for s in found] == [21 * i for i in range(6_000)] and [s.end_char for s in found] == [21 * i + 20 for i in range(6_000)]


def test_merged_chunks_are_joined_once(spark):
    """The kept tokens are read from their written copy, not joined again to be measured and to be numbered."""
    from timeweave.operators import transcript

    chunks = spark.createDataFrame([(1, 0, 0, 0, 100), (1, 1, 100, 100, 200)],
                                   "run_id long, position long, source_start_ms long, core_start_ms long, core_end_ms long")
    toks = spark.createDataFrame([(1, 0, 0, 10, 20), (1, 0, 1, 150, 160), (1, 1, 0, 30, 50)],
                                 "run_id long, chunk_position long, token_pos long, start_ms long, end_ms long")
    out = transcript.merge_chunks(toks, chunks)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((x.position, x.start_ms, x.end_ms) for x in out.collect()) == [(0, 10, 20), (1, 130, 150)]


def test_pages_are_taken_in_turn(spark):
    """As by one chapter after another, with copies, near copies, short texts and pages wanted by many."""
    import random

    from timeweave.operators import mapping

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    random.seed(8)
    word = lambda: "".join(random.choices("abcdefgh", k=5))
    base = ["".join(word() for _ in range(n)) for n in (4, 6, 30, 34, 40, 44)]

    def edited(text, n):
        for _ in range(n):
            at = random.randrange(len(text))
            text = text[:at] + random.choice("xyz") + text[at + random.randint(0, 1):]
        return text

    texts = [edited(random.choice(base), random.choice((0, 0, 2, 7, 12))) for _ in range(26)]
    # The second chapter loses its page to the first and comes before the third, which wants its next best.
    texts += ["k" * 10 + base[2], "k" * 10 + base[2], edited(base[2], 1) + "k" * 10]
    pages = [edited(t, random.choice((0, 1, 3, 10))) for t in texts if random.random() < 0.9]
    ch = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)], "book_id long, chapter_id long, position long, text string")
    pg = spark.createDataFrame([(1, 100 + i, i, t) for i, t in enumerate(pages)], "book_id long, page_id long, spine_pos long, text string")
    wanted, unused = {}, dict(enumerate(pages))
    for i, text in enumerate(texts):
        same = [j for j, page in unused.items() if page == text]
        if same:
            wanted[i] = unused.pop(same[0]) and 100 + same[0]
    for i, text in enumerate(texts):
        grams = {text[k:k + 16] for k in range(len(text) - 15)}
        rated = [(1 - distance(text, p) / max(len(text), len(p)), -j) for j, p in unused.items() if i not in wanted and any(p[k:k + 16] in grams for k in range(len(p) - 15))]
        if rated and max(rated)[0] >= 0.45:
            wanted[i] = 100 - max(rated)[1]
            del unused[-max(rated)[1]]
    assert {r.chapter_id: r.page_id for r in mapping.match_pages(ch, pg).collect()} == wanted


def test_chapters_wait_for_earlier_ones(spark):
    """A page goes to the earliest chapter that is left with it, though a later one asks for it first."""
    import random

    from timeweave.operators import mapping

    random.seed(1)
    text = "".join(random.choices("abcdefghij", k=400))
    other = "".join(random.choices("klmnop", k=40))
    ch = spark.createDataFrame([(1, i, i, t) for i, t in enumerate((text, text, text[:-40] + other))], "book_id long, chapter_id long, position long, text string")
    pg = spark.createDataFrame([(1, 10, 0, "z" + text), (1, 11, 1, text[:-40] + other + "z")], "book_id long, page_id long, spine_pos long, text string")
    assert {(r.chapter_id, r.page_id) for r in mapping.match_pages(ch, pg).collect()} == {(0, 10), (1, 11)}


@pytest.mark.parametrize("name", ["bounded_tokens", "token_sentences", "token_blocks"])
def test_events_before_1970_as_in_sql(spark, tmp_path, name):
    spark.range(400).selectExpr(
        "id AS event_id", "cast(timestamp_ntz'1969-12-28 00:00:00.000500' + make_dt_interval(0, 0, id * 17, id * 7.31 % 60) AS timestamp_ntz) AS ts", "id % 3 AS user_id",
        "element_at(array('view', 'click', 'purchase'), cast(id * 7 % 3 + 1 AS int)) AS event_type", "id * 13 % 50 + 0.5D AS value", "concat('{\"k\": ', id % 90, '}') AS props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, tmp_path, "events", name)


def test_title_scores_of_equal_and_of_dear_titles(spark, tmp_path):
    """A title against itself costs nothing, and the pairs are not put into few tasks for being few bytes."""
    import time

    from pyspark.sql import functions as F

    from timeweave.functions.titles import similarity

    rows = spark.createDataFrame([("ab" * 60_000,)], "a string").withColumn("b", F.concat("a", F.lit("")))
    began = time.monotonic()
    assert rows.select(similarity(F.col("a"), F.col("b")).alias("s")).first().s == 1.0
    assert time.monotonic() - began < 10
    docs = [(i, f"title {i * 7919 % 101} {'x' * (i % 9)}\nbody", f"s{i % 2}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["title_scores"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    same_as_sql(spark, tmp_path, "documents", "title_scores")


def test_crossing_blocks_are_solved_in_batches(spark):
    """The chains of brute force, by one call a batch and with nothing run twice."""
    import itertools
    import random

    from timeweave.operators import matching
    from timeweave.ordered import Seq

    random.seed(4)
    sides = {chapter: random.sample(range(9), 9) for chapter in range(40)}
    pairs = spark.createDataFrame([(c, a, b) for c, bs in sides.items() for a, b in enumerate(bs)], "chapter_id long, a long, b long")
    chain = matching.heaviest_chain(pairs, Seq(order=("a",)))
    plan = chain._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Window" not in plan
    found = {}
    for row in sorted(chain.collect()):
        found.setdefault(row.chapter_id, []).append(row.b)
        assert sides[row.chapter_id][row.a] == row.b
    for chapter, bs in sides.items():
        longest = max(n for n in range(1, 10) for some in itertools.combinations(bs, n) if list(some) == sorted(some))
        assert found[chapter] == sorted(found[chapter]) and len(found[chapter]) == longest


def test_pyramid_tasks_are_bounded(spark, monkeypatch):
    """More cells make more tasks, and no cell of any level is met by two of them."""
    from timeweave.operators import pyramid

    monkeypatch.setattr(pyramid, "TASK_CELLS", 40)
    rows = [(chapter, bucket, band, (bucket * 37 + chapter) % 101) for chapter in range(3) for bucket in range(0, 130, 1 + chapter) for band in "ab"]
    found = pyramid.max_pyramid(spark.createDataFrame(rows, "chapter_id long, bucket long, band string, value long"), stop=16)
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {}
    for chapter, bucket, band, value in rows:
        for level in range(5):  # 129 or 130 buckets are halved four times
            key = chapter, level, bucket >> level, band
            wanted[key] = max(wanted.get(key, 0), value)
    assert {(r.chapter_id, r.level, r.bucket, r.band): r.value for r in found.collect()} == wanted
    assert found.count() == len(wanted)


def test_merges_look_up_only_new_neighbours():
    from timeweave.llm import sentence_pieces

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    pieces = sentence_pieces.Pieces(sentence_pieces.load_model())
    own = pieces.text_of.index
    pieces.rank = Counted(pieces.rank)
    assert pieces.stays_apart(sentence_pieces.START, own("▁international")) and pieces.rank.asked <= 3 * len("▁international")
    assert not pieces.stays_apart(own("▁th"), own("e")) and pieces.stays_apart(own("▁the"), own("▁international"))


@pytest.mark.parametrize("rule", ["plain", "forced", "last wins", "texts"])
def test_cursors_in_tasks_take_what_column_scores_take(spark, monkeypatch, rule):
    """the same rows and the very same scores, over many blocks and pieces."""
    import random

    from timeweave import cursors, transfers
    from timeweave.functions.titles import similarity
    from timeweave.operators import mapping

    for name, value in (("PIECE", 4), ("FAN", 3)):
        monkeypatch.setattr(transfers, name, value)
    monkeypatch.setattr(mapping, "BLOCK_LEFT", 4)
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abé", k=rng.choice([0, 2, 3, 40])))
    sizes = {0: (30, 60), 1: (24, 30), 2: (3, 9), 3: (9, 1)}
    rows = {side: [(g, i, word(), rng.choice(["", "1", "2"]), rng.choice([0, 400, 9000]) * (1, 250)[side], n[0] - i)
                   for g, n in sizes.items() for i in range(n[side])] for side in (0, 1)}
    left = spark.createDataFrame(rows[0], "book_id long, rank long, key string, number string, text_length long, left_after long")
    right = spark.createDataFrame(rows[1], "book_id long, ord long, key string, number string, duration_ms long, x long").drop("x")
    if rule == "texts":
        found = [mapping.cursor_match(left, right, 3, threshold=0.35, **how) for how in (
            {"score": lambda a, b: similarity(a["key"], b["key"])}, {"chooser": cursors.text_chooser})]
    else:
        options = {"plain": {}, "forced": {"forced": True}, "last wins": {"last_wins": True}}[rule]
        found = [mapping.cursor_match(left, right, 3, **how, **options) for how in ({"score": mapping.match_score}, {"chooser": cursors.link_chooser, "span": 2})]
    want, got = (sorted(tuple(r) for r in df.select("book_id", "rank", "ord", "score").collect()) for df in found)
    assert want and got == want


def test_whole_distances_only_without_a_near_text(monkeypatch):
    """a text among those that follow is found without filling a table; distances are exact."""
    import random

    import numpy as np

    from timeweave import cursors

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choices("abé", k=rng.randint(0, 40)))
        b = "".join(c if rng.random() < 0.9 else rng.choice(["", "a", "bé"]) for c in a) if rng.random() < 0.7 else "".join(rng.choices("abé", k=rng.randint(0, 40)))
        want, most = table(a, b), rng.randint(0, 12)
        assert cursors.distance(a, b) == want
        assert cursors.close_distance(a, b, most) == (want if want <= most else None)
        points = np.frombuffer(b.encode("utf-32-le"), np.uint32)
        assert cursors.distances(np.frombuffer(a.encode("utf-32-le"), np.uint32), points[:, None], np.array([len(b)])).tolist() == [want]
    texts = ["".join(rng.choices("abcdefgh", k=rng.randint(300, 400))) for _ in range(30)]
    near = [t[:50] + "x" + t[60 - rng.randint(0, 8):] for t in texts]
    whole = []
    monkeypatch.setattr(cursors, "distance", lambda a, b: whole.append(1) or table(a, b))
    choose = cursors.text_chooser({"key": texts}, {"key": near}, False)
    taken = cursors.walk(choose, 30, 0, 29, 8, 0.35, None)
    assert [(row, at) for row, at, _ in taken] == [(i, i) for i in range(30)] and len(whole) <= 8
    assert [score for *_, score in taken] == [1 - table(a, b) / max(len(a), len(b)) for a, b in zip(texts, near)]


def test_entries_far_from_the_straight_line_need_few_rounds(spark):
    """cursors that reach the end at a third of the blocks; the line is guessed from where cursors go."""
    from pyspark.sql import functions as F

    from timeweave import transfers

    last, n = 4_000, 200
    blocks = spark.range(n).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("__block"))
    sizes = spark.createDataFrame([(0, n, last)], "g long, blocks long, last long")
    asked_pieces = []

    def maps(asked):
        asked_pieces.append(asked.count())
        first = F.col("piece") * transfers.PIECE
        step = lambda e: F.when(e > last, e).otherwise(F.least(F.lit(last + 1), e + 55 + (F.col("__block") * 7 + F.floor(e / 5)) % 12)).cast("long")
        return asked.withColumn("exits", F.transform(F.sequence(first, first + transfers.PIECE - 1), step))

    found, rounds = transfers.entries(blocks, sizes, "g", 80, maps, probe=True)
    want, entry = [], 0
    for block in range(n):
        want.append((block, entry))
        entry = entry if entry > last else min(last + 1, entry + 55 + (block * 7 + entry // 5) % 12)
    assert sorted((r["__block"], r["entry"]) for r in found.collect()) == want and rounds <= 2
