"""The ordered primitives against sequential Python, with and without blocks."""

import random

import pytest
from pyspark.sql import functions as F

from timeweave.functions.text import spoken_units  # noqa: F401
from timeweave.intervals import asof_join, overlap_join, point_join
from timeweave.operators import matching, planning, quality, silence, timeline
from timeweave.operators.mapping import cursor_match
from timeweave.ordered import CHAPTER, Agg, Seq, number_rows, prepare, prev, scan

CUE = "chapter_id long, position long, text string, start_ms long, end_ms long, confidence double, status string, locked boolean, origin string, segment_id long"


def cues(spark, rows):
    full = [(c, p, t, s, e, 0.8, st, lk, "source", c * 1000 + p) for c, p, t, s, e, st, lk in rows]
    return spark.createDataFrame(full, CUE)


def random_cues(seed, chapters=3, n=17):
    rng = random.Random(seed)
    rows = []
    for c in range(chapters):
        for p in range(n):
            s = rng.randint(0, 40) * 100
            e = s + rng.choice([0, 0, 100, 700, 1500])
            rows.append((c, p, "ab cd " * rng.randint(1, 4), s, e, "auto" if e > s else "unmatched", rng.random() < 0.1))
    rng.shuffle(rows)
    return rows


def by_key(rows):
    return {(r[0], r[1]): r[2:] for r in rows}


def test_scan_and_numbers(spark, blocks):
    rows = [(g, p, (p * 7 + g) % 5) for g in range(2) for p in range(20)]
    df = spark.createDataFrame(rows, "chapter_id long, position long, v long")
    df, seq = prepare(df, CHAPTER)
    assert (seq.width is not None) == (blocks is not None)
    out = scan(df, seq, {"total": Agg("sum", F.col("v")), "before": prev("v")}, {"after": prev("v"), "low": Agg("min", F.col("v"))})
    for r in out.collect():
        vs = [v for g, p, v in sorted(rows) if g == r.chapter_id]
        i = r.position
        assert r.total == sum(vs[: i + 1])
        assert (r.before.v if r.before else None) == (vs[i - 1] if i else None)
        assert (r.after.v if r.after else None) == (vs[i + 1] if i < 19 else None)
        assert r.low == min(vs[i:])
    assert number_rows(spark.createDataFrame(rows, "chapter_id long, position long, v long"), CHAPTER, "k").filter("k <> position").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_monotonic_conflict_regressive(spark, blocks, seed):
    rows = random_cues(seed)
    df = cues(spark, rows)
    mono = by_key(timeline.enforce_monotonic(df).select("chapter_id", "position", "start_ms", "end_ms").collect())
    clash = by_key(timeline.flag_conflicts(df).select("chapter_id", "position", "conflict").collect())
    kept = by_key(quality.split_regressive(df).select("chapter_id", "position", "accepted").collect())
    for c in range(3):
        cursor, confirmed = 0, 0
        chapter = sorted(r for r in rows if r[0] == c)
        live = [r for r in chapter if r[4] > r[3]]
        for _, p, _, s, e, _, _ in chapter:
            start = max(cursor, s)
            cursor = max(start, e)
            assert mono[c, p] == (start, cursor)
            before = [x for x in live if x[1] < p][-1:]
            after = [x for x in live if x[1] > p][:1]
            want = e > s and (any(x[4] > s for x in before) or any(e > x[3] for x in after))
            assert clash[c, p] == (want,)
            ok = e > s and s >= confirmed - 250
            assert kept[c, p] == (ok,)
            if ok:
                confirmed = max(confirmed, e)


@pytest.mark.parametrize("seed", [3, 4])
def test_key_silence_thinning(spark, blocks, seed):
    rng = random.Random(seed)
    rows = [(0, i, t, rng.random(), t - rng.randint(200, 500), t + rng.randint(200, 500)) for i, t in enumerate(sorted(rng.sample(range(0, 20000), 25)))]
    df = spark.createDataFrame(rows, "chapter_id long, position long, time_ms long, score double, start_ms long, end_ms long")
    got = [r.time_ms for r in silence.key_silences(df).orderBy("time_ms").collect()]
    chosen = []
    for r in rows:
        length = r[5] - r[4]
        if not (length >= 525 or (length >= 350 and r[3] >= 0.78)):
            continue
        if not chosen or r[2] - chosen[-1][2] >= 800:
            chosen.append(r)
        elif r[3] * length > chosen[-1][3] * (chosen[-1][5] - chosen[-1][4]):
            chosen[-1] = r
    assert got == [r[2] for r in chosen]


def test_gap_fill_sequential(spark, blocks):
    rng = random.Random(9)
    rows = []
    for c in range(4):
        at = 0
        for p in range(14):
            live = p in (0, 13) or rng.random() < 0.35
            if live:
                at += rng.choice([2, 30, 900])
            rows.append((c, p, "word " * rng.randint(1, 5), at if live else 0, at + 50 if live else 0, "auto" if live else "unmatched", False))
            at += 50 if live else 0
    got = by_key(timeline.fill_gaps(cues(spark, rows)).select("chapter_id", "position", "start_ms", "end_ms").collect())
    for c in range(4):
        chapter = sorted(r for r in rows if r[0] == c)
        want = {r[1]: (r[3], r[4]) for r in chapter}
        i = 0
        while i < len(chapter):
            if chapter[i][4] > chapter[i][3]:
                i += 1
                continue
            j = i
            while chapter[j][4] <= chapter[j][3]:
                j += 1
            lo, hi = chapter[i - 1][4], chapter[j][3]
            run = chapter[i:j]
            weights = [len(r[2].split()) for r in run]
            if hi - lo >= len(run):
                cursor, cum = lo, 0
                for k, w in enumerate(weights):
                    cum += w
                    target = hi if k == len(run) - 1 else lo + round((hi - lo) * cum / sum(weights))
                    end = max(cursor + 1, min(hi - (len(run) - k - 1), target))
                    want[run[k][1]] = (cursor, end)
                    cursor = end
            i = j
        for p, span in want.items():
            assert got[c, p] == span


def test_interval_joins(spark):
    rng = random.Random(5)
    spans = [(g, i, s, s + rng.choice([1, 900, 250_000])) for g in range(2) for i, s in enumerate(rng.sample(range(0, 300_000), 12))]
    points = [(g, t) for g in range(2) for t in rng.sample(range(0, 500_000), 15)]
    a = spark.createDataFrame(spans, "g long, i long, s long, e long")
    b = spark.createDataFrame([(g, i, s, e) for g, i, s, e in spans], "g long, j long, s2 long, e2 long")
    p = spark.createDataFrame(points, "g long, t long")
    got = {tuple(r) for r in overlap_join(a, b, ["g"], ("s", "e"), ("s2", "e2")).select("g", "i", "j").collect()}
    assert got == {(x[0], x[1], y[1]) for x in spans for y in spans if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    inside = sorted(tuple(r) for r in point_join(p, a, ["g"], "t", ("s", "e")).select("g", "t", "i").collect())
    assert inside == sorted((g, t, i) for g, t in points for h, i, s, e in spans if g == h and s <= t < e)


def test_asof_both_ways(spark, blocks):
    left = [(0, t) for t in range(0, 100, 7)]
    right = [(0, t, t * 10) for t in range(3, 100, 11)]
    a = spark.createDataFrame(left, "g long, t long")
    b = spark.createDataFrame(right, "g long, u long, v long")
    back = {r.t: (r.hit.u if r.hit else None) for r in asof_join(a, b, ("g",), "t", "u", ["v"]).collect()}
    fore = {r.t: (r.hit.u if r.hit else None) for r in asof_join(a, b, ("g",), "t", "u", ["v"], backward=False).collect()}
    for _, t in left:
        assert back[t] == max((u for _, u, _ in right if u <= t), default=None)
        assert fore[t] == min((u for _, u, _ in right if u >= t), default=None)


def test_chunk_plan_blocks_agree(spark):
    rng = random.Random(11)
    pauses = [(1, t) for t in sorted(rng.sample(range(0, 2_000_000), 60))]
    sil = spark.createDataFrame(pauses, "audio_id long, time_ms long")
    spans = spark.createDataFrame([(1, 0, 2_000_000)], "audio_id long, from_ms long, to_ms long")
    small = sorted(tuple(r) for r in planning.plan_chunks(spans, sil, block_ms=200_000).collect())
    large = sorted(tuple(r) for r in planning.plan_chunks(spans, sil, block_ms=10_000_000).collect())
    cuts, cursor = [0], 0
    while 2_000_000 - cursor > 180_000:
        options = [t for _, t in pauses if 20_000 < t < 1_980_000 and cursor + 60_000 <= t <= cursor + 180_000]
        cursor = min(options, key=lambda t: abs(t - cursor - 120_000)) if options else cursor + 180_000
        cuts.append(cursor)
    assert small == large and [r[4] for r in small] == cuts


def serial_cursor(left, right, reach, score, threshold=None, left_after=None, last_wins=False):
    """The rule row by row: (rank, ord) pairs."""
    found, cursor = [], 0
    for i, v in enumerate(left):
        if cursor >= len(right):
            break
        options = range(cursor, min(len(right), cursor + reach))
        best = max(options, key=lambda j: (score(v, right[j]), j if last_wins else -j))
        if left_after is not None and len(right) - cursor == left_after[i]:
            best = cursor
        elif threshold is not None and score(v, right[best]) < threshold:
            continue
        found.append((i, best))
        cursor = best + 1
    return found


@pytest.mark.parametrize("rule", ["threshold", "always", "forced", "last wins"])
def test_cursor_match_crosses_blocks(spark, monkeypatch, rule):
    from timeweave import transfers
    from timeweave.operators import mapping

    for name, value in (("PIECE", 4), ("FAN", 3)):
        monkeypatch.setattr(transfers, name, value)
    monkeypatch.setattr(mapping, "BLOCK_LEFT", 4)
    rng = random.Random(12)
    data = {}
    for g, shape in enumerate(["even", "drifting", "jump", "few right", "ties", "short"]):
        spread = 3 if shape == "ties" else 30
        left = [rng.randint(0, spread) for _ in range(3 if shape == "short" else 90)]
        right = {"drifting": [w for v in left for w in (rng.randint(0, spread), v)], "jump": left[:20] + [99] * 150 + left[20:],
                 "few right": left[:30], "ties": [rng.randint(0, spread) for _ in left]}.get(shape, left)
        data[g] = left, right, [len(left) - i for i in range(len(left))]
    rows = lambda side: [(g, i, v, n[i] if side == 0 else 0) for g, (*sides, n) in data.items() for i, v in enumerate(sides[side])]
    left = spark.createDataFrame(rows(0), "g long, rank long, v long, left_after long")
    right = spark.createDataFrame(rows(1), "g long, ord long, v long, x long").drop("x")
    score = lambda a, b: 1 - F.abs(a["v"] - b["v"]) / 30.0
    options = {"threshold": {"threshold": 0.6}, "always": {}, "forced": {"forced": True}, "last wins": {"last_wins": True}}[rule]
    got = sorted((r.g, r.rank, r.ord) for r in cursor_match(left, right, 3, score, group="g", **options).collect())
    want = []
    for g, (a, b, n) in data.items():
        found = serial_cursor(a, b, 3, lambda x, y: 1 - abs(x - y) / 30.0, options.get("threshold"), n if rule == "forced" else None, rule == "last wins")
        want += [(g, i, j) for i, j in found]
    assert got == want


@pytest.mark.parametrize("n", [100, 1000])
def test_transfer_maps_settle_in_few_rounds(spark, n):
    """Blocks whose exits follow from their entries by a rule with drift and jumps."""
    from timeweave import transfers

    last = 12 * n
    move = lambda block, entry: min(last + 1, entry + 3 + (7 * block + entry // 5) % 4 + (40 if block % 97 == 50 else 0))
    blocks = spark.range(n).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("__block"))
    sizes = spark.createDataFrame([(0, n, last)], "g long, blocks long, last long")

    def maps(asked):
        first = F.col("piece") * transfers.PIECE
        step = lambda e: F.least(F.lit(last + 1), e + 3 + (F.col("__block") * 7 + F.floor(e / 5)) % 4 + F.when(F.col("__block") % 97 == 50, 40).otherwise(0)).cast("long")
        return asked.withColumn("exits", F.transform(F.sequence(first, first + transfers.PIECE - 1), step))

    found, rounds = transfers.entries(blocks, sizes, "g", 43, maps)
    want, entry = [], 0
    for block in range(n):
        want.append((block, entry))
        entry = move(block, entry)
    assert sorted((r["__block"], r.entry) for r in found.collect()) == want
    assert rounds < 10


def test_monotone_match_never_crosses(spark, blocks):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 25)}" if rng.random() < 0.4 else f"unique{i}" for i in range(60)]
    heard = [w for i, w in enumerate(words) if i % 6 != 4]
    a = spark.createDataFrame([(0, i, w) for i, w in enumerate(words)], "chapter_id long, at long, unit string")
    b = spark.createDataFrame([(0, i, w) for i, w in enumerate(heard)], "chapter_id long, at long, unit string")
    pairs = sorted((r.a, r.b) for r in matching.monotone_match(a, b).collect())
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert all(words[x] == heard[y] for x, y in pairs) and len(pairs) >= 0.8 * len(heard)


@pytest.mark.parametrize("shape", ["outlier", "ties", "giant"])
def test_blocks_are_even_whatever_the_order_looks_like(spark, shape):
    from timeweave import ordered

    place = {"outlier": F.when(F.col("id") == 7, F.lit(10 ** 12)).otherwise(F.col("id")), "ties": F.lit(0), "giant": F.col("id")}[shape]
    group = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)) if shape == "giant" else F.lit(1)
    rows = spark.range(4000).select(group.cast("long").alias("chapter_id"), place.cast("long").alias("position"), F.lpad(F.col("id").cast("string"), 6, "0").alias("name"))
    spark.conf.set(ordered.ROWS_SETTING, "400")
    try:
        df, seq = ordered.prepare(rows, ordered.Seq(order=("position", "name")))
        assert df.groupBy(*seq.keys).count().agg(F.max("count")).first()[0] <= 800
        found = {r.name: r.n for r in ordered.number_rows(rows, ordered.Seq(order=("position", "name")), "n").collect()}
    finally:
        spark.conf.unset(ordered.ROWS_SETTING)
    want, counts = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.chapter_id, r.position, r.name)):
        want[r.name] = counts[r.chapter_id] = counts.get(r.chapter_id, -1) + 1
    assert found == want


def test_smallest_containing_equals_brute_force(spark):
    from timeweave.sweeps import smallest_containing

    rng = random.Random(4)
    spans = [(rng.choice("ab"), s, s + rng.randrange(0, 30), rng.randrange(3)) for s in (rng.randrange(100) for _ in range(120))]
    spans += [("a", 5, 2, 0), ("c", 0, 1000, 0), ("c", 10, 20, 1), ("c", 12, 14, 2)]
    points = [(g, i, p) for i, (g, p) in enumerate((g, p) for g in "abcd" for p in range(-5, 140, 3))]
    want = {}
    for g, i, p in points:
        around = [(e - s, s, v) for h, s, e, v in spans if h == g and s <= p <= e]
        if around:
            want[g, i] = min(around)
    p = spark.createDataFrame([*points, (None, 900, 5), ("a", 901, None)], "g string, i int, p long")
    s = spark.createDataFrame([*spans, (None, 0, 9, 1)], "g string, s long, e long, v int")
    found = {(r.g, r.i): (r.hit.e - r.hit.s, r.hit.s, r.hit.v) for r in smallest_containing(p, s, "g", "i", "p", ("s", "e"), "hit").collect()}
    assert found == want
