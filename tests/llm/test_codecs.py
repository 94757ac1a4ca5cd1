"""Byte-level BPE, fill-in-middle and hard negatives: the library, round trips and brute force."""

import base64
import hashlib
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from timeweave.llm import byte_bpe, fill_in_middle, hard_negatives

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MODEL = byte_bpe.load_model()
CODEC = byte_bpe.Codec(*MODEL)
PIECES = ["a", "b", "e", "the", "in", " ", "  ", "\n", "\t", "é", "ß", "日本", "👍", "‍", "-", "=", "Ã", "Â", "0", "1", "'s", "'", ".", "\x1c", "\x85", "ª", "²", "́"]


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


# 11. byte-level BPE

@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PIECES), max_size=60).map("".join)))
def test_tokens_equal_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert CODEC.encode(text) == packed(LIBRARY.encode_ordinary(text))
    assert CODEC.decode(CODEC.encode(text)) == text


@pytest.mark.parametrize("match", ["a" * 3000, "-" * 2001, " " * 999, "ab" * 1500, "ÃÂ" * 301, "the" * 900])
def test_one_very_long_match(match):
    assert CODEC.machine.encode(match.encode()) == packed(LIBRARY._encode_single_piece(match))


def test_small_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST_STATES", 20)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(byte_bpe, "MATCHES", 3)
    rng, codec = random.Random(5), byte_bpe.Codec(*MODEL)
    for _ in range(60):
        text = "".join(rng.choice(PIECES) for _ in range(80))
        assert codec.encode(text) == packed(LIBRARY.encode_ordinary(text))


def test_a_match_that_merging_does_not_reach_is_still_its_token():
    tokens = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"bcd": 299}
    # "bcd" comes from bc + d; "abc" from ab + c, as ab ranks first; "xbc" has no token of its own
    machine = byte_bpe.Transducer(tokens | {b"bcab": 301, b"cabd": 302})
    own = tiktoken.Encoding("own", pat_str=r"\w+|\W+", mergeable_ranks=tokens | {b"bcab": 301, b"cabd": 302}, special_tokens={})
    for text in ("abc", "abcd", "cabd", "bcab", "bcabd", "xbcabcabd", "cabdcabd", "aabbcc"):
        assert machine.encode(text.encode()) == packed(own.encode_ordinary(text)), text


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=12), st.lists(st.integers(1, 4), max_size=12))
def test_streamed_decoding_replaces_what_is_no_utf8(data, sizes):
    parts, at = [], 0
    for size in [*sizes, len(data)]:
        parts.append(data[at:at + size])
        at += size
    stream = byte_bpe.StreamDecoder(dict(enumerate(parts)))
    assert "".join([stream.feed([i]) for i in range(len(parts))] + [stream.close()]) == data.decode("utf-8", "replace")


def test_bpe_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "the end", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").withColumnRenamed("doc_id", "n_tokens").selectExpr("n_tokens as `a.b`", "text", "tokens", "1 as kept", "2 as needed")
    done = byte_bpe.encode(docs, MODEL, with_text=True)
    assert done.columns == ["a.b", "text", "kept", "needed", "tokens", "n_tokens"]
    back = byte_bpe.decode(done, MODEL)
    assert sorted((r["a.b"] or 0, r.n_tokens, r.decoded_text) for r in back.collect()) == [(0, 2, "the end"), (1, 0, ""), (2, 0, ""), (2, 0, "")]
    assert byte_bpe.encode(docs.limit(0), MODEL).collect() == []
    assert byte_bpe.decode(spark.sql("select cast(null as binary) as tokens, 1 as kept"), MODEL).first().decoded_text == ""


def test_bpe_query_equals_the_library_on_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = byte_bpe.op11_byte_bpe(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# 13. fill-in-middle

def plain_cut(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle_equals_a_plain_reading(spark):
    rng = random.Random(7)
    texts = [None, "", "a", "é", "<", "<P", "x<P>y", "<<S", "ab<M>", " ", "\n\r\n", "日本語 text", "👍" * 400, "word " * 300, "a" * 5000, "aé" * 3000]
    texts += ["".join(rng.choice(["ab", "c", " ", "é", "👍", "<", "S>", "\n", ".", "Z"]) for _ in range(rng.randrange(700))) for _ in range(120)]
    rows = [(i, t, f"x{i}", -1) for i, t in enumerate(texts)] + [(None, "some text here", "n", -1)] + [(40, texts[40], "again", -1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_units int")
    done = fill_in_middle.restore(fill_in_middle.fill_in_middle(docs, with_text=True))
    found = done.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.kept) for r in found) == sorted((r[0] is None, r[0], r[2]) for r in rows)
    for r in found:
        assert (r.n_units, r.fim_form, r.prefix_chars, r.middle_chars, r.fim_text) == plain_cut(r.doc_id, r.text)
        assert r.restored_text == (r.text or "")
    assert {r.fim_form for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(docs.limit(0)).collect() == []


def test_descent_finds_every_unit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 100):
        counts = np.stack([rng.integers(0, 4, n), rng.integers(0, 9, n)], axis=1)
        tree, upto = fill_in_middle.BlockTree(counts), np.vstack([[0, 0], np.cumsum(counts, axis=0)])
        wanted = np.arange(1, upto[-1, 0] + 1)
        block, before = tree.descend(wanted)
        assert (block == np.searchsorted(upto[1:, 0], wanted)).all() and (before == upto[block]).all()


# 12. hard negatives

def plain_negatives(rows, anchors, low=50, high=95):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for own, label, v in {(i, l, tuple(x)) for i, l, x in anchors}:
        scored = sorted((-dot(v, x), i, l) for i, l, x in rows)
        positives = [(-s, i) for s, i, l in scored if l == label and i != own][:5]
        for score, positive in positives:
            fit = [(-s, i) for s, i, l in scored if l != label and low * score <= -100 * s <= high * score][:3]
            out += [(own, positive, rank, i, score, s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale,small", [(1, False), (1, True), (1 << 26, True), (174_483_046, True)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, scale, small):
    if small:
        for name, value in (("SHARD_ROWS", 16), ("GROUP_ROWS", 4), ("LANE_ROWS", 3), ("MOST_PIVOTS", 6), ("SAMPLE_ROWS", 40)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(11)
    size = scale  # beyond 2**52 sums of doubles are no longer exact, beyond 2**62 longs might overflow
    rows = [(i, rng.randrange(3), [rng.randrange(-3, 9) * size + rng.randrange(3) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, 1, [4 * size, 2 * size, 0, size, size, size]) for i in range(60)]  # ties and one hot vector
    rows += [(5, 2, [size] * 6)] * 3 + [(300, 0, [0] * 6), (301, 1, [size])]
    anchors = rows[:150:9] + rows[150:153] + [rows[-1], rows[-3]] + [rows[0]] * 2
    padded = [(i, l, v + [0] * (6 - len(v))) for i, l, v in rows]
    assert hard_negatives.kind_of(max(sum(x * x for x in v) for _, _, v in rows)) == {1: np.float64, 1 << 26: np.int64, 174_483_046: object}[scale]
    df = lambda data: spark.createDataFrame(data, "vec_id long, label long, v array<long>")
    found = hard_negatives.hard_negatives(df(rows), df(anchors))
    wanted = plain_negatives(padded, [(i, l, v + [0] * (6 - len(v))) for i, l, v in anchors])
    assert len(wanted) > 100
    assert sorted(tuple(r) for r in found.collect()) == wanted


def test_rows_that_take_no_part(spark):
    fine = [0.5, 0.25]
    rows = [(1, 1, fine, "a"), (None, 1, fine, "a"), (2, None, fine, "a"), (3, 1, None, "a"), (4, 1, [1.0, None], "a"), (5, 1, [float("nan"), 1.0], "a"), (6, 1, [float("inf"), 1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, v string")
    import pyspark.sql.functions as F
    kept = hard_negatives.prepared(df, F.col("label"))
    assert [tuple(r) for r in kept.collect()] == [(1, 1, [128, 64])]
    assert hard_negatives.hard_negatives(kept, kept).collect() == []
    assert hard_negatives.hard_negatives(kept.limit(0), kept.limit(0)).collect() == []


def test_spanning_tree_is_least():
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 9, (40, 3)).astype(float)
    order, parent, edge = hard_negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and (parent[1:] < np.arange(1, 40)).all()
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(edge[1:], apart[order[1:], order[parent[1:]]])
    joined, total = {0}, 0.0
    while len(joined) < 40:
        least, nxt = min((apart[a, b], b) for a in joined for b in range(40) if b not in joined)
        joined.add(nxt)
        total += least
    assert np.isclose(edge.sum(), total)
