"""Language identification by prediction by partial matching.

Every language has a byte context tree of depth ``CONTEXT``: how often each byte followed each
context of up to that many bytes in the labelled sample.  A byte is coded in the longest known
context; if it never followed there, an escape is paid (escape method C: distinct followers
against all) and the next shorter context is asked, down to a flat code of eight bits.  The
statistics are frozen after training, so the exact code length of a text is a sum of constants
over the longest known string that ends at each byte.  The language of the shortest code wins.

The sample is bounded: at most ``sample_docs`` whole documents a language, chosen by a hash of the
id.  Strings of four and five bytes that the sample holds only once are left out, and with them
their share of the counts of a context.

Defined results: a text that is null or has no letter is ``und`` with score 0; equal code lengths
go to the first language by name; without any labelled text everything is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeweave.llm.registry import query
from timeweave.llm.tables import read
from timeweave.llm.words import raw, slices

CONTEXT = 4
LONGEST = CONTEXT + 1
SAMPLE_DOCS = 400
ONCE_FROM = 4
FLAT_BITS = 8.0
ADDED = ("lang_pred", "lang_score", "lang_bits")


def _keys(data: np.ndarray, n: int) -> np.ndarray:
    """The string of ``n`` bytes that ends at each byte, newest byte lowest, tagged by its length."""
    key = np.full(len(data), n << (8 * LONGEST), np.int64)
    for back in range(n):
        key[back:] |= data[:len(data) - back].astype(np.int64) << (8 * back)
    return key


def _depth(offsets: np.ndarray) -> np.ndarray:
    """How many bytes of its text each byte has up to and with itself."""
    return np.arange(1, offsets[-1] + 1) - np.repeat(offsets[:-1], np.diff(offsets))


def string_counts(labelled: DataFrame) -> DataFrame:
    """(lang, key, n): how often each string of one to five bytes occurs in each language."""
    def count(batches):
        for batch in slices(batches):
            langs = np.array(batch.column("lang").to_pylist())
            data, offsets = raw(batch.column("text"))
            depth, of = _depth(offsets), np.repeat(langs, np.diff(offsets))
            for lang in np.unique(langs):
                mine = of == lang
                keys = np.concatenate([_keys(data, n)[mine & (depth >= n)] for n in range(1, LONGEST + 1)])
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

    return (
        labelled.select("lang", "text").mapInArrow(count, "lang string, key long, n long")
        .groupBy("lang", "key").agg(F.sum("n").alias("n"))
        .filter((F.col("n") > 1) | (F.shiftright("key", 8 * LONGEST) < ONCE_FROM))
    )


@dataclass(frozen=True)
class Model:
    """Frozen statistics: a hash table of strings and what each costs in each language."""

    langs: tuple[str, ...]
    slots: np.ndarray  # keys by open addressing, 0 is empty
    nodes: np.ndarray  # node of each slot
    cost: np.ndarray  # [node, lang] bits of the last byte less the escapes that its context has paid
    escape: np.ndarray  # [node, lang] bits of all escapes from the state after this node
    start: np.ndarray  # [lang] the same for the empty context

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Node of each key, -1 if unknown."""
        bits = np.uint64(64 - int(np.log2(len(self.slots))))
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> bits).astype(np.int64)
        seen = self.slots[slot]
        found = np.where(seen == keys, self.nodes[slot], -1)
        left = np.flatnonzero((seen != keys) & (seen != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.slots) - 1)
            seen = self.slots[slot[left]]
            hit = seen == keys[left]
            found[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (seen != 0)]
        return found

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[text, lang] bits to code each whole text."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if not len(full):
            return out
        depth = _depth(offsets)
        node = np.zeros(len(data), np.int64)  # node 0: the byte is unknown
        left = None
        for n in range(LONGEST, 0, -1):
            keys = _keys(data, n)
            able = np.flatnonzero(depth >= n) if left is None else left[depth[left] >= n]
            got = self.find(keys[able])
            node[able[got >= 0]] = got[got >= 0]
            missed = able[got < 0]
            short = np.flatnonzero(depth < n) if left is None else left[depth[left] < n]
            left = np.concatenate([missed, short])
        last = node[offsets[full + 1] - 1]
        for lang in range(len(self.langs)):
            both = (self.cost[:, lang] + self.escape[:, lang])[node]
            out[full, lang] = np.add.reduceat(both, offsets[full]) + self.start[lang] - self.escape[last, lang]
        return out


def build(rows: list[tuple[str, int, int]]) -> Model:
    """The model of (lang, key, n)."""
    lang, key, n = zip(*rows) if rows else ((), (), ())
    return build_table(pa.table({"lang": pa.array(lang, pa.string()), "key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())}))


def build_table(rows: pa.Table) -> Model:
    """The model of a table (lang, key, n); its rows are bounded by the sample."""
    named = pc.dictionary_encode(rows.column("lang").combine_chunks())
    code, key, n = named.indices.to_numpy(), rows.column("key").to_numpy(), rows.column("n").to_numpy()
    names = named.dictionary.to_pylist()
    langs = tuple(sorted(names))
    all_keys = np.unique(key)
    length = all_keys >> (8 * LONGEST)
    body = all_keys & ((1 << (8 * LONGEST)) - 1)
    place = lambda n, text: np.searchsorted(all_keys, (n << (8 * LONGEST)) | text) + 1  # noqa: E731  node 0 is empty
    context = np.where(length > 1, place(length - 1, body >> 8), 0)
    suffix = np.where(length > 1, place(length - 1, body & ((1 << np.maximum(8 * (length - 1), 0)) - 1)), 0)
    counts = np.zeros((len(all_keys) + 1, len(langs)))
    for i, lang in enumerate(langs):
        mine = code == names.index(lang)
        counts[np.searchsorted(all_keys, key[mine]) + 1, i] = n[mine]
    total, kinds = np.zeros_like(counts), np.zeros_like(counts)
    np.add.at(total, context, counts[1:])
    np.add.at(kinds, context, counts[1:] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        leave = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
        own = np.log2((total + kinds)[context] / counts[1:])
    bits, chain = np.full_like(counts, FLAT_BITS), np.zeros_like(counts)
    chain[0] = leave[0]
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(length == n)
        bits[at + 1] = np.where(counts[at + 1] > 0, own[at], leave[context[at]] + bits[suffix[at]])
        chain[at + 1] = leave[at + 1] + chain[suffix[at]]
    cost = bits.copy()
    cost[1:] -= chain[context]
    deepest = np.flatnonzero(length == LONGEST) + 1
    escape = chain.copy()
    escape[deepest] = chain[suffix[deepest - 1]]
    size = 1 << int(np.ceil(np.log2(max(4 * len(all_keys), 16))))
    slots, nodes = np.zeros(size, np.int64), np.zeros(size, np.int64)
    slot = ((all_keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - int(np.log2(size)))).astype(np.int64)
    left = np.arange(len(all_keys))
    while len(left):
        free = left[slots[slot[left]] == 0]
        _, first = np.unique(slot[free], return_index=True)
        taken = free[first]
        slots[slot[taken]], nodes[slot[taken]] = all_keys[taken], taken + 1
        left = np.setdiff1d(left, taken, assume_unique=True)
        slot[left] = np.where(slots[slot[left]] != 0, (slot[left] + 1) & (size - 1), slot[left])
    return Model(langs, slots, nodes, cost, escape, chain[0])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from (doc_id, text, lang) rows; null languages and texts teach nothing."""
    labelled = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("doc_id", F.lit(3))
    rates = labelled.groupBy("lang").agg((F.lit(2.0 * sample_docs) / F.count(F.lit(1))).alias("rate"))
    # One row a language: far below any broadcast bound.
    sample = labelled.join(F.broadcast(rates), "lang").filter(F.pmod(order, F.lit(1 << 20)) < F.col("rate") * (1 << 20))
    first = Window.partitionBy("lang").orderBy(order, "doc_id", "text")
    sample = sample.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample_docs)
    return build_table(string_counts(sample).toArrow())


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns, with ``lang_pred``, ``lang_score`` and ``lang_bits`` (bits a byte).

    Columns of these names are replaced.  The score is the weight of the chosen language among
    all, each weighted by two to the power of minus its code length.
    """
    df = df.drop(*ADDED)
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_bits", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = shared.value
        for batch in slices(batches, text):
            data, offsets = raw(batch.column(text))
            has = batch.column("__letter").to_numpy(zero_copy_only=False)
            best, score = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows)
            bits = np.full(batch.num_rows, FLAT_BITS)
            if model.langs:
                lengths = model.code_lengths(data, offsets)
                best = lengths.argmin(axis=1)
                least = lengths[np.arange(len(best)), best]
                score = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
                size = np.diff(offsets)
                bits = np.where(size > 0, least / np.maximum(size, 1), FLAT_BITS)
            names = [model.langs[i] if ok and model.langs else "und" for i, ok in zip(best, has)]
            score = np.where(has & bool(model.langs), score, 0.0)
            rest = [c for n, c in zip(batch.schema.names, batch.columns) if n != "__letter"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(names, pa.string()), pa.array(score), pa.array(bits)],
                names=[n for n in batch.schema.names if n != "__letter"] + list(ADDED),
            )

    return df.select("*", letter).mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted() -> Column:
    """A language was found, and its model codes the text better than plain bytes."""
    return (F.col("lang_pred") != "und") & (F.col("lang_bits") < FLAT_BITS)


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from documents that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_bits")
