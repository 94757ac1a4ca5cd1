r"""Removal of word sequences that occur more than once, by compressed FM-indexes.

Words are ``[^\x20\x09-\x0D]+``.  A window is ``WINDOW`` consecutive words of one document; a window is
repeated if its words also start anywhere else, in the same document too, and every word that a
repeated window covers is removed.

1. Each window has a minimiser: the run of ``GRAM`` words inside it with the least hash (the first of
   equals).  Windows with the same words have the same one, and neighbouring windows mostly share
   theirs, so a document falls into stretches of windows with one minimiser each.  Minimisers that
   occur once are counted out.
2. Stretches of the others are known by the hash of their words; equal ones are one row with a count
   and one place to read the words at, so a passage in a third of all documents is one row.  Only
   that place's text is read again.  Stretches meet in shards by minimiser.  Where a minimiser has
   more than ``CROWDED`` different stretches (one passage in ever other surroundings) they are cut into
   single windows, which spread over ``SPREAD`` shards by a hash of their words and are counted again.
3. A shard's stretches, at most about ``SHARD_WORDS`` words at a time, become an FM-index: the
   Burrows-Wheeler transform of the words in a wavelet tree of bit vectors with rank counts, and the
   lengths of common prefixes.  All stretches are streamed against it from their last word to
   their first: backward search lengthens the match by one word, and where fewer than two
   occurrences are left the match is cut to its parent interval.  This gives matching statistics;
   a window is repeated where they reach ``WINDOW``.
4. Repeated windows go back to their stretches' documents as ranges.

Nothing is capped.  Words are told apart by 64-bit hashes.  Defined results: a null text has no
words; ids are taken to be unique, rows that repeat an id count as further occurrences and share
their removals.  Rows with a null id are documents of their own, known by a 64-bit hash of their text:
they count as occurrences, lose their repeated words and keep the null id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.filters import IdFilter
from timeweave.llm.registry import query
from timeweave.llm.runs import runs
from timeweave.llm.tables import cut_lineage, read, spread
from timeweave.llm.words import STEP, gram_hashes, inverse, mix, powers, raw, slices, word_hashes, word_spans

WINDOW = 35
GRAM = 8
PLACE = (1 << 32) - 1
SHARD_WORDS = 150_000
CROWDED = 4_096
SPREAD = 64


def row_key() -> Column:
    """The id of a row, or a hash of its text if it has none: never null."""
    return F.coalesce("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(6)))


def stretches(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimiser) of all stretches of a slice of texts.

    Windows are numbered by their first word in the slice.
    """
    grams = gram_hashes(words, GRAM)
    inside = WINDOW - GRAM + 1
    n = len(words) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # The upper half holds a hash and the lower one the place, so the least is the first of equals.
    key = grams & ~np.uint64(PLACE) | np.arange(len(grams), dtype=np.uint64)
    least, reach = key, 1
    while reach < inside:
        step = min(reach, inside - reach)
        least = np.minimum(least[:len(least) - step], least[step:])
        reach += step
    place = (least[:n] & np.uint64(PLACE)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    whole = np.arange(n) + WINDOW <= at[1:][text]
    begins = np.ones(n, bool)
    begins[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begins &= whole
    first = np.flatnonzero(begins)
    # A stretch ends where the next begins or its text has no whole window any more.
    stop = np.minimum(np.append(first[1:], n), at[1:][text[first]] - WINDOW + 1) if len(first) else first
    return text[first], first, stop - first, grams[place[first]]


class WaveletTree:
    """Rank of symbols in a sequence: one bit vector a level, ones behind zeros on the next level."""

    WORD = 64

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(int(size - 1).bit_length(), 1)
        self.bits, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            padded = np.zeros(-(-(len(bit) + 1) // self.WORD) * self.WORD, np.uint8)
            padded[:len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbols: np.ndarray, upto: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before a place; ``starts`` is where it begins on the last level."""
        place = upto
        for level, (packed, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros)):
            word = place >> 6
            below = packed[word] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[word] + np.bitwise_count(below)
            place = np.where((symbols >> (self.levels - 1 - level)) & 1, zeros + ones, place - ones)
        return place - starts[symbols]


class FmIndex:
    """Backward search over weighted stretches of words; stretches are told apart by separators."""

    def __init__(self, text: np.ndarray, size: int, weight: np.ndarray):
        """``text`` has symbols below ``size``; separators are the lowest, each used once."""
        n = len(text)
        order, rank = np.argsort(text, kind="stable"), text.astype(np.int64)
        reach = 1
        while reach < n and reach < 2 * WINDOW:
            ahead = np.zeros(n, np.int64)
            ahead[:n - reach] = rank[reach:] + 1
            key = rank * (n + size + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
            reach *= 2
            if rank[order[-1]] == n - 1:  # all suffixes are told apart
                break
        self.length = n
        symbols = text[order - 1]
        self.first = np.searchsorted(np.sort(text), np.arange(size + 1))  # rows that begin with lesser symbols
        self.tree = WaveletTree(symbols, size)
        self.starts = self.tree.rank(np.arange(size), np.zeros(size, np.int64), np.zeros(size, np.int64))
        self.weights = np.concatenate([[0], np.cumsum(weight[order])])
        self.common = self._common(text, order)
        # Row limits of the interval of each row for every length of a common prefix.
        rows = np.arange(n)
        self.low = np.empty((WINDOW, n), np.int32)
        self.high = np.empty((WINDOW, n), np.int32)
        for depth in range(WINDOW):
            new = self.common[:-1] < depth
            self.low[depth] = np.maximum.accumulate(np.where(new, rows, 0))
            ends = np.where(np.append(new[1:], True), rows + 1, n)
            self.high[depth] = np.minimum.accumulate(ends[::-1])[::-1]

    @staticmethod
    def _common(text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each row with the row before it, up to ``WINDOW``; 0 at both ends."""
        n = len(text)
        out = np.zeros(n + 1, np.int32)
        live = np.arange(1, n)
        for depth in range(WINDOW):
            a, b = order[live] + depth, order[live - 1] + depth
            ok = (a < n) & (b < n)
            ok[ok] = text[a[ok]] == text[b[ok]]
            live = live[ok]
            if not len(live):
                break
            out[live] = depth + 1
        return out

    def repeated(self, queries: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each place of the streamed words, whether a window begins there that occurs twice or more."""
        out = np.zeros(len(queries), bool)
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.length, np.int64)
        length = np.zeros(len(sizes), np.int64)
        at = starts + sizes - 1
        live = np.flatnonzero(sizes > 0)
        while len(live):
            symbol = queries[at[live]]
            n = len(live)
            ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]), self.starts)
            new_low, new_high = self.first[symbol] + ranks[:n], self.first[symbol] + ranks[n:]
            enough = self.weights[new_high] - self.weights[new_low] >= 2
            # Where the match grows, the place is done; a full window is cut by its last word.
            grown = live[enough]
            low[grown], high[grown] = new_low[enough], new_high[enough]
            length[grown] += 1
            full = grown[length[grown] == WINDOW]
            out[at[full]] = True
            # Else the match is cut to its parent interval; the empty match gives the place up.
            stuck = live[~enough]
            empty = stuck[length[stuck] == 0]
            cut = stuck[length[stuck] > 0]
            parent = np.maximum(self.common[low[cut]], self.common[high[cut]]).astype(np.int64)
            parent = np.minimum(parent, length[cut] - 1)
            row = low[cut]
            low[cut], high[cut], length[cut] = self.low[parent, row], self.high[parent, row], parent
            row = low[full]
            low[full], high[full], length[full] = self.low[WINDOW - 1, row], self.high[WINDOW - 1, row], WINDOW - 1
            at[grown] -= 1
            at[empty] -= 1
            live = live[at[live] >= starts[live]]
        return out


def repeated_windows(words: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a repeated window begins at each word of the stretches; ``counts`` says how often each occurs."""
    sizes = np.diff(at)
    names, symbols = np.unique(words, return_inverse=True)
    text = np.empty(len(words) + len(sizes), np.int64)
    keep = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
    text[keep] = symbols + len(sizes)
    ends = at[1:] + np.arange(len(sizes))
    text[ends] = np.arange(len(sizes))
    index = FmIndex(text, len(names) + len(sizes), np.repeat(counts, sizes + 1))
    return index.repeated(text, at[:-1] + np.arange(len(sizes)), sizes)[keep]


def sequence_hashes(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence of ``size`` words from ``first`` on."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(STEP, len(words)), out=sums[1:])
    back = powers(inverse(STEP), len(words) + 1)
    return mix((sums[first + size] - sums[first]) * back[first] + size.astype(np.uint64))


def minimisers(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Of each stretch some of key (``row_key``), nameless (a row without an id), place (its first word), m (its minimiser) and id (hash of its words)."""
    kinds = {"key": "long", "nameless": "boolean", "place": "int", "m": "long", "id": "long"}

    def find(batches):
        for batch in slices(batches):
            data, offsets = raw(batch.column("text"))
            start, end, at = word_spans(data, offsets)
            words = word_hashes(data, start, end)
            text, first, n, m = stretches(words, at)
            made = {"m": pa.array(m.view(np.int64))}
            if "id" in columns:
                made |= {"key": batch.column("key").take(pa.array(text)), "nameless": batch.column("nameless").take(pa.array(text)), "place": pa.array((first - at[text]).astype(np.int32)),
                         "id": pa.array(sequence_hashes(words, first, n + WINDOW - 1).view(np.int64))}
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], names=list(columns))

    return docs.select(row_key().alias("key"), F.col("doc_id").isNull().alias("nameless"), "text").mapInArrow(find, ", ".join(f"{c} {kinds[c]}" for c in columns))


def shared_stretches(docs: DataFrame) -> DataFrame:
    """(key, nameless, place, m, id) of every stretch whose minimiser occurs more than once."""
    # Written, so that the join reads both sides from exchanges of their own and a hot minimiser can be split.
    often = cut_lineage(minimisers(docs, ("m",)).groupBy("m").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("m"))
    return minimisers(docs, ("key", "nameless", "place", "m", "id")).join(often, "m")


def read_words(docs: DataFrame, wanted: DataFrame, single: bool) -> DataFrame:
    """The words of the ``wanted`` (key, place, m, id, n) stretches, or of each of their windows.

    Whole stretches: (m, id, part, words, n).  Windows: (m, id, i, window, part, words, n), ``i`` the place
    in the stretch and ``window`` the hash of the words, by which they are dealt to parts.
    """
    places = wanted.groupBy("key").agg(F.collect_list(F.struct("place", "m", "id", "n")).alias("wanted"))
    places = cut_lineage(places)
    held = IdFilter(places, "key").rows(docs.select(row_key().alias("key"), F.col("doc_id").isNull().alias("nameless"), "text"), "key", inside=True)
    # Equal texts without an id have one key and are read once.
    once = held.filter("nameless").groupBy("key").agg(F.first("text").alias("text"))
    marked = held.filter("NOT nameless").select("key", "text").unionByName(once).join(places, "key")

    def cut(batches):
        for batch in slices(batches):
            data, offsets = raw(batch.column("text"))
            start, end, at = word_spans(data, offsets)
            words = word_hashes(data, start, end)
            text, first, size, m = stretches(words, at)
            ids = sequence_hashes(words, first, size + WINDOW - 1).view(np.int64)
            column = batch.column("wanted")
            asked = column.flatten()
            of = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            key = (of << 32) | asked.field("place").to_numpy()
            order = np.argsort(key)
            mine = (text << 32) | (first - at[text])
            slot = np.minimum(np.searchsorted(key[order], mine), max(len(key) - 1, 0))
            keep = np.flatnonzero(key[order][slot] == mine) if len(key) else np.zeros(0, np.int64)
            row = order[slot[keep]]
            # A text that repeats an id has other words there; only the stretch asked for counts.
            same = asked.field("id").to_numpy()[row] == ids[keep]
            keep, row = keep[same], row[same]
            first, size, m, ids = first[keep], size[keep], m[keep].view(np.int64), ids[keep]
            n = asked.field("n").to_numpy()[row]
            content = data.tobytes()
            if not single:
                spans = zip(start[first].tolist(), end[first + size + WINDOW - 2].tolist())
                texts = [b" ".join(content[a:b].split()).decode() for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(ids), pa.array(np.zeros(len(m), np.int32)), pa.array(texts, pa.string()), pa.array(n)], names=["m", "id", "part", "words", "n"])
                continue
            i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            begin = np.repeat(first, size) + i
            window = sequence_hashes(words, begin, np.full(len(begin), WINDOW)).view(np.int64)
            part = (window.view(np.uint64) % np.uint64(SPREAD)).astype(np.int32)
            for a in range(0, len(begin), 20_000):
                z = slice(a, a + 20_000)
                texts = [b" ".join(content[x:y].split()).decode() for x, y in zip(start[begin[z]].tolist(), end[begin[z] + WINDOW - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(m, size)[z]), pa.array(np.repeat(ids, size)[z]), pa.array(i[z].astype(np.int32)), pa.array(window[z]), pa.array(part[z]), pa.array(texts, pa.string()), pa.array(np.repeat(n, size)[z])],
                    names=["m", "id", "i", "window", "part", "words", "n"])

    return marked.select("text", "wanted").mapInArrow(
        cut, "m long, id long, i int, window long, part int, words string, n long" if single else "m long, id long, part int, words string, n long")


def matching(shards: DataFrame) -> DataFrame:
    """(m, id, ranges) of (m, id, part, words, n): from where to where repeated windows begin, if anywhere."""
    def search(batches):
        for table, at in runs(batches, ["m", "part"]):
            counts = table.column("n").to_numpy()
            data, offsets = raw(table.column("words"))
            start, end, word_at = word_spans(data, offsets)
            hashes = word_hashes(data, start, end)
            # Whole runs of one key, so many that an index has about SHARD_WORDS words.
            a = 0
            while a < len(at) - 1:
                b = max(a + 1, int(np.searchsorted(word_at[at], word_at[at[a]] + SHARD_WORDS, "right")) - 1)
                own_at = word_at[at[a]:at[b] + 1]
                hit = repeated_windows(hashes[own_at[0]:own_at[-1]], own_at - own_at[0], counts[at[a]:at[b]])
                # The last windows of a stretch end it, so no range crosses stretches.
                edges = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
                low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
                row = np.searchsorted(own_at - own_at[0], low, "right") - 1
                base = (own_at - own_at[0])[row]
                some, first = np.unique(row, return_index=True)
                if len(some):
                    ranges = np.column_stack([low - base, high - base]).reshape(-1).astype(np.int32)
                    names = table.take(pa.array(some + at[a])).select(["m", "id"]).combine_chunks()
                    yield pa.RecordBatch.from_arrays(
                        [names.column("m").combine_chunks(), names.column("id").combine_chunks(), pa.ListArray.from_arrays(pa.array(2 * np.append(first, len(row)).astype(np.int32)), pa.array(ranges))],
                        names=["m", "id", "ranges"])
                a = b

    dealt = shards.select("m", "id", "part", "words", "n").repartition(spread(shards), "m", "part").sortWithinPartitions("m", "part")
    return dealt.mapInArrow(search, "m long, id long, ranges array<int>")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(key, ranges): from where to where repeated windows begin in each document that has any."""
    occurrences = cut_lineage(shared_stretches(docs))
    distinct = cut_lineage(
        occurrences.groupBy("m", "id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("nameless", "key", "place")).alias("at"))
        .select("m", "id", "n", "at.key", "at.place"))
    crowds = cut_lineage(distinct.groupBy("m").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > CROWDED).select("m"))
    if crowds.isEmpty():
        hits = matching(read_words(docs, distinct, single=False))
    else:
        whole = matching(read_words(docs, distinct.join(crowds, "m", "left_anti"), single=False))
        windows = cut_lineage(read_words(docs, distinct.join(crowds, "m", "left_semi"), single=True))
        counted = windows.groupBy("m", F.col("window").alias("id"), "part").agg(F.first("words").alias("words"), F.sum("n").alias("n"))
        found = matching(counted).select("m", F.col("id").alias("window"))
        begin = F.sort_array(F.collect_set("i"))
        hits = whole.unionByName(
            windows.join(found, ["m", "window"]).groupBy("m", "id").agg(F.flatten(F.transform(begin, lambda i: F.array(i, i + 1))).alias("ranges")))
    located = occurrences.join(hits, ["m", "id"]).select("key", F.transform("ranges", lambda x: x + F.col("place")).alias("ranges"))
    # A set, so that rows with one key don't lengthen it.
    return located.groupBy("key").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document without the words of repeated windows."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    places = cut_lineage(repeated_ranges(docs))
    # Texts that lose nothing are not shuffled.
    changed = IdFilter(places, "key")
    keyed = docs.withColumn("key", row_key())
    marked = changed.rows(keyed, "key", inside=True).join(places, "key", "left").select("doc_id", "text", "ranges").unionByName(
        changed.rows(keyed, "key", inside=False).select("doc_id", "text", F.lit(None).cast("array<int>").alias("ranges")))

    def strip(batches):
        for batch in slices(batches):
            data, offsets = raw(batch.column("text"))
            start, end, at = word_spans(data, offsets)
            gone = np.zeros(len(start) + 1, np.int32)
            for row, own in enumerate(batch.column("ranges")):
                if own.is_valid:
                    low, high = own.values.to_numpy().reshape(-1, 2).T
                    # Windows from low to before high cover these words.
                    last = np.minimum(at[row] + high + WINDOW - 1, at[row + 1])
                    np.add.at(gone, np.minimum(at[row] + low, last), 1)
                    np.subtract.at(gone, last, 1)
            removed = np.cumsum(gone[:-1]) > 0
            bytes_ = data.tobytes()
            kept, n_removed = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                out = removed[a:b]
                n_removed.append(int(out.sum()))
                if n_removed[-1]:
                    left = np.flatnonzero(~out) + a
                    kept.append(b" ".join([bytes_[x:y] for x, y in zip(start[left].tolist(), end[left].tolist())]).decode())
                else:
                    kept.append(b" ".join(bytes_[start[a]:end[b - 1]].split()).decode() if b > a else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"])

    return marked.select("doc_id", "text", "ranges").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")


SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
    SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM words
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS n FROM starts JOIN words USING (doc_id)
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows WHERE n > 1
), lists AS (SELECT doc_id, list(j) AS js, count(*) AS n_removed FROM gone GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM words),
kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t FROM flat ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op6_substring_dedup", SQL)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps once its repeated windows are removed."""
    done = remove_repeats(read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
