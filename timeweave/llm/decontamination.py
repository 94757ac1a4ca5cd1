r"""Benchmark passages in documents, by latent semantic retrieval with exact checks.

Words are lower-cased runs of letters and digits, hashed to ``TERMS`` terms.

1. Document frequencies of all terms are counted over all documents.
2. Items are cut into passages of equal length, at most ``PASSAGE`` words, so that a window inside a
   copy looks like one of them however long the item is.  The passages are dealt to blocks of about
   ``BLOCK_ITEMS``.  For each block a randomised singular value decomposition of its TF-IDF passages is
   computed in Spark: rows are sketched with a random matrix, the sketch is made orthonormal through
   its Gram matrix, and the rows are summed into term vectors (twice, with one power step).  Only
   matrices of the size of a block are on the driver.  The rank grows until every passage keeps
   ``KEPT`` of its length.
3. Every document is read in steps of ``STRIDE`` words, once for ``SCANNED`` blocks.  A window of ``WINDOW``
   words is projected if the terms of the block's passages have the share of its weight without
   which no cosine reaches ``COSINE`` (by Cauchy's inequality, every occurrence of a word counted).
   Items of which a passage has cosine ``COSINE`` or more are candidates (cosines against the window's
   full length, so that a window with one word of the benchmark doesn't look like it).
4. An item shorter than a window is hidden there by heavier words around it, so such items are also
   found by containment.  What passes the test of 5 lacks less than 1 - ``PARAPHRASE`` of the weight;
   so of the item's heaviest words, ``HEAVY`` of its weight or more, the rest must be in one stretch
   of one and a half times the item's length.  Each such stretch is a candidate: no copy is missed.
5. For each candidate the words around its windows are compared with the whole item: the longest
   common subsequence, each word weighted by its inverse document frequency.  A document holds an
   item if the subsequence has ``SAME`` of the item's weight, or ``PARAPHRASE`` of it while the answer,
   the item's last sentence, is also there with ``ANSWER`` of its own weight.

Defined results: null texts and items without a word match nothing; of rows that repeat an item id
each counts, and the best is reported; items are compared as whole texts, however short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeweave.llm.registry import query
from timeweave.llm.tables import cut_lineage, read
from timeweave.llm.words import hashed_words, slices

TERM_BITS = 17
TERMS = 1 << TERM_BITS
BLOCK_ITEMS = 256
KEPT = 0.95
STRIDE = 8
WINDOW = 24
# A passage of 18 to 36 words of which PARAPHRASE is kept reaches 0.44 in some window, if weights are equal; the limit
# below leaves room for words put in that weigh more than those that are kept.
PASSAGE = 36
SCANNED = 8
HEAVY = 0.75
PROJECTED = 2_000
COSINE = 0.33
SAME = 0.8
PARAPHRASE = 0.55
ANSWER = 0.6


def plain(text: Column) -> Column:
    """Lower-cased words of letters and digits, single spaces between."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents, and for each term in how many of them it is."""
    def count(batches):
        out, rows = np.zeros(TERMS, np.int64), 0
        for batch in slices(batches):
            words, at = hashed_words(batch.column("text"))
            key = (np.repeat(np.arange(len(at) - 1), np.diff(at)) << TERM_BITS) | terms_of(words)
            out += np.bincount(np.unique(key) & (TERMS - 1), minlength=TERMS)
            rows += batch.num_rows
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(out[some], rows))], names=["term", "n"])

    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most TERMS + 1 rows
    term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(TERMS, np.int64)
    counts[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), counts


def decomposed(passages: DataFrame, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, vectors) of the right singular vectors of the TF-IDF rows of ``plain`` texts."""
    spark = passages.sparkSession
    weights = spark.sparkContext.broadcast(idf)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            words, at = hashed_words(batch.column("text"))
            for a, b in zip(at[:-1], at[1:]):
                if b > a:
                    term, n = np.unique(terms_of(words[a:b]), return_counts=True)
                    value = n * weights.value[term]
                    yield term, value / max(np.linalg.norm(value), 1e-12)

    def project(vectors) -> np.ndarray:
        """Sum of the outer products of the sketched rows: the Gram matrix."""
        def gram(batches):
            out = np.zeros((rank, rank))
            for term, value in rows(batches):
                y = value @ vectors(term)
                out += np.outer(y, y)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rank)), pa.array(list(out), pa.list_(pa.float64()))], names=["row", "v"])

        parts = passages.mapInArrow(gram, "row long, v array<double>").select("row", F.posexplode("v").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros((rank, rank))
        out[parts.column("row").to_numpy(), parts.column("col").to_numpy()] = parts.column("x").to_numpy()
        return out

    def gather(vectors, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term vectors: the rows summed with the orthonormal sketch as weights."""
        def sums(batches):
            held: dict[int, np.ndarray] = {}
            for term, value in rows(batches):
                y = value @ vectors(term) @ inverse
                for t, x in zip(term.tolist(), value.tolist()):
                    held[t] = held.get(t, 0) + x * y
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["term", "v"])

        added = passages.mapInArrow(sums, "term long, v array<double>").select("term", F.posexplode("v").alias("i", "x"))
        parts = added.groupBy("term", "i").agg(F.sum("x").alias("x")).toArrow()  # the terms of one block
        term, at = np.unique(parts.column("term").to_numpy(), return_inverse=True)
        out = np.zeros((len(term), rank))
        out[at, parts.column("i").to_numpy()] = parts.column("x").to_numpy()
        return term, out

    def random_rows(term: np.ndarray) -> np.ndarray:
        return np.stack([np.random.Generator(np.random.Philox(int(t))).standard_normal(rank) for t in term])

    vectors = random_rows
    for _ in range(2):
        values, base = np.linalg.eigh(project(vectors))
        good = values > values.max(initial=0) * 1e-10
        inverse = np.zeros((rank, rank))
        inverse[:, :good.sum()] = base[:, good] / np.sqrt(values[good])
        term, summed = gather(vectors, inverse)
        shared = spark.sparkContext.broadcast((term, summed))

        def vectors(wanted: np.ndarray, shared=shared) -> np.ndarray:
            term, summed = shared.value
            return summed[np.searchsorted(term, wanted)]

    values, base = np.linalg.eigh(summed.T @ summed)
    good = values > values.max(initial=0) * 1e-10
    return term, (summed @ base[:, good] / np.sqrt(values[good])).astype(np.float32)


def present(words: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the words are among the others."""
    if not len(among):
        return np.zeros(len(words), bool)
    ordered = np.sort(among)
    return ordered[np.minimum(np.searchsorted(ordered, words), len(ordered) - 1)] == words


def common_weight(item: np.ndarray, weight: np.ndarray, other: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two word sequences."""
    shared = present(item, other)
    item, weight, other = item[shared], weight[shared], other[present(other, item)]
    best = np.zeros(len(other) + 1)
    for word, w in zip(item, weight):
        take = best[:-1] + w * (other == word)
        np.maximum(best[1:], take, out=best[1:])
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def summed_runs(rows: np.ndarray, first: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each run of ``size`` entries of ``rows`` from ``first`` on, the sum of these rows of a table."""
    out = np.zeros((len(first), table.shape[1]), table.dtype)
    # Longest first: those that have a next row are the first few.
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    for ahead in range(int(size.max(initial=0))):
        more = int(np.searchsorted(-size, -ahead, "left"))
        out[:more] += table[rows[first[:more] + ahead]]
    back = np.empty_like(out)
    back[order] = out
    return back


def cosine_of(one: np.ndarray, other: np.ndarray, idf: np.ndarray) -> float:
    """Cosine of the TF-IDF vectors of two word sequences."""
    (a, n), (b, m) = (np.unique(terms_of(x), return_counts=True) for x in (one, other))
    both, x, y = np.intersect1d(a, b, return_indices=True)
    return float((n[x] * m[y] * idf[both] ** 2).sum() / np.sqrt(((n * idf[a]) ** 2).sum() * ((m * idf[b]) ** 2).sum()))


def passages_of(items: DataFrame) -> DataFrame:
    """(row, text) of every passage of ``plain`` items (row, text)."""
    word = F.array_remove(F.split("text", " "), "")
    n = F.ceil(F.size("word") / PASSAGE).cast("int")
    first = lambda k: F.floor(F.size("word") * k / n).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice("word", first(k) + 1, first(k + 1) - first(k)), " "))
    return items.select("row", word.alias("word")).select("row", F.posexplode(cut).alias("k", "text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer) for every benchmark item that a document holds."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", plain(F.col(text)).alias("text"))
    total, counts = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + counts)).astype(np.float32) + np.float32(0.1)
    items = cut_lineage(benchmark.select(
        F.monotonically_increasing_id().alias("row"), "item_id", plain(F.trim("text")).alias("text"),
        plain(F.regexp_extract(F.trim("text"), r"(?s)([^.!?]+[.!?]*\s*)$", 1)).alias("answer")).filter(F.col("text").rlike(r"[^ ]")))
    passages = passages_of(items)
    blocks = -(-passages.count() // BLOCK_ITEMS)
    dealt = cut_lineage(passages.withColumn("block", F.pmod(F.xxhash64("row", "k"), F.lit(max(blocks, 1)))))
    found = [_scan(spark, docs, items, [dealt.filter(F.col("block") == i) for i in range(a, min(a + SCANNED, blocks))], idf) for a in range(0, blocks, SCANNED)]
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, overlap double, answer double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max(F.struct("overlap", "answer", "cosine")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.cosine", "m.overlap", "m.answer")


def _latent(block: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(rows, place, weighted, latent) of a block of passages: their items, and what windows are projected with."""
    rows = block.select("row", "text").toArrow()
    if not rows.num_rows:
        return None
    words, at = hashed_words(rows.column("text"))
    size = rows.num_rows
    rank = min(64, size)
    while True:
        term, vectors = decomposed(block.select("text").repartition(4), idf, rank)
        latent = np.zeros((size, vectors.shape[1]), np.float32)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            own, n = np.unique(terms_of(words[a:b]), return_counts=True)
            value = n * idf[own]
            latent[i] = (value / max(np.linalg.norm(value), 1e-12)) @ vectors[np.searchsorted(term, own)]
        if rank >= size or np.linalg.norm(latent, axis=1).min() >= KEPT:
            break
        rank = min(2 * rank, size)
    place = np.full(TERMS, len(term), np.int32)
    place[term] = np.arange(len(term))
    weighted = np.vstack([vectors * idf[term][:, None], np.zeros((1, vectors.shape[1]), np.float32)])
    return rows.column("row").to_numpy(), place, weighted, latent


def _heavy_words(words: np.ndarray, at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, item, share) of the heaviest words of items shorter than a window, by word; and the share each item needs."""
    found, need = [], np.full(len(at) - 1, np.inf)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        if b - a < WINDOW:
            own, n = np.unique(words[a:b], return_counts=True)
            one = idf[terms_of(own)].astype(np.float64)
            one /= (n * one).sum()
            order = np.argsort(-one, kind="stable")
            share = np.cumsum((n * one)[order])
            some = order[:np.searchsorted(share, HEAVY - 1e-9) + 1]
            need[i] = (n * one)[some].sum() - (1 - PARAPHRASE) - 1e-6
            found += zip(own[some].tolist(), [i] * len(some), one[some].tolist())
    found.sort()
    word, item, share = (np.array([x[k] for x in found], t) for k, t in enumerate((np.uint64, np.int64, np.float64)))
    return word, item, share, need


def _scan(spark: SparkSession, docs: DataFrame, items: DataFrame, blocks: list[DataFrame], idf: np.ndarray) -> DataFrame:
    """Matches of the items of some blocks of passages, whose number is bounded."""
    models = [x for x in (_latent(block, idf) for block in blocks) if x is not None]
    used = np.unique(np.concatenate([x[0] for x in models])) if models else np.zeros(0, np.int64)
    rows = items.join(spark.createDataFrame(pa.table({"row": used})), "row").orderBy("row").toArrow()
    ids = rows.column("item_id").to_numpy(zero_copy_only=False)
    words, at = hashed_words(rows.column("text"))
    answers, answer_at = hashed_words(rows.column("answer"))
    models = [(np.searchsorted(used, row), *more) for row, *more in models]
    shared = spark.sparkContext.broadcast((idf, models, _heavy_words(words, at, idf), ids, words, at, answers, answer_at))

    def scan(batches):
        idf, models, heavy, ids, item_words, item_at, answers, answer_at = shared.value
        heavy_word, heavy_item, heavy_share, need = heavy
        heavy_term = np.zeros(TERMS, bool)
        heavy_term[terms_of(heavy_word)] = True
        size_of = np.diff(item_at)

        def similar(term, at):
            """(text, item, first, last, cosine) of regions whose windows are like a passage of an item."""
            size = np.diff(at)
            full = np.flatnonzero(size)
            # Steps of STRIDE words, the last of a text shorter; a window is WINDOW // STRIDE steps.
            steps = -(-size[full] // STRIDE)
            step_at = np.concatenate([[0], np.cumsum(steps)])
            start = np.repeat(at[full], steps) + STRIDE * (np.arange(step_at[-1]) - np.repeat(step_at[:-1], steps))
            of = np.repeat(full, steps)
            weight = idf[term].astype(np.float64) ** 2

            def windows(one):
                out = one.copy()
                for ahead in range(1, WINDOW // STRIDE):
                    same = of[ahead:] == of[:-ahead]
                    out[:-ahead][same] += one[ahead:][same]
                return out

            all_weight = windows(np.add.reduceat(weight, start))
            hit, item, score = [], [], []
            for item_of, place, weighted, latent in models:
                row = place[term]
                known = row < len(weighted) - 1
                able = np.flatnonzero(windows(np.add.reduceat(weight * known, start)) >= COSINE ** 2 * all_weight)
                here = np.flatnonzero(known)
                row, first = row[here], np.searchsorted(here, np.append(start, len(term)))
                for a in range(0, len(able), PROJECTED):
                    part = able[a:a + PROJECTED]
                    # Windows overlap, so each of their steps is summed once; beyond its text a window has no step.
                    own = part[:, None] + np.arange(WINDOW // STRIDE)
                    own[of[np.minimum(own, len(of) - 1)] != of[part][:, None]] = len(of)
                    own[own > len(of)] = len(of)
                    some, at_step = np.unique(own, return_inverse=True)
                    begin = first[some]
                    sums = summed_runs(row, begin, first[np.minimum(some + 1, len(of))] - begin, weighted)
                    vector = sums[at_step.reshape(own.shape)].sum(axis=1)
                    cosine = (vector @ latent.T) / np.sqrt(all_weight[part])[:, None]
                    x, y = np.nonzero(cosine >= COSINE)
                    hit.append(part[x]), item.append(item_of[y]), score.append(cosine[x, y])
            step, item, score = (np.concatenate(x) for x in (hit, item, score)) if hit else (np.zeros(0, np.int64),) * 3
            if not len(step):
                return
            order = np.lexsort((step, item, of[step]))
            step, item, score = step[order], item[order], score[order]
            # Windows of one text and item whose words are near each other are one region.
            new = np.ones(len(step), bool)
            new[1:] = (of[step][1:] != of[step][:-1]) | (item[1:] != item[:-1]) | (start[step][1:] > start[step][:-1] + WINDOW)
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(step)) - 1
            best = np.maximum.reduceat(score, begins)
            own = size_of[item[begins]]
            yield from zip(of[step[begins]], item[begins], start[step[begins]] - own, start[step[ends]] + WINDOW + own, best)

        def contained(words, term, at):
            """The same of stretches that may contain a short item; their cosine is against the stretch's own words."""
            near = np.flatnonzero(heavy_term[term])
            low = np.searchsorted(heavy_word, words[near])
            n = np.searchsorted(heavy_word, words[near], "right") - low
            if not n.sum():
                return
            entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            place, item, share = np.repeat(near, n), heavy_item[entry], heavy_share[entry]
            of = np.searchsorted(at, place, "right") - 1
            # Texts are set apart by more than a stretch, and items by all texts.
            key = item * (len(words) + 2 * WINDOW * len(at)) + place + 2 * WINDOW * of
            order = np.argsort(key)
            key, place, item, share, of = key[order], place[order], item[order], share[order], of[order]
            reach = size_of[item] + size_of[item] // 2
            total = np.concatenate([[0], np.cumsum(share)])
            held = total[np.searchsorted(key, key + reach)] - total[:-1]
            for x in np.flatnonzero(held >= need[item]):
                yield of[x], item[x], place[x] - reach[x] + 1, place[x] + reach[x], None

        for batch in slices(batches):
            words, at = hashed_words(batch.column("text"))
            if not len(words):
                continue
            term = terms_of(words)
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, i, first, last, top in (*similar(term, at), *contained(words, term, at)):
                own = item_words[item_at[i]:item_at[i + 1]]
                region = words[max(at[doc], first):min(at[doc + 1], last)]
                weight = idf[terms_of(own)]
                # No subsequence outweighs the item's words that are there at all.
                if weight[present(own, region)].sum(dtype=np.float64) < (PARAPHRASE - 1e-5) * weight.sum():
                    continue
                overlap = common_weight(own, weight, region) / weight.sum()
                if overlap < PARAPHRASE:
                    continue
                tail = answers[answer_at[i]:answer_at[i + 1]]
                tail_weight = idf[terms_of(tail)]
                answer = common_weight(tail, tail_weight, region) / tail_weight.sum() if len(tail) else 1.0
                if overlap >= SAME or answer >= ANSWER:
                    for column, value in zip(out, (doc, i, cosine_of(own, region, idf) if top is None else float(top), overlap, answer)):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(out[0])), pa.array(ids[out[1]], pa.int64()), *(pa.array(x, pa.float64()) for x in out[2:])],
                    names=["doc_id", "item_id", "cosine", "overlap", "answer"])

    return docs.mapInArrow(scan, "doc_id long, item_id long, cosine double, overlap double, answer double")


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
