"""Reworded copies of benchmark items against a brute-force common subsequence."""

import random

import numpy as np
import pyarrow as pa
import pytest

from timeweave.llm import decontamination
from timeweave.llm.words import hashed_words


def plainly(item, weight, other):
    """Weight of the heaviest common subsequence, cell by cell."""
    best = [0.0] * (len(other) + 1)
    for word, w in zip(item, weight):
        before = 0.0
        for j, own in enumerate(other):
            kept = best[j + 1]
            best[j + 1] = max(kept, best[j], before + w * (own == word))
            before = kept
    return best[-1]


def test_common_weight_is_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, other = (rng.integers(0, rng.integers(1, 12), rng.integers(0, 14)).astype(np.uint64) for _ in range(2))
        weight = rng.random(len(item))
        found = decontamination.common_weight(item, weight, other)
        assert found == pytest.approx(plainly(item, weight, other))
        assert found <= weight[decontamination.present(item, other)].sum() + 1e-9


def test_summed_runs():
    rng = np.random.default_rng(4)
    table = rng.random((9, 3))
    size = rng.integers(0, 5, 40)
    first = np.cumsum(size) - size
    rows = rng.integers(0, 9, size.sum())
    found = decontamination.summed_runs(rows, first, size, table)
    assert np.allclose(found, [table[rows[a:a + n]].sum(axis=0) for a, n in zip(first, size)])
    assert decontamination.summed_runs(rows, first[:0], size[:0], table).shape == (0, 3)


@pytest.mark.parametrize("fresh", [False, True])
def test_reworded_copies_are_found(spark, fresh):
    """60 items of 36 to 126 words between ordinary words; of the copies that the rule itself calls contained, nine tenths.

    Words are replaced by ordinary ones, or by words that occur nowhere else and so weigh most.
    """
    rng = random.Random(77)
    vocabulary = [f"w{k}" for k in range(20_000)]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    ordinary = lambda n: rng.choices(vocabulary, weights, k=n)
    items, texts, copies = [], [], {}
    for i in range(60):
        n = rng.randint(36, 126)
        question, answer = ordinary(n - 8), ordinary(8)
        items.append((i, " ".join(question) + ". " + " ".join(answer) + "."))
        for share in (0.2, 0.3, 0.35):
            copy = [w if int((k + 1) * share) == int(k * share) else f"new{i}x{k}x{share}" if fresh else ordinary(1)[0] for k, w in enumerate(question)] + answer
            copies[len(texts)] = (i, share, copy)
            texts.append(" ".join(ordinary(rng.randint(50, 300)) + copy + ordinary(rng.randint(50, 300))))
    clean = len(texts)
    texts += [" ".join(ordinary(rng.randint(100, 600))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not {d for d, _ in found if d >= clean}
    held = np.zeros(decontamination.TERMS, np.int64)
    for text in texts:
        held[np.unique(decontamination.terms_of(hashed_words(pa.array([text]))[0]))] += 1
    idf = np.log((1 + len(texts)) / (1 + held)) + 0.1
    for share in (0.2, 0.3, 0.35):
        due = hit = 0
        for d, (i, own, copy) in copies.items():
            if own == share:
                words = items[i][1].replace(".", "").split()
                weight = idf[decontamination.terms_of(hashed_words(pa.array([" ".join(words)]))[0])]
                if plainly(words, weight, copy) >= decontamination.PARAPHRASE * weight.sum():
                    due += 1
                    hit += (d, i) in found
        print(fresh, share, due, hit)
        assert due > 20 and hit >= 0.9 * due
