"""The rows that a cursor takes, block by block: scores by NumPy and bounds instead of one expression a pair.

A ``Chooser`` gets the columns of a block's left rows and of the right rows that it can reach.  It answers, for a left
row and several cursors, which of the next rows scores best from each.  ``walk`` follows one cursor, ``exits`` many;
cursors that meet go on as one, so that a band of entries costs little more than its first rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from timeweave.ordered import BLOCK

NEAR = 1 / 32
Columns = dict[str, list]
# (row, cursors, rows ahead, last right row) -> (best scores, their rows); places count within the block's right rows.
Choose = Callable[[int, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]
Chooser = Callable[[Columns, Columns, bool], Choose]


def close_distance(a: str, b: str, most: int) -> int | None:
    """The edit distance if it is at most ``most``: the furthest place reached on each diagonal by number of edits."""
    n, m = len(a), len(b)
    if abs(m - n) > most:
        return None
    reached: dict[int, int] = {}
    for edits in range(most + 1):
        now = {}
        for k in range(-edits, edits + 1):
            i = max(reached.get(k, -2) + 1, reached.get(k - 1, -2), reached.get(k + 1, -2) + 1) if edits else 0
            if i < 0 or i > n or i + k < 0 or i + k > m:
                i = min(i, n, m - k)
                if i < 0 or i + k < 0:
                    continue
            while i < n and a[i:i + 16] == b[i + k:i + k + 16] and i + 16 <= n and i + k + 16 <= m:
                i += 16
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            now[k] = i
        if now.get(m - n) == n:
            return edits
        reached = now
    return None


def distance(a: str, b: str) -> int:
    """The edit distance; a column of the table is held in the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, result, get = full, 0, len(a), places.get
    for c in b:
        same = get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(level | up)), up & level
        if more & top:
            result += 1
        elif less & top:
            result -= 1
        more = more << 1 | 1
        up, down = (less << 1 | ~(vertical | more)) & full, more & vertical & full
    return result


def text_chooser(left: Columns, right: Columns, last_wins: bool, least: float = 0.35) -> Choose:
    """By ``similarity`` of the keys; scores below ``least`` may be given as less.

    A distance within ``NEAR`` of the longer length is found by few steps and beats all others, so the whole distance is
    counted only where there is none, and only of rows whose lengths allow a better score than the best so far.
    """
    ours, theirs = ([key or "" for key in side["key"]] for side in (left, right))

    def choose(row: int, cursors: np.ndarray, ahead: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        own, scores = ours[row], {}

        def near(at: int) -> float | None:
            other = theirs[at]
            longer = max(len(own), len(other))
            if not own or not other:
                return 0.0
            found = close_distance(own, other, int(longer * NEAR))
            return None if found is None else 1 - found / longer

        known: dict[int, float | None] = {}
        best = []
        for cursor in cursors.tolist():
            window = range(cursor, min(cursor + ahead, last + 1))
            for at in window:
                if at not in known:
                    known[at] = near(at)
            found = [(known[at], at) for at in window if known[at] is not None and known[at] >= 1 - NEAR]
            if not found:
                top = least
                bound = {at: 1 - abs(len(own) - len(theirs[at])) / max(1, len(own), len(theirs[at])) for at in window}
                for at in sorted(window, key=lambda at: -bound[at]):
                    if known[at] is None and at not in scores and bound[at] >= top:
                        scores[at] = 1 - distance(own, theirs[at]) / max(len(own), len(theirs[at]))
                    value = known[at] if known[at] is not None else scores.get(at, -1.0)
                    top = max(top, value)
                    found.append((value, at))
            best.append(max(found, key=lambda x: (x[0], x[1] if last_wins else -x[1])))
        return np.array([s for s, _ in best]), np.array([at for _, at in best], np.int64)

    return choose


def distances(text: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Edit distances of a text to many, whose characters are the columns of ``others``."""
    row = np.zeros((len(others) + 1, others.shape[1]), np.int32)  # each cell less its place in the other text
    for i, c in enumerate(text, 1):
        after = np.empty_like(row)
        after[0] = i
        np.minimum(row[:-1] - (others == c), row[1:] + 1, out=after[1:])
        row = np.minimum.accumulate(after, axis=0, out=after)
    return row[lengths, np.arange(others.shape[1])] + lengths


def link_chooser(left: Columns, right: Columns, last_wins: bool) -> Choose:
    """By ``mapping.match_score``; the same numbers, all rows before the cursors of a left row at once."""
    points, others = ([np.frombuffer((key or "").encode("utf-32-le"), np.uint32) for key in side["key"]] for side in (left, right))
    lengths = np.array([len(key) for key in others], np.int64)
    letters = np.zeros((lengths.max(initial=0), len(lengths)), np.uint32)
    for at, key in enumerate(others):
        letters[:len(key), at] = key
    numbers, durations = np.array(right["number"], object), np.array(right["duration_ms"], np.int64)

    def scored(row: int, ats: np.ndarray) -> np.ndarray:
        size = left["text_length"][row] or 0
        expected, lasting = max(10_000, size * 260), durations[ats]
        lasts = np.where((size > 0) & (lasting > 0), np.minimum(expected, lasting) / np.maximum(expected, lasting), 0.0)
        same = (numbers[ats] == left["number"][row]).astype(float) if left["number"][row] else np.zeros(len(ats))
        own, others = points[row], lengths[ats]
        alike = np.zeros(len(ats))
        if len(own):
            most = int(others.max(initial=0))
            alike = np.where(others > 0, 1 - distances(own, letters[:most, ats], others) / np.maximum(len(own), others), 0.0)
        return same * 0.55 + alike * 0.35 + lasts * 0.10

    def choose(row: int, cursors: np.ndarray, ahead: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        window = cursors[:, None] + np.arange(ahead)
        valid = window <= last
        first = int(cursors.min())
        asked = np.zeros(min(last, int(cursors.max()) + ahead - 1) - first + 1, bool)
        asked[window[valid] - first] = True
        values = np.full(len(asked) + ahead, -np.inf)
        values[np.flatnonzero(asked)] = scored(row, np.flatnonzero(asked) + first)
        seen = np.where(valid, values[np.minimum(window - first, len(asked))], -np.inf)
        at = ahead - 1 - seen[:, ::-1].argmax(axis=1) if last_wins else seen.argmax(axis=1)
        return seen[np.arange(len(cursors)), at], cursors + at

    return choose


def taken(choose: Choose, row: int, cursors: np.ndarray, ahead: int, last: int, threshold: float | None, left_after: list | None) -> tuple[np.ndarray, np.ndarray]:
    """(score, row taken) for each cursor, -1 for none; ``left_after`` forces the cursor's own row."""
    scores, at = choose(row, cursors, ahead, last)
    if threshold is not None:
        at = np.where(scores >= threshold, at, -1)
    if left_after is not None:
        due = last + 1 - cursors == left_after[row]
        if due.any():
            scores[due], at[due] = choose(row, cursors[due], 1, last)
    return scores, at


def exits(choose: Choose, rows: int, cursors: np.ndarray, last: int, *rule) -> np.ndarray:
    """Where cursors stand behind the rows of a block."""
    ahead, threshold, left_after = rule
    current, of = np.unique(cursors, return_inverse=True)
    for row in range(rows):
        live = current <= last
        if not live.any():
            break
        _, at = taken(choose, row, current[live], ahead, last, threshold, left_after)
        moved = current.copy()
        moved[live] = np.where(at >= 0, at + 1, current[live])
        current, to = np.unique(moved, return_inverse=True)
        of = to[of]
    return current[of]


def walk(choose: Choose, rows: int, cursor: int, last: int, *rule) -> list[tuple[int, int, float]]:
    """(row of the block, right row, score) taken by one cursor."""
    ahead, threshold, left_after = rule
    out = []
    for row in range(rows):
        if cursor > last:
            break
        score, at = taken(choose, row, np.array([cursor]), ahead, last, threshold, left_after)
        if at[0] >= 0:
            out.append((row, int(at[0]), float(score[0])))
            cursor = int(at[0]) + 1
    return out


def blocks(batches: Iterator[pa.RecordBatch], chooser: Chooser, last_wins: bool, forced: bool) -> Iterator[tuple]:
    """Each block of loaded rows: ``(batch, place in it, choose, rows, base, last, left_after)``, ``last`` counted from the base."""
    def columns(batch: pa.RecordBatch, name: str, at: int) -> Columns:
        values = batch.column(name)[at].values
        return {} if values is None else {f.name: values.field(f.name).to_pylist() for f in values.type}

    for batch in batches:
        for at in range(batch.num_rows):
            left, right = columns(batch, "rows", at), columns(batch, "__near", at)
            base, last = batch.column("__base")[at].as_py(), batch.column("__last")[at].as_py()
            # A block that no right row follows has none to choose from, wherever the last one stands.
            rows = len(left["rank"]) if right.get("ord") else 0
            yield batch, at, chooser(left, right, last_wins) if rows else None, rows, base, last - base, left["left_after"] if forced else None


def exit_rows(batches: Iterator[pa.RecordBatch], chooser: Chooser, group: str, piece: int, rule: tuple) -> Iterator[pa.RecordBatch]:
    """(group, block, piece, exits) of the pieces that each loaded block lists."""
    ahead, threshold, forced, last_wins = rule
    for batch, at, choose, rows, base, last, left_after in blocks(batches, chooser, last_wins, forced):
        pieces = np.array(batch.column("pieces")[at].as_py(), np.int64)
        entries = (pieces[:, None] * piece + np.arange(piece)).ravel() - base
        ends = exits(choose, rows, entries, last, ahead, threshold, left_after) + base
        index = pa.array(np.full(len(pieces), at))
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(pieces) + 1) * piece).astype(np.int32)), pa.array(ends))
        yield pa.RecordBatch.from_arrays([batch.column(group).take(index), batch.column(BLOCK).take(index), pa.array(pieces), lists],
                                         names=[group, BLOCK, "piece", "exits"])


def taken_rows(batches: Iterator[pa.RecordBatch], chooser: Chooser, group: str, rule: tuple) -> Iterator[pa.RecordBatch]:
    """(group, rank, ord, score) taken in each loaded block from its entry on."""
    ahead, threshold, forced, last_wins = rule
    for batch, at, choose, rows, base, last, left_after in blocks(batches, chooser, last_wins, forced):
        found = walk(choose, rows, batch.column("entry")[at].as_py() - base, last, ahead, threshold, left_after)
        ranks = batch.column("rows")[at].values.field("rank")
        row, right, score = (np.array(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(group).take(pa.array(np.full(len(row), at, np.int64))), ranks.take(pa.array(row)).cast(pa.int64()), pa.array(right + base), pa.array(score)],
            names=[group, "rank", "ord", "score"])
