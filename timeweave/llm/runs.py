"""Streaming through sorted Arrow batches, one run of equal keys after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs and the n + 1 offsets of the runs; rows come sorted by integer ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cuts = np.zeros(len(table) - 1, bool)
        for key in keys:
            values = table.column(key).to_numpy()
            cuts |= values[1:] != values[:-1]
        starts = np.flatnonzero(cuts) + 1
        if len(starts):
            yield table.slice(0, starts[-1]).combine_chunks(), np.concatenate([[0], starts])
            held = table.slice(starts[-1])
        else:
            held = table
    if held is not None:
        yield held.combine_chunks(), np.array([0, len(held)])
