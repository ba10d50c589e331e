"""Small helpers over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``most`` bytes in ``column`` each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first one, cut only where its value changes.

    A group that spans batches is put together once, when it is complete. Columns are fixed-width and hold no null.
    """
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        if held and cols[0][-1] == held[0][0][0]:
            held.append([c.copy() for c in cols])
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if held or last:
            yield [np.concatenate(x) for x in zip(*held, [c[:last] for c in cols], strict=True)]
        held = [[c[last:].copy() for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
