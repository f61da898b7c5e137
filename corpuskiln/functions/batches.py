"""Slices of the Arrow batches that Spark hands to Python.

A batch holds up to 10,000 rows. Functions that work slice by slice, and give each
result back before the next slice, hold the work of one slice only, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SLICE_ROWS = 1024
SLICE_BYTES = 4_000_000


def slices(texts: pa.Array, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``rows`` texts, each closed by the text that brings it to ``size`` bytes."""
    start, taken = 0, 0
    for at, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), start=1):
        taken += length
        if taken >= size or at - start == rows:
            yield texts.slice(start, at - start)
            start, taken = at, 0
    if start < len(texts):
        yield texts.slice(start)
