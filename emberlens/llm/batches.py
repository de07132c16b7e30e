"""Arrow batches of texts in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text (in ``column``) each, so that few texts are Python strings at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
