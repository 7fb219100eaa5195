"""Cutting Arrow batches by the bytes of their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], most: int, column: int = -1) -> Iterator[pa.RecordBatch]:
    """``batches`` in pieces of about ``most`` bytes of text in ``column``, one row at least; rows without any share a piece. A batch
    whose column isn't text stays whole."""
    for batch in batches:
        text = batch.column(column % batch.num_columns)
        if not (pa.types.is_string(text.type) or pa.types.is_large_string(text.type)):
            yield batch
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, until - at)
            at = until
