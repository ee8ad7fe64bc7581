"""Arrow batches cut by the size of their texts, so that a batch of long texts takes no more memory at once than one of short ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on by itself.
TEXT_BYTES = 8 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of at most ``most`` bytes of text (one row at least); empty batches vanish."""
    most = most or TEXT_BYTES
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b
