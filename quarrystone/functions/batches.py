"""Parts of Arrow batches: a batch is bounded by its rows alone, so what is made of it has to be by its contents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Elements of lists that a worker handles at once.
ELEMENTS = 1 << 18


def parts(lists: pa.Array, limit: int = ELEMENTS) -> Iterator[tuple[int, int]]:
    """(begin, end) of consecutive rows with at most limit elements (or one row); memory is given back after each."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + limit, side="right")))
        yield at, end
        at = end
        pa.default_memory_pool().release_unused()
