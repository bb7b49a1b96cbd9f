"""Arrow batches of texts in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21  # bytes of the texts that are worked on at once; a longer text has a slice of its own


def text_slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Consecutive rows with the bytes of their column ``name`` (binary; null is empty), some at a time."""
    for batch in batches:
        texts = batch.column(name)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start), [t or b"" for t in texts.slice(start, stop - start).to_pylist()]
            start = stop


def with_columns(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more.values()], names=[*keep, *more])


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive values as one list for each size."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
