"""Rows that a helper reads out of files, as Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa

#: Rows of a batch, and letters and bytes after which it is handed on.
BATCH_ROWS, BATCH_SIZE = 4096, 1 << 22


def batched(rows: Iterator[Sequence[object]], names: Sequence[str], kinds: Sequence[pa.DataType], most: int = BATCH_ROWS, size: int = BATCH_SIZE) -> Iterator[pa.RecordBatch]:
    """``rows`` in their order; a batch ends with ``most`` rows, or with the row that takes it to ``size`` letters and bytes."""
    held: list[Sequence[object]] = []
    weight = 0

    def whole() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))

    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most or weight >= size:
            yield whole()
            held, weight = [], 0
    if held:
        yield whole()
