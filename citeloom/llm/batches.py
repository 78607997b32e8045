"""Arrow batches in slices, so that a worker holds few texts as Python objects at a time, however long they are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[list[list]]:
    """The columns of each slice as lists."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            part = batch.slice(low, rows)
            yield [part.column(i).to_pylist() for i in range(part.num_columns)]
