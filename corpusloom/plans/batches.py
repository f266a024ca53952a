"""Walking over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Texts are turned into Python objects this many at a time, or fewer if they are long; both only bound memory.
ROWS, BYTES = 1000, 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded rows and bytes; a single longer text is a slice of its own."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            size = min(ROWS, b.num_rows - at)
            while size > 1 and (pc.sum(pc.binary_length(b.column(text).slice(at, size))).as_py() or 0) > BYTES:
                size //= 2
            yield b.slice(at, size)
            at += size
