"""Maps over texts that keep the text where the function fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.batches import slices


def _mapped(batches: Iterator[pa.RecordBatch], f: Callable[[str], str]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out, errors = [], []
        for text in b.column("text").to_pylist():
            try:
                out.append(None if text is None else f(text))
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                out.append(text)
                errors.append(type(e).__name__)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["id", "text", "error"])


def map_texts(docs: DataFrame, f: Callable[[str], str], id: str = "doc_id") -> DataFrame:
    """(id, text, error): f of each text, or the text as it was with the name of the error that f raised. Null stays null."""
    return docs.select(F.col(id).alias("id"), "text").mapInArrow(lambda it: _mapped(it, f), "id bigint, text string, error string").withColumnRenamed("id", id)
