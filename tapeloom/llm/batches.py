"""Apply a Python function to slices of Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at a time; one longer text makes a slice of its own.
SLICE_BYTES = 2_000_000


def slices(batch: pa.RecordBatch, text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``most`` bytes in the string column ``text_at``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, key_cols: list, text: str, fn: Callable[[list], dict], out: str, most: int = SLICE_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """One output row per input row: the key columns, then what ``fn`` gives for the texts.

    ``fn`` takes a list of texts (None where null) and returns lists or arrays by the column names of
    the DDL string ``out``. Only the key columns and the text leave the scan, so further columns of
    ``df``, whatever their names, are not read. ``done`` is called at the end of each task: Spark keeps Python workers
    for later stages, so what ``fn`` remembers would stay in them.
    """
    named = [c if not isinstance(c, str) else F.col(f"`{c}`") for c in key_cols]
    keys = df.select(*named).schema.fields
    own = "__text" + "_" * max(len(k.name) for k in [*keys, T.StructField("", T.LongType())])  # a name that no key has
    picked = df.select(*named, F.col(f"`{text}`").cast("string").alias(own))
    schema = T.StructType([*keys, *T._parse_datatype_string(out).fields])
    arrow, names, last = to_arrow_schema(schema), T._parse_datatype_string(out).names, len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, last, most):
                    made = fn(part.column(last).to_pylist())
                    columns = [part.column(i).cast(arrow.field(i).type) for i in range(last)]
                    columns += [pa.array(made[n], type=arrow.field(last + k).type) for k, n in enumerate(names)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            if done:
                done()

    return picked.mapInArrow(run, schema)
