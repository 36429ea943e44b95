"""Python work on one row at a time: however many rows an Arrow batch brings, a worker holds few of them as Python objects."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: rows taken from a batch at a time, and rows put into one
ROWS, OUT = 16, 2048


def plain(c: pa.Array) -> list:
    """to_pylist, but lists are cut from all their values together, so that no Arrow scalar is made for each value."""
    if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
        values, ends = plain(c.flatten()), list(accumulate((n or 0 for n in plain(pc.list_value_length(c))), initial=0))
        return [values[i:j] if ok else None for i, j, ok in zip(ends, ends[1:], c.is_valid().to_numpy(zero_copy_only=False))]
    quick = pa.types.is_integer(c.type) or pa.types.is_string(c.type) or pa.types.is_large_string(c.type)
    return c.to_numpy(zero_copy_only=False).tolist() if quick and not c.null_count else c.to_pylist()


def columns(b: pa.RecordBatch) -> dict[str, list]:
    """The columns as Python lists; lists of numbers that have no nulls in them are NumPy arrays."""
    out = {}
    for name, c in zip(b.schema.names, b.columns):
        flat = c.flatten() if c.type in (pa.list_(pa.float64()), pa.large_list(pa.float64())) else None
        if flat is None or flat.null_count:
            out[name] = plain(c)
        else:
            values, at = flat.to_numpy(), np.concatenate([[0], np.cumsum([n or 0 for n in pc.list_value_length(c).to_pylist()])])
            out[name] = [values[at[i] : at[i + 1]] if ok else None for i, ok in enumerate(c.is_valid().to_pylist())]
    return out


def records(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[dict]:
    try:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                held = columns(b.slice(i, rows))
                yield from (dict(zip(held, r)) for r in zip(*held.values()))
    finally:
        # workers outlive their tasks and share an executor's memory
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not every C library has it
            pass


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kind])


def together(found: Iterable[tuple], schema: pa.Schema, out: int = OUT) -> Iterator[pa.RecordBatch]:
    """Rows as batches of so many."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*held), schema)], schema=schema)

    for row in found:
        held.append(row)
        if len(held) >= out:
            yield batch()
            held = []
    if held:
        yield batch()


def map_rows(rows: DataFrame, f: Callable[[dict], Iterable[tuple]], schema: str | T.StructType, out: int = OUT) -> DataFrame:
    """What f makes of each row, as tuples of schema."""
    made = arrow_schema(schema)
    return rows.mapInArrow(lambda batches: together((x for r in records(batches) for x in f(r)), made, out), schema)
