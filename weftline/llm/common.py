"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the key, the text (null: empty) and the columns in keep go on, so further or clashing columns don't matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *keep)


def give_back() -> None:
    """Returns freed memory to the system: Python workers outlive their tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller record batches: of so many rows, or of so many bytes of text and a last row that passes them, at most.

    So a worker holds few long texts as Python objects at once.
    """
    try:
        for b in batches:
            if "text" in b.schema.names:
                ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            else:
                ends = np.zeros(b.num_rows, np.int64)
            i = 0
            while i < b.num_rows:
                before = ends[i - 1] if i else 0
                j = min(i + rows, int(np.searchsorted(ends, before + size)) + 1, b.num_rows)
                yield b.slice(i, j - i)
                i = j
    finally:
        if not isinstance(batches, list):
            give_back()


def map_texts(docs: DataFrame, f: Callable[[list[str]], dict[str, list]], schema: str, rows: int = 512) -> DataFrame:
    """Puts the columns that f makes of a list of texts in the place of `text`, before the others; one row out per row in."""
    others = [x for x in docs.schema.fields if x.name not in ("doc_id", "text")]
    names = [x.split()[0] for x in schema.split(",")]
    out = T.StructType([T.StructField("doc_id", T.LongType()), *T.StructType.fromDDL(schema).fields, *others])
    kinds = {x.name: to_arrow_type(x.dataType) for x in out}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows):
            got = f(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(got[n], kinds[n]) for n in names), *(b.column(x.name) for x in others)], names=[f.name for f in out])

    return docs.mapInArrow(run, out)
