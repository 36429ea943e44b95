"""Rows that hold for runs of boundaries, spread over these in NumPy inside of tasks.

Spark deals the rows to blocks and sorts them; a task goes over its blocks once and holds the rows that reach beyond what it
has seen, and a bounded number of (row, boundary) pairs. Rows for each boundary are made only where they are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftline.operators.blocks import BLOCK
from weftline.operators.pieces import arrow_schema
from weftline.schema import KEY

#: (row, boundary) pairs made at a time; one boundary's are never parted
PAIRS = 1 << 18
AT = [*KEY, BLOCK]

#: make(columns by pair, boundary by pair, first pairs of each boundary) gives the columns of each boundary; pairs are in order of
#: place, then symbol (`rank` among `names`), then the other columns
Make = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, pa.Array], dict[str, pa.Array | np.ndarray]]


def lists(names: pa.Array, rank: np.ndarray, wanted: np.ndarray, starts: np.ndarray) -> pa.Array:
    """For each run of pairs the names of those that are wanted."""
    counts = np.add.reduceat(wanted.astype(np.int64), starts)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), names.take(pa.array(rank[wanted])))


def groups(t: pa.Table) -> np.ndarray:
    """The number of each row's block, in the order of rows."""
    change = np.zeros(t.num_rows, bool)
    for c in AT:
        codes = pc.dictionary_encode(t[c].combine_chunks(), null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)


def pieces(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of places [lo, hi] of rows `at`, cut into parts of few pairs; a place is a block's number and a boundary."""
    total = int((hi - lo + 1).sum())
    first, last = int(lo.min()), int(hi.max())
    if total <= PAIRS or first == last:
        yield lo, hi, at
        return
    a, b = first >> 32, last >> 32
    cut = (a + b + 1) // 2 << 32 if a < b else (first + last + 1) // 2
    for keep, l, h in ((lo < cut, lo, np.minimum(hi, cut - 1)), (hi >= cut, np.maximum(lo, cut), hi)):
        if keep.any():
            yield from pieces(l[keep], h[keep], at[keep])


def spread(rows: DataFrame, make: Make, schema: str) -> DataFrame:
    """AT, b and what make gives for each boundary from low to high of some row; rows: AT, low, high, symbol, numbers."""
    schema = f"path string, region_id string, {BLOCK} int, b int, {schema}"
    made = arrow_schema(schema)

    def batch(t: pa.Table, numbers: dict[str, np.ndarray], rank: np.ndarray, names: pa.Array, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        n = hi - lo + 1
        p = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        of = np.repeat(at, n)
        order = np.lexsort((*(v[of] for v in numbers.values()), rank[of], p))
        p, of = p[order], of[order]
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        cells = make({"rank": rank[of], **{k: v[of] for k, v in numbers.items()}}, p & 0xFFFFFFFF, starts, names)
        rows = pa.array(of[starts])
        cells |= {c: t[c].take(rows).combine_chunks() for c in AT} | {"b": p[starts] & 0xFFFFFFFF}
        columns = [cells[x.name] if isinstance(cells[x.name], pa.Array) else pa.array(cells[x.name], x.type) for x in made]
        return pa.RecordBatch.from_arrays(columns, schema=made)

    def emit(t: pa.Table, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(at):
            return
        coded = pc.dictionary_encode(t["symbol"].combine_chunks(), null_encoding="encode")
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.argsort(order)[coded.indices.to_numpy()]
        numbers = {c: t[c].to_numpy() for c in t.column_names if c not in (*AT, "low", "high", "symbol")}
        for l, h, a in pieces(lo, hi, at):
            yield batch(t, numbers, rank, coded.dictionary.take(pa.array(order)), l, h, a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in batches:
            if not part.num_rows:
                continue
            t = pa.Table.from_batches([part])
            t = t if held is None else pa.concat_tables([held, t])
            g, low, high = groups(t) << 32, t["low"].to_numpy(), t["high"].to_numpy()
            # rows come in order of low: later ones of the last block add nothing before this place
            seen = g[-1] + low[-1]
            done, rest = np.flatnonzero(g + low < seen), np.flatnonzero(g + high >= seen)
            yield from emit(t, (g + low)[done], np.minimum(g + high, seen - 1)[done], done)
            held = t.take(pa.array(rest))
            low_field = held.schema.field("low")
            held = held.set_column(held.schema.get_field_index("low"), low_field, pa.array(np.maximum(low[rest], low[-1]), low_field.type))
        if held is not None:
            g = groups(held) << 32
            yield from emit(held, g + held["low"].to_numpy(), g + held["high"].to_numpy(), np.arange(held.num_rows))

    # what comes out has new names in Spark's eyes, so it is dealt once more; joins with other facts of the blocks then move nothing
    return rows.repartition(*AT).sortWithinPartitions(*AT, "low").mapInArrow(run, schema).repartition(*AT)
