"""Window work over long regions, cut into blocks of positions so that no task holds a whole region.

Frames of a bounded reach get copies of the rows beyond a block's edges (`with_halo`); running totals are taken within
blocks and start from what earlier blocks add up to (`running`), which is one row for each block of a region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import by_key, materialize

#: positions in a block
SPAN = 4096
BLOCK, OWN = "block_", "own_"


def block_of(at: Column, span: int = SPAN) -> Column:
    return F.floor(at / span).cast("int")


def with_halo(rows: DataFrame, reach: int | Column, at: str = "idx", span: int = SPAN, ahead: int | Column | None = None, ends: bool = False) -> DataFrame:
    """Adds block_ and own_: every row in its block (own_), and in every other that is within reach (ahead: where the reach
    towards later blocks is another). ends: adds the block's first and last position, from_ and to_."""
    at, ahead = F.col(at), reach if ahead is None else ahead
    near = F.sequence(F.greatest(F.lit(0), block_of(at - reach, span)), F.greatest(F.lit(0), block_of(at + ahead, span)))
    rows = rows.withColumn(BLOCK, F.explode(near)).withColumn(OWN, F.col(BLOCK) == block_of(at, span))
    return rows.withColumns({"from_": F.col(BLOCK) * span, "to_": F.col(BLOCK) * span + span - 1}) if ends else rows


def running(rows: DataFrame, keys: list[str], at: str, columns: list[str], span: int = SPAN) -> DataFrame:
    """keys, at and the running totals of columns up to each position; rows of one position are added up first."""
    each = rows.groupBy(*keys, at).agg(*(F.sum(c).alias(c) for c in columns)).withColumn(BLOCK, block_of(F.col(at), span))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    each = each.select(*keys, at, BLOCK, *(F.sum(c).over(inside).alias(c) for c in columns), F.lead(at).over(Window.partitionBy(*keys, BLOCK).orderBy(at)).isNull().alias("end_"))
    # a block's last row has its sum: the carries of a region are one row for each block
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carries = each.where("end_").select(*keys, BLOCK, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns))
    return each.join(by_key(carries), [*keys, BLOCK]).select(*keys, at, *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in columns))


def numbered(rows: DataFrame, by: str, name: str) -> DataFrame:
    """Adds a row's place (from 0) in the order of a column: ranges are counted, and numbered one after another."""
    ranges = materialize(rows.repartitionByRange(by).withColumn("range_", F.spark_partition_id()), "ranges")
    # one row for each range, as many as shuffle partitions
    before = F.coalesce(F.sum("count").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("range_").count().select("range_", before.alias("start_"))
    place = F.col("start_") + F.row_number().over(Window.partitionBy("range_").orderBy(by)) - 1
    return ranges.join(F.broadcast(starts), "range_").withColumn(name, place.cast("long")).drop("range_", "start_")


def dyadic(low: Column, high: Column) -> Column:
    """(level, node) of the fewest aligned runs of 2 ** level positions that make up [low, high]; empty where high < low."""
    end = high + 1

    def at(l: Column) -> Column:
        run = F.pow(F.lit(2.0), l)
        left, right = F.ceil(low / run).cast("int"), F.floor(end / run).cast("int")
        after = left + left % 2
        node = lambda i: F.struct(l.cast("int").alias("level"), i.alias("node"))
        return F.array(F.when((left % 2 == 1) & (left < right), node(left)), F.when((right % 2 == 1) & (after < right), node(right - 1)))

    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.lit(1), end - low).cast("double"))).cast("int")))
    return F.when(high >= low, F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<level:int,node:int>>"))
