"""State carried along ordered rows, whatever part of a key's rows lies where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmint.sources.settled import settled


def filled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each null in ``columns`` becomes the key's last value before it in ``order`` (unique within a key), if any.

    A window by key would put a key into one task. Here ranges of (keys, order) are filled each by itself, and a range
    that begins inside a key takes what the ranges before it end with. At most one key crosses a border between ranges,
    so there are fewer such rows than ranges, and those are broadcast.
    """
    dealt = settled(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    ends = dealt.groupBy(*keys, "_part").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_value")))).alias(c) for c in columns))
    along = Window.partitionBy(*keys).orderBy("_part")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    crossing = ends.select(
        *(F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)), F.col("_part").alias("_at"), F.row_number().over(along).alias("_nth"), *(F.last(F.col(f"{c}._value"), ignorenulls=True).over(before).alias(f"_before_{c}") for c in columns),
    ).where("_nth > 1").drop("_nth")
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    own = dealt.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    met = F.col("_part") == F.col("_at")
    for n, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_key{n}"))
    joined = own.join(F.broadcast(crossing), met, "left")
    return joined.select(*(F.coalesce(c, f"_before_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


BLOCK = 1 << 16  # numbers of one block


def filled_in_blocks(rows: DataFrame, key: str, number: str, column: str, block: int = BLOCK) -> DataFrame:
    """``filled`` for rows that a whole ``number`` orders within their key: blocks of so many numbers need no sample to be dealt.

    Each block is filled by itself, in one shuffle, and the rows are kept so; what the blocks before it end with, a row a
    block, is broadcast.
    """
    inside = Window.partitionBy(key, "_block").orderBy(number)
    own = settled(rows.withColumn("_block", F.call_function("div", F.col(number), F.lit(block))).withColumn(column, F.last(column, ignorenulls=True).over(inside)))
    ends = own.groupBy(key, "_block").agg(F.max(F.when(F.col(column).isNotNull(), F.struct(number, F.col(column).alias("_value")))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    crossing = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.last("_end._value", ignorenulls=True).over(before).alias("_before")).where("_before is not null")
    joined = own.join(F.broadcast(crossing), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_at")), "left")
    return joined.select(*(F.coalesce(column, "_before").alias(column) if c == column else F.col(c) for c in rows.columns))


def runs(rows: DataFrame, keys: Sequence[str], value: str, gap: float, name: str) -> DataFrame:
    """Rows whose ``value`` is not null, with ``name``: the least value of their run, where a key's values in order fall
    into runs that lie more than ``gap`` apart.

    Ranges of (keys, value) find their own runs; a range that begins inside a key takes from those before it the key's
    greatest value, then the beginning of its last run. Fewer rows than ranges are broadcast.
    """
    dealt = settled(rows.where(F.col(value).isNotNull()).repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))

    def with_greatest_before(marked: DataFrame, of: str, name: str) -> DataFrame:
        along = Window.partitionBy(*keys).orderBy("_part")
        ends = marked.groupBy(*keys, "_part").agg(F.max(of).alias("_end"))
        before = F.max("_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
        crossing = ends.select(*(F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)), F.col("_part").alias("_at"), before.alias(name), F.row_number().over(along).alias("_nth")).where("_nth > 1").drop("_nth")
        met = F.col("_part") == F.col("_at")
        for n, k in enumerate(keys):
            met = met & F.col(k).eqNullSafe(F.col(f"_key{n}"))
        return marked.join(F.broadcast(crossing), met, "left").drop("_at", *(f"_key{n}" for n in range(len(keys))))

    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    met = with_greatest_before(dealt, value, "_former")
    former = F.coalesce(F.lag(value).over(inside), "_former")
    begun = met.withColumn("_start", F.when(former.isNull() | (F.col(value) - former > gap), F.col(value)))
    own = with_greatest_before(begun, "_start", "_earlier")
    start = F.coalesce(F.max("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_earlier")
    return own.withColumn(name, start).drop("_part", "_former", "_start", "_earlier")
