"""Money on decimals: half-up rounding, proportional splits, tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dec(x: Column | str, scale: int = 2) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(f"decimal(18,{scale})")


def out(x: Column) -> Column:
    """A money result as double, the form in which queries return it."""
    return x.cast("double")


def half_up(x: Column, places: int = 2) -> Column:
    return F.round(x.cast("decimal(38,10)"), places)


def within(a: Column, b: Column, cents: str = "0.01") -> Column:
    """Equal up to a tolerance."""
    return F.abs(a - b) <= F.lit(cents).cast("decimal(18,6)")


def split_in_proportion(rows: DataFrame, key: str, total: str, weight: str, order: str, into: str) -> DataFrame:
    """Share ``total`` over a key's rows by weight in cents; the rounding rest goes to the largest weight, first in order.

    Rows of a key without weight share nothing but the rest.
    """
    by_key = Window.partitionBy(key)
    whole = F.sum(F.abs(weight)).over(by_key)
    cents = lambda x: (x * 100).cast("decimal(18,0)")
    double_whole = cents(whole) * 2
    # Half up in whole cents: a decimal quotient would be rounded twice.
    share = F.when(whole == 0, F.lit(0)).otherwise(
        F.call_function("div", F.abs(cents(F.col(total))) * cents(F.abs(weight)) * 2 + cents(whole), double_whole) * F.signum(F.col(total)).cast("int")
    )
    share = (share.cast("decimal(18,2)") / 100).cast("decimal(18,2)")
    largest = F.row_number().over(by_key.orderBy(F.desc(F.abs(weight)), order)) == 1
    rest = F.col(total) - F.sum("_share").over(by_key)
    return rows.withColumn("_share", share).withColumn(into, (F.col("_share") + F.when(largest, rest).otherwise(0)).cast("decimal(18,2)")).drop("_share")
