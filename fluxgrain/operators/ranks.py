"""Running totals and ranks over a whole table without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is cut into; so many numbers, approximate quantiles, come to the driver.
CUTS = 128


def ranged(df: DataFrame, by: str, cuts: int = CUTS) -> DataFrame:
    """df with _range, which rises with by (a number without nulls): how many of its approximate quantiles lie below."""
    bounds = sorted(set(df.select(F.col(by).cast("double").alias("x")).approxQuantile("x", [i / cuts for i in range(1, cuts)], 0.002)))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(by))) if bounds else F.lit(0)
    return df.withColumn("_range", at)


def running_totals(df: DataFrame, by: str, values: Sequence[str], cuts: int = CUTS) -> DataFrame:
    """df with upto_<value> for each value: its sum over all rows whose by isn't larger. Sums inside each range, and what lies
    before it: a prefix sum in two steps, so that no task sees more than a range."""
    r = ranged(df, by, cuts)
    totals = r.groupBy("_range").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select("_range", *(F.coalesce(F.sum(f"_t_{v}").over(order), F.lit(0)).alias(f"_b_{v}") for v in values))
    inside = Window.partitionBy("_range").orderBy(by)
    out = r.join(before, "_range")
    return out.select(*df.columns, *((F.sum(v).over(inside) + F.col(f"_b_{v}")).alias(f"upto_{v}") for v in values))


def row_numbers(df: DataFrame, by: str, order: Sequence[Column], name: str, cuts: int = CUTS) -> DataFrame:
    """df with name: row numbers from 1 by order, whose first column rises with by."""
    r = ranged(df, by, cuts)
    totals = r.groupBy("_range").agg(F.count("*").alias("_n"))
    before = totals.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = r.join(before, "_range")
    n = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return out.select(*df.columns, n.cast("long").alias(name))
