"""Column expressions over the long trace table (recording columns, roi, frame, value). All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MAD_FACTOR = 1.4826  # fixed value: makes the MAD of normal data its standard deviation


def keys(df: DataFrame, key: Sequence[str] | None = None) -> list[str]:
    """The columns that name a region: the given ones, else recording, where the table has it, and roi. Recordings number their
    regions on their own, so a table of several must have the column."""
    return list(key) if key else [c for c in ("recording", "roi") if c in df.columns]


def finite(x: Column) -> Column:
    """x where it is a number; NaN becomes null, since Spark orders NaN above all numbers."""
    return F.when(~F.isnan(x), x)


def mad_z(x: Column, key: Sequence[str], eps: float = 1e-12) -> tuple[Column, Column]:
    """Median over key, and the robust z score given a column `med` that holds it. Two windows over one partitioning."""
    w = Window.partitionBy(*key)
    return F.median(x).over(w), (x - F.col("med")) / (F.lit(MAD_FACTOR) * (F.median(F.abs(x - F.col("med"))).over(w) + eps))


def zscore(x: Column, key: Sequence[str], zero_std: str = "zero") -> Column:
    """Population z score; zero_std says what a constant group gives: zero, null, one (divide by 1) or eps (add 1e-8)."""
    w = Window.partitionBy(*key)
    mean, sd = F.avg(x).over(w), F.stddev_pop(x).over(w)
    if zero_std == "eps":
        return (x - mean) / (sd + 1e-8)
    if zero_std == "one":
        return (x - mean) / F.when(sd == 0, 1.0).otherwise(sd)
    return F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0) if zero_std == "zero" else F.lit(None))


def hysteresis(z: Column, hi: float, lo: float, order: WindowSpec) -> Column:
    """Whether the state is active: it becomes so at z >= hi and stops being so at z <= lo. Needs hi > lo."""
    z = finite(z)
    flag = F.when(z >= hi, 1).when(z <= lo, 0)
    return F.coalesce(F.last(flag, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def min_separation(frames: Column, least: int) -> Column:
    """The sorted frames of an array that are at least `least` after the last one kept."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(
        F.sort_array(frames),
        none,
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) >= least), F.array_append(kept, x)).otherwise(kept),
    )


def derivative(x: Column, order: WindowSpec, fps: float, coefficients: Sequence[float], divisor: float) -> Column:
    """A centred difference filter: sum of coefficients times x at offsets -h..h, times fps."""
    half = len(coefficients) // 2
    terms = [c * F.lag(x, -k).over(order) for k, c in zip(range(-half, half + 1), coefficients, strict=True) if c]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / divisor * fps


def butter2(cutoff: float, fs: float) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of the second-order low-pass by the bilinear transform; the cutoff is held in [1e-4, 0.95 * fs / 2]."""
    k = math.tan(math.pi * min(max(cutoff, 1e-4), 0.95 * fs / 2) / fs)
    n = 1 / (1 + math.sqrt(2) * k + k * k)
    return k * k * n, 2 * k * k * n, k * k * n, 2 * (k * k - 1) * n, (1 - math.sqrt(2) * k + k * k) * n


def lowpass(values: Column, cutoff: float, fs: float, init: str = "first") -> Column:
    """The filtered array of an array; state starts at its first value ("first") or at 0 ("zero"). For short arrays: it copies."""
    b0, b1, b2, a1, a2 = butter2(cutoff, fs)
    x0 = F.element_at(values, 1).cast("double") if init == "first" else F.lit(0.0)
    start = F.struct(x0.alias("z0"), x0.alias("z1"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        x = x.cast("double")
        y = b0 * x + s["z0"]
        return F.struct((b1 * x - a1 * y + s["z1"]).alias("z0"), (b2 * x - a2 * y).alias("z1"), F.array_append(s["out"], y).alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def half_even(x: Column) -> Column:
    """Rounding to integers with ties to even."""
    return F.bround(x, 0)
