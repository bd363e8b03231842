"""Operators over traces. Long form: (recording, roi, frame, f) with one shuffle on (recording, roi); array form (roi, xs and any
other columns, which pass) where a step needs no shuffle. `key` names a region: by default recording, where there is one, and roi."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fluxgrain.functions import kernels
from fluxgrain.functions.columns import derivative, finite, hysteresis, keys, lowpass, mad_z, min_separation


def by_roi(df: DataFrame, key: Sequence[str] | None = None) -> WindowSpec:
    return Window.partitionBy(*keys(df, key)).orderBy("frame")


def subtract_neuropil(df: DataFrame, r: float = 0.7) -> DataFrame:
    return df.withColumn("v", F.col("f") - r * F.col("fneu"))


def shift_nonnegative(df: DataFrame, key: Sequence[str] = ("recording",)) -> DataFrame:
    """f and fneu moved up by one amount for each recording, so that neither is negative. One aggregate row a recording is joined."""
    shift = F.greatest(F.lit(0.0), -F.least(F.min("f"), F.min("fneu"))).alias("shift")
    return df.join(df.groupBy(*key).agg(shift), list(key)).withColumn("f", F.col("f") + F.col("shift")).withColumn("fneu", F.col("fneu") + F.col("shift"))


def fill_gaps(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Null and NaN samples by linear interpolation over frames, ends held."""
    x = finite(F.col("f"))
    here = F.when(x.isNotNull(), F.struct("frame", x.alias("x")))
    w = by_roi(df, key)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("p", F.last(here, ignorenulls=True).over(before)).withColumn("q", F.first(here, ignorenulls=True).over(after))
    share = (F.col("frame") - F.col("p.frame")) / (F.col("q.frame") - F.col("p.frame"))
    blend = F.when(F.col("p.frame") == F.col("q.frame"), F.col("p.x")).otherwise(F.col("p.x") + (F.col("q.x") - F.col("p.x")) * share)
    return df.withColumn("v", F.coalesce(blend, "p.x", "q.x")).drop("p", "q")


def dff_first(df: DataFrame, frames: int, baseline: str = "percentile", p: float = 0.1, key: Sequence[str] | None = None) -> DataFrame:
    """(f - F0) / F0 with F0 from the first frames: their p-quantile (floor 1e-9) or mean (floor 1e-6)."""
    w, head = Window.partitionBy(*keys(df, key)), F.when(F.col("frame") < frames, F.col("f"))
    f0 = F.greatest(F.percentile(head, p).over(w), F.lit(1e-9)) if baseline == "percentile" else F.greatest(F.avg(head).over(w), F.lit(1e-6))
    return df.withColumn("f0", f0).withColumn("dff", (F.col("f") - F.col("f0")) / F.col("f0"))


def neighbours(xs: Column, i: Column, half: int) -> Column:
    """The values at i - half .. i + half of an array, its ends repeated."""
    return F.transform(F.sequence(i - half, i + half), lambda k: F.get(xs, F.least(F.greatest(k, F.lit(0)), F.size(xs) - 1)).cast("double"))


def dff_rolling(arrays: DataFrame, size: int, p: float, lift: float = 0.0) -> DataFrame:
    """recording (if there), roi, dff: (f - F0) over one scalar, the 1st percentile of F0, which is a rank filter with repeated ends.
    Arrow batches, no shuffle."""
    key = keys(arrays)

    def one(x: np.ndarray) -> np.ndarray:
        f0 = kernels.percentile_filter(x, size, p)
        return (x - f0) / max(np.percentile(f0, 1), 1e-9)

    def run(batches):
        for x in batches:
            yield x[key].assign(dff=[one(np.asarray(v, float) + lift) for v in x["xs"]])

    return arrays.select(*key, "xs").mapInPandas(run, f"{typed(arrays, key)}, dff array<double>")


def typed(df: DataFrame, columns: Sequence[str]) -> str:
    """Names and types of columns, for the schema of a kernel's output."""
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def smooth_gaussian(arrays: DataFrame, sigma: float) -> DataFrame:
    """ys: Gaussian smoothing of radius int(4 * sigma + 0.5), ends repeated."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    weights = F.array(*(F.lit(x / sum(w)) for x in w))
    at = F.sequence(F.lit(0), F.size("xs") - 1)

    def one(i: Column) -> Column:
        terms = F.zip_with(neighbours(F.col("xs"), i, r), weights, lambda x, w: x * w)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return arrays.withColumn("ys", F.transform(at, one))


def lowpass_arrays(arrays: DataFrame, cutoff: float, fs: float) -> DataFrame:
    return arrays.withColumn("ys", lowpass(F.col("xs"), cutoff, fs))


def savgol5(arrays: DataFrame, fps: float) -> DataFrame:
    """ys: derivative of quadratic fits over 5 samples; the two samples at each end use the first and last fit."""
    xs, n = F.col("xs"), F.size("xs")

    def one(i: Column) -> Column:
        c = F.least(F.greatest(i, F.lit(2)), n - 3)
        v = [F.get(xs, c + k).cast("double") for k in (-2, -1, 0, 1, 2)]
        slope = (-2 * v[0] - v[1] + v[3] + 2 * v[4]) / 10.0
        bend = (2 * v[0] - v[1] - 2 * v[2] - v[3] + 2 * v[4]) / 14.0
        return (slope + 2 * bend * (i - c)) * fps

    return arrays.withColumn("ys", F.transform(F.sequence(F.lit(0), n - 1), one))


def derivative5(df: DataFrame, fps: float, poly: int = 2, key: Sequence[str] | None = None) -> DataFrame:
    """The long form of the interior of savgol5 (null at the ends); poly 3 or 4 uses the matching weights."""
    weights, divisor = ((-2, -1, 0, 1, 2), 10.0) if poly < 3 else ((1, -8, 0, 8, -1), 12.0)
    return df.withColumn("dt", derivative(F.col("f"), by_roi(df, key), fps, weights, divisor))


def power_spectrum(arrays: DataFrame) -> DataFrame:
    """recording (if there), roi, k, power: |sum x[t] exp(-2 pi i k t / n)|^2 for k up to n / 2, by fast transforms over Arrow batches."""
    key = keys(arrays)

    def run(batches):
        for x in batches:
            yield x[key].assign(power=[np.abs(np.fft.rfft(np.asarray(v, float))) ** 2 if len(v) else np.zeros(0) for v in x["xs"]])

    out = arrays.select(*key, "xs").mapInPandas(run, f"{typed(arrays, key)}, power array<double>")
    return out.select(*key, F.posexplode("power").alias("k", "power")).withColumn("k", F.col("k").cast("long"))


def robust_z(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    med, z = mad_z(F.col("f"), keys(df, key))
    return df.withColumn("med", med).withColumn("z", z)


def onsets(df: DataFrame, hi: float = 3.5, lo: float = 1.5, key: Sequence[str] | None = None) -> DataFrame:
    """Rows where the hysteresis state of z begins."""
    w = by_roi(df, key)
    active = df.withColumn("active", hysteresis(F.col("z"), hi, lo, w))
    active = active.withColumn("was", F.coalesce(F.lag("active").over(w), F.lit(0)))
    return active.where("active = 1 and was = 0").drop("active", "was")


def separated(on: DataFrame, least: int, key: Sequence[str] | None = None) -> DataFrame:
    """The key and frame of the onsets that are at least `least` frames after the last one kept."""
    key = keys(on, key)
    kept = on.groupBy(*key).agg(min_separation(F.collect_list("frame"), least).alias("frames"))
    return kept.select(*key, F.explode("frames").alias("frame"))


def downsample(df: DataFrame, block: int, frames: int, key: Sequence[str] | None = None) -> DataFrame:
    """The key, bin, v: block means; frames past the last whole block are left out."""
    return df.where(F.col("frame") < frames // block * block).groupBy(*keys(df, key), F.floor(F.col("frame") / block).alias("bin")).agg(F.avg("f").alias("v"))


def to_uint8(df: DataFrame, value: str, key: Sequence[str] | None = None) -> DataFrame:
    """u8: value scaled from its 1st-99th percentile to 0..255, 0 where those are equal."""
    ends = F.percentile(value, F.array(F.lit(0.01), F.lit(0.99))).over(Window.partitionBy(*keys(df, key)))
    df = df.withColumn("ends", ends).withColumn("lo", F.get("ends", F.lit(0))).withColumn("hi", F.get("ends", F.lit(1)))
    share = F.least(F.greatest((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return df.withColumn("u8", F.when(F.col("hi") > F.col("lo"), F.floor(share * 255 + 0.5)).otherwise(0).cast("int")).drop("ends", "lo", "hi")


def process(df: DataFrame, fps: float, cutoff: float = 1.0, window_s: float = 45.0, sg_ms: float = 333.0, init: str = "first") -> DataFrame:
    """dff, low, dt of each (recording, roi): rolling baseline, causal low-pass, derivative. One shuffle gathers a trace into an
    array; batches of traces then pass through the kernels."""
    samples = df.groupBy("recording", "roi").agg(F.sort_array(F.collect_list(F.struct("frame", "f"))).alias("s"))
    arrays = samples.select("recording", "roi", F.transform("s", lambda x: x["frame"]).alias("frame"), F.transform("s", lambda x: x["f"]).alias("xs"))

    def run(batches):
        for x in batches:
            dff = [kernels.dff_rolling(np.asarray(v, float), fps, window_s) for v in x["xs"]]
            low = [kernels.lowpass(v, cutoff, fps, init) for v in dff]
            dt = [kernels.savgol_derivative(v, fps, sg_ms, 2) for v in low]
            yield pd.DataFrame({"recording": x["recording"], "roi": x["roi"], "frame": x["frame"], "dff": dff, "low": low, "dt": dt})

    kind = df.schema["recording"].dataType.simpleString()
    out = arrays.mapInPandas(run, f"recording {kind}, roi long, frame array<long>, dff array<double>, low array<double>, dt array<double>")
    return out.select("recording", "roi", F.inline(F.arrays_zip("frame", "dff", "low", "dt")))


def process_arrays(arrays: DataFrame, fps: float, cutoff: float = 1.0, window_s: float = 45.0, sg_ms: float = 333.0) -> DataFrame:
    """The same from the array form, without any shuffle: recording (if there), roi, dff, low, dt arrays."""
    key = keys(arrays)

    def run(batches):
        for x in batches:
            dff = [kernels.dff_rolling(np.asarray(v, float), fps, window_s) for v in x["xs"]]
            low = [kernels.lowpass(v, cutoff, fps) for v in dff]
            yield x[key].assign(dff=dff, low=low, dt=[kernels.savgol_derivative(v, fps, sg_ms, 2) for v in low])

    return arrays.select(*key, "xs").mapInPandas(run, f"{typed(arrays, key)}, dff array<double>, low array<double>, dt array<double>")
