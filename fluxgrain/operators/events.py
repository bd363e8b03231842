"""Onsets to population events: windows, bins, density, activation, order and lags."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrain.functions import kernels
from fluxgrain.functions.columns import keys


def range_join(onsets: DataFrame, windows: DataFrame, t: str, start: str, end: str, bucket: float | None = None) -> DataFrame:
    """Onsets in closed windows [start, end]. With a bucket width, windows are cut into buckets and the join is an equi-join with
    a residual test, which large window tables need; without one the planner broadcasts the side that it finds small."""
    inside = (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))
    if bucket is None:
        return onsets.join(windows, inside)
    lo, hi = F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)
    cut = windows.withColumn("bucket", F.explode(F.sequence(lo, hi)))
    return onsets.withColumn("bucket", F.floor(F.col(t) / bucket)).join(cut, "bucket").where(inside).drop("bucket")


def ordered_windows(windows: DataFrame) -> DataFrame:
    """Windows whose bounds are swapped where they are in the wrong order."""
    return windows.select("window", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"))


def counts_in_windows(onsets: DataFrame, windows: DataFrame, rois: DataFrame) -> DataFrame:
    """recording (if rois has it), roi, window, n for every region and window, 0 included. windows has frames."""
    w, key = ordered_windows(windows), keys(rois)
    n = range_join(onsets, w, "frame", "start", "end").groupBy(*key, "window").agg(F.count("*").alias("n"))
    return rois.crossJoin(w).join(n, [*key, "window"], "left").select(*key, "window", "start", "end", F.coalesce("n", F.lit(0)).alias("n"))


def frequencies(counts: DataFrame, fps: float) -> DataFrame:
    """hz: events over the window's duration, both ends included."""
    return counts.withColumn("hz", F.col("n") / ((F.col("end") - F.col("start") + 1) / fps))


def binned(onsets: DataFrame, bin_s: float) -> DataFrame:
    """recording (if there), roi, bin, first_t: activation in half-open bins with the earliest onset."""
    return onsets.groupBy(*keys(onsets), F.floor(F.col("t_s") / bin_s).alias("bin")).agg(F.min("t_s").alias("first_t"))


def density(onsets: DataFrame, bin_s: float, bins: int, n_rois: DataFrame) -> DataFrame:
    """bin, d: onsets a bin over the number of regions (one row `n`); every bin from 0 is there, the last one closed."""
    spine = onsets.sparkSession.range(bins).withColumnRenamed("id", "bin")
    at = F.least(F.floor(F.col("t_s") / bin_s), F.lit(bins - 1))
    n = onsets.groupBy(at.alias("bin")).agg(F.count("*").alias("c"))
    return spine.join(n, "bin", "left").crossJoin(F.broadcast(n_rois)).select("bin", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("d"))


def rank_order(active: DataFrame, event: str = "event") -> DataFrame:
    """Order of activation in each event (ties by roi) and the lag behind the first."""
    w = Window.partitionBy(*[c for c in ("recording",) if c in active.columns], event)
    return active.withColumn("rank", F.row_number().over(w.orderBy("first_t", "roi"))).withColumn("lag", F.col("first_t") - F.min("first_t").over(w))


def synchronous(binned_: DataFrame, n_rois: int, share: float) -> DataFrame:
    """Bins with at least ceil(share * n_rois) active regions, and whether each begins a run of such bins."""
    need = max(1, math.ceil(share * n_rois))
    hot = binned_.groupBy("bin").agg(F.count_distinct("roi").alias("active")).where(F.col("active") >= need)
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    before = F.lag("bin").over(w)
    return hot.withColumn("begins", before.isNull() | (F.col("bin") - before > 1))


def coactive_threshold(histogram: Sequence[tuple[int, int]], bins: int, n: int, share: float = 0.8, least: int = 20, most: int = 50, rounds: int = 300) -> int | None:
    """The number of active regions from which a bin counts, moved until between least and most bins do.

    histogram: (active regions, bins with so many). It starts at ceil(share * n), falls by 30% while too few bins count and rises
    by 10% while too many do, by one at least. None if no bin is active.
    """
    histogram = [(a, c) for a, c in histogram if a > 0]
    if not histogram or not bins:
        return None
    level = max(1, min(n, math.ceil(max(0.0, min(1.0, share)) * n)))
    kept = lambda t: sum(c for a, c in histogram if a >= t)
    if bins < least:
        return level
    for _ in range(rounds):
        k = kept(level)
        if least <= k <= most:
            break
        if k < least:
            if level == 1:
                break
            level = max(1, min(level - 1, math.floor(level * 0.7)))
        else:
            if level == n:
                break
            level = min(n, max(level + 1, math.ceil(level * 1.1)))
    return level


def coactive_bins(binned_: DataFrame, bins: int, n: int, share: float = 0.8, least: int = 20, most: int = 50) -> DataFrame:
    """bin, active of the highly co-active bins. Only the histogram over activity, n rows at most, comes to the driver."""
    per_bin = binned_.groupBy("bin").agg(F.count_distinct("roi").alias("active"))
    histogram = [(r["active"], r["c"]) for r in per_bin.groupBy("active").agg(F.count("*").alias("c")).collect()]
    level = coactive_threshold(histogram, bins, n, share, least, most)
    if level is None:
        return per_bin.limit(0)
    found = per_bin.where(F.col("active") >= level)
    if sum(c for a, c in histogram if a >= level) > most:
        found = found.orderBy(F.desc("active"), F.desc("bin")).limit(most)
    return found


def noise(df: DataFrame, key: Sequence[str], quiet: float = 0.4) -> DataFrame:
    """1.4826 * MAD of the residuals r up to their quiet-quantile; of all residuals where those are fewer than 32."""
    w = Window.partitionBy(*key)
    df = df.withColumn("calm", F.col("r") <= F.percentile("r", quiet).over(w))
    df = df.withColumn("few", F.count_if("calm").over(w) < 32).where("calm or few")
    df = df.withColumn("med", F.median("r").over(w))
    return df.groupBy(*key).agg((1.4826 * (F.median(F.abs(F.col("r") - F.col("med"))) + 1e-12)).alias("noise"), F.count("*").alias("n"))


def walked(df: DataFrame, key: Sequence[str], most: int) -> DataFrame:
    """For each row with is_peak: first and last index around it over the level (columns i, d, level), at most `most` steps away."""
    low = F.when(F.col("d") <= F.col("level"), F.col("i"))
    w = Window.partitionBy(*key).orderBy("i")
    df = df.withColumn("b", F.last(low, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("a", F.first(low, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    df = df.withColumn("first_i", F.min("i").over(Window.partitionBy(*key))).withColumn("last_i", F.max("i").over(Window.partitionBy(*key)))
    start = F.greatest(F.coalesce(F.col("b") + 1, "first_i"), F.col("i") - most)
    end = F.least(F.coalesce(F.col("a") - 1, "last_i"), F.col("i") + most)
    return df.where("is_peak").select(*key, "i", "d", start.alias("start"), end.alias("end"))


def merged(events: DataFrame, key: Sequence[str], gap: int) -> DataFrame:
    """Events that touch (start - latest end so far <= gap), ordered by i, become one; the taller peak stays, the earlier of equals."""
    w = Window.partitionBy(*key).orderBy("i")
    until = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("new", F.when(until.isNull() | (F.col("start") - until > gap), 1).otherwise(0))
    events = events.withColumn("event", F.sum("new").over(w))
    peak = F.max_by("i", F.struct("d", -F.col("i")))
    return events.groupBy(*key, "event").agg(F.min("start").alias("start"), peak.alias("peak"), F.max("end").alias("end"), F.max("d").alias("height"))


def moments(samples: DataFrame, key: Sequence[str], floor: float) -> DataFrame:
    """mu, sigma of samples t with weights max(w, 0); sigma at least floor. Both null without weight."""
    w = F.greatest("w", F.lit(0.0))
    s = samples.withColumn("w", w)
    total, mu = F.sum("w"), F.sum(F.col("t") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))
    out = s.withColumn("mu", F.sum(F.col("t") * F.col("w")).over(Window.partitionBy(*key)) / F.nullif(F.sum("w").over(Window.partitionBy(*key)), F.lit(0.0)))
    var = F.sum((F.col("t") - F.col("mu")) * (F.col("t") - F.col("mu")) * F.col("w")) / F.nullif(total, F.lit(0.0))
    return out.groupBy(*key).agg(mu.alias("mu"), F.greatest(F.sqrt(var), F.lit(floor)).alias("sigma"))


EVENT_SCHEMA = "event_id int, start_s double, peak_s double, end_s double, peak_height double, prominence double, duration_s double, mu_s double, sigma_s double, src_left string, src_right string"


def population_events(onsets: DataFrame, params: kernels.EventParams, key: str = "recording") -> DataFrame:
    """Event windows of each recording from its onsets (key, roi, t_s): density, peaks, bounded events. Onsets are counted by bin
    first, so that a group holds the bins of a recording, however many regions and onsets it has."""
    kind = onsets.schema[key].dataType.simpleString()
    width = F.lit(params.bin_s)
    i = F.floor(F.col("t_s") / width)
    i = F.when(F.col("t_s") < i * width, i - 1).when(F.col("t_s") >= (i + 1) * width, i + 1).otherwise(i)  # bins as the edges have it
    counts = onsets.where("t_s >= 0").groupBy(key, i.alias("bin")).agg(F.count("*").alias("n"))
    whole = onsets.groupBy(key).agg(F.max("t_s").alias("last"), F.count_distinct("roi").alias("rois"))

    def one(x: pd.DataFrame) -> pd.DataFrame:
        series = np.zeros(int(x["bin"].max()) + 1)
        series[x["bin"].to_numpy(int)] = x["n"]
        found = kernels.population_events(series, float(x["last"].iloc[0]) + params.bin_s, int(x["rois"].iloc[0]), params)
        out = pd.DataFrame(found, columns=[c.split()[0] for c in EVENT_SCHEMA.split(", ")][1:])
        out.insert(0, "event_id", np.arange(len(out), dtype=np.int32))
        out.insert(0, key, x[key].iloc[0])
        return out

    return counts.join(whole, key).groupBy(key).applyInPandas(one, f"{key} {kind}, {EVENT_SCHEMA}")


def density_peaks(series: DataFrame, key: str, params: kernels.EventParams) -> DataFrame:
    """key, bin, d of the peaks of each series (key, bin, d)."""
    kind = series.schema[key].dataType.simpleString()

    def one(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bin").reset_index(drop=True)
        at = kernels.find_peaks(x["d"].to_numpy(float), params.min_prominence, params.min_width_bins, max(1, round(params.min_distance_bins)))
        return x.iloc[at][[key, "bin", "d"]]

    return series.select(key, "bin", "d").groupBy(key).applyInPandas(one, f"{key} {kind}, bin long, d double")
