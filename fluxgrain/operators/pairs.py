"""Pairs of regions: lagged correlation, permutation and surrogate statistics, false-discovery control.

Positive lags pair a[t + k] with b[t]: at a positive best lag, a is delayed against b.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrain.operators import blocks as B


def cluster_pairs(clusters: DataFrame, with_self: bool = True) -> DataFrame:
    """cluster_a, cluster_b: unordered pairs of cluster names, which are few."""
    a, b = clusters.select(F.col("cluster").alias("cluster_a")).distinct(), clusters.select(F.col("cluster").alias("cluster_b")).distinct()
    return a.join(b, F.col("cluster_a") <= F.col("cluster_b") if with_self else F.col("cluster_a") < F.col("cluster_b"))


def _clustered(traces: DataFrame, clusters: DataFrame) -> tuple[DataFrame, list[str]]:
    rec = ["recording"] if "recording" in traces.columns and "recording" in clusters.columns else []
    return traces.join(clusters, [*rec, "roi"]).select(*rec, "cluster", "roi", "xs" if "xs" in traces.columns else "zs"), rec


def _most(zf: np.ndarray, most: int) -> int:
    return min(most, zf.shape[1] - 1)


def xcorr_blocks(traces: DataFrame, clusters: DataFrame, most: int, block: int = 256, with_self: bool = True) -> DataFrame:
    """All pairs of all cluster pairs by matrix products: recording (if there), cluster_a, cluster_b, roi_a, roi_b, best_lag, max_corr,
    zero_lag.

    traces: roi, zs (z-scored array). Clusters are cut into blocks of at least `block` regions (operators/blocks.py), so that no task
    sees a whole large cluster.
    """
    arrays, rec = _clustered(traces, clusters)

    def work(tiles, _):
        for t in tiles:
            lag, best, zero = B.peaks(t[1], t[3], _most(t[1], most))
            yield B.pair_columns(t, best_lag=lag, max_corr=best, zero_lag=zero)

    return B.over_pairs(arrays, work, "roi_a long, roi_b long, best_lag int, max_corr double, zero_lag double", rec, "cluster", with_self, block)


def xcorr_means(traces: DataFrame, clusters: DataFrame, most: int, with_self: bool = True) -> DataFrame:
    """recording (if there), cluster_a, cluster_b, n, mean_max, mean_zero: xcorr_blocks summed up by cluster pair where it is computed."""
    arrays, rec = _clustered(traces, clusters)

    def work(tiles, _):
        n, high, zero = 0, 0.0, 0.0
        for t in tiles:
            _, best, at0 = B.peaks(t[1], t[3], _most(t[1], most))
            n, high, zero = n + best.size, high + best.sum(), zero + at0.sum()
        yield {"n": [n], "high": [high], "zero": [zero]}

    s = B.over_pairs(arrays, work, "n long, high double, zero double", rec, "cluster", with_self)
    n = F.sum("n")
    return s.groupBy(*rec, "cluster_a", "cluster_b").agg(n.alias("n"), (F.sum("high") / n).alias("mean_max"), (F.sum("zero") / n).alias("mean_zero"))


def xcorr_lags(traces: DataFrame, clusters: DataFrame, most: int, with_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """Best lags by cluster pair, counted where they are computed: (recording,) cluster_a, cluster_b, best_lag, n; and for sign flips
    cluster_a, cluster_b, row, best_lag, n: the sums of the lags by the remainder of roi_a * 1_000_003 + roi_b that decides their signs."""
    arrays, rec = _clustered(traces, clusters)

    def work(tiles, _):
        counts, sums, of = np.zeros(2 * most + 1, np.int64), np.zeros(MODULUS), np.zeros(MODULUS, np.int64)
        for t in tiles:
            lag, _, _ = B.peaks(t[1], t[3], _most(t[1], most))
            counts += np.bincount(lag.ravel() + most, minlength=2 * most + 1)
            row = (t[0] * 1_000_003 % MODULUS)[:, None] + (t[2] % MODULUS)[None]
            row -= (row >= MODULUS) * MODULUS
            sums += np.bincount(row.ravel(), lag.ravel(), MODULUS)  # whole numbers: exact
            of += np.bincount(row.ravel(), minlength=MODULUS)
        seen, some = np.flatnonzero(counts), np.flatnonzero(of)
        yield {"at": -1 - seen, "total": counts[seen] * (seen - most), "n": counts[seen]}
        yield {"at": some, "total": sums[some].astype(np.int64), "n": of[some]}

    s = B.over_pairs(arrays, work, "at long, total long, n long", rec, "cluster", with_self)
    keys = [*rec, "cluster_a", "cluster_b"]
    # which is which is asked of an aggregate, so that no filter is pushed below it and both tables read the one computation
    s = s.groupBy(*keys, "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("at").alias("kind"))
    counted = s.where("kind < 0").select(*keys, F.expr("CAST(total DIV n AS INT)").alias("best_lag"), "n")
    return counted, s.where("kind >= 0").select(*keys, F.col("at").alias("row"), F.col("total").alias("best_lag"), "n")


def benjamini_hochberg(p: DataFrame, key: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """p_fdr (p * m / rank, made monotone from the largest p down, at most 1) and reject."""
    w = Window.partitionBy(*key)
    p = p.withColumn("m", F.count("p").over(w)).withColumn("rank", F.row_number().over(w.orderBy("p")))
    down = w.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col("p") * F.col("m") / F.col("rank")).over(down))
    passing = F.max(F.when(F.col("p") <= alpha * F.col("rank") / F.col("m"), F.col("p"))).over(w)
    return p.withColumn("p_fdr", adjusted).withColumn("reject", F.coalesce(F.col("p") <= passing, F.lit(False))).drop("m", "rank")


def pair_stats(pairs: DataFrame, key: Sequence[str], value: str, least: int = 10, count: str | None = None) -> DataFrame:
    """n, mean, median, interquartile range and share of positive values, for groups of at least `least`. count: a column that says how
    often a row's value occurs."""
    n = F.sum(count) if count else F.count("*")
    mean = F.sum(F.col(value) * F.col(count)) / n if count else F.avg(value)
    positive = F.sum(F.when(F.col(value) > 0, F.col(count)).otherwise(0)) / n if count else F.avg((F.col(value) > 0).cast("double"))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), *([F.col(count)] if count else []))
    s = pairs.groupBy(*key).agg(n.alias("n"), mean.alias("mean"), q.alias("q"), positive.alias("frac_pos"))
    return s.where(F.col("n") >= least).select(*key, "n", "mean", F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), "frac_pos")


#: Signs depend on a row's number modulo this.
MODULUS = 65521


def sign(i: Column, perm: Column, seed: int = 1) -> Column:
    """A pseudo-random sign from integer arithmetic, the same in any engine."""
    h = (i * 7919 + perm * 104729 + F.lit(seed) * 15485863) % MODULUS
    return F.when((h * h % MODULUS) % 2 == 0, 1).otherwise(-1)


def signflip(pairs: DataFrame, key: Sequence[str], value: str, row: str, rounds: int, plus_one: bool = False, count: str | None = None, seed: int = 1) -> DataFrame:
    """Two-sided p of the mean under random signs. A sign depends on the row modulo MODULUS, so values are summed by it first, and a
    round costs that many rows of a group at most. count: a column with the number of rows, where values are such sums already."""
    n = F.sum(count) if count else F.count(value)
    by = pairs.groupBy(*key, (F.col(row).cast("long") % MODULUS).alias("_row")).agg(F.sum(F.col(value).cast("double")).alias("_v"), n.alias("_n"))

    def one(name: tuple, x: pd.DataFrame) -> pd.DataFrame:
        rows, sums, total = x["_row"].to_numpy(), x["_v"].fillna(0).to_numpy(), x["_n"].sum()
        null = np.empty(rounds)
        for i in range(rounds):
            h = (rows * 7919 + i * 104729 + seed * 15485863) % MODULUS
            null[i] = np.where(h * h % MODULUS % 2 == 0, sums, -sums).sum()
        mean = sums.sum() / total if total else np.nan
        hits = int((np.abs(null / max(1, total)) >= abs(mean) - 1e-12).sum())
        return pd.DataFrame(dict(zip(key, ([v] for v in name), strict=True)) | {"mean": [mean], "p": [(hits + 1) / (rounds + 1) if plus_one else hits / rounds]})

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in key)
    return by.groupBy(*key).applyInPandas(one, f"{kinds}, mean double, p double")


def shift_surrogates(pairs: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """Of pairs (roi_a, roi_b, za, zb arrays): r, the correlation at lag 0, and the p of |r| among circular shifts of b.

    Shifts come from integer arithmetic, uniform in 1..T/2. Array form: a pair is one row, nothing is shuffled.
    """
    n = F.size("za")

    def corr(shift: Column) -> Column:
        moved = F.when(shift == 0, F.col("zb")).otherwise(F.concat(F.slice("zb", F.lit(1) + shift, n), F.slice("zb", F.lit(1), shift)))
        return F.aggregate(F.zip_with("za", moved, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / n

    half = F.floor(n / 2).cast("int")

    def shift(i: Column) -> Column:
        h = (F.col("roi_a") * 31 + F.col("roi_b") * 17 + i * 7919 + F.lit(seed) * 104729) % 65521
        return ((h * h) % 65521 % half + 1).cast("int")

    r = pairs.withColumn("r", corr(F.lit(0)))
    nulls = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda i: corr(shift(i)))
    exceed = F.size(F.filter(nulls, lambda x: F.abs(x) >= F.abs("r") - 1e-12))
    return r.withColumn("exceed", exceed).withColumn("p", (F.col("exceed") + 1) / F.lit(rounds + 1))


@lru_cache(4)
def _draws(half: int, rounds: int, seed: int) -> list[np.ndarray]:
    """How often each of the shifts 1..half is drawn, by the remainder that a pair's draws depend on: bit i of the counts in the i-th
    array, a bit a shift, a row a word of bits, a column a remainder."""
    h = (np.arange(MODULUS)[:, None] + np.arange(rounds)[None] * 7919 + seed * 104729) % MODULUS
    counts = np.bincount((np.arange(MODULUS)[:, None] * half + h * h % MODULUS % half).ravel(), minlength=MODULUS * half).reshape(MODULUS, half)
    bits = [np.packbits(counts >> i & 1, axis=1, bitorder="little") for i in range(int(counts.max()).bit_length())]
    return [np.ascontiguousarray(np.pad(b, ((0, 0), (0, -b.shape[1] % 4))).view(np.uint32).T) for b in bits]


def _exceeding(t: B.Tile, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a tile's pairs: r, and how many of the shifts of shift_surrogates reach it. All shifts are matrix products; which of them
    reach r is a bit each, and those are counted as often as a pair draws them. Worked off in cells that fit a core's own cache."""
    n = t[1].shape[1]
    draws, both = _draws(n // 2, rounds, seed), np.concatenate([t[3], t[3]], axis=1)
    r, exceed = np.empty((len(t[0]), len(t[2]))), np.empty((len(t[0]), len(t[2])), np.int32)
    for i in range(0, r.shape[0], B.CELL[0]):
        for j in range(0, r.shape[1], B.CELL[1]):
            at = np.s_[i : i + B.CELL[0], j : j + B.CELL[1]]
            m = (t[0][at[0]] * 31 % MODULUS)[:, None] + (t[2][at[1]] * 17 % MODULUS)[None]
            m -= (m >= MODULUS) * MODULUS
            r[at], exceed[at] = _exceeding_cell(t[1][at[0]], both[at[1]], m, n, draws)
    return r, exceed


def _exceeding_cell(zf: np.ndarray, both: np.ndarray, m: np.ndarray, n: int, draws: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    r, parts = zf @ both[:, :n].T / n, zf / n
    least, exceed, null, high = np.abs(r) - 1e-12, np.zeros(r.shape, np.int32), np.empty(r.shape), np.empty(r.shape, bool)
    for word in range(len(draws[0])):
        reach = np.zeros((4, *r.shape), np.uint8)
        for s in range(32 * word, min(32 * word + 32, n // 2)):
            np.matmul(parts, both[:, s + 1 : s + 1 + n].T, out=null)
            np.greater_equal(np.abs(null, out=null), least, out=high)
            reach[s % 32 // 8] |= high.view(np.uint8) << np.uint8(s % 8)
        reach = np.ascontiguousarray(np.moveaxis(reach, 0, -1)).view(np.uint32)[..., 0]
        for i, drawn in enumerate(draws):
            exceed += np.bitwise_count(drawn[word].take(m) & reach).astype(np.int32) << i
    return r, exceed


def surrogates_within(arrays: DataFrame, by: Sequence[str], rounds: int, seed: int = 1, digits: int = 6) -> DataFrame:
    """by, roi_a, roi_b, r, exceed, p of all pairs roi_a < roi_b inside each group, as shift_surrogates has them, r and p rounded."""

    def work(tiles, _):
        for t in tiles:
            r, exceed = _exceeding(t, rounds, seed)
            yield B.pair_columns(t, r=B.rounded(r, digits), exceed=exceed, p=B.rounded((exceed + 1) / (rounds + 1), digits))

    return B.over_pairs(arrays, work, "roi_a long, roi_b long, r double, exceed long, p double", by)


def surrogate_sums(arrays: DataFrame, group: str, rounds: int, seed: int = 1, bins: int = 1 << 14) -> DataFrame:
    """group, n_pairs, mean_r, median_r, frac_p_low (no shift reaches r), min_p: surrogates_within summed up where it is computed.

    The median is exact: the first run counts r by bins, the second keeps the values of the bins that hold the middle ones. So many
    bins a group come to the driver."""
    place = lambda r: np.clip(((r + 1) * (bins / 2)).astype(int), 0, bins - 1)

    def work(tiles, _):
        n, total, low, least, counts = 0, 0.0, 0, rounds, np.zeros(bins, np.int64)
        for t in tiles:
            r, exceed = _exceeding(t, rounds, seed)
            if t[4] is not None:
                r, exceed = r[t[4]], exceed[t[4]]
            if r.size:
                n, total, low, least = n + r.size, total + r.sum(), low + int((exceed < 1).sum()), min(least, int(exceed.min()))
                counts += np.bincount(place(r).ravel(), minlength=bins)
        some = np.flatnonzero(counts)
        if n:
            yield {"bin": some, "count": counts[some], "total": np.zeros(len(some)), "low": np.zeros(len(some), int), "least": np.full(len(some), rounds)}
            yield {"bin": [-1], "count": [n], "total": [total], "low": [low], "least": [least]}

    s = B.over_pairs(arrays, work, "bin int, count long, total double, low long, least long", [group])
    found: dict = {}
    for x in s.groupBy(group, "bin").agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.sum("low").alias("low"), F.min("least").alias("least")).toLocalIterator():
        found.setdefault(x[group], {})[x["bin"]] = x
    middle, whole = {}, []
    for name, each in found.items():
        all_ = each.pop(-1)
        at, upto = sorted(each), np.cumsum([each[b]["count"] for b in sorted(each)])
        first, last = (int(np.searchsorted(upto, i, "right")) for i in ((all_["count"] - 1) // 2, all_["count"] // 2))
        before = int(upto[first - 1]) if first else 0
        middle[name] = (at[first], at[last])
        whole.append((name, all_["count"], all_["total"] / all_["count"], all_["low"] / all_["count"], (all_["least"] + 1) / (rounds + 1), (all_["count"] - 1) // 2 - before, all_["count"] // 2 - before))

    def near(tiles, unit):
        for t in tiles:
            r = t[1] @ t[3].T / t[1].shape[1]
            r = r.ravel() if t[4] is None else r[t[4]]
            yield {"r": r[np.isin(place(r), middle[unit[group]])]}

    kind = arrays.schema[group].dataType.simpleString()
    whole = arrays.sparkSession.createDataFrame(whole, f"{group} {kind}, n_pairs long, mean_r double, frac_p_low double, min_p double, i int, j int")
    values = B.over_pairs(arrays, near, "r double", [group]).groupBy(group).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    median = (F.get("rs", F.col("i")) + F.get("rs", F.col("j"))) / 2
    return values.join(whole, group).select(group, "n_pairs", "mean_r", median.alias("median_r"), "frac_p_low", "min_p")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def curve_blocks(arrays: DataFrame, most: int, block: int = 128) -> DataFrame:
    """grp, roi_a, roi_b, rs: the sums over t of a[t + k] * b[t] for k = -most..most, of all pairs roi_a < roi_b inside each group.

    arrays: grp (long), roi, zs (of one length inside a group). A group is cut into blocks of at least `block` regions
    (operators/blocks.py), so that no task sees a large group whole. Whoever needs less of a curve takes curve_peaks, curve_points
    or the like, which reduce it where it is computed.
    """

    def work(tiles, _):
        for t in tiles:
            sums = np.stack([B.lagged(t[1], t[3], k) for k in range(-most, most + 1)], axis=-1)
            c = B.pair_columns(t, rs=sums)
            n, width = c["rs"].shape
            yield c | {"rs": pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(c["rs"].ravel()))}

    return B.over_pairs(arrays, work, "roi_a long, roi_b long, rs array<double>", ["grp"], block=block)


def correlations_across(arrays: DataFrame, kind: str, by: Sequence[str], digits: int = 6) -> DataFrame:
    """by, <kind>_a, <kind>_b, roi_a, roi_b, r: correlation at lag 0, rounded, of all pairs of different kinds; roi_a is of the lesser."""

    def work(tiles, _):
        for t in tiles:
            yield B.pair_columns(t, r=B.rounded(B.lagged(t[1], t[3], 0) / t[1].shape[1], digits))

    return B.over_pairs(arrays, work, "roi_a long, roi_b long, r double", by, kind, with_self=False)


def curve_points(arrays: DataFrame, most: int, scale: float | None = None, digits: int = 6) -> DataFrame:
    """grp, roi_a, roi_b, k, r: the curves, a row a lag, over the length (or scale) and rounded."""

    def work(tiles, _):
        for t in tiles:
            pairs = B.pair_columns(t)
            for k in range(-most, most + 1):  # a batch a lag, so that a tile costs the memory of one
                r = B.lagged(t[1], t[3], k)
                r = B.rounded(r / (scale or t[1].shape[1]), digits)
                yield pairs | {"k": np.full(len(pairs["roi_a"]), k, np.int32), "r": r.ravel() if t[4] is None else r[t[4]]}

    return B.over_pairs(arrays, work, "roi_a long, roi_b long, k int, r double", ["grp"])


def curve_peaks(arrays: DataFrame, most: int, scale: float | None = None, even: int | None = None, digits: int = 6, form: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """grp, roi_a, roi_b, best_lag, max_corr, zero_lag of the curves over their length (or scale), values rounded. Of equal maxima
    (to `even` places) the least lag. form: what becomes of stored values instead of z scores."""

    def work(tiles, _):
        for t in tiles:
            lag, best, zero = B.peaks(t[1], t[3], most, scale, even)
            yield B.pair_columns(t, best_lag=lag, max_corr=B.rounded(best, digits), zero_lag=B.rounded(zero, digits))

    return B.over_pairs(arrays, work, "roi_a long, roi_b long, best_lag int, max_corr double, zero_lag double", ["grp"], form=form)


def correlations(arrays: DataFrame, digits: int = 6) -> DataFrame:
    """grp, roi_a, roi_b, r: correlation at lag 0, rounded."""

    def work(tiles, _):
        for t in tiles:
            r = B.lagged(t[1], t[3], 0) / t[1].shape[1]
            yield B.pair_columns(t, r=B.rounded(r, digits))

    return B.over_pairs(arrays, work, "roi_a long, roi_b long, r double", ["grp"])


def mean_lags(arrays: DataFrame, most: int) -> DataFrame:
    """grp, roi_a, mean_lag: the mean best lag of each region against all regions of greater numbers, summed up where it is computed."""

    def work(tiles, _):
        for t in tiles:
            lag, _, _ = B.peaks(t[1], t[3], most)
            keep = np.ones(lag.shape, bool) if t[4] is None else t[4]
            yield {"roi_a": t[0], "total": (lag * keep).sum(1), "n": keep.sum(1)}

    s = B.over_pairs(arrays, work, "roi_a long, total long, n long", ["grp"]).where("n > 0")
    return s.groupBy("grp", "roi_a").agg((F.sum("total") / F.sum("n")).alias("mean_lag"))


def closest(arrays: DataFrame, k: int) -> DataFrame:
    """grp, roi_a, roi_b, r, rn: the k partners of greater numbers with the highest absolute correlation, of those equal to 12 places
    the least numbers. Each tile puts out its own k best."""

    def work(tiles, _):
        for f, zf, s, zs, keep in tiles:
            r = B.lagged(zf, zs, 0) / zf.shape[1]
            size = np.rint(np.abs(r) * 1e12)
            if keep is not None:
                size[~keep] = -1
            rows, found = np.arange(len(f)), []
            for _ in range(min(k, len(s))):
                at = size.argmax(1)
                ok = size[rows, at] >= 0
                found.append((f[ok], s[at[ok]], r[rows[ok], at[ok]]))
                size[rows, at] = -1
            yield dict(zip(("roi_a", "roi_b", "r"), map(np.concatenate, zip(*found, strict=True)), strict=True))

    rn = F.row_number().over(Window.partitionBy("grp", "roi_a").orderBy(F.desc(F.round(F.abs("r"), 12)), "roi_b")).cast("long")
    return B.over_pairs(arrays, work, "roi_a long, roi_b long, r double", ["grp"]).withColumn("rn", rn).where(F.col("rn") <= k)


def bin_correlation(traces: DataFrame, bins: DataFrame, frames: int, most: int, least: int = 8) -> DataFrame:
    """grp (the bin), roi_a, roi_b, n, rs: correlation curves at lags -most..most of all pairs inside each listed bin of `frames`
    frames. traces: roi, frame, f; bins: bin. Bins of fewer than `least` samples are left out; a constant trace correlates 0."""
    return _curves(in_bins(traces, bins, frames), "bin", most, least)


def from_onsets(traces: DataFrame, starts: DataFrame, most: int, least: int = 8) -> DataFrame:
    """grp (the start), roi_a, roi_b, n, rs: correlation curves of all pairs from each listed start (column s, a frame) to the end."""
    return _curves(onward(traces, starts), "s", most, least)


def in_bins(traces: DataFrame, bins: DataFrame, frames: int) -> DataFrame:
    return traces.withColumn("bin", F.floor(F.col("frame") / frames)).join(bins.select("bin"), "bin", "left_semi")


def binned(arrays: DataFrame, bins: DataFrame, frames: int, least: int = 8) -> DataFrame:
    """grp (the bin), roi, xs: the part of each trace (roi, xs) inside each listed bin, if it has at least `least` samples; for
    correlations, like window_scores of in_bins but as stored and without a shuffle."""
    a = arrays.crossJoin(F.broadcast(bins.select(F.col("bin").cast("long").alias("grp")).distinct()))
    a = a.select("grp", "roi", F.slice("xs", (F.col("grp") * frames + 1).cast("int"), F.lit(frames)).alias("xs"))
    return a.where(F.size("xs") >= least)


def windowed(arrays: DataFrame, windows: DataFrame, least: int = 8) -> DataFrame:
    """arrays with the part of each trace (xs) inside each window (grp, s, e; frames, closed at both ends, a null e is the end), if it
    has at least `least` samples; for correlations, like window_scores of the frames but as stored and without a shuffle."""
    a = arrays.crossJoin(F.broadcast(windows.select(F.col("grp").cast("long").alias("grp"), F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"))))
    n = F.greatest(F.coalesce(F.col("e"), F.size("xs") - 1) - F.col("s") + 1, F.lit(0))
    a = a.where(F.col("xs").isNotNull()).withColumn("xs", F.slice("xs", F.col("s") + 1, n))
    return a.where(F.size("xs") >= least).select("grp", *arrays.columns)


def onward(traces: DataFrame, starts: DataFrame) -> DataFrame:
    return traces.join(starts.select("s"), F.col("frame") >= F.col("s"))


def _curves(t: DataFrame, group: str, most: int, least: int) -> DataFrame:
    z = window_scores(t, group, least)
    n = z.groupBy("grp").agg(F.max(F.size("zs")).alias("n"))
    return curve_blocks(z, most).join(n, "grp").select("grp", "roi_a", "roi_b", "n", F.transform("rs", lambda x: x / F.col("n")).alias("rs"))


def window_scores(t: DataFrame, group: str, least: int = 8) -> DataFrame:
    """grp, roi, zs: z scores inside each group of frames, of groups of at least `least` samples."""
    a = t.groupBy(F.col(group).cast("long").alias("grp"), "roi").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", "f"))), lambda x: x["f"].cast("double")).alias("xs"), F.avg("f").alias("m"), F.stddev_pop("f").alias("sd"), F.count("*").alias("n"))
    return a.where(F.col("n") >= least).select("grp", "roi", F.transform("xs", lambda x: F.when(F.col("sd") > 0, (x - F.col("m")) / F.col("sd")).otherwise(0.0)).alias("zs"))


def mean_shift_null(traces: DataFrame, clusters: DataFrame, rounds: int, least_shift: int, most_shift: int, two_sided: bool = False, seed: int = 1) -> DataFrame:
    """cluster_a, cluster_b, n_a, n_b, obs, p: the mean correlation at lag 0 of all pairs between two clusters (a < b), and how often it
    is reached where each region of b is shifted around by its own random offset.

    traces: roi, zs. The mean over pairs is linear, so cluster a enters by its mean trace: no pair of regions is formed, and a
    round costs the regions of b, whatever the size of a. Shifts come from integer arithmetic."""
    z = traces.join(clusters, "roi").select("cluster", "roi", "zs")
    # the outer form: no filter on zs is inferred, which would be pushed below and compute zs once more, lambdas and all
    mean = z.select("cluster", "roi", F.posexplode_outer("zs").alias("t", "z")).where("t is not null").groupBy("cluster", "t").agg(F.avg("z").alias("m"), F.count("*").alias("n"))
    mean = mean.groupBy(F.col("cluster").alias("cluster_a")).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "m"))), lambda x: x["m"]).alias("ms"), F.max("n").alias("n_a"))
    pairs = z.withColumnRenamed("cluster", "cluster_b").join(mean, F.col("cluster_a") < F.col("cluster_b"))  # a region and a cluster's mean

    def run(batches):
        i = np.arange(rounds)
        for x in batches:
            out = []
            for roi, ms, zs in zip(x["roi"], x["ms"], x["zs"], strict=True):
                h = (int(roi) * 31 + i * 7919 + seed * 104729) % 65521
                shift = np.concatenate([[0], h * h % 65521 % (most_shift - least_shift + 1) + least_shift])  # 0: as observed
                t = np.arange(len(zs))
                out.append(np.asarray(zs)[(t[None, :] - shift[:, None]) % len(zs)] @ np.asarray(ms) / len(zs))
            yield x[["cluster_a", "cluster_b", "n_a"]].assign(rs=out)

    each = pairs.select("cluster_a", "cluster_b", "n_a", "roi", "ms", "zs").mapInPandas(run, "cluster_a string, cluster_b string, n_a long, rs array<double>")
    each = each.select("cluster_a", "cluster_b", "n_a", F.posexplode("rs").alias("i", "r"))
    null = each.groupBy("cluster_a", "cluster_b", "i").agg(F.avg("r").alias("r"), F.count("*").alias("n_b"), F.max("n_a").alias("n_a"))
    # one row a pair with its rounds, the first of which is the observation
    one = null.groupBy("cluster_a", "cluster_b").agg(F.sort_array(F.collect_list(F.struct("i", "r"))).alias("rs"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    one = one.withColumn("obs", F.get("rs", F.lit(0))["r"])
    size = lambda x: F.abs(x) if two_sided else x
    hits = F.size(F.filter(F.slice("rs", 2, rounds), lambda x: size(x["r"]) >= size(F.col("obs")) - 1e-12))
    return one.select("cluster_a", "cluster_b", "n_a", "n_b", "obs", ((hits + 1) / F.lit(rounds + 1)).alias("p"))
