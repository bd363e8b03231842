"""All pairs by blocks: each region is sent about as often whatever the size of its group, and sums agree with plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxgrain.operators import blocks as B
from fluxgrain.operators import clustering as C
from fluxgrain.operators import pairs as P
from fluxgrain.plans.recording import cluster_pair_stats

FRAMES, N = 12, 700


@pytest.fixture(scope="module")
def z():
    x = np.random.default_rng(5).normal(size=(N, FRAMES))
    x[11] = x[3]
    return (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)


@pytest.fixture(scope="module")
def arrays(spark, z):
    rows = pd.DataFrame({"grp": np.arange(N) % 2, "roi": np.arange(N), "zs": list(z)})
    return spark.createDataFrame(rows, "grp long, roi long, zs array<double>").withColumn("cluster", F.concat(F.lit("C"), F.col("roi") % 3)).cache()


def best(z, a, b, most):
    rs = np.array([z[a][max(k, 0) : FRAMES + min(k, 0)] @ z[b][max(-k, 0) : FRAMES - max(k, 0)] / FRAMES for k in range(-most, most + 1)])
    return int(rs.argmax()) - most, rs.max(), rs[most]


def same_group(n=N):
    return [(a, b) for a in range(n) for b in range(a + 1, n) if a % 2 == b % 2]


@pytest.mark.parametrize("kind", [None, "cluster"])
def test_units_dont_grow_with_the_square_of_a_group(spark, kind):
    t = spark.range(6000).select(F.col("id").alias("roi"), F.array(F.lit(0.5), F.lit(-0.5)).alias("zs"), F.concat(F.lit("C"), F.col("id") % 3).alias("cluster"))
    work = lambda tiles, _: iter([{"n": [sum(x[0].size * x[2].size if x[4] is None else int(x[4].sum()) for x in tiles)]}])
    got = [r["n"] for r in B.over_pairs(t.select("roi", "zs", *([kind] if kind else [])), work, "n long", [], kind).collect()]
    assert sum(got) == (6000 * 5999 // 2 if kind is None else 2000 * 2000 * 6) and len(got) <= 19 * 20 / 2 + 3 * 15


def test_distances_of_all_pairs(spark, arrays, z):
    xs = arrays.select("roi", F.col("zs").alias("xs"))
    got = {(r["roi_a"], r["roi_b"]): r["dist"] for r in C.distances(xs, digits=6).collect()}
    assert len(got) == N * (N - 1) // 2 and all(got[a, b] == pytest.approx(1 - z[a] @ z[b] / FRAMES, abs=6e-7) for a, b in [(0, 1), (3, 11), (5, 699), (350, 351)])


def test_means_by_cluster_pair(arrays, z):
    """As q_keyed_xcorr has them, by group."""
    t = arrays.withColumnRenamed("grp", "recording")
    got = {(r["recording"], r["cluster_a"], r["cluster_b"]): r for r in P.xcorr_means(t.select("recording", "roi", "zs"), t.select("recording", "roi", "cluster"), 2).collect()}
    assert len(got) == 12
    a, b = [[i for i in range(N) if i % 2 == 1 and i % 3 == c] for c in (0, 2)]
    want = [best(z, x, y, 2) for x in a for y in b]
    assert got[1, "C0", "C2"]["n"] == len(want) and got[1, "C0", "C2"]["mean_max"] == pytest.approx(np.mean([w[1] for w in want]))


def test_correlations_inside_groups(arrays, z):
    """As q_bin_correlation has them, a group a bin."""
    got = {(r["roi_a"], r["roi_b"]): (r["grp"], r["r"]) for r in P.correlations(arrays).collect()}
    assert sorted(got) == same_group() and all(got[a, b] == (a % 2, pytest.approx(z[a] @ z[b] / FRAMES, abs=6e-7)) for a, b in same_group()[::997])


def test_lags_counted_by_cluster_pair(arrays, z):
    """As q_cluster_pair_stats counts them; sign flips from sums agree with sign flips from rows."""
    t = arrays.where("roi < 150")
    x = P.xcorr_blocks(t.select("roi", "zs"), t.select("roi", "cluster"), 2, with_self=False).withColumn("row", F.col("roi_a") * 1_000_003 + F.col("roi_b"))
    counted, summed = P.xcorr_lags(t.select("roi", "zs"), t.select("roi", "cluster"), 2, with_self=False)
    key = ["cluster_a", "cluster_b"]
    assert sorted(map(tuple, x.groupBy(*key, "best_lag").agg(F.count("*")).collect())) == sorted(map(tuple, counted.collect()))
    assert sorted(map(tuple, P.signflip(x, key, "best_lag", "row", 50).collect())) == sorted(map(tuple, P.signflip(summed, key, "best_lag", "row", 50, count="n").collect()))
    assert sorted(map(tuple, P.pair_stats(x, key, "best_lag").collect())) == sorted(map(tuple, P.pair_stats(counted, key, "best_lag", count="n").collect()))


def test_pair_stats_from_pairs_and_from_counts(arrays):
    """q_cluster_pair_stats takes lags that are counted where they are computed, a row a pair is taken too."""
    t = arrays.where("roi < 150")
    x = P.xcorr_blocks(t.select("roi", "zs"), t.select("roi", "cluster"), 2, with_self=False)
    want = sorted(map(tuple, cluster_pair_stats(x).collect()))
    assert len(want) == 3 and sorted(map(tuple, cluster_pair_stats(*P.xcorr_lags(t.select("roi", "zs"), t.select("roi", "cluster"), 2, with_self=False)).collect())) == want


def test_peaks_across_cells():
    x = np.random.default_rng(2).normal(size=(1400, 9))
    f, s = x[: 2 * B.CELL[0] + 3], x[-(2 * B.CELL[1] + 5) :]
    curves = np.stack([B.lagged(f, s, k) for k in range(-9, 10)]) / 9  # lags of 9 have nothing to sum
    lag, top, zero = B.peaks(f, s, 9)
    assert (lag == curves.argmax(0) - 9).all() and np.allclose(top, curves.max(0), atol=1e-14) and np.allclose(zero, curves[9], atol=1e-14)
    lag, top, zero = B.peaks(f, s, 70)  # more lags than fit a byte
    assert (lag.min(), lag.max()) == (-70, 8) and np.allclose(top, curves.max(0), atol=1e-14)


def test_peaks_that_are_equal_but_for_rounding(arrays, z):
    """As q_onset_lags and q_xcorr_event take them: of lags equal to nine places the least one."""
    lag, top, zero = B.peaks(np.array([[1.0, 0, 0, 1 - 1e-12]]), np.array([[1.0, 0, 0, 1.0]]), 3, 1.0, 9)
    assert (lag.item(), top.item()) == (0, pytest.approx(2))
    lag, top, zero = B.peaks(np.array([[0.0, 1 - 1e-12, 0, 1.0]]), np.array([[0.0, 0, 1.0, 0]]), 2, 1.0, 9)
    assert (lag.item(), top.item()) == (-1, 1.0) and B.peaks(np.array([[0.0, 1 - 1e-12, 0, 1.0]]), np.array([[0.0, 0, 1.0, 0]]), 2, 1.0)[0].item() == 1


def test_surrogates_of_all_pairs_inside_groups(arrays, z):
    """As q_shift_surrogate has them: the same as pair by pair."""
    t = arrays.where("roi < 90")
    a, b = (t.select("grp", F.col("roi").alias(f"roi_{s}"), F.col("zs").alias(f"z{s}")) for s in "ab")
    want = P.shift_surrogates(a.join(b, "grp").where("roi_a < roi_b"), 20).select("grp", "roi_a", "roi_b", F.round("r", 6) + 0.0, "exceed", F.round("p", 6))
    assert sorted(map(tuple, P.surrogates_within(t, ["grp"], 20).select("grp", "roi_a", "roi_b", "r", "exceed", "p").collect())) == sorted(map(tuple, want.collect()))


def test_summed_surrogates(arrays, z):
    """As q_surrogate_summary has them, with the exact median."""
    got = {r["grp"]: r for r in P.surrogate_sums(arrays, "grp", 20).collect()}
    for g in (0, 1):
        r = np.array([z[a] @ z[b] / FRAMES for a, b in same_group() if a % 2 == g])
        assert got[g]["n_pairs"] == len(r) and got[g]["mean_r"] == pytest.approx(r.mean()) and got[g]["median_r"] == pytest.approx(np.median(r), abs=1e-12)


@pytest.mark.parametrize("frames", [5, 64, 80])
def test_shifts_counted_by_bits(frames):
    """As q_surrogate_summary counts them: the table of draws is made once a process, and its bits are the counts."""
    x = np.random.default_rng(3).normal(size=(700, frames))
    t = (np.arange(90) * 977, x[:90], np.arange(700) * 1013 + 5, x, None)
    r, exceed = P._exceeding(t, 20, 1)
    assert P._draws(frames // 2, 20, 1) is P._draws(frames // 2, 20, 1) and np.allclose(r, t[1] @ x.T / frames)
    for a, b in [(0, 0), (3, 4), (70, 600), (89, 699)]:
        h = (t[0][a] * 31 + t[2][b] * 17 + np.arange(20) * 7919 + 104729) % 65521
        null = [x[a] @ np.roll(x[b], -s) / frames for s in h * h % 65521 % (frames // 2) + 1]
        assert exceed[a, b] == (np.abs(null) >= abs(r[a, b]) - 1e-12).sum()


def test_points_of_curves(arrays, z):
    """As q_xcorr_curve has them: a row a lag."""
    t = arrays.where("roi < 200")
    got = {(r["roi_a"], r["roi_b"], r["k"]): r["r"] for r in P.curve_points(t, 3).collect()}
    assert len(got) == 7 * len(same_group(200)) and all(got[a, b, 2] == pytest.approx(z[a][2:] @ z[b][:-2] / FRAMES, abs=6e-7) for a, b in same_group(200)[::97])


def test_stored_values_become_scores_in_the_worker(spark):
    """As q_xcorr_best, q_xcorr_curve, q_surrogate_summary and q_cluster_pair_stats send them: 4 bytes a value; a constant trace is 0."""
    x = np.random.default_rng(8).normal(3, 2, size=(200, 10)).astype(np.float32)
    x[5] = x[5, 0]
    rows = pd.DataFrame({"grp": 0, "roi": np.arange(200), "xs": list(x), "zs": list(B.scores(x.astype(float)))})
    t = spark.createDataFrame(rows, "grp long, roi long, xs array<float>, zs array<double>")
    a, b = (sorted(map(tuple, P.curve_peaks(t.select("grp", "roi", c), 3).collect())) for c in ("xs", "zs"))
    assert a == b and len(a) == 200 * 199 / 2 and {r[3:] for r in a if 5 in r[1:3]} == {(-3, 0.0, 0.0)}
    w = np.float64(x[3]), np.float64(x[77])
    assert [r[5] for r in a if r[1:3] == (3, 77)] == [pytest.approx(np.corrcoef(*w)[0, 1], abs=6e-7)]


def test_bins_of_stored_traces(spark):
    """As q_bin_correlation takes them: like z scores of the frames in each bin, a last bin of too few samples left out."""
    x = np.random.default_rng(9).normal(size=(30, 21)).astype(np.float32)
    arrays = spark.createDataFrame(pd.DataFrame({"roi": np.arange(30), "xs": list(x)}), "roi long, xs array<float>")
    t = arrays.select("roi", F.posexplode("xs").alias("frame", "f"))
    bins = spark.createDataFrame([(0,), (2,), (2,), (5,)], "bin long")
    for frames, groups in ((8, {0}), (9, {0}), (7, set())):
        got, want = (sorted(map(tuple, P.correlations(c).collect())) for c in (P.binned(arrays, bins, frames), P.window_scores(P.in_bins(t, bins, frames), "bin")))
        assert got == want and {r[0] for r in got} == groups and len(got) == len(groups) * 30 * 29 / 2


def test_points_of_curves_come_a_lag_at_a_time():
    """As q_xcorr_curve puts them out: no batch holds more than one lag of a tile."""
    held = {}
    over = B.over_pairs
    try:
        B.over_pairs = lambda arrays, work, *_: held.setdefault("work", work)
        P.curve_points(None, 2)
    finally:
        B.over_pairs = over
    x = B.scores(np.random.default_rng(1).normal(size=(50, 8)))
    made = list(held["work"](B.rising(np.arange(50), x, None, None), {}))
    assert [set(m["k"]) for m in made] == [{k} for k in range(-2, 3)] and {len(m["r"]) for m in made} == {50 * 49 // 2}


def test_correlations_across_kinds(arrays, z):
    """As q_xcorr_from_sync has them: the first region is of the lesser kind, whatever the numbers."""
    got = {(r["roi_a"], r["roi_b"]): r["r"] for r in P.correlations_across(arrays.withColumn("rec", -F.col("roi") % 3), "rec", ["grp"]).collect()}
    assert sorted(got) == sorted((a, b) for a in range(N) for b in range(N) if a % 2 == b % 2 and a % 3 > b % 3)
    assert all(r == pytest.approx(z[a] @ z[b] / FRAMES, abs=6e-7) for (a, b), r in list(got.items())[::997])


def test_mean_lags_of_regions(arrays, z):
    """As q_cell_means has them."""
    got = {r["roi_a"]: r["mean_lag"] for r in P.mean_lags(arrays, 3).collect()}
    assert sorted(got) == list(range(N - 2)) and all(got[a] == pytest.approx(np.mean([best(z, a, b, 3)[0] for b in range(a + 2, N, 2)])) for a in (0, 1, 350, 697))


def test_closest_partners(arrays, z):
    """As q_topk_pairs has them."""
    got = {}
    for r in P.closest(arrays, 3).orderBy("roi_a", "rn").collect():
        got.setdefault(r["roi_a"], []).append(r["roi_b"])
    assert got[3][0] == 11
    for a in range(N - 2):
        assert got[a] == sorted(range(a + 2, N, 2), key=lambda b: (-round(abs(z[a] @ z[b] / FRAMES), 12), b))[:3]


def test_raw_peaks_of_all_pairs(arrays, z):
    """As q_raw_xcorr (sums) has them."""
    got = {(r["roi_a"], r["roi_b"]): (r["best_lag"], r["max_corr"]) for r in P.curve_peaks(arrays, 3, scale=1).collect()}
    assert sorted(got) == same_group()
    for a, b in same_group()[::997]:
        lag, top, _ = best(z, a, b, 3)
        assert got[a, b] == (lag, pytest.approx(top * FRAMES, abs=6e-7))


def test_peaks_of_all_pairs(arrays, z):
    """As q_xcorr_best has them."""
    got = {(r["roi_a"], r["roi_b"]): (r["best_lag"], r["max_corr"], r["zero_lag"]) for r in P.curve_peaks(arrays, 3).collect()}
    assert sorted(got) == same_group()
    for a, b in same_group()[::997]:
        lag, *rest = best(z, a, b, 3)
        assert got[a, b] == (lag, *(pytest.approx(x, abs=6e-7) for x in rest))


def test_peaks_of_equal_lags_in_pairs(arrays, z):
    """As q_xcorr_event has them, with lags equal to nine places."""
    got = {(r["roi_a"], r["roi_b"]): r["best_lag"] for r in P.curve_peaks(arrays, 4, even=9).collect()}
    assert sorted(got) == same_group() and all(got[a, b] == best(z, a, b, 4)[0] for a, b in same_group()[::997])


def test_windows_of_stored_traces(spark):
    """As q_xcorr_event, q_onset_lags and q_xcorr_from_sync take them: like z scores of the frames in each window, as stored."""
    x = np.random.default_rng(10).normal(2, 3, size=(30, 21)).astype(np.float32)
    x[4] = x[4, 0]
    arrays = spark.createDataFrame(pd.DataFrame({"roi": np.arange(30), "xs": list(x)}), "roi long, xs array<float>").union(spark.createDataFrame([(30, None)], "roi long, xs array<float>"))
    windows = spark.createDataFrame([(0, 0, 9), (1, 5, None), (2, 14, 20), (3, 13, None), (4, 30, None)], "grp long, s int, e int")
    w = P.windowed(arrays, windows)
    assert w.schema["xs"].dataType.simpleString() == "array<float>" and {r["grp"]: len(r["xs"]) for r in w.collect()} == {0: 10, 1: 16, 3: 8}
    t = arrays.select("roi", F.posexplode("xs").alias("frame", "f")).join(windows, F.col("frame").between(F.col("s"), F.coalesce("e", F.lit(20))))
    got, want = (sorted(map(tuple, P.curve_peaks(c, 3, even=9).collect())) for c in (w, P.window_scores(t, "grp")))
    assert got == want and len(got) == 3 * 30 * 29 / 2


def test_stored_values_are_centred_or_softened_in_the_worker(spark):
    """As q_raw_xcorr and distances send them: 4 bytes a value."""
    x = np.random.default_rng(11).normal(3, 2, size=(150, 10)).astype(np.float32)
    t = spark.createDataFrame(pd.DataFrame({"grp": 0, "roi": np.arange(150), "xs": list(x)}), "grp long, roi long, xs array<float>")
    y = x - x.mean(1, keepdims=True, dtype=float)
    got = {r[1:3]: r for r in map(tuple, P.curve_peaks(t, 2, scale=1, form=B.centred).collect())}
    assert len(got) == 150 * 149 / 2 and all(r[5] == pytest.approx(y[a] @ y[b], abs=1e-6) for (a, b), r in got.items())
    z = y / (y.std(1, keepdims=True) + 1e-8)
    for kind, want in (("correlation", lambda a, b: 1 - z[a] @ z[b] / 10), ("euclidean", lambda a, b: np.linalg.norm(z[a] - z[b]))):
        d = C.distances(t, kind)
        assert "transform" not in d._jdf.queryExecution().optimizedPlan().toString()  # sent as stored
        assert all(r["dist"] == pytest.approx(want(r["roi_a"], r["roi_b"]), abs=1e-5) for r in d.collect())
