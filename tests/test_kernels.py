"""Kernels against values worked out by hand or by plain loops."""

import numpy as np
import pytest

from fluxgrain.functions import kernels as K


def test_fill_gaps_interpolates_and_holds_ends():
    assert K.fill_gaps([np.nan, 1, np.nan, 3, np.inf]).tolist() == [1, 1, 2, 3, 3]
    assert K.fill_gaps([np.nan, np.nan]).tolist() == [0, 0]


@pytest.mark.parametrize("mode", ["nearest", "reflect"])
def test_percentile_filter_is_a_rank_filter(mode):
    x = np.random.default_rng(0).normal(size=40)
    got = K.percentile_filter(x, 7, 30, mode)
    for i in range(40):
        at = [j if 0 <= j < 40 else (0 if mode == "nearest" else -j - 1) if j < 0 else (39 if mode == "nearest" else 79 - j) for j in range(i - 3, i + 4)]
        assert got[i] == sorted(x[at])[2]


def test_lowpass_passes_a_constant_and_halves_power_at_the_cutoff():
    assert np.allclose(K.lowpass(np.full(400, 3.0), 1.0, 15.0)[-50:], 3.0, atol=1e-6)
    t = np.arange(6000) / 15.0
    y = K.lowpass(np.sin(2 * np.pi * t), 1.0, 15.0, "zero")[2000:]
    assert abs(y.std() * 2**0.5 - 2**-0.5) < 0.001  # the amplitude, from whole periods
    assert K.lowpass(np.array([1.0, 2.0]), 1.0, 15.0).tolist() == [1, 2]
    assert len(K.lowpass(np.ones(5), 1.0, 15.0, "pad64")) == 5


def test_savgol_is_exact_on_parabolas():
    t = np.arange(30) / 15.0
    assert np.allclose(K.savgol_derivative(3 * t**2 + t, 15.0, 333, 2), 6 * t + 1)
    assert K.savgol_derivative(np.array([1.0, 2.0]), 15.0).tolist() == [0, 15]


def test_gaussian_smooth_keeps_constants():
    assert np.allclose(K.gaussian_smooth(np.full(9, 2.0), 2.0), 2.0)


def test_find_peaks_gates():
    x = np.array([0, 2, 0, 3, 3, 0, 1, 0, 5, 0], float)
    assert K.local_maxima(x).tolist() == [1, 3, 6, 8]
    assert K.find_peaks(x, min_prominence=2).tolist() == [1, 3, 8]
    assert K.find_peaks(x, distance=4).tolist() == [3, 8]
    assert K.find_peaks(x, height=3).tolist() == [3, 8]
    assert K.find_peaks(np.zeros(2)).tolist() == []


def test_prominence_and_width():
    x = np.array([0, 1, 4, 1, 2, 0], float)
    assert K.prominence(x, 2)[0] == 4
    assert K.prominence(x, 4)[0] == 1
    assert K.width(x, 2, 4.0, 0, 5)[0] == pytest.approx(4 / 3)


def test_events_merge_and_keep_the_taller_peak():
    d = np.array([0, 0, 5, 6, 5, 9, 5, 0, 0, 0] + [0.0] * 40)
    e = K.bounded_events(np.arange(50.0), d, [3, 5], K.EventParams(baseline="global", gaussian=False))
    assert [(x["start_s"], x["peak_s"], x["end_s"]) for x in e] == [(2, 5, 6)]
    g = K.bounded_events(np.arange(50.0), d, [3, 5], K.EventParams(baseline="global"))
    assert g[0]["start_s"] <= g[0]["peak_s"] <= g[0]["end_s"]
    assert K.bounded_events(np.arange(50.0), d, [], K.EventParams()) == []


def brute_linkage(points, method):
    groups = {i: [i] for i in range(len(points))}
    heights = []
    while len(groups) > 1:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    p, q = points[groups[a]], points[groups[b]]
                    if method == "average":
                        d = np.mean([np.linalg.norm(x - y) for x in p for y in q])
                    else:
                        d = np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(p.mean(0) - q.mean(0))
                    if best is None or d < best[0]:
                        best = (d, a, b)
        d, a, b = best
        groups[a] = groups.pop(a) + groups.pop(b)
        heights.append(d)
    return heights


@pytest.mark.parametrize("method", ["average", "ward"])
def test_linkage_heights(method):
    x = np.random.default_rng(1).normal(size=(12, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert np.allclose(K.linkage(d, method)[:, 2], brute_linkage(x, method))


def test_flat_clusters_and_colours():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [20.0]])
    m = K.linkage(np.abs(x - x.T))
    assert sorted(map(sorted, K.members(m, 5, 1.0))) == [[0, 1], [2, 3], [4]]
    assert sorted(K.leaf_order(m, 5)) == [0, 1, 2, 3, 4]
    colours = dict(zip(K.leaf_order(m, 5), K.colour_groups(m, 5, 1.0), strict=True))
    assert colours[4] == 0 and colours[0] == colours[1] != colours[2] == colours[3]
    assert K.members(np.zeros((0, 4)), 1, 1.0) == [[0]]


def test_lagged_correlation_finds_a_delay():
    x = np.random.default_rng(2).normal(size=200)
    a, b = np.roll(x, 3)[20:180], x[20:180]
    z = lambda v: ((v - v.mean()) / v.std())[:, None]
    lag, best, zero = K.lagged_correlation(z(a), z(b), 5)
    assert lag[0, 0] == 3 and best[0, 0] > 0.9 > zero[0, 0]
    back, _, _ = K.lagged_correlation(z(b), z(a), 5)
    assert back[0, 0] == -3


@pytest.mark.parametrize("method", ["average", "ward"])
@pytest.mark.parametrize("n", [1, 2, 3, 90, 260])
def test_linkage_of_vectors_is_that_of_their_distances(method, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 12)) + 3 * rng.normal(size=(4, 12))[rng.integers(0, 4, n)]
    if method == "average":
        x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True) / np.sqrt(12)
    d = 1 - x @ x.T if method == "average" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got, want = K.vector_linkage(x, method, 7), K.linkage(d, method)
    assert got[:, [0, 1, 3]].tolist() == want[:, [0, 1, 3]].tolist() and got[:, 2] == pytest.approx(want[:, 2])


def test_chains_finish_what_rounds_leave():
    x = np.repeat(np.eye(8)[:3] * [[1.0], [2.0], [5.0]], 60, axis=0)  # equal points: few are each other's nearest
    got = K.vector_linkage(x, "ward")
    assert len(got) == 179 and got[-1, 3] == 180 and (got[:177, 2] == 0).all() and (got[177:, 2] > 1).all()
