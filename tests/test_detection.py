"""Detection control, blobs, orchestration."""

import numpy as np

from fluxgrain.operators import detection as D
from fluxgrain.plans.recording import cluster_pair_stats


def spots(at, n=40):
    y, x = np.mgrid[:n, :n]
    return sum(np.exp(-((y - a) ** 2 + (x - b) ** 2) / (2 * s * s)) for a, b, s in at)


def test_log_blobs_finds_spots_and_scales():
    found = D.log_blobs(spots([(10, 12, 1.5), (28, 30, 3.0)]), (1.0, 1.5, 2.0, 3.0, 4.0), 0.2)
    assert {(y, x): s for y, x, s, _ in found} == {(10, 12): 1.5, (28, 30): 3.0}
    assert D.log_blobs(np.zeros((8, 8)), (1.0,), 0.1) == []


def test_blobs_by_recording(spark):
    image = spots([(10, 12, 1.5)], 24)
    rows = [("a", y, x, float(image[y, x])) for y in range(24) for x in range(24)] + [("b", y, x, 0.0) for y in range(4) for x in range(4)]
    got = D.blobs(spark.createDataFrame(rows, "recording string, y long, x long, v double"), (1.0, 1.5, 2.0), 0.2).collect()
    assert [(r["recording"], r["y"], r["x"]) for r in got] == [("a", 10, 12)]


def test_threshold_falls_then_searches():
    level, passes = D.adapt_threshold(lambda t: (int(100 / t), 0.9), D.Schedule(most_rois=300))
    assert 1 / 3 <= level < 0.36 and passes[0][0] == 1.0
    level, _ = D.adapt_threshold(lambda t: (10_000 if t < 2 else 10, 0.9))
    assert level >= 2
    level, passes = D.adapt_threshold(lambda t: (5, 0.9), D.Schedule(floor=0.5))
    assert level == 0.5


def test_sweep_resumes(spark):
    a, b = {"x": 1, "y": 2}, {"y": 2, "x": 1}
    assert D.signature(a) == D.signature(b) != D.signature({"x": 2, "y": 2})
    configs = spark.createDataFrame([(D.signature(a),), ("other",)], "sig string")
    ledger = spark.createDataFrame([(D.signature(a), "done"), ("other", "failed")], "sig string, status string")
    assert [r["sig"] for r in D.pending(configs, ledger).collect()] == ["other"]


def test_footprints(spark):
    m = spark.createDataFrame([("r", 0, 0, 0, 2.0), ("r", 0, 0, 1, 8.0)], "recording string, frame long, y long, x long, v double")
    p = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 0.5)], "roi long, y long, x long, lam double")
    assert D.footprint_traces(m, p).first()["f"] == 4.0


def test_cluster_pair_stats(spark):
    rows = [("A", "B", i, 100 + i, 3) for i in range(20)] + [("A", "C", i, 200 + i, (-1) ** i) for i in range(20)]
    s = {r["pair"]: r for r in cluster_pair_stats(spark.createDataFrame(rows, "cluster_a string, cluster_b string, roi_a long, roi_b long, best_lag int")).collect()}
    assert s["AxB"]["reject"] and s["AxB"]["mean"] == 3 and not s["AxC"]["reject"]
