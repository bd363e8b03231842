"""Recordings that number their regions alike don't meet; readers, steps and ranks on small tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrain.operators import clustering as C
from fluxgrain.operators import ranks
from fluxgrain.operators import scoring as SC
from fluxgrain.operators import spatial as S
from fluxgrain.operators import steps
from fluxgrain.operators import traces as T
from fluxgrain.session import shared_folder
from fluxgrain.sources import readers, sinks


def test_onsets_stay_in_their_recording(spark):
    spike = lambda at: [5.0 if t == at else 0.0 for t in range(12)]
    rows = [(r, 0, t, z) for r, at in (("A", 3), ("B", 7)) for t, z in enumerate(spike(at))]
    df = spark.createDataFrame(rows, "recording string, roi long, frame long, z double")
    got = T.separated(T.onsets(df, 3.5, 1.5), 6)
    assert sorted(map(tuple, got.collect())) == [("A", 0, 3), ("B", 0, 7)]


def test_pixels_stay_in_their_recording(spark):
    px = spark.createDataFrame([("A", 0, 1, 1, 1.0), ("A", 1, 1, 1, 1.0), ("B", 0, 1, 1, 1.0)], "recording string, roi long, y long, x long, lam double")
    v = spark.createDataFrame([("A", 0, 2.0), ("A", 1, 4.0), ("B", 0, 10.0)], "recording string, roi long, v double")
    assert sorted(map(tuple, S.paint(v, px).collect())) == [("A", 1, 1, 3.0), ("B", 1, 1, 10.0)]
    assert [tuple(r)[:4] for r in S.overlaps(px, px).where("roi_a < roi_b").collect()] == [("A", 0, 1, 1)]


def test_running_totals_and_row_numbers(spark):
    r = np.random.default_rng(2)
    x = np.unique(r.normal(size=500)).tolist()
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(x)], "x double, n long").repartition(5)
    got = {row["x"]: row["upto_n"] for row in ranks.running_totals(df, "x", ["n"], 16).collect()}
    want = dict(zip(x, np.cumsum([i % 7 for i in range(len(x))]).tolist(), strict=True))
    assert got == want
    n = {row["x"]: row["k"] for row in ranks.row_numbers(df, "x", [F.col("x")], "k", 16).collect()}
    assert n == {v: i + 1 for i, v in enumerate(x)}
    assert ranks.running_totals(df.limit(0), "x", ["n"]).collect() == []


def test_top_percent_keeps_ties(spark):
    s = spark.createDataFrame([(i, v) for i, v in enumerate([9.0, 8.0, 8.0, 7.0, 1.0, 1.0, 1.0, 1.0, 1.0, None])], "roi long, score double")
    got = {r["roi"] for r in SC.soft_mask(s, 0.0, top_percent=20.0).where("keep").collect()}
    assert got == {0, 1, 2}


def test_fitted_scorer(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 2)) * [2, 5] + [1, -4]
    y = (x @ [1.0, 0.3] + r.logistic(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, y int")
    fit = SC.fit_scorer(df, ["a", "b"], "y")
    assert np.allclose(fit["means"], x.mean(0)) and np.allclose(fit["scales"], x.std(0))
    z = (x - x.mean(0)) / x.std(0)
    p = 1 / (1 + np.exp(-(fit["weights"][0] + z @ fit["weights"][1:])))
    assert np.allclose(z.T @ (y - p) / 300, 1e-3 * np.array(fit["weights"][1:]), atol=1e-6)
    f1 = lambda t: 2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum())
    assert fit["f1"] == pytest.approx(max(f1(t) for t in p))
    assert SC.apply_scorer(df, fit).where("keep").count() == (p >= fit["threshold"] - 1e-12).sum()


def test_reclustering_keeps_ids(spark):
    r = np.random.default_rng(4)
    base = [np.sin(np.arange(32) / 3 + k) for k in (0, 2, 4)]
    rows = [(100 + i, (base[i % 3] + r.normal(size=32) * 0.05).tolist()) for i in range(12)] + [(i, r.normal(size=32).tolist()) for i in range(5)]
    arrays = spark.createDataFrame(rows, "roi long, xs array<double>")
    clusters = spark.createDataFrame([(f"C{1 + (i >= 106)}", i) for i in range(100, 112)] + [("C9", i) for i in range(5)], "cluster string, roi long")
    got = {}
    for row in C.reclustered(arrays, clusters, ["C1", "C2"]).collect():
        got.setdefault(row["cluster"], set()).add(row["roi"])
    assert sorted(map(sorted, got.values())) == [list(range(100 + k, 112, 3)) for k in range(3)]


def test_steps_skip_what_is_done_and_keep_errors_to_their_recording(spark):
    folder = shared_folder(spark, "steps-test")
    ran, broken = [], {"b"}
    g = steps.Registry()

    @g.step("one")
    def one(c):
        ran.append((c.recording, "one"))
        if c.recording in broken:
            raise RuntimeError("no frames")
        return spark.range(3)

    @g.step("two")
    def two(c):
        ran.append((c.recording, "two"))
        return c.result("one").where("id > 0")

    with pytest.raises(ValueError):
        g.step("one")(one)
    with pytest.raises(ValueError):
        steps.run(spark, g, ["a"], folder, ["three"])
    status = lambda df: {(r["recording"], r["step"]): r["status"] for r in df.collect()}
    assert status(steps.run(spark, g, ["a", "b", "c"], folder)) == {("a", "one"): "done", ("a", "two"): "done", ("b", "one"): "failed", ("b", "two"): "not run", ("c", "one"): "done", ("c", "two"): "done"}
    broken.clear()
    ran.clear()
    assert status(steps.run(spark, g, ["a", "b"], folder)) == {("a", "one"): "skipped", ("a", "two"): "skipped", ("b", "one"): "done", ("b", "two"): "done"}
    assert ran == [("b", "one"), ("b", "two")]
    assert spark.read.parquet(f"{folder}/c/two").count() == 2
    found = lambda s, path: spark.createDataFrame([("a",)], "recording string") if path == "x" else s.read.parquet(path)
    out = status(steps.over_folders(spark, g, ["x", f"{folder}/nowhere"], folder, found))
    assert out[("a", "one")] == "skipped" and out[(f"{folder}/nowhere", "discover")] == "failed"


def test_readers(spark, tmp_path):
    for name, body in (("C1_rois.txt", "1\n 2\nx\n\n900\n"), ("C1_manual_combined_rois.txt", "5\n"), ("notes.txt", "7\n")):
        (tmp_path / name).write_text(body)
    got = sorted(map(tuple, readers.cluster_files(spark, str(tmp_path), most_roi=100).collect()))
    assert got == [("C1", 1), ("C1", 2)]
    for pair, name, body in (("C1xC2", "a_summary.csv", "roiA,roiB,best_lag_sec\n1,2,0.5\n3,4,\n"), ("C1xC2", "b_summary.csv", "roiA,roiB,best_lag_sec\n9,9,9\n"), ("C2xC10", "s_summary.csv", "roiA,roiB,best_lag_sec\n5,6,-1.5\n")):
        (tmp_path / "pairs" / pair).mkdir(parents=True, exist_ok=True)
        (tmp_path / "pairs" / pair / name).write_text(body)
    rows = readers.pair_summaries(spark, str(tmp_path / "pairs"))
    assert sorted(map(tuple, rows.collect())) == [("C1xC2", 1, 2, 0.5), ("C2xC10", 5, 6, -1.5)]
    names = spark.createDataFrame([("C10xC2",), ("C2xC10",), ("C2xC9",)], "pair string")
    assert [r["pair"] for r in readers.natural_order(names, "pair").collect()] == ["C2xC9", "C2xC10", "C10xC2"]


def test_pair_lags_cost_less_than_a_line_a_pair(spark):
    """As q_pair_summaries writes and reads them: every pair with its lag, missing ones and NaN left out, clusters in order of number."""
    folder = shared_folder(spark, "pairs-test")
    label = {i: (2, 10, 3)[i % 3] for i in range(900)}

    def lag(a, b):
        return np.ma.array(np.where((a + b) % 7 == 0, np.nan, (a * 3 + b) % 11 / 10.0), mask=(a + b) % 5 == 0)

    sinks.write_pair_lags(spark.createDataFrame([(label[i], i) for i in label], "label int, roi long"), lag, folder)
    want = {(f"C{label[a]}xC{label[b]}", a, b, (a * 3 + b) % 11 / 10.0) for a in label for b in label if label[a] < label[b] and (a + b) % 5 and (a + b) % 7}
    got = readers.pair_lags(spark, folder).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    files = [f for f in Path(folder).rglob("*.parquet")]
    assert {f.parent.name for f in files} == {"pair=C2xC3", "pair=C2xC10", "pair=C3xC10"} and sum(f.stat().st_size for f in files) < 3 * 300 * 300
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_sheets_and_identities(spark):
    folder = shared_folder(spark, "sheets-test")
    sinks.upsert_sheet(spark.createDataFrame([(1, 2.0, 1.0), (2, 3.0, None)], "event long, start_s double, end_s double"), folder, "EventWindows")
    sinks.upsert_sheet(sinks.params_sheet(spark, {"b": 1, "a": "x"}), folder, "FilterParams")
    assert sorted(map(tuple, readers.event_windows(spark, folder).collect())) == [(1, 1.0, 2.0)]
    assert sorted(map(tuple, readers.sheet(spark, folder, "FilterParams").collect())) == [("a", "x"), ("b", "1")]
    c = spark.createDataFrame([("#FF88 00", 1), ("C1", 2)], "cluster string, roi long")
    sinks.write_identities(c, folder + "-c")
    assert sorted(map(tuple, readers.cluster_tables(spark, folder + "-c/clusters").collect())) == [("C1", 2), ("_FF88_00", 1)]


def test_savgol_window_longer_than_the_trace():
    from fluxgrain.functions import kernels as K

    t = np.arange(4)
    assert np.allclose(K.savgol_derivative(t**2.0, 10.0, 2000, 2), 20.0 * t)
    assert np.allclose(K.savgol_derivative(np.arange(5) ** 2.0, 10.0, 2000, 2), 20.0 * np.arange(5))


def test_spectrum_of_long_traces(spark):
    x = np.random.default_rng(1).normal(size=(3, 501))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "roi long, xs array<double>")
    got = {(r["roi"], r["k"]): r["power"] for r in T.power_spectrum(df).collect()}
    want = np.abs(np.fft.rfft(x)) ** 2
    assert len(got) == want.size and all(got[i, k] == pytest.approx(want[i, k]) for i in range(3) for k in range(want.shape[1]))


@pytest.mark.parametrize("kind", ["double", "string", "int"])
def test_many_columns_are_put_together_like_a_pivot(spark, kind):
    """As q_pivot_wide has them; its plan has no expression a column."""
    t = spark.range(40 * 300).selectExpr("IF(id % 300 = 7, NULL, id % 300) AS frame", "id DIV 300 AS roi", f"CAST(IF(id % 11 = 0, NULL, id) AS {kind}) AS f").where("roi % 13 != frame % 17 OR frame IS NULL")
    names = [n for n in range(45) if n != 6]  # some that are not there, one left out
    want = sinks.wide(t, "frame", "roi", "f", names)
    got = sinks.wide(t, "frame", "roi", "f", names, few=0)
    assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 300
    plan = sinks.wide(t, "frame", "roi", "f", range(5000))._jdf.queryExecution().analyzed()
    assert not any("Aggregate" in plan.p(i).nodeName() for i in range(2))
