"""Operators on small inputs with known answers and edge cases."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluxgrain.functions import kernels as K
from fluxgrain.operators import events as E
from fluxgrain.operators import pairs as P
from fluxgrain.operators import scoring as S
from fluxgrain.operators import spatial as SP
from fluxgrain.operators import traces as T
from fluxgrain.sources import sinks, text


def long(spark, xs):
    return spark.createDataFrame([(r, i, v) for r, x in enumerate(xs) for i, v in enumerate(x)], "roi long, frame long, f double")


def loop_onsets(z, hi, lo):
    out, active = [], False
    for i, v in enumerate(z):
        if not active and v >= hi:
            active = True
            out.append(i)
        elif active and v <= lo:
            active = False
    return out


def test_hysteresis_equals_the_loop_with_nan(spark):
    r = np.random.default_rng(3)
    xs = r.normal(size=(5, 80)) * 2
    xs[1, 10:13] = np.nan
    df = long(spark, xs.tolist()).withColumnRenamed("f", "z")
    got = {}
    for x in T.onsets(df, 2.0, 0.5).collect():
        got.setdefault(x["roi"], []).append(x["frame"])
    assert {k: sorted(v) for k, v in got.items()} == {i: o for i in range(5) if (o := loop_onsets(xs[i], 2.0, 0.5))}


def test_constant_trace_has_zero_scores(spark):
    assert [r["z"] for r in T.robust_z(long(spark, [[2.0] * 4])).collect()] == [0.0] * 4


def test_min_separation_compares_with_the_last_kept(spark):
    on = spark.createDataFrame([(0, f) for f in (0, 4, 8, 10, 16)], "roi long, frame long")
    assert sorted(r["frame"] for r in T.separated(on, 6).collect()) == [0, 8, 16]


def test_fill_gaps(spark):
    got = T.fill_gaps(long(spark, [[None, 1.0, float("nan"), 3.0, None], [None, None]])).orderBy("roi", "frame").collect()
    assert [r["v"] for r in got] == [1, 1, 2, 3, 3, None, None]


def test_process_matches_the_kernels(spark):
    x = (100 + np.random.default_rng(4).normal(size=90).cumsum()).tolist()
    df = long(spark, [x]).withColumn("recording", F.lit("a"))
    got = T.process(df, 15.0, window_s=2.0).orderBy("frame").collect()
    dff = K.dff_rolling(np.array(x), 15.0, 2.0)
    assert np.allclose([r["dff"] for r in got], dff)
    assert np.allclose([r["low"] for r in got], K.lowpass(dff, 1.0, 15.0))


def test_windows_are_closed_and_swapped(spark):
    on = spark.createDataFrame([(0, 5), (0, 9), (1, 10)], "roi long, frame long")
    w = spark.createDataFrame([(1, 9, 5)], "window int, start int, end int")
    rois = spark.createDataFrame([(0,), (1,), (2,)], "roi long")
    assert {r["roi"]: r["n"] for r in E.counts_in_windows(on, w, rois).collect()} == {0: 2, 1: 0, 2: 0}


def test_bucketed_range_join_equals_the_plain_one(spark):
    on = spark.createDataFrame([(i % 5, float(i)) for i in range(100)], "roi long, t_s double")
    w = spark.createDataFrame([(i, i * 7.0, i * 7.0 + 20) for i in range(12)], "event long, s double, e double")
    a, b = (sorted(map(tuple, E.range_join(on, w, "t_s", "s", "e", bucket=k).select("roi", "t_s", "event").collect())) for k in (None, 9.0))
    assert a == b


def plain_threshold(counts, n, share):
    level = max(1, min(n, int(np.ceil(share * n))))
    for _ in range(300):
        k = (counts >= level).sum()
        if 20 <= k <= 50 or (k < 20 and level == 1) or (k > 50 and level == n):
            break
        level = max(1, min(level - 1, int(np.floor(level * 0.7)))) if k < 20 else min(n, max(level + 1, int(np.ceil(level * 1.1))))
    return level


@pytest.mark.parametrize("seed", range(4))
def test_coactive_threshold(seed):
    c = np.random.default_rng(seed).poisson(10, 300)
    hist = list(zip(*np.unique(c, return_counts=True), strict=True))
    assert E.coactive_threshold(hist, 300, 60) == plain_threshold(c, 60, 0.8)
    assert E.coactive_threshold([], 0, 60) is None


def test_rank_order_breaks_ties_by_roi(spark):
    a = spark.createDataFrame([(7, 0, 1.0), (3, 0, 1.0), (5, 0, 0.5)], "roi long, event long, first_t double")
    assert [(r["roi"], r["rank"], r["lag"]) for r in E.rank_order(a).orderBy("rank").collect()] == [(5, 1, 0.0), (3, 2, 0.5), (7, 3, 0.5)]


def test_population_events_of_a_burst(spark):
    rows = [("a", i % 20, 5 + 0.01 * i) for i in range(20)] + [("a", i % 20, 20 + 0.01 * i) for i in range(20)] + [("a", 0, 40.0)]
    got = E.population_events(spark.createDataFrame(rows, "recording string, roi long, t_s double"), K.EventParams()).orderBy("start_s").collect()
    assert len(got) == 2 and all(r["start_s"] <= r["peak_s"] <= r["end_s"] for r in got)
    assert abs(got[0]["peak_s"] - 5.1) < 0.3


def plain_bh(p, alpha=0.05):
    m, order = len(p), np.argsort(p)
    q = np.minimum.accumulate((p[order] * m / np.arange(1, m + 1))[::-1])[::-1]
    ok = p[order] <= alpha * np.arange(1, m + 1) / m
    out = np.empty(m)
    out[order] = np.minimum(q, 1)
    cut = p[order][ok].max() if ok.any() else -1
    return out, p <= cut


def test_benjamini_hochberg(spark):
    p = np.random.default_rng(5).uniform(size=30) ** 3
    df = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(p)], "pair string, i int, p double")
    got = P.benjamini_hochberg(df, ["pair"]).orderBy("i").collect()
    q, reject = plain_bh(p)
    assert np.allclose([r["p_fdr"] for r in got], q) and [r["reject"] for r in got] == reject.tolist()


def test_blocked_correlation_equals_one_block(spark):
    x = np.random.default_rng(6).normal(size=(9, 40))
    z = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    t = spark.createDataFrame([(i, v) for i, v in enumerate(z.tolist())], "roi long, zs array<double>")
    c = spark.createDataFrame([(i, f"C{i % 2}") for i in range(9)], "roi long, cluster string")
    a, b = ({(r["cluster_a"], r["cluster_b"], r["roi_a"], r["roi_b"]): (r["best_lag"], round(r["max_corr"], 9)) for r in P.xcorr_blocks(t, c, 4, block=k).collect()} for k in (2, 100))
    assert a == b and len(a) == 25 + 20 + 16


def test_paint_of_a_constant_is_constant(spark):
    px = spark.createDataFrame([(0, 1, 1, 0.5), (0, 1, 1, 0.5), (0, 1, 2, 0.2), (1, 1, 2, 0.9)], "roi long, y long, x long, lam double")
    v = spark.createDataFrame([(0, 3.0), (1, 3.0)], "roi long, v double")
    assert {(r["y"], r["x"]): round(r["v"], 9) for r in SP.paint(v, px).collect()} == {(1, 1): 3.0, (1, 2): 3.0}


def test_merge_by_iou_depends_on_order(spark):
    o = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.5)], "roi_a long, roi_b long, iou double")
    run = lambda ids: sorted(r["roi"] for r in SP.merge_by_iou(o, spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "roi long, rank long")).collect())
    assert run([0, 1, 2]) == [0, 2]
    assert run([1, 0, 2]) == [1]
    r = np.random.default_rng(9)
    pairs = [(int(a), int(b), 0.4) for a, b in r.integers(0, 60, (150, 2)) if a != b]
    against, kept = {}, []
    for a, b, _ in pairs:
        against.setdefault(a, set()).add(b)
        against.setdefault(b, set()).add(a)
    for i in range(60):
        if not against.get(i, set()) & set(kept):
            kept.append(i)
    o = spark.createDataFrame(pairs, "roi_a long, roi_b long, iou double")
    assert run(list(range(60))) == kept


def test_shift_movie_fails_beyond_16_bits(spark):
    m = spark.createDataFrame([("a", -5), ("a", 65533)], "recording string, v long")
    with pytest.raises(PySparkException):
        SP.shift_movie(m).collect()


def test_logistic_fit_is_a_stationary_point(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(200, 2))
    y = (x @ [1.0, -2.0] + r.logistic(size=200) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    beta = np.array(S.fit_logistic(df, ["a", "b"], "y"))
    xx = np.column_stack([np.ones(200), x])
    p = 1 / (1 + np.exp(-xx @ beta))
    assert np.abs(xx.T @ (y - p) / 200 - np.array([0, 1e-3, 1e-3]) * beta).max() < 1e-6


def test_label_log_last_wins_and_null_takes_back(spark):
    log = spark.createDataFrame([("r", 1, 1, 1), ("r", 1, 0, 2), ("r", 2, 1, 1), ("r", 2, None, 3)], "recording string, roi long, label int, seq long")
    assert [tuple(x) for x in S.effective_labels(log).collect()] == [("r", 1, 0)]


def test_odd_window_bounds_fail(spark):
    with pytest.raises(PySparkException):
        text.parse_windows(spark.createDataFrame([(0, "r1,1,2,3")], "line_no int, value string")).collect()


def tiff(pages, order="<"):
    import struct

    out, at = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)), 8
    for i, p in enumerate(pages):
        data = p.astype(order + "u2").tobytes()
        tags = [(256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 4, 16), (273, 4, at + 2 + 12 * 5 + 4), (279, 4, len(data))]
        out += struct.pack(order + "H", 5) + b"".join(struct.pack(order + "HHII", t, k, 1, v) for t, k, v in tags)
        at = at + 2 + 60 + 4 + len(data)
        out += struct.pack(order + "I", at if i + 1 < len(pages) else 0) + data
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_pages(spark, tmp_path, order):
    pages = [np.arange(6).reshape(2, 3) + 100 * i for i in range(3)]
    (tmp_path / "a.tif").write_bytes(tiff(pages, order))
    got = text.read_tiff(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r["pixels"] for r in got] == [p.ravel().tolist() for p in pages]


def test_sheets_are_replaced_one_at_a_time(spark, tmp_path):
    path = str(tmp_path / "book")
    for name, v in (("a", 1), ("b", 2), ("a", 3)):
        sinks.upsert_sheet(spark.createDataFrame([(v,)], "v int"), path, name)
    assert sorted((r["sheet"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]


def test_traces_and_wide_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r", "all", i, f, float(i + f)) for i in range(2) for f in range(3)], "recording string, variant string, roi long, frame long, dff double")
    sinks.write_traces(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    sinks.write_wide_csv(sinks.wide(df, "frame", "roi", "dff", [0, 1]), str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).columns == ["frame", "roi_0", "roi_1"]


def test_streamed_onsets_carry_state_across_files(spark, tmp_path):
    from fluxgrain.streaming.streams import causal_onsets, drained

    x = (np.sin(np.arange(60) / 4) * 3).tolist()
    for part in (range(30), range(30, 60)):
        spark.createDataFrame([(0, i, x[i]) for i in part], "roi long, frame long, f double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("roi long, frame long, f double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = drained(causal_onsets(s, 1.0, 15.0, 1.5, 0.5, 2), "x", str(tmp_path)).orderBy("frame").collect()
    y = K.lowpass(np.array(x), 1.0, 15.0)
    assert np.allclose([r["y"] for r in got], y)
    assert [r["frame"] for r in got if r["onset"]] == loop_onsets(y, 1.5, 0.5)
