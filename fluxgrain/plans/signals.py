"""Queries over traces: baselines, filters, derivatives, scores, onsets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrain.functions.columns import butter2, zscore
from fluxgrain.operators import traces as T
from fluxgrain.plans.registry import query, r6
from fluxgrain.sources.standins import exploded, trace, trace_arrays, with_

FPS, HI, LO = 15.0, 1.5, 0.5
LIFT = 10.0  # added to the stand-in's values where a baseline must be positive

PAIRED = with_("trace") + ", n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT t.*, u.f AS fneu FROM trace t, n JOIN trace u ON u.roi = (t.roi + 1) % n.n AND u.frame = t.frame)"


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace with fneu: the trace of the next region."""
    t = trace(spark, sf_dir)
    n = trace_arrays(spark, sf_dir).agg(F.count("*").alias("n"))
    u = t.select(F.col("roi").alias("other"), F.col("frame").alias("at"), F.col("f").alias("fneu"))
    t = t.crossJoin(F.broadcast(n)).withColumn("next", (F.col("roi") + 1) % F.col("n"))
    return t.join(u, (F.col("next") == F.col("other")) & (F.col("frame") == F.col("at"))).select("recording", "roi", "frame", "f", "fneu")


@query(PAIRED + " SELECT roi, frame, round(f - 0.7 * fneu, 6) + 0.0 AS v FROM b")
def q_neuropil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.subtract_neuropil(paired(spark, sf_dir)).select("roi", "frame", r6("v").alias("v"))


@query(PAIRED + ", s AS (SELECT *, greatest(0, -least(min(f) OVER w, min(fneu) OVER w)) AS shift FROM b WINDOW w AS (PARTITION BY recording)) SELECT recording, round(max(shift), 6) AS shift, round(min(least(f, fneu) + shift), 6) + 0.0 AS lowest, count(*) AS n FROM s GROUP BY recording")
def q_nonneg_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.shift_nonnegative(paired(spark, sf_dir))
    return s.groupBy("recording").agg(r6(F.max("shift")).alias("shift"), r6(F.min(F.least("f", "fneu"))).alias("lowest"), F.count("*").alias("n"))


@query(
    with_("trace")
    + """, g AS (SELECT roi, frame, CASE WHEN (roi * 7 + frame * 3) % 11 = 0 THEN NULL ELSE f END AS f FROM trace),
 e AS (SELECT *, last_value(CASE WHEN f IS NOT NULL THEN frame END IGNORE NULLS) OVER a AS pf, last_value(f IGNORE NULLS) OVER a AS px,
  first_value(CASE WHEN f IS NOT NULL THEN frame END IGNORE NULLS) OVER b AS qf, first_value(f IGNORE NULLS) OVER b AS qx FROM g
  WINDOW a AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY roi ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT roi, frame, round(coalesce(CASE WHEN pf = qf THEN px ELSE px + (qx - px) * ((frame - pf)::DOUBLE / (qf - pf)) END, px, qx), 6) + 0.0 AS v FROM e"""
)
def q_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).withColumn("f", F.expr("if((roi * 7 + frame * 3) % 11 = 0, null, f)"))
    return T.fill_gaps(t).select("roi", "frame", r6("v").alias("v"))


@query(with_("trace") + f", g AS (SELECT roi, frame, f + {LIFT} AS f FROM trace), b AS (SELECT roi, greatest(quantile_cont(f, 0.1), 1e-9) AS f0 FROM g WHERE frame < 20 GROUP BY roi) SELECT roi, frame, round((f - f0) / f0, 6) + 0.0 AS dff FROM g JOIN b USING (roi)")
def q_dff_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).withColumn("f", F.col("f") + LIFT)
    return T.dff_first(t, 20).select("roi", "frame", r6("dff").alias("dff"))


@query(with_("trace") + f", g AS (SELECT roi, frame, f + {LIFT} AS f FROM trace), b AS (SELECT roi, greatest(avg(f), 1e-6) AS f0 FROM g WHERE frame < 15 GROUP BY roi) SELECT roi, frame, round((f - f0) / f0, 6) + 0.0 AS dff FROM g JOIN b USING (roi)")
def q_dff_mean_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir).withColumn("f", F.col("f") + LIFT)
    return T.dff_first(t, 15, "mean").select("roi", "frame", r6("dff").alias("dff"))


@query(
    with_("trace")
    + f""", g AS (SELECT roi, frame, f + {LIFT} AS f FROM trace), k AS (SELECT unnest(range(-3, 4)) AS k),
 w AS (SELECT g.roi, g.frame, list_sort(list(h.f))[3] AS f0 FROM g, k JOIN g h ON h.roi = g.roi AND h.frame = least(greatest(g.frame + k.k, 0), 63) GROUP BY g.roi, g.frame),
 d AS (SELECT roi, greatest(quantile_cont(f0, 0.01), 1e-9) AS den FROM w GROUP BY roi)
 SELECT g.roi, g.frame, round((g.f - w.f0) / d.den, 6) + 0.0 AS dff FROM g JOIN w USING (roi, frame) JOIN d ON d.roi = g.roi"""
)
def q_dff_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.dff_rolling(trace_arrays(spark, sf_dir), 7, 30.0, LIFT)
    return exploded(d, "dff", "dff").select("roi", "frame", r6("dff").alias("dff"))


B0, B1, B2, A1, A2 = butter2(1.0, FPS)


@query(
    with_("trace", recursive=True)
    + f""", y AS (SELECT roi, frame, {B0} * f + f AS y, ({B1} * f - ({A1}) * ({B0} * f + f) + f) AS z0, ({B2} * f - ({A2}) * ({B0} * f + f)) AS z1 FROM trace WHERE frame = 0
  UNION ALL SELECT t.roi, t.frame, {B0} * t.f + y.z0, {B1} * t.f - ({A1}) * ({B0} * t.f + y.z0) + y.z1, {B2} * t.f - ({A2}) * ({B0} * t.f + y.z0) FROM y JOIN trace t ON t.roi = y.roi AND t.frame = y.frame + 1)
 SELECT roi, frame, round(y, 6) + 0.0 AS low FROM y"""
)
def q_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(T.lowpass_arrays(trace_arrays(spark, sf_dir), 1.0, FPS), "ys", "low").select("roi", "frame", r6("low").alias("low"))


@query(
    with_("trace")
    + f""", c AS (SELECT roi, frame, f, least(greatest(frame, 2), 61) AS c FROM trace),
 v AS (SELECT c.roi, c.frame, c.c, sum(CASE t.frame - c.c WHEN -2 THEN -2 WHEN -1 THEN -1 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END * t.f) / 10 AS slope, sum(CASE abs(t.frame - c.c) WHEN 2 THEN 2 WHEN 1 THEN -1 ELSE -2 END * t.f) / 14 AS bend
  FROM c JOIN trace t ON t.roi = c.roi AND t.frame BETWEEN c.c - 2 AND c.c + 2 GROUP BY ALL)
 SELECT roi, frame, round((slope + 2 * bend * (frame - c)) * {FPS}, 5) + 0.0 AS dt FROM v"""
)
def q_sg_deriv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(T.savgol5(trace_arrays(spark, sf_dir), FPS), "ys", "dt").select("roi", "frame", (F.round("dt", 5) + 0.0).alias("dt"))


@query(with_("trace") + f", l AS (SELECT roi, frame, (lag(f, 2) OVER w - 8 * lag(f) OVER w + 8 * lead(f) OVER w - lead(f, 2) OVER w) / 12 * {FPS} AS dt FROM trace WINDOW w AS (PARTITION BY roi ORDER BY frame)) SELECT roi, frame, round(dt, 5) + 0.0 AS dt FROM l")
def q_sg_deriv_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.derivative5(trace(spark, sf_dir), FPS, 3).select("roi", "frame", (F.round("dt", 5) + 0.0).alias("dt"))


@query(with_("trace", "z") + " SELECT roi, frame, round(z, 6) + 0.0 AS z FROM z")
def q_mad_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.robust_z(trace(spark, sf_dir)).select("roi", "frame", r6("z").alias("z"))


@query(with_("trace") + ", s AS (SELECT roi, frame, f, avg(f) OVER w AS m, stddev_pop(f) OVER w AS sd FROM trace WINDOW w AS (PARTITION BY roi)) SELECT roi, frame, round(CASE WHEN sd > 0 THEN (f - m) / sd ELSE 0 END, 6) + 0.0 AS z, round((f - m) / (sd + 1e-8), 6) + 0.0 AS z_eps FROM s")
def q_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return t.select("roi", "frame", r6(zscore(F.col("f"), ["roi"])).alias("z"), r6(zscore(F.col("f"), ["roi"], "eps")).alias("z_eps"))


@query(
    with_("trace")
    + ", k AS (SELECT unnest(range(33)) AS k), s AS (SELECT roi, k, sum(f * cos(-2 * pi() * ((k * frame) % 64) / 64)) AS c, sum(f * sin(-2 * pi() * ((k * frame) % 64) / 64)) AS s FROM trace, k GROUP BY roi, k) SELECT roi, k, round(c * c + s * s, 6) + 0.0 AS power FROM s"
)
def q_fft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.power_spectrum(trace_arrays(spark, sf_dir)).select("roi", "k", r6("power").alias("power"))


@query(with_("trace") + " SELECT roi, frame, round(quantile_cont(f, 0.1) OVER (PARTITION BY roi ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) + 0.0 AS base FROM trace")
def q_rolling_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    w = T.by_roi(t).rowsBetween(-5, 5)
    return t.select("roi", "frame", r6(F.percentile("f", 0.1).over(w)).alias("base"))


@query(
    with_("trace")
    + """, k AS (SELECT unnest(range(-8, 9)) AS k), w AS (SELECT k, exp(-0.5 * (k / 2.0) ** 2) AS w FROM k), q AS (SELECT k, w / sum(w) OVER () AS w FROM w)
 SELECT t.roi, t.frame, round(sum(u.f * q.w), 6) + 0.0 AS v FROM trace t, q JOIN trace u ON u.roi = t.roi AND u.frame = least(greatest(t.frame + q.k, 0), 63) GROUP BY t.roi, t.frame"""
)
def q_gauss_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(T.smooth_gaussian(trace_arrays(spark, sf_dir), 2.0), "ys", "v").select("roi", "frame", r6("v").alias("v"))


@query(with_("trace") + " SELECT roi, frame // 5 AS bin, round(avg(f), 6) + 0.0 AS v FROM trace WHERE frame < 60 GROUP BY roi, frame // 5")
def q_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.downsample(trace(spark, sf_dir), 5, 64).select("roi", "bin", r6("v").alias("v"))


@query(
    with_("trace")
    + """, b AS (SELECT roi, frame // 5 AS bin, round(avg(f), 9) AS v FROM trace WHERE frame < 60 GROUP BY ALL), e AS (SELECT roi, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM b GROUP BY roi)
 SELECT roi, bin, CAST(CASE WHEN hi > lo THEN floor(least(greatest((v - lo) / (hi - lo), 0), 1) * 255 + 0.5) ELSE 0 END AS INTEGER) AS u8 FROM b JOIN e USING (roi)"""
)
def q_heatmap_u8(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.downsample(trace(spark, sf_dir), 5, 64).withColumn("v", F.round("v", 9))
    return T.to_uint8(b, "v").select("roi", "bin", "u8")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.onsets(T.robust_z(trace(spark, sf_dir)), HI, LO)


@query(with_("trace", "z", "act") + " SELECT roi, frame FROM ons")
def q_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onsets(spark, sf_dir).select("roi", "frame")


SEPARATED = """, n AS (SELECT roi, frame, row_number() OVER (PARTITION BY roi ORDER BY frame) AS i FROM ons),
 k AS (SELECT roi, frame, i, frame AS kept, true AS keep FROM n WHERE i = 1
  UNION ALL SELECT n.roi, n.frame, n.i, CASE WHEN n.frame - k.kept >= 6 THEN n.frame ELSE k.kept END, n.frame - k.kept >= 6 FROM k JOIN n ON n.roi = k.roi AND n.i = k.i + 1)"""


@query(with_("trace", "z", "act", recursive=True) + SEPARATED + " SELECT roi, frame FROM k WHERE keep")
def q_min_sep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.separated(onsets(spark, sf_dir), 6).select("roi", "frame")


@query(with_("trace", "z", "act") + f", c AS (SELECT roi, count(*) AS n FROM ons GROUP BY roi) SELECT vec_id AS roi, coalesce(n, 0) AS onsets, round(coalesce(n, 0) / greatest(64 / {FPS} / 60, 1e-9), 6) AS per_min FROM embeddings LEFT JOIN c ON roi = vec_id")
def q_event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.robust_z(trace(spark, sf_dir))
    on = T.onsets(t, HI, LO).groupBy("roi").agg(F.count("*").alias("n"))
    every = trace_arrays(spark, sf_dir).select("roi", F.size("xs").alias("frames"))
    n = F.coalesce("n", F.lit(0))
    return every.join(on, "roi", "left").select("roi", n.alias("onsets"), F.round(n / F.greatest(F.col("frames") / FPS / 60, F.lit(1e-9)), 6).alias("per_min"))


@query(with_("trace", "z") + " SELECT roi, round(max(z), 6) + 0.0 AS peak, round(avg(f), 6) + 0.0 AS mean FROM z GROUP BY roi")
def q_peak_and_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.robust_z(trace(spark, sf_dir))
    return t.groupBy("roi").agg(r6(F.max("z")).alias("peak"), r6(F.avg("f")).alias("mean"))


@query(with_("trace") + " SELECT recording, frame, round(avg(f), 6) + 0.0 AS mean, round(median(f), 6) + 0.0 AS median FROM trace GROUP BY recording, frame")
def q_population_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).groupBy("recording", "frame").agg(r6(F.avg("f")).alias("mean"), r6(F.median("f")).alias("median"))


@query(with_("trace") + " SELECT roi, frame // 10 AS bin, bool_or(f > 0.2) AS spiked FROM trace GROUP BY ALL")
def q_spike_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(spark, sf_dir).groupBy("roi", F.floor(F.col("frame") / 10).alias("bin")).agg(F.bool_or(F.col("f") > 0.2).alias("spiked"))


@query(with_("trace") + f" SELECT roi, frame, round(frame / {FPS}, 6) AS t_s FROM trace WHERE frame / {FPS} >= 1 AND frame / {FPS} <= 3")
def q_time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("frame") / FPS
    return trace(spark, sf_dir).where(t.between(1, 3)).select("roi", "frame", F.round(t, 6).alias("t_s"))


@query(with_("trace") + ", p AS (SELECT roi, quantile_cont(f, 0.05) AS lo, quantile_cont(f, 0.95) AS hi FROM trace GROUP BY roi) SELECT roi, frame, round(CASE WHEN hi > lo THEN least(greatest((f - lo) / (hi - lo), 0), 1) ELSE 0 END, 6) + 0.0 AS v FROM trace JOIN p USING (roi)")
def q_robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("roi")
    t = trace(spark, sf_dir).withColumn("lo", F.percentile("f", 0.05).over(w)).withColumn("hi", F.percentile("f", 0.95).over(w))
    v = F.when(F.col("hi") > F.col("lo"), F.least(F.greatest((F.col("f") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return t.select("roi", "frame", r6(v).alias("v"))


@query()
def q_process_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on long traces; its steps are compared with SQL one by one above, the chain with numpy in the tests."""
    t = trace(spark, sf_dir).withColumn("f", F.col("f") + LIFT)
    out = T.process(t, FPS, window_s=1.0)
    return out.select("recording", "roi", "frame", *(r6(c).alias(c) for c in ("dff", "low", "dt")))


@query(with_("trace") + f", p AS (SELECT roi, frame, {math.pi} * frame AS a, f FROM trace) SELECT roi, round(sqrt(sum(f * f)), 6) AS norm, round(hypot(min(f), max(f)), 6) AS h, round(degrees(atan2(max(f), min(f))), 6) AS angle, CAST(round_even(avg(f) * 100, 0) AS BIGINT) AS cents FROM p GROUP BY roi".replace("hypot(min(f), max(f))", "sqrt(min(f) * min(f) + max(f) * max(f))"))
def q_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = trace(spark, sf_dir), F.col("f")
    return t.groupBy("roi").agg(
        F.round(F.sqrt(F.sum(f * f)), 6).alias("norm"),
        F.round(F.hypot(F.min(f), F.max(f)), 6).alias("h"),
        F.round(F.degrees(F.atan2(F.max(f), F.min(f))), 6).alias("angle"),
        F.bround(F.avg(f) * 100, 0).cast("long").alias("cents"),
    )
