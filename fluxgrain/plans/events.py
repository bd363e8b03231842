"""Queries over onsets: windows, bins, density, population events, order of activation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrain.functions.kernels import EventParams
from fluxgrain.operators import events as E
from fluxgrain.operators import traces as T
from fluxgrain.plans.registry import query, r6
from fluxgrain.plans.signals import FPS, SEPARATED, onsets
from fluxgrain.sources.standins import cluster, onset, read, rows, trace_arrays, with_

WINDOWS = [(1, 0, 20), (2, 45, 18), (3, 40, 63)]
WINDOWS_SQL = ", win(window_no, s0, e0) AS (VALUES (1, 0, 20), (2, 45, 18), (3, 40, 63)), w AS (SELECT window_no AS \"window\", least(s0, e0) AS s, greatest(s0, e0) AS e FROM win)"
HOUR = 3600.0


def windows(spark: SparkSession) -> DataFrame:
    return rows(spark, WINDOWS, "window int, start int, end int")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = T.separated(onsets(spark, sf_dir), 6)
    return E.counts_in_windows(on, windows(spark), trace_arrays(spark, sf_dir).select("roi"))


COUNTED = with_("trace", "z", "act", recursive=True) + SEPARATED + WINDOWS_SQL + ", kk AS (SELECT roi, frame FROM k WHERE keep), c AS (SELECT v.vec_id AS roi, w.\"window\", w.s, w.e, count(kk.frame) AS n FROM embeddings v CROSS JOIN w LEFT JOIN kk ON kk.roi = v.vec_id AND kk.frame BETWEEN w.s AND w.e GROUP BY ALL)"


@query(COUNTED + " SELECT roi, CAST(sum(n) FILTER (\"window\" = 1) AS BIGINT) AS w1, CAST(sum(n) FILTER (\"window\" = 2) AS BIGINT) AS w2, CAST(sum(n) FILTER (\"window\" = 3) AS BIGINT) AS w3 FROM c GROUP BY roi")
def q_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = counted(spark, sf_dir).groupBy("roi").pivot("window", [1, 2, 3]).agg(F.sum("n"))
    return wide.select("roi", F.col("1").alias("w1"), F.col("2").alias("w2"), F.col("3").alias("w3"))


@query(COUNTED + f" SELECT roi, \"window\", n, round(n / ((e - s + 1) / {FPS}), 6) AS hz FROM c")
def q_range_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.frequencies(counted(spark, sf_dir), FPS).select("roi", "window", "n", r6("hz").alias("hz"))


@query(COUNTED + f", f AS (SELECT *, (e - s + 1) / {FPS} AS dur, n / ((e - s + 1) / {FPS}) AS hz FROM c) SELECT \"window\", count(*) AS n_rois, round(avg(hz), 6) AS mean_hz, CAST(round_even(round(avg(hz) * any_value(dur) * count(*), 6), 0) AS BIGINT) AS total FROM f GROUP BY \"window\"")
def q_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = E.frequencies(counted(spark, sf_dir), FPS).withColumn("dur", (F.col("end") - F.col("start") + 1) / FPS)
    total = F.bround(F.round(F.avg("hz") * F.any_value("dur") * F.count("*"), 6), 0).cast("long")
    return f.groupBy("window").agg(F.count("*").alias("n_rois"), r6(F.avg("hz")).alias("mean_hz"), total.alias("total"))


@query(COUNTED + ", p AS (SELECT vec_id AS roi FROM embeddings WHERE label IN (2, 4)) SELECT \"window\", count(*) AS rois_in_counts, count(p.roi) AS rows_kept, (SELECT count(*) FROM p) AS rois_in_clusters FROM c LEFT JOIN p ON p.roi = c.roi GROUP BY \"window\"")
def q_filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cluster(spark, sf_dir).where("cluster in ('C2', 'C4')").select(F.col("roi").alias("picked"))
    c = counted(spark, sf_dir).join(p, F.col("roi") == F.col("picked"), "left")
    n = F.broadcast(p.agg(F.count("*").alias("rois_in_clusters")))
    return c.groupBy("window").agg(F.count("*").alias("rois_in_counts"), F.count("picked").alias("rows_kept")).crossJoin(n)


@query(with_("onset") + f" SELECT roi, CAST(floor(t_s / {HOUR}) AS BIGINT) AS bin, round(min(t_s), 6) AS first_t FROM onset GROUP BY ALL")
def q_bin_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.binned(onset(spark, sf_dir), HOUR).select("roi", "bin", r6("first_t").alias("first_t"))


EVENTS = ", ev AS (SELECT CAST(unnest(range(40)) AS BIGINT) AS event), w AS (SELECT event, event * 50000.0::DOUBLE AS s, event * 50000.0::DOUBLE + 60000.0 AS e FROM ev), act AS (SELECT o.roi, w.event, min(o.t_s) AS first_t FROM onset o JOIN w ON o.t_s >= w.s AND o.t_s <= w.e GROUP BY ALL)"


def event_windows(spark: SparkSession) -> DataFrame:
    return spark.range(40).select(F.col("id").alias("event"), (F.col("id") * 50000.0).alias("s"), (F.col("id") * 50000.0 + 60000.0).alias("e"))


def activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.range_join(onset(spark, sf_dir), event_windows(spark), "t_s", "s", "e").groupBy("roi", "event").agg(F.min("t_s").alias("first_t"))


@query(with_("onset") + EVENTS + " SELECT roi, event, round(first_t, 6) AS first_t FROM act")
def q_window_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activation(spark, sf_dir).select("roi", "event", r6("first_t").alias("first_t"))


@query(with_("onset") + EVENTS + " SELECT roi, event, round(first_t, 6) AS first_t FROM act")
def q_window_activation_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.range_join(onset(spark, sf_dir), event_windows(spark), "t_s", "s", "e", bucket=25000.0)
    return found.groupBy("roi", "event").agg(r6(F.min("t_s")).alias("first_t"))


@query(with_("onset") + EVENTS + " SELECT roi, event, row_number() OVER (PARTITION BY event ORDER BY first_t, roi) AS rank, round(first_t - min(first_t) OVER (PARTITION BY event), 6) AS lag FROM act".replace("AS rank", "AS rank"))
def q_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rank_order(activation(spark, sf_dir)).select("roi", "event", F.col("rank").cast("long").alias("rank"), r6("lag").alias("lag"))


@query(with_("onset") + EVENTS + ", l AS (SELECT roi, first_t - min(first_t) OVER (PARTITION BY event) AS lag FROM act) SELECT roi, count(*) AS n, round(median(lag), 3) AS median_lag, round(avg(lag), 3) AS mean_lag FROM l GROUP BY roi HAVING count(*) >= 5")
def q_rel_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.rank_order(activation(spark, sf_dir))
    return r.groupBy("roi").agg(F.count("*").alias("n"), F.round(F.median("lag"), 3).alias("median_lag"), F.round(F.avg("lag"), 3).alias("mean_lag")).where("n >= 5")


@query(with_("onset") + EVENTS + " SELECT w.event, round(w.s, 6) AS start_s, round(w.e, 6) AS end_s, round(w.e - w.s, 6) AS duration_s, count(DISTINCT act.roi) AS n_active FROM w LEFT JOIN act ON act.event = w.event GROUP BY ALL")
def q_events_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, a = event_windows(spark), activation(spark, sf_dir).select("event", "roi")
    return w.join(a, "event", "left").groupBy("event", r6("s").alias("start_s"), r6("e").alias("end_s"), r6(F.col("e") - F.col("s")).alias("duration_s")).agg(F.count_distinct("roi").alias("n_active"))


@query(with_("onset") + EVENTS + ", r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY first_t, roi) AS r, count(*) OVER (PARTITION BY event) AS k FROM act) SELECT roi, event, round((k - r + 1) / k, 6) AS v FROM r")
def q_order_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.rank_order(activation(spark, sf_dir)).withColumn("k", F.max("rank").over(Window.partitionBy("event")))
    return r.select("roi", "event", r6((F.col("k") - F.col("rank") + 1) / F.col("k")).alias("v"))


@query(with_("onset") + f", b AS (SELECT CAST(floor(t_s / {HOUR}) AS BIGINT) AS bin, count(DISTINCT roi) AS active FROM onset GROUP BY 1 HAVING count(DISTINCT roi) >= 5) SELECT bin, active, coalesce(bin - lag(bin) OVER (ORDER BY bin) > 1, true) AS begins FROM b")
def q_sync_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.synchronous(E.binned(onset(spark, sf_dir), HOUR), 100, 0.05).select("bin", "active", "begins")


@query()
def q_coact_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highly co-active bins under the adaptive threshold; a control loop over a histogram, tested against a plain loop."""
    return E.coactive_bins(E.binned(onset(spark, sf_dir), HOUR), 720, 150)


DENSITY = with_("onset") + f", p AS (SELECT CAST(unnest(range(720)) AS BIGINT) AS bin), c AS (SELECT least(CAST(floor(t_s / {HOUR}) AS BIGINT), 719) AS bin, count(*) AS c FROM onset GROUP BY 1), dens AS (SELECT p.bin, coalesce(c, 0) / (SELECT count(DISTINCT roi) FROM onset) AS d FROM p LEFT JOIN c USING (bin))"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = onset(spark, sf_dir)
    return E.density(on, HOUR, 720, on.agg(F.count_distinct("roi").alias("n")))


@query(DENSITY + " SELECT bin, round(d, 6) AS d FROM dens")
def q_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(spark, sf_dir).select("bin", r6("d").alias("d"))


@query(DENSITY + ", r AS (SELECT bin // 240 AS part, d - quantile_cont(d, 0.05) OVER (PARTITION BY bin // 240) AS r FROM dens), q AS (SELECT *, r <= quantile_cont(r, 0.4) OVER (PARTITION BY part) AS calm FROM r), f AS (SELECT *, count(*) FILTER (calm) OVER (PARTITION BY part) < 32 AS few FROM q), g AS (SELECT part, r FROM f WHERE calm OR few), m AS (SELECT *, median(r) OVER (PARTITION BY part) AS med FROM g) SELECT part, round(1.4826 * (median(abs(r - med)) + 1e-12), 6) AS noise, count(*) AS n FROM m GROUP BY part")
def q_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir).withColumn("part", F.floor(F.col("bin") / 240))
    d = d.withColumn("r", F.col("d") - F.percentile("d", 0.05).over(Window.partitionBy("part")))
    return E.noise(d, ["part"]).select("part", r6("noise").alias("noise"), "n")


PEAKED = DENSITY + ", e AS (SELECT bin // 240 AS part, bin AS i, d, (SELECT quantile_cont(d, 0.6) FROM dens) AS level, lag(d) OVER w AS p, lead(d) OVER w AS q FROM dens WINDOW w AS (PARTITION BY bin // 240 ORDER BY bin)), f AS (SELECT *, coalesce(d > p AND d > q AND d > level, false) AS is_peak, max(CASE WHEN d <= level THEN i END) OVER (PARTITION BY part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN d <= level THEN i END) OVER (PARTITION BY part ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a, min(i) OVER (PARTITION BY part) AS lo, max(i) OVER (PARTITION BY part) AS hi FROM e), wk AS (SELECT part, i, d, greatest(coalesce(b + 1, lo), i - 4) AS s, least(coalesce(a - 1, hi), i + 4) AS t FROM f WHERE is_peak)"


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir).select(F.floor(F.col("bin") / 240).alias("part"), F.col("bin").alias("i"), "d")
    d = d.crossJoin(F.broadcast(d.agg(F.percentile("d", 0.6).alias("level"))))
    w = Window.partitionBy("part").orderBy("i")
    up = (F.col("d") > F.lag("d").over(w)) & (F.col("d") > F.lead("d").over(w)) & (F.col("d") > F.col("level"))
    return E.walked(d.withColumn("is_peak", F.coalesce(up, F.lit(False))), ["part"], 4)


@query(PEAKED + " SELECT part, i, s AS start, t AS \"end\" FROM wk")
def q_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir).select("part", "i", "start", "end")


@query(PEAKED + ", n AS (SELECT *, CASE WHEN s - max(t) OVER (PARTITION BY part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS new FROM wk), g AS (SELECT *, sum(new) OVER (PARTITION BY part ORDER BY i) AS event FROM n) SELECT part, CAST(event AS BIGINT) AS event, min(s) AS start, (array_agg(i ORDER BY d DESC, i))[1] AS peak, max(t) AS \"end\" FROM g GROUP BY part, event")
def q_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merged(walked(spark, sf_dir), ["part"], 1).select("part", "event", "start", "peak", "end")


@query(DENSITY + ", w AS (SELECT bin // 24 AS event, bin * 1.0::DOUBLE AS t, greatest(d - (SELECT quantile_cont(d, 0.3) FROM dens), 0) AS w FROM dens), m AS (SELECT event, sum(t * w) / nullif(sum(w), 0) AS mu FROM w GROUP BY event) SELECT w.event, round(any_value(mu), 6) AS mu, round(greatest(sqrt(sum((t - mu) * (t - mu) * w) / nullif(sum(w), 0)), 0.05), 6) AS sigma FROM w JOIN m USING (event) GROUP BY w.event")
def q_gauss_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hourly(spark, sf_dir)
    base = F.broadcast(d.agg(F.percentile("d", 0.3).alias("base")))
    s = d.crossJoin(base).select(F.floor(F.col("bin") / 24).alias("event"), F.col("bin").cast("double").alias("t"), (F.col("d") - F.col("base")).alias("w"))
    return E.moments(s, ["event"], 0.05).select("event", r6("mu").alias("mu"), r6("sigma").alias("sigma"))


HOURLY = EventParams(bin_s=HOUR, min_prominence=0.001, min_width_bins=1.0, min_distance_bins=2.0, baseline_window_s=48 * HOUR, max_duration_s=12 * HOUR, fit_pad_s=HOUR, min_sigma_s=60.0)


@query()
def q_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density peaks by prominence, width and distance; a sequential kernel, tested on hand-made series."""
    return E.density_peaks(hourly(spark, sf_dir).withColumn("part", F.floor(F.col("bin") / 240)), "part", HOURLY)


@query()
def q_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population events of each recording (here a part of the month); a sequential kernel, tested on hand-made onsets."""
    on = onset(spark, sf_dir).withColumn("recording", F.floor(F.col("t_s") / (240 * HOUR))).withColumn("t_s", F.col("t_s") % (240 * HOUR))
    return E.population_events(on, HOURLY)


@query(with_("onset") + f" SELECT roi, CAST(floor(t_s / {24 * HOUR}) AS BIGINT) AS day, round(min(t_s) - floor(t_s / {24 * HOUR}) * {24 * HOUR}, 5) AS rel FROM onset GROUP BY roi, floor(t_s / {24 * HOUR})")
def q_aligned_bin_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = E.binned(onset(spark, sf_dir), 24 * HOUR)
    return b.select("roi", F.col("bin").alias("day"), F.round(F.col("first_t") - F.col("bin") * 24 * HOUR, 5).alias("rel"))


@query(with_("trace", "z", "act") + ", b AS (SELECT roi, least(frame // 5, 11) AS bin FROM ons) SELECT roi, bin, count(*) AS n, count(*) OVER (PARTITION BY roi) AS bins FROM b GROUP BY roi, bin")
def q_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = onsets(spark, sf_dir).groupBy("roi", F.least(F.floor(F.col("frame") / 5), F.lit(11)).alias("bin")).agg(F.count("*").alias("n"))
    return r.withColumn("bins", F.count("*").over(Window.partitionBy("roi")))


@query(with_("trace", "z", "act") + ", c AS (SELECT roi, count(*) AS n FROM ons GROUP BY roi), r AS (SELECT roi, n, row_number() OVER (ORDER BY n DESC, roi) AS rn FROM c) SELECT roi, n, rn, (rn - 1) // 96 AS page FROM r WHERE rn <= 200")
def q_top_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 regions with most onsets, 96 a page: a top-k report, so the limit is the feature."""
    c = onsets(spark, sf_dir).groupBy("roi").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "roi").limit(200)
    rn = F.row_number().over(Window.orderBy(F.desc("n"), "roi")).cast("long")
    return c.withColumn("rn", rn).withColumn("page", F.floor((F.col("rn") - 1) / 96))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def q_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), r6(F.avg("value")).alias("mean"))


