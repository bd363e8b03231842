"""Queries over scores, labels and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrain.functions import kernels
from fluxgrain.operators import clustering as C
from fluxgrain.operators import scoring as S
from fluxgrain.operators.ranks import row_numbers
from fluxgrain.plans.registry import query, r6
from fluxgrain.sources.standins import read, trace_arrays, with_

FEATURES = "feat AS (SELECT vec_id AS roi, label AS recording, vec_id % 11 AS rate, vec_id % 23 AS peak, 20 + vec_id % 61 AS npix, CASE WHEN (vec_id * 7) % 10 < 3 + label % 3 THEN 1 ELSE 0 END AS y FROM embeddings), sc AS (SELECT *, 1 / (1 + exp(-(2.3662 + 1.0454 * (rate - 4.079) / 1.146 + 1.1252 * (peak - 11.24) / 4.214 + 0.2987 * (npix - 41.178) / 37.065))) AS raw FROM feat), score AS (SELECT *, round(raw, 9) AS score FROM sc)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    y = F.when((v * 7) % 10 < 3 + F.col("label") % 3, 1).otherwise(0)
    return e.select(v.alias("roi"), F.col("label").alias("recording"), (v % 11).alias("rate"), (v % 23).alias("peak"), (20 + v % 61).alias("npix"), y.alias("y"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).withColumn("score", F.round(S.cell_score([F.col(c) for c in ("rate", "peak", "npix")]), 9))


@query(f"WITH {FEATURES} SELECT roi, round(score, 6) AS score FROM score")
def q_cell_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("roi", r6("score").alias("score"))


@query(f"WITH {FEATURES}, a AS (SELECT avg((score >= 0.999)::INT) AS share, count(*) FILTER (score > 0) AS n_pos, avg(score) + stddev_pop(score) AS edge, count(*) FILTER (score >= 0.999) AS n1 FROM score), b AS (SELECT *, (SELECT count(*) FROM score WHERE score >= edge) AS n2 FROM a) SELECT roi, CASE WHEN CASE WHEN share < 0.02 AND n_pos >= 10 AND n2 > n1 THEN n2 ELSE n1 END > 1000 THEN score >= 0.68 WHEN share < 0.02 AND n_pos >= 10 AND n2 > n1 THEN score >= edge ELSE score >= 0.999 END AS keep FROM score, b")
def q_soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.soft_mask(scored(spark, sf_dir).select("roi", "score"), 0.999).select("roi", "keep")


@query(f"WITH {FEATURES}, r AS (SELECT roi, rank() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM score) SELECT roi, r <= ceil(n * 10 / 100) AS keep FROM r")
def q_top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_share(scored(spark, sf_dir).select("roi", "score"), 10.0).select("roi", "keep")


@query(f"WITH {FEATURES}, c AS (SELECT count(*) FILTER (score >= 0.68 AND y = 1) AS tp, count(*) FILTER (score >= 0.68 AND y = 0) AS fp, count(*) FILTER (score < 0.68 AND y = 1) AS fn, count(*) FILTER (score < 0.68 AND y = 0) AS tn FROM score) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS youden FROM c")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.confusion(scored(spark, sf_dir), "score", "y", 0.68)
    return c.select("tp", "fp", "fn", "tn", *(r6(x).alias(x) for x in ("precision", "recall", "f1", "accuracy", "youden")))


@query(f"WITH {FEATURES}, g AS (SELECT score, sum(y) AS pos, count(*) AS n FROM score GROUP BY score), t AS (SELECT score, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS p, sum(n - pos) OVER () AS q FROM g WINDOW w AS (ORDER BY score DESC)), f AS (SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(2 * tp / (tp + fp + p), 6) AS f1 FROM t) SELECT * FROM f ORDER BY f1 DESC, score DESC LIMIT 1")
def q_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one threshold with the best F1: a top-1 report."""
    t = S.thresholds(scored(spark, sf_dir), "score", "y").withColumn("f1", r6("f1"))
    return t.orderBy(F.desc("f1"), F.desc("score")).limit(1).select("score", "tp", "fp", "f1")


@query(f"WITH {FEATURES}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM score) SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r")
def q_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.auroc(scored(spark, sf_dir), "score", "y").select(r6("auroc").alias("auroc"))


@query(f"WITH {FEATURES}, z AS (SELECT roi, (rate - avg(rate) OVER ()) / stddev_pop(rate) OVER () AS a, (npix - avg(npix) OVER ()) / stddev_pop(npix) OVER () AS b FROM feat) SELECT roi, round(a, 6) + 0.0 AS rate_z, round(b, 6) + 0.0 AS npix_z FROM z")
def q_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.standardise(features(spark, sf_dir), ["rate", "npix"]).select("roi", r6("rate_z").alias("rate_z"), r6("npix_z").alias("npix_z"))


@query()
def q_logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newton's method over aggregates: iterative, tested against numpy."""
    df = S.standardise(features(spark, sf_dir), ["rate", "peak", "npix"])
    beta = S.fit_logistic(df, ["rate_z", "peak_z", "npix_z"], "y")
    return spark.createDataFrame([(n, round(b, 6)) for n, b in zip(("bias", "rate", "peak", "npix"), beta, strict=True)], "term string, weight double")


LOG = "l AS (SELECT doc_id % 7 AS recording, doc_id AS roi, quality AS label, doc_id AS seq FROM labels UNION ALL SELECT doc_id % 7, doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END, doc_id + 1000000 FROM labels WHERE doc_id % 3 = 0)"


@query(f"WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY recording, roi ORDER BY seq DESC) AS rn FROM l) SELECT recording, roi, label FROM r WHERE rn = 1 AND label IS NOT NULL")
def q_dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "labels")
    rec = (F.col("doc_id") % 7).alias("recording")
    a = d.select(rec, F.col("doc_id").alias("roi"), F.col("quality").alias("label"), F.col("doc_id").alias("seq"))
    again = F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("label")
    b = d.where("doc_id % 3 = 0").select(rec, F.col("doc_id").alias("roi"), again, (F.col("doc_id") + 1000000).alias("seq"))
    return S.effective_labels(a.unionByName(b))


@query(f"WITH {FEATURES}, r AS (SELECT roi, y, row_number() OVER (PARTITION BY y ORDER BY (roi * 48271 + 11) % 65537, roi) AS rn, count(*) OVER (PARTITION BY y) AS n FROM feat) SELECT roi, y, CASE WHEN rn <= greatest(1, ceil(n * 0.2)) THEN 'val' ELSE 'train' END AS part FROM r")
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split(features(spark, sf_dir), "y", F.col("roi"), 0.2).select("roi", "y", "part")


@query(f"WITH {FEATURES}, k AS (SELECT roi, CASE WHEN roi % 4 = 0 THEN roi % 8 = 0 END AS predicted, CASE WHEN roi % 3 = 0 THEN roi % 9 = 0 END AS legacy, CASE WHEN roi % 5 < 4 THEN roi % 2 END AS iscell FROM feat) SELECT roi, coalesce(predicted, legacy, iscell > 0, true) AS keep FROM k")
def q_keep_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).select("roi")
    a = f.where("roi % 4 = 0").select("roi", (F.col("roi") % 8 == 0).alias("predicted"))
    b = f.where("roi % 3 = 0").select("roi", (F.col("roi") % 9 == 0).alias("legacy"))
    c = f.where("roi % 5 < 4").select("roi", (F.col("roi") % 2).alias("iscell"))
    j = f.join(a, "roi", "left").join(b, "roi", "left").join(c, "roi", "left")
    return j.select("roi", S.keep_mask(F.col("predicted"), F.col("legacy"), F.col("iscell")).alias("keep"))


@query(f"WITH {FEATURES} SELECT roi, row_number() OVER (ORDER BY score DESC, recording, roi) AS pooled, row_number() OVER (ORDER BY abs(score - 0.5), recording, roi) AS uncertain FROM score WHERE roi % 6 <> 0")
def q_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    todo = s.join(s.where("roi % 6 = 0").select("roi"), "roi", "left_anti")
    todo = todo.withColumn("down", -F.col("score")).withColumn("doubt", F.abs(F.col("score") - 0.5))
    a = row_numbers(todo, "down", S.work_queue(todo, "pooled"), "pooled").select("roi", "pooled")
    return a.join(row_numbers(todo, "doubt", S.work_queue(todo, "uncertainty"), "uncertain").select("roi", "uncertain"), "roi")


@query(f"WITH {FEATURES} SELECT recording, (array_agg(roi ORDER BY score DESC, roi))[1] AS best, round(max(score), 6) AS score FROM score GROUP BY recording")
def q_best_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by("roi", F.struct("score", -F.col("roi")))
    return scored(spark, sf_dir).groupBy("recording").agg(best.alias("best"), r6(F.max("score")).alias("score"))


@query(f"WITH {FEATURES} SELECT roi, y, CASE WHEN y = 1 THEN 100 ELSE 0 END AS prob FROM feat")
def q_iscell_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("roi", "y", F.when(F.col("y") == 1, 100).otherwise(0).alias("prob"))


@query(with_("trace") + " SELECT a.roi AS roi_a, b.roi AS roi_b, round(1 - corr(a.f, b.f), 6) + 0.0 AS dist FROM trace a JOIN trace b ON a.frame = b.frame AND a.roi < b.roi GROUP BY ALL")
def q_corr_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.distances(trace_arrays(spark, sf_dir), digits=6)


@query()
def q_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward linkage of all regions: sequential, tested on hand-made points."""
    _, merges = C.linkage(trace_arrays(spark, sf_dir), "euclidean", "ward")
    return spark.createDataFrame([(i, int(a), int(b), round(d, 6), int(n)) for i, (a, b, d, n) in enumerate(merges.tolist())], "step int, a int, b int, dist double, n int")


@query()
def q_fcluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat clusters by correlation distance at the automatic cut."""
    arrays = trace_arrays(spark, sf_dir)
    rois, merges = C.linkage(arrays)
    return C.flat_clusters(arrays, rois, merges, kernels.auto_cut(merges, len(rois)))


@query()
def q_leaf_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf order and colour groups under the automatic cut."""
    rois, merges = C.linkage(trace_arrays(spark, sf_dir))
    order = kernels.leaf_order(merges, len(rois))
    colours = kernels.colour_groups(merges, len(rois), kernels.auto_cut(merges, len(rois)))
    return spark.createDataFrame([(i, rois[x], f"C{c}") for i, (x, c) in enumerate(zip(order, colours, strict=True))], "position int, roi long, colour string")
