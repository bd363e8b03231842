"""Scores and labels of regions: logistic score, masks, thresholds, ROC, fitting, queues, splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrain.operators.ranks import running_totals

# fixed values: the fitted weights, means and scales of (bias, event rate, peak derivative, pixels)
WEIGHTS, MEANS, SCALES = (2.3662, 1.0454, 1.1252, 0.2987), (4.079, 11.24, 41.178), (1.146, 4.214, 37.065)


def cell_score(features: Sequence[Column], weights: Sequence[float] = WEIGHTS, means: Sequence[float] = MEANS, scales: Sequence[float] = SCALES) -> Column:
    """Logistic of bias + sum of weight * (x - mean) / scale."""
    z = F.lit(weights[0])
    for x, w, m, s in zip(features, weights[1:], means, scales, strict=True):
        z = z + w * (x - m) / s
    return 1 / (1 + F.exp(-z))


def keep_mask(predicted: Column, legacy: Column, iscell: Column) -> Column:
    """The first of the sources that is there; all regions if none is."""
    return F.coalesce(predicted, legacy, iscell > 0, F.lit(True))


def top_share(scores: DataFrame, percent: float, name: str = "keep") -> DataFrame:
    """scores with name: whether fewer than ceil(percent of all rows), at least one, score higher; ties are kept, rows without a score not."""
    by = scores.where("score is not null").groupBy((-F.col("score")).alias("neg")).agg(F.count("*").alias("n"))
    upto = running_totals(by, "neg", ["n"]).withColumn("above", F.col("upto_n") - F.col("n"))  # how many score higher
    k = scores.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * percent / 100)).alias("k"))
    edge = upto.crossJoin(k).where("above < k").agg(F.max("neg").alias("worst"))
    return scores.crossJoin(edge).withColumn(name, F.coalesce(-F.col("score") <= F.col("worst"), F.lit(False))).drop("worst")


def soft_mask(scores: DataFrame, level: float, top_percent: float | None = None, most: int = 1000, strict: float = 0.68) -> DataFrame:
    """keep: score >= level (or the top percent, ties kept). If that keeps under 2% and at least 10 scores are positive, mean + sd of
    the positive ones where it keeps more; if over `most` remain, the strict level. One aggregate row is broadcast back."""
    if top_percent is not None:
        s = top_share(scores, top_percent, "first")
    else:
        s = scores.withColumn("first", F.col("score") >= level)
    positive = F.when(F.col("score") > 0, F.col("score"))
    a = s.agg(F.avg(F.col("first").cast("double")).alias("share"), F.count(positive).alias("n_pos"), (F.avg(positive) + F.stddev_pop(positive)).alias("edge"), F.count_if("first").alias("n_first"))
    s = s.crossJoin(a).withColumn("second", F.col("score") >= F.col("edge"))
    b = s.agg(F.count_if("second").alias("n_second"))
    s = s.crossJoin(b)
    relax = (F.col("share") < 0.02) & (F.col("n_pos") >= 10) & (F.col("n_second") > F.col("n_first"))
    s = s.withColumn("kept", F.when(relax, F.col("second")).otherwise(F.col("first"))).withColumn("total", F.when(relax, F.col("n_second")).otherwise(F.col("n_first")))
    return s.select(*scores.columns, F.when(F.col("total") > most, F.col("score") >= strict).otherwise(F.col("kept")).alias("keep"))


def confusion(df: DataFrame, score: str, label: str, level: float) -> DataFrame:
    p, y = F.col(score) >= level, F.col(label) == 1
    c = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), (recall + ratio(tn, tn + fp) - 1).alias("youden"))


def thresholds(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, tp, fp, f1, youden for a threshold at each distinct score: one aggregation and running totals over ranges of scores."""
    g = df.groupBy((-F.col(score)).alias("neg")).agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n")).withColumn("other", F.col("n") - F.col("pos"))
    whole = g.agg(F.sum("pos").alias("p"), F.sum("other").alias("q"))
    g = running_totals(g, "neg", ["pos", "other"]).crossJoin(whole).select((-F.col("neg")).alias(score), F.col("upto_pos").alias("tp"), F.col("upto_other").alias("fp"), "p", "q")
    return g.select(score, "tp", "fp", (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).alias("f1"), (F.col("tp") / F.col("p") - F.col("fp") / F.col("q")).alias("youden"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """The rank-sum statistic over n1 * n0, ties at their mean rank. Ranks come from distinct scores, by running totals over ranges."""
    g = df.groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    g = running_totals(g, score, ["n"]).withColumn("rank", F.col("upto_n") - F.col("n") + (F.col("n") + 1) / 2)
    n1, n0 = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return g.agg(((F.sum(F.col("rank") * F.col("pos")) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auroc"))


def effective_labels(log: DataFrame) -> DataFrame:
    """The last label of each (recording, roi) by seq; a null label takes the last one back."""
    last = log.groupBy("recording", "roi").agg(F.max_by(F.struct("label"), "seq").alias("last"))  # wrapped: a null label counts
    return last.select("recording", "roi", F.col("last.label").alias("label")).where("label is not null")


def moments_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and standard deviation (1 where it is 0) of each column, as <column>_m and <column>_s."""
    sd = lambda c: F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"{c}_s")
    return df.agg(*(F.avg(c).alias(f"{c}_m") for c in columns), *(sd(c) for c in columns))


def standardise(df: DataFrame, columns: Sequence[str], moments: DataFrame | None = None) -> DataFrame:
    """<column>_z from the moments of df, or from given ones; their one row is joined."""
    m = moments_of(df, columns) if moments is None else moments
    z = [((F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")).alias(f"{c}_z") for c in columns]
    return df.crossJoin(m).select(*df.columns, *z)


def fit_scorer(df: DataFrame, columns: Sequence[str], label: str, ridge: float = 1e-3) -> dict:
    """Fit and report: the means, scales and weights of a logistic score, the threshold of best F1, and its confusion and AUROC."""
    m = moments_of(df, columns).first().asDict()
    moments = df.sparkSession.createDataFrame([tuple(m.values())], list(m))
    z = standardise(df, columns, moments)
    weights = fit_logistic(z, [f"{c}_z" for c in columns], label, ridge)
    fit = {"columns": list(columns), "weights": weights, "means": [m[f"{c}_m"] for c in columns], "scales": [m[f"{c}_s"] for c in columns]}
    scored = apply_scorer(df, fit).withColumn("_score", F.round("score", 12))
    best = thresholds(scored, "_score", label).orderBy(F.desc("f1"), F.desc("_score")).first()
    report = confusion(scored, "_score", label, best["_score"]).first().asDict()
    return fit | {"threshold": best["_score"], "auroc": auroc(scored, "_score", label).first()["auroc"]} | report


def apply_scorer(df: DataFrame, fit: dict) -> DataFrame:
    """df with score, and keep where the fit has a threshold."""
    s = df.withColumn("score", cell_score([F.col(c) for c in fit["columns"]], fit["weights"], fit["means"], fit["scales"]))
    return s.withColumn("keep", F.round("score", 12) >= fit["threshold"]) if "threshold" in fit else s


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, ridge: float = 1e-3, rounds: int = 25, tol: float = 1e-8) -> list[float]:
    """Bias and weights by Newton's method with an L2 penalty on the weights. Each round is one aggregate of (k + 1)^2 sums."""
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    k = len(x)
    beta = np.zeros(k)
    for _ in range(rounds):
        z = sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        sums = [F.avg(c * (F.col(label) - p)).alias(f"g{i}") for i, c in enumerate(x)]
        sums += [F.avg(x[i] * x[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = df.agg(*sums).first()
        penalty = np.diag([0.0] + [ridge] * (k - 1))
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty + 1e-9 * np.eye(k)
        step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(k)]) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    return beta.tolist()


def work_queue(df: DataFrame, mode: str) -> Sequence[Column]:
    """Ordering columns: per_recording, pooled (score falling) or uncertainty (|p - 0.5| rising)."""
    if mode == "per_recording":
        return [F.col("recording"), F.desc("score"), F.col("roi")]
    if mode == "pooled":
        return [F.desc("score"), F.col("recording"), F.col("roi")]
    return [F.abs(F.col("score") - 0.5), F.col("recording"), F.col("roi")]


def split(df: DataFrame, stratum: str, row: Column, share: float) -> DataFrame:
    """part: train or val; in each stratum the first ceil(share * n), at least one, by an arithmetic shuffle of row."""
    h = (row * 48271 + 11) % 65537
    w = Window.partitionBy(stratum)
    rank = F.row_number().over(w.orderBy(h, row))
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * share))
    return df.withColumn("part", F.when(rank <= n, "val").otherwise("train"))
