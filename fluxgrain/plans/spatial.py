"""Queries over regions' pixels and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrain.operators import spatial as S
from fluxgrain.plans.events import EVENTS, activation
from fluxgrain.plans.registry import query, r6
from fluxgrain.sources.standins import read, roi_pixel, trace, with_

CENTRES = ", cen AS (SELECT roi, median(x) AS cx, median(y) AS cy FROM roi_pixel GROUP BY roi)"


@query("SELECT vec_id AS roi, round(3080.90169 / (1 + label) / 512, 6) AS ux, round(3560.14057 / (1 + label) / 592, 6) AS uy FROM embeddings")
def q_px_to_um(spark: SparkSession, sf_dir: str) -> DataFrame:
    ux, uy = S.um_per_pixel(1 + F.col("label"), F.lit(512), F.lit(592))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("roi"), r6(ux).alias("ux"), r6(uy).alias("uy"))


@query(with_("roi_pixel") + ", g AS (SELECT roi, avg(x) AS mx, avg(y) AS my, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM roi_pixel GROUP BY roi) SELECT roi, mx > 6 AND mx < 50 AND my > 6 AND my < 58 AS by_centre, x0 > 6 AND x1 < 50 AND y0 > 6 AND y1 < 58 AS by_box FROM g")
def q_edge_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roi_pixel(spark, sf_dir)
    a = S.inside_edge(p, 64, 56).withColumnRenamed("keep", "by_centre")
    return a.join(S.inside_edge(p, 64, 56, by_box=True).withColumnRenamed("keep", "by_box"), "roi")


@query(with_("trace", "roi_pixel") + ", val AS (SELECT roi, avg(f) AS v FROM trace GROUP BY roi) SELECT y, x, round(sum(v * lam) / sum(lam), 6) + 0.0 AS v FROM val JOIN roi_pixel USING (roi) GROUP BY y, x")
def q_paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = trace(spark, sf_dir).groupBy("roi").agg(F.avg("f").alias("v"))
    return S.paint(v, roi_pixel(spark, sf_dir)).select("y", "x", r6("v").alias("v"))


@query(with_("roi_pixel") + " SELECT y, x, max(roi) AS label FROM roi_pixel GROUP BY y, x")
def q_label_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.label_image(roi_pixel(spark, sf_dir))


@query(with_("roi_pixel") + ", o AS (SELECT a.roi AS roi_a, b.roi AS roi_b, count(*) AS n FROM roi_pixel a JOIN roi_pixel b ON a.y = b.y AND a.x = b.x AND a.roi < b.roi GROUP BY ALL) SELECT roi_a, roi_b, n AS \"both\", round(n / (18 - n), 6) AS iou FROM o")
def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = roi_pixel(spark, sf_dir)
    return S.overlaps(p, p).where("roi_a < roi_b").select("roi_a", "roi_b", "both", r6("iou").alias("iou"))


@query(with_("roi_pixel") + ", p AS (SELECT DISTINCT y, x FROM roi_pixel WHERE roi % 2 = 0) SELECT roi, round(avg((p.y IS NOT NULL)::INT), 6) AS share, avg((p.y IS NOT NULL)::INT) < 0.3 AS keep FROM roi_pixel r LEFT JOIN p ON p.y = r.y AND p.x = r.x WHERE roi % 2 <> 0 GROUP BY roi")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of odd id covered by those of even id: a stand-in for two selections that hold all regions."""
    p = roi_pixel(spark, sf_dir)
    c = S.covered(p.where("roi % 2 <> 0"), p.where("roi % 2 = 0"))
    return c.select("roi", r6("share").alias("share"), (F.col("share") < 0.3).alias("keep"))


@query(with_("roi_pixel") + " SELECT roi, count(*) AS n FROM (SELECT roi, y - 3 AS y, x - 5 AS x FROM roi_pixel) WHERE y >= 0 AND y < 40 AND x >= 0 AND x < 30 GROUP BY roi")
def q_in_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of moved regions that lie inside a smaller image."""
    moved = roi_pixel(spark, sf_dir).withColumn("y", F.col("y") - 3).withColumn("x", F.col("x") - 5)
    return S.in_bounds(moved, 40, 30).groupBy("roi").agg(F.count("*").alias("n"))


@query(with_("roi_pixel") + CENTRES + ", d AS (SELECT a.roi, b.roi AS other, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS dist FROM cen a JOIN cen b ON a.roi <> b.roi AND abs(floor(a.cx / 12) - floor(b.cx / 12)) <= 1 AND abs(floor(a.cy / 12) - floor(b.cy / 12)) <= 1), r AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY dist, other) AS rn FROM d) SELECT roi, other, round(dist, 6) AS dist, rn FROM r WHERE rn <= 5")
def q_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = S.neighbours(S.centroids(roi_pixel(spark, sf_dir)), 5, 12.0)
    return near.select("roi", "other", r6("dist").alias("dist"), F.col("rn").cast("long").alias("rn"))


@query(
    with_("onset", "roi_pixel")
    + EVENTS
    + CENTRES
    + """, a AS (SELECT act.*, cx, cy, min(first_t) OVER (PARTITION BY event) AS t0, max(first_t) OVER (PARTITION BY event) AS t1 FROM act JOIN cen USING (roi)),
 g AS (SELECT event, avg(cx) FILTER (first_t - t0 <= 600) AS x0, avg(cy) FILTER (first_t - t0 <= 600) AS y0, avg(cx) FILTER (t1 - first_t <= 600) AS x1, avg(cy) FILTER (t1 - first_t <= 600) AS y1, any_value(t1 - t0) AS dt FROM a GROUP BY event),
 h AS (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS dist FROM g)
 SELECT event, round(dist, 6) AS distance, round(CASE WHEN dt > 0 THEN dist / dt ELSE 0 END, 6) AS speed, round(CASE WHEN dist > 0 THEN degrees(atan2(y1 - y0, x1 - x0)) ELSE 0 END, 6) + 0.0 AS angle FROM h"""
)
def q_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.propagation(activation(spark, sf_dir), S.centroids(roi_pixel(spark, sf_dir)), 600.0)
    return p.select("event", *(r6(c).alias(c) for c in ("distance", "speed", "angle")))


@query(with_("onset") + EVENTS + ", l AS (SELECT roi, first_t - min(first_t) OVER (PARTITION BY event) AS lag FROM act), m AS (SELECT roi, median(lag) AS s FROM l GROUP BY roi), q AS (SELECT quantile_cont(s, 0.25) AS c FROM m) SELECT roi, round(s, 3) AS s, s <= c AS leads FROM m, q")
def q_leadlag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fluxgrain.operators.events import rank_order

    m = rank_order(activation(spark, sf_dir)).groupBy("roi").agg(F.median("lag").alias("s"))
    c = F.broadcast(m.agg(F.percentile("s", 0.25).alias("c")))
    return m.crossJoin(c).select("roi", F.round("s", 3).alias("s"), (F.col("s") <= F.col("c")).alias("leads"))


PULL = (
    with_("trace", "roi_pixel")
    + CENTRES
    + """, v AS (SELECT roi, avg(f) FILTER (frame >= 32) - avg(f) FILTER (frame < 32) AS v FROM trace GROUP BY roi), q AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM v),
 n AS (SELECT roi, least(greatest((v - lo) / (hi - lo), 0), 1) AS v FROM v, q), d AS (SELECT a.roi, b.roi AS other, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS dist FROM cen a JOIN cen b ON a.roi <> b.roi AND abs(floor(a.cx / 12) - floor(b.cx / 12)) <= 1 AND abs(floor(a.cy / 12) - floor(b.cy / 12)) <= 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY roi ORDER BY dist, other) AS rn FROM d), e AS (SELECT r.roi, greatest(w.v - n.v, 0) AS up, o.cx - c.cx AS dx, o.cy - c.cy AS dy, dist + 1e-6 AS dist FROM r JOIN n ON n.roi = r.roi JOIN n w ON w.roi = r.other JOIN cen c ON c.roi = r.roi JOIN cen o ON o.roi = r.other WHERE rn <= 5),
 u AS (SELECT roi, sum(up * dx / dist) / (sum(up) + 1e-9) AS vx, sum(up * dy / dist) / (sum(up) + 1e-9) AS vy FROM e GROUP BY roi)"""
)


def pulls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pull vectors of the regions, and the neighbours that they come from."""
    half = trace(spark, sf_dir).groupBy("roi").agg((F.avg(F.expr("if(frame >= 32, f, null)")) - F.avg(F.expr("if(frame < 32, f, null)"))).alias("d"))
    ends = half.agg(F.percentile("d", 0.05).alias("lo"), F.percentile("d", 0.95).alias("hi"))
    v = half.crossJoin(ends).select("roi", F.least(F.greatest((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)).alias("v"))
    points = S.centroids(roi_pixel(spark, sf_dir))
    near = S.neighbours(points, 5, 12.0)
    return S.pull_vectors(v, near, points), near


@query(PULL + " SELECT roi, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy FROM u")
def q_pull_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulls(spark, sf_dir)[0].select("roi", r6("vx").alias("vx"), r6("vy").alias("vy"))


@query(PULL + ", m AS (SELECT r.roi, avg(u.vx) AS mx, avg(u.vy) AS my FROM r JOIN u ON u.roi = r.other WHERE rn <= 5 GROUP BY r.roi) SELECT u.roi, round((vx + coalesce(mx, vx)) / 2, 6) + 0.0 AS vx, round((vy + coalesce(my, vy)) / 2, 6) + 0.0 AS vy FROM u LEFT JOIN m USING (roi)")
def q_smoothed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, near = pulls(spark, sf_dir)
    return S.smoothed_vectors(vectors, near).select("roi", r6("vx").alias("vx"), r6("vy").alias("vy"))


MOVIE = "movie AS (SELECT label AS recording, vec_id AS frame, CAST(unnest(range(64)) AS BIGINT) // 8 AS y, CAST(unnest(range(64)) AS BIGINT) % 8 AS x, CAST(floor(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings)"


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in movie: each vector an 8 x 8 frame of its label's recording."""
    t = trace(spark, sf_dir)
    return t.select("recording", F.col("roi").alias("frame"), F.floor(F.col("frame") / 8).alias("y"), (F.col("frame") % 8).alias("x"), F.floor(F.col("f") * 1000).alias("v"))


@query(f"WITH {MOVIE}, s AS (SELECT *, v + greatest(0, -min(v) OVER (PARTITION BY recording)) AS u FROM movie) SELECT recording, min(u) AS lowest, max(u) AS highest, CAST(sum(u) AS BIGINT) AS total FROM s GROUP BY recording")
def q_movie_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shift_movie(movie(spark, sf_dir)).groupBy("recording").agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.sum("v").alias("total"))


@query(f"WITH {MOVIE} SELECT recording, y, x, round(avg(v), 6) + 0.0 AS mean, max(v) AS highest FROM movie GROUP BY ALL")
def q_mean_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movie(spark, sf_dir).groupBy("recording", "y", "x").agg(r6(F.avg("v")).alias("mean"), F.max("v").alias("highest"))


GRID = ", g AS (SELECT CAST(a AS BIGINT) AS y, CAST(b AS BIGINT) AS x, CAST((a * 13 + b * 29) % 101 AS DOUBLE) AS v FROM (SELECT unnest(range(70)) AS a), (SELECT unnest(range(60)) AS b))"


def grid(spark: SparkSession) -> DataFrame:
    g = spark.range(4200).select(F.floor(F.col("id") / 60).alias("y"), (F.col("id") % 60).alias("x"))
    return g.withColumn("v", ((F.col("y") * 13 + F.col("x") * 29) % 101).cast("double"))


DILATED = ", di AS (SELECT DISTINCT r.y + a AS y, r.x + b AS x FROM roi_pixel r, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b) WHERE abs(a) + abs(b) <= 2)"


@query(with_("roi_pixel") + GRID + DILATED + ", base AS (SELECT median(v) AS m FROM g ANTI JOIN di USING (y, x)) SELECT g.y, g.x, CASE WHEN di.y IS NULL THEN v ELSE m END AS v FROM g CROSS JOIN base LEFT JOIN di ON di.y = g.y AND di.x = g.x")
def q_residual_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image without its regions, their surroundings included."""
    return S.residual(grid(spark), S.dilated(roi_pixel(spark, sf_dir).select("y", "x"), 2))


@query(with_("roi_pixel") + GRID + " SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.99), 6) AS p99, round(sum(v * v), 3) AS energy FROM g")
def q_residual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark).agg(r6(F.avg("v")).alias("mean"), r6(F.percentile("v", 0.99)).alias("p99"), F.round(F.sum(F.col("v") * F.col("v")), 3).alias("energy"))


@query("WITH c AS (SELECT vec_id AS roi, vec_id * 7 % 61 AS y0, vec_id * 11 % 53 AS x0, label % 3 + 1 AS r FROM embeddings), p AS (SELECT roi, y0 + i AS y, x0 + j AS x, exp(-(i * i + j * j) / (2 * (r / 2) ** 2)) AS w FROM c, (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j) WHERE i * i + j * j <= r * r) SELECT roi, y, x, round(w / sum(w) OVER (PARTITION BY roi), 6) AS lam FROM p")
def q_blob_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    c = e.select(F.col("vec_id").alias("roi"), (F.col("vec_id") * 7 % 61).alias("y0"), (F.col("vec_id") * 11 % 53).alias("x0"), (F.col("label") % 3 + 1).alias("r"))
    return S.discs(c, 3).select("roi", "y", "x", r6("lam").alias("lam"))


@query(with_("roi_pixel") + ", l AS (SELECT y, x, max(roi) AS label FROM roi_pixel GROUP BY y, x) SELECT label, count(*) AS npix, round(sqrt(count(*) / pi()), 6) AS radius, median(y) AS my, median(x) AS mx FROM l GROUP BY label")
def q_mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = S.label_image(roi_pixel(spark, sf_dir)).groupBy("label")
    return g.agg(F.count("*").alias("npix"), r6(F.sqrt(F.count("*") / F.pi())).alias("radius"), F.median("y").alias("my"), F.median("x").alias("mx"))


@query("SELECT CAST(i // 60 AS BIGINT) AS y, CAST(i % 60 AS BIGINT) AS x, CASE WHEN i // 60 BETWEEN 5 AND 64 AND i % 60 BETWEEN 7 AND 50 THEN CAST((i // 60 * 13 + i % 60 * 29) % 101 AS DOUBLE) ELSE 0 END AS v FROM range(4200) t(i)")
def q_image_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark)
    cropped = g.where("y between 5 and 64 and x between 7 and 50").select((F.col("y") - 5).alias("cy"), (F.col("x") - 7).alias("cx"), "v")
    placed = cropped.select((F.col("cy") + 5).alias("y"), (F.col("cx") + 7).alias("x"), "v")
    return g.select("y", "x").join(placed, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


@query(with_("roi_pixel") + GRID + ", c AS (SELECT roi, CAST(round_even(avg(y), 0) AS BIGINT) AS cy, CAST(round_even(avg(x), 0) AS BIGINT) AS cx FROM roi_pixel GROUP BY roi), p AS (SELECT roi, i, j, coalesce(g.v, 0) AS v FROM c CROSS JOIN (SELECT unnest(range(-4, 4)) AS i) CROSS JOIN (SELECT unnest(range(-4, 4)) AS j) LEFT JOIN g ON g.y = cy + i AND g.x = cx + j) SELECT roi, count(*) AS n, round(sum(v), 6) AS total FROM p GROUP BY roi")
def q_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches(spark, roi_pixel(spark, sf_dir))


def patches(spark: SparkSession, pixels: DataFrame) -> DataFrame:
    c = pixels.groupBy("roi").agg(F.bround(F.avg("y"), 0).cast("long").alias("cy"), F.bround(F.avg("x"), 0).cast("long").alias("cx"))
    o = F.explode(F.expr("flatten(transform(sequence(-4, 3), i -> transform(sequence(-4, 3), j -> struct(i, j))))"))
    p = c.select("roi", "cy", "cx", o.alias("p")).select("roi", (F.col("cy") + F.col("p.i")).alias("y"), (F.col("cx") + F.col("p.j")).alias("x"))
    return p.join(grid(spark), ["y", "x"], "left").groupBy("roi").agg(F.count("*").alias("n"), r6(F.sum(F.coalesce("v", F.lit(0.0)))).alias("total"))


@query("WITH RECURSIVE " + with_("roi_pixel")[5:] + ", o AS (SELECT a.roi AS a, b.roi AS b FROM roi_pixel a JOIN roi_pixel b ON a.y = b.y AND a.x = b.x AND a.roi > b.roi GROUP BY ALL HAVING count(*) / (18 - count(*)) >= 0.3), n AS (SELECT roi, row_number() OVER (ORDER BY roi) AS i, coalesce(list(o.b) FILTER (o.b IS NOT NULL), []) AS earlier FROM (SELECT DISTINCT roi FROM roi_pixel) r LEFT JOIN o ON o.a = r.roi GROUP BY roi), k AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT n.i, CASE WHEN list_has_any(k.kept, n.earlier) THEN k.kept ELSE list_append(k.kept, n.roi) END FROM k JOIN n ON n.i = k.i + 1) SELECT unnest(kept) AS roi FROM k WHERE i = (SELECT max(i) FROM n)")
def q_merge_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent acceptance by overlap, in the order of the ids."""
    p = roi_pixel(spark, sf_dir)
    return S.merge_by_iou(S.overlaps(p, p), p.select("roi").distinct().withColumn("rank", F.col("roi")))
