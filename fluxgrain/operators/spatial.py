"""Geometry of regions: painting, overlap, neighbours, propagation, images as (y, x, v) tables.

Tables of several recordings have the column recording; regions and pixels of different recordings then never meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrain.functions.columns import keys
from fluxgrain.session import shared_folder


def of(*tables: DataFrame) -> list[str]:
    """recording, where all tables have it."""
    return ["recording"] if all("recording" in t.columns for t in tables) else []


# fixed values: the field of view in micrometres at zoom 1
FOV_X_UM, FOV_Y_UM = 3080.90169, 3560.14057


def um_per_pixel(zoom: Column, lx: Column, ly: Column) -> tuple[Column, Column]:
    return FOV_X_UM / zoom / lx, FOV_Y_UM / zoom / ly


def centroids(pixels: DataFrame, how: str = "median") -> DataFrame:
    f = F.median if how == "median" else F.avg
    return pixels.groupBy(*keys(pixels)).agg(f("x").alias("cx"), f("y").alias("cy"))


def inside_edge(pixels: DataFrame, ly: int, lx: int, buffer: int = 6, by_box: bool = False) -> DataFrame:
    """roi, keep: the mean pixel (or the whole box) lies strictly inside the buffer."""
    if by_box:
        g = pixels.groupBy(*keys(pixels)).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    else:
        g = pixels.groupBy(*keys(pixels)).agg(F.avg("x").alias("x0"), F.avg("x").alias("x1"), F.avg("y").alias("y0"), F.avg("y").alias("y1"))
    keep = (F.col("x0") > buffer) & (F.col("x1") < lx - buffer) & (F.col("y0") > buffer) & (F.col("y1") < ly - buffer)
    return g.select(*keys(pixels), keep.alias("keep"))


def paint(values: DataFrame, pixels: DataFrame) -> DataFrame:
    """y, x, v: mean of the values of the regions that cover a pixel, weighted by lam; repeated pixels of a region count once."""
    key = keys(pixels)
    once = pixels.groupBy(*key, "y", "x").agg(F.max("lam").alias("lam"))
    return values.join(once, [*of(values, pixels), "roi"]).groupBy(*of(pixels), "y", "x").agg((F.sum(F.col("v") * F.col("lam")) / F.sum("lam")).alias("v"))


def label_image(pixels: DataFrame) -> DataFrame:
    """y, x, label: the last region that covers a pixel."""
    return pixels.groupBy(*of(pixels), "y", "x").agg(F.max("roi").alias("label"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """recording (if there), roi_a, roi_b, both, iou of the pairs that share pixels: an equi-join on pixels."""
    rec = of(a, b)
    n = lambda d, s: d.groupBy(*rec, "roi").agg(F.count_distinct("y", "x").alias(f"n_{s}")).withColumnRenamed("roi", f"roi_{s}")
    x = a.select(*rec, F.col("roi").alias("roi_a"), "y", "x").distinct()
    y = b.select(*rec, F.col("roi").alias("roi_b"), "y", "x").distinct()
    both = x.join(y, [*rec, "y", "x"]).groupBy(*rec, "roi_a", "roi_b").agg(F.count("*").alias("both"))
    both = both.join(n(a, "a"), [*rec, "roi_a"]).join(n(b, "b"), [*rec, "roi_b"])
    return both.select(*rec, "roi_a", "roi_b", "both", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("iou"))


def covered(secondary: DataFrame, primary: DataFrame) -> DataFrame:
    """recording (if there), roi, share: the part of each secondary region's pixels that any primary one covers."""
    rec = of(secondary, primary)
    p = primary.select(*rec, "y", "x").distinct().withColumn("hit", F.lit(1))
    return secondary.join(p, [*rec, "y", "x"], "left").groupBy(*keys(secondary)).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))


def in_bounds(pixels: DataFrame, ly: int, lx: int) -> DataFrame:
    """The pixels inside an image of ly x lx; regions that lose all of theirs go."""
    return pixels.where((F.col("y") >= 0) & (F.col("y") < ly) & (F.col("x") >= 0) & (F.col("x") < lx))


def merge_by_iou(found: DataFrame, order: DataFrame, limit: float = 0.3, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """roi of the regions accepted in the given order (roi, rank; ranks differ) unless one accepted before overlaps by `limit` or
    more. found: roi_a, roi_b, iou.

    Greedy acceptance in rounds: a region all of whose earlier overlapping ones are decided is decided itself. The rounds are as many
    as the longest chain of regions that wait for one another, not as many as regions; all state is in tables, which `keep` writes and
    reads again (saved in the session's shared folder by default), and only emptiness comes to the driver."""
    keep = keep or saved
    o = order.select("roi", "rank")
    both = found.where(F.col("iou") >= limit).where("roi_a <> roi_b")
    both = both.select("roi_a", "roi_b").union(both.select(F.col("roi_b").alias("roi_a"), F.col("roi_a").alias("roi_b"))).distinct()
    a, b = (o.select(F.col("roi").alias(f"roi_{s}"), F.col("rank").alias(f"rank_{s}")) for s in "ab")
    waits = keep(both.join(a, "roi_a").join(b, "roi_b").where("rank_b < rank_a").select(F.col("roi_a").alias("roi"), F.col("roi_b").alias("earlier")))
    open_ = keep(o.select("roi"))
    taken = open_.limit(0)
    while not open_.isEmpty():
        ready = keep(open_.join(waits.select("roi").distinct(), "roi", "left_anti"))  # nothing earlier is undecided or accepted
        taken = keep(taken.union(ready))
        beaten = waits.join(ready.select(F.col("roi").alias("earlier")), "earlier", "left_semi").select("roi").distinct()
        gone = keep(ready.union(beaten))
        open_ = keep(open_.join(gone, "roi", "left_anti"))
        waits = keep(waits.join(gone, "roi", "left_anti").join(beaten.select(F.col("roi").alias("earlier")), "earlier", "left_anti").select("roi", "earlier"))
    return taken


def saved(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "merge")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def neighbours(points: DataFrame, k: int, cell: float, reach: int = 1) -> DataFrame:
    """recording (if there), roi, other, dist, rn: the k nearest others within `reach` grid cells of size `cell`: an equi-join on cells."""
    rec = of(points)
    p = points.withColumn("gx", F.floor(F.col("cx") / cell)).withColumn("gy", F.floor(F.col("cy") / cell))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = p.select(*rec, "roi", "cx", "cy", "gx", "gy", F.explode(steps).alias("i")).withColumn("j", F.explode(steps))
    near = near.select(*rec, "roi", "cx", "cy", (F.col("gx") + F.col("i")).alias("gx"), (F.col("gy") + F.col("j")).alias("gy"))
    q = p.select(*rec, F.col("roi").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), "gx", "gy")
    d = near.join(q, [*rec, "gx", "gy"]).where("roi <> other").withColumn("dist", F.sqrt((F.col("cx") - F.col("ox")) * (F.col("cx") - F.col("ox")) + (F.col("cy") - F.col("oy")) * (F.col("cy") - F.col("oy"))))
    rn = F.row_number().over(Window.partitionBy(*rec, "roi").orderBy("dist", "other"))
    return d.withColumn("rn", rn).where(F.col("rn") <= k).select(*rec, "roi", "other", "dist", "rn")


def propagation(active: DataFrame, points: DataFrame, tolerance: float) -> DataFrame:
    """Per event: mean place of the first and of the last regions (first_t within tolerance of the extremes), path, speed, angle."""
    rec = of(active, points)
    w = Window.partitionBy(*of(active), "event")
    a = active.join(points, [*rec, "roi"]).withColumn("t0", F.min("first_t").over(w)).withColumn("t1", F.max("first_t").over(w))
    first, last = F.col("first_t") - F.col("t0") <= tolerance, F.col("t1") - F.col("first_t") <= tolerance
    g = a.groupBy(*of(active), "event").agg(
        F.avg(F.when(first, F.col("cx"))).alias("x0"), F.avg(F.when(first, F.col("cy"))).alias("y0"), F.avg(F.when(last, F.col("cx"))).alias("x1"), F.avg(F.when(last, F.col("cy"))).alias("y1"),
        F.any_value(F.col("t1") - F.col("t0")).alias("dt"), F.count_if(first).alias("n_first"), F.count_if(last).alias("n_last"),
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    g = g.withColumn("distance", F.hypot(dx, dy))
    speed = F.when(F.col("dt") > 0, F.col("distance") / F.col("dt")).otherwise(0.0)
    angle = F.when(F.col("distance") > 0, F.degrees(F.atan2(dy, dx))).otherwise(0.0)
    return g.withColumn("speed", speed).withColumn("angle", angle)


def pull_vectors(values: DataFrame, graph: DataFrame, points: DataFrame) -> DataFrame:
    """roi, vx, vy: mean of the unit vectors to neighbours that rise more, weighted by how much more. values: roi, v in 0..1."""
    rec = of(values, graph, points)
    v = values.select(*rec, "roi", "v").join(points, [*rec, "roi"])
    o = v.select(*rec, F.col("roi").alias("other"), F.col("v").alias("w"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    e = graph.select(*rec, "roi", "other").join(v, [*rec, "roi"]).join(o, [*rec, "other"])
    up, d = F.greatest(F.col("w") - F.col("v"), F.lit(0.0)), F.hypot(F.col("ox") - F.col("cx"), F.col("oy") - F.col("cy")) + 1e-6
    pull = lambda a, b: (F.sum(up * (F.col(a) - F.col(b)) / d) / (F.sum(up) + 1e-9)).alias(f"v{b[-1]}")
    return e.groupBy(*rec, "roi").agg(pull("ox", "cx"), pull("oy", "cy"))


def smoothed_vectors(vectors: DataFrame, graph: DataFrame, rounds: int = 1, own: float = 0.5) -> DataFrame:
    """vx, vy of each region after `rounds` passes, each a blend of its own vector and the mean of its neighbours' (its own without any)."""
    rec = of(vectors, graph)
    for _ in range(rounds):
        o = vectors.select(*rec, F.col("roi").alias("other"), F.col("vx").alias("ox"), F.col("vy").alias("oy"))
        mean = graph.select(*rec, "roi", "other").join(o, [*rec, "other"]).groupBy(*rec, "roi").agg(F.avg("ox").alias("mx"), F.avg("oy").alias("my"))
        v = vectors.join(mean, [*rec, "roi"], "left")
        blend = lambda a, m: (own * F.col(a) + (1 - own) * F.coalesce(F.col(m), F.col(a))).alias(a)
        vectors = v.select(*rec, "roi", blend("vx", "mx"), blend("vy", "my"))
    return vectors


def dilated(mask: DataFrame, steps: int) -> DataFrame:
    """y, x of a mask grown by 4-neighbours, `steps` times."""
    reach = F.explode(F.expr(f"filter(flatten(transform(sequence(-{steps}, {steps}), i -> transform(sequence(-{steps}, {steps}), j -> struct(i, j)))), p -> abs(p.i) + abs(p.j) <= {steps})"))
    return mask.select("y", "x", reach.alias("p")).select((F.col("y") + F.col("p.i")).alias("y"), (F.col("x") + F.col("p.j")).alias("x")).distinct()


def residual(image: DataFrame, mask: DataFrame) -> DataFrame:
    """The image with the median of the rest in the place of masked pixels."""
    m = image.join(mask.withColumn("hit", F.lit(True)), ["y", "x"], "left")
    base = F.broadcast(m.where("hit is null").agg(F.median("v").alias("base")))
    return m.crossJoin(base).select("y", "x", F.when(F.col("hit"), F.col("base")).otherwise(F.col("v")).alias("v"))


def discs(centres: DataFrame, most: int) -> DataFrame:
    """roi, y, x, lam: pixels within radius r of each centre (y0, x0, r), Gaussian weights of sigma r / 2 that sum to 1."""
    box = F.explode(F.expr(f"flatten(transform(sequence(-{most}, {most}), i -> transform(sequence(-{most}, {most}), j -> struct(i, j))))"))
    p = centres.select("roi", "y0", "x0", "r", box.alias("p")).withColumn("d2", F.col("p.i") * F.col("p.i") + F.col("p.j") * F.col("p.j")).where("d2 <= r * r")
    w = F.exp(-F.col("d2") / (2 * (F.col("r") / 2) * (F.col("r") / 2)))
    p = p.withColumn("w", w)
    return p.select("roi", (F.col("y0") + F.col("p.i")).alias("y"), (F.col("x0") + F.col("p.j")).alias("x"), (F.col("w") / F.sum("w").over(Window.partitionBy("roi"))).alias("lam"))


def shift_movie(movie: DataFrame) -> DataFrame:
    """The movie moved up so that no pixel of a recording is negative; fails above 65535."""
    lift = movie.groupBy("recording").agg(F.greatest(F.lit(0), -F.min("v")).alias("lift"))
    v = F.col("v") + F.col("lift")
    return movie.join(lift, "recording").withColumn("v", F.when(v > 65535, F.raise_error(F.lit("a pixel exceeds 65535")).cast("long")).otherwise(v)).select(*movie.columns)
