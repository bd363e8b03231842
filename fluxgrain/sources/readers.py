"""Readers of what the engine and its users keep in folders. All go through Spark's own readers, so any store that it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANTS = ("dff", "low", "dt")


def variants(spark: SparkSession, path: str, prefix: str = "", names: tuple[str, ...] = VARIANTS, keep: DataFrame | None = None) -> DataFrame:
    """Traces (recording, variant, roi, frame, value) of the variants prefix + name, without the prefix; with keep (recording, roi,
    keep) only of the kept regions. Folders by recording and variant are pruned."""
    t = spark.read.parquet(path).where(F.col("variant").isin([prefix + n for n in names]))
    t = t.withColumn("variant", F.substring("variant", len(prefix) + 1, 1 << 20))
    return t if keep is None else t.join(keep.where("keep").select("recording", "roi"), ["recording", "roi"], "left_semi")


def cluster_files(spark: SparkSession, path: str, without: str = "manual_combined", most_roi: int | None = None) -> DataFrame:
    """cluster, roi from files of one region a line, named <cluster>_rois.<ending>; files whose name holds `without` are left out,
    regions outside 0..most_roi too."""
    lines = spark.read.text(path, pathGlobFilter="*_rois.*").select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)_rois\.[^.]*$", 1).alias("cluster"), F.trim("value").alias("value"))
    rows = lines.where(~F.col("cluster").contains(without)).select("cluster", F.expr("try_cast(value AS bigint)").alias("roi")).where("roi >= 0")
    return rows if most_roi is None else rows.where(F.col("roi") <= most_roi)


def cluster_tables(spark: SparkSession, path: str, without: str = "manual_combined") -> DataFrame:
    """cluster, roi as sinks.write_clusters leaves them: a folder a cluster."""
    t = spark.read.schema("roi long, cluster string").option("header", True).csv(path)
    return t.where(~F.col("cluster").contains(without)).select("cluster", "roi")


def pair_summaries(spark: SparkSession, path: str) -> DataFrame:
    """pair, roi_a, roi_b, best_lag_sec from the first *_summary.csv of each sub-folder, which names the pair; rows without a lag go."""
    t = spark.read.option("header", True).csv(f"{path}/*/*_summary.csv", enforceSchema=False)
    t = t.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("pair"), F.col("_metadata.file_path").alias("file"))
    first = t.groupBy("pair").agg(F.min("file").alias("file"))
    t = t.join(first, ["pair", "file"], "left_semi")
    number = lambda c, kind: F.expr(f"try_cast(`{c}` AS {kind})")
    rows = t.select("pair", number("roiA", "bigint").alias("roi_a"), number("roiB", "bigint").alias("roi_b"), number("best_lag_sec", "double").alias("best_lag_sec"))
    return rows.where("best_lag_sec is not null and not isnan(best_lag_sec)").dropna()


def pair_tables(spark: SparkSession, path: str) -> DataFrame:
    """The same from folders written by partitionBy("pair")."""
    t = spark.read.schema("roiA long, roiB long, best_lag_sec double, pair string").option("header", True).csv(path)
    return t.select("pair", F.col("roiA").alias("roi_a"), F.col("roiB").alias("roi_b"), "best_lag_sec").where("best_lag_sec is not null and not isnan(best_lag_sec)")


def pair_lags(spark: SparkSession, path: str) -> DataFrame:
    """The same from folders written by sinks.write_pair_lags."""
    t = spark.read.schema("roiA array<long>, roiB array<long>, best_lag_sec array<double>, pair string").parquet(path)
    t = t.select("pair", "roiA", "roiB", F.posexplode("best_lag_sec").alias("at", "best_lag_sec")).where("best_lag_sec is not null and not isnan(best_lag_sec)")
    across = F.size("roiB")
    return t.select("pair", F.get("roiA", F.floor(F.col("at") / across).cast("int")).alias("roi_a"), F.get("roiB", F.col("at") % across).alias("roi_b"), "best_lag_sec")


def natural_order(df: DataFrame, column: str) -> DataFrame:
    """df ordered by the numbers in column, then its text: C2xC10 before C10xC2."""
    return df.orderBy(F.transform(F.regexp_extract_all(column, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long")), column)


def sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One sheet of a workbook folder; columns that only other sheets have are left out."""
    t = spark.read.option("mergeSchema", True).parquet(path).where(F.col("sheet") == name).drop("sheet")
    used = t.agg(*(F.count(c).alias(c) for c in t.columns)).first()
    return t.select(*(c for c in t.columns if used[c])) if used else t


def event_windows(spark: SparkSession, path: str, name: str = "EventWindows") -> DataFrame:
    """event, start_s, end_s of a workbook's event sheet; swapped bounds are put right, rows without bounds go."""
    t = sheet(spark, path, name).where("start_s is not null and end_s is not null")
    return t.select("event", F.least("start_s", "end_s").alias("start_s"), F.greatest("start_s", "end_s").alias("end_s"))


def discover(spark: SparkSession, root: str, marker: str = "part-*.parquet", depth: int = 2) -> DataFrame:
    """recording, path: folders anywhere below root that hold the marker file, named by the folder `depth` levels above it (1: the
    marker's own); of several with one name the first path. Files are listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", marker).load(root).select("path")
    parts = F.split("path", "/")
    found = files.select(F.element_at(parts, -1 - depth).alias("recording"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("path"))
    return found.groupBy("recording").agg(F.min("path").alias("path"))
