"""Writers: partitioned tables, one table a sheet, wide files, logs and ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from fluxgrain.operators import blocks as B

#: First and second regions of a row of write_pair_lags, which readers hold by the thousand.
PART = 32, 64
#: Columns that wide() leaves to a pivot, and values that it holds otherwise.
FEW, CELLS = 256, 1 << 21


def write_traces(df: DataFrame, path: str) -> None:
    """Traces by recording and variant, sorted by roi and frame, so that scans prune both."""
    df.repartition("recording", "variant").sortWithinPartitions("recording", "variant", "roi", "frame").write.mode("overwrite").partitionBy("recording", "variant").parquet(path)


def wide(df: DataFrame, row: str, column: str, value: str, names: Sequence[int], prefix: str = "roi_", few: int = FEW) -> DataFrame:
    """One row a frame, one column a region; the columns are given, so their number is known and no pass looks for them.

    A pivot plans several expressions a column on the driver. So more than a few columns are put together where the rows are: they
    come sorted by frame, and a worker holds about `CELLS` values whatever the number of either."""
    names = list(names)
    if len(names) <= few:
        w = df.groupBy(row).pivot(column, names).agg(F.first(value))
        return w.select(row, *(F.col(str(n)).alias(f"{prefix}{n}") for n in names))
    key, kind = df.schema[row], df.schema[value].dataType
    schema = StructType([key, *(StructField(f"{prefix}{n}", kind) for n in names)])
    of_key, of_value, at_once = to_arrow_type(key.dataType), to_arrow_type(kind), max(1, CELLS // len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, header = pd.Index(names), [f.name for f in schema]

        def flush(held: list[tuple]) -> pa.RecordBatch:
            flat, gone = np.zeros((len(names), len(held)), of_value.to_pandas_dtype()), np.ones((len(names), len(held)), bool)
            for k, (_, parts) in enumerate(held):
                for at, x, missing in reversed(parts):  # of several values the first one stays
                    flat[at, k], gone[at, k] = x, missing
            values = pa.array(flat.ravel(), of_value, mask=gone.ravel())
            return pa.RecordBatch.from_arrays([pa.array([name for name, _ in held], of_key), *(values.slice(i * len(held), len(held)) for i in range(len(names)))], names=header)

        held: list[tuple] = []
        for batch in batches:
            if not len(batch):
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), len(batch)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(i, j - i)
                name, at = part.column(0)[0].as_py(), place.get_indexer(part.column(1).to_pandas())
                missing = part.column(2).is_null().to_numpy(zero_copy_only=False)
                x = part.column(2).fill_null(of_value.to_pandas_dtype()(0)) if missing.any() and not pa.types.is_string(of_value) else part.column(2)
                known = (at >= 0).nonzero()[0][::-1]
                if not held or held[-1][0] != name:
                    if len(held) == at_once:
                        yield flush(held)
                        held = []
                    held.append((name, []))
                held[-1][1].append((at[known], x.to_numpy(zero_copy_only=False)[known], missing[known]))
        if held:
            yield flush(held)

    dealt = df.select(row, column, value).repartition(row).sortWithinPartitions(row)
    return dealt.mapInArrow(run, schema)


def write_wide_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, compression="gzip")


def upsert_sheet(df: DataFrame, path: str, sheet: str) -> None:
    """Replaces one sheet of a workbook folder and leaves the others."""
    df.withColumn("sheet", F.lit(sheet)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sheet").parquet(path)


def key_values(df: DataFrame) -> DataFrame:
    """key, value of each column of each row."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns)))
    return df.select(pairs.alias("kv")).select("kv.key", "kv.value")


def write_clusters(df: DataFrame, path: str) -> None:
    """One folder a cluster; stale ones go."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("cluster").csv(path, header=True)


def append_label(df: DataFrame, path: str) -> None:
    """Adds labels to the log. Undoing one is a further row with a null label."""
    df.write.mode("append").parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def leaderboard(ledger: DataFrame, most: int) -> DataFrame:
    """The configurations with the least mean residual, ranked."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy("residual_mean", "sig"))
    return ledger.orderBy("residual_mean", "sig").limit(most).withColumn("rank", rank)


def coactivation_rows(ranked: DataFrame, windows: DataFrame, filtered: DataFrame) -> DataFrame:
    """The co-activation summary: a row for each active region of an event. ranked: event, roi, first_t, rank, lag; windows: event,
    start_s, end_s; filtered: roi, filtered (its position among the kept regions). order_rank is 1 for the first, 1 / k for the last."""
    from pyspark.sql import Window

    k = F.count("*").over(Window.partitionBy("event"))
    rows = ranked.withColumn("order_rank", (k - F.col("rank") + 1) / k).join(windows, "event").join(filtered, "roi")
    return rows.select(F.col("filtered").alias("roi_index_filtered"), F.col("roi").alias("roi_index_original"), F.col("event").alias("event_index"), F.col("start_s").alias("event_start_s"), F.col("end_s").alias("event_end_s"), F.col("first_t").alias("first_onset_s"), F.col("lag").alias("relative_lag_s"), "order_rank")


def propagation_rows(found: DataFrame, windows: DataFrame, zoom: float, fov_x: float, fov_y: float) -> DataFrame:
    """The propagation summary: a row for each event, from spatial.propagation and the events' windows."""
    f = found.join(windows, "event")
    named = {"event_index": "event", "event_start_s": "start_s", "event_end_s": "end_s", "start_x_um": "x0", "start_y_um": "y0", "end_x_um": "x1", "end_y_um": "y1", "dt_s": "dt", "distance_um": "distance", "speed_um_per_s": "speed", "angle_deg": "angle", "n_first_frame_rois": "n_first", "n_last_frame_rois": "n_last"}
    whole = {"zoom": F.lit(zoom), "fov_um_x": F.lit(fov_x), "fov_um_y": F.lit(fov_y), "dx_um": F.col("x1") - F.col("x0"), "dy_um": F.col("y1") - F.col("y0")}
    return f.select(*(F.col(c).alias(n) for n, c in named.items()), *(x.alias(n) for n, x in whole.items()))


def rois_sheet(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """roi, x_med, y_med, area_px and what labels (roi, p_cell, predicted_cell, iscell) says of it, null where it says nothing."""
    g = pixels.groupBy("roi").agg(F.median("x").alias("x_med"), F.median("y").alias("y_med"), F.count("*").alias("area_px"))
    return g.join(labels, "roi", "left").select("roi", "x_med", "y_med", "area_px", "p_cell", "predicted_cell", "iscell")


def params_sheet(spark, params: dict) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(params.items())], "key string, value string")


def clusters_sheet(clusters: DataFrame, method: str, metric: str, threshold: float) -> DataFrame:
    return clusters.select("roi", "cluster", F.lit(threshold).alias("threshold"), F.lit(method).alias("method"), F.lit(metric).alias("metric"))


def cluster_name(column: str):
    """A name that can be a folder: runs of other signs than letters and digits become one underscore."""
    return F.regexp_replace(column, "[^A-Za-z0-9]+", "_")


def write_identities(clusters: DataFrame, path: str) -> None:
    """The clusters' folders and, beside them, the table of all (cluster, roi)."""
    named = clusters.select(cluster_name("cluster").alias("cluster"), "roi")
    write_clusters(named, f"{path}/clusters")
    write_summary(named, f"{path}/cluster_identities")


def write_pair_lags(regions: DataFrame, lag: Callable[[np.ndarray, np.ndarray], np.ma.MaskedArray], path: str) -> None:
    """The lags of all pairs of a region of a lesser cluster and one of a greater, a folder a pair of clusters (C1xC2). A row has some
    regions of either, roiA and roiB, and best_lag_sec of each with each, row by row, missing ones as null: a pair of regions costs its
    lag, in the few bits that its dictionary has, and not a line. regions: label (int), roi; lag(a, b), of ids that broadcast."""

    def work(tiles, _):
        for a, _, b, _, _ in tiles:
            x = np.ma.masked_invalid(lag(a[:, None], b[None]), copy=False)
            cuts = [np.s_[i : i + PART[0], j : j + PART[1]] for i in range(0, len(a), PART[0]) for j in range(0, len(b), PART[1])]
            values, gone = (np.concatenate([y[c].ravel() for c in cuts]) for y in (x.data, np.ma.getmaskarray(x)))
            sides = {"roiA": [a[c[0]] for c in cuts], "roiB": [b[c[1]] for c in cuts]}
            ends = np.concatenate([[0], np.cumsum([len(f) * len(s) for f, s in zip(*sides.values(), strict=True)])]).astype(np.int32)
            there = pa.py_buffer(np.packbits(~gone, bitorder="little"))  # pa.array(values, mask=gone) takes 40 times as long
            lags = pa.Array.from_buffers(pa.float64(), len(values), [there, pa.py_buffer(values.astype(float, copy=False))])
            yield sides | {"best_lag_sec": pa.ListArray.from_arrays(pa.array(ends), lags)}

    r = regions.select("label", "roi", F.array(F.lit(0.0)).alias("zs"))
    p = B.over_pairs(r, work, "roiA array<long>, roiB array<long>, best_lag_sec array<double>", kind="label", with_self=False)
    p = p.select(F.concat(F.lit("C"), "label_a", F.lit("xC"), "label_b").alias("pair"), "roiA", "roiB", "best_lag_sec")
    conf, open_files = regions.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(open_files)
    conf.set(open_files, "64")  # a task has few pairs; one file at a time would have all lags sorted by pair on disk first
    try:
        p.write.partitionBy("pair").parquet(path, compression="zstd")
    finally:
        conf.set(open_files, before)
