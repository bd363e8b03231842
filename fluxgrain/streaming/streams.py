"""Structured Streaming forms of the trace and event operators. An extension: the batch operators define the results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxgrain.functions.columns import butter2


def stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder; timestamps without zone become instants, which watermarks need."""
    s = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """event_type, start, n, total in fixed windows."""
    w = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n of runs without a gap: the streaming form of merging touching events."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def causal_onsets(samples: DataFrame, cutoff: float, fs: float, hi: float, lo: float, least: int) -> DataFrame:
    """roi, frame, y, onset of a stream (roi, frame, f): low-pass, hysteresis and minimum separation, whose state is kept a region."""
    b0, b1, b2, a1, a2 = butter2(cutoff, fs)

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z0, z1, active, kept = state.get if state.exists else (None, 0.0, False, -(1 << 40))
        x = pd.concat(list(batches)).sort_values("frame")
        ys, flags = [], []
        for frame, v in zip(x["frame"], x["f"], strict=True):
            if z0 is None:
                z0 = z1 = float(v)
            y = b0 * v + z0
            z0, z1 = b1 * v - a1 * y + z1, b2 * v - a2 * y
            begins = not active and y >= hi
            active = begins or (active and y > lo)
            begins = begins and frame - kept >= least
            kept = int(frame) if begins else kept
            ys.append(y)
            flags.append(begins)
        state.update((z0, z1, active, kept))
        yield pd.DataFrame({"roi": key[0], "frame": x["frame"], "y": ys, "onset": flags})

    return samples.groupBy("roi").applyInPandasWithState(one, "roi long, frame long, y double, onset boolean", "z0 double, z1 double, active boolean, kept long", "append", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now and returns its rows. Checkpoints and output go to folder, which must be shared."""
    spark = df.sparkSession
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{folder}/{name}-out").option("checkpointLocation", f"{folder}/{name}-ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}-out")

    def replace(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}-{i}")
        done.append(i)

    done: list[int] = []
    q = df.writeStream.outputMode(mode).foreachBatch(replace).option("checkpointLocation", f"{folder}/{name}-ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}-{done[-1]}")
