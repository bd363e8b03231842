"""Streaming queries over events, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrain.plans.registry import query
from fluxgrain.session import shared_folder
from fluxgrain.sources.standins import read
from fluxgrain.streaming import streams as S


def _folder(spark: SparkSession) -> str:
    return shared_folder(spark, "stream")


def _events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """events as a stream: a copy of the table in files, as a stream source needs a folder."""
    e = read(spark, sf_dir, "events")
    e.repartition(2).write.parquet(f"{folder}/in")
    return S.stream(spark, f"{folder}/in", e)


@query("SELECT event_type, CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS BIGINT) AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    out = S.drained(S.tumbling(_events(spark, sf_dir, folder)), "tumbling", folder, "complete")
    return out.select("event_type", F.unix_seconds("start").alias("start_s"), "n", F.round("total", 4).alias("total"))


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS start_ms, count(*) AS n FROM g GROUP BY user_id, s")
def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    out = S.drained(S.sessions(_events(spark, sf_dir, folder)), "sessions", folder, "complete")
    return out.select("user_id", F.unix_millis("start").alias("start_ms"), "n")
