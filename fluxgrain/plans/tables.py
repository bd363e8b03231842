"""Queries over names, files, joins, sets and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrain.session import MANY_COLUMNS, beside, shared_folder
from fluxgrain.plans.registry import query, r6
from fluxgrain.sources import sinks, text
from fluxgrain.sources.standins import cluster, read, trace, trace_arrays, with_

NAMES = "SELECT doc_id, '2024-0' || (doc_id % 9 + 1) || '-03-' || lpad(CAST(doc_id % 40 AS VARCHAR), 5, '0') AS a, '2024-' || (doc_id % 9 + 1) || '-3_' || (doc_id % 40) AS b FROM documents"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    a = F.concat(F.lit("2024-0"), F.col("doc_id") % 9 + 1, F.lit("-03-"), F.lpad((F.col("doc_id") % 40).cast("string"), 5, "0"))
    b = F.concat(F.lit("2024-"), F.col("doc_id") % 9 + 1, F.lit("-3_"), F.col("doc_id") % 40)
    return d.select("doc_id", a.alias("a"), b.alias("b"))


@query(f"WITH n AS ({NAMES}), k AS (SELECT DISTINCT b, doc_id % 9 + 1 AS m, doc_id % 40 AS r FROM n) SELECT n.doc_id, k.b AS matched FROM n JOIN k ON k.m = n.doc_id % 9 + 1 AND k.r = n.doc_id % 40")
def q_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = names(spark, sf_dir)
    keys = n.select("b").distinct().withColumn("key", text.number_key(F.col("b")))
    return n.withColumn("key", text.number_key(F.col("a"))).join(keys.withColumnRenamed("b", "matched"), "key").select("doc_id", "matched")


@query("WITH l AS (SELECT vec_id, CASE label % 5 WHEN 0 THEN 'jRG8m-x' WHEN 1 THEN 'syn_GCaMP+6F' WHEN 2 THEN 'rg6s_b' WHEN 3 THEN '6m-6f' ELSE 'none' END AS label FROM embeddings) SELECT vec_id, CASE label WHEN 'syn_GCaMP+6F' THEN 0.7 WHEN 'rg6s_b' THEN 1.3 WHEN '6m-6f' THEN 0.7 END::DOUBLE AS tau FROM l")
def q_sensor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    m = F.col("label") % 5
    label = F.when(m == 0, "jRG8m-x").when(m == 1, "syn_GCaMP+6F").when(m == 2, "rg6s_b").when(m == 3, "6m-6f").otherwise("none")
    return e.select("vec_id", text.sensor_value(label).alias("tau"))


NOTES = [("2024-01-03", "2024-01-03-00001", 30.0, 2.0), ("2024-01-03", "x-00002", 20.0, 1.5), ("2024-01-03", "00003", 10.0, None), ("2024-02-03", "2024-02-03-00001", None, 3.0)]


@query("SELECT * FROM (VALUES ('2024-01-03_00001', 30.0::DOUBLE, 2.0::DOUBLE), ('2024-01-03_00002', 20.0, 1.5), ('2024-01-03_00003', 10.0, 1.0), ('2024-02-03_00001', 15.07, 3.0), ('2024-05-01_00009', 15.07, 1.0)) t(recording, fps, zoom)")
def q_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = spark.createDataFrame([(x,) for x in ("2024-01-03_00001", "2024-01-03_00002", "2024-01-03_00003", "2024-02-03_00001", "2024-05-01_00009")], "recording string")
    return text.notes_lookup(rec, spark.createDataFrame(NOTES, "date string, filename string, rate_hz double, zoom double"))


LINES = ["﻿rec,start,end", "r1, 10,20, 30, 40", "r2\t5\t9", "", "r3,7,3,,"]


@query("SELECT * FROM (VALUES ('r1', 1, 10, 20), ('r1', 2, 30, 40), ('r2', 1, 5, 9), ('r3', 1, 7, 3)) t(recording, \"window\", start, \"end\")")
def q_windows_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.parse_windows(spark.createDataFrame(list(enumerate(LINES)), "line_no int, value string"))


@query("SELECT * FROM (VALUES ('r1', 'C7+C1'), ('r2', 'C10')) t(recording, clusters)")
def q_selection_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ["rec,clusters", "r1,C2+C4", "r2\tc10", "r1, c7 + C1"]
    s = text.parse_selection(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))
    return s.where("recording <> 'rec'").select("recording", F.array_join("clusters", "+").alias("clusters"))


@query("WITH r AS (SELECT source AS identifier, source || '-f' || doc_id % 17 AS location, doc_id % 17 AS n FROM documents GROUP BY ALL) SELECT identifier, string_agg(location, ';' ORDER BY n, location) AS members FROM r GROUP BY identifier")
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    r = d.select(F.col("source").alias("identifier"), F.concat("source", F.lit("-f"), F.col("doc_id") % 17).alias("location")).distinct()
    return text.grouped_manifest(r).select("identifier", F.array_join("members", ";").alias("members"))


@query("WITH r AS (SELECT doc_id, lang || ' 2024-0' || (doc_id % 9 + 1) || '-03_' || doc_id || ' x' AS name FROM documents), i AS (SELECT doc_id, regexp_extract(name, '\\d{4}-\\d{2}-\\d{2}_\\d+') AS id FROM r) SELECT doc_id, split_part(id, '_', 1)::DATE AS day, split_part(id, '_', 2) AS rec FROM i")
def q_recording_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    name = F.concat("lang", F.lit(" 2024-0"), F.col("doc_id") % 9 + 1, F.lit("-03_"), "doc_id", F.lit(" x"))
    i = d.select("doc_id", text.recording_id(name).alias("id"))
    return i.select("doc_id", F.to_date(F.split_part("id", F.lit("_"), F.lit(1))).alias("day"), F.split_part("id", F.lit("_"), F.lit(2)).alias("rec"))


@query(with_("trace", "cluster") + " SELECT recording, count(*) AS n, round(sum(f), 4) + 0.0 AS total FROM trace SEMI JOIN (SELECT roi FROM cluster WHERE cluster IN ('C1', 'C3')) c USING (roi) GROUP BY recording")
def q_semi_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cluster(spark, sf_dir).where("cluster in ('C1', 'C3')").select("roi").distinct()
    t = trace(spark, sf_dir).join(c, "roi", "left_semi")
    return t.groupBy("recording").agg(F.count("*").alias("n"), (F.round(F.sum("f"), 4) + 0.0).alias("total"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def q_anti_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT o_orderkey AS k, o_totalprice AS a, NULL::DOUBLE AS b FROM orders UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def q_union_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("b"))
    return o.unionByName(s, allowMissingColumns=True)


@query("WITH a AS (SELECT DISTINCT l_partkey % 97 AS k FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT o_custkey % 97 AS k FROM orders WHERE o_totalprice > 300000) SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'minus', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def q_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select((F.col("l_partkey") % 97).alias("k"))
    b = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select((F.col("o_custkey") % 97).alias("k"))
    named = lambda name, d: d.select(F.lit(name).alias("op"), "k")
    return named("union", a.union(b).distinct()).union(named("both", a.intersect(b))).union(named("minus", a.subtract(b)))


@query()
def q_pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each region, whose number SQL can't know beforehand: tested against the arrays; q_pivot_recordings has SQL."""
    own = beside(spark, MANY_COLUMNS)
    t = trace(own, sf_dir).withColumn("f", r6("f"))
    return sinks.wide(t, "frame", "roi", "f", sorted(trace_arrays(own, sf_dir).select("roi").distinct().toArrow()["roi"].to_pylist()))


@query(with_("trace") + ", m AS (SELECT recording, frame, round(avg(f), 6) + 0.0 AS f FROM trace GROUP BY ALL) SELECT frame, " + ", ".join(f"max(f) FILTER (recording = {i}) AS rec_{i}" for i in range(10)) + " FROM m GROUP BY frame")
def q_pivot_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for each recording's mean trace, over all regions."""
    m = trace(spark, sf_dir).groupBy("recording", "frame").agg(r6(F.avg("f")).alias("f"))
    return sinks.wide(m, "frame", "recording", "f", range(10), "rec_")


@query("SELECT unnest(['rois', 'frames', 'labels']) AS key, unnest([count(*)::VARCHAR, max(len(embedding))::VARCHAR, count(DISTINCT label)::VARCHAR]) AS value FROM embeddings")
def q_meta_key_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return sinks.key_values(e.agg(F.count("*").alias("rois"), F.max(F.size("embedding")).alias("frames"), F.count_distinct("label").alias("labels")))


@query("WITH r AS (SELECT a AS backend, b AS thr, c AS size FROM (SELECT unnest(['x', 'y']) AS a), (SELECT unnest(range(5)) AS b), (SELECT unnest([3, 7]) AS c)), l AS (SELECT backend || '-' || thr || '-' || size AS sig, (thr * 37 + size * 11 + length(backend)) % 29 AS residual_mean FROM r) SELECT sig, residual_mean, row_number() OVER (ORDER BY residual_mean, sig) AS rank FROM l ORDER BY rank LIMIT 10")
def q_grid_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of configurations and the best ten: a top-k report."""
    axis = lambda name, v: spark.createDataFrame([(x,) for x in v], [name])
    g = axis("backend", ["x", "y"]).crossJoin(axis("thr", list(range(5)))).crossJoin(axis("size", [3, 7]))
    led = g.select(F.concat_ws("-", "backend", F.col("thr").cast("string"), F.col("size").cast("string")).alias("sig"), ((F.col("thr") * 37 + F.col("size") * 11 + F.length("backend")) % 29).alias("residual_mean"))
    return sinks.leaderboard(led, 10).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def q_star_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM p WHERE rn = 1")
def q_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def q_min_max_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-phase minima and maxima over files, with rollup totals (an extension)."""
    return read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.count("*").alias("n"))


@query("SELECT 'hip' AS area, '2p' AS mode, 'a,b' AS solution, 'q\"x' AS Notes, count(*) AS n FROM documents")
def q_metadata_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as metadata rows written to CSV in the shared folder and read back through the dirty-file reader."""
    where = shared_folder(spark, "metadata-csv")
    d = read(spark, sf_dir, "documents")
    cols = "human_ID area slice_ID AAV DIV 1P_2P video min_start baseline_min frames fs solution Pos# region good_bad_meh Notes".split()
    v = [F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, " Hip").otherwise("hip "), F.lit("s"), F.lit("rg8m"), F.lit("9"), F.when(F.col("doc_id") % 3 == 0, "2P").otherwise("2p"), F.lit("v"), F.lit(0.0), F.lit(1.0), F.lit(100), F.lit(15.07), F.lit("a,b"), F.lit("1"), F.lit("r"), F.lit("?"), F.lit('q"x')]
    d.select(*(x.alias(c) for x, c in zip(v, cols, strict=True))).write.mode("overwrite").csv(where, header=True, escape='"')
    return text.read_metadata(spark, where).groupBy("area", F.col("1P_2P").alias("mode"), "solution", "Notes").agg(F.count("*").alias("n"))
