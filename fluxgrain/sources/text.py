"""Parsing of names, manifests, window and selection files, notes and image stacks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: decay times in seconds by sensor
TAU = {"6f": 0.7, "6m": 1.0, "6s": 1.3, "8m": 0.137}
DEFAULT_FPS, DEFAULT_ZOOM = 15.07, 1.0


def number_key(name: Column) -> Column:
    """The whole numbers of a name split at - and _, so that 00001 equals 1."""
    return F.transform(F.filter(F.split(name, "[-_]"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("long"))


def recording_id(name: Column) -> Column:
    return F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}_\d+", 0)


def sensor_value(label: Column, values: dict[str, float] = TAU) -> Column:
    """The value of the sensor that a label names (its "rg" taken out, cut at - _ +); of several the least key. Null if none."""
    tokens = F.split(F.replace(F.lower(label), F.lit("rg"), F.lit("")), "[-_+]")
    keys = F.array(*(F.lit(k) for k in values))
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.try_element_at(table, F.array_min(F.array_intersect(tokens, keys)))


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, r"([0-9]+)(?!.*[0-9])", 1).try_cast("int")


def parse_windows(lines: DataFrame) -> DataFrame:
    """recording, window, start, end from lines `rec, s1, e1, s2, e2...` split at commas or tabs. A byte-order mark, blank fields
    and a header (a first row whose second field is no number) are skipped; an odd number of bounds fails. lines: line_no, value."""
    f = F.filter(F.transform(F.split(F.regexp_replace("value", "^﻿", ""), r"[,\t]"), lambda x: F.trim(x)), lambda x: x != "")
    d = lines.select("line_no", f.alias("f")).where((F.size("f") > 0) & ~((F.col("line_no") == 0) & ~F.coalesce(F.get("f", F.lit(1)).rlike(r"^-?[0-9.]+$"), F.lit(False))))
    n = F.size("f") - 1
    pairs = F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: F.struct(F.get("f", 2 * i + 1).cast("int").alias("start"), F.get("f", 2 * i + 2).cast("int").alias("end")))
    pairs = F.when(n % 2 == 1, F.raise_error(F.lit("odd number of window bounds")).cast("array<struct<start:int,end:int>>")).when(n > 0, pairs)
    return d.select(F.get("f", F.lit(0)).alias("recording"), F.posexplode(pairs).alias("i", "w")).select("recording", (F.col("i") + 1).alias("window"), "w.start", "w.end")


def parse_selection(lines: DataFrame) -> DataFrame:
    """recording, clusters: the C<number> tokens of each recording's last line, upper-cased. lines: line_no, value."""
    rec = F.trim(F.get(F.split("value", r"[,\t]", 2), F.lit(0)))
    rest = F.get(F.split("value", r"[,\t]", 2), F.lit(1))
    tokens = F.transform(F.regexp_extract_all(rest, F.lit("(?i)C[0-9]+"), F.lit(0)), lambda x: F.upper(x))
    d = lines.select("line_no", rec.alias("recording"), tokens.alias("tokens")).where("size(tokens) > 0")
    return d.groupBy("recording").agg(F.max_by("tokens", "line_no").alias("clusters"))


def grouped_manifest(rows: DataFrame) -> DataFrame:
    """identifier, members: the locations of each identifier by trailing number. rows: identifier, location."""
    m = F.sort_array(F.collect_list(F.struct(trailing_number(F.col("location")).alias("n"), "location")))
    return rows.groupBy("identifier").agg(F.transform(m, lambda x: x["location"]).alias("members"))


def notes_lookup(recordings: DataFrame, notes: DataFrame) -> DataFrame:
    """recording, fps, zoom: the note of the exact name, else one whose name ends with -number or is the number, else defaults.

    recordings: recording as date_number. notes: date, filename, rate_hz, zoom.
    """
    r = recordings.select("recording", F.substring_index("recording", "_", 1).alias("date"), F.substring_index("recording", "_", -1).alias("rec"))
    exact = notes.select("date", F.col("filename").alias("fx"), F.col("rate_hz").alias("hx"), F.col("zoom").alias("zx")).dropDuplicates(["date", "fx"])
    j = r.join(exact, (r["date"] == exact["date"]) & (F.col("fx") == F.concat_ws("-", r["date"], "rec")), "left").select("recording", r["date"], "rec", "hx", "zx")
    short = notes.groupBy("date", F.regexp_extract("filename", r"([^-]*)$", 1).alias("rec")).agg(F.min(F.struct("filename", "rate_hz", "zoom")).alias("s"))
    j = j.join(short, ["date", "rec"], "left")
    return j.select("recording", F.coalesce("hx", "s.rate_hz", F.lit(DEFAULT_FPS)).alias("fps"), F.coalesce("zx", "s.zoom", F.lit(DEFAULT_ZOOM)).alias("zoom"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The recordings' metadata, quoted fields respected, wholly empty rows dropped, area and mode in lower case."""
    schema = "human_ID string, area string, slice_ID string, AAV string, DIV string, `1P_2P` string, video string, min_start double, baseline_min double, frames int, fs double, solution string, `Pos#` string, region string, good_bad_meh string, Notes string"
    d = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"')
    return d.dropna(how="all").withColumn("area", F.lower(F.trim("area"))).withColumn("1P_2P", F.lower(F.trim("`1P_2P`")))


def tiff_pages(raw: bytes) -> Iterator[np.ndarray]:
    """The pages of an uncompressed grey TIFF (8 or 16 bits, stripped), classic or big."""
    order = "<" if raw[:2] == b"II" else ">"
    big = struct.unpack(order + "H", raw[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), raw[8:16] if big else raw[4:8])[0]
    count, entry, value = ("Q", 20, 8) if big else ("H", 12, 4)
    size = {1: "B", 3: "H", 4: "I", 16: "Q"}
    while at:
        n = struct.unpack_from(order + count, raw, at)[0]
        at += struct.calcsize(count)
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, at + i * entry)
            k = struct.unpack_from(order + ("Q" if big else "I"), raw, at + i * entry + 4)[0]
            if kind in size:
                where = at + i * entry + entry - value
                if struct.calcsize(size[kind]) * k > value:
                    where = struct.unpack_from(order + ("Q" if big else "I"), raw, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{k}{size[kind]}", raw, where)
        at = struct.unpack_from(order + ("Q" if big else "I"), raw, at + n * entry)[0]
        if tags.get(259, (1,))[0] != 1:
            raise ValueError("compressed TIFF pages are not read")
        kind = {(8, 1): "u1", (16, 1): "u2", (16, 2): "i2", (8, 2): "i1"}[tags.get(258, (1,))[0], tags.get(339, (1,))[0]]
        data = b"".join(raw[a : a + b] for a, b in zip(tags[273], tags[279], strict=True))
        yield np.frombuffer(data, order + kind).reshape(tags[257][0], tags[256][0])


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """path, frame, ny, nx, pixels: a row for each page of the TIFF files at path."""

    def run(batches):
        for x in batches:
            for file, raw in zip(x["path"], x["content"], strict=True):
                for i, p in enumerate(tiff_pages(raw)):
                    yield pd.DataFrame({"path": [file], "frame": [i], "ny": [p.shape[0]], "nx": [p.shape[1]], "pixels": [p.ravel().astype(np.int32)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame int, ny int, nx int, pixels array<int>")
