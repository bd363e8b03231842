"""Line deduplication by winnowing over line hashes.

A document is its lines. A window starts at each line with words and ends where its lines hold MIN_WORDS words together. Winnowing
selects the least line hash of each window, the last of equals: its fingerprint, at a position that neighbouring windows mostly
share. Identical windows select at the same place, so every run of lines with MIN_WORDS words or more that occurs twice has common
fingerprints. Three steps:

1. Distinct positions (fingerprint, line) go through one aggregation, which finds the fingerprints that occur twice.
2. Windows behind shared fingerprints are verified: they are joined, by fingerprint and a hash of all their lines, with their
   first occurrence in the corpus (least doc_id, then line).
3. Matches whose windows follow one another in both documents make one run. Runs are grouped by their pair of documents, and a
   pair's runs are extended line by line both ways. A document's later runs, merged to disjoint stretches, are deleted.

The first occurrence of a line's content is never deleted, since what is deleted has an equal earlier line. A window that a third
of all documents hold costs one aggregated row and one joined row an occurrence, not a pair of occurrences. Lines are compared
without white space at their ends and with A-Z lower-cased, by 64-bit hashes.

Defined cases: null and empty texts have no lines with words and stay; very long texts are handled alike, a task holds the line
hashes of two at a time; blank lines belong to no window, break no run and go with the run around them; rows that share doc_id and text are the same
document, other texts of a doc_id are documents of their own, ordered by a hash of the text; rows with a null doc_id are left
alone; an empty table gives an empty result; extra columns pass, those named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrain.llm.common import IS_SPACE, LOWER, mix64, saved, slices, small_batches, span_hashes, utf8, word_spans

MIN_WORDS = 20


def line_table(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with words of all rows: row, number in the row, hash, words."""
    start, _, words_at = word_spans(data, off)
    breaks = np.flatnonzero(data == 10)
    line_start = np.concatenate([off[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
    order = np.lexsort((line_start, row))  # a row's final line break opens a line where the next row starts
    line_start, row = line_start[order], row[order]
    line_end = np.concatenate([line_start[1:] - 1, [len(data)]])
    last_of_row = np.concatenate([row[1:] != row[:-1], [True]])
    line_end[last_of_row] = off[1:][row[last_of_row]]
    number = np.arange(len(row)) - np.searchsorted(row, row)
    words = np.searchsorted(start, line_end) - np.searchsorted(start, line_start)
    keep = words > 0
    line_start, line_end, row, number, words = (x[keep] for x in (line_start, line_end, row, number, words))
    ink = np.flatnonzero(~IS_SPACE[data])
    a, b = ink[np.searchsorted(ink, line_start)], ink[np.searchsorted(ink, line_end) - 1] + 1
    return row, number, span_hashes(LOWER[data], a, b), words


def windows(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document's lines: start and end (inclusive) of each window, the line it selects, and a key of its content."""
    upto = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(upto, upto[:-1] + least) - 1
    start = np.flatnonzero(end < len(words))
    end = end[start]
    key = np.zeros(len(start), np.uint64)
    low, at = np.full(len(start), np.iinfo(np.uint64).max, np.uint64), start.copy()
    for i in range(int((end - start).max()) + 1 if len(start) else 0):
        inside = start + i <= end
        h = hashes[np.minimum(start + i, len(hashes) - 1)]
        key = np.where(inside, mix64(key * np.uint64(3) + h), key)
        less = inside & (h <= low)
        low, at = np.where(less, h, low), np.where(less, start + i, at)
    return start, end, at, key


def scanner(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each document its lines (hash, number) and its windows (fingerprint, line selected, key, first line, last line)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                row, number, hashes, words = line_table(*utf8(batch.column("text")))
                bounds = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
                out: dict[str, list] = {"lines": [], "numbers": [], "fps": [], "spots": [], "keys": [], "starts": [], "ends": []}
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    h = hashes[a:b]
                    s, e, at, k = windows(h, words[a:b], least)
                    for name, x in (("lines", h), ("numbers", number[a:b]), ("fps", h[at]), ("spots", at), ("keys", k), ("starts", s), ("ends", e)):
                        out[name].append(x.astype(np.int64))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id")} | {n: pa.array(x, pa.list_(pa.int64())) for n, x in out.items()})

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moves both ends of each run (s, e, s0) of a pair outwards while its lines agree with those of the first occurrence; gives
    the runs as line numbers."""
    for batch in batches:
        at, a, b = [], [], []
        for row, (runs, lines, numbers, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("runs", "lines", "numbers", "first")), strict=True)):
            reached: dict[int, int] = {}  # by shift, the last line that a run before covers
            for r in sorted(runs, key=lambda r: r["s"]):
                s, e, s0 = r["s"], r["e"], r["s0"]
                if reached.get(s - s0, -1) >= e:
                    continue
                e0 = s0 + e - s
                while e + 1 < len(lines) and e0 + 1 < len(first) and lines[e + 1] == first[e0 + 1]:
                    e, e0 = e + 1, e0 + 1
                while s > 0 and s0 > 0 and lines[s - 1] == first[s0 - 1]:
                    s, s0 = s - 1, s0 - 1
                reached[s - s0] = e
                at.append(row)
                a.append(numbers[s])
                b.append(numbers[e])
        yield pa.RecordBatch.from_pydict({"id": batch.column("id").take(pa.array(at, pa.int64())), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, tie (a hash of the text), spans: the line numbers [a, b] of each document's later repeated runs, ascending and disjoint."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    kind = f"struct<doc_id: {docs.schema['doc_id'].dataType.simpleString()}, tie: long>"
    known = docs.where("doc_id is not null").select(F.struct("doc_id", F.xxhash64(text).alias("tie")).alias("id"), text.alias("text"))
    fields = ", ".join(f"{c} array<long>" for c in ("lines", "numbers", "fps", "spots", "keys", "starts", "ends"))
    table = saved(known.mapInArrow(scanner(least), f"id {kind}, {fields}"), "lines")

    # 1. the fingerprints selected at two positions
    spots = table.select("id", F.explode(F.array_distinct(F.arrays_zip("fps", "spots"))).alias("x")).select("id", F.col("x.fps").alias("fp"), F.col("x.spots").alias("spot"))
    place = F.struct("id", "spot")
    shared = saved(spots.groupBy("fp").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f < l").select("fp"), "shared")

    # 2. their windows, verified against the first occurrence of their content
    rows = table.select("id", F.explode(F.arrays_zip("fps", "keys", "starts", "ends")).alias("w"))
    rows = rows.select("id", F.col("w.fps").alias("fp"), F.col("w.keys").alias("key"), F.col("w.starts").alias("s"), F.col("w.ends").alias("e"))
    rows = saved(rows.join(shared, "fp", "left_semi"), "windows")
    spot = F.struct("id", "s")
    first = rows.groupBy("fp", "key").agg(F.min(spot).alias("f"), F.max(spot).alias("l")).where("f < l")
    # saved, as tables below, so that both sides of the joins are plain exchanges, whose hot keys adaptive execution splits
    first = saved(first.select("fp", "key", F.col("f.id").alias("id0"), F.col("f.s").alias("s0")), "first")
    later = rows.join(first, ["fp", "key"]).where("id <> id0 or s <> s0").select("id", "s", "e", "id0", "s0", (F.col("s") - F.col("s0")).alias("shift")).distinct()

    # 3. runs of a pair of documents, extended, then merged for each document
    order = Window.partitionBy("id", "id0", "shift").orderBy("s")
    later = later.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    later = later.withColumn("island", F.sum("new").over(order))
    runs = later.groupBy("id", "id0", "shift", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("s0").alias("s0"))
    pairs = saved(runs.groupBy("id", "id0").agg(F.collect_list(F.struct("s", "e", "s0")).alias("runs")), "runs")
    one = table.select("id", "lines", "numbers").dropDuplicates(["id"])
    one = saved(one.join(pairs.select("id").union(pairs.select(F.col("id0").alias("id"))).distinct(), "id", "left_semi"), "lines-by-id")
    both = pairs.join(one, "id").join(one.select(F.col("id").alias("id0"), F.col("lines").alias("first")), "id0")
    spans = both.select("id", "runs", "lines", "numbers", "first").mapInArrow(_extend, f"id {kind}, a long, b long")
    spans = spans.groupBy("id", "a").agg(F.max("b").alias("b"))
    order = Window.partitionBy("id").orderBy("a")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (F.col("a") > F.coalesce(before, F.lit(-2)) + 1).cast("int")).withColumn("run", F.sum("new").over(order))
    merged = spans.groupBy("id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy(F.col("id.doc_id").alias("doc_id"), F.col("id.tie").alias("tie")).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with text without its later repeated runs, and n_lines, n_removed (in the place of columns so named)."""
    spans = saved(repeats(docs, least).select(F.col("doc_id").alias("_fg_of"), F.col("tie").alias("_fg_tie"), F.col("spans").alias("_fg_spans")), "spans")
    same = (F.col("doc_id") == F.col("_fg_of")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_fg_tie"))
    found = docs.join(spans.hint("merge"), same, "left").drop("_fg_of", "_fg_tie")
    lines = F.split(F.col("text"), "\n", -1)
    found = found.withColumn("_fg_lines", lines)
    # what lies between the spans, each stretch cut out once
    ends = F.concat(F.array(F.lit(-1).cast("long")), F.col("_fg_spans.b"))
    starts = F.concat(F.col("_fg_spans.a"), F.array(F.size("_fg_lines").cast("long")))
    kept = F.flatten(F.zip_with(ends, starts, lambda b, a: F.slice("_fg_lines", (b + 2).cast("int"), F.greatest(a - b - 1, F.lit(0)).cast("int"))))
    cut = F.col("_fg_spans").isNotNull() & F.col("text").isNotNull()
    found = found.withColumn("_fg_kept", F.when(cut, kept))
    found = found.withColumn("n_lines", F.coalesce(F.size("_fg_lines"), F.lit(0)).cast("long"))
    found = found.withColumn("n_removed", F.when(cut, F.col("n_lines") - F.size("_fg_kept")).otherwise(0).cast("long"))
    return found.withColumn("text", F.when(cut, F.array_join("_fg_kept", "\n")).otherwise(F.col("text"))).drop("_fg_spans", "_fg_kept", "_fg_lines")
