"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by deleting every character of ``[\\x20\\x09-\\x0D]``. The UTF-8 bytes are hashed in chunks,
``H(c) = sum c[i] * r^i mod p`` under two primes, and the hashes of neighbouring stretches combine by
``H(ab) = H(a) + r^|a| * H(b)``: chunks of one document combine inside a task, and the pieces of a huge document, which are
dealt out to many tasks, combine afterwards in an aggregate. Rows with equal length and fingerprints are candidates; their
texts are then compared chunk by chunk as a stream of (class, chunk number, chunk) rows, of which equal ones collapse before
the shuffle, so that a class may hold any share of all rows. Classes found to differ are split by their SHA-256.

Defined cases: null text counts as empty; all empty texts are one class; ties (equal code points) keep the smallest doc_id,
a null doc_id counting as larger than any; repeated rows are rows of their class like any others, all of them kept where one
is (they are one document); very long texts are dealt out in pieces; an empty table gives an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrain.llm.common import IS_SPACE, WS_CHARS, saved, slices, small_batches, utf8

PRIMES = (2147483647, 2147483629)
BASES = (48271, 69621)
CHUNK = 1024


@functools.cache
def _weights() -> list[np.ndarray]:
    out = []
    for p, r in zip(PRIMES, BASES, strict=True):
        w = np.ones(CHUNK, np.uint64)
        for i in range(1, CHUNK):
            w[i] = int(w[i - 1]) * r % p
        out.append(w)
    return out


def combine(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    """The fingerprint (length, h1, h2) of the concatenation of two stretches."""
    return (a[0] + b[0], *((x + pow(r, a[0], p) * y) % p for x, y, p, r in zip(a[1:], b[1:], PRIMES, BASES, strict=True)))


def fingerprints(data: np.ndarray, off: np.ndarray) -> list[tuple[int, ...]]:
    """(length, h1, h2) of each row of normalised bytes."""
    size = np.diff(off)
    per = -(-size // CHUNK)
    row = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = off[row] + nth * CHUNK
    sums = []
    if len(start):
        pos = np.arange(len(data)) - np.repeat(start, np.minimum(CHUNK, off[1:][row] - start))
        for w, p in zip(_weights(), PRIMES, strict=True):
            sums.append((np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * w[pos], start) % np.uint64(p)).tolist())
    out, at = [], 0
    for n, k in zip(size.tolist(), per.tolist(), strict=True):
        fp = (0, 0, 0)
        for i in range(k):
            fp = combine(fp, (min(CHUNK, n - i * CHUNK), sums[0][at + i], sums[1][at + i]))
        out.append(fp)
        at += k
    return out


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ink = ~IS_SPACE[data]
    count = np.concatenate([[0], np.cumsum(ink)])
    return data[ink], count[off]


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the column text; the other columns pass."""
    for whole in batches:
        for batch in slices(whole):
            data, off = normalised(*utf8(batch.column("text")))
            fps = fingerprints(data, off)
            raw = data.tobytes()
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            rest = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
            n, a, b = (pa.array([x[i] for x in fps], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_pydict(dict(rest) | {"n_norm": n, "fp1": a, "fp2": b, "text_sha256": pa.array(sha, pa.string())})


def fingerprint(docs: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """doc_id, n_cp, n_norm, fp1, fp2, text_sha256 for each row. Normalised texts over piece code points are cut, dealt out by
    their SHA-256 and piece (equal texts once), hashed, and combined by length-shifted arithmetic in an aggregate."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n_cp"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    small = base.where(F.col("n_cp") <= piece).mapInArrow(_kernel, f"doc_id {kind}, n_cp long, n_norm long, fp1 long, fp2 long, text_sha256 string")
    ink = F.translate("text", WS_CHARS, "")
    huge = base.where(F.col("n_cp") > piece).select("doc_id", "n_cp", ink.alias("text")).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    cut = F.expr(f"transform(sequence(0, cast(length(text) div {piece} as int)), i -> struct(i AS nth, substring(text, i * {piece} + 1, {piece}) AS text))")
    pieces = huge.select(F.col("text_sha256").alias("of"), F.explode(cut).alias("x")).select("of", "x.nth", "x.text").repartition("of", "nth").dropDuplicates(["of", "nth"])
    hashed = pieces.mapInArrow(_kernel, "of string, nth int, n_norm long, fp1 long, fp2 long, text_sha256 string")
    shifts = [power(F.col("n_norm"), r, p).alias(f"r{i}") for i, (r, p) in enumerate(zip(BASES, PRIMES, strict=True), 1)]
    joined = hashed.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("nth", "n_norm", "fp1", "fp2", *shifts))).alias("xs"))
    zero = F.expr("named_struct('n_norm', 0L, 'fp1', 0L, 'fp2', 0L, 'r1', 1L, 'r2', 1L)")

    def put(a: Column, x: Column) -> Column:
        """H(ab) = H(a) + r^|a| H(b), and r^|ab| = r^|a| r^|b|."""
        fp = [((a[f"fp{i}"] + a[f"r{i}"] * x[f"fp{i}"]) % p).alias(f"fp{i}") for i, p in enumerate(PRIMES, 1)]
        return F.struct((a["n_norm"] + x["n_norm"]).alias("n_norm"), *fp, *((a[f"r{i}"] * x[f"r{i}"] % p).alias(f"r{i}") for i, p in enumerate(PRIMES, 1)))

    whole = joined.select("of", F.aggregate("xs", zero, put).alias("f"))
    big = huge.select("doc_id", "n_cp", "text_sha256").join(whole, F.col("text_sha256") == F.col("of"))
    return small.unionByName(big.select("doc_id", "n_cp", "f.n_norm", "f.fp1", "f.fp2", "text_sha256"))


def power(n: Column, base: int, prime: int) -> Column:
    """base^n mod prime for n < 2^40, by squares that are known beforehand."""
    out = F.lit(1).cast("long")
    steps = F.array(*(F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(pow(base, 1 << i, prime)).cast("long").alias("square")) for i in range(40)))
    return F.aggregate(steps, out, lambda x, s: F.when(n.bitwiseAND(s["bit"]) != 0, x * s["square"] % prime).otherwise(x))


def differing(docs: DataFrame, members: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Keys of the classes whose normalised texts are not all equal, found by streaming comparison of chunks. Texts find their class
    by SHA-256, so that ids which repeat or are null multiply nothing; by a merge join at every size, as members grow with docs."""
    key = ["n_norm", "fp1", "fp2"]
    text = F.translate(F.coalesce("text", F.lit("")), WS_CHARS, "")
    of = saved(members.select(F.col("text_sha256").alias("m"), *key).distinct(), "members")
    rows = docs.select(text.alias("t")).withColumn("sha", F.sha2(F.col("t").cast("binary"), 256)).join(of.hint("merge"), F.col("sha") == F.col("m"))
    cut = F.expr(f"transform(sequence(0, cast(length(t) div {chunk} as int)), i -> struct(i AS nth, substring(t, i * {chunk} + 1, {chunk}) AS part))")
    parts = rows.select(*key, F.explode(cut).alias("x")).select(*key, "x.nth", "x.part").distinct()
    return parts.groupBy(*key, "nth").count().where("count > 1").select(*key).distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_norm."""
    small_batches(docs.sparkSession)
    key = ["n_norm", "fp1", "fp2"]
    fps = saved(fingerprint(docs), "fingerprints")
    # saved, as classes below, so that both sides of the joins are plain exchanges, whose hot keys adaptive execution splits
    several = saved(fps.groupBy(*key).count().where("count > 1").select(*key), "several")
    bad = saved(differing(docs, fps.join(several, key, "left_semi")), "differing")
    if bad.isEmpty():
        fps = fps.withColumn("sub", F.lit(""))
    else:
        fps = fps.join(bad.withColumn("split", F.lit(True)), key, "left")
        fps = fps.withColumn("sub", F.when(F.col("split"), F.col("text_sha256")).otherwise("")).drop("split")
    key.append("sub")
    best = F.min(F.struct((-F.col("n_cp")).alias("short"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    classes = saved(fps.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "classes")
    return fps.join(classes, key).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_cp") == -F.col("best.short"))).alias("kept"),
        "text_sha256",
        "n_norm",
    )
