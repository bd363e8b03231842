"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

A list holds rules (host, path, verdict). A rule fits a url whose host is the rule's or a subdomain of it and whose path starts
with the rule's; the longest rule (host and path together, then the longer host) wins. A rule has a shape: how many labels its
host has and how many bytes its path. For each shape that the list has, a url has one candidate at most: the last labels of its
host with the first bytes of its path. Prefix sums give a candidate's hash without building it, so a url costs its length and
the number of shapes, however long it is or whatever the list's lengths are. Candidates are probed in a blocked Bloom filter of
the listed keys: one 64-byte block by one half of the hash, eight bits of it by the other. Hits, few beside the candidates, are
joined with the list, which removes false positives. The filter takes ``bits`` bits a rule and at most ``max_bytes``; with more
rules it fills up and only passes more, the result stays exact.

Defined cases: null urls and urls without ``://`` have empty host and path and no rule; urls that no rule fits get the verdict
"allow"; an empty host fits no rule; very long urls are judged whole; repeated rules count once (block before allow); rules with
a null host or path are ignored; repeated rows are judged each; an empty table or list works; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrain.llm.common import mix64, powers, saved, slices, small_batches, utf8

BLOCK = 64
ODD64 = np.uint64(0xD6E8FEB86659FD93)
ODD = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]  # fixed values: multipliers for the bits


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


class BlockedBloom:
    """Blocks of 512 bits; a key sets eight bits of one block. Filters of equal size merge by OR."""

    def __init__(self, n: int, bits: int = 16, max_bytes: int = 16 << 20):
        blocks = max(1, min(-(-n * bits // (8 * BLOCK)), max_bytes // BLOCK))
        self.words = np.zeros((blocks, 8), np.uint64)

    def _at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = h.astype(np.uint64)
        block = (h >> np.uint64(32)) % np.uint64(len(self.words))
        low = h & np.uint64(0xFFFFFFFF)
        bit = np.stack([((low * np.uint64(m)) & np.uint64(0xFFFFFFFF)) >> np.uint64(26) for m in ODD], 1)
        return block, np.uint64(1) << bit

    def add(self, h: np.ndarray) -> None:
        block, mask = self._at(h)
        np.bitwise_or.at(self.words, block, mask)

    def might_contain(self, h: np.ndarray) -> np.ndarray:
        block, mask = self._at(h)
        return ((self.words[block] & mask) == mask).all(1)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S and Q so that the bytes [a, b) of data hash to (S[b] - S[a]) * Q[a], wherever they stand."""
    p, q = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return sums, q


def key(host: np.ndarray, path: np.ndarray, host_size: np.ndarray, path_size: np.ndarray) -> np.ndarray:
    """The hash of a host and a path from those of their bytes."""
    return mix64(mix64(host + host_size.astype(np.uint64) * ODD64) ^ (path + path_size.astype(np.uint64) * ODD64))


def rule_keys(hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    out = []
    for column in (hosts, paths):
        data, off = utf8(column)
        sums, q = prefix_sums(data)
        out.append(((sums[off[1:]] - sums[off[:-1]]) * q[off[:-1]], np.diff(off)))
    return key(out[0][0], out[1][0], out[0][1], out[1][1])


def candidates(hosts: pa.Array, paths: pa.Array, shapes: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each shape (labels, bytes): the rows that have a candidate, its key, where its host starts, and its path's bytes."""
    (host, h_off), (path, p_off) = utf8(hosts), utf8(paths)
    (hs, hq), (ps, pq) = prefix_sums(host), prefix_sums(path)
    dots = np.flatnonzero(host == 46)
    first, last = np.searchsorted(dots, h_off[:-1]), np.searchsorted(dots, h_off[1:])
    path_size = np.diff(p_off)
    for labels, size in shapes:
        rows = np.flatnonzero((h_off[:-1] < h_off[1:]) & (last - first + 1 >= labels) & (path_size >= size))
        cut = last[rows] - labels  # the dot before the last labels, where there is one
        start = np.where(cut >= first[rows], dots[np.maximum(cut, 0)] + 1 if len(dots) else 0, h_off[:-1][rows])
        end, at = h_off[1:][rows], p_off[:-1][rows]
        h = (hs[end] - hs[start]) * hq[start]
        p = (ps[at + size] - ps[at]) * pq[at]
        yield rows, key(h, p, end - start, np.full(len(rows), size)), start - h_off[:-1][rows], size


def build_filter(rules: DataFrame, bits: int = 16, max_bytes: int = 16 << 20) -> BlockedBloom:
    """Tasks build filters of the final size, which are merged in a tree; only filters of bounded size move."""
    n = rules.count()
    shape = BlockedBloom(n, bits, max_bytes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockedBloom(n, bits, max_bytes)
        for x in batches:
            own.add(rule_keys(x.column("host"), x.column("path")))
        yield pa.RecordBatch.from_pydict({"words": pa.array([own.words.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros_like(shape.words)
        for x in batches:
            for w in x.column("words").to_pylist():
                out |= np.frombuffer(w, np.uint64).reshape(out.shape)
        yield pa.RecordBatch.from_pydict({"words": pa.array([out.tobytes()], pa.binary())})

    parts = rules.select("host", "path").mapInArrow(part, "words binary")
    while parts.rdd.getNumPartitions() > 8:
        parts = parts.coalesce(max(1, parts.rdd.getNumPartitions() // 8)).mapInArrow(merge, "words binary")
    for row in parts.toLocalIterator():
        shape.words |= np.frombuffer(row["words"], np.uint64).reshape(shape.words.shape)
    return shape


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages; rules has host, path, verdict."""
    small_batches(pages.sparkSession)
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    shape = rules.select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.octet_length("path").alias("bytes")).distinct()
    shapes = sorted((r["labels"], r["bytes"]) for r in shape.toLocalIterator())
    shipped = pages.sparkSession.sparkContext.broadcast((build_filter(rules), shapes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, shapes = shipped.value
        for whole in batches:
            for batch in slices(whole, "path"):
                hosts, paths, urls = batch.column("host"), batch.column("path"), batch.column("url")
                out: list[tuple[int, str, str]] = []
                for rows, keys, start, size in candidates(hosts, paths, shapes):
                    hit = bloom.might_contain(keys)
                    out += [(r, hosts[r].as_py().encode()[s:].decode(), paths[r].as_py().encode()[:size].decode(errors="replace")) for r, s in zip(rows[hit].tolist(), start[hit].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"url": urls.take(pa.array([r for r, _, _ in out], pa.int64())), "host": pa.array([h for _, h, _ in out], pa.string()), "path": pa.array([p for _, _, p in out], pa.string())}
                )

    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = urls.where("host <> ''").select("url", "host", "path").mapInArrow(probe, "url string, host string, path string").distinct()
    length = (F.length("host") + F.length("path")).alias("n")
    best = found.join(rules, ["host", "path"]).groupBy("url").agg(F.max(F.struct(length, F.length("host").alias("m"), F.concat("host", "path").alias("rule"), "verdict")).alias("best"))
    best = saved(best.withColumnRenamed("url", "u"), "judged")  # saved, so that a url that a third of all pages share can be split
    out = urls.join(best, F.col("url") == F.col("u"), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, p, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), j AS (
  SELECT v.*, r.h || r.p AS rule, r.verdict, length(r.h) + length(r.p) AS n
  FROM v LEFT JOIN r ON (v.host = r.h OR ends_with(v.host, '.' || r.h)) AND starts_with(v.path, r.p)
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, n) AS rule, coalesce(arg_max(verdict, n), 'allow') AS verdict FROM j GROUP BY page_id
"""
