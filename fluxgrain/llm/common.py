"""Table access, shared-folder materialisation and byte-level text kernels."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of the contracts: space and 0x09-0x0D.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one numpy pass works on; larger batches are cut into such slices.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes, so long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


_own: list[str] = []
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Without it a local session (as in tests) gets a temporary
    one, which goes with the process; a cluster gets an error, since its machines would not see each other's files."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="fluxgrain-"))
            atexit.register(shutil.rmtree, _own[0], True)
        found = _own[0]
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside goes at the end. A result that is to stay is to be saved after, or outside."""
    _scratch.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _scratch.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of batch whose texts together hold about limit bytes (one row at least)."""
    _, off = utf8(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start)
        start = end


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _B), ("q", _BINV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables["p"], _tables["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), which are ascending and disjoint."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        p, q = powers(hi - lo + 1)
        h = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=h[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix64((h[e] - h[s]) * q[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_spans(data: np.ndarray, off: np.ndarray, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (plus the total)."""
    ink = ~apart[data]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = off[:-1][off[:-1] < off[1:]]
    first[edge] = ink[edge]
    last[off[1:][off[:-1] < off[1:]] - 1] = ink[off[1:][off[:-1] < off[1:]] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z lower-cased, and the rows' bounds among them."""
    data, off = utf8(column)
    start, end, bounds = word_spans(data, off)
    return span_hashes(LOWER[data], start, end), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row index and hash of each k-word shingle; a row with fewer words, but one at least, has its whole sequence as one."""
    n = len(words)
    count = np.diff(bounds)
    rows_of_short = np.flatnonzero((count > 0) & (count < k))
    if n >= k:
        h = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            h = (h ^ words[i : n - k + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        row = np.repeat(np.arange(len(count)), count)[: n - k + 1]
        whole = np.arange(n - k + 1) + k <= bounds[1:][row]
        row, h = row[whole], mix64(h[whole])
    else:
        row, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(rows_of_short):
        extra = []
        for r in rows_of_short:
            x = np.uint64(0x2545F4914F6CDD1D)
            for w in words[bounds[r] : bounds[r + 1]]:
                x = mix64(np.array([x ^ w], np.uint64))[0]
            extra.append(x)
        row = np.concatenate([row, rows_of_short])
        h = np.concatenate([h, np.array(extra, np.uint64)])
    return row, h
