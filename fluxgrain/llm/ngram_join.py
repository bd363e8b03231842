"""N-gram Jaccard join with a token-group matrix.

Texts become sets of 64-bit hashes of k-word shingles. Two documents link when ``den * |A & B| >= num * |A | B|``.

1. One pass sketches every text: the set's size, two 64-bit sums that identify the set, and min-hash band keys. Documents with
   equal sets are a class; one of them stands for it from here on.
2. Classes are partitioned into groups of similar documents: each goes to the least class that shares a band key with it.
3. The token-group matrix stores, for each group, the union of its members' rarest tokens. How rare a token is comes from a
   count sketch of all tokens of all documents, of bounded size; any total order makes the filter exact, and this one keeps
   common passages out. If A and B link and |A| <= |B|, they share L of the ``|B| - ceil(|B| * num / den) + L`` rarest tokens
   of B and the ``|A| - ceil(2 * |A| * num / (num + den)) + L`` rarest of A. So the number of a query's rare tokens in a
   group's union bounds its overlap with every member that isn't larger: groups with fewer than L are never opened.
4. Qualifying groups are opened: their queries and their members, each cut into blocks of about BLOCK tokens and SIDE sets by size
   and hash, meet block by block, where overlaps of whole sets are matrix products of bounded numbers of rows, columns and
   cells. A block puts out a spanning forest of its links, not the links.
5. Components of the forests' edges are the result.

Nothing is sampled or capped. Set equality and overlap hold up to collisions of 64-bit hashes.

Defined cases: null and empty texts, and texts of white space, have an empty set and link with nothing; texts of fewer than k
words have their whole sequence as one shingle; very long texts are whole sets, of which a task holds two blocks' worth at a time;
repeated rows are equal documents; a class of equal sets is one node, whatever doc_ids its rows have, so that texts which share
a doc_id, or have none, are linked by their words only; a component is named by its smallest doc_id, a component of rows without
doc_id by null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxgrain.llm.common import mix64, saved, shingle_hashes, slices, small_batches, word_hashes
from fluxgrain.llm.components import components

BANDS, ROWS = 4, 3
L = 2
#: Tokens of a block of queries or members.
BLOCK = 200_000
#: Sets of a block of queries or members, so that a pair of blocks has at most SIDE^2 cells or so.
SIDE = 512
#: Sketch counters: one for about each PER tokens, between these bounds.
PER, LEAST, MOST = 256, 1 << 12, 1 << 20

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def sets_of(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    row, h = shingle_hashes(*word_hashes(column), k)
    order = np.argsort(row, kind="stable")
    bounds = np.searchsorted(row[order], np.arange(len(column) + 1))
    h = h[order]
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _sums(x: np.ndarray) -> tuple[int, int]:
    m = mix64(x ^ np.uint64(0xA0761D6478BD642F))
    return int(x.sum(dtype=np.uint64).astype(np.int64)), int(m.sum(dtype=np.uint64).astype(np.int64))


_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def _bands(x: np.ndarray) -> list[int]:
    least = np.array([((x ^ s) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(8)).min() for s in _SEEDS], np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mix64(key ^ least[:, i])
    return key.astype(np.int64).tolist()


def sketcher(k: int) -> Kernel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = sets_of(batch.column("text"), k)
                sums = [_sums(x) for x in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "tie": batch.column("tie"),
                        "n": pa.array([len(x) for x in sets], pa.int64()),
                        "s1": pa.array([a for a, _ in sums], pa.int64()),
                        "s2": pa.array([b for _, b in sums], pa.int64()),
                        "bands": pa.array([_bands(x) if len(x) else [] for x in sets], pa.list_(pa.int64())),
                    }
                )

    return run


PART = 1 << 12


def counter(k: int, size: int) -> Kernel:
    """Counts of tokens by hash modulo size, as rows of PART counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for whole in batches:
            for batch in slices(whole):
                _, h = shingle_hashes(*word_hashes(batch.column("text")), k)
                at, n = np.unique(h & np.uint64(size - 1), return_counts=True)
                total[at.astype(np.int64)] += n
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(size // PART)), "counts": pa.array([x.tobytes() for x in total.astype(np.int32).reshape(-1, PART)], pa.binary())})

    return run


def adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
    if total:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total)), "counts": pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())})


def token_counts(docs: DataFrame, k: int, tokens: int) -> np.ndarray:
    """The count sketch of all tokens, whose size is bounded by MOST counters."""
    size = min(MOST, max(LEAST, 1 << int(tokens // PER).bit_length()))
    parts = docs.select("text").mapInArrow(counter(k, size), "part long, counts binary")
    summed = parts.repartition(max(1, size // PART // 8), "part").mapInArrow(adder, "part long, counts binary")
    out = np.zeros((size // PART, PART), np.int32)
    for r in summed.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counts"], np.int32)
    return out.ravel()


def prefixer(k: int, num: int, den: int, least: int, counts) -> Kernel:
    """The rarest tokens of each set, rarest first; short: whether they are among those that count when the set is the smaller one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = counts.value
        mask = np.uint64(len(load) - 1)
        for whole in batches:
            for batch in slices(whole):
                sets = sets_of(batch.column("text"), k)
                ids, grps, s1s = (batch.column(c).to_numpy() for c in ("id", "grp", "s1"))
                tokens, at, short = [], [], []
                for i, x in enumerate(sets):
                    n = len(x)
                    if n == 0 or _sums(x)[0] != s1s[i]:
                        continue
                    p, q = n - -(-n * num // den) + least, n - -(-2 * n * num // (num + den)) + least
                    x = x[np.lexsort((x, load[(x & mask).astype(np.int64)]))[: min(n, p)]]
                    tokens.append(x)
                    at.append(np.full(len(x), i))
                    short.append(np.arange(len(x)) < q)
                if tokens:
                    at_ = np.concatenate(at)
                    n = np.array([len(x) for x in sets], np.int32)
                    yield pa.RecordBatch.from_pydict(
                        {"token": pa.array(np.concatenate(tokens).astype(np.int64)), "id": pa.array(ids[at_]), "grp": pa.array(grps[at_]), "n": pa.array(n[at_]), "short": pa.array(np.concatenate(short))}
                    )

    return run


def setter(k: int) -> Kernel:
    """The sets themselves, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = [x if _sums(x)[0] == s else x[:0] for x, s in zip(sets_of(batch.column("text"), k), batch.column("s1").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "tokens": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run


def overlaps(q: list[np.ndarray], m: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """|a & b| for all a in q and b in m, as products of incidence matrices over the tokens that both sides hold."""
    qs, ms = np.concatenate(q), np.concatenate(m)
    both = np.intersect1d(qs, ms)
    out = np.zeros((len(q), len(m)), np.float32)
    if not len(both):
        return out

    def places(all_: np.ndarray, one: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(one)), [len(x) for x in one])
        col = np.minimum(np.searchsorted(both, all_), len(both) - 1)
        hit = both[col] == all_
        order = np.argsort(col[hit], kind="stable")
        return row[hit][order], col[hit][order]

    (qr, qc), (mr, mc) = places(qs, q), places(ms, m)
    step = max(1, cells // max(len(q), len(m)))
    for lo in range(0, len(both), step):
        parts = []
        for r, c, n in ((qr, qc, len(q)), (mr, mc, len(m))):
            a, b = np.searchsorted(c, [lo, lo + step])
            x = np.zeros((n, min(step, len(both) - lo)), np.float32)
            x[r[a:b], c[a:b] - lo] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def forest(linked: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what linked (len(q) x len(m)) connects: a breadth-first tree of each component, level by level."""
    a: list[int] = []
    b: list[int] = []
    open_q, open_m = linked.any(1), linked.any(0)
    while open_q.any():
        rows = np.flatnonzero(open_q)[:1]
        open_q[rows] = False
        while len(rows):
            cols = np.flatnonzero(open_m & linked[rows].any(0))
            open_m[cols] = False
            a += q[rows[linked[np.ix_(rows, cols)].argmax(0)]].tolist() if len(cols) else []
            b += m[cols].tolist()
            if not len(cols):
                break
            rows = np.flatnonzero(open_q & linked[:, cols].any(1))
            open_q[rows] = False
            if len(rows):
                a += q[rows].tolist()
                b += m[cols[linked[np.ix_(rows, cols)].argmax(1)]].tolist()
    return a, b


def opener(num: int, den: int) -> Kernel:
    """Links of each block, whose rows (g, qb, mb, query, id, tokens) come together, queries last."""

    def links(rows: list[tuple]) -> tuple[list[int], list[int]]:
        sides: list[dict[int, np.ndarray]] = [{}, {}]
        for *_, query, i, tokens in rows:
            if tokens:
                sides[query][i] = np.frombuffer(tokens, np.uint64)
        m, q = sides
        if not m or not q:
            return [], []
        both = overlaps(list(q.values()), list(m.values()))
        size = [np.array([len(x) for x in side.values()], np.float64) for side in (q, m)]
        linked = (both > 0) & (den * both.astype(np.float64) >= num * (size[0][:, None] + size[1][None, :] - both))
        ids = np.array(list(q)), np.array(list(m))
        linked &= ids[0][:, None] != ids[1][None, :]
        return forest(linked, *ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for r in zip(*(batch.column(c).to_pylist() for c in ("g", "qb", "mb", "query", "id", "tokens")), strict=True):
                if rows and r[:3] != rows[0][:3]:
                    x, y = links(rows)
                    a += x
                    b += y
                    rows = []
                rows.append(r)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        if rows:
            x, y = links(rows)
            yield pa.RecordBatch.from_pydict({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return run


def blocked(rows: DataFrame, num: int, den: int) -> DataFrame:
    """rows (g, id, n) with their block: of each group and size band as many as BLOCK tokens and SIDE sets need. Totals are aggregates and the
    block a hash, so that no task sees a whole group."""
    band = F.floor(F.log(F.col("n")) / float(np.log(den / num))) if num < den else F.col("n").cast("long")
    rows = rows.withColumn("band", band)
    totals = saved(rows.groupBy("g", "band").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / SIDE)).alias("parts")), "totals")
    rows = rows.join(totals, ["g", "band"])
    return saved(rows.select("g", "id", "n", (F.col("band") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), "blocks")


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, tie (a hash of the text) and first (whether the row's doc_id and tie are the component's
    least, a null doc_id last) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = saved(docs.mapInArrow(sketcher(k), "doc_id long, tie long, n long, s1 long, s2 long, bands array<long>"), "sketches")
    # a class of equal sets is a node, named by what identifies the set; of its rows the one with the least doc_id stands for it
    node = F.xxhash64("n", "s1", "s2").alias("id")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(who).alias("who"), F.any_value("bands").alias("bands"))
    classes = saved(classes.select(node, "n", "s1", "who", "bands"), "classes")

    # groups of similar classes
    buckets = classes.select("id", F.explode("bands").alias("band"))
    leaders = buckets.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("band", "lead")
    groups = buckets.join(leaders, "band").groupBy("id").agg(F.min("lead").alias("grp"))
    reps = saved(classes.join(groups, "id", "left").select("id", "s1", F.coalesce("grp", "id").alias("grp"), F.col("who.doc_id").alias("d"), F.col("who.tie").alias("t")), "reps")
    stands = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))
    twice = not rows.groupBy("doc_id", "tie").count().where("count > 1").isEmpty()

    def texts_of(of: DataFrame, *columns: str) -> DataFrame:
        found = docs.join(of, stands).select("id", *columns, "text")
        return found.dropDuplicates(["id"]) if twice else found  # a row that repeats stands for its class once

    # the token-group matrix
    least = L if 2 * num > den else 1
    total = rows.agg(F.sum("n")).first()[0] or 0
    counts = spark.sparkContext.broadcast(token_counts(docs, k, total))
    prefix = texts_of(reps, "s1", "grp").mapInArrow(prefixer(k, num, den, least, counts), "token long, id long, grp long, n int, short boolean").repartition("token")
    shared = prefix.groupBy("token").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("token")
    rare = saved(prefix.join(shared, "token", "left_semi"), "rare")
    matrix = rare.where("short").select("token", F.col("grp").alias("g")).distinct()
    bound = rare.join(matrix, "token").groupBy("id", "n", "grp", "g").count().where(f"count >= {least}")
    members = saved(rare.where("short").groupBy("id", "n", F.col("grp").alias("g")).count().where(f"count >= {least}").select("g", "id", "n"), "members")
    # a group's only member may be another set than the query, since a query is bounded with more of its tokens than a member
    several = members.groupBy("g").agg(F.count("*").alias("c"), F.min("id").alias("only"))
    opened = saved(bound.drop("count").join(several, "g").where("c > 1 or only <> id").select("g", "id", "n"), "opened")

    # blocks of queries and of members by size band and hash, and those pairs of blocks whose sizes allow links
    queries, members = blocked(opened, num, den), blocked(members, num, den)
    q = queries.groupBy("g", "block").agg(F.min("n").alias("ql"), F.max("n").alias("qh")).withColumnRenamed("block", "qb")
    m = members.groupBy("g", "block").agg(F.min("n").alias("ml"), F.max("n").alias("mh")).withColumnRenamed("block", "mb")
    meet = saved(q.join(m, "g").where(f"qh >= ml and {den} * mh >= {num} * ql").select("g", "qb", "mb"), "meetings")
    queries = queries.select("g", F.col("block").alias("qb"), F.lit(1).alias("query"), "id").join(meet, ["g", "qb"])
    members = members.select("g", F.col("block").alias("mb"), F.lit(0).alias("query"), "id").join(meet, ["g", "mb"])
    sides = saved(queries.select("g", "qb", "mb", "query", "id").union(members.select("g", "qb", "mb", "query", "id")), "sides")
    wanted = reps.join(sides.select("id").distinct(), "id").select("id", "s1", "d", "t")
    sets = saved(texts_of(wanted, "s1").mapInArrow(setter(k), "id long, tokens binary"), "sets")
    dealt = sides.join(sets, "id").select("g", "qb", "mb", "query", "id", "tokens").repartition("g", "qb", "mb").sortWithinPartitions("g", "qb", "mb", "query", "id")
    links = saved(dealt.mapInArrow(opener(num, den), "a long, b long"), "links")

    labels = components(links).withColumnRenamed("node", "id")
    of = saved(classes.join(labels, "id", "left").select("id", "who", F.coalesce("label", "id").alias("label")), "labelled")
    best = of.groupBy("label").agg(F.min("who").alias("best"))
    of = saved(of.select("id", "label").join(best, "label").select(F.col("id").alias("of"), "best"), "components")
    out = rows.select("doc_id", "tie", "n", F.when(F.col("n") > 0, node).alias("id")).join(of, F.col("id") == F.col("of"), "left")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    linked = F.col("of").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "tie", (~linked | own.eqNullSafe(F.col("best"))).alias("first"))
