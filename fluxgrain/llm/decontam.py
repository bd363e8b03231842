"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts are lower-cased and cut into words of letters and digits. A mask is fixed: it looks at some words of a span and ignores the
rest. The masked hashes of all positions of all documents are joined with those of the benchmark's items. A hit names an
alignment of a document with an item (document, item, offset). Alignments are then verified on the words: some window of WINDOW
item words (the whole item where it is shorter) must agree in at least AGREE of 100 positions.

Which masks serve an item depends on its number of words n, so that whatever words were substituted some mask meets the overlap:

* n >= LONG: two masks of four words in a span of eight. Every window of 15 words or more that passes is hit (all 4845 choices of
  4 in 20 and 455 of 3 in 15 are).
* 10 <= n < 15, two substitutions at most: three masks, each looking at one third of the item.
* 5 <= n < 10, one substitution at most: three masks, each ignoring one third of the item.
* n < 5, no substitution: one mask, the whole item.

Masks that no item needs are not hashed. Seeds of one benchmark are broadcast only after they have been counted and found to be at
most BROADCAST_ROWS (32 bytes each), and then hits take along the words beside the item, so that documents are read once and only
hits move; beyond that the join is dealt by hash and documents are read again for their hits' words.

Defined cases: null and empty texts have no words and no hits; rows that share doc_id and text are one document, other texts of a
doc_id (or of a null one) are documents of their own with rows of their own; items with the same item_id and words are one; very
long texts are hashed and joined whole; ties between alignments go to more agreeing words, then the earlier start; empty tables
give an empty result; extra columns are ignored by hits() and pass through decontaminate().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrain.llm.common import saved

LONG = 15
MASKS = ((0, 1, 2, 7), (0, 1, 3, 7))
SPAN = 8
WINDOW = 20
AGREE = 80
BROADCAST_ROWS = 2_000_000
#: Items under LONG words may have as many of them beyond a document's ends.
EDGE = 2


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def thirds(n: int) -> list[tuple[int, ...]]:
    cuts = [round(n * i / 3) for i in range(4)]
    return [tuple(range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(n: int) -> list[tuple[int, ...]]:
    """The masks for items of n words: the offsets that each looks at, the span's first word included or not."""
    if n >= LONG:
        return list(MASKS)
    if n >= 10:
        return thirds(n)
    if n >= 5:
        return [tuple(i for i in range(n) if i not in third) for third in thirds(n)]
    return [tuple(range(n))]


def seeds(rows: DataFrame, lengths: list[int], own: bool) -> DataFrame:
    """rows (words, others) as others, p, h: the hash h of a mask whose span begins at word p. With own, the rows are items, which
    have the masks for their own length only, short ones at their start only; without, all masks for the given lengths everywhere."""
    others = [c for c in rows.columns if c != "words"]
    hashed = rows.select(*others, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    at = hashed.select(*others, "n", "w", F.posexplode("w").alias("p", "first"))
    found = []
    for size in sorted({min(n, LONG) for n in lengths}):
        for k, mask in enumerate(masks(size)):
            span = SPAN if size >= LONG else size
            there = F.col("p") + span <= F.col("n")
            if own:
                there &= (F.col("n") >= LONG) if size >= LONG else (F.col("n") == size) & (F.col("p") == 0)
            h = F.xxhash64(F.lit(size), F.lit(k), *(F.get("w", F.col("p") + o) for o in mask))
            found.append(F.when(there, h))
    # one row a mask: made inside the generated code, from values that are there
    h = F.explode(F.array(*found)).alias("h")
    return at.select(*others, "p", h).where("h is not null")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word of the document where the item would begin), matched, item_words, tie (a hash of the document's
    text): the best alignment of each document with each item."""
    items = benchmark.select("item_id", F.array_remove(words_of(F.col("text")), "").alias("words")).where(F.size("words") > 0).distinct()
    lengths = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(LONG)).alias("n")).distinct().collect()]  # LONG rows at most
    items = saved(items.withColumn("item_tie", F.xxhash64("words")).withColumn("item_words", F.size("words")), "items")
    b = saved(seeds(items, lengths, True).select("h", "item_id", "item_tie", "item_words", F.col("p").alias("at")).distinct(), "benchmark-seeds")
    few = b.count() <= BROADCAST_ROWS
    tie = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")
    edge = F.array_repeat(F.lit(""), EDGE)
    texts = docs.select("doc_id", tie, F.concat(edge, words_of(F.col("text")), edge).alias("words"))
    start = F.col("p") - F.col("at")  # in the words with their edges
    n = F.col("item_words")
    # beside the item: word j of the item lies at start + j, where that is in the document
    beside = F.concat(F.array_repeat(F.lit(""), F.greatest(-F.col("start"), F.lit(0))), F.slice("cells", F.greatest(F.col("start"), F.lit(0)) + 1, F.greatest(n + F.least(F.col("start"), F.lit(0)), F.lit(0)))).alias("beside")
    key = ["doc_id", "tie", "item_id", "item_tie", "item_words", "start"]
    if few:  # hits are made where the words are, so they take along what lies beside the item
        found = seeds(texts.withColumn("cells", F.col("words")), lengths, False).join(F.broadcast(b), "h").withColumn("start", start)
        pairs = saved(found.select(*key, beside).distinct(), "alignments")
    else:
        found = saved(seeds(texts, lengths, False).join(b, "h").withColumn("start", start).select(*key).distinct(), "alignments")
        again = texts.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), F.col("words").alias("cells"))
        pairs = again.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie"))).select(*key, beside)

    pairs = pairs.drop("item_words").withColumn("start", F.col("start") - EDGE)
    known = items.select(F.col("item_id").alias("i"), F.col("item_tie").alias("it"), F.col("words").alias("item"), "item_words")
    pairs = pairs.join(known, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_tie") == F.col("it"))).drop("i", "it")
    agree = F.transform("item", lambda w, j: F.coalesce((F.get("beside", j) == w).cast("int"), F.lit(0)))
    wide = F.least(n, F.lit(WINDOW))
    sums = F.transform(F.sequence(F.lit(1), n - wide + 1), lambda i: F.aggregate(F.slice("agree", i, wide), F.lit(0), lambda a, x: a + x))
    pairs = pairs.withColumn("agree", agree).withColumn("best", F.array_max(sums)).where(F.col("best") * 100 >= AGREE * wide)
    matched = F.aggregate("agree", F.lit(0), lambda a, x: a + x)
    pairs = pairs.select("doc_id", "tie", "item_id", F.struct(matched.alias("matched"), (-F.col("start")).alias("back"), n.alias("n")).alias("x"))
    best = pairs.groupBy("doc_id", "tie", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).cast("long").alias("start"), F.col("x.matched").cast("long").alias("matched"), F.col("x.n").cast("long").alias("item_words"), "tie")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that have no hit."""
    bad = saved(hits(docs, benchmark).select(F.col("doc_id").alias("_fg_bad"), F.col("tie").alias("_fg_tie")).distinct(), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_fg_bad")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_fg_tie"))
    return docs.join(bad, same, "left_anti")
