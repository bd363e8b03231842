"""Mixing sources to target weights.

Every row gets a hash-random key, ``md5(seed : doc_id)``, of the text where there is no doc_id. Each source is range-sorted by the
key: the key's leading hex digits name one of 4096 ranges, so that a source of any share of the rows is cut into that many
stretches. Prefix sums of the sizes are distributed: sums by (source, range), a running total over those few rows of a source, and
a running sum inside each range. The whole epochs that a target holds repeat every document of the source; the rest is cut from
the sorted order at exactly the source's budget, the document at the cut giving its leading words only.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating, and share 150% of all sizes. A target stops at twice its
source's size; the excess is shared again by weight. In closed form, with sources ordered by (2 * size / weight), the saturated
ones are a prefix of that order.

Defined cases: null text has size 0 and takes 0; null sources are one source; ties of the key go by doc_id and then text, so
that reruns agree; repeated rows count each and cost one row each; very long texts are counted whole; if all sizes are 0 all targets
are 0; an empty table gives an empty result; extra columns are ignored by mix() and pass through mixed(), whose own are named
mix_epoch, mix_words and mix_target. The table of sources (one row each) is assumed to be small beside the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrain.llm.common import WORD_CLASS, WS_CLASS, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from source, source_size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("cap", (CAP * F.col("source_size")).cast("double"))
    ranked = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, every = ranked.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left", F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # the level at which the sources from here on share what those before leave; of the levels that a source's own cap allows,
    # which fall along the order, the first holds
    s = s.withColumn("level", F.max(F.when(F.col("left") / F.col("open") * F.col("weight") <= F.col("cap"), F.col("left") / F.col("open"))).over(every))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def planned(rows: DataFrame) -> DataFrame:
    """rows (a table, read twice; _fg_key, _fg_id, _fg_tie, _fg_source, _fg_range, _fg_size and any others) with _fg_source_size, _fg_target,
    _fg_epochs (whole ones) and _fg_part (words of the last epoch, which is cut)."""
    ranges = rows.groupBy(F.col("_fg_source").alias("source"), F.col("_fg_range").alias("range")).agg(F.sum("_fg_size").alias("range_size"))
    sources = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0))).withColumnRenamed("source", "s")
    plan = ranges.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    plan = saved(plan.select(*(F.col(c).alias(f"_fg_p_{c}") for c in plan.columns)), "mixing-plan")
    given = rows.columns
    # the join and the window are dealt by the same columns, none of them null, so that rows move once, at every size
    key = ["_fg_none", "_fg_name", "_fg_range"]
    named = lambda df, c: df.withColumn("_fg_none", F.col(c).isNull()).withColumn("_fg_name", F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = named(rows, "_fg_source").join(named(plan, "_fg_p_s").withColumnRenamed("_fg_p_range", "_fg_range").hint("merge"), key)
    inside = Window.partitionBy(*key).orderBy("_fg_key", "_fg_id", "_fg_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_fg_inside", F.coalesce(F.sum("_fg_size").over(inside), F.lit(0)))
    total, target = F.col("_fg_p_source_size"), F.col("_fg_p_target")
    epochs = F.when(total > 0, F.floor(target / total)).otherwise(0)
    budget = F.floor(target) - epochs * total
    part = F.greatest(F.lit(0), F.least(F.col("_fg_size"), budget - F.col("_fg_p_before") - F.col("_fg_inside")))
    return rows.select(*(F.col(f"`{c}`") for c in given), total.alias("_fg_source_size"), target.alias("_fg_target"), epochs.alias("_fg_epochs"), part.alias("_fg_part"))


def keyed(docs: DataFrame, seed: int) -> list[Column]:
    """What planned() needs of each row. Rows without an id are spread by their text."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_CLASS)).cast("long")
    own = F.coalesce(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary"))
    return [F.col("doc_id").alias("_fg_id"), F.xxhash64("text").alias("_fg_tie"), F.col("source").alias("_fg_source"), size.alias("_fg_size"), key.alias("_fg_key"), F.substring(key, 1, 3).alias("_fg_range")]


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, tie (a hash of the text) for each row of docs."""
    rows = planned(saved(docs.select(*keyed(docs, seed)), "mixing"))
    taken = (F.col("_fg_epochs") * F.col("_fg_size") + F.col("_fg_part")).cast("long")
    named = [F.col(f"_fg_{c}").alias(c) for c in ("size", "source_size", "target")]
    return rows.select(F.col("_fg_id").alias("doc_id"), *named, taken.alias("taken"), F.col("_fg_source").alias("source"), F.col("_fg_tie").alias("tie"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix: the columns of docs, a row for each epoch that takes words of a document, and mix_epoch (from 0), mix_words (words
    of the row), mix_target (its source's; columns so named are replaced). In the epoch that is cut, the document at the cut has
    its leading words only."""
    rows = planned(docs.select("*", *keyed(docs, seed)))
    whole = F.transform(F.sequence(F.lit(1), F.col("_fg_epochs").cast("int")), lambda i: F.struct((i - 1).cast("int").alias("epoch"), F.col("_fg_size").alias("words")))
    none = F.expr("cast(array() as array<struct<epoch: int, words: bigint>>)")
    last = F.array(F.struct(F.col("_fg_epochs").cast("int").alias("epoch"), F.col("_fg_part").cast("long").alias("words")))
    taken = F.concat(F.when((F.col("_fg_epochs") > 0) & (F.col("_fg_size") > 0), whole).otherwise(none), F.when(F.col("_fg_part") > 0, last).otherwise(none))
    rows = rows.withColumn("_fg_take", F.explode(taken))
    words = F.regexp_extract_all("text", F.lit(f"{WS_CLASS}*{WORD_CLASS}"), F.lit(0))
    n = F.col("_fg_take.words")
    text = F.when(n < F.col("_fg_size"), F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")).otherwise(F.col("text")).alias("text")
    added = {"mix_epoch": F.col("_fg_take.epoch"), "mix_words": n, "mix_target": F.col("_fg_target")}
    given = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in added]
    return rows.select(*given, *(x.alias(c) for c, x in added.items()))


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s
), r AS (
  SELECT *, {SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER q, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER q, 0) AS open
  FROM w WINDOW q AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, max(CASE WHEN rest / open * weight <= cap THEN rest / open END) OVER () AS level FROM r
), t AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l
), p AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken, source FROM p
"""
