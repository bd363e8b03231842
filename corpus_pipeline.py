"""The corpus pipeline: documents without toxic texts, copies, near copies and benchmark passages, mixed by source.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again as the next stage's docs. All stages but the last return the columns of documents.

1. toxicity: documents whose expected severity reaches the threshold go.
2. exact_dedup: of texts equal without white space one stays, the longest, then that of the smallest doc_id.
3. ngram_join: of documents connected by similarities of 0.8 or more on five-word shingles that of the smallest doc_id stays.
4. decontamination: documents with a passage of the benchmark go.
5. mixing: the mix itself. A document has a row for each epoch that takes words of it; mix_epoch, mix_words and mix_target are
   added, and the document at a source's cut has its leading words only.

Defined cases: documents are told apart by doc_id and text, so that null or repeated doc_ids drop nothing else; null and empty
texts are not toxic, are one class of copies of which one stays, link with nothing, and leave the mix, which takes words; very long
texts are taken whole; of repeated rows one stays; with empty tables each stage gives an empty table, without labels nothing is
toxic; other columns pass all stages, whatever their names (but columns named as the three of the mix are replaced).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrain.llm import decontam, exact_dedup, mixing, ngram_join, toxicity
from fluxgrain.llm.common import WS_CHARS, saved, scratch, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def text_tie() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text (its hash, tie) aren't in gone. A merge join at every size: gone grows with docs."""
    gone = saved(gone.select(F.col("doc_id").alias("_fg_gone"), F.col("tie").alias("_fg_tie")).distinct(), "gone")
    return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_fg_gone")) & (text_tie() == F.col("_fg_tie")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = saved(exact_dedup.dedup(docs), "dedup")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = saved(found.where("not kept").select(F.col("doc_id").alias("_fg_gone")), "gone")
        return docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_fg_gone")), "left_anti")
    # a doc_id that repeats doesn't name a row: its text must, and of equal rows one stays
    kept = found.where("kept").select(F.col("doc_id").alias("_fg_d"), F.col("text_sha256").alias("_fg_s")).distinct()
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), WS_CHARS, "").cast("binary"), 256)
    rows = docs.withColumn("_fg_sha", sha).withColumn("_fg_size", F.length(F.coalesce("text", F.lit(""))))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_fg_d")) & (F.col("_fg_sha") == F.col("_fg_s")), "left_semi")
    most = rows.groupBy(F.col("doc_id").alias("_fg_d2"), F.col("_fg_sha").alias("_fg_s2")).agg(F.max("_fg_size").alias("_fg_most"))
    same = F.col("doc_id").eqNullSafe(F.col("_fg_d2")) & (F.col("_fg_sha") == F.col("_fg_s2")) & (F.col("_fg_size") == F.col("_fg_most"))
    return rows.join(most, same, "left_semi").dropDuplicates(["doc_id", "_fg_sha"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, ngram_join.join(docs, k=5, num=80, den=100).where("not first"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):  # what a stage saves on its way goes once its result is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs


#: None: SQL can't express the fitted model of the first stage.
ORACLE_SQL = None
