"""The pipeline against a plain composition of its stages, and the llm queries on the smallest tables."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluxgrain.llm import queries
from tests.llm.test_ops import docs, labelled, plain_dedup, plain_hits, plain_join, random_words


def write(spark, folder, name, df):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(11)
    rows, marks = labelled(rng, 500)
    item = " ".join(random_words(rng, 30, 100000))
    base = random_words(rng, 80, 100000)
    one = next(i for i, _, t in marks if not t)
    rows += [(500, rows[one][1]), (501, rows[one][1].replace(" ", "  ")), (502, "x y " + item + " z"), (503, " ".join(base)), (504, " ".join([*base[:-1], "other"])), (505, None), (506, "")]
    src = lambda i: ["hot", "hot", "a", "b", None][i % 5]
    d = docs(spark, [(i, t, src(i)) for i, t in rows], extra=False)
    write(spark, tmp_path, "documents", d)
    write(spark, tmp_path, "labels", spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    write(spark, tmp_path, "benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    toxic = {i for i, _, t in marks if t}
    left = [(i, t) for i, t in rows if not re.search(r"\bvile", t or "")]
    assert {i for i, _ in rows} - {i for i, _ in left} == toxic
    left = [(i, t) for (i, t), r in zip(left, plain_dedup(left), strict=True) if r[3]]
    assert {501, 505} <= {i for i, _ in left} and not {one, 500} & {i for i, _ in left}
    left = [(i, t) for (i, t), r in zip(left, plain_join(left, 5, 80, 100), strict=True) if r[0] == r[2]]
    assert 503 in {i for i, _ in left} and 504 not in {i for i, _ in left}
    leaks = {i for i, _ in plain_hits(left, [(1, item)])}
    assert leaks == {502}
    left = [(i, t) for i, t in left if i not in leaks]
    assert {r["doc_id"] for r in out} <= {i for i, _ in left}
    sizes, taken = {}, {}
    for i, t in left:
        sizes[src(i)] = sizes.get(src(i), 0) + len((t or "").split())
    by_id = {}
    for r in out:
        n = len(r["text"].split())
        assert 0 < n == r["mix_words"]
        by_id[r["doc_id"]] = by_id.get(r["doc_id"], 0) + n
        taken[r["source"]] = (taken.get(r["source"], (0, 0))[0] + n, r["mix_target"])
    assert all(by_id.get(i, 0) <= 2 * len((t or "").split()) for i, t in left)
    assert all(abs(a - b) < 1 for a, b in taken.values())
    assert sum(a for a, _ in taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=len(sizes))


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "decontamination", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_repeated_ids_in_exact_dedup(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (2, "abc"), (None, "n"), (None, "n"), (None, "m")]
    got = corpus_pipeline.drop_copies(spark, docs(spark, rows, extra=False), "")
    assert sorted((repr(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", "a b c"), ("1", "other"), ("None", "m"), ("None", "n")]


@pytest.fixture
def side_tables(spark, tmp_path):
    write(spark, tmp_path, "labels", spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"))
    write(spark, tmp_path, "benchmark", spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string"))
    return str(tmp_path)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, side_tables, stage):
    assert stage(spark, docs(spark, [], extra=False), side_tables).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_stages_keep_clean_rows_of_null_and_repeated_ids_and_other_columns(spark, side_tables, stage):
    clean = [(None, "one of its own"), (None, "two by itself"), (7, "third kind"), (7, "fourth text " * 9), (8, "fifth")]
    d = docs(spark, clean)
    out = stage(spark, d, side_tables)
    assert out.columns == d.columns
    assert sorted((repr(r["doc_id"]), r["text"]) for r in out.collect()) == sorted((repr(i), t) for i, t in clean)


def test_near_copies_and_leaks_of_null_ids(spark, side_tables):
    import random

    words = random_words(random.Random(3), 50, 100000)
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(None, " ".join(words)), (None, "clean"), (4, " ".join([*words[:-1], "else"])), (None, "see " + item)]
    near = corpus_pipeline.drop_near_copies(spark, docs(spark, rows, extra=False), "")
    assert {(r["doc_id"], r["text"]) for r in near.collect()} == {rows[1], rows[2], rows[3]}
    leaks = corpus_pipeline.drop_leaks(spark, docs(spark, rows, extra=False), side_tables)
    assert {(r["doc_id"], r["text"]) for r in leaks.collect()} == set(rows[:3])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    import duckdb

    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*map(F.col, cols)).collect())
    if name in queries.SQL:
        con = duckdb.connect()
        for t in ("documents", "pages", "conversations", "labels", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        cur = con.execute(queries.SQL[name])
        names = [d[0] for d in cur.description]
        assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
    else:
        n = spark.read.parquet(f"{sf}/{'pages' if name == 'op5_html_text' else 'documents'}.parquet").count()
        assert len(got) == n or name == "op10_decontamination" and 0 < len(got) < n
