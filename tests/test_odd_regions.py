"""Clustering of regions whose vectors or ids are missing or not finite, and of none."""

import numpy as np
import pytest

from fluxgrain.operators import clustering as C
from fluxgrain.plans.all_queries import FLAGSHIP  # noqa: F401  (registers all queries)
from fluxgrain.plans.registry import QUERIES

PLAIN = [[float(np.sin((i % 4 + 1) * (t + 1) * 0.9) + 0.01 * np.cos(i * t)) for t in range(16)] for i in range(12)]
ODD = [None, [], [float("nan"), *PLAIN[0][1:]], [None, *PLAIN[0][1:]], [float("inf"), *PLAIN[0][1:]]]


def embeddings(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(i, x, i % 2 + 1) for i, x in enumerate(PLAIN)] + [(100 + i, x, 1) for i, x in enumerate(ODD)] + [(None, PLAIN[1], 1)]
    return embeddings(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return embeddings(spark, tmp_path_factory.mktemp("none"), [])


def test_flat_clusters_of_odd_regions(spark, odd, none):
    got = [(r["roi"], r["cluster"]) for r in QUERIES["q_fcluster"](spark, odd).collect()]
    assert sorted(got, key=str) == sorted(set(got), key=str) and {r for r, _ in got} == {*range(12), *range(100, 105), None}
    of = dict(got)
    for i in range(4):  # what is alike stays together, and odd vectors join none of it
        assert len({of[j] for j in range(i, 12, 4)}) == 1 and of[i] not in {of[100 + j] for j in range(5)}
    assert of[None] == of[1]
    assert QUERIES["q_fcluster"](spark, none).collect() == []


def test_odd_vectors_are_as_far_as_constant_ones(spark):
    for kind, method in (("correlation", "average"), ("euclidean", "ward")):
        rows = spark.createDataFrame(list(enumerate(PLAIN + ODD)), "roi long, xs array<double>")
        flat = spark.createDataFrame(list(enumerate(PLAIN + [[3.0] * 16] * len(ODD))), "roi long, xs array<double>")
        assert np.allclose(C.linkage(rows, kind, method)[1], C.linkage(flat, kind, method)[1])


def test_vectors_of_several_lengths_are_named(spark):
    with pytest.raises(ValueError, match="several lengths"):
        C.linkage(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "roi long, xs array<double>"))


def test_leaf_colours_of_odd_regions(spark, odd, none):
    rows = QUERIES["q_leaf_colours"](spark, odd).collect()
    assert sorted(r["position"] for r in rows) == list(range(18)) and {r["roi"] for r in rows} == {*range(12), *range(100, 105), None}
    of = {r["roi"]: r["colour"] for r in rows}
    assert of[None] == of[1] == of[5] != "C0"
    assert QUERIES["q_leaf_colours"](spark, none).collect() == []


def test_two_clusters_anew_of_odd_regions(spark, odd, none, tmp_path):
    got = {r["roi"]: r["cluster"] for r in QUERIES["q_recluster"](spark, odd).collect()}
    assert set(got) == {*range(12), *range(100, 105)}  # clusters name their regions by id
    assert QUERIES["q_recluster"](spark, none).collect() == []
    others = embeddings(spark, tmp_path, [(i, x, 5) for i, x in enumerate(PLAIN)])
    assert QUERIES["q_recluster"](spark, others).collect() == []  # none of the two clusters is there
