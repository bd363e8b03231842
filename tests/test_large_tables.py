"""Queries over more regions than the smallest tables have."""

import math

import pytest

from fluxgrain.plans.all_queries import FLAGSHIP  # noqa: F401  (registers all queries)
from fluxgrain.plans.registry import QUERIES


def test_top_percent_has_no_bound_on_how_many_it_keeps(spark, tmp_path):
    spark.range(10300).selectExpr("id AS vec_id", "array(CAST(id AS FLOAT)) AS embedding", "CAST(id % 10 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["roi"] for r in QUERIES["q_top_percent"](spark, str(tmp_path)).where("keep").collect()}
    score = lambda v: round(1 / (1 + math.exp(-(2.3662 + 1.0454 * (v % 11 - 4.079) / 1.146 + 1.1252 * (v % 23 - 11.24) / 4.214 + 0.2987 * (20 + v % 61 - 41.178) / 37.065))), 9)
    least = sorted(map(score, range(10300)), reverse=True)[1029]
    assert len(got) >= 1030 and got == {v for v in range(10300) if score(v) >= least}


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Embeddings of more regions than a matrix of distances was allowed for, half of them copies of 40 vectors."""
    path = str(tmp_path_factory.mktemp("many"))
    xs = "transform(sequence(0, 15), t -> CAST(sin((IF(id % 2 = 0, id % 80, id) + 1) * (t + 1) * 0.37) AS FLOAT)) AS embedding"
    spark.range(6200).selectExpr("id AS vec_id", xs, "CAST(id % 2 AS INT) + 1 AS label").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_linkage_of_many_regions(spark, many):
    rows = QUERIES["q_linkage"](spark, many).orderBy("step").collect()
    assert len(rows) == 6199 and rows[-1]["n"] == 6200
    assert sorted([r["a"] for r in rows] + [r["b"] for r in rows]) == list(range(2 * 6200 - 2))
    dist = [r["dist"] for r in rows]
    assert dist == sorted(dist) and sum(d < 1e-6 for d in dist) >= 3100 - 40


def test_flat_clusters_of_many_regions(spark, many):
    got = {r["roi"]: r["cluster"] for r in QUERIES["q_fcluster"](spark, many).collect()}
    assert sorted(got) == list(range(6200))
    for first in range(0, 80, 2):  # copies stay together
        assert len({got[i] for i in range(first, 6200, 80)}) == 1


def test_leaf_colours_of_many_regions(spark, many):
    rows = QUERIES["q_leaf_colours"](spark, many).collect()
    assert sorted(r["position"] for r in rows) == sorted(r["roi"] for r in rows) == list(range(6200))
    assert {r["colour"] for r in rows} <= {f"C{i}" for i in range(10)} and len({r["colour"] for r in rows}) > 1


def test_two_clusters_of_many_regions_are_clustered_anew(spark, many):
    rows = QUERIES["q_recluster"](spark, many).collect()
    assert sorted(r["roi"] for r in rows) == list(range(6200)) and len({r["cluster"] for r in rows}) > 1
