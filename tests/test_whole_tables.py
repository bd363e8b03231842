"""Queries over all regions: they hold every pair, and agree with plain products where SQL would be too slow."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from fluxgrain.plans.all_queries import FLAGSHIP  # noqa: F401  (registers all queries)
from fluxgrain.plans.registry import QUERIES
from fluxgrain.sources.standins import cluster, trace_arrays

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")


def test_curves_of_all_pairs(spark, sf):
    arrays = {r["roi"]: np.array(r["xs"], float) for r in trace_arrays(spark, sf).collect()}
    z = {i: (x - x.mean()) / x.std() for i, x in arrays.items()}
    got = {}
    for r in QUERIES["q_xcorr_curve"](spark, sf).toLocalIterator():
        got.setdefault((r["roi_a"], r["roi_b"]), {})[r["k"]] = r["r"]
    assert set(got) == {(a, b) for a in z for b in z if a < b}
    for (a, b), curve in got.items():
        assert set(curve) == set(range(-10, 11))
        for k in (-10, -3, 0, 7):
            x, y = (z[a][k:], z[b][: len(z[b]) - k]) if k >= 0 else (z[a][:k], z[b][-k:])
            assert curve[k] == pytest.approx(x @ y / 64, abs=2e-6)


def test_cluster_pair_stats_hold_all_regions(spark, sf):
    n = {}
    for r in cluster(spark, sf).groupBy("cluster").count().collect():
        n[r["cluster"]] = r["count"]
    got = {r["pair"]: r["n"] for r in QUERIES["q_cluster_pair_stats"](spark, sf).collect()}
    assert got == {f"{a}x{b}": n[a] * n[b] for a in n for b in n if a < b and n[a] * n[b] >= 10}


def test_merged_rois_come_from_all_regions(spark, sf):
    ids = [r["roi"] for r in trace_arrays(spark, sf).select("roi").collect()]
    assert max(r["roi"] for r in QUERIES["q_merge_rois"](spark, sf).collect()) >= 120 or max(ids) < 120


def test_wide_file_has_a_column_a_region(spark, sf):
    arrays = {r["roi"]: r["xs"] for r in trace_arrays(spark, sf).collect()}
    rows = QUERIES["q_pivot_wide"](spark, sf).collect()
    assert len(rows) == 64 and all(row[f"roi_{i}"] == pytest.approx(x[row["frame"]], abs=1e-6) for row in rows for i, x in arrays.items())


def test_wide_file_is_written_without_a_dictionary_a_column(spark, sf, tmp_path):
    """A dictionary costs a writer 16 KB a column, which at 1 GB was more than an executor has. The caller's session stays as it is."""
    before = dict(spark.conf.getAll)
    df = QUERIES["q_pivot_wide"](spark, sf)
    df.write.parquet(f"{tmp_path}/wide")
    table = pq.read_table(f"{tmp_path}/wide")
    assert sorted(map(str, table.to_pylist())) == sorted(str(r.asDict()) for r in df.collect())
    chunks = [g.column(i) for f in tmp_path.glob("wide/*.parquet") for g in [pq.ParquetFile(f).metadata.row_group(0)] for i in range(g.num_columns)]
    assert chunks and not any(c.has_dictionary_page for c in chunks)
    assert dict(spark.conf.getAll) == before
