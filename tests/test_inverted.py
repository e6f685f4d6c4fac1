"""The inverted file against the exact search."""

import numpy as np
import pytest

from quillspark.operators.inverted import build, nearest_by_bounds, nearest_listed, probes_for, recall, spherical_kmeans, stored, within_reach
from quillspark.operators.retrieve import nearest

SCHEMA = "id long, vec array<float>"


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((12, 16))
    x = middles[rng.integers(0, 12, 600)] + 0.4 * rng.standard_normal((600, 16))
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], SCHEMA).cache()


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_every_row_is_indexed_once_and_recall(spark, groups, tmp_path):
    asked, index = groups.where("id % 20 = 0"), stored(spark, str(tmp_path / "ix"), groups)
    assert index.lists.count() == index.lists.select("id").distinct().count() == 600
    exact = nearest(groups, asked, 5)
    n = probes_for(index, asked, 5)
    assert n < len(index.centroids[16]) / 2
    assert recall(nearest_listed(index, asked, 5, n), exact) >= 0.9
    again = stored(spark, str(tmp_path / "ix"), groups)
    assert np.array_equal(again.centroids[16], index.centroids[16]) and again.n_lists == index.n_lists


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_all_lists_give_the_exact_result(groups, block_rows):
    asked = groups.where("id % 20 = 0")
    index = build(groups, 6)
    assert len(index.centroids[16]) == 6
    assert _rows(nearest_listed(index, asked, 4, 6, block_rows)) == _rows(nearest(groups, asked, 4))


@pytest.mark.parametrize("probes", [1, 3])
def test_bounds_leave_out_lists_and_no_hit(spark, groups, probes):
    asked, index = groups.where("id % 20 = 0"), build(groups, 12)
    assert _rows(nearest_by_bounds(index, asked, 4, probes)) == _rows(nearest(groups, asked, 4))
    radii = {(16, r["list"]): r["away"] for r in index.lists.groupBy("list").agg({"away": "max"}).withColumnRenamed("max(away)", "away").collect()}
    reached = within_reach(asked.selectExpr("*", "0.95D AS least"), index.centroids, radii)
    assert 0 < reached.count() < 30 * 12 and within_reach(asked.selectExpr("*", "-0.1D AS least"), index.centroids, radii).count() == 30 * 12


def test_vectors_without_match_lengths_and_repeats(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [1.0, 2.0, 1.0]), (9, [])]
    v = spark.createDataFrame(rows, SCHEMA)
    index = build(v)
    assert sorted(r["id"] for r in index.lists.collect()) == [1, 2, 2, 7, 8]
    got = _rows(nearest_listed(index, v, 2, probes_for(index, v, 2)))
    assert got == _rows(nearest(v, v, 2)) == _rows(nearest_by_bounds(index, v, 2))
    assert {(q, i) for q, _, i, _ in got} == {(1, 2), (2, 1), (7, 8), (8, 7)}


def test_one_list_of_equal_vectors(spark):
    v = spark.createDataFrame([(k, [0.5, 0.5]) for k in range(300)], SCHEMA)
    index = build(v)
    assert _rows(nearest_listed(index, v.where("id < 3"), 2, probes_for(index, v, 2), 50)) == [(q, r + 1, i, 1.0) for q in range(3) for r, i in enumerate([k for k in range(3) if k != q])]


def test_empty_tables(spark, groups, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = stored(spark, str(tmp_path / "ix"), none)
    assert probes_for(index, groups, 3) == 1 and nearest_listed(index, groups, 3, 1).count() == nearest_by_bounds(index, groups, 3).count() == 0
    assert nearest_listed(build(groups), none, 3, 1).count() == 0
    assert recall(nearest(none, none, 3), nearest(none, none, 3)) == 1


def test_centroids_are_unit_vectors():
    x = np.eye(4, dtype=np.float32).repeat(10, axis=0)
    assert np.allclose(np.linalg.norm(spherical_kmeans(x, 4), axis=1), 1)
