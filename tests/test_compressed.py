"""Product codes against the exact search."""

import numpy as np
import pytest

from quillspark.operators import compressed
from quillspark.operators.compressed import book_of, build, candidates, decode, encode, nearest_by_codes, nearest_shortlisted, stored
from quillspark.operators.inverted import recall
from quillspark.operators.retrieve import nearest

SCHEMA = "id long, vec array<float>"


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(5).standard_normal((3000, 16)).astype(np.float32)
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], SCHEMA).cache()


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())


def test_codes_are_small_and_say_how_far_off_they_are(spark, cloud, tmp_path):
    index = stored(spark, str(tmp_path / "ix"), cloud)
    vec = {r["id"]: np.array(r["vec"], float) for r in cloud.collect()}
    rows = index.codes.collect()
    assert sorted(r["id"] for r in rows) == list(range(3000)) and {len(r["code"]) for r in rows} == {16}
    for r in rows[::50]:
        x = vec[r["id"]] / np.linalg.norm(vec[r["id"]])
        off = np.linalg.norm(x - decode(np.frombuffer(r["code"], np.uint8)[None], index.books[16], 16)[0])
        assert off <= r["error"] <= off + 1e-6 and r["norm"] == pytest.approx(np.linalg.norm(vec[r["id"]]))
    assert np.mean([r["error"] for r in rows]) < 0.02
    again = stored(spark, str(tmp_path / "ix"), cloud)
    assert np.array_equal(again.books[16], index.books[16])


def test_encoding_takes_the_nearest_words():
    x = np.random.default_rng(1).standard_normal((40, 5))
    full = np.pad(x, ((0, 0), (0, 1)))
    book = book_of(full.reshape(40, 3, 2), 6)
    codes = encode(x, book)
    for row, code in zip(full, codes, strict=True):
        for p in range(3):
            left = row[2 * p : 2 * p + 2]
            for level in range(2):
                away = ((book[level, p] - left) ** 2).sum(axis=1)
                assert away[code[3 * level + p]] == pytest.approx(away.min())
                left = left - book[level, p][code[3 * level + p]]
    assert np.allclose(decode(codes, book, 5)[0], [sum(book[v, c // 2, codes[0][3 * v + c // 2], c % 2] for v in range(2)) for c in range(5)])


@pytest.mark.parametrize("block_rows", [700, 4096])
def test_codes_leave_out_vectors_and_no_hit(cloud, block_rows):
    asked, index = cloud.where("id % 20 = 0"), build(cloud)
    exact = _rows(nearest(cloud, asked, 5))
    assert _rows(nearest_by_codes(index, asked, 5, block_rows)) == exact
    met = candidates(index, asked, 5, block_rows)
    assert met.where("id is null").count() == 0 and 150 * 5 <= met.count() < 150 * 8


@pytest.mark.parametrize(("most", "in_all"), [(3, 4096), (512, 5)])
def test_queries_with_too_many_candidates_are_answered_too(cloud, most, in_all):
    asked, index = cloud.where("id % 100 = 0"), build(cloud)
    assert _rows(nearest_by_codes(index, asked, 5, 700, most, in_all)) == _rows(nearest(cloud, asked, 5))


def test_recall_of_a_shortlist(cloud):
    asked, index = cloud.where("id % 20 = 0"), build(cloud)
    exact = nearest(cloud, asked, 5).cache()
    assert recall(nearest_shortlisted(index, asked, 5, 15), exact) >= 0.9
    assert _rows(nearest_shortlisted(index, asked, 5, 3000)) == _rows(exact)


def test_vectors_without_match_lengths_repeats_and_tiny_ones(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [1.0, 2.0, 1.0]), (9, []), (10, [float("inf"), 1.0]), (11, [1e-6, 0.0]), (12, [1e-7, 1e-7])]
    v = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", Code string")
    want = _rows(nearest(v, v, 2))
    assert sorted(r["id"] for r in build(v).codes.collect()) == [1, 2, 2, 7, 8, 11, 12]
    assert _rows(nearest_by_codes(build(v), v, 2)) == want
    monkeypatch.setattr(compressed, "BOOK_DIMS", 2)  # vectors of three components get no code words
    index = build(v)
    assert list(index.books) == [2] and {r["error"] >= 1 for r in index.codes.where("dims = 3").collect()} == {True}
    assert _rows(nearest_by_codes(index, v, 2)) == want


def test_copies(spark):
    v = spark.createDataFrame([(k, [0.5, 0.5]) for k in range(300)], SCHEMA)
    got = nearest_by_codes(build(v), v.where("id < 3"), 2, 50, 20)
    assert _rows(got) == [(q, r + 1, i, 1.0) for q in range(3) for r, i in enumerate([k for k in range(3) if k != q])]


def test_empty_tables(spark, cloud, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = stored(spark, str(tmp_path / "ix"), none)
    assert nearest_by_codes(index, cloud, 3).count() == nearest_shortlisted(index, cloud, 3, 9).count() == 0
    assert nearest_by_codes(build(cloud), none, 3).count() == 0
