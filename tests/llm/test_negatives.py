import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, group long, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l, 1, "x") for i, v, l in rows], SCHEMA)


def slow(rows, step=100, positives=5, negatives=10, least=30, most=90):
    ok = {(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v), l) for i, v, l in rows if i is not None and l is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for i, x, l in ok:
        if i % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), j, m) for j, y, m in ok if j != i and len(x) == len(y))
        for s, j, _ in [t for t in scored if t[2] == l][:positives]:
            allowed = [(t, k) for t, k, m in scored if m != l and least * -s <= 100 * -t <= most * -s]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(allowed[:negatives])]
    return sorted(out)


def data(n, dims=64, labels=4, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims)) * 0.1
    out = []
    for i in range(n):
        l = int(rng.integers(labels))
        out.append((i, (centres[rng.integers(labels)] + rng.normal(size=dims) * 0.1).astype(np.float32).tolist(), l))
    return out + [(n + k, out[0][1], k % labels) for k in range(copies)]


def found(df, step=100, **more):
    return sorted(tuple(r) for r in N.hard_negatives(df, F.col("vec_id") % step == 0, **more).collect())


@pytest.mark.parametrize("dims", [64, 7, 17])
def test_against_all_scores(spark, dims):
    rows = data(400, dims, copies=60)
    assert found(frame(spark, rows), 20) == slow(rows, 20)


def test_small_slices_and_blocks(spark, monkeypatch):
    """Ties over slices, tasks and blocks of anchors; a third of the rows are copies of one vector."""
    rows = data(300, 16, copies=200, seed=2)
    monkeypatch.setattr(N, "SLICE_SCORES", 1)
    monkeypatch.setattr(N, "BLOCK_ANCHORS", 7)
    assert found(frame(spark, rows).repartition(5), 10) == slow(rows, 10)


def test_what_takes_no_part_and_repeats(spark):
    inf, nan = float("inf"), float("nan")
    rows = data(120, 8) + [(200, None, 1), (300, [nan] * 8, 1), (400, [inf] * 8, 1), (500, [None] * 8, 1), (600, [1.0] * 8, None), (None, [1.0] * 8, 1), (700, [], 1), (800, [0.5] * 3, 1), (801, [0.5] * 3, 2), (802, [0.4] * 3, 1), (100, [0.25] * 8, 3), (5, [0.1] * 8, 2)]
    assert found(frame(spark, rows + rows[:50])) == slow(rows)


def test_edges(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, [1.0], 1)])) == []
    assert found(frame(spark, [(100, [1.0], 1)])) == []
    zero = [(100, [0.0] * 4, 1), (1, [0.0] * 4, 1), (2, [0.0] * 4, 2), (3, [1.0] * 4, 2)]
    assert found(frame(spark, zero)) == slow(zero) == [(100, 1, 1, 2, 0, 0), (100, 1, 2, 3, 0, 0)]
    below = [(100, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]
    assert found(frame(spark, below)) == slow(below) == []


def test_large_entries(spark):
    rows = [(i, [3e6 * (i % 5 - 2), 1.0, -7e5 * i], i % 2) for i in range(40)] + [(100, [5e6, 2.0, -1e6], 1)]
    assert found(frame(spark, rows)) == slow(rows)
    with pytest.raises(OverflowError):
        found(frame(spark, [(100, [1e12] * 4, 1), (1, [1e12] * 4, 1)]))


def test_shift_add_is_exact():
    rng = np.random.default_rng(1)
    for dims, high in ((1, 1), (8, 100), (13, 2**20), (64, 159)):
        x, y = rng.integers(-high, high, (20, dims)), rng.integers(-high, high, (30, dims))
        planes = int(high).bit_length() + 1
        packed = N.bit_planes(y, planes)
        assert (N.from_planes(packed, dims) == y).all()
        assert (N.shift_add(N.subset_sums(x), packed) == y @ x.T).all()


def test_scores_near_and_beyond_64_bits(spark):
    """Entries for which the largest products of the table fit 64 bits not at all, hundredfold, or with a place; what is returned fits."""
    rng = np.random.default_rng(5)
    for size in (1e3, 4e5, 2e6):
        rows = [(i, (rng.normal(size=6) * size).tolist(), i % 2) for i in range(60)]
        assert found(frame(spark, rows), 20) == slow(rows, 20) != []
    # the anchor's own scores are small, other rows' are not; one negative is too large to count
    rows = [(100, [1.0, 0, 2**-8], 1), (1, [1e6, 0, 0], 1), (2, [5e5, 1e12, 0], 2), (3, [-1e6, -1e12, 1], 2), (4, [1e13, 1e12, 1], 2), (200, [1e5, 0, 0], 3), (5, [2e7, 1, 1], 3), (6, [1e7, 1, 2], 2), (7, [1e12] * 3, 2)]
    assert found(frame(spark, rows)) == slow(rows) != []


def test_clamped_scores_are_the_last(monkeypatch):
    rows, planes = N.pd.DataFrame({"vec_id": [1], "label": [1], "packed": [N.bit_planes(np.array([[2**40]]), 42)[0].tobytes()]}), 42
    block, packed = N.AnchorBlock(rows, planes, 1, 2**40), N.bit_planes(np.array([[-(2**40)], [2**40], [3], [2**40]]), planes)
    assert not block.fits
    parts = [(list(at), N._scores(t, packed[at])) for at, t in block.parts(packed, lambda kind: N.subset_sums(block.x, kind))]
    assert [(at, x.tolist()) for at, x in parts] == [([2], [[3 * 2**40]]), ([0, 1, 3], [[-N.LIMIT, N.LIMIT, N.LIMIT]])]
    i, j = N.best_places(parts[1][1], np.array([[True, True, False]]), 5, block.keyed)
    assert j.tolist() == [1, 0]
