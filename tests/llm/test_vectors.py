import numpy as np

from quillspark.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cell int"


def slow(rows, cosine=V.COSINE):
    ok = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows if i is not None and v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    label = {i: i for i, _, _ in rows}
    pairs = []
    for k, (i, x, l) in enumerate(ok):
        for j, y, m in ok[k + 1 :]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return {i: (links[i], label[i], label[i] == i) for i, _, _ in rows}


def rows_of(seed, n=300, dims=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    out = []
    for i in range(n):
        v = centres[rng.integers(20)] + rng.normal(size=dims) * rng.choice([0.0, 0.02, 0.25, 0.4, 2.0])
        out.append((i, (v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(3))))
    return out


def found(frame):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in frame.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_against_all_pairs(spark):
    inf, nan = float("inf"), float("nan")
    rows = rows_of(1) + [(900, None, 1), (901, [0.0] * 64, 1), (902, [nan] * 64, 1), (903, [inf] * 64, 1), (904, [1.0] * 63 + [None], 1), (905, [1.0] * 64, None), (906, [1.0] * 64, 1), (907, [2.0] * 64, 1), (908, [1.0] * 3, 1), (909, [1.0] * 3, 1), (910, [], 1), (911, [5.0], 1), (912, [7.0], 1), (913, [-7.0], 1)]
    assert found(V.near_duplicates(frame(spark, rows))) == slow(rows)


def test_full_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.15).tolist(), 0) for i in range(150)] + rows_of(3, 60, 16)[:0] + [(200 + i, [1.0, 2.0, 3.0], 1) for i in range(20)]
    assert found(V.near_duplicates(frame(spark, rows))) == slow(rows)


def test_finer_grids_and_halves(spark, monkeypatch):
    """Results don't depend on how many coordinates the grid uses, nor on coordinates at a cell's middle or border."""
    rows = rows_of(5, 120) + [(500 + i, np.eye(64)[i % 4].tolist(), 0) for i in range(8)] + [(600 + i, [0.5, 0.25, 0.125 * i], 1) for i in range(12)]
    want = slow(rows)
    for dims in (1, 2, 5):
        monkeypatch.setattr(V, "grid_dims", lambda _, d=dims: d)
        assert found(V.near_duplicates(frame(spark, rows))) == want
    monkeypatch.undo()
    assert [V.grid_dims(n) for n in (0, 5_000, 1 << 15, (1 << 15) + 1, 1 << 18, 1 << 21, 1 << 40)] == [2, 2, 2, 3, 3, 4, 8]


def test_each_pair_meets_once_a_block(spark):
    """Rows that a grid brings together, counted: no pair of vectors is in two cells of a block."""
    classes = V.classes_of(frame(spark, rows_of(6, 60)))
    placed = [(r.cell, r.block, r.home, r.node) for r in V.cells(classes).collect()]
    homes = {(b, n): c for c, b, h, n in placed if h}
    asked = {(b, n, c) for c, b, h, n in placed if not h}
    assert len(homes) == 8 * classes.count() and not any(homes[b, n] == c for b, n, c in asked)
    for b, n in homes:
        for m in {m for _, m in homes} - {n}:
            assert ((b, n, homes[b, m]) in asked) + ((b, m, homes[b, n]) in asked) <= 1


def test_edges(spark):
    assert V.near_duplicates(frame(spark, [])).count() == 0
    twice = V.near_duplicates(frame(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)])).collect()
    assert sorted(((r.vec_id, r.n_links) for r in twice), key=str) == [(1, 1), (1, 1), (None, 0)]


def test_rows_that_repeat_an_id_with_other_vectors(spark):
    """Each such row is a vector of its own: links are counted by rows, components go by the smallest vec_id."""
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=64), rng.normal(size=64)
    near = lambda k: (a + 0.05 * rng.normal(size=64) * k).tolist()
    rows = [(1, near(0), 0), (1, near(1), 0), (2, near(1), 0), (3, b.tolist(), 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]

    rows = [(i % 40, v, l) for i, v, l in rows_of(9, 200)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in V.near_duplicates(frame(spark, rows)).collect())
    want = slow([(k, v, l) for k, (_, v, l) in enumerate(rows)])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[want[k][1]] = min(least.get(want[k][1], i), i)
    assert got == sorted((i, want[k][0], least[want[k][1]]) for k, (i, _, _) in enumerate(rows))
