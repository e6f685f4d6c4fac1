import numpy as np
import pytest

from quillspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x string, n int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, 2) for i, v in rows], SCHEMA)


def slow(rows, components=W.COMPONENTS):
    """By a full eigendecomposition of the covariance."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    exact = n * x - s
    c = exact.astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return n, (exact**2).sum(axis=1), c @ vectors / np.sqrt(values), values / (c * c).sum() * n


def checked(got, rows, components=W.COMPONENTS, near=1e-6):
    n, deviation, white, explained = slow(rows, components)
    at = {i: k for k, (i, _) in enumerate(rows)}
    r = white.shape[1]
    assert len(got) == len(rows) * r
    out = np.zeros((len(rows), r))
    for g in got:
        k = at[g.vec_id]
        assert (g.n, g.deviation) == (n, deviation[k])
        assert abs(g.explained / explained[g.component - 1] - 1) < 1e-9 and g.identity_error < 1e-9
        out[k, g.component - 1] = g.whitened
    signs = np.sign((out * white).sum(axis=0))
    assert np.abs(out * signs - white).max() < near


def data(n, dims, seed=1, flat=False):
    rng = np.random.default_rng(seed)
    scale = np.ones(dims) if flat else np.linspace(3, 0.5, dims)
    return [(int(i), v.tolist()) for i, v in enumerate((rng.normal(size=(n, dims)) * scale).astype(np.float32))]


@pytest.mark.parametrize("dims,n,flat", [(64, 700, False), (64, 900, True), (48, 400, False), (5, 60, False), (1, 9, False), (100, 500, True)])
def test_against_eigh(spark, dims, n, flat):
    rows = data(n, dims, flat=flat)
    checked(W.whiten(frame(spark, rows)).collect(), rows)


def test_what_takes_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = data(200, 8)
    bad = [(900, None), (901, [nan] * 8), (902, [inf] + [0.0] * 7), (903, [None] + [1.0] * 7), (904, []), (905, [1.0] * 3)]
    checked(W.whiten(frame(spark, rows + bad)).collect(), rows)


def test_hot_vector_and_wide_spectrum(spark):
    """A third of the rows is one vector, and one direction has a million times the variance of the others."""
    rows = data(300, 40)
    rows = [(i, [1000.0 * v[0], *v[1:]]) for i, v in rows] + [(1000 + k, rows[0][1]) for k in range(150)]
    checked(W.whiten(frame(spark, rows)).collect(), rows)


def test_many_tasks_add_up_in_a_tree(spark, monkeypatch):
    rows = data(120, 6)
    monkeypatch.setattr(W, "FAN_IN", 2)
    fit = W.Centred(frame(spark, rows).repartition(9).select("vec_id", W.as_integers("embedding", 64, 10**6).alias("x")), 6)
    q = np.eye(6)
    x = np.array([[np.floor(64 * np.float32(c)) for c in v] for _, v in rows])
    assert fit.tasks == 9 and np.allclose(fit.times(q), np.cov(x.T, bias=True), rtol=1e-12)


def test_zero_variance_and_edges(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).count() == 0
    got = W.whiten(frame(spark, [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [3.0, 2.0, 5.0])])).collect()
    assert sorted(((r.vec_id, r.component, round(abs(r.whitened), 9), r.explained) for r in got), key=str) == [(1, 1, 0.707106781, 1.0), (1, 1, 0.707106781, 1.0), (None, 1, 1.414213562, 1.0)]


def test_too_large_entries_raise(spark):
    with pytest.raises(Exception, match="too large"):
        W.whiten(frame(spark, [(1, [1e30]), (2, [1.0])])).count()


def test_passes_are_filtered(spark):
    """The recurrence does the work: a few rounds of several passes, and fewer passes than plain subspace iteration takes."""
    rows = data(600, 64, flat=True)
    fit = W.Centred(frame(spark, rows).select("vec_id", W.as_integers("embedding", 64, 10**6).alias("x")), 64)
    x = np.array([[np.floor(64 * np.float32(c)) for c in v] for _, v in rows])
    v = np.cov(x.T, bias=True)
    passes = []
    fit.times = lambda q: passes.append(q.shape) or v @ q
    values, basis = W.leading(fit, 32)
    plain, block = 0, np.linalg.qr(np.random.default_rng(0).standard_normal((64, 48)))[0]
    while plain < 2000:
        plain += 1
        block = np.linalg.qr(v @ block)[0]
        e, u = np.linalg.eigh(block.T @ v @ block)
        pair = block @ u[:, -32:]
        if np.linalg.norm(v @ pair - pair * e[-32:], axis=0).max() <= W.RESIDUAL * e[-1]:
            break
    assert len(passes) < plain / 2
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:32]).max() < 1e-9 * values[0]
