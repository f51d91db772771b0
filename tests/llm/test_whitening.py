"""Whitening against dense eigenvectors, and the iteration where it breaks down or restarts."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from bibspark.llm import whitening
from bibspark.llm.whitening import BlockLanczos, fit, op11_embedding_whitening, transform

DATA = "/root/testdata/sf0.001"


def dense(vectors):
    """n, deviations, eigenvalues, eigenvectors and trace by exact sums and a dense matrix."""
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    c = np.array(y, float) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    return n, [sum(a * a for a in row) for row in y], c, e[::-1], q[:, ::-1], np.trace(v)


def test_whole_table(spark):
    table = pq.read_table(f"{DATA}/embeddings.parquet")
    ids, vectors = table["vec_id"].to_pylist(), table["embedding"].to_pylist()
    usable = [k for k, v in enumerate(vectors) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n, deviations, c, e, q, trace = dense([vectors[k] for k in usable])
    rows = op11_embedding_whitening(spark, DATA).collect()
    assert len(rows) == 32 * len(usable)
    at = {ids[k]: j for j, k in enumerate(usable)}
    got = np.zeros((n, 32))
    for r in rows:
        assert (r.n, r.deviation) == (n, deviations[at[r.vec_id]])
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error <= 1e-9
        got[at[r.vec_id], r.component - 1] = r.whitened
    want = c @ q[:, :32] / np.sqrt(e[:32])
    for k in range(32):
        sign = 1 if got[:, k] @ want[:, k] > 0 else -1
        assert got[:, k] * sign == pytest.approx(want[:, k], abs=1e-6)
    assert np.abs(got.T @ got / n - np.eye(32)).max() <= 1e-9


@pytest.mark.parametrize(("d", "rank", "wanted", "block", "basis"), [(40, 40, 5, 3, 512), (60, 4, 8, 8, 512), (200, 200, 6, 4, 20), (30, 30, 30, 7, 512), (5, 1, 3, 2, 512), (300, 300, 10, 12, 60)])
def test_iteration(d, rank, wanted, block, basis):
    """Full rank, breakdown at low rank, restarts of a small basis, the whole spectrum."""
    random = np.random.default_rng(d + rank)
    a = random.standard_normal((d, rank)) * np.geomspace(1, 0.05, rank)
    m = a @ a.T
    run = BlockLanczos(d, wanted, block, basis)
    while not run.done:
        assert np.abs(run.block.T @ run.block - np.eye(run.block.shape[1])).max() < 1e-12
        assert run.basis.shape[1] == 0 or np.abs(run.basis.T @ run.block).max() < 1e-12
        run.absorb(m @ run.block)
        assert run.passes < 400
    e, q = np.linalg.eigh(m)
    assert run.values == pytest.approx(e[::-1][:wanted], abs=1e-11 * e[-1])
    for k in range(min(wanted, rank)):
        assert abs(run.vectors[:, k] @ q[:, -1 - k]) == pytest.approx(1, abs=1e-6)
    assert rank == d or run.breakdowns
    assert basis == 512 or run.restarts


def test_equal_eigenvalues_are_all_found():
    run = BlockLanczos(50, 6, 6)
    while not run.done:
        run.absorb(np.diag([9.0] * 4 + [5.0] * 2 + [1.0] * 44) @ run.block)
    assert run.values == pytest.approx([9, 9, 9, 9, 5, 5], abs=1e-11)


SCHEMA = "vec_id long, embedding array<double>, n string, keep string, `a b` int"


def test_odd_rows(spark):
    """Two lengths, nulls, non-finite and huge entries, an empty vector, repeats, clashing names."""
    random = np.random.default_rng(3)
    two, three = random.normal(size=(30, 2)).tolist(), random.normal(size=(20, 3)).tolist()
    rows = [(k, v, "x", "y", k) for k, v in enumerate(two + three)]
    rows += [(100, None, "x", "y", 1), (101, [1.0, None], "x", "y", 1), (102, [1.0, math.nan], "x", "y", 1), (103, [math.inf, 1.0], "x", "y", 1), (104, [], "x", "y", 1), (105, [1e300, 1.0], "x", "y", 1)]
    rows += [(None, two[0], None, None, None), rows[1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    models = fit(df)
    done = transform(df, models)
    assert done.columns == ["vec_id", "keep", "a b", "n", "deviation", "whitened", "explained", "identity_error"]
    got = done.collect()
    assert len(got) == 52 and {r.vec_id for r in got} == {None, *range(50)}
    for d, vectors in ((2, [*two, two[0], two[1]]), (3, three)):
        n, deviations, _, e, _, trace = dense(vectors)
        here = [r for r in got if len(r.whitened) == d]
        assert sorted(r.deviation for r in here) == sorted(deviations) and {r.n for r in here} == {n}
        assert here[0].explained == pytest.approx(list(e / trace), rel=1e-9)
        assert models[d].identity_error < 1e-9


def test_no_spread_and_no_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = transform(same, fit(same)).collect()
    assert [(r.n, r.deviation, r.whitened) for r in got] == [(2, 0, []), (2, 0, [])]
    none = same.limit(0)
    assert fit(none) == {} and transform(none, {}).count() == 0


def test_low_rank_gives_fewer_components(spark):
    rows = [(k, [float(k), 2.0 * k, -1.0 * k, 5.0]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = fit(df)[4]
    assert len(model.values) == 1 and model.identity_error < 1e-9
    assert model.explained[0] == pytest.approx(1, rel=1e-9)


def test_large_numbers_are_exact(spark):
    """Products beyond 64 bits: exact in between, null where the result does not fit."""
    rows = [(0, [1e9, 0.0]), (1, [-1e9, 1.0]), (2, [0.0, 2.0]), (3, [1e12, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, deviations, *_ = dense([v for _, v in rows])
    got = {r.vec_id: r.deviation for r in transform(df, fit(df)).collect()}
    assert got == {k: v if v < 1 << 63 else None for k, v in enumerate(deviations)}
    small = spark.createDataFrame([(0, [2e7]), (1, [0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    _, deviations, *_ = dense([[2e7], [0.0], [1.0]])
    assert {r.vec_id: r.deviation for r in transform(small, fit(small)).collect()} == dict(enumerate(deviations))
    assert whitening.LARGEST == 2.0**62
