import numpy as np
import pytest

from marketloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=4):
    """(ids, x, n, sums, eigenvalues, vectors, trace) by numpy over all rows at once."""
    fine = [(i, v) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    ids, x = [i for i, _ in fine], np.floor(256 * np.array([v for _, v in fine], np.float32).astype(float)).astype(np.int64)
    u = np.unique(x, axis=0)
    centred = u - u.sum(0) / len(u)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(u))
    return ids, x, len(u), u.sum(0), values[::-1], vectors[:, ::-1], values.sum()


def check(spark, rows, completed):
    df = spark.createDataFrame(rows, SCHEMA)
    logs = []
    fit = whitening.fit
    whitening.fit = lambda *a, **b: logs.append(fit(*a, **b)) or logs[-1]
    try:
        got = whitening.whiten(df).toPandas()
    finally:
        whitening.fit = fit
    ids, x, n, sums, values, vectors, trace = plain(rows)
    assert logs[0].log[1] is completed and len(got) == 4 * len(ids)
    assert (got["n"] == n).all() and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    expected = (x - sums / n) @ (vectors[:, :4] / np.sqrt(values[:4]))
    for c in range(4):
        mine = got[got["component"] == c + 1]
        key = lambda i, w: sorted(zip(i, np.round(w, 6) + 0.0))
        sign = np.sign(logs[0].components[:, c] @ vectors[:, c])
        assert [k[0] for k in key(mine["vec_id"], mine["whitened"])] == sorted(ids)
        a, b = (np.array([w for _, w in sorted(zip(i, v))]) for i, v in ((mine["vec_id"], mine["whitened"]), (ids, sign * expected[:, c])))
        assert np.abs(a - b).max() < 1e-9
        assert abs(mine["explained"].iloc[0] / (values[c] / trace) - 1) < 1e-9
    deviation = dict(zip(ids, ((n * x - sums) ** 2).sum(1).tolist()))
    assert all(deviation[i] == d for i, d in zip(got["vec_id"], got["deviation"]))


def odd_rows(x):
    """Rows of x, some of them twice, and vectors that take no part."""
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(10_000 + i, rows[i][1]) for i in range(0, 50)] + [rows[0]]
    bad = [None] + [[float("nan")] + [0.0] * (x.shape[1] - 1), [None] + [1.0] * (x.shape[1] - 1), [float("-inf")] * x.shape[1]]
    return rows + [(20_000 + i, v) for i, v in enumerate(bad)]


def test_a_flat_spectrum_completes_the_basis(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    check(spark, odd_rows(rng.normal(size=(400, 24)) * np.linspace(1, 2, 24)), True)


def test_a_steep_spectrum_needs_no_full_basis(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    check(spark, odd_rows(3000 * (rng.normal(size=(400, 24)) * 0.2 ** np.arange(24)) @ axes), False)


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert sorted(set(got["component"])) == [1] and (got["n"] == 7).all() and len(got) == 30
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [float("nan")])], [(1, [])]])
def test_tables_without_vectors_give_no_rows(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert df.collect() == [] and df.columns[:2] == ["vec_id", "component"]


def test_other_lengths_and_clashing_names(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(c) for c in v], 5, [0]) for i, v in enumerate(rng.normal(size=(40, 5)))] + [(99, [1.0, 2.0], 0, None)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA + ", n int, x array<int>")).toPandas()
    assert set(got["vec_id"]) == set(range(40)) and (got["n"] == 40).all()


def test_deviations_are_exact_beyond_doubles_and_null_beyond_longs():
    x = np.array([[1 << 30, 3], [-(1 << 30), 5]], np.int64)
    assert whitening.deviations(x, 2, [0, 8]) == [(1 << 31) ** 2 + 4, (1 << 31) ** 2 + 4]
    assert whitening.deviations(x, 4, [0, 8]) == [None, None] or whitening.deviations(x, 4, [0, 8])[0] == (1 << 32) ** 2 + 16
    assert whitening.deviations(x[:, :1] * 2, 2, [0]) == [None, None]
