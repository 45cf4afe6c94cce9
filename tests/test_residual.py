"""Residual scores and their book against numpy, window by window."""

import datetime as dt

import numpy as np
import pytest

from marketloom.operators import residual

T, N, M = 90, 9, 40


def day(i):
    return dt.date(2022, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.Generator(np.random.PCG64(8))
    market = rng.normal(0, 0.01, (T, 2))
    noise = rng.normal(0, 0.004, (T, N))
    return market @ rng.normal(1, 0.5, (2, N)) + noise - 0.6 * np.vstack([np.zeros(N), noise[:-1]])


def plain_scores(r, factors, longest):
    """Each window by least squares over its own rows."""
    out = np.full((T, N), np.nan)
    for t in range(M, T):
        w = r[t - M : t]
        sd = w.std(axis=0, ddof=1)
        v = np.linalg.eigh(np.corrcoef(w.T))[1][:, -factors:]
        a = np.column_stack([np.ones(M), w @ (v / sd[:, None])])
        x = np.cumsum(w - a @ np.linalg.lstsq(a, w, rcond=None)[0], axis=0)
        for i in range(N):
            before, now = x[:-1, i], x[1:, i]
            b = np.cov(before, now, ddof=0)[0, 1] / before.var()
            if not 1e-4 < b < 1 - 1e-6 or np.log(2) / -np.log(b) > longest:
                continue
            c = now.mean() - b * before.mean()
            sigma = np.sqrt(((now - c - b * before) ** 2).mean() / (1 - b * b))
            out[t, i] = (x[-1, i] - c / (1 - b)) / sigma
    return out


def plain_book(r, s, open_, close, bps):
    held, before, out = np.zeros(N), np.zeros(N), {}
    for t in range(M, T):
        for i in range(N):
            x = s[t, i]
            if np.isnan(x):
                held[i] = 0
            elif held[i] == 0:
                held[i] = 1 if x < -open_ else -1 if x > open_ else 0
            elif (held[i] > 0 and x > -close) or (held[i] < 0 and x < close):
                held[i] = 0
        w = np.where(held > 0, 0.5 / max((held > 0).sum(), 1), np.where(held < 0, -0.5 / max((held < 0).sum(), 1), 0))
        out[day(t)] = (float(w @ r[t]) - np.abs(w - before).sum() * bps / 1e4, int(np.abs(held).sum()))
        before = w
    return out


@pytest.mark.parametrize("block,chunk", [(64, 32), (4, 7), (1, 100)])
def test_scores_and_book(spark, matrix, block, chunk):
    rows = [(f"S{j}", day(i), float(matrix[i, j])) for i in range(T) for j in range(N)]
    scored = residual.scores(spark.createDataFrame(rows, "symbol string, ts date, ret double"), M, 2, 8.0, block, chunk).cache()
    expected = plain_scores(matrix, 2, 8.0)
    got = {(r["symbol"], r["ts"]): r["score"] for r in scored.collect()}
    assert len(got) == (T - M) * N and 0 < np.isfinite(expected[M:]).sum() < expected[M:].size
    for (name, at), s in got.items():
        e = expected[(at - day(0)).days, int(name[1:])]
        assert (s is None) == np.isnan(e) and (s is None or s == pytest.approx(e, abs=1e-7))
    if block == 4:
        daily = {r["ts"]: (r["net"], r["names"]) for r in residual.book(residual.banded(scored, 1.0, 0.4), 5.0).collect()}
        plain = plain_book(matrix, expected, 1.0, 0.4, 5.0)
        assert set(daily) == set(plain) and any(n for _, n in plain.values())
        for t, (net, names) in plain.items():
            assert daily[t] == (pytest.approx(net, abs=1e-10), names)
    scored.unpersist()


@pytest.mark.parametrize("symbols,times", [(4, 80), (6, 50), (0, 0)])
def test_too_little_data_gives_no_scores(spark, symbols, times):
    rows = [(f"S{j}", day(i), 0.01 * (i % 3)) for i in range(times) for j in range(symbols)]
    assert residual.scores(spark.createDataFrame(rows, "symbol string, ts date, ret double"), M, 2).collect() == []
