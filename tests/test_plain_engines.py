"""Engines against plain loops over arrays, written from the published rules and not from the plans."""

import datetime as dt
import math
import statistics as stats

import numpy as np
import pytest

from marketloom.functions import calendar as cal
from marketloom.operators import execution as ex
from marketloom.operators import overlays, panel, portfolio
from marketloom.operators import statistics as st
from marketloom.plans.rel import Rel, dialect

B = Rel.table("bars")
N, T = 13, 120


def day(i):
    return dt.date(2022, 1, 3) + dt.timedelta(days=7 * i)


@pytest.fixture(scope="module")
def closes():
    """T x N closes with a few gaps; the first rows are whole."""
    rng = np.random.Generator(np.random.PCG64(12))
    c = 50 * np.exp(np.cumsum(rng.normal(0, 0.03, (T, N)), axis=0))
    c = np.round(c, 6)
    c[rng.random((T, N)) < 0.02] = np.nan
    return c


@pytest.fixture(scope="module")
def tables(spark, closes):
    rows = [(f"S{j:02d}", day(i), *[float(closes[i, j])] * 4, 100.0) for i in range(T) for j in range(N) if np.isfinite(closes[i, j])]
    return {"bars": spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double").cache()}


def own_returns(c):
    out = np.zeros_like(c)
    for j in range(c.shape[1]):
        at = np.flatnonzero(np.isfinite(c[:, j]))
        out[at[1:], j] = c[at[1:], j] / c[at[:-1], j] - 1
    return out


def nets(plan, tables):
    return {r["ts"]: r["net"] for r in plan.df(tables).select("ts", "net").collect()}


def same(got, expected):
    assert set(got) == set(expected)
    for t, value in expected.items():
        assert got[t] == pytest.approx(value, abs=1e-10), t


def book(value, k, long_high):
    w = np.zeros(len(value))
    there = sorted((v, j) for j, v in enumerate(value) if np.isfinite(v))
    if len(there) < 2 * k:
        return None
    side = 0.5 / k if long_high else -0.5 / k
    for _, j in there[:k]:
        w[j] -= side
    for _, j in there[-k:]:
        w[j] += side
    return w


@pytest.mark.parametrize("long_high", [True, False])
def test_factor(tables, closes, long_high):
    signal = np.full((T, N), np.nan)
    signal[6:] = np.round(closes[6:] / closes[:-6] - 1, 10)
    ret, w, expected = own_returns(closes), np.zeros(N), {}
    for t in range(1, T):
        before = w
        if (t - 1) % 4 == 0:
            made = book(signal[t - 1], 3, long_high)
            w = before if made is None else made
        expected[day(t)] = float(w @ ret[t]) - np.abs(w - before).sum() * 2e-4
    same(nets(portfolio.factor(portfolio.momentum(panel.dense(B), 6), 3, 4, long_high=long_high), tables), expected)


@pytest.mark.parametrize("reverse", [False, True])
def test_cross_sectional(tables, closes, reverse):
    rows = np.flatnonzero(np.isfinite(closes).all(axis=1))
    c, w, expected = closes[rows], np.zeros(N), {}
    for t in range(1, len(rows)):
        growth = 1 + float(w @ (c[t] / c[t - 1] - 1))
        if t >= 10 and (t - 10) % 5 == 0:
            new = book(np.round(c[t] / c[t - 10] - 1, 10), 2, not reverse)
            growth *= 1 - 2e-4 * np.abs(new - w).sum()
            w = new
        expected[day(int(rows[t]))] = growth - 1
    same(nets(portfolio.cross_sectional(B, 10, 5, 2, reverse=reverse), tables), expected)


@pytest.mark.parametrize("leg,apr", [("both", 0.0), ("long", 0.0), ("short", 0.1)])
def test_event_drift(spark, tables, closes, leg, apr):
    rng = np.random.Generator(np.random.PCG64(3))
    events = [(f"S{j:02d}", day(int(i)) + dt.timedelta(days=int(rng.integers(-2, 3))), float(rng.normal(0, 4))) for j in range(N) for i in sorted(rng.choice(range(-2, T + 2), 6, replace=False))]
    position = np.zeros((T, N))
    for symbol, at, surprise in sorted(events):
        j = int(symbol[1:])
        own = [i for i in range(T) if np.isfinite(closes[i, j])]
        later = [n for n, i in enumerate(own) if day(i) > at]
        if abs(surprise) >= 2 and later and day(own[0]) <= at:
            for n in range(later[0] + 1, min(later[0] + 1 + 5, len(own))):  # skip = 2: one bar on
                position[own[n], j] = math.copysign(1, surprise)
    ret, w, expected = own_returns(closes), np.zeros(N), {}
    for t in range(1, T):
        p, new = position[t - 1], np.zeros(N)
        for sign, name in ((1, "long"), (-1, "short")):
            if (p == sign).any() and leg in (name, "both"):
                new[p == sign] = sign * (0.5 if leg == "both" else 1.0) / (p == sign).sum()
        expected[day(t)] = float(new @ ret[t]) - np.abs(new - w).sum() * 2e-4 - -new[new < 0].sum() * apr / 52
        w = new
    t = {**tables, "ev": spark.createDataFrame(events, "symbol string, event_ts date, surprise double")}
    same(nets(portfolio.event_drift(B, Rel.table("ev"), 5, 2, 2.0, leg, apr, 52.0), t), expected)


def test_tail_hedge(spark):
    r = np.random.Generator(np.random.PCG64(5)).standard_t(3, 300) * 0.01
    expected, held = {}, 1.0
    exposure = np.ones(300)
    for i in range(20, 300):
        x = r[i - 20 : i]
        z = (x - x.mean()) / x.std()
        if (z**3).mean() < -0.3 and (z**4).mean() > 3:
            exposure[i] = 0.75
    for i in range(300):
        now = 1.0 if i == 0 else exposure[i - 1]
        expected[day(i)] = now * r[i] - abs(now - held) * 2e-4
        held = now
    t = {"r": spark.createDataFrame([(day(i), float(x)) for i, x in enumerate(r)], "ts date, bench double")}
    assert (exposure < 1).sum() > 5
    same(nets(overlays.tail_hedge(Rel.table("r"), 20, -0.3, 3.0), t), expected)


def calendar_returns(c):
    out = np.zeros_like(c)
    out[1:] = np.nan_to_num(c[1:] / c[:-1] - 1)
    return out


def test_rotation(tables, closes):
    ret, w, expected = calendar_returns(closes), np.zeros(N), {}
    chosen = np.zeros(N)
    weights = np.zeros((T, N))
    for i in range(T):
        if i >= 8 and day(i).month != day(i - 1).month:
            score = np.round(np.prod(1 + ret[i - 8 : i], axis=0) - 1, 10)
            chosen = np.zeros(N)
            chosen[sorted(range(N), key=lambda j: (score[j], j))[N // 2]] = 1
        weights[i] = chosen
    for i in range(1, T):
        expected[day(i)] = float(weights[i - 1] @ ret[i]) - np.abs(weights[i] - weights[i - 1]).sum() * 2e-4
    same(nets(portfolio.earn(overlays.rotation(panel.dense(B), 8), charged=0, first=2), tables), expected)


def test_hardened_momentum(tables, closes):
    ret = calendar_returns(closes)
    there = np.isfinite(closes)
    index = np.cumprod([1 + ret[t, there[t]].mean() for t in range(T)])
    w, expected, traded = np.zeros(N), {}, 0
    start = 20 + 2 + 1
    for t in range(1, T):
        net = float(w @ ret[t])
        if t >= start and (t - start) % 4 == 0:
            x = np.where(there[t], closes[t - 2] / closes[t - 22] - 1, np.nan)
            ok, new = np.isfinite(x), np.zeros(N)
            low = max(0, t - 12)
            moves = np.abs(np.diff(index[low : t + 1])).sum()
            if ok.sum() >= 10 and round(abs(index[t] - index[low]) / moves, 9) >= 0.3:
                z = (x[ok] - x[ok].mean()) / (x[ok].std() + 1e-12)
                new[ok] = z / np.abs(z).sum()
                traded += 1
            net -= np.abs(new - w).sum() * 2e-4
            w = new
        expected[day(t)] = net
    assert traded > 3
    same(nets(portfolio.earn(overlays.hardened_momentum(panel.dense(B), 20, 2, 4, 12), charged=0, first=2), tables), expected)


def test_leg_gate(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    b = rng.normal(0.001, 0.02, 300)
    for drift, mixed in ((0.002, 0.0), (-0.001, 0.0), (0.002, 0.9)):
        c = rng.normal(drift, 0.02, 300) * (1 - mixed) + b * mixed
        years = np.array([day(i).year for i in range(300)])
        sharpe = lambda x: x.mean() / x.std() * math.sqrt(52)

        def lift(keep):
            u, v = 1 / c[keep].std(), 1 / b[keep].std()
            return sharpe((u * c[keep] + v * b[keep]) / (u + v)) - sharpe(b[keep])

        every = np.ones(300, bool)
        folds = [lift(years != y) for y in sorted(set(years)) if (years != y).sum() >= 40]
        rho = float(np.corrcoef(c, b)[0, 1])
        expected = {"forward_positive": sharpe(c) > 0, "uncorrelated": abs(rho) < 0.3, "lifts": lift(every) > 0.03, "robust_loo": np.mean([x > 0 for x in folds]) >= 0.6, "partial_year_safe": lift(years != max(years)) > 0}
        t = {k: spark.createDataFrame([(day(i), float(x)) for i, x in enumerate(v)], "ts date, net double") for k, v in (("c", c), ("b", b))}
        got = st.leg_gate(Rel.table("c"), Rel.table("b"), 52.0).df(t).first()
        assert {k: got[k] for k in expected} == {k: bool(v) for k, v in expected.items()} and got["passed"] == all(expected.values())
        assert got["rho"] == pytest.approx(rho) and got["lift"] == pytest.approx(lift(every)) and got["without_last"] == pytest.approx(lift(years != max(years)))
    few = {k: v.limit(50) for k, v in t.items()}
    assert not st.leg_gate(Rel.table("c"), Rel.table("b"), 52.0).df(few).first()["passed"]


@pytest.mark.parametrize("n,k", [(41, 4), (100, 3), (10, 4), (12, 4)])
def test_segments(spark, n, k):
    r = np.random.Generator(np.random.PCG64(n)).normal(0.001, 0.02, n)
    curve = [1.0]
    for x in r:
        curve.append(curve[-1] * (1 + x))
    points = len(curve)

    def sharpe(part):
        x = [b / a - 1 for a, b in zip(part, part[1:])]
        return stats.fmean(x) / stats.pstdev(x) * math.sqrt(52)

    expected = [sharpe(curve)] if points < 3 * k else [round(sharpe(curve[s * points // k : (s + 1) * points // k + 1]), 2) for s in range(k)]
    t = {"r": spark.createDataFrame([(day(i), float(x)) for i, x in enumerate(r)], "ts date, net double")}
    got = [r["sharpe"] for r in st.segments(Rel.table("r"), k, 52.0).df(t).orderBy("segment").collect()]
    assert got == pytest.approx(expected, abs=1e-9)


def test_settled_cash(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    flows = [("A", int(s), float(rng.normal(0, 100))) for s in sorted(rng.integers(0, 12, 40))]
    t = {"f": spark.createDataFrame(flows, "who string, session int, amount double")}
    sessions = sorted({s for _, s, _ in flows})
    for lag in (1, 2):
        settled, pending, expected = 0.0, {}, {}
        for k, session in enumerate(sessions):
            for due in [d for d in pending if d <= k]:
                settled += pending.pop(due)
            for _, s, amount in flows:
                if s == session and amount < 0:
                    settled += amount
                elif s == session:
                    pending[k + lag] = pending.get(k + lag, 0.0) + amount
            expected[session] = (settled, settled + sum(pending.values()))
        got = {r["session"]: (r["settled"], r["cash"]) for r in overlays.settled_cash(Rel.table("f"), "who", "session", "amount", lag).df(t).collect()}
        assert set(got) == set(expected) and all(got[s] == pytest.approx(expected[s]) for s in expected)


def test_calibrate(spark):
    rng = np.random.Generator(np.random.PCG64(4))
    rows = []
    for name, slope in (("up", 50.0), ("down", -50.0), ("flat", 0.0), ("few", 9.0)):
        for _ in range(3 if name == "few" else 60):
            part = 0.01 if name == "flat" else float(rng.uniform(0.001, 0.2))
            rows.append((name, float(-2 + slope * math.sqrt(part) + rng.normal(0, 0.5)), part, None))
    rows += [("quoted", 1.0, 0.01 * (i + 1), 3.0 + i) for i in range(5)]
    t = {"f": spark.createDataFrame(rows, "symbol string, slippage_bps double, participation double, half double")}
    got = {r["symbol"]: r for r in ex.calibrate(Rel.table("f"), "half").df(t).collect()}
    for name in ("up", "down", "flat", "few"):
        mine = [(s, p) for n, s, p, _ in rows if n == name]
        x, y = np.sqrt([p for _, p in mine]), np.array([s for s, _ in mine])
        fitted = len(mine) >= 4 and name != "flat"
        assert got[name]["fitted"] == int(fitted)
        assert got[name]["impact"] == pytest.approx(max(0.0, np.polyfit(x, y, 1)[0]) if fitted else 8.0)
        low = np.quantile([p for _, p in mine], 0.25)
        assert got[name]["half_spread"] == pytest.approx(max(0.0, stats.median(s for s, p in mine if p <= low + 1e-12)))
    assert got["quoted"]["half_spread"] == 5.0


def test_fills(spark):
    df = spark.createDataFrame([(10.0, 10.2, 10.5, 10.0, True, 50.0), (10.0, 9.8, 10.5, 9.7, True, 5000.0), (10.0, 10.2, 10.5, 10.01, True, 5000.0), (10.0, 9.8, 10.0, 9.7, False, 5000.0), (10.0, 10.3, 10.5, 9.7, False, 0.0), (None, 9.8, 9.9, 9.7, True, 50.0)], "want double, open double, high double, low double, buy boolean, volume double")
    got = Rel.table("f").with_(**ex.fill_limit("want", "open", "high", "low", "buy", "40.0", "volume", 0.1)).df({"f": df}).collect()
    assert [(r["filled"], r["price"]) for r in got] == [(5.0, 10.0), (40.0, 9.8), (0.0, None), (40.0, 10.0), (40.0, 10.3), (0.0, None)]
    market = Rel.table("f").with_(**ex.fill_market("want", "100.0", "volume", "buy", 1.0, 8.0, 0.1, 0.01)).df({"f": df}).collect()
    assert [r["filled"] for r in market] == [5.0, 100.0, 100.0, 100.0, 100.0, 0.0]
    assert market[1]["price"] == pytest.approx(round(10 * (1 + (1 + 8 * math.sqrt(100 / 5000)) / 1e4), 2))
    assert market[4]["price"] == pytest.approx(round(10 * (1 - 1 / 1e4), 2))


def test_sessions(spark):
    cases = [("2026-07-03", "10:00", "CLOSED_HOLIDAY"), ("2026-07-04", "10:00", "CLOSED_WEEKEND"), ("2026-07-05", "10:00", "CLOSED_WEEKEND"), ("2026-07-06", "09:29", "PRE_MARKET"), ("2026-07-06", "09:30", "REGULAR"), ("2026-07-06", "15:59", "REGULAR"),
             ("2026-07-06", "16:00", "AFTER_HOURS"), ("2026-07-06", "20:00", "CLOSED"), ("2026-07-06", "03:59", "CLOSED"), ("2025-11-28", "12:59", "REGULAR"), ("2025-11-28", "13:00", "AFTER_HOURS"), ("2019-12-25", "10:00", "REGULAR")]
    df = spark.createDataFrame([c[:2] for c in cases], "session string, clock string")
    got = df.selectExpr(f"{dialect(cal.session(), True)} AS kind", f"{cal.covered()} AS covered").collect()
    assert [r["kind"] for r in got] == [c[2] for c in cases] and [r["covered"] for r in got] == [True] * 11 + [False]


def test_null_facts_overwrite(spark):
    facts = spark.createDataFrame([("A", dt.date(2020, 12, 31), day(2), 5.0), ("A", dt.date(2021, 12, 31), day(5), None), ("A", dt.date(2022, 12, 31), day(8), 7.0)], "symbol string, fy_end date, filed date, x double")
    bars = spark.createDataFrame([("A", day(i)) for i in range(10)], "symbol string, ts date")
    t = {"f": facts, "b": bars}
    read = lambda nulls: [r["value"] for r in panel.step(Rel.table("b"), Rel.table("f"), "x", nulls).df(t).orderBy("ts").collect()]
    assert read(True) == [None] * 2 + [5.0] * 3 + [None] * 3 + [7.0] * 2
    assert read(False) == [None] * 2 + [5.0] * 6 + [7.0] * 2


@pytest.mark.parametrize("reverse", [True, False])
def test_short_interest_tilt(spark, tables, closes, reverse):
    rng = np.random.Generator(np.random.PCG64(8))
    reports = [(f"S{j:02d}", day(int(i)) + dt.timedelta(days=int(rng.integers(-3, 4))), None if rng.random() < 0.1 else float(rng.integers(1, 40)) / 4 + j / 100) for j in range(N) for i in rng.choice(range(-1, T + 3), 12, replace=False)]
    data = {**tables, "reports": spark.createDataFrame(reports, "symbol string, settled date, days_to_cover double")}
    known = np.full((T, N), np.nan)
    for symbol, at, value in sorted(reports, key=lambda r: (r[0], r[1], r[2] or 0)):
        opens = next((i for i in range(T) if day(i) >= at), None)
        if value is not None and opens is not None:
            known[min(opens + 4, T - 1) :, int(symbol[1:])] = value
    ret, w, expected = own_returns(closes), np.zeros(N), {}
    for t in range(1, T):
        made = book(np.round(known[t - 1], 10), 3, not reverse)
        new = np.zeros(N) if made is None else made
        apr = np.minimum(0.01 + 0.02 * np.nan_to_num(known[t - 1]), 0.12)
        expected[day(t)] = float(new @ ret[t]) - np.abs(new - w).sum() * 2e-4 - float((np.maximum(-new, 0) * apr).sum()) / 252
        w = new
    same(nets(portfolio.short_interest_tilt(B, Rel.table("reports"), 3, 4, borrow=(0.01, 0.02, 0.12), reverse=reverse), data), expected)


def test_combo_report(tables, closes):
    streams = B.with_(before="lag(close) OVER (PARTITION BY symbol ORDER BY ts)").where("before IS NOT NULL").select("symbol", "ts", r="close / before - 1.0")
    series = []
    for j in range(N):
        c = closes[np.isfinite(closes[:, j]), j]
        series.append(c[1:] / c[:-1] - 1)
    m = min(len(x) for x in series)
    x = np.array([s[-m:] for s in series])
    inverse = 1 / x.std(axis=1)
    iv, ew = inverse / inverse.sum() @ x, x.mean(axis=0)
    sharpe, vol = iv.mean() / iv.std() * math.sqrt(252), iv.std() * math.sqrt(252)
    leverage = max(0.0, min(2.0, 0.5 * sharpe / vol))
    used = min(0.08, leverage * vol) if leverage > 0 else 0.08
    rho = np.abs(np.corrcoef(x)[~np.eye(N, dtype=bool)]).mean()
    got = st.combo_report(streams).df(tables).first()
    want = {"n": m, "avg_abs_corr": rho, "ew_sharpe": ew.mean() / ew.std() * math.sqrt(252), "iv_sharpe": sharpe, "vol": vol, "leverage": leverage, "applied_vol": used, "excess": sharpe * used, "expected": sharpe * used + 0.04, "noise_to_edge": math.sqrt(252) / sharpe}
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-8), name
