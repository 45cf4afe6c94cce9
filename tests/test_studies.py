"""Impact fits, meta-labelling, lead-lag and placebo studies against plain numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import impact, lead_lag, learning, placebo


def rng(seed):
    return np.random.Generator(np.random.PCG64(seed))


# ---- impact ----

def simplex(f, start, steps=4000):
    """A plain downhill simplex."""
    pts = [np.array(start, float)] + [np.array(start, float) * (1 + 0.25 * (np.arange(len(start)) == i)) + 0.25 * ((np.arange(len(start)) == i) & (np.array(start) == 0)) for i in range(len(start))]
    for _ in range(steps):
        pts.sort(key=f)
        mid, worst = np.mean(pts[:-1], axis=0), pts[-1]
        if abs(f(worst) - f(pts[0])) < 1e-15:
            break
        mirror = 2 * mid - worst
        if f(mirror) < f(pts[0]):
            far = 3 * mid - 2 * worst
            pts[-1] = far if f(far) < f(mirror) else mirror
        elif f(mirror) < f(pts[-2]):
            pts[-1] = mirror
        else:
            near = (mid + worst) / 2
            pts = [*pts[:-1], near] if f(near) < f(worst) else [pts[0], *[(p + pts[0]) / 2 for p in pts[1:]]]
    return min(pts, key=f)


@pytest.fixture(scope="module")
def records():
    """symbol -> (participation, slippage, volatility or None)"""
    r, out = rng(5), {}
    for name, c, eta, beta, vol in (("A", 2.0, 40.0, 0.6, True), ("B", 0.0, 25.0, 0.35, False), ("C", 5.0, 90.0, 0.95, True)):
        x, s = r.uniform(0.001, 0.3, 200), r.uniform(0.5, 2.0, 200)
        y = c + eta * (s if vol else 1) * x**beta + r.normal(0, 0.3, 200)
        out[name] = list(zip(x.tolist(), y.tolist(), s.tolist() if vol else [None] * 200))
    out["falling"] = [(float(x), float(9 - 20 * x + e), 1.0) for x, e in zip(r.uniform(0.01, 0.3, 50), r.normal(0, 0.1, 50))]
    out["few"] = [(0.1, 1.0, 1.0), (0.3, 2.0, 1.0), (0.2, 1.5, 2.0)]
    out["narrow"] = [(0.1 + 0.001 * i, float(i), 1.0) for i in range(20)]
    out["odd"] = [(None, 1.0, 1.0), (0.0, 1.0, 1.0), (0.1, None, 1.0)]
    return out


def frame(spark, records):
    rows = [(k, *v) for k, own in records.items() for v in own]
    return spark.createDataFrame(rows, "symbol string, participation double, slippage_bps double, realized_vol double")


def test_power_law_is_the_simplex_optimum(spark, records):
    got = {r["symbol"]: r for r in impact.power_law(frame(spark, records), ["symbol"]).collect()}
    assert set(got) == {"A", "B", "C", "falling"}
    for name, r in got.items():
        x, y, s = (np.array([1.0 if v is None else v for v in col]) for col in zip(*records[name]))

        def loss(p):
            c, eta, beta = max(0.0, p[0]), max(0.0, p[1]), min(1.0, max(0.2, p[2]))
            return ((y - c - eta * s * x**beta) ** 2).sum() + 1e6 * ((p[0] - c) ** 2 + (p[1] - eta) ** 2 + (p[2] - beta) ** 2)

        best = simplex(loss, [1.0, 20.0, 0.5])
        assert loss([r["c"], r["eta"], r["beta"]]) <= loss(best) * (1 + 1e-7) + 1e-9
        if name != "falling":
            assert (r["c"], r["eta"], r["beta"]) == (pytest.approx(max(best[0], 0), abs=2e-2), pytest.approx(best[1], rel=5e-3), pytest.approx(best[2], abs=2e-3))
    assert got["falling"]["eta"] == 0.0 and got["falling"]["c"] == pytest.approx(np.mean([y for _, y, _ in records["falling"]]))


def test_regime_slopes(spark, records):
    got = {r["symbol"]: r for r in impact.regime_slopes(frame(spark, records), ["symbol"]).collect()}
    assert set(got) == {"A", "C", "falling"}
    for name in ("A", "C"):
        x, y, s = map(np.array, zip(*records[name]))
        edge = np.median(s)
        assert got[name]["threshold"] == pytest.approx(edge)
        for side, at in (("low", s <= edge), ("high", s > edge)):
            assert got[name][side] == pytest.approx(max(0.0, np.polyfit(np.sqrt(x[at]), y[at], 1)[0]))
    assert got["falling"]["low"] == 0.0 and got["falling"]["high"] is None  # all of one volatility


# ---- meta-labelling ----

def test_logit_equals_numpys_descent(spark):
    r = rng(6)
    x = r.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 5, 1]
    y = (r.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.1 * x[:, 1])))).astype(int)
    rows = [(*map(float, a), int(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1)]
    got = learning.fit_logit(spark.createDataFrame(rows, "a double, b double, c double, label int").repartition(3), ("a", "b", "c"), steps=60)
    z = np.column_stack([np.ones(300), (x - x.mean(0)) / x.std(0)])
    w = np.zeros(4)
    for _ in range(60):
        g = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / 300
        g[1:] += w[1:] / 300
        w -= 0.3 * g
    assert np.allclose(got.weights, w, atol=1e-9)
    empty = learning.fit_logit(spark.createDataFrame([], "a double, label int"), ("a",))
    assert not empty.weights.any()


@pytest.mark.parametrize("digits", [1, 6])
def test_auc_is_the_share_of_pairs(spark, digits):
    r = rng(7)
    rows = [(k, round(float(s), digits), int(l)) for k in "ab" for s, l in zip(r.random(200), r.random(200) < 0.4)] + [("c", 0.5, 1), ("a", None, 1)]
    got = {x["k"]: x for x in learning.auc(spark.createDataFrame(rows, "k string, score double, label int"), "score", "label", "k", ranges=7).collect()}
    for k in "ab":
        pos, neg = ([s for n, s, l in rows if n == k and s is not None and l == want] for want in (1, 0))
        assert got[k]["auc"] == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
    assert got["c"]["auc"] == 0.5


def plain_trades(ca, cb, h, lookback, first, enter, leave, bps):
    """By an account in money, opened and closed as the spread's z says."""
    s = [math.log(a) - h * math.log(b) for a, b in zip(ca, cb)]
    cash, qa, qb, held, out, cost = 1e5, 0.0, 0.0, 0, [], bps / 1e4
    for i, (a, b) in enumerate(zip(ca, cb)):
        if i + 1 >= lookback:
            w = s[i + 1 - lookback : i + 1]
            z = (s[i] - np.mean(w)) / np.std(w)
            if held == 0 and abs(z) > enter:
                before, held, size, dates = cash, -1 if z > 0 else 1, abs(z), []
                leg, at = 0.5 * cash, i
                qa, qb = held * leg / a, -held * leg / b
                cash -= qa * a + qb * b + cost * 2 * leg
            elif held and held * z >= -leave:
                value = cash + qa * a + qb * b
                out.append((dates, i, held, size, value / before - 1))
                cash, qa, qb, held = value - cost * (abs(qa) * a + abs(qb) * b), 0.0, 0.0, 0
        if held and i > at and i >= first:
            dates.append(i)
    if held:
        out.append((dates, len(ca) - 1, held, size, (cash + qa * ca[-1] + qb * cb[-1]) / before - 1))
    return [(d[0], c, s_, z, net) for d, c, s_, z, net in out if d]


def test_trades_and_what_was_known():
    r = rng(8)
    for seed in range(5):
        lb = 4 + np.cumsum(r.normal(0, 0.01, 150))
        la = lb + r.normal(0, 0.03, 150)
        got = learning.trades_of(np.exp(la), np.exp(lb), 1.0, 20, 100, 1.5, 0.5, 3.0)
        want = plain_trades(np.exp(la), np.exp(lb), 1.0, 20, 100, 1.5, 0.5, 3.0)
        assert len(got) == len(want) > 0
        for a, b in zip(got, want):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-10)


# ---- lead-lag ----

@pytest.mark.parametrize("train,test,lag", [(60, 20, 1), (50, 20, 2), (45, 20, 6)])
def test_lead_lag_walk(spark, train, test, lag):
    r, n, t = rng(9), 11, 131
    ret = r.normal(0, 0.01, (t, n))
    ret[1:, 1] += 0.8 * ret[:-1, 0]
    price = np.round(100 * np.exp(np.cumsum(ret, axis=0)), 6)
    day = lambda i: dt.date(2022, 1, 1) + dt.timedelta(days=i)
    rows = [(f"S{j:02d}", day(i), float(price[i, j])) for i in range(t) for j in range(n)] + [("S00", day(900), 5.0)]
    got = {x["ts"]: x for x in lead_lag.walk(spark.createDataFrame(rows, "symbol string, ts date, close double"), train, test, lag, 3, 0.2, 3.0).collect()}
    real = np.vstack([np.zeros(n), price[1:] / price[:-1] - 1])
    want, before, start, k = {}, np.zeros(n), train, 2
    while start + test <= t:
        x, y = real[start - train : start - lag], real[start - train + lag : start]
        c = np.array([[0.0 if i == j else np.corrcoef(x[:, i], y[:, j])[0, 1] for j in range(n)] for i in range(n)])
        kept = np.zeros_like(c)
        for j in range(n):
            top = np.argsort(-np.abs(c[:, j]), kind="stable")[:3]
            kept[top, j] = c[top, j]
        for at in range(start, start + test):
            order = np.argsort(real[at - lag] @ kept, kind="stable")
            w = np.zeros(n)
            w[order[-k:]], w[order[:k]] = 0.5 / k, -0.5 / k
            want[day(at)] = float(w @ real[at]) - np.abs(w - before).sum() * 3e-4
            before = w
        start += test
    # rows after the last whole window are not traded
    assert set(got) == set(want)
    for at, net in want.items():
        assert got[at]["net"] == pytest.approx(net, abs=1e-10) and got[at]["active"] == 2 * k


def test_shuffled_leaders_are_a_repeatable_control(spark):
    r = rng(10)
    rows = [(f"S{j:02d}", dt.date(2022, 1, 1) + dt.timedelta(days=i), float(p)) for j in range(10) for i, p in enumerate(100 * np.exp(np.cumsum(r.normal(0, 0.01, 100))))]
    df = spark.createDataFrame(rows, "symbol string, ts date, close double")
    run = lambda seed, parts: sorted(map(tuple, lead_lag.walk(df.repartition(parts), 40, 20, shuffled=seed).select("ts", F.round("net", 12)).collect()))
    assert run(1, 2) == run(1, 7) != run(2, 2)
    assert lead_lag.walk(df.where("symbol < 'S04'"), 40, 20).collect() == []


# ---- placebos ----

def trading_days(n=500):
    out, d = [], dt.date(2021, 1, 4)
    while len(out) < n:
        if d.weekday() < 5 and d.toordinal() % 17:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def test_expiry_week_and_its_placebo(spark):
    days, r = trading_days(), rng(11)
    ret = np.round(r.normal(0.0003, 0.01, len(days)), 8)
    df = spark.createDataFrame([(d, float(x)) for d, x in zip(days, ret)], "ts date, ret double")
    inside, seen, weeks = np.zeros(len(days), bool), {}, 0
    for i, d in enumerate(days):
        if d.weekday() == 4:
            seen[d.year, d.month] = seen.get((d.year, d.month), 0) + 1
            if seen[d.year, d.month] == 3:
                weeks += 1
                j = i
                while j > 0 and days[j - 1].weekday() < days[j].weekday() and days[j - 1].month == d.month and (d - days[j - 1]).days < 7:
                    j -= 1
                inside[j : i + 1] = True
    marked = [(x["ts"], x["inside"]) for x in placebo.expiry_weeks(df).orderBy("ts").collect()]
    assert marked == list(zip(days, inside.tolist()))
    held = inside.astype(float)
    net = held * ret - np.abs(np.diff(held, prepend=0.0)) * 2e-4
    got = placebo.expiry_week(df, replicas=40).first()
    assert (got["n"], got["weeks"]) == (len(days), weeks)
    assert got["sharpe"] == pytest.approx(net.mean() / net.std() * math.sqrt(252))
    assert got["effect"] == pytest.approx(ret[inside].mean() - ret[~inside].mean()) and got["exposure"] == pytest.approx(held.mean())
    assert 0 <= got["percentile"] <= 1
    assert tuple(got) == tuple(placebo.expiry_week(df.repartition(9), replicas=40).first())
    assert placebo.expiry_week(df, replicas=40, seed=8).first()["placebo_mean"] != got["placebo_mean"]


def test_exposure_and_equal_weight_controls(spark):
    r = rng(12)
    ret, held = r.normal(0.001, 0.01, 100), r.choice([0.75, 1.0], 100)
    df = spark.createDataFrame([(i, float(a), float(b), float(a * b)) for i, (a, b) in enumerate(zip(ret, held))], "ts int, ret double, held double, net double")
    got, ratio = placebo.matched_exposure(df).first(), lambda x: x.mean() / x.std() * math.sqrt(252)
    assert got["overlay_sharpe"] == pytest.approx(ratio(ret * held)) and got["exposure"] == pytest.approx(held.mean())
    assert got["market_sharpe"] == pytest.approx(ratio(ret)) == pytest.approx(got["matched_sharpe"])
    names = r.normal(0, 0.01, (100, 4))
    panel = spark.createDataFrame([(f"E{j}", i, float(names[i, j])) for i in range(100) for j in range(4)], "symbol string, ts int, ret double")
    got = placebo.equal_weights(panel, df.select("ts", "net")).first()
    equal, net = names.mean(axis=1) - np.where(np.arange(100) == 0, 2e-4, 0), ret * held
    beta = np.cov(net, equal, ddof=0)[0, 1] / equal.var()
    assert got["equal_sharpe"] == pytest.approx(ratio(equal)) and got["rotation_sharpe"] == pytest.approx(ratio(net))
    assert got["beta"] == pytest.approx(beta) and got["alpha"] == pytest.approx((net.mean() - beta * equal.mean()) * 252)
