"""Pairs out of sample against plain loops over lists."""

import datetime as dt
import math
import statistics as stats

import numpy as np
import pytest

from marketloom.operators import pair_walks as pw
from marketloom.operators import pairs

TRAIN, TEST = 80, 20


def day(i):
    return dt.date(2021, 1, 1) + dt.timedelta(days=i)


def universe(n=260, seed=3, delisted=False):
    """Four pairs around common paths and three names of their own; one name may end within a test window."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = {}
    for g in range(4):
        path = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for leg in "AB":
            s = np.zeros(n)
            for i in range(1, n):
                s[i] = 0.85 * s[i - 1] + rng.normal(0, 0.8)
            out[f"G{g}{leg}"] = {i: float(round(p, 6)) for i, p in enumerate(path * (1 + 0.02 * s) + (2 if leg == "B" else 0))}
    for j in range(3):
        out[f"F{j}"] = {i: float(round(p, 6)) for i, p in enumerate(50 * np.exp(np.cumsum(rng.normal(0, 0.012, n))))}
    if delisted:
        out["G1B"] = {i: p for i, p in out["G1B"].items() if i < 151}  # within the test rows of the window that trains on 60 to 139
        out["G2A"] = {i: p for i, p in out["G2A"].items() if i % 9}  # with gaps
        out["LATE"] = {i: p * 1.5 for i, p in out["G3A"].items() if i > 130}
    return out


def dickey_fuller(y):
    d, x = [b - a for a, b in zip(y, y[1:])], y[:-1]
    mx, md = stats.fmean(x), stats.fmean(d)
    sxx = sum((v - mx) ** 2 for v in x)
    if len(y) < 12 or sxx <= 0:
        return 0.0, 0.0
    b = sum((v - mx) * (w - md) for v, w in zip(x, d)) / sxx
    rss = sum((w - md - b * (v - mx)) ** 2 for v, w in zip(x, d))
    return b, b / math.sqrt(rss / (len(d) - 2) / sxx)


def plain_equity(ca, cb, h, lookback, enter, leave, bps, sized=False, regime=None):
    cash, qa, qb, held, out = 1e5, 0.0, 0.0, 0, []
    spread = [math.log(a) - h * math.log(b) for a, b in zip(ca, cb)]
    if len(ca) < lookback + 5:
        return []
    for i, (a, b) in enumerate(zip(ca, cb)):
        want, label = held, regime[i] if regime else 0
        if label == 2:
            want = 0
        elif i + 1 >= lookback:
            w = spread[i + 1 - lookback : i + 1]
            sd = stats.pstdev(w)
            z = (spread[i] - stats.fmean(w)) / sd if sd > 0 else 0.0
            if held == 0 and label == 0:
                want = -1 if z > enter else 1 if z < -enter else 0
            elif held and held * z >= -leave:
                want = 0
        if want != held:
            cash += qa * a + qb * b - bps / 1e4 * (abs(qa) * a + abs(qb) * b)
            qa = qb = 0.0
            if want:
                leg = 0.5 * cash * (min(abs(z) / enter, 1.0) if sized else 1.0)
                qa, qb = want * leg / a, -want * leg / b
                cash -= qa * a + qb * b + bps / 1e4 * 2 * leg
            held = want
        out.append(cash + qa * a + qb * b)
    return out


def plain_walk(prices, top, most_adf=None, monitor=None, calibrated=False, bps=2.0):
    """{(left, right, time): return}"""
    master = sorted({t for p in prices.values() for t in p})
    out = {}
    for w in range(0, len(master) - TRAIN - TEST + 1, TEST):
        train, test = master[w : w + TRAIN], master[w + TRAIN : w + TRAIN + TEST]
        names = sorted(s for s in prices if sum(t in prices[s] for t in train) >= 0.8 * TRAIN)
        if len(names) < 4:
            continue
        ranked = []
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                ts = [t for t in train if t in prices[a] and t in prices[b]]
                if len(ts) < int(TRAIN * 0.8):
                    continue
                la, lb = [math.log(prices[a][t]) for t in ts], [math.log(prices[b][t]) for t in ts]
                ma, mb = stats.fmean(la), stats.fmean(lb)
                h = sum((y - mb) * (x - ma) for x, y in zip(la, lb)) / sum((y - mb) ** 2 for y in lb)
                pull, adf = dickey_fuller([x - h * y for x, y in zip(la, lb)])
                if pull >= 0 or not 1.0 <= -math.log(2) / pull <= 30 or (most_adf is not None and adf >= most_adf):
                    continue
                half = round(-math.log(2) / pull, 1)
                ranked.append((round(adf, 3) if most_adf is not None else half, a, b, round(h, 3), half))
        for _, a, b, h, half in sorted(ranked)[:top]:
            ts = [t for t in train + test if t in prices[a] and t in prices[b]]
            ca, cb = [prices[a][t] for t in ts], [prices[b][t] for t in ts]
            spread = [math.log(x) - h * math.log(y) for x, y in zip(ca, cb)]
            regime = None
            if monitor:
                regime = []
                for i in range(len(ts)):
                    p = pairs.adf_pvalue(dickey_fuller(spread[i + 1 - monitor : i + 1])[1]) if i + 1 >= monitor else 0.0
                    regime.append(2 if p >= 0.2 else 1 if p >= 0.1 else 0)
            enter = 2.0
            if calibrated:
                known = [s for s, t in zip(spread, ts) if t in train]
                pull, _ = dickey_fuller(known)
                d = [y - x for x, y in zip(known, known[1:])]
                sd = stats.pstdev([y - pull * x for x, y in zip(known, d)]) / math.sqrt(1 - (1 + pull) ** 2)
                enter = max(2.0, 4 * bps / 1e4 / sd)
                if enter > 8:
                    continue
            eq = plain_equity(ca, cb, h, int(max(20, min(120, half * 3))), enter, 0.5, bps, sized=calibrated, regime=regime)
            for t, before, now in zip(ts[1:], eq, eq[1:]):
                if t in test:
                    out[a, b, day(t)] = now / before - 1
    return out


def frame(spark, prices):
    return spark.createDataFrame([(s, day(t), p) for s, own in prices.items() for t, p in own.items()], "symbol string, ts date, close double")


@pytest.mark.parametrize("options", [{}, {"most_adf": -2.86}, {"monitor": 25}, {"calibrated": True, "bps": 60.0}])
def test_walk_with_names_that_end_and_start_late(spark, options):
    prices = universe(delisted=True)
    expected = plain_walk(prices, 6, **options)
    bps = options.pop("bps", 2.0)
    if options.get("calibrated"):
        options["sized"] = True
    got = pw.walk(frame(spark, prices), TRAIN, TEST, 6, shortest=1.0, cost_bps=bps, **options).collect()
    assert {(r["left_key"], r["right_key"], r["ts"]) for r in got} == set(expected)
    for r in got:
        assert r["ret"] == pytest.approx(expected[r["left_key"], r["right_key"], r["ts"]], abs=1e-10)
    if not options:
        ended = [t for a, b, t in expected if "G1B" in (a, b)]
        assert ended and max(ended) == day(150)  # the last price of the leg that ends
        assert any(v for v in expected.values())


def test_survivors_alone_give_the_same_walk_either_way(spark):
    bars = frame(spark, universe())
    a, b = (sorted(map(tuple, pw.walk(bars, TRAIN, TEST, 6, common=c).collect())) for c in (False, True))
    assert a == b and len(a) > 0


def test_a_late_name_shortens_the_common_calendar_only(spark):
    bars = frame(spark, universe(delisted=True))
    windows = lambda c: pw.walk(bars, TRAIN, TEST, 6, common=c).select("window").distinct().count()
    assert windows(True) < windows(False)


def test_regime_change_closes_an_open_position():
    rng = np.random.Generator(np.random.PCG64(1))
    ca, cb = 100 * np.exp(rng.normal(0, 0.02, 60)), np.full(60, 100.0)
    free = pw.spread_equity(ca, cb, 1.0, 20, 1.0, 0.0)
    opened = int(np.flatnonzero(free != free[0])[0])
    regime = np.where(np.arange(60) >= opened + 2, 2, 0)
    closed = pw.spread_equity(ca, cb, 1.0, 20, 1.0, 0.0, regime=regime)
    assert (closed[: opened + 2] == free[: opened + 2]).all() and (closed[opened + 2 :] == closed[opened + 2]).all()


def test_the_filter_trades_its_innovations():
    rng = np.random.Generator(np.random.PCG64(2))
    lb = np.cumsum(rng.normal(0, 0.01, 120)) + 4
    la = 0.3 + 0.9 * lb + rng.normal(0, 0.01, 120)
    error, sd = pairs.kalman(la, lb, with_deviation=True)
    assert (error == pairs.kalman(la, lb)).all() and (sd > 0).all()
    assert len(pw.spread_equity(np.exp(la), np.exp(lb), 1.0, 30, 0.1, 0.02, adaptive=True)) == 120


def test_short_histories_have_no_windows(spark):
    assert pw.walk(frame(spark, universe(n=110)), TRAIN, TEST).collect() == []
