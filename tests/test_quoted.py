"""Significance of ratios, buying and holding, and signals on quoted bars, against plain loops."""

import datetime as dt
import math
import statistics as stats

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import folds, overlays, quoted
from marketloom.operators import significance as sg
from marketloom.operators import statistics as st
from marketloom.plans.rel import Rel


def test_normal_cdf_column(spark):
    xs = [-12.0, -9.0, -5.5, -2.0, -1e-9, 0.0, 0.3, 1.96, 4.0, 8.9, 9.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", sg.normal_cdf_column(F.col("x")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=2e-15)


def test_significance_of_streams(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    streams = {f"S{j}": rng.normal(0.0005 * j, 0.01, 150) ** (1 if j % 2 else 3) for j in range(6)}
    streams |= {"flat": np.zeros(20), "few": np.array([0.1, 0.2, -0.1])}
    df = spark.createDataFrame([(k, i, float(v)) for k, own in streams.items() for i, v in enumerate(own)] + [("S1", 999, None)], "symbol string, ts int, r double")
    got = {r["symbol"]: r for r in sg.significance(df, per_year=252.0).collect()}
    ratio = {k: v.mean() / v.std() if len(v) >= 4 and v.std() > 0 else 0.0 for k, v in streams.items()}
    top = st.expected_max_sharpe(len(streams), stats.pvariance(ratio.values()))
    for k, v in streams.items():
        assert got[k]["n"] == len(v) and got[k]["sharpe"] == pytest.approx(ratio[k] * math.sqrt(252), abs=1e-9)
        assert got[k]["expected_max"] == pytest.approx(top, abs=1e-8)
        if ratio[k]:
            z = (v - v.mean()) / v.std()
            for name, against in (("probabilistic", 0.0), ("deflated", top)):
                assert got[k][name] == pytest.approx(st.probabilistic_sharpe(ratio[k], len(v), (z**3).mean(), (z**4).mean(), against), abs=1e-8)
            assert got[k]["p_value"] == pytest.approx(st.sharpe_pvalue(ratio[k] * math.sqrt(len(v))), abs=1e-10)
        else:
            assert (got[k]["probabilistic"], got[k]["deflated"], got[k]["p_value"]) == (0.0, 0.0, 1.0)


def test_buy_and_hold(spark):
    t0, rng = dt.datetime(2024, 1, 2, 10), np.random.Generator(np.random.PCG64(3))
    closes = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, 40)))
    rows = [("A", t0 + dt.timedelta(days=i // 4, hours=i % 4), float(c)) for i, c in enumerate(closes)] + [("A", t0 + dt.timedelta(days=20), None), ("B", t0, 5.0)]
    got = {r["symbol"]: r for r in sg.buy_and_hold(spark.createDataFrame(rows, "symbol string, ts timestamp, close double")).collect()}
    a, ret, top = got["A"], closes[1:] / closes[:-1] - 1, np.maximum.accumulate(closes)
    assert (a["n"], a["periods_per_year"]) == (40, 4 * 252.0)
    assert a["total_return"] == pytest.approx(closes[-1] / closes[0] - 1) and a["max_drawdown"] == pytest.approx((closes / top - 1).min())
    assert a["sharpe"] == pytest.approx(ret.mean() / ret.std() * math.sqrt(1008))
    assert tuple(got["B"])[1:] == (1, 252.0, 0.0, 0.0, 0.0)


QUOTES = "symbol string, session string, ts int, bid double, ask double, bid_size double, ask_size double"


def quote_rows(n=260):
    rng, out = np.random.Generator(np.random.PCG64(5)), []
    for s in "AB":
        bid = 10.0
        for i in range(n):
            bid = round(bid + float(rng.choice([-0.01, 0, 0, 0.01])), 2)
            size = [float(x) for x in rng.integers(1, 9, 2)]
            out.append((s, f"d{i // (40 + 25 * (s == 'B'))}", i, bid, round(bid + float(rng.choice([0.0, 0.01, 0.02])), 2), *size) if rng.random() > 0.05 else (s, f"d{i // 50}", i, bid, None, *size))
    return out


def plain_flow(rows, window):
    out, past = {}, {}
    for s, session, i, *q in sorted(rows, key=lambda r: (r[0], r[2])):
        if None in q:
            out[s, i] = None
            continue
        bid, ask, bs, az = q
        held = past.setdefault((s, session), {"prev": None, "e": [], "size": []})
        if held["prev"]:
            pb, pa, pbs, paz = held["prev"]
            e = (bs if bid > pb else bs - pbs if bid == pb else -pbs) - (-paz if ask > pa else az - paz if ask == pa else az)
            held["e"].append(e)
            held["size"].append(bs + az)
        held["prev"] = (bid, ask, bs, az)
        out[s, i] = sum(held["e"][-window:]) / (sum(held["size"][-window:]) or 1.0) if len(held["e"]) >= window else None
    return out


@pytest.mark.parametrize("short", [False, True])
def test_flow_of_a_session_and_its_positions(spark, short):
    rows = quote_rows()
    df = quoted.flow(spark.createDataFrame(rows, QUOTES).repartition(3), 8)
    got = {(r["symbol"], r["ts"]): (r["ofi"], r["position"]) for r in quoted.positioned(df, "ofi", 0.2, 0.05, short).collect()}
    want, held, turns = plain_flow(rows, 8), {}, 0
    assert set(got) == set(want)
    for (s, i), v in sorted(want.items()):
        side = held.get(s, "")
        if v is not None:
            if side == "":
                side = "LONG" if v > 0.2 else "SHORT" if short and v < -0.2 else ""
            elif (side == "LONG" and v < 0.05) or (side == "SHORT" and v > -0.05):
                side = ""
        turns += side != held.get(s, "")
        held[s] = side
        assert got[s, i] == (pytest.approx(v) if v is not None else None, {"": 0, "LONG": 1, "SHORT": -1}[side])
    assert turns > 10
    levels = {r["symbol"]: r for r in quoted.flow_levels(df, 8).collect()}
    sizes = {}
    for s, session, i, *q in rows:
        if None not in q:
            sizes[s, session] = sizes.get((s, session), 0) + 1
    for s in "AB":
        kept = [abs(want[s, i]) for t, session, i, *q in rows if t == s and None not in q and sizes[s, session] > 8 and want[s, i] is not None]
        assert levels[s]["n"] == len(kept) and levels[s]["p90"] == pytest.approx(np.quantile(kept, 0.9))


def test_tilt_positions_and_the_gate(spark):
    rows = quote_rows(120)
    df = spark.createDataFrame(rows, QUOTES).withColumn("tilt", quoted.tilt(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size")))
    got = {(r["symbol"], r["ts"]): (r["tilt"], r["position"]) for r in quoted.positioned(df, "tilt", 0.5, 0.5, True, strict=True).collect()}
    side = {}
    for s, _, i, bid, ask, bs, az in sorted(rows, key=lambda r: (r[0], r[2])):
        t = None
        if ask is not None and ask > bid:
            half = (ask - bid) / 2
            t = ((ask * bs + bid * az) / (bs + az) - (bid + ask) / 2) / half
        now = side.get(s, 0)
        if t is not None:
            lean = 1 if t > 0.5 else -1 if t < -0.5 else 0
            now = lean if now == 0 else now if lean == now else 0
        side[s] = now
        assert got[s, i] == (pytest.approx(t) if t is not None else None, now)
    rng = np.random.Generator(np.random.PCG64(6))
    closes = 10 + np.cumsum(rng.normal(0, 0.05, 120))
    bars = spark.createDataFrame([(s, i, float(closes[i]), float(closes[i]) + 0.05, float(closes[i]) - 0.05, float(closes[i]), 1.0, bid, ask, bs, az) for s, _, i, bid, ask, bs, az in rows],
                                 "symbol string, ts int, open double, high double, low double, close double, volume double, bid double, ask double, bid_size double, ask_size double")
    said = {(r["symbol"], r["ts"]): (r["signal"], r["blocked"]) for r in quoted.gated(bars, "ema_cross").collect()}
    blocked = 0
    for s in "AB":
        state, act = folds.State(), folds.make("ema_cross")
        for t, _, i, *_q in rows:
            if t == s:
                c = float(closes[i])
                state.push({"open": c, "high": c + 0.05, "low": c - 0.05, "close": c, "volume": 1.0})
                want = act(state)
                stop = want == "buy" and not (got[s, i][0] is not None and got[s, i][0] > 0.5)
                blocked += stop
                if not stop:
                    state.position = 1 if want == "buy" else 0 if want == "sell" else state.position
                assert said[s, i] == (None if stop else want, stop)
    assert blocked > 0


def test_expiry_week_leaves_weekends_out(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    got = {r["ts"] for r in overlays.expiry_week(Rel.table("d")).df({"d": spark.createDataFrame([(d,) for d in days], "ts date")}).where("expiry = 1").collect()}
    thirds = [d for d in days if d.weekday() == 4 and 15 <= d.day <= 21]
    assert got == {f - dt.timedelta(days=i) for f in thirds for i in range(5)}


def test_nothing_outlives_a_query(spark, tmp_path):
    """A plan that is shared within a query is read anew by the next one."""
    shared = Rel.shared("x", Rel.table("t").with_(b="a * 2"))
    for factor in (1, 10):
        df = spark.createDataFrame([(factor * i,) for i in range(5)], "a int")
        df.write.mode("overwrite").parquet(str(tmp_path / "t"))
        both = shared.select("a", "b").join(shared.select("a", c="b"), "a")
        assert both.df({"t": spark.read.parquet(str(tmp_path / "t"))}).agg({"c": "sum"}).first()[0] == 20 * factor
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


@pytest.mark.parametrize("require", [True, False])
def test_the_gate_streams_and_carries_its_state_from_batch_to_batch(spark, require):
    """No task holds a symbol: batches of seven bars give what the whole rows give, also for no symbol, missing quotes and bars of one ts."""
    rng, rows = np.random.Generator(np.random.PCG64(9)), []
    for s, n in (("A", 150), (None, 90), *((f"T{i}", 3 + i) for i in range(6)), ("B", 151)):
        closes = (10 + np.cumsum(rng.normal(0, 0.05, n))).round(4)
        for i, c in enumerate(closes.tolist()):
            quote = (c, None if i % 11 == 0 else round(c + float(rng.choice([0.0, 0.01, 0.02])), 4), *rng.integers(1, 9, 2).astype(float).tolist())
            rows.append((s, i // 2 if s == "B" else i, c, c + 0.1, c - 0.1, c, 1.0, *quote))
    bars = spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume double, bid double, ask double, bid_size double, ask_size double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = quoted.gated(bars.repartition(3), "ema_cross", 0.25, require)
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
        got = sorted(map(tuple, df.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in {r[0] for r in rows}:
        state, act = folds.State(), folds.make("ema_cross")
        for _, t, o, h, low, c, v, bid, ask, bs, az in sorted((r for r in rows if r[0] == s), key=lambda r: r[1:7]):
            lean = ((ask * bs + bid * az) / (bs + az) - (bid + ask) / 2) / ((ask - bid) / 2) if ask is not None and ask > bid else None
            state.push({"open": o, "high": h, "low": low, "close": c, "volume": v})
            said = act(state)
            stop = said == "buy" and not (not require if lean is None else lean > 0.25)
            if not stop and said:
                state.position = int(said == "buy")
            want.append((s, t, None if stop else said, stop))
    assert got == sorted(want, key=repr) and sum(r[3] for r in want) > 5 and sum(r[2] == "sell" for r in want) > 2
