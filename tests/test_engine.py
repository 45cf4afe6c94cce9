"""Hand cases and invariants of the engine."""

import datetime as dt
import json
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from marketloom.functions import windows as w
from marketloom.operators import execution as ex
from marketloom.operators import folds, pairs, panel, portfolio, statistics
from marketloom.plans import catalogue
from marketloom.plans.rel import Rel
from marketloom.sources import tables as t
from marketloom.streaming import bars as stream

SF = "/root/testdata/sf0.001"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def frame(spark, rows, schema="symbol string, ts date, close double"):
    return spark.createDataFrame(rows, schema)


def values(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("symbol", "ts").collect()]


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) >= 150


@pytest.mark.parametrize("name", ["bars_weekly", "alpha_a2_volume_change", "factor_value_daily", "join_step_net_income", "pairs_screen", "risk_codes", "join_asof_quotes", "combine_correlations"])
def test_queries_equal_their_sql(spark, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for table in t.SCHEMA_NAMES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = db.sql(catalogue.ORACLES[name]).df()[list(got.columns)]
    key = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert len(got) and key(got) == key(expected)


def test_common_calendar_and_prices(spark):
    rows = [("A", day(i), 10.0 + i) for i in range(4)] + [("B", day(i + 1), 20.0 + 2 * i) for i in range(4)]
    got = panel.common(Rel.table("bars")).df({"bars": frame(spark, rows)})
    assert sorted({r["ts"] for r in got.collect()}) == [day(2), day(3)]
    rows = [("A", day(0), 10.0), ("A", day(1), 0.0), ("A", day(2), 12.0), ("B", day(0), 20.0), ("B", day(1), 21.0), ("B", day(2), 22.0)]
    assert {r["ts"] for r in panel.common(Rel.table("bars")).df({"bars": frame(spark, rows)}).collect()} == {day(2)}


def test_asof_with_staleness(spark):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    bars = spark.createDataFrame([("A", at(s), s) for s in (4, 5, 9, 30)], "symbol string, ts timestamp, n int")
    quotes = spark.createDataFrame([("A", at(5), 1.0), ("A", at(10), 2.0)], "symbol string, ts timestamp, bid double")
    got = panel.asof(bars, quotes, ["symbol"], "ts", ["bid"], most=10)
    assert [r["bid"] for r in got.orderBy("n").collect()] == [None, 1.0, 1.0, None]


def test_rolling_expressions(spark):
    rows = [("A", day(i), v) for i, v in enumerate([1.0, 2.0, 2.0])] + [(s, day(9), v) for s, v in (("A", 3.0), ("B", None), ("C", 1.0), ("D", 2.0))]
    df = Rel.table("x").with_(decay=w.decay_linear("close", 3), rank=w.ts_rank("close", 3), x=w.xrank("close")).df({"x": frame(spark, rows)})
    got = {(r["symbol"], r["ts"]): r for r in df.collect()}
    assert got["A", day(2)]["rank"] == 1.0 and got["A", day(2)]["decay"] == pytest.approx((1 + 4 + 6) / 6)
    assert [got[s, day(9)]["x"] for s in "ABCD"] == [1.0, None, 1 / 3, 2 / 3]


def test_windows_see_no_later_rows(spark):
    bars = t.bars().df(t.tables(spark, SF)).cache()
    cut = sorted(r["ts"] for r in bars.select("ts").distinct().collect())[40]
    for signal in (portfolio.momentum(panel.dense(Rel.table("bars")), 5), portfolio.near_high(panel.dense(Rel.table("bars")), 10)):
        full, part = (signal.df({"bars": b}).where(f"ts <= DATE'{cut}'").select("symbol", "ts", "signal") for b in (bars, bars.where(f"ts <= DATE'{cut}'")))
        assert sorted(map(str, full.collect())) == sorted(map(str, part.collect()))


def test_step_and_interval(spark):
    calendar = Rel.table("bars")
    bars = frame(spark, [("A", day(i), 1.0) for i in range(0, 300, 5)])
    facts = spark.createDataFrame([("A", dt.date(2022, 12, 31), day(5), 1.0), ("A", dt.date(2023, 12, 31), day(200), 2.0), ("A", dt.date(2023, 12, 31), day(250), None)], "symbol string, fy_end date, filed date, x double")
    got = dict(values(panel.step(calendar, Rel.table("facts"), "x").df({"bars": bars, "facts": facts}), "ts", "value"))
    assert (got[day(0)], got[day(5)], got[day(195)], got[day(200)], got[day(290)]) == (None, 1.0, 1.0, 2.0, 2.0)
    paid = spark.createDataFrame([("A", day(10), 3.0)], "symbol string, ex date, amount_paid double")
    got = dict(values(panel.interval_sum(calendar, Rel.table("paid"), "amount_paid", "ex").df({"bars": bars, "paid": paid}), "ts", "credited"))
    assert got[day(10)] == 3.0 and sum(got.values()) == 3.0


def test_driving_signal_pays(spark):
    rng = np.random.Generator(np.random.PCG64(1))
    rows = []
    for k in range(16):
        price = 100.0
        for i in range(120):
            price *= 1 + (k - 7.5) * 2e-4 + rng.normal(0, 1e-3)
            rows.append((f"S{k:02d}", day(i), price, price, price, price, 1.0, float(k)))
    df = frame(spark, rows, "symbol string, ts date, open double, high double, low double, close double, volume double, score double")
    p = panel.dense(Rel.table("bars"))
    total = {}
    for high in (True, False):
        daily = portfolio.factor(p.with_(signal="score"), 3, 5, 0.0, high)
        total[high] = statistics.summary(daily, 252.0).df({"bars": df}).first()["total"]
    assert total[True] > 0 > total[False]


def test_microstructure_cases(spark):
    q = spark.createDataFrame([("A", 1, 1, 10.0, 11.0, 3.0, 1.0), ("B", 1, 2, 10.0, 10.5, 2.0, 4.0), ("B", 2, 3, 10.1, 10.5, 5.0, 6.0), ("C", 1, 4, 5.0, 5.0, 1.0, 1.0)], "symbol string, ts int, event_id int, bid double, ask double, bid_size double, ask_size double")
    got = {r["event_id"]: r for r in ex.microprice(Rel.table("q")).df({"q": q}).collect()}
    assert (got[1]["micro"], got[1]["tilt"], got[4]["tilt"]) == (10.75, 0.5, None)
    flow = {r["event_id"]: r["e"] for r in ex.order_flow(Rel.table("q")).df({"q": q}).collect()}
    assert flow[3] == 5.0 - (6.0 - 4.0)
    row = spark.sql(f"SELECT {ex.sell_fee('100D', '50D')} AS fee, {ex.fill_limit('100D', '98D', '101D', '97D', 'true')['price']} AS better, {ex.fill_limit('99D', '99.8D', '101D', '99.5D', 'true')['price']} AS untouched").first()
    assert row["fee"] == pytest.approx(0.1556) and row["better"] == 98 and row["untouched"] is None


def test_statistics_cases(spark):
    assert statistics.combined_sharpe(0.5, 4, 0) == 1.0 and statistics.combined_sharpe(0.5, 4, 0.3) == pytest.approx(0.7255, abs=1e-4)
    assert statistics.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-5)
    column = spark.range(1).select(*[statistics.normal_ppf_column(F.lit(p)).alias(f"p{i}") for i, p in enumerate((0.01, 0.5, 0.975)) for F in [__import__("pyspark.sql.functions", fromlist=["lit"])]]).first()
    assert [round(x, 5) for x in column] == [-2.32635, 0.0, 1.95996]
    eq = spark.createDataFrame([(i, float(x)) for i, x in enumerate((100, 120, 90, 130))], "ts int, equity double")
    assert statistics.drawdown(Rel.table("e")).df({"e": eq}).first()[0] == -0.25
    assert statistics.expected_max_sharpe(1, 0.1) == 0.0 < statistics.expected_max_sharpe(40, 0.1)
    assert pairs.adf_pvalue(-2.86) == 0.05 and pairs.adf_pvalue(-9) == 0.005


def test_pairs_find_cointegration(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    walk, s, rows = 4.0, 0.0, []
    for i in range(300):
        walk, s = walk + rng.normal(0, 0.01), 0.9 * s + rng.normal(0, 0.01)
        rows += [("A", day(i), math.exp(walk + s)), ("B", day(i), math.exp(walk))]
    noise = 4.0
    for i in range(300):
        noise += rng.normal(0, 0.02)
        rows.append(("C", day(i), math.exp(noise)))
    df = frame(spark, rows)
    got = pairs.screen(Rel.table("bars"), 120, 2.0, 30.0, -2.86).df({"bars": df}).collect()
    assert ("A", "B") in {(r["left_key"], r["right_key"]) for r in got}
    out = pairs.walk_forward(df, train=120, test=40, top=1, longest=30.0, lookback=20, enter=1.0).collect()
    assert {(r["left_key"], r["right_key"]) for r in out} >= {("A", "B")} and min(r["ts"] for r in out) == day(120)


def bars_of(closes, opens=None):
    opens = closes if opens is None else opens
    return pd.DataFrame([{"ts": i, "open": o, "high": max(o, c) + 0.5, "low": min(o, c) - 0.5, "close": c, "volume": 1.0} for i, (o, c) in enumerate(zip(opens, closes))])


def test_signals_fill_at_the_next_open():
    got = folds.simulate(bars_of([100.0] * 6 + [110, 120], [100.0] * 6 + [100, 120]), folds.donchian(5, 3), cost_bps=0.0)
    bought = got[got["fill"] == "buy"]
    assert bought["ts"].tolist() == [7] or got["qty"].iloc[-1] == 0.0
    last = folds.simulate(bars_of([100.0] * 6 + [110], [100.0] * 7), folds.donchian(5, 3))
    assert (last["equity"] == 100_000.0).all()


@pytest.mark.parametrize("name", folds.available())
def test_strategies_are_causal(name):
    rng = np.random.Generator(np.random.PCG64(3))
    b = bars_of((100 * np.exp(np.cumsum(rng.normal(0, 0.02, 160)))).tolist())
    b["session"] = (b["ts"] // 8).astype(str)
    full, part = folds.simulate(b, folds.make(name)), folds.simulate(b.iloc[:120], folds.make(name))
    assert np.allclose(full["equity"].iloc[:119], part["equity"].iloc[:119])


@pytest.mark.parametrize("qty", [0.0, 100.0, -100.0])
@pytest.mark.parametrize("side", ["buy", "sell"])
@pytest.mark.parametrize("size", [10.0, 60.0, 120.0])
def test_fills_conserve_equity(qty, side, size):
    after, avg, realised, cash = folds.apply_fill(qty, 50.0, side, size, 55.0)
    assert cash + after * 55 == pytest.approx(-qty * 0 + qty * 55) and (after != 0 or avg == 0)
    assert realised == pytest.approx((after * avg - qty * 50.0) + cash)


def test_rsi_extremes():
    assert folds.rsi([1, 2, 3, 4, 5.0], 3) == 100.0 and folds.rsi([1.0] * 6, 3) == 50.0


def test_streams_drop_late_bars_and_signal(spark, tmp_path):
    def write(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"symbol": "A", "ts": f"2024-01-01T00:00:{s:02d}Z", "open": c, "high": c, "low": c, "close": c, "volume": 1.0}) for s, c in rows))

    write("1.json", [(1, 1.0), (3, 3.0)])
    write("2.json", [(2, 2.0), (3, 9.0), (4, 4.0)])
    fresh = stream.newer(stream.replay(spark, str(tmp_path / "in")))
    query = fresh.writeStream.format("memory").queryName("fresh").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["close"] for r in spark.table("fresh").orderBy("ts").collect()] in ([1.0, 3.0, 4.0], [2.0, 9.0, 4.0], [2.0, 3.0, 4.0])
    live = stream.signals(stream.replay(spark, str(tmp_path / "in"), 2), "ema_cross")
    query = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("live").count() == 5


def test_sources(spark, tmp_path):
    assert t.timeframe("1h") == 3600
    with pytest.raises(ValueError):
        t.timeframe("7min")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "id string, v int")
    t.append_new(df, str(tmp_path / "s"), ["id"])
    assert t.append_new(spark.createDataFrame([("B", 3), ("C", 4)], "id string, v int"), str(tmp_path / "s"), ["id"]).count() >= 0
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["A", "B", "C"]
