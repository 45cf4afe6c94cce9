"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.operators import alphas, panel
from marketloom.plans.rel import Rel
from marketloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rel(name: str, plan: Rel) -> None:
    """Register a plan and its SQL."""
    QUERIES[name] = lambda spark, sf_dir: plan.df(t.tables(spark, sf_dir))
    ORACLES[name] = plan.sql(t.SCHEMA_NAMES)


def shown(plan: Rel, *values: str, digits: int = 8, keys: tuple = ("symbol", "ts")) -> Rel:
    """The keys, times as text, and rounded values."""
    return plan.select(*[k for k in keys if k != "ts"], **({"ts": "CAST(ts AS STRING)"} if "ts" in keys else {}), **{v: f"round(CAST({v} AS DOUBLE), {digits}) + 0.0" for v in values})


BARS = Rel.shared("bars", t.bars())
PANEL = panel.dense(BARS)

rel("bars_weekly", shown(BARS, "open", "high", "low", "close", "volume"))
rel("panel_dense", shown(PANEL, "close", "own", "ret", "vwap"))
rel("panel_common_returns", shown(panel.common(BARS, 10), "ret"))
rel("market_return", shown(panel.market(PANEL), "bench", keys=("ts",)))
for _name in alphas.STAGES:
    rel(f"alpha_{_name}", shown(alphas.alpha(PANEL, _name), "alpha"))

from marketloom.functions import windows as w  # noqa: E402
from marketloom.operators import portfolio as p  # noqa: E402
from marketloom.operators import statistics as st  # noqa: E402

YEAR = 52.0
FACTS = Rel.shared("facts", t.fundamentals())
BENCH = panel.market(PANEL)
MARKET = p.with_market(PANEL, BENCH)
SECTOR = "CAST(CAST(substr(symbol, 2, 2) AS INT) % 4 AS STRING)"
K = p.k_of(16, 0.2)
DAYS = ("ts",)


def stats(name: str, daily: Rel, *keys: str) -> None:
    """A daily table and its summary."""
    rel(f"{name}_daily", shown(daily, "net", keys=DAYS))
    rel(f"{name}_summary", shown(st.summary(daily, YEAR, "net", *keys), "n", "sharpe", "tstat", "sortino", "vol", "skew", "kurt", "total", digits=6, keys=keys))


# rolling and cross-sectional primitives
for _name, _e in {
    "delay": w.delay("close", 3), "delta": w.delta("close", 3), "sum": w.ts_sum("ret", 6), "mean": w.ts_mean("close", 6), "std": w.ts_std("ret", 6), "rank": w.ts_rank("close", 6), "min": w.ts_min("low", 6), "max": w.ts_max("high", 6),
    "argmax": w.ts_argmax("high", 6), "argmin": w.ts_argmin("low", 6), "decay": w.decay_linear("ret", 6), "corr": w.rolling_corr("close", "volume", 8), "cov": w.rolling_cov("close", "volume", 8), "signed_power": w.signed_power("ret", 2.0),
    "z_prior": w.z_prior("close", 10), "xrank": w.xrank("close"), "rank01": w.rank01("close"), "scale": w.scale("ret"), "zscore_rows": w.zscore_rows("close"), "zscore_columns": w.zscore_columns("close"),
}.items():
    rel(f"window_{_name}", shown(PANEL.with_(v=_e), "v", digits=3 if _name == "cov" else 8))
rel("window_sector_demean", shown(PANEL.with_(sector=SECTOR).with_(v=w.demean("close", "sector")), "v"))
rel("window_atr", shown(BARS.with_(tr=w.true_range()).with_(atr=f"avg(tr) {w.last(14)}", before=f"avg(tr) {w.last(14, 1)}"), "atr", "before"))
rel("window_return_volatility", shown(BARS.with_(r=f"ln(close / lag(close) {w.SERIES})").with_(vol=f"CASE WHEN count(r) {w.last(20)} >= 2 THEN stddev_pop(r) {w.last(20)} * sqrt(52.0) ELSE 0.15 END"), "vol"))
rel("window_mean_variance", shown(BARS.with_(r=f"close / lag(close) {w.SERIES} - 1.0").with_(mu=f"avg(close) {w.last(20, 1)}", var=f"var_pop(r) {w.last(20)}").with_(n=w.ROW).where("n > 20"), "mu", "var"))
rel("window_donchian", shown(BARS.with_(top=f"max(high) {w.last(20, 1)}", bottom=f"min(low) {w.last(20, 1)}").with_(breakout="CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 ELSE 0 END"), "top", "bottom", "breakout"))
rel("window_bollinger", shown(BARS.with_(m=f"avg(close) {w.last(20)}", s=f"stddev_pop(close) {w.last(20)}", n=w.ROW).where("n >= 20").with_(upper="m + 2.0 * s", lower="m - 2.0 * s"), "m", "upper", "lower"))

# alignment
rel("join_step_net_income", shown(panel.step(PANEL, FACTS, "net_income"), "value", digits=6))
rel("join_interval_sum", shown(panel.interval_sum(BARS, FACTS.with_(dividend="fcf / shares"), "dividend", "filed"), "credited"))
rel("join_nearest_statement", shown(panel.nearest(BARS.select("symbol", "ts"), FACTS, "shares", "fy_end", 120), "value", digits=6))
rel("join_tail_alignment", shown(panel.tail(BARS), "place", "close"))
rel("join_market_left", shown(MARKET, "b"))
rel("join_inner_pair", BARS.where("symbol = 'S01'").select("ts", x="close").join(BARS.where("symbol = 'S02'").select("ts", y="close"), "ts").select(ts="CAST(ts AS STRING)", spread="round(ln(x) - 0.8 * ln(y), 8)"))
rel("facts_yearly", FACTS.select("symbol", "fy", filed="CAST(filed AS STRING)", net_income="net_income", total_assets="total_assets", shares="shares"))
rel("facts_accruals", p.accruals(FACTS).select("symbol", "fy", accrual="round(accrual, 8)"))
rel("facts_surprise", FACTS.with_(ue=f"net_income - lag(net_income) OVER (PARTITION BY symbol ORDER BY fy_end)").with_(sd="stddev_pop(ue) OVER (PARTITION BY symbol ORDER BY fy_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", n="count(ue) OVER (PARTITION BY symbol ORDER BY fy_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").select("symbol", "fy", sue="CASE WHEN n >= 2 THEN round(ue / nullif(sd, 0.0), 8) END"))

# signals
_SIGNALS = {
    "momentum": p.momentum(PANEL, 12), "short_return": p.momentum(PANEL, 5), "skip_momentum": p.momentum(PANEL, 48, 4), "max_return": p.max_return(PANEL, 21), "idiosyncratic_vol": p.idiosyncratic_vol(MARKET, 52),
    "residual_momentum": p.residual_momentum(MARKET, 52, 4), "vol_managed": p.vol_managed_momentum(PANEL, 52, 4, 26), "low_beta": p.low_beta(MARKET, 52), "near_high": p.near_high(PANEL, 52), "gap": p.gap(PANEL), "seasonality": p.seasonality(PANEL, 8),
    "asset_growth": p.step_signal(PANEL, p.growth(FACTS, "total_assets"), "growth"), "net_issuance": p.step_signal(PANEL, p.growth(FACTS, "shares"), "growth"),
    "roa": p.step_signal(PANEL, FACTS.with_(x="net_income / total_assets"), "x"), "gross_profit": p.step_signal(PANEL, FACTS.with_(x="(revenue - cogs) / total_assets"), "x"), "accruals": p.step_signal(PANEL, p.accruals(FACTS), "accrual"),
    "value": p.value_composite(PANEL, FACTS), "value_sector_momentum": p.value_composite(PANEL, FACTS, SECTOR, 0.5),
}
for _name, _s in _SIGNALS.items():
    rel(f"signal_{_name}", shown(_s, "signal", digits=10))

# portfolio engines
for _name, _high in {"momentum": True, "max_return": False, "idiosyncratic_vol": False, "residual_momentum": True, "vol_managed": True, "seasonality": True, "asset_growth": False, "net_issuance": False, "roa": True, "gross_profit": True, "value": True, "value_sector_momentum": True}.items():
    stats(f"factor_{_name}", p.factor(_SIGNALS[_name], K, 4, long_high=_high))
stats("cross_sectional_momentum", p.cross_sectional(BARS, 12, 4, K))
stats("cross_sectional_reversal", p.cross_sectional(BARS, 12, 4, K, reverse=True))
stats("near_high_tranches", p.overlapping(_SIGNALS["near_high"], K, 4))
stats("gap_reversion", p.overlapping(_SIGNALS["gap"], K, 5, long_high=False))
stats("overnight_reversal", p.overnight_reversal(PANEL, 1, K))
stats("low_beta", p.factor(_SIGNALS["low_beta"], K, 4))
stats("accrual_daily_rank", p.daily(_SIGNALS["accruals"], K, long_high=False))
_REPORTS = Rel.table("orders").select(symbol="concat('S', lpad(CAST(o_custkey % 16 AS STRING), 2, '0'))", settled="CAST(date_trunc('month', o_orderdate) AS DATE)", p="o_totalprice").group("symbol", "settled", days_to_cover="round(avg(p) / 20000.0, 4)")
rel("signal_short_interest", shown(p.short_interest(PANEL, _REPORTS, 2), "signal", digits=10))
_BORROW = (0.01, 0.002, 0.05)
stats("short_interest_tilt", p.short_interest_tilt(BARS, _REPORTS, K, 2, borrow=_BORROW, per_year=YEAR))
stats("short_interest_chase", p.short_interest_tilt(BARS, _REPORTS, K, 2, borrow=_BORROW, per_year=YEAR, reverse=False))
for _mode in ("tsmom", "long_vol", "ew_bh"):
    stats(f"trend_{_mode}", p.time_series_momentum(PANEL, 26, 13, 4, YEAR, mode=_mode))
rel("factor_momentum_equity", shown(p.equity(p.factor(_SIGNALS["momentum"], K, 4)), "equity", digits=4, keys=DAYS))
rel("factor_momentum_drawdown", st.drawdown(p.equity(p.factor(_SIGNALS["momentum"], K, 4))).select(max_drawdown="round(max_drawdown, 8)"))
_ONE = BARS.where("symbol = 'S03'")
_ALL = {"turn_of_month": p.calendar_position(BARS), "inventory": p.inventory_target(BARS, 20), "band": p.band_target(BARS, "close", 20, 1.0, 0.25)}
_ALL["before_event"] = p.before_event_position(BARS, Rel.table("orders").select(ts="CAST(date_trunc('week', o_orderdate) AS DATE)", p="o_totalprice").group("ts", top="max(p)").where("month(ts) % 3 = 0"), 1)
for _name, _r in _ALL.items():
    rel(f"position_{_name}", shown(p.positioned(_r), "position", "net"))

_DTC_CHANGE = _REPORTS.where("days_to_cover IS NOT NULL").with_(before="lag(days_to_cover) OVER (PARTITION BY symbol ORDER BY settled)").where("before IS NOT NULL").select("symbol", "settled", days_to_cover="round(days_to_cover - before, 8)")
rel("signal_short_interest_change", shown(p.short_interest(PANEL, _DTC_CHANGE, 2), "signal", digits=10))

# events
_SURPRISES = p.growth(FACTS, "net_income").where("growth IS NOT NULL").select("symbol", event_ts="filed", surprise="round(100.0 * growth, 8)")
for _leg in ("both", "long", "short"):
    stats(f"event_drift_{_leg}", p.event_drift(BARS, _SURPRISES, 8, 1, 2.0, _leg, 0.03 if _leg == "short" else 0.0, YEAR))
_EAR = p.announcement_returns(BARS, _SURPRISES)
rel("event_announcement_returns", _EAR.select("symbol", event_ts="CAST(event_ts AS STRING)", surprise="round(surprise, 8)"))
stats("event_announcement_drift", p.event_drift(BARS, _EAR, 8, 3, 1.0))
_BUYS = Rel.table("orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select(symbol="concat('S', lpad(CAST(o_custkey % 16 AS STRING), 2, '0'))", bought="CAST(o_orderdate AS DATE)")
rel("event_recent_buyers", p.recent_buyers(BARS, _BUYS, 30).group("ts", names="count(*)", mean="avg(close)").select("names", ts="CAST(ts AS STRING)", mean="round(mean, 10)"))

# evaluation and combination
_MOM, _VAL = p.factor(_SIGNALS["momentum"], K, 4), p.factor(_SIGNALS["roa"], K, 4)
rel("evaluate_beta_alpha", st.beta_alpha(_MOM, BENCH, YEAR).select("n", beta="round(beta, 8)", alpha="round(alpha, 8)", ir="round(ir, 8)"))
rel("evaluate_segments", shown(st.segments(_MOM, 4, YEAR), "segment", "n", "sharpe", digits=6, keys=()))
rel("evaluate_years", shown(st.by_year(_MOM, YEAR), "year", "n", "sharpe", digits=6, keys=()))
_STREAMS = PANEL.where("ret IS NOT NULL").select("symbol", "ts", r="ret")
rel("combine_correlations", st.correlations(_STREAMS).select("left_key", "right_key", "n", rho="round(rho, 8)"))
rel("combine_inverse_vol", st.inverse_vol_weights(_STREAMS).select("symbol", weight="round(weight, 8)"))
stats("combine_blend", st.blend(_STREAMS, st.inverse_vol_weights(_STREAMS)))
_COMBO = ("avg_abs_corr", "ew_sharpe", "iv_sharpe", "vol", "leverage", "applied_vol", "excess", "expected", "day_excess", "day_vol", "noise_to_edge")
rel("combine_report", st.combo_report(_STREAMS, YEAR).select("n", **{v: f"round({v}, 7) + 0.0" for v in _COMBO}))
_SLEEVES = BARS.select("symbol").distinct().select(sleeve="symbol", weight="0.05 + CAST(substr(symbol, 2, 2) AS DOUBLE) / 100.0", cap="CASE WHEN symbol = 'S00' THEN 0.04 END")
stats("combine_sleeves", st.combine_tracks(_STREAMS.select("ts", "r", sleeve="symbol"), _SLEEVES))
rel("gate_leg", st.leg_gate(_VAL, _MOM, YEAR).select("n", "enough_overlap", "forward_positive", "uncorrelated", "lifts", "robust_loo", "partial_year_safe", "passed", rho="round(rho, 8)", lift="round(lift, 8)", loo_share="round(loo_share, 8)", without_last="round(without_last, 8)"))
rel("gate_leave_one_year_out", st.leave_one_year_out(_VAL, _MOM).select("dropped", "n", lift="round(lift, 8)", mix_ratio="round(mix_ratio, 8)"))
_INDEX = p.equity(BENCH.with_(net="bench")).select("ts", symbol="'EW'", close="round(equity, 6)")
rel("regime_labels", st.regime(_INDEX, 13, YEAR, 0.01, 0.12).select("regime", ts="CAST(ts AS STRING)"))

from marketloom.functions import calendar as cal  # noqa: E402
from marketloom.operators import execution as ex  # noqa: E402
from marketloom.operators import pairs  # noqa: E402

QUOTES = t.quotes()
FILLS = ex.fills(BARS)
rel("pairs_screen", pairs.screen(BARS, 120, 2.0, 200.0).select("left_key", "right_key", "n", "hedge", "half_life", adf="round(adf, 6)"))
rel("pairs_reversion", pairs.reversion(BARS, 60).select("left_key", "right_key", "n", hedge="round(hedge, 7)", adf="round(adf, 6)", sigma="round(sigma, 7)"))
rel("pairs_book", pairs.book(BARS, 60, 1.0, 120, 500.0).select("symbol", weight="round(weight, 8)"))
_SPREADS = pairs.hedged(BARS, 60)
for _kind, _targets in {"inventory": pairs.inventory_spread(_SPREADS, 20, 40.0), "binary": pairs.binary_spread(_SPREADS, 20)}.items():
    rel(f"spread_{_kind}", pairs.spread_book(_targets).group("left_key", "right_key", n="count(*)", total="sum(net)", held="avg(abs(target))").select("left_key", "right_key", "n", total="round(total, 7) + 0.0", held="round(held, 7)"))
rel("micro_price", ex.microprice(QUOTES).select("event_id", "lean", micro="round(micro, 10) + 0.0", tilt="round(tilt, 8) + 0.0"))
rel("micro_order_flow", ex.order_flow(QUOTES).select("event_id", ofi="round(ofi, 8)"))
rel("micro_quote_quality", ex.quote_quality(QUOTES).select("symbol", "quotes", "books", spread_p50="round(spread_p50, 6)", tilt_p75="round(tilt_p75, 6)"))
_MARKET_FILL = FILLS.with_(**{k: v for k, v in ex.fill_market("ref", "qty", "bar_volume", "buy").items()})
rel("fill_market", _MARKET_FILL.group("symbol", filled="sum(filled)", mean="avg(price)").select("symbol", filled="round(filled, 4)", mean="round(mean, 7)"))
rel("fill_limit", BARS.with_(want="round(close * 0.995, 6)", buy="volume > 200").with_(**ex.fill_limit("want", "open", "high", "low", "buy", "40.0", "volume", 0.1)).select("symbol", ts="CAST(ts AS STRING)", price="round(price, 10)", filled="round(filled, 6)"))
rel("fee_sells", FILLS.where("NOT buy").group("symbol", fee=f"sum({ex.sell_fee('qty', 'ref')})").select("symbol", fee="round(fee, 6)"))
for _kind in ("power", "log", "sqrt"):
    rel(f"queue_{_kind}", QUOTES.select("event_id", p=f"round({ex.queue_probability('bid_size', 'ask_size', _kind)}, 9)"))
rel("calibrate_fills", ex.calibrate(FILLS).select("symbol", "n", "fitted", half_spread="round(half_spread, 3) + 0.0", impact="round(impact, 3) + 0.0", intercept="round(intercept, 5)"))
rel("tca_fills", ex.tca(FILLS, BARS).select("symbol", arrival_bps="round(arrival_bps, 6)", worst_bps="round(worst_bps, 6)", best_bps="round(best_bps, 6)", transient_bps="round(transient_bps, 5)", permanent_bps="round(permanent_bps, 5)"))
rel("latency_summary", ex.latency(FILLS, ("symbol",), "slippage_bps").select("symbol", "n", mean="round(mean, 6)", p50="round(p50, 6) + 0.0", p95="round(p95, 6) + 0.0", p99="round(p99, 6) + 0.0", least="round(least, 6)", most="round(most, 6)"))
_ORDERS = Rel.table("orders").select("o_orderkey", "o_custkey", notional="o_totalprice", side="o_orderpriority", day="CAST(o_orderdate AS DATE)").join(Rel.table("customer").select(o_custkey="c_custkey", equity="c_acctbal"), "o_custkey")
_CHECKS = {"NO_PRICE": "notional IS NULL", "MAX_ORDER_NOTIONAL": "notional > 250000", "INSUFFICIENT_BUYING_POWER": "notional > 40.0 * greatest(equity, 0.0)", "CONCENTRATION": "notional > 25.0 * greatest(equity, 0.0)"}
rel("risk_codes", _ORDERS.with_(code=ex.risk_code(_CHECKS)).group("code", orders="count(*)", notional="sum(notional)").select("code", "orders", notional="round(notional, 2)"))
rel("risk_rate_limit", ex.rate_limited(_ORDERS.with_(epoch="CAST(o_orderkey AS BIGINT)"), "o_custkey", 2000, 3).select("o_orderkey", "recent", "limited"))
rel("borrow_rates", BARS.select("symbol", ts="CAST(ts AS STRING)", apr=f"round({ex.borrow_apr('volume / 100.0', 0.003, 0.002, 0.05)}, 9)"))
_ACCOUNTS = Rel.table("orders").with_(month="CAST(12 * year(o_orderdate) + month(o_orderdate) AS INT)").group("o_custkey", "month", day_trades="sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)")
rel("risk_day_trades", ex.day_trade_blocked(_ACCOUNTS, "o_custkey", "month").select("o_custkey", "month", "blocked", recent="CAST(recent AS BIGINT)"))
rel("calendar_sessions", Rel.table("events").select("event_id", session="CAST(@session(ts) AS STRING)", clock="@clock(ts)").with_(
    kind=cal.session()).with_(tradeable=cal.tradeable(), extended=cal.tradeable(extended=True), covered=cal.covered()))
rel("events_daily_counts", Rel.table("events").group("event_type", "user_id", n="count(*)").group("event_type", users="count(*)", most="max(n)"))


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = t.tables(spark, sf_dir)
    orders = tables["orders"].selectExpr("o_orderkey", "o_orderdate AS ts", "element_at(array('click', 'view', 'purchase', 'signup'), CAST(o_orderkey % 4 AS INT) + 1) AS symbol")
    quotes = QUOTES.df(tables).groupBy("symbol", "ts").agg({"bid": "max"}).withColumnRenamed("max(bid)", "bid").where("bid IS NOT NULL")
    return panel.asof(orders, quotes, ["symbol"], "ts", ["bid"]).selectExpr("o_orderkey", "symbol", "bid")


QUERIES["join_asof_quotes"] = _asof
ORACLES["join_asof_quotes"] = f"""
WITH q AS (SELECT symbol, ts, max(bid) AS bid FROM ({QUOTES.sql(t.SCHEMA_NAMES)}) GROUP BY symbol, ts HAVING max(bid) IS NOT NULL),
o AS (SELECT o_orderkey, o_orderdate AS ts, (['click', 'view', 'purchase', 'signup'])[CAST(o_orderkey % 4 AS INT) + 1] AS symbol FROM orders)
SELECT o.o_orderkey, o.symbol, q.bid FROM o ASOF LEFT JOIN q ON o.symbol = q.symbol AND o.ts >= q.ts"""

from marketloom.operators import overlays as ov  # noqa: E402

stats("overlay_tail_hedge", ov.tail_hedge(BENCH, 26, -0.1, 2.5))
rel("overlay_expiry_week", ov.expiry_week(Rel.table("orders").select(ts="CAST(o_orderdate AS DATE)").distinct()).select("expiry", ts="CAST(ts AS STRING)"))
stats("overlay_rotation", p.earn(ov.rotation(PANEL), charged=0, first=2))
stats("trend_book", p.earn(ov.trend_book(PANEL)))
stats("momentum_hardened", p.earn(ov.hardened_momentum(PANEL), charged=0, first=2))
rel("lead_lag_matrix", ov.lead_lag(PANEL).select("leader", "follower", "n", rho="round(rho, 8)"))
rel("lead_lag_leaders", ov.top_leaders(ov.lead_lag(PANEL)).select("leader", "follower", "place", rho="round(rho, 8)"))
rel("select_representative", ov.representative(BARS).select("symbol", price="round(price, 7)", dollars="round(dollars, 5)"))
rel("store_latest", ov.latest(Rel.table("orders"), "o_custkey", "o_orderdate, o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice"))
rel("ledger_settled", ov.settled_cash(Rel.table("orders").select("o_custkey", o_totalprice="CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END", session="CAST(date_trunc('month', o_orderdate) AS DATE)"), "o_custkey", "session", "o_totalprice").select("o_custkey", session="CAST(session AS STRING)", cash="round(cash, 3)", settled="round(settled, 3) + 0.0"))
rel("events_daily_sum", Rel.table("events").with_(day="CAST(ts AS DATE)").group("event_type", "day", total="sum(value)", n="count(*)").select("event_type", "n", day="CAST(day AS STRING)", total="round(total, 4)"))

from marketloom.plans import written  # noqa: E402

_BARS_SQL = written.bars()
ORACLES["bars_weekly"] = f"SELECT symbol, CAST(ts AS VARCHAR) AS ts, {', '.join(f'round({c}, 8) + 0e0 AS {c}' for c in ('open', 'high', 'low', 'close', 'volume'))} FROM ({_BARS_SQL})"
ORACLES["factor_momentum_daily"] = written.factor_momentum(_BARS_SQL, 12, K, 4, 2.0)
for _name, _reverse in {"momentum": False, "reversal": True}.items():
    ORACLES[f"cross_sectional_{_name}_daily"] = written.cross_sectional(_BARS_SQL, 12, K, 4, 2.0, _reverse)
ORACLES["fill_limit"] = written.limit_fills(_BARS_SQL)
ORACLES["ledger_settled"] = written.settled("SELECT o_custkey AS who, CAST(date_trunc('month', o_orderdate) AS DATE) AS session, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders")
_REPORTS_SQL = _REPORTS.sql(t.SCHEMA_NAMES)
for _name, _reverse in {"tilt": True, "chase": False}.items():
    ORACLES[f"short_interest_{_name}_daily"] = written.short_interest_tilt(_BARS_SQL, _REPORTS_SQL, K, 2, 2.0, _BORROW, YEAR, _reverse)
ORACLES["combine_report"] = written.combo_report(_STREAMS.sql(t.SCHEMA_NAMES), YEAR)
ORACLES["join_nearest_statement"] = written.nearest(FACTS.sql(t.SCHEMA_NAMES), 120)
ORACLES["event_recent_buyers"] = written.recent_buyers(30)

from marketloom.plans import studies  # noqa: E402

QUERIES.update(studies.QUERIES)
ORACLES.update(studies.ORACLES)
