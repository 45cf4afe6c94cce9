"""Queries of the studies that are no Rel, and SQL for them written by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import folds, impact, lead_lag, learning, ledger, overlays, pair_walks, panel, pairs, placebo, portfolio, quoted, residual, significance
from marketloom.operators import execution as ex
from marketloom.plans import written
from marketloom.plans.rel import Rel
from marketloom.sources import insider, statements
from marketloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

YEAR = 52.0
TRAIN, TEST = 104, 26
BARS, FACTS, QUOTES = Rel.shared("bars", t.bars()), Rel.shared("facts", t.fundamentals()), t.quotes()
PANEL = panel.dense(BARS)


def query(name: str, sql: str | None = None):
    """Registers a function of the driver's tables, and its SQL."""

    def register(f: Callable[[dict], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(t.tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, without a negative zero, and times as text."""
    kind = {f.name: f.dataType.typeName() for f in df.schema.fields}
    show = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("string"), "timestamp": lambda c: F.col(c).cast("string")}
    return df.select(*[show.get(kind[c], F.col)(c).alias(c) for c in df.columns])


# ---- residuals and pairs ----

def _scores(tables: dict) -> DataFrame:
    return residual.scores(panel.common(BARS, 10).df(tables).select("symbol", "ts", "ret"), 60, 3, 30.0)


query("pca_scores")(lambda tables: rounded(_scores(tables).select("symbol", "ts", "score"), 6))
query("pca_statarb_daily")(lambda tables: rounded(residual.book(residual.banded(_scores(tables)))))

_WALK = {"train": TRAIN, "test": TEST, "top": 10, "shortest": 1.0, "longest": 60.0}


def _listed(tables: dict) -> DataFrame:
    """Bars of which S05's end and S11's begin within the sample."""
    return BARS.df(tables).where("NOT (symbol = 'S05' AND ts > DATE '1999-06-30') AND NOT (symbol = 'S11' AND ts < DATE '1997-06-01')")


query("pairs_walk_forward")(lambda tables: rounded(pair_walks.walk(BARS.df(tables), common=True, enter=1.5, **_WALK), 9))
query("pairs_delisting_walk")(lambda tables: rounded(pair_walks.walk(_listed(tables), enter=1.5, **_WALK), 9))
query("pairs_delisting_daily")(lambda tables: rounded(pair_walks.basket(pair_walks.walk(_listed(tables), enter=1.5, **_WALK)), 9))
query("pairs_regime_walk")(lambda tables: rounded(pair_walks.walk(_listed(tables), enter=1.5, monitor=30, **_WALK), 9))


@query("pairs_window_screen", written.window_screen(TRAIN, TEST, 10, 1.0, 60.0))
def _screen(tables: dict) -> DataFrame:
    bars = _listed(tables).select("symbol", "ts", "close")
    days = pair_walks.calendar(bars, TRAIN, TEST)
    return pair_walks.screened(bars, days, pair_walks.members(bars, days, TRAIN), TRAIN, 10, 1.0, 60.0).select("window", "left_key", "right_key", "hedge", "half_life")


@query("pairs_unit_root", written.unit_root(pairs.reversion(BARS, 60).sql(t.SCHEMA_NAMES), pairs.ADF_KNOTS, pairs.ADF_LEAST, pairs.ADF_MOST))
def _unit_root(tables: dict) -> DataFrame:
    got = pairs.reversion(BARS, 60).df(tables)
    return got.select("left_key", "right_key", F.round(pair_walks.adf_probability(F.col("adf")), 7).alias("p"))


# ---- impact and learning ----

def _records(tables: dict) -> DataFrame:
    """Fills with the volatility of their symbol's last 20 returns."""
    vol = BARS.with_(r="close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1.0").with_(
        n="count(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", v="stddev_pop(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
    vol = vol.select("symbol", "ts", realized_vol="CASE WHEN n = 20 THEN round(v, 12) END")
    return ex.fills(BARS).join(vol, "symbol, ts").df(tables).select("symbol", "participation", "slippage_bps", "realized_vol")


query("impact_power_law")(lambda tables: rounded(impact.power_law(_records(tables), ["symbol"]), 3))
query("impact_regimes", written.regime_slopes())(lambda tables: rounded(impact.regime_slopes(_records(tables), ["symbol"]), 5))
_TRADES = {"train": TRAIN, "test": TEST, "top": 10, "most_adf": None, "enter": 1.2, "shortest": 1.0, "longest": 60.0}
query("meta_trades")(lambda tables: rounded(learning.collect_trades(BARS.df(tables), **_TRADES), 7))


@query("meta_ranking")
def _meta(tables: dict) -> DataFrame:
    """A model of the trades of the first windows ranks those, and the later ones."""
    trades = learning.written(learning.collect_trades(BARS.df(tables), **_TRADES))
    cut = trades.agg(F.expr("max(`window`)")).first()[0]
    early = F.col("window") <= (cut or 0) // 2
    model = learning.fit_logit(trades.where(early), steps=30)
    scored = trades.select(F.when(early, "train").otherwise("test").alias("part"), F.round(model.probability(), 9).alias("score"), "label")
    return rounded(learning.auc(scored, "score", "label", "part"), 6)


# ---- lead-lag and placebos ----

query("lead_lag_walk_daily", written.lead_lag_walk(TRAIN, TEST, 5, 3, 2.0))(lambda tables: rounded(lead_lag.walk(BARS.df(tables).select("symbol", "ts", "close"), TRAIN, TEST)))
query("lead_lag_shuffled_daily")(lambda tables: rounded(lead_lag.walk(BARS.df(tables).select("symbol", "ts", "close"), TRAIN, TEST, shuffled=11)))


def _days(tables: dict) -> DataFrame:
    """A daily return made of the mean size of orders."""
    return tables["orders"].groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.round((F.avg("o_totalprice") - 150000.0) / 1e7, 10).alias("ret"))


query("placebo_expiry_week")(lambda tables: rounded(placebo.expiry_week(_days(tables)), 6))
_HEDGE = overlays.tail_hedge(panel.market(PANEL), 26, -0.1, 2.5).select("ts", "held", "net", ret="bench")
query("placebo_tail_hedge")(lambda tables: rounded(placebo.matched_exposure(_HEDGE.df(tables), YEAR), 6))
query("placebo_rotation")(lambda tables: rounded(placebo.equal_weights(PANEL.df(tables).select("symbol", "ts", "ret"), portfolio.earn(overlays.rotation(PANEL), charged=0, first=2).df(tables), YEAR), 6))

# ---- significance and holding ----

_STREAMS = PANEL.where("ret IS NOT NULL").select("symbol", "ts", r="ret")
query("significance_streams")(lambda tables: rounded(significance.significance(_STREAMS.df(tables), per_year=YEAR), 7))
query("buy_and_hold", written.buy_and_hold(YEAR))(lambda tables: rounded(significance.buy_and_hold(BARS.df(tables), YEAR), 7))

# ---- quoted signals ----

def _flow(tables: dict) -> DataFrame:
    return quoted.flow(QUOTES.df(tables).withColumn("session", F.to_date("ts")), 10, tie="event_id")


query("quoted_flow", written.quoted_flow(10))(lambda tables: rounded(_flow(tables).select("event_id", "ofi")))
query("quoted_flow_levels", written.flow_levels(10))(lambda tables: rounded(quoted.flow_levels(_flow(tables), 10), 6))
query("quoted_flow_positions")(lambda tables: quoted.positioned(rounded(_flow(tables).select("event_id", "symbol", "ofi"), 10).withColumn("ts", F.col("event_id")), "ofi", 0.1, 0.03, True).select("event_id", "position"))


@query("quoted_tilt_positions")
def _tilted(tables: dict) -> DataFrame:
    tilt = F.round(quoted.tilt(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size")), 10)
    rows = QUOTES.df(tables).select("event_id", "symbol", F.col("event_id").alias("ts"), tilt.alias("tilt"))
    return quoted.positioned(rows, "tilt", 0.5, 0.5, True, strict=True).select("event_id", "position")


@query("strategy_signals")
def _signals(tables: dict) -> DataFrame:
    bars = BARS.df(tables).selectExpr("*", "date_format(ts, 'yyyy-MM') AS session")
    got = folds.signals(bars, folds.available())
    count = lambda side: F.sum(F.when(F.col("signal") == side, 1).otherwise(0)).alias(f"{side}s")
    return got.groupBy("symbol", "strategy").agg(count("buy"), count("sell"))


@query("quoted_gate")
def _gated(tables: dict) -> DataFrame:
    """Each symbol's quotes as bars of one price, their entries confirmed by the tilt."""
    q = QUOTES.df(tables).where("bid IS NOT NULL")
    price = [F.col("bid").alias(c) for c in ("open", "high", "low", "close")]
    bars = q.select("symbol", F.col("event_id").alias("ts"), *price, F.lit(1.0).alias("volume"), "bid", "ask", "bid_size", "ask_size")
    got = quoted.gated(bars, "ema_cross", 0.25)
    return got.groupBy("symbol").agg(F.count("signal").alias("signals"), F.sum(F.col("blocked").cast("int")).alias("blocked"))


# ---- sources ----

def documents(tables: dict) -> DataFrame:
    """Fact documents of the symbols' years: restated a year later, with quarters between, and revenue under either tag."""
    y = FACTS.df(tables).select("*", F.concat("fy", F.lit("-01-01")).alias("start"), F.concat("fy", F.lit("-12-31")).alias("end"))
    filed, again = F.concat(F.col("fy") + 1, F.lit("-03-01")), F.concat(F.col("fy") + 2, F.lit("-03-01"))

    def fact(value, start="start", end="end", when=filed, fp="FY", form="10-K"):
        return F.struct(F.col(start).alias("start") if start else F.lit(None).cast("string").alias("start"), (F.col(end) if isinstance(end, str) else end).alias("end"), value.alias("val"), F.lit(fp).alias("fp"), F.lit(form).alias("form"), when.alias("filed"))

    def told(value, flow: bool = True, there=None):
        first = "start" if flow else None
        facts = F.array(fact(value * 1.1, first, when=again, form="10-K/A"), fact(value, first), fact(value * 0.2, first, fp="Q3", form="10-Q"), fact(value * 0.5, None, when=filed))
        return F.collect_list(facts if there is None else F.when(there, facts))

    even = F.substring("symbol", 2, 2).cast("int") % 2 == 0
    tags = {
        "NetIncomeLoss": told(F.col("net_income")), "NetCashProvidedByUsedInOperatingActivities": told(F.col("cfo")), "Assets": told(F.col("total_assets"), False), "StockholdersEquity": told(F.col("book_equity"), False),
        "PaymentsToAcquirePropertyPlantAndEquipment": told(F.round(F.col("cfo") * 0.1, 4), there=F.col("fy") % 2 == 0), "Revenues": told(F.col("revenue"), there=even), "RevenueFromContractWithCustomerExcludingAssessedTax": told(F.col("revenue"), there=~even),
        "CostOfRevenue": told(F.col("cogs"))}
    cover = F.collect_list(fact(F.col("shares"), None, F.concat(F.col("fy") + 1, F.lit("-02-10")), filed))
    g = y.groupBy("symbol").agg(*[F.flatten(v).alias(k) for k, v in tags.items()], cover.alias("cover"))
    unit = lambda name, of: F.struct(F.create_map(F.lit(name), of).alias("units"))
    gaap = F.create_map(*[x for k in tags for x in (F.lit(k), unit("USD", F.col(k)))])
    dei = F.create_map(F.lit("EntityCommonStockSharesOutstanding"), unit("shares", F.col("cover")))
    return g.select("symbol", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), gaap, F.lit("dei"), dei).alias("facts"))).alias("doc"))


# assets and equity are instants: the half-sized fact without a span is filed with the first and stands behind it
query("statements_annual", written.statements(t.fundamentals().sql(t.SCHEMA_NAMES)))(lambda tables: rounded(statements.annual_statements(documents(tables)), 3))


def filings(tables: dict) -> DataFrame:
    """Archive rows made of orders and their lines: an order is a filing."""
    o = tables["orders"].withColumn("day", F.to_date("o_orderdate"))
    when = lambda d: F.when(F.col("o_orderkey") % 3 == 0, F.upper(F.date_format(d, "dd-MMM-yyyy"))).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    archive, accession = F.concat(F.year("day"), F.lit("q"), F.quarter("day")), F.col("o_orderkey").cast("string")
    nothing = F.lit(None).cast("string")

    def rows(df, kind, place, **given):
        return df.select(archive.alias("archive"), place.cast("long").alias("place"), F.lit(kind).alias("kind"), accession.alias("accession"), *[given.get(f, nothing).alias(f) for f in insider._FIELDS])

    ticker = F.when(F.col("o_custkey") % 17 == 0, F.lit("none")).otherwise(F.concat(F.lit(" s"), F.lpad((F.col("o_custkey") % 16).cast("string"), 2, "0")))
    lines = tables["lineitem"].join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    place = (F.col("o_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01"))
    bought = rows(lines, insider.TRANSACTION, place, code=F.when(F.col("l_returnflag") == "N", "P").otherwise("S"), side=F.lit("A"), shares=F.col("l_quantity").cast("string"), price=(F.col("l_partkey") % 100).cast("string"), traded=when(F.to_date("l_shipdate")))
    owners = rows(o, insider.OWNER, F.col("o_orderkey"), role=F.col("o_orderpriority")).unionByName(rows(o, insider.OWNER, F.col("o_orderkey"), role=F.col("o_orderstatus")))
    return rows(o, insider.SUBMISSION, F.col("o_orderkey"), ticker=ticker, filed=when(F.col("day"))).unionByName(owners).unionByName(bought)


query("insider_buys", written.insider_buys())(lambda tables: insider.buys(filings(tables)).select("ticker", F.col("filing_date").cast("string").alias("filing_date"), F.col("trans_date").cast("string").alias("trans_date"), "buy_value", "n_owners", F.concat_ws("|", "roles").alias("roles")))


def _chain(tables: dict) -> DataFrame:
    order = F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key")))
    event = F.when(F.col("o_orderstatus") == "F", "FILL").when(F.col("o_orderstatus") == "O", "SUBMIT").otherwise("PARTIAL_FILL")
    events = tables["orders"].select(F.col("o_custkey").cast("string").alias("log"), F.col("o_orderkey").cast("double").alias("ts"), event.alias("event"), order.alias("order"))
    cut = F.col("ts") % 2 == 0  # in two parts: the second goes on from the first's tails
    first = ledger.append(events.where(cut))
    return first.unionByName(ledger.append(events.where(~cut), first))


query("ledger_chain", written.ledger_chain())(lambda tables: _chain(tables).select("log", "seq", "event", "hash"))
query("ledger_check", written.ledger_check())(lambda tables: ledger.verify(_chain(tables)))
