"""Table schemas, readers, and the domain tables that the driver tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketloom.plans.rel import Rel

#: Schemas of files, as DDL; readers never infer.
SCHEMAS = {
    "bars": "symbol string, ts timestamp, open double, high double, low double, close double, volume double, adjustment string",
    "quotes": "symbol string, ts timestamp, bid double, ask double, bid_size double, ask_size double",
    "dividends": "symbol string, ex_ts timestamp, amount double",
    "earnings": "symbol string, ts timestamp, surprise_pct double, eps double, consensus double",
    "fundamentals": "symbol string, fy_end date, filed date, net_income double, cfo double, total_assets double, capex double, fcf double, book_equity double, shares double, revenue double, cogs double",
    "short_interest": "symbol string, settlement date, days_to_cover double",
    "sector": "symbol string, sector string",
    "insider_buys": "ticker string, filing_date date, trans_date date, buy_value double, n_owners int, roles array<string>",
    "funding": "ts timestamp, rate double",
    "news": "created_at timestamp, headline string, symbols array<string>",
    "articles": "source string, kind string, title string, url string, published timestamp, authors array<string>, tickers array<string>, sentiment double, relevance double, extra map<string,string>",
    "fills": "symbol string, side string, qty double, intended_price double, fill_price double, bar_volume double, submit_ms double, ack_ms double, fill_ms double, total_ms double, ts timestamp, realized_vol double, bid double, ask double, bid_size double, ask_size double, quote_ts timestamp",
    "orders": "client_order_id string, symbol string, side string, qty double, order_type string, limit_price double, stop_price double, tif string, status string, created_ts double, submit_ts double, ack_ts double, fill_ts double, fills array<struct<ts:double,price:double,qty:double,fee:double>>, metadata map<string,string>",
    "order_events": "seq long, ts double, event string, order string, prev_hash string, hash string",
}
# fixed values: seconds of the named bars, and the adjustments of prices
TIMEFRAMES = {"1min": 60, "5min": 300, "15min": 900, "1hour": 3600, "1day": 86400}
ADJUSTMENTS = ("raw", "split", "dividend", "all")


def read(spark: SparkSession, kind: str, path: str, fmt: str = "json") -> DataFrame:
    """Files of one kind with their schema: rows that do not parse are null, zero quote sides too."""
    df = spark.read.schema(SCHEMAS[kind]).format(fmt).load(path)
    if kind == "quotes":
        df = df.selectExpr("symbol", "ts", *[f"nullif({c}, 0.0D) AS {c}" for c in ("bid", "ask", "bid_size", "ask_size")])
    return df


def timeframe(name: str) -> int:
    """Seconds of a bar."""
    aliases = {"1m": "1min", "5m": "5min", "15m": "15min", "1h": "1hour", "60min": "1hour", "1d": "1day", "day": "1day", "hour": "1hour", "minute": "1min"}
    key = name.strip().lower()
    if aliases.get(key, key) not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {name!r}")
    return TIMEFRAMES[aliases.get(key, key)]


def adjustment(name: str) -> str:
    """A known adjustment."""
    if name not in ADJUSTMENTS:
        raise ValueError(f"unknown adjustment {name!r}")
    return name


def append(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Append-only sink."""
    df.write.mode("append").format(fmt).save(path)


def append_new(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet") -> DataFrame:
    """Append only rows whose keys the store does not hold; returns those rows."""
    spark = df.sparkSession
    try:
        held = spark.read.format(fmt).schema(df.schema).load(path).select(*keys)
        fresh = df.dropDuplicates(keys).join(held, keys, "left_anti")
        fresh.write.mode("append").format(fmt).save(path)
    except Exception as error:  # a first write has no folder to read
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = df.dropDuplicates(keys)
        fresh.write.mode("append").format(fmt).save(path)
    return fresh


# ---- the domain tables over the driver's tables -----------------------------

SCHEMA_NAMES = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver's tables that plans read."""
    return _Tables(spark, sf_dir)


class _Tables(dict):
    """Tables that are opened when a plan first reads them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in SCHEMA_NAMES:
            raise KeyError(name)
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


def bars() -> Rel:
    """Weekly bars of 16 symbols from lineitem."""
    cells = Rel.table("lineitem").select(
        symbol="concat('S', lpad(CAST(l_partkey % 16 AS STRING), 2, '0'))", ts="CAST(date_trunc('week', l_shipdate) AS DATE)", d="l_discount", tax="l_tax", q="l_quantity",
    ).group("symbol", "ts", step="round(avg(d), 9) - 0.05", tax="max(tax)", volume="sum(q)")
    closes = cells.with_(close=f"round(100.0 * exp(sum(step) OVER (PARTITION BY symbol ORDER BY ts)), 6)")
    opened = closes.with_(open="coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 100.0)")
    return opened.select("symbol", "ts", "open", "close", "volume", high="round(greatest(open, close) * (1.0 + tax / 10.0), 6)", low="round(least(open, close) * (1.0 - tax / 10.0), 6)")


def quotes() -> Rel:
    """Quotes from events: an event type is a symbol."""
    k = "CAST(user_id % 7 AS DOUBLE)"
    return Rel.table("events").select(
        "event_id", "ts", symbol="event_type", bid="CASE WHEN value > 0 THEN value END", ask=f"CASE WHEN value > 0 THEN round(value * (1.0 + 0.0005 * (1.0 + {k})), 6) END",
        bid_size="CAST(1 + event_id % 9 AS DOUBLE)", ask_size="CAST(1 + event_id % 7 AS DOUBLE)")


def fundamentals() -> Rel:
    """Yearly statements of the symbols from orders and lineitem; filed 60 days after the year."""
    rows = Rel.table("lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity", symbol="concat('S', lpad(CAST(l_partkey % 16 AS STRING), 2, '0'))").join(
        Rel.table("orders").select(l_orderkey="o_orderkey", fy="CAST(year(o_orderdate) AS INT)"), "l_orderkey")
    year = rows.group("symbol", "fy", revenue="round(sum(l_extendedprice), 6)", cogs="round(sum(l_extendedprice * (1.0 - l_discount)) * 0.6, 6)", tax="round(sum(l_extendedprice * l_tax), 6)", shares="sum(l_quantity)", lines="count(*)")
    return year.select("symbol", "fy", "revenue", "cogs", "shares", fy_end="make_date(fy, 12, 31)", filed="make_date(fy + 1, 3, 1)",
                       net_income="round(revenue - cogs - tax, 6)", cfo="round((revenue - cogs) * 0.9 - tax, 6)", total_assets="round(revenue * 1.5 + CAST(lines AS DOUBLE) * 100.0, 6)", book_equity="round(revenue * 0.7, 6)", fcf="round((revenue - cogs) * 0.8 - tax, 6)")
