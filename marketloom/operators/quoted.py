"""Signals on quoted bars: order-flow imbalance, micro-price tilt, and a gate on any strategy's entries.

Imbalances are windows of one symbol's session, so a task holds a session, not a symbol's
history.  Positions are ordered folds over one number a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import folds


def flow(quotes: DataFrame, window: int = 20, session: str = "session", tie: str | None = None) -> DataFrame:
    """quotes(symbol, session, ts, bid, ask, bid_size, ask_size) with `ofi`: the flow of the last `window` quotes of a session over their size.

    Null until a session has that many increments, the first quote of a session giving
    none.  Rows with an incomplete quote have no imbalance and are not quotes of the window.
    """
    sides = ["bid", "ask", "bid_size", "ask_size"]
    whole = quotes.dropna(subset=sides)
    line = Window.partitionBy("symbol", session).orderBy("ts", *([tie] if tie else []))
    q = whole.select("*", *[F.lag(c).over(line).alias(f"p_{c}") for c in sides])
    bid = F.when(F.col("bid") > F.col("p_bid"), F.col("bid_size")).when(F.col("bid") == F.col("p_bid"), F.col("bid_size") - F.col("p_bid_size")).otherwise(-F.col("p_bid_size"))
    ask = F.when(F.col("ask") > F.col("p_ask"), -F.col("p_ask_size")).when(F.col("ask") == F.col("p_ask"), F.col("ask_size") - F.col("p_ask_size")).otherwise(F.col("ask_size"))
    q = q.withColumn("e", F.when(F.col("p_bid").isNotNull(), bid - ask)).withColumn("size", F.when(F.col("p_bid").isNotNull(), F.col("bid_size") + F.col("ask_size")))
    frame = line.rowsBetween(1 - window, 0)
    total = F.sum("size").over(frame)
    ofi = F.when(F.count("e").over(frame) == window, F.sum("e").over(frame) / F.when(total == 0, 1.0).otherwise(total))
    none = quotes.where(" OR ".join(f"{c} IS NULL" for c in sides)).withColumn("ofi", F.lit(None).cast("double"))
    return q.withColumn("ofi", ofi).select(*quotes.columns, "ofi").unionByName(none)


def flow_levels(flows: DataFrame, window: int = 20, session: str = "session") -> DataFrame:
    """(symbol, days, n, p50, p75, p90, p95): percentiles of the imbalance's size, of sessions with more than `window` quotes."""
    sides = " AND ".join(f"{c} IS NOT NULL" for c in ("bid", "ask", "bid_size", "ask_size"))
    full = flows.where(sides).withColumn("quotes", F.count("*").over(Window.partitionBy("symbol", session))).where(F.col("quotes") > window)
    size = F.abs("ofi")
    return full.groupBy("symbol").agg(F.countDistinct(session).alias("days"), F.count("ofi").alias("n"), *[F.percentile(size, F.lit(p / 100)).alias(f"p{p}") for p in (50, 75, 90, 95)])


def tilt(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    """(micro-price - mid) / half-spread; null for locked, crossed or empty quotes."""
    half, total = (ask - bid) / 2, bid_size + ask_size
    return F.when((total > 0) & (half > 0), ((ask * bid_size + bid * ask_size) / total - (bid + ask) / 2) / half)


def positioned(rows: DataFrame, value: str, enter: float, leave: float, short: bool = False, strict: bool = False, tie: str | None = None) -> DataFrame:
    """rows(symbol, ts, value) with `position`: long above `enter` until the value is below `leave`, short the other way round if allowed.

    With `strict` a position is also left at `leave` itself.  Rows without a value keep the
    position, also from one session to the next.  One ordered fold a symbol.
    """
    line = ["ts", *([tie] if tie else [])]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(line, kind="stable")
        held, out = 0, []
        for v in part[value].to_numpy(float):
            if v == v:
                if held == 0:
                    held = 1 if v > enter else -1 if short and v < -enter else 0
                elif held * v < leave or (strict and held * v == leave):
                    held = 0
            out.append(held)
        return part.assign(position=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("symbol").applyInPandas(fold, f"{fields}, position int")


def gated(bars: DataFrame, strategy: str, dead_band: float = 0.5, require_quote: bool = True) -> DataFrame:
    """(symbol, ts, signal, blocked): a strategy's signals on quoted bars, entries only where the tilt confirms them.

    A blocked entry leaves the strategy flat, so it is asked again at the next bar; exits
    always pass.  Without a usable quote an entry is blocked, or with require_quote=False
    passes.  One ordered fold a symbol, which holds a batch of bars and the strategy's state;
    bars of one ts go by their other columns.
    """
    fields = [c for c in ("open", "high", "low", "close", "volume", "session") if c in bars.columns]
    seen = bars.select("symbol", "ts", *fields, tilt(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size")).alias("tilt"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state, act = (), None, None  # no symbol yet, which a symbol that is null is not
        for frame in frames:
            signals, stops = [], []
            for key, lean, *values in zip(*[frame[c].tolist() for c in ("symbol", "tilt", *fields)]):
                if key != symbol:
                    symbol, state, act = key, folds.State(), folds.make(strategy)
                state.push(dict(zip(fields, values)))
                said = act(state)
                blocked = said == "buy" and not (lean > dead_band if lean == lean else not require_quote)
                if not blocked:
                    state.position = 1 if said == "buy" else 0 if said == "sell" else state.position
                signals.append(None if blocked else said)
                stops.append(blocked)
            yield frame[["symbol", "ts"]].assign(signal=signals, blocked=stops)

    kind = bars.schema["ts"].dataType.simpleString()
    placed = seen.repartition("symbol").sortWithinPartitions("symbol", *[F.col(c).asc_nulls_last() for c in ("ts", *fields, "tilt")])
    return placed.mapInPandas(fold, f"symbol string, ts {kind}, signal string, blocked boolean")
