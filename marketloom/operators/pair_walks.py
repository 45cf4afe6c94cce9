"""Pairs out of sample: point-in-time universes, screens of each training window, and the chosen pairs' spreads traded after it.

Windows are numbers that calendar rows belong to, so screening is one aggregate over
(window, pair) and needs no loop.  Only the chosen pairs (`top` a window) are traded: an
ordered fold each, over as many rows as a window has.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.pairs import ADF_KNOTS, ADF_LEAST, ADF_MOST, kalman
from marketloom.sources.scratch import written

ACTIVE, WARNING, HALTED = 0, 1, 2


def calendar(bars: DataFrame, train: int, test: int, common: bool = False) -> DataFrame:
    """(window, ts, training): the rows of each window, which starts `test` rows after the one before; none for a calendar under train + 2 test rows.

    The calendar has all times, or with `common` those of every symbol.
    """
    days = bars.groupBy("ts").agg(F.countDistinct("symbol").alias("here"))
    if common:
        names = bars.agg(F.countDistinct("symbol").alias("symbols"))
        days = days.join(F.broadcast(names), F.col("here") == F.col("symbols"))
    days = days.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    # window w has rows w test ... w test + train + test - 1, all of them there
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (train + test - 1)) / test)).cast("int")
    final = F.least(F.floor(F.col("i") / test), F.floor((F.col("n") - train - test) / test)).cast("int")
    days = days.where((F.col("n") >= train + 2 * test) & (first <= final)).select("ts", "i", F.explode(F.sequence(first, final)).alias("window"))
    return days.select("window", "ts", (F.col("i") < F.col("window") * test + train).alias("training"))


def members(bars: DataFrame, days: DataFrame, train: int, share: float = 0.8, fewest: int = 4) -> DataFrame:
    """(window, symbol): symbols with bars on that share of a window's training rows; windows with too few of them go."""
    here = bars.join(days.where("training"), "ts").groupBy("window", "symbol").agg(F.count("*").alias("bars")).where(F.col("bars") >= share * train)
    return here.withColumn("names", F.count("*").over(Window.partitionBy("window"))).where(F.col("names") >= fewest).select("window", "symbol")


def screened(bars: DataFrame, days: DataFrame, names: DataFrame, train: int, top: int, shortest: float = 3.0, longest: float = 30.0, most_adf: float | None = None) -> DataFrame:
    """(window, left_key, right_key, hedge, half_life, adf): the `top` pairs of each window's training rows.

    A pair's spread reverts with a half-life within the band and, if asked, a unit-root
    statistic below `most_adf`; ranked by that statistic to 3 digits, else by half-life to
    1 digit, then by name.
    """
    rows = bars.join(days.where("training"), "ts").join(names, ["window", "symbol"]).select("window", "ts", "symbol", F.log("close").alias("x"))
    a = rows.select("window", "ts", F.col("symbol").alias("left_key"), F.col("x").alias("la"))
    b = rows.select("window", "ts", F.col("symbol").alias("right_key"), F.col("x").alias("lb"))
    pair = ["window", "left_key", "right_key"]
    both = a.join(b, ["window", "ts"]).where("left_key < right_key")
    slopes = both.groupBy(*pair).agg(F.count("*").alias("n"), F.covar_pop("la", "lb").alias("cov"), F.var_pop("lb").alias("var")).where(F.col("n") >= int(train * 0.8))
    slopes = slopes.select(*pair, "n", F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(1.0).alias("slope"))
    s = both.join(slopes, pair).withColumn("spread", F.col("la") - F.col("slope") * F.col("lb"))
    s = s.withColumn("before", F.lag("spread").over(Window.partitionBy(*pair).orderBy("ts"))).where("before IS NOT NULL").withColumn("d", F.col("spread") - F.col("before"))
    g = s.groupBy(*pair).agg(F.first("slope").alias("slope"), F.count("*").alias("m"), F.covar_pop("d", "before").alias("cov"), F.var_pop("before").alias("var"), F.var_pop("d").alias("vd")).where("var > 0")
    g = g.withColumn("pull", F.col("cov") / F.col("var")).where("pull < 0").withColumn("half_life", F.lit(-math.log(2)) / F.col("pull"))
    g = g.withColumn("adf", adf_statistic(F.col("pull"), F.col("cov"), F.col("var"), F.col("vd"), F.col("m"))).where(F.col("half_life").between(shortest, longest))
    if most_adf is not None:
        g = g.where(F.col("adf") < most_adf)
    g = g.select(*pair, F.round("slope", 3).alias("hedge"), F.round("half_life", 1).alias("half_life"), F.round("adf", 3).alias("adf"))
    rank = Window.partitionBy("window").orderBy("adf" if most_adf is not None else "half_life", "left_key", "right_key")
    return g.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top).drop("place")


def adf_statistic(pull: Column, cov: Column, var: Column, vd: Column, m: Column) -> Column:
    """t of the slope of a step on the value before it, from population moments of m steps; 0 with fewer than 11 or without error."""
    rss = (vd - pull * cov) * m
    return F.when((m >= 11) & (rss > 0), pull / F.sqrt(rss / (m - 2) / (var * m))).otherwise(0.0)


def adf_probability(t: Column) -> Column:
    """The probability of a unit-root statistic: linear between the knots."""
    out = F.when(t <= ADF_KNOTS[0][0], ADF_LEAST)
    for (x0, p0), (x1, p1) in zip(ADF_KNOTS, ADF_KNOTS[1:]):
        out = out.when(t <= x1, p0 + (p1 - p0) * (t - x0) / (x1 - x0)) if x1 < ADF_KNOTS[-1][0] else out.when(t < x1, p0 + (p1 - p0) * (t - x0) / (x1 - x0))
    return out.otherwise(ADF_MOST)


def regime_labels(spreads: DataFrame, keys: list[str], window: int = 60, warn: float = 0.10, halt: float = 0.20) -> DataFrame:
    """(*keys, ts, regime): the health of spreads(*keys, ts, spread) by the unit-root probability of the last rows; active until there are enough."""
    size = max(20, window)
    line = Window.partitionBy(*keys).orderBy("ts")
    frame = line.rowsBetween(2 - size, 0)  # size - 1 steps
    s = spreads.withColumn("before", F.lag("spread").over(line)).withColumn("d", F.col("spread") - F.col("before")).withColumn("i", F.row_number().over(line))
    s = s.withColumn("cov", F.covar_pop("d", "before").over(frame)).withColumn("var", F.var_pop("before").over(frame)).withColumn("vd", F.var_pop("d").over(frame)).withColumn("m", F.count("d").over(frame))
    pull = F.col("cov") / F.nullif("var", F.lit(0.0))
    p = adf_probability(F.when(F.col("var") > 0, adf_statistic(pull, F.col("cov"), F.col("var"), F.col("vd"), F.col("m"))).otherwise(0.0))
    label = F.when(F.col("i") < size, ACTIVE).when(p >= halt, HALTED).when(p >= warn, WARNING).otherwise(ACTIVE)
    return s.select(*keys, "ts", label.alias("regime"))


def spread_equity(ca: np.ndarray, cb: np.ndarray, hedge: float, lookback: int, enter: float = 2.0, leave: float = 0.5, cost_bps: float = 2.0, leg: float = 0.5,
                  sized: bool = False, regime: np.ndarray | None = None, adaptive: bool = False, cash: float = 100_000.0) -> np.ndarray:
    """The account after each row of a spread's trading; empty with fewer than lookback + 5 rows.

    The z of the spread against its last rows, or with `adaptive` of the filter's innovation,
    opens equal legs at that row's closes and closes them within `leave`.  `sized` scales legs
    by |z| / enter, at most 1.  Regimes: no opening but when active, closed when halted.
    """
    n, cost = len(ca), cost_bps / 1e4
    if n < lookback + 5:
        return np.zeros(0)
    la, lb = np.log(ca), np.log(cb)
    z = np.full(n, np.nan)
    if adaptive:
        error, deviation = kalman(la, lb, with_deviation=True)
        fine = (np.arange(n) >= lookback) & (deviation > 0)
        z[fine] = error[fine] / deviation[fine]
    else:
        spread = la - hedge * lb
        view = np.lib.stride_tricks.sliding_window_view(spread, lookback)
        sd = view.std(axis=1)
        z[lookback - 1 :] = np.where(sd > 0, (spread[lookback - 1 :] - view.mean(axis=1)) / np.where(sd > 0, sd, 1), 0)
    out, held, qa, qb = np.zeros(n), 0, 0.0, 0.0
    for i in range(n):
        state = ACTIVE if regime is None else regime[i]
        asked = held
        if state == HALTED:
            asked = 0
        elif not np.isnan(z[i]):
            if held == 0:
                if state == ACTIVE:
                    asked = -1 if z[i] > enter else 1 if z[i] < -enter else 0
            elif (held == 1 and z[i] >= -leave) or (held == -1 and z[i] <= leave):
                asked = 0
        if asked != held:
            cash += qa * ca[i] + qb * cb[i] - cost * (abs(qa) * ca[i] + abs(qb) * cb[i])
            qa = qb = 0.0
            if asked:
                size = leg * cash * (min(abs(z[i]) / enter, 1.0) if sized else 1.0)
                qa, qb = asked * size / ca[i], -asked * size / cb[i]
                cash -= qa * ca[i] + qb * cb[i] + cost * (abs(qa) * ca[i] + abs(qb) * cb[i])
            held = asked
        out[i] = cash + qa * ca[i] + qb * cb[i]
    return out


def stationary_deviation(spread: np.ndarray) -> float:
    """The deviation a reverting spread settles at: that of its steps' errors over sqrt(1 - phi^2); 0 if it does not revert."""
    if len(spread) < 5:
        return 0.0
    before, d = spread[:-1], np.diff(spread)
    var = ((before - before.mean()) ** 2).sum()
    if var <= 0:
        return 0.0
    pull = float(((before - before.mean()) * (d - d.mean())).sum() / var)
    sd = float((d - d.mean() - pull * (before - before.mean())).std())
    return sd / math.sqrt(1 - (1 + pull) ** 2) if abs(1 + pull) < 1 and sd > 0 else 0.0


def traded(bars: DataFrame, days: DataFrame, chosen: DataFrame, train: int, enter: float = 2.0, leave: float = 0.5, cost_bps: float = 2.0, calibrated: bool = False, sized: bool = False,
           labels: DataFrame | None = None, adaptive: bool = False) -> DataFrame:
    """(window, left_key, right_key, ts, ret): each chosen pair's returns on its window's test rows.

    A pair trades on the rows that both legs have: where a leg's bars end, its returns end,
    at the last price.  Pairs with under half the training rows do not trade.  `calibrated`
    asks for a z of four times the cost over the spread's settled deviation at least, and
    leaves pairs out that would need more than 8.  `labels` (window, left_key, right_key,
    ts, regime) are taken as of each row: the last one at or before it.
    """
    pair = ["window", "left_key", "right_key"]
    a = bars.select("ts", F.col("symbol").alias("left_key"), F.col("close").alias("ca"))
    b = bars.select("ts", F.col("symbol").alias("right_key"), F.col("close").alias("cb"))
    rows = chosen.select(*pair, "hedge", "half_life").join(days, "window").join(a, ["ts", "left_key"]).join(b, ["ts", "right_key"])
    rows = rows.select(*pair, "ts", "training", "hedge", "half_life", "ca", "cb", F.lit(None).cast("int").alias("regime"))
    if labels is not None:
        rows = rows.unionByName(labels.select(*pair, "ts", "regime"), allowMissingColumns=True)
    gated = labels is not None

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        # one ordered scan of both streams; of equal times the label comes first
        part = part.assign(first=part["ca"].notna()).sort_values(["ts", "first"], kind="stable")
        regime = part["regime"].ffill().fillna(ACTIVE).to_numpy(int)[part["first"].to_numpy()] if gated else None
        part = part[part["first"]]
        none = pd.DataFrame({"window": pd.Series([], dtype="int32"), "left_key": pd.Series([], dtype=object), "right_key": pd.Series([], dtype=object), "ts": pd.Series([], dtype=object), "ret": pd.Series([], dtype=float)})
        if len(part) < train * 0.5:
            return none
        hedge, lookback = float(part["hedge"].iloc[0]), int(max(20, min(120, part["half_life"].iloc[0] * 3)))
        ca, cb, training = part["ca"].to_numpy(float), part["cb"].to_numpy(float), part["training"].to_numpy(bool)
        bar = enter
        if calibrated or sized:
            sd = stationary_deviation((np.log(ca) - hedge * np.log(cb))[training])
            if sd <= 0 or max(enter, 4 * cost_bps / 1e4 / sd) > 8:
                return none
            bar = max(enter, 4 * cost_bps / 1e4 / sd) if calibrated else enter
        equity = spread_equity(ca, cb, hedge, lookback, bar, leave, cost_bps, sized=sized, regime=regime, adaptive=adaptive)
        if len(equity) < 2:
            return none
        keep = ~training[1:] & (equity[:-1] > 0)
        ret = np.diff(equity)[keep] / equity[:-1][keep]
        return pd.DataFrame({"window": key[0], "left_key": key[1], "right_key": key[2], "ts": part["ts"].to_numpy()[1:][keep], "ret": ret})

    kind = bars.schema["ts"].dataType.simpleString()
    return rows.groupBy(*pair).applyInPandas(one, f"window int, left_key string, right_key string, ts {kind}, ret double")


def walk(bars: DataFrame, train: int = 252, test: int = 63, top: int = 10, shortest: float = 3.0, longest: float = 30.0, most_adf: float | None = None, common: bool = False,
         monitor: int | None = None, **options) -> DataFrame:
    """(window, left_key, right_key, ts, ret) of the pairs chosen on each training window, on its test rows.

    bars(symbol, ts, close) may end early: names are in a window by their bars in its
    training rows, and the calendar has all times.  With `common` it has only the times
    of every symbol, as for a universe that survived.  `monitor`: rows of the regime
    monitor, which closes a pair while its spread shows no reversion.
    """
    bars = bars.where("close > 0").select("symbol", "ts", "close")
    if common:
        whole = calendar(bars, train, test, True).select("ts").distinct()
        bars = bars.join(whole, "ts", "left_semi")
    days = calendar(bars, train, test)
    chosen = written(screened(bars, days, members(bars, days, train), train, top, shortest, longest, most_adf))
    labels = None
    if monitor is not None:
        pair = ["window", "left_key", "right_key"]
        a = bars.select("ts", F.col("symbol").alias("left_key"), F.log("close").alias("la"))
        b = bars.select("ts", F.col("symbol").alias("right_key"), F.log("close").alias("lb"))
        spread = chosen.join(days, "window").join(a, ["ts", "left_key"]).join(b, ["ts", "right_key"]).select(*pair, "ts", (F.col("la") - F.col("hedge") * F.col("lb")).alias("spread"))
        labels = regime_labels(spread, pair, monitor)
    return traded(bars, days, chosen, train, labels=labels, **options)


def basket(returns: DataFrame) -> DataFrame:
    """(ts, net, pairs): the mean return of the pairs that trade at a time."""
    return returns.groupBy("ts").agg(F.avg("ret").alias("net"), F.count("*").alias("pairs"))
