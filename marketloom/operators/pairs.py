"""Pairs: screening by regression, mean reversion and unit-root statistics; spread trading as ordered folds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.plans.rel import Rel

#: Dickey-Fuller statistics (constant, no trend) and their probabilities; below the first and from the last on.
ADF_KNOTS = ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-1.95, 0.30), (-1.62, 0.50), (-0.50, 0.80), (0.0, 0.95), (1.0, 0.99))
ADF_LEAST, ADF_MOST = 0.005, 0.995


def aligned(bars: Rel) -> Rel:
    """(left_key, right_key, ts, la, lb): log closes of every pair of symbols on common times."""
    logs = bars.where("close > 0").select("symbol", "ts", x="ln(close)")
    return logs.select("ts", left_key="symbol", la="x").join(logs.select("ts", right_key="symbol", lb="x"), "a.ts = b.ts AND a.left_key < b.right_key")


def hedged(bars: Rel, least: int = 120) -> Rel:
    """The pairs' spreads with the slope of la on lb (1.0 without variance), for pairs with enough overlap."""
    both = aligned(bars)
    slopes = both.group("left_key", "right_key", n="count(*)", cov="covar_pop(la, lb)", var="var_pop(lb)").where(f"n >= {least}")
    slopes = slopes.select("left_key", "right_key", "n", hedge="CASE WHEN var > 1e-18 THEN cov / var ELSE 1.0 END")
    return both.join(slopes, "left_key, right_key").with_(spread="la - hedge * lb")


def reversion(bars: Rel, least: int = 120) -> Rel:
    """One row a pair: hedge, half-life of the spread's reversion, and the Dickey-Fuller t without lags."""
    line = "OVER (PARTITION BY left_key, right_key ORDER BY ts)"
    steps = hedged(bars, least).with_(before=f"lag(spread) {line}").where("before IS NOT NULL").with_(d="spread - before")
    g = steps.group("left_key", "right_key", hedge="max(hedge)", n="count(*)", cov="covar_pop(d, before)", var="var_pop(before)", vd="var_pop(d)", mean="avg(spread)")
    g = g.where("var > 1e-18").with_(slope="cov / var").with_(rss="greatest(vd - slope * cov, 0.0) * n")
    return g.select("left_key", "right_key", "hedge", "n", "slope", half_life="CASE WHEN slope < 0 THEN -ln(2.0) / slope END",
                    adf=f"CASE WHEN n >= 12 AND rss > 1e-18 THEN slope / sqrt(rss / (n - 2) / (var * n)) ELSE 0.0 END",
                    sigma=f"CASE WHEN abs(1.0 + slope) < 1.0 THEN sqrt(rss / n) / sqrt(1.0 - (1.0 + slope) * (1.0 + slope)) END")


def screen(bars: Rel, least: int = 120, shortest: float = 2.0, longest: float = 60.0, most_adf: float | None = None) -> Rel:
    """Pairs whose half-life is within the band; hedge to 3 and half-life to 1 digits."""
    out = reversion(bars, least).where(f"half_life >= {shortest} AND half_life <= {longest}")
    if most_adf is not None:
        out = out.where(f"adf < {most_adf}")
    return out.select("left_key", "right_key", "adf", "n", hedge="round(hedge, 3)", half_life="round(half_life, 1)")


def adf_pvalue(t: float) -> float:
    """Piecewise linear between the knots."""
    if t <= ADF_KNOTS[0][0]:
        return ADF_LEAST
    if t >= ADF_KNOTS[-1][0]:
        return ADF_MOST
    return float(np.interp(t, *zip(*ADF_KNOTS)))


def kalman(la: np.ndarray, lb: np.ndarray, delta: float = 1e-4, noise: float = 1e-3, with_deviation: bool = False):
    """Innovations of a two-state filter (intercept, hedge) from (0, 1) with unit covariance, and their deviations if asked."""
    state, cov = np.array([0.0, 1.0]), np.eye(2)
    drift = delta / (1 - delta) * np.eye(2)
    out, deviation = np.empty(len(la)), np.empty(len(la))
    for i, (y, x) in enumerate(zip(la, lb)):
        cov = cov + drift
        h = np.array([1.0, x])
        out[i] = y - h @ state
        size = h @ cov @ h + noise
        deviation[i] = np.sqrt(size)
        gain = cov @ h / size
        state = state + gain * out[i]
        cov = cov - np.outer(gain, h) @ cov
    return (out, deviation) if with_deviation else out


def trade(a: np.ndarray, b: np.ndarray, hedge: float, lookback: int = 60, enter: float = 2.0, leave: float = 0.5, cost_bps: float = 2.0, leg: float = 0.5, use_kalman: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(position, return): the z of the trailing window (this row included) opens and closes the spread at this close; each leg pays."""
    la, lb = np.log(a), np.log(b)
    spread = kalman(la, lb) if use_kalman else la - hedge * lb
    n = len(spread)
    z = np.zeros(n)
    if n >= lookback:
        view = np.lib.stride_tricks.sliding_window_view(spread, lookback)
        sd = view.std(axis=1)
        z[lookback - 1 :] = np.where(sd > 1e-12, (spread[lookback - 1 :] - view.mean(axis=1)) / np.where(sd > 1e-12, sd, 1), 0)
    position, held = np.zeros(n), 0.0
    for i in range(n):
        if i + 1 >= lookback:
            if held == 0:
                held = -1.0 if z[i] >= enter else 1.0 if z[i] <= -enter else 0.0
            elif abs(z[i]) <= leave:
                held = 0.0
        position[i] = held
    ra, rb = np.diff(a, prepend=a[0]) / np.roll(a, 1), np.diff(b, prepend=b[0]) / np.roll(b, 1)
    ra[0] = rb[0] = 0.0
    before = np.concatenate([[0.0], position[:-1]])
    moved = np.abs(position - before)
    return position, leg * before * (ra - np.sign(hedge) * rb) - moved * 2 * leg * cost_bps / 1e4


def walk_forward(bars: DataFrame, train: int = 104, test: int = 26, top: int = 10, longest: float = 30.0, shortest: float = 2.0, most_adf: float | None = None, **options) -> DataFrame:
    """(window, ts, left_key, right_key, ret): pairs screened on each training window, traded over it and the test rows after it, test rows kept.

    Windows are a small table; each (window, pair) is a task of its own, so neither
    symbols nor history meet in one place.  A window's pairs are its `top` by statistic.
    """
    calendar = [r["ts"] for r in bars.select("ts").distinct().orderBy("ts").collect()]
    spans = [(k, calendar[i], calendar[i + train - 1], calendar[min(i + train + test, len(calendar)) - 1]) for k, i in enumerate(range(0, len(calendar) - train, test))]
    spark = bars.sparkSession
    if not spans:
        return spark.createDataFrame([], "window int, ts date, left_key string, right_key string, ret double")
    windows = F.broadcast(spark.createDataFrame(spans, "window int, first date, cut date, final date"))
    logs = bars.where("close > 0").select("symbol", "ts", "close")
    a = logs.select("ts", F.col("symbol").alias("left_key"), F.col("close").alias("ca"))
    b = logs.select("ts", F.col("symbol").alias("right_key"), F.col("close").alias("cb"))
    both = a.join(b, "ts").where("left_key < right_key").join(windows, F.expr("ts >= first AND ts <= final"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts")
        known = (rows["ts"] <= rows["cut"]).to_numpy()
        la, lb = np.log(rows["ca"].to_numpy()), np.log(rows["cb"].to_numpy())
        empty = pd.DataFrame({name: pd.Series([], dtype=kind) for name, kind in (("window", "int32"), ("ts", "object"), ("left_key", "object"), ("right_key", "object"), ("ret", "float64"), ("score", "float64"))})
        if known.sum() < max(30, int(0.8 * train)):
            return empty
        x, y = lb[known], la[known]
        var = x.var()
        hedge = float(((x - x.mean()) * (y - y.mean())).mean() / var) if var > 1e-18 else 1.0
        s = y - hedge * x
        d, before = np.diff(s), s[:-1]
        vb = before.var()
        if vb < 1e-18:
            return empty
        slope = float(((before - before.mean()) * (d - d.mean())).mean() / vb)
        if slope >= 0 or not shortest <= -math.log(2) / slope <= longest:
            return empty
        rss = max(float(((d - d.mean() - slope * (before - before.mean())) ** 2).sum()), 1e-18)
        score = slope / math.sqrt(rss / (len(d) - 2) / (vb * len(d)))
        if most_adf is not None and score >= most_adf:
            return empty
        _, ret = trade(rows["ca"].to_numpy(), rows["cb"].to_numpy(), round(hedge, 3), **options)
        keep = ~known
        return pd.DataFrame({"window": key[0], "ts": rows["ts"][keep], "left_key": key[1], "right_key": key[2], "ret": ret[keep], "score": score})

    traded = both.groupBy("window", "left_key", "right_key").applyInPandas(one, "window int, ts date, left_key string, right_key string, ret double, score double")
    best = traded.groupBy("window", "left_key", "right_key").agg(F.first("score").alias("s"))
    from pyspark.sql import Window as W

    chosen = best.withColumn("n", F.row_number().over(W.partitionBy("window").orderBy("s", "left_key", "right_key"))).where(F.col("n") <= top).select("window", "left_key", "right_key")
    return traded.join(chosen, ["window", "left_key", "right_key"], "left_semi").drop("score")


def book(bars: Rel, lookback: int = 60, enter: float = 2.0, least: int = 120, longest: float = 60.0) -> Rel:
    """The last row's net weight a symbol: pairs beyond the entry band, each leg half, gross-normalised."""
    line = "OVER (PARTITION BY left_key, right_key ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)".format(lookback - 1)
    good = screen(bars, least, 2.0, longest).select("left_key", "right_key")
    z = hedged(bars, least).join(good, "left_key, right_key").with_(m=f"avg(spread) {line}", sd=f"stddev_pop(spread) {line}", back="row_number() OVER (PARTITION BY left_key, right_key ORDER BY ts DESC)")
    z = z.where("back = 1 AND sd > 1e-12").with_(z="round((spread - m) / sd, 8)").where(f"abs(z) >= {enter}").with_(side="-sign(z)")
    legs = z.select(symbol="left_key", v="0.5 * side").union(z.select(symbol="right_key", v="-0.5 * side * sign(hedge)"))
    net = legs.group("symbol", v="sum(v)")
    return net.with_(gross="sum(abs(v)) OVER ()").select("symbol", weight="v / nullif(gross, 0.0)")


_PAIR = "OVER (PARTITION BY left_key, right_key ORDER BY ts"


def _against_past(spreads: Rel, window: int) -> Rel:
    """Spreads with the mean and variance of the `window` rows before, and the row's number from 0."""
    before = f"{_PAIR} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return spreads.with_(m=f"avg(spread) {before}", v=f"var_pop(spread) {before}", place=f"row_number() {_PAIR}) - 1")


def inventory_spread(spreads: Rel, window: int = 20, gamma: float = 1.0, most: float = 1.0, floor: float = 1e-8) -> Rel:
    """`target` of each spread: (mean - spread) / (gamma variance) of the rows before, clipped; 0 until there are enough."""
    q = f"(m - spread) / ({gamma!r} * greatest(v, {floor!r}))"
    return _against_past(spreads, window).with_(target=f"CASE WHEN place >= {window} THEN greatest({-most!r}, least({most!r}, {q})) ELSE 0.0 END")


def binary_spread(spreads: Rel, window: int = 20, enter: float = 2.0, leave: float = 0.5, most: float = 1.0) -> Rel:
    """`target` of each spread: full against it beyond `enter`, 0 within `leave`, else as before.

    Any state can be left for any other, so the target is the last event: no fold is needed.
    """
    z = _against_past(spreads, window).with_(z=f"CASE WHEN place >= {window} AND v > 0 THEN round((spread - m) / sqrt(v), 10) END")
    said = z.with_(said=f"CASE WHEN z <= {-enter!r} THEN {most!r} WHEN z >= {enter!r} THEN {-most!r} WHEN abs(z) <= {leave!r} THEN 0.0 END")
    return said.with_(target=f"coalesce(@last(said) {_PAIR} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)")


def spread_book(targets: Rel, cost_bps: float = 4.0) -> Rel:
    """(left_key, right_key, ts, net) from each spread's second row on: the target of the row before earns the spread's step and pays for its change."""
    b = targets.with_(held=f"coalesce(lag(target) {_PAIR}), 0.0)", older=f"coalesce(lag(target, 2) {_PAIR}), 0.0)", step=f"spread - lag(spread) {_PAIR})")
    return b.where("step IS NOT NULL").select("left_key", "right_key", "ts", "target", net=f"held * step - abs(held - older) * {cost_bps / 1e4!r}")
