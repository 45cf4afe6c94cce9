"""Meta-labelling: trades with what was known when they opened, a logistic model of their success, and its ranking power."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators import pair_walks as pw
from marketloom.sources.scratch import written

FEATURES = ("abs_entry_z", "adf", "half_life", "abs_hedge", "lookback", "train_vol", "side")


def trades_of(ca: np.ndarray, cb: np.ndarray, hedge: float, lookback: int, first: int, enter: float, leave: float, cost_bps: float, leg: float = 0.5) -> list[tuple]:
    """(first row held from `first` on, closing row, side, |z| at the opening, return less the opening's cost) of a spread's trades.

    Trades that are closed before they are held for such a row are left out; the last row closes an open one.
    """
    n = len(ca)
    if n < lookback + 5:
        return []
    spread = np.log(ca) - hedge * np.log(cb)
    view = np.lib.stride_tricks.sliding_window_view(spread, lookback)
    sd = view.std(axis=1)
    z = np.where(sd > 0, (spread[lookback - 1 :] - view.mean(axis=1)) / np.where(sd > 0, sd, 1), 0)
    out, held, at, size = [], 0, 0, 0.0

    def closed(i: int, until: int) -> None:
        since = max(at + 1, first)
        if since < until:
            net = leg * held * (ca[i] / ca[at] - cb[i] / cb[at]) - 2 * leg * cost_bps / 1e4
            out.append((since, i, held, size, float(net)))

    for i in range(lookback - 1, n):
        now = float(z[i - lookback + 1])
        if held == 0:
            if abs(now) > enter:
                held, at, size = (-1 if now > 0 else 1), i, abs(now)
        elif (held == 1 and now >= -leave) or (held == -1 and now <= leave):
            closed(i, i)
            held = 0
    if held:
        closed(n - 1, n)
    return out


def collect_trades(bars: DataFrame, train: int = 252, test: int = 63, top: int = 10, most_adf: float | None = -2.86, enter: float = 2.0, leave: float = 0.5, cost_bps: float = 2.0, shortest: float = 3.0, longest: float = 30.0) -> DataFrame:
    """A row for each trade of the chosen pairs on their test rows: its features, all known at the opening, its net return and label (1: it won)."""
    bars = bars.where("close > 0").select("symbol", "ts", "close")
    bars = bars.join(pw.calendar(bars, train, test, True).select("ts").distinct(), "ts", "left_semi")
    days = pw.calendar(bars, train, test)
    chosen = pw.screened(bars, days, pw.members(bars, days, train), train, top, shortest, longest, most_adf)
    a = bars.select("ts", F.col("symbol").alias("left_key"), F.col("close").alias("ca"))
    b = bars.select("ts", F.col("symbol").alias("right_key"), F.col("close").alias("cb"))
    rows = chosen.join(days, "window").join(a, ["ts", "left_key"]).join(b, ["ts", "right_key"])

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        hedge, half, adf = (float(part[c].iloc[0]) for c in ("hedge", "half_life", "adf"))
        ca, cb, training = part["ca"].to_numpy(float), part["cb"].to_numpy(float), part["training"].to_numpy(bool)
        lookback = int(max(20, min(120, half * 3)))
        vol = float((np.log(ca) - hedge * np.log(cb))[training].std()) if training.sum() > 2 else 0.0
        times = part["ts"].to_numpy()
        made = [(*key, times[o], times[c], z, adf, half, abs(hedge), float(lookback), vol, float(side), net, int(net > 0)) for o, c, side, z, net in trades_of(ca, cb, hedge, lookback, int(training.sum()), enter, leave, cost_bps)]
        return pd.DataFrame(made, columns=["window", "left_key", "right_key", "opened", "closed", *FEATURES, "net", "label"])

    ts = bars.schema["ts"].dataType.simpleString()
    kinds = ", ".join(f"{f} double" for f in FEATURES)
    return rows.groupBy("window", "left_key", "right_key").applyInPandas(one, f"window int, left_key string, right_key string, opened {ts}, closed {ts}, {kinds}, net double, label int")


@dataclass
class Logit:
    """A logistic model of standardised features."""

    features: tuple[str, ...]
    means: np.ndarray
    deviations: np.ndarray
    weights: np.ndarray

    def probability(self) -> Column:
        """The model as an expression over the features."""
        return _probability(self.features, self.means, self.deviations, self.weights)


def _standard(name: str, mean: float, deviation: float) -> Column:
    return (F.col(name) - F.lit(float(mean))) / F.lit(float(deviation))


def _probability(features: tuple, means: np.ndarray, deviations: np.ndarray, weights: np.ndarray) -> Column:
    line = F.lit(float(weights[0]))
    for f, m, d, w in zip(features, means, deviations, weights[1:]):
        line = line + F.lit(float(w)) * _standard(f, m, d)
    return 1 / (1 + F.exp(-line))


def fit_logit(rows: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "label", l2: float = 1.0, steps: int = 500, rate: float = 0.3) -> Logit:
    """Gradient descent on rows(*features, label): each step's gradient is one aggregate, of which a row of as many numbers as weights comes back.

    The rows are written once, for every step to read.  Features are standardised by the rows' own moments (a constant one counts as
    deviation 1); rows with a null feature or label take no part; without rows all weights
    are 0.
    """
    features = tuple(features)
    rows = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label)).dropna()
    rows = written(rows)
    g = rows.agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"d_{f}") for f in features]).first()
    n, weights = g["n"], np.zeros(len(features) + 1)
    if not n:
        return Logit(features, np.zeros(len(features)), np.ones(len(features)), weights)
    means = np.array([g[f"m_{f}"] for f in features])
    deviations = np.array([g[f"d_{f}"] if g[f"d_{f}"] > 1e-12 else 1.0 for f in features])
    x = [F.lit(1.0), *[_standard(f, m, d) for f, m, d in zip(features, means, deviations)]]
    for _ in range(steps):
        error = _probability(features, means, deviations, weights) - F.col(label)
        got = rows.select(error.alias("e"), *[c.alias(f"x{j}") for j, c in enumerate(x)]).agg(*[F.sum(F.col("e") * F.col(f"x{j}")).alias(f"g{j}") for j in range(len(x))]).first()
        gradient = np.array(list(got)) / n
        gradient[1:] += l2 * weights[1:] / n
        weights = weights - rate * gradient
    return Logit(features, means, deviations, weights)


def auc(scored: DataFrame, score: str = "score", label: str = "label", *keys: str, ranges: int = 1024) -> DataFrame:
    """(*keys, positives, negatives, auc): the share of (positive, negative) pairs in which the positive's score is higher, ties half.

    Scores lie in 0 to 1.  Rows are counted by score first; what lies below a score is summed
    within ranges of scores and over the ranges, so no task orders all scores.  Without one
    of the labels the area is 0.5.
    """
    counted = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    counted = counted.withColumn("range", F.least(F.floor(F.col("s") * ranges), F.lit(ranges - 1)).cast("int"))
    by = counted.groupBy(*keys, "range").agg(F.sum("neg").alias("neg_here"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(*keys, "range", F.coalesce(F.sum("neg_here").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy(*keys, "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("under", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(by, [*keys, "range"])
    wins = F.col("pos") * (F.col("below") + F.col("under") + F.col("neg") * 0.5)
    g = ranked.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(wins).alias("wins"))
    both = F.col("positives") * F.col("negatives")
    return g.select(*keys, "positives", "negatives", F.when(both > 0, F.col("wins") / both).otherwise(0.5).alias("auc"))
