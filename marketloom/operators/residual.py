"""Residual statistical arbitrage: principal components of rolling windows, scores of what they leave, and the book on them.

The correlation matrix of a window is put together from blocks: a task holds two blocks
of symbols over a chunk of neighbouring windows and gives the centred products of each
window.  Only these products (symbols squared, whatever the history) meet in the task of
a window, which takes their eigenvectors and, from the products alone, every symbol's
loadings.  Factor returns, residuals, their running sums and the regression of these on
their own past are joins, windows and aggregates over (window, row, symbol).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.scratch import written

#: Symbols of a block, and windows of a chunk.
BLOCK, CHUNK = 64, 32


def numbered(returns: DataFrame) -> DataFrame:
    """(symbol, ts, ret, k, d): symbols and times numbered from 0; the numbering sees one row a time and one a symbol."""
    times = returns.select("ts").distinct().withColumn("d", F.row_number().over(Window.orderBy("ts")) - 1)
    names = returns.select("symbol").distinct().withColumn("k", F.row_number().over(Window.orderBy("symbol")) - 1)
    return returns.select("symbol", "ts", "ret").join(times, "ts").join(names, "symbol")


def products(rows: DataFrame, symbols: int, times: int, lookback: int, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(t, i, j, means, cells): for the window of `lookback` rows before t, the centred products of the symbols of blocks i and j.

    Cells lie row by row; i <= j; means are those of block i, on the diagonal only.
    """
    blocks = -(-symbols // block)
    dealt = rows.withColumn("i", F.floor(F.col("k") / block).cast("int"))
    packed = dealt.groupBy("i", "d").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ret"))), lambda x: x["ret"]).alias("r"))
    # row d is in the windows d + 1 ... d + lookback, and a block meets every block
    first, final = F.greatest(F.col("d") + 1, F.lit(lookback)), F.least(F.col("d") + lookback, F.lit(times - 1))
    c = F.explode(F.sequence(F.floor(first / chunk).cast("int"), F.floor(final / chunk).cast("int"))).alias("c")
    spread = packed.where(first <= final).select("i", "d", "r", c)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = spread.select("c", "d", "r", F.col("i").alias("own"), other.alias("other")).select(
        "c", "d", "r", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        i, j, c = key
        part = part.sort_values("d")
        a, b = (part[part["own"] == x] for x in (i, j))
        days, x, y = a["d"].to_numpy(), np.array(a["r"].tolist()), np.array(b["r"].tolist())
        out = []
        for t in range(max(lookback, c * chunk), min(times, (c + 1) * chunk)):
            at = slice(*np.searchsorted(days, (t - lookback, t)))
            mx, my = x[at].mean(axis=0), y[at].mean(axis=0)
            out.append((t, i, j, mx.tolist() if i == j else [], ((x[at] - mx).T @ (y[at] - my)).ravel().tolist()))
        return pd.DataFrame(out, columns=["t", "i", "j", "means", "cells"])

    return met.groupBy("i", "j", "c").applyInPandas(one, "t int, i int, j int, means array<double>, cells array<double>")


def loadings(blocks: DataFrame, symbols: int, lookback: int, factors: int, block: int = BLOCK) -> DataFrame:
    """(t, k, b, q0.., b0..): each window's eigenportfolio weights q of a symbol, and its intercept b and slopes on the portfolios' returns."""
    m = min(factors, symbols - 1)

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s, mu = np.zeros((symbols, symbols)), np.zeros(symbols)
        for i, j, means, cells in part[["i", "j", "means", "cells"]].itertuples(index=False):
            a, b = slice(i * block, min((i + 1) * block, symbols)), slice(j * block, min((j + 1) * block, symbols))
            s[a, b] = np.reshape(cells, (a.stop - a.start, b.stop - b.start))
            s[b, a] = s[a, b].T
            if i == j:
                mu[a] = means
        sd = np.maximum(np.sqrt(np.diag(s) / (lookback - 1)), 1e-12)
        vectors = np.linalg.eigh(s / np.outer(sd, sd) / (lookback - 1))[1][:, -m:]
        q = vectors / sd[:, None]
        slopes = np.linalg.lstsq(q.T @ s @ q, q.T @ s, rcond=None)[0]
        made = {"t": key[0], "k": np.arange(symbols), "b": mu - (mu @ q) @ slopes}
        return pd.DataFrame({**made, **{f"q{f}": q[:, f] for f in range(m)}, **{f"b{f}": slopes[f] for f in range(m)}})

    names = ", ".join(f"{x}{f} double" for x in "qb" for f in range(m))
    return blocks.groupBy("t").applyInPandas(one, f"t int, k int, b double, {names}")


def scores(returns: DataFrame, lookback: int = 60, factors: int = 15, longest: float = 30.0, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(symbol, ts, ret, score): the distance of each symbol's summed residual from its mean, known before ts.

    returns(symbol, ts, ret) is whole: every symbol at every time.  The score is null
    where the residual does not revert (slope on its past within 0.0001 and 1) or only with
    a half-life beyond `longest`.  Fewer than five symbols, or than lookback + 20 times,
    give an empty result.
    """
    rows = written(numbered(returns))
    size = rows.agg(F.max("d"), F.max("k")).first()
    times, symbols = (size[0] + 1, size[1] + 1) if size[0] is not None else (0, 0)
    if times < lookback + 20 or symbols < 5:
        return rows.select("symbol", "ts", "ret", F.lit(None).cast("double").alias("score")).limit(0)
    m = min(factors, symbols - 1)
    load = written(loadings(products(rows, symbols, times, lookback, block, chunk), symbols, lookback, factors, block))
    first, final = F.greatest(F.col("d") + 1, F.lit(lookback)), F.least(F.col("d") + lookback, F.lit(times - 1))
    seen = rows.where(first <= final).select("k", "d", "ret", F.explode(F.sequence(first, final)).alias("t")).join(load, ["t", "k"])
    factor = seen.groupBy("t", "d").agg(*[F.sum(F.col(f"q{f}") * F.col("ret")).alias(f"f{f}") for f in range(m)])
    explained = sum((F.col(f"b{f}") * F.col(f"f{f}") for f in range(m)), F.col("b"))
    left = seen.join(factor, ["t", "d"]).select("t", "k", "d", (F.col("ret") - explained).alias("e"))
    line = Window.partitionBy("t", "k").orderBy("d")
    summed = left.select("t", "k", "d", F.sum("e").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("x"))
    steps = summed.select("t", "k", "d", "x", F.lag("x").over(line).alias("before"))
    past = F.col("before").isNotNull()
    g = steps.groupBy("t", "k").agg(
        F.covar_pop("x", "before").alias("cov"), F.var_pop("before").alias("v0"), F.var_pop(F.when(past, F.col("x"))).alias("v1"), F.avg("before").alias("m0"), F.avg(F.when(past, F.col("x"))).alias("m1"),
        F.max_by("x", "d").alias("last"))
    g = g.withColumn("slope", F.col("cov") / F.greatest("v0", F.lit(1e-18)))
    g = g.withColumn("mean", F.when(F.abs(1 - F.col("slope")) > 1e-9, (F.col("m1") - F.col("slope") * F.col("m0")) / (1 - F.col("slope"))).otherwise(0.0))
    # the mean squared error of the regression
    error = F.col("v1") - 2 * F.col("slope") * F.col("cov") + F.col("slope") * F.col("slope") * F.col("v0")
    g = g.withColumn("sigma", F.sqrt(F.greatest(error, F.lit(1e-18)) / F.greatest(1 - F.col("slope") * F.col("slope"), F.lit(1e-9))))
    fine = (F.col("slope") > 1e-4) & (F.col("slope") < 1 - 1e-6) & (F.lit(math.log(2)) / -F.log("slope") <= longest) & (F.col("sigma") > 1e-12)
    g = g.select(F.col("t").alias("d"), "k", F.when(fine, (F.col("last") - F.col("mean")) / F.col("sigma")).alias("score"))
    return rows.join(g, ["d", "k"]).select("symbol", "ts", "ret", "score")


def banded(scored: DataFrame, open_: float = 1.25, close: float = 0.5) -> DataFrame:
    """`position` against the score: opened beyond `open_`, closed within `close` or where there is no score; one ordered fold a symbol."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        held, out = 0.0, []
        for s in part["score"].to_numpy(float):
            if np.isnan(s):
                held = 0.0
            elif held == 0:
                held = 1.0 if s < -open_ else -1.0 if s > open_ else 0.0
            elif (held > 0 and s > -close) or (held < 0 and s < close):
                held = 0.0
            out.append(held)
        return part.assign(position=out)

    kind = scored.schema["ts"].dataType.simpleString()
    return scored.select("symbol", "ts", "ret", F.round("score", 9).alias("score")).groupBy("symbol").applyInPandas(fold, f"symbol string, ts {kind}, ret double, score double, position double")


def book(positions: DataFrame, cost_bps: float = 2.0) -> DataFrame:
    """(ts, net, names, turnover): half long and half short in equal parts, changes pay; positions known before ts earn its return."""
    side = F.sum(F.when(F.col("position") == F.signum(F.col("position")), F.abs("position"))).over(Window.partitionBy("ts", "position"))
    w = positions.withColumn("weight", F.when(F.col("position") != 0, 0.5 * F.col("position") / side).otherwise(0.0))
    w = w.withColumn("moved", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(Window.partitionBy("symbol").orderBy("ts")), F.lit(0.0))))
    day = w.groupBy("ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.sum(F.abs("position")).cast("int").alias("names"), F.sum("moved").alias("turnover"))
    return day.select("ts", (F.col("gross") - F.col("turnover") * (cost_bps / 1e4)).alias("net"), "names", "turnover")
