"""Lead-lag walk-forward: who led whom on the training rows, traded on the test rows after them.

Sums of lagged products are taken once for each block of rows, whose length divides both
training and test rows, so a window's matrix is the sum of its blocks less the pairs that
reach back beyond its first row; overlapping windows share the work.  Only each follower's
few leaders meet their returns again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def matrix(returns: DataFrame, train: int, test: int, lag: int = 1) -> DataFrame:
    """(window, leader, follower, rho) of returns(symbol, i, ret): the leader's return `lag` rows before against the follower's, on each training window.

    Window w trains on rows w test ... w test + train - 1.  A deviation under 1e-12 counts as 1.
    """
    step = math.gcd(train, test)
    led = returns.select(F.col("symbol").alias("leader"), (F.col("i") + lag).alias("i"), F.col("ret").alias("x"))
    followed = returns.select(F.col("symbol").alias("follower"), "i", F.col("ret").alias("y"))
    both = led.join(followed, "i").where("leader <> follower")
    # the first `lag` rows of a block look back beyond it: they are summed apart, each by its place
    block, head = F.floor(F.col("i") / step).cast("int").alias("block"), F.when(F.col("i") % step < lag, F.col("i") % step).alias("head")
    sums = [F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy")]
    parts = both.groupBy(block, head, "leader", "follower").agg(*sums)
    top = returns.agg(F.max("i")).first()[0]
    windows = (top + 1 - train - test) // test if top is not None else -1
    inside, per = train // step, test // step
    first = F.greatest(F.lit(0), F.ceil((F.col("block") - inside + 1) / per)).cast("int")
    final = F.least(F.floor(F.col("block") / per), F.lit(windows)).cast("int")
    in_windows = parts.where(first <= final).withColumn("window", F.explode(F.sequence(first, final)))
    # of a window's rows, those less than `lag` after its first look back beyond it
    offset = (F.col("block") - F.col("window") * per) * step + F.coalesce("head", F.lit(lag))
    g = in_windows.where(F.col("head").isNull() | (offset >= lag)).groupBy("window", "leader", "follower").agg(*[F.sum(c).alias(c) for c in _SUMS])
    mean = {c: F.col(c) / F.col("n") for c in _SUMS}
    sd = lambda c: F.sqrt(F.greatest(mean[c + c] - mean[c] * mean[c], F.lit(0.0)))
    one = lambda c: F.when(sd(c) < 1e-12, F.lit(1.0)).otherwise(sd(c))
    return g.select("window", "leader", "follower", ((mean["xy"] - mean["x"] * mean["y"]) / (one("x") * one("y"))).alias("rho"))


def walk(closes: DataFrame, train: int = 252, test: int = 63, lag: int = 1, leaders: int = 5, share: float = 0.2, cost_bps: float = 2.0, shuffled: int | None = None) -> DataFrame:
    """(ts, net, turnover, active): half long the followers whose leaders promise most, half short those they promise least.

    closes(symbol, ts, close) on the times that all symbols have.  `shuffled` is a seed: each
    follower's leaders are drawn by a hash of it, with their true strengths, as a control.
    Fewer than max(5, 2 / share) symbols, or than train + test + lag + 2 times, give an
    empty result.
    """
    size = closes.agg(F.countDistinct("symbol").alias("n")).first()["n"]
    days = closes.groupBy("ts").agg(F.countDistinct("symbol").alias("here")).where(F.col("here") == size).select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("i"))
    series = Window.partitionBy("symbol").orderBy("i")
    before = F.lag("close").over(series)
    returns = closes.join(days, "ts").select("symbol", "ts", "i", F.coalesce(F.when(before > 0, F.col("close") / before - 1), F.lit(0.0)).alias("ret"))
    times = days.count()
    k = max(1, round(size * share))
    if size < max(5, round(2 / max(share, 1e-9))) or times < train + test + lag + 2:
        return returns.select("ts", F.lit(0.0).alias("net"), F.lit(0.0).alias("turnover"), F.lit(0).alias("active")).limit(0)
    strength = [F.round(F.abs("rho"), 12).desc(), F.col("leader")] if shuffled is None else [F.xxhash64(F.lit(shuffled), "window", "follower", "leader")]
    picked = matrix(returns.select("symbol", "i", "ret"), train, test, lag).withColumn("place", F.row_number().over(Window.partitionBy("window", "follower").orderBy(*strength)))
    picked = picked.where(F.col("place") <= leaders).select("window", "follower", "leader", "rho")
    told = returns.select(F.col("symbol").alias("leader"), (F.col("i") + lag).alias("i"), F.col("ret").alias("seen")).withColumn("window", F.floor((F.col("i") - train) / test).cast("int")).where("window >= 0")
    said = told.join(picked, ["window", "leader"]).groupBy("window", "i", F.col("follower").alias("symbol")).agg(F.round(F.sum(F.col("rho") * F.col("seen")), 12).alias("promise"))
    up, down = Window.partitionBy("i").orderBy(F.desc("promise"), F.desc("symbol")), Window.partitionBy("i").orderBy("promise", "symbol")
    weight = F.when(F.row_number().over(up) <= k, 0.5 / k).otherwise(0.0) - F.when(F.row_number().over(down) <= k, 0.5 / k).otherwise(0.0)
    book = said.withColumn("weight", weight).join(returns, ["i", "symbol"])
    moved = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(series), F.lit(0.0)))
    day = book.withColumn("moved", moved).groupBy("ts").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.sum("moved").alias("turnover"), F.sum(F.when(F.col("weight") != 0, 1).otherwise(0)).cast("int").alias("active"))
    return day.select("ts", (F.col("gross") - F.col("turnover") * (cost_bps / 1e4)).alias("net"), "turnover", "active")
