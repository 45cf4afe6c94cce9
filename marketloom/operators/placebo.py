"""Placebo distributions of overlays: what chance would have given, by seeded resampling in one aggregate.

Replicas are a small table of numbers.  A replica draws its week blocks by the order of a
hash of seed, replica and block, so the draw is the same however the rows lie.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sharpe(total: Column, squares: Column, n: Column, per_year: float) -> Column:
    """Annual ratio from sums; 0 without deviation."""
    sd = F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)))
    return F.when(sd > 1e-15, total / n / sd * math.sqrt(per_year)).otherwise(0.0)


def expiry_weeks(days: DataFrame) -> DataFrame:
    """days(ts, ret) with `inside`: rows of the weeks, from Monday on, that end with the calendar's third Friday row of a month."""
    d = days.withColumn("month", F.trunc("ts", "month")).withColumn("week", F.trunc("ts", "week"))
    friday = F.when(F.dayofweek("ts") == 6, 1)
    d = d.withColumn("nth", F.when(friday == 1, F.count(friday).over(Window.partitionBy("month").orderBy("ts"))))
    third = F.max(F.when(F.col("nth") == 3, F.col("ts"))).over(Window.partitionBy("week"))
    d = d.withColumn("friday", third)
    inside = F.col("friday").isNotNull() & (F.col("ts") <= F.col("friday")) & (F.trunc("friday", "month") == F.col("month"))
    return d.withColumn("inside", F.coalesce(inside, F.lit(False))).select("ts", "ret", "week", "inside", "friday")


def expiry_week(days: DataFrame, per_year: float = 252.0, cost_bps: float = 2.0, replicas: int = 300, seed: int = 7, block: int = 5) -> DataFrame:
    """One row: the overlay that holds the market in expiry weeks, and its place among as many random week blocks.

    days(ts, ret), one row a time.  A replica holds `block` rows from each of so many
    drawn Mondays as there are expiry weeks, and pays nothing.
    """
    d = expiry_weeks(days).withColumn("i", F.row_number().over(Window.orderBy("ts")) - 1)
    held = F.col("inside").cast("double")
    d = d.withColumn("held", held).withColumn("moved", F.abs(held - F.coalesce(F.lag(held).over(Window.orderBy("i")), F.lit(0.0))))
    d = d.withColumn("net", F.col("held") * F.col("ret") - F.col("moved") * (cost_bps / 1e4))
    real = d.agg(F.count("*").alias("n"), F.countDistinct("friday").alias("weeks"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss"), F.avg("held").alias("exposure"),
                 F.avg(F.when(F.col("inside"), F.col("ret"))).alias("inside_mean"), F.avg(F.when(~F.col("inside"), F.col("ret"))).alias("outside_mean")).first()
    number = lambda name: F.lit(real[name]).cast("double")
    monday = d.where(F.dayofweek("ts") == 2).select(F.col("i").alias("start"))
    line = Window.partitionBy("replica").orderBy(F.xxhash64(F.lit(seed), "replica", "start"), "start")
    tries = d.sparkSession.range(replicas).select(F.col("id").cast("int").alias("replica"))
    drawn = monday.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("place", F.row_number().over(line)).where(F.col("place") <= real["weeks"])
    covered = drawn.select("replica", F.explode(F.sequence("start", F.col("start") + block - 1)).alias("i")).distinct()
    sums = covered.join(d.select("i", "ret"), "i").groupBy("replica").agg(F.sum("ret").alias("ps"), F.sum(F.col("ret") * F.col("ret")).alias("pss"))
    lucky = _sharpe(F.coalesce("ps", F.lit(0.0)), F.coalesce("pss", F.lit(0.0)), number("n"), per_year)
    against = tries.join(sums, "replica", "left").withColumn("lucky", F.round(lucky, 12)).withColumn("sharpe", _sharpe(number("s"), number("ss"), number("n"), per_year))
    percentile = F.avg(F.when(F.col("lucky") < F.round("sharpe", 12), 1.0).otherwise(0.0))
    g = against.agg(F.max("sharpe").alias("sharpe"), percentile.alias("percentile"), F.avg("lucky").alias("placebo_mean"))
    return g.select(F.lit(real["n"]).alias("n"), F.lit(real["weeks"]).alias("weeks"), "sharpe", number("exposure").alias("exposure"), (number("inside_mean") - number("outside_mean")).alias("effect"), "percentile", "placebo_mean")


def matched_exposure(days: DataFrame, per_year: float = 252.0) -> DataFrame:
    """One row: an overlay days(ts, ret, held, net) against the market and against its own mean exposure held throughout."""
    g = days.agg(F.count("*").alias("n"), F.avg("held").alias("exposure"), *[x for c in ("ret", "net") for x in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}"))])
    static = F.col("exposure")
    return g.select(
        "n", "exposure", _sharpe(F.col("s_net"), F.col("ss_net"), F.col("n"), per_year).alias("overlay_sharpe"), _sharpe(F.col("s_ret"), F.col("ss_ret"), F.col("n"), per_year).alias("market_sharpe"),
        _sharpe(static * F.col("s_ret"), static * static * F.col("ss_ret"), F.col("n"), per_year).alias("matched_sharpe"))


def equal_weights(panel: DataFrame, rotated: DataFrame, per_year: float = 252.0, cost_bps: float = 2.0) -> DataFrame:
    """One row: a rotation (ts, net) against all its names in equal weights, which pay for their first purchase only.

    panel(symbol, ts, ret) has every name at every time of the rotation.
    """
    names = panel.groupBy("ts").agg(F.avg(F.coalesce("ret", F.lit(0.0))).alias("equal"))
    both = rotated.select("ts", "net").join(names, "ts").withColumn("first", F.min("ts").over(Window.partitionBy()))
    both = both.withColumn("equal", F.col("equal") - F.when(F.col("ts") == F.col("first"), F.lit(cost_bps / 1e4)).otherwise(0.0))
    g = both.agg(F.count("*").alias("n"), F.covar_pop("net", "equal").alias("cov"), F.var_pop("equal").alias("var"), F.avg("net").alias("m"), F.avg("equal").alias("me"),
                 *[x for c in ("net", "equal") for x in (F.sum(c).alias(f"s_{c}"), F.sum(F.col(c) * F.col(c)).alias(f"ss_{c}"))])
    beta = F.when(F.col("var") > 0, F.col("cov") / F.col("var")).otherwise(0.0)
    return g.select("n", *[_sharpe(F.col(f"s_{c}"), F.col(f"ss_{c}"), F.col("n"), per_year).alias(f"{name}_sharpe") for c, name in (("net", "rotation"), ("equal", "equal"))],
                    beta.alias("beta"), ((F.col("m") - beta * F.col("me")) * per_year).alias("alpha"))
