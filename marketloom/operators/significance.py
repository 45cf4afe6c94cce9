"""How sure a Sharpe ratio is: probabilistic and deflated ratios of many streams at once, in one aggregate and columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.statistics import EULER, normal_ppf_column

_TERMS = 140


def normal_cdf_column(x: Column) -> Column:
    """The normal distribution by the series of positive terms x^(2k+1) / (1 3 5 ... (2k+1)) times its density; beyond 9 deviations 0 or 1."""
    start = F.struct(F.abs(x).alias("term"), F.abs(x).alias("total"))

    def step(a: Column, k: Column) -> Column:
        term = a["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    half = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), start, step)["total"] * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    inside = F.least(F.lit(0.5), half)
    return F.when(F.abs(x) > 9, F.when(x > 0, 1.0).otherwise(0.0)).otherwise(0.5 + F.signum(x) * inside)


def expected_max_column(trials: Column, variance: Column) -> Column:
    """The expected best ratio of so many trials without skill."""
    best = (1 - EULER) * normal_ppf_column(1 - 1 / trials) + EULER * normal_ppf_column(1 - 1 / (trials * math.e))
    return F.when((trials < 2) | (variance <= 0), 0.0).otherwise(F.sqrt(variance) * best)


def significance(streams: DataFrame, key: str = "symbol", ret: str = "r", per_year: float = 252.0) -> DataFrame:
    """A row for each stream: n, annual sharpe, tstat, p_value, probabilistic, expected_max (per period) and deflated.

    All streams count as trials, the variance is that of their ratios.  A stream with fewer
    than four returns, or without deviation, has a ratio, t and probabilities of 0.
    """
    r = F.col(ret)
    g = streams.where(r.isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_pop(r).alias("sd"), *[F.avg(F.pow(r, F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)])
    moves = (F.col("n") >= 4) & (F.col("sd") > 1e-15)
    m, sd = F.col("m"), F.nullif("sd", F.lit(0.0))
    g = g.withColumn("ratio", F.when(moves, m / sd).otherwise(0.0))
    skew = (F.col("m3") - 3 * m * F.col("m2") + 2 * m * m * m) / F.pow(sd, F.lit(3))
    kurt = (F.col("m4") - 4 * m * F.col("m3") + 6 * m * m * F.col("m2") - 3 * m * m * m * m) / F.pow(sd, F.lit(4))
    error = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * F.col("ratio") + (kurt - 1) / 4 * F.col("ratio") * F.col("ratio")))
    every = Window.partitionBy()
    g = g.withColumn("error", error).withColumn("trials", F.count("*").over(every).cast("double")).withColumn("variance", F.var_pop("ratio").over(every))
    g = g.withColumn("expected_max", expected_max_column(F.col("trials"), F.col("variance")))
    root = F.sqrt(F.col("n") - 1)
    chance = lambda against: F.when(moves, normal_cdf_column((F.col("ratio") - against) * root / F.col("error"))).otherwise(0.0)
    t = F.col("ratio") * F.sqrt("n")
    return g.select(key, "n", (F.col("ratio") * math.sqrt(per_year)).alias("sharpe"), t.alias("tstat"), F.when(moves, 2 * (1 - normal_cdf_column(F.abs(t)))).otherwise(1.0).alias("p_value"),
                    chance(F.lit(0.0)).alias("probabilistic"), "expected_max", chance(F.col("expected_max")).alias("deflated"))


def buy_and_hold(bars: DataFrame, per_year: float | None = None) -> DataFrame:
    """A row for each symbol: n, periods_per_year, total_return, sharpe and max_drawdown of holding it from its first bar.

    Without `per_year` it is the median number of bars a day that has any, times 252.
    Bars without a close do not count; symbols with fewer than two have nothing but zeros.
    """
    fine = bars.where("close IS NOT NULL AND close <> 0")
    line = Window.partitionBy("symbol").orderBy("ts")
    days = fine.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count("*").alias("bars")).groupBy("symbol").agg(F.percentile("bars", F.lit(0.5)).alias("typical"), F.count("*").alias("days"))
    b = fine.withColumn("ret", F.col("close") / F.lag("close").over(line) - 1).withColumn("fall", F.col("close") / F.max("close").over(line.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = b.groupBy("symbol").agg(F.count("*").alias("n"), F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("sd"), F.min("fall").alias("fall"))
    year = F.lit(float(per_year)) if per_year is not None else F.when(F.col("days") >= 2, F.col("typical") * 252.0).otherwise(252.0)
    there = (F.col("n") >= 2) & (F.col("first") > 0)
    g = g.join(days, "symbol").withColumn("periods_per_year", year)
    sharpe = F.when(there & (F.col("n") >= 3) & (F.col("sd") > 1e-15), F.col("m") / F.col("sd") * F.sqrt("periods_per_year")).otherwise(0.0)
    return g.select("symbol", "n", "periods_per_year", F.when(there, F.col("last") / F.col("first") - 1).otherwise(0.0).alias("total_return"), sharpe.alias("sharpe"), F.when(there, F.least("fall", F.lit(0.0))).otherwise(0.0).alias("max_drawdown"))
