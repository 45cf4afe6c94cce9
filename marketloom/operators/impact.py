"""Market impact by group: a power law of participation, and square-root slopes of calm and lively times.

The power law slippage = c + eta sigma participation^beta is fitted without derivatives
and without gathering a group's rows.  For a given beta the best c and eta follow from six
sums, so a pass takes these sums for a grid of betas in each group's bracket, in one
aggregate, keeps the best beta, and narrows the bracket to its neighbours.  Brackets are a
table of one row a group; nothing comes to the driver between passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources.scratch import written

LEAST_BETA, MOST_BETA = 0.2, 1.0
#: Betas of a pass; each pass after the first narrows the bracket by half as many.
GRID, PASSES = 17, 7


def _solved(n: Column, y: Column, yy: Column, u: Column, uu: Column, uy: Column) -> Column:
    """struct(sse, c, eta) of the best y = c + eta u with neither below 0, from sums."""
    det = n * uu - u * u
    eta = F.when(det > 1e-12 * n * uu, (n * uy - u * y) / det).otherwise(F.lit(0.0))
    c = (y - eta * u) / n
    at_zero = F.greatest(F.when(uu > 0, uy / uu).otherwise(F.lit(0.0)), F.lit(0.0))

    def made(c_: Column, eta_: Column) -> Column:
        sse = yy - 2 * c_ * y - 2 * eta_ * uy + n * c_ * c_ + 2 * c_ * eta_ * u + eta_ * eta_ * uu
        return F.struct(sse.alias("sse"), c_.alias("c"), eta_.alias("eta"))

    edge = F.array_min(F.array(made(F.lit(0.0), at_zero), made(F.greatest(y / n, F.lit(0.0)), F.lit(0.0))))
    return F.when((c >= 0) & (eta >= 0), made(c, eta)).otherwise(edge)


def usable(records: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, x, y, sigma): records with a participation above 0 and a slippage; sigma is null where there is none."""
    there = (F.col("participation") > 0) & F.col("slippage_bps").isNotNull()
    return records.where(there).select(*keys, F.col("participation").alias("x"), F.col("slippage_bps").alias("y"), F.col("realized_vol").alias("sigma"))


def power_law(records: DataFrame, keys: list[str], least: int = 4, ratio: float = 1.5, passes: int = PASSES) -> DataFrame:
    """(*keys, n, c, eta, beta) of records(*keys, participation, slippage_bps, realized_vol).

    Beta lies in 0.2 to 1, c and eta are not negative.  A missing or zero volatility counts
    as 1.  Groups with fewer than `least` records, or with participations less than
    `ratio` apart, have no row.
    """
    points = written(usable(records, keys)).withColumn("sigma", F.coalesce(F.nullif("sigma", F.lit(0.0)), F.lit(1.0)))
    spread = points.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where((F.col("n") >= least) & (F.col("hi") / F.col("lo") >= ratio))
    bracket = spread.select(*keys, F.lit(LEAST_BETA).alias("first"), F.lit(MOST_BETA).alias("final"))
    step = (F.col("final") - F.col("first")) / (GRID - 1)
    for _ in range(passes):
        tried = points.join(bracket.select(*keys, "first", step.alias("step")), keys).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
        tried = tried.select(*keys, "y", "step", (F.col("first") + F.col("step") * F.col("g")).alias("beta"), "g", "x", "sigma").withColumn("u", F.col("sigma") * F.pow("x", "beta"))
        sums = {"y": F.sum("y"), "yy": F.sum(F.col("y") * F.col("y")), "u": F.sum("u"), "uu": F.sum(F.col("u") * F.col("u")), "uy": F.sum(F.col("u") * F.col("y"))}
        took = tried.groupBy(*keys, "g").agg(F.count("*").cast("double").alias("n"), F.first("beta").alias("beta"), F.first("step").alias("step"), *[v.alias(k) for k, v in sums.items()])
        solved = took.select(*keys, "g", "n", "beta", "step", _solved(*[F.col(c) for c in ("n", "y", "yy", "u", "uu", "uy")]).alias("fit"))
        best = solved.groupBy(*keys).agg(F.min_by(F.struct("n", "beta", "step", "fit"), F.struct("fit.sse", "g")).alias("found"))
        low, high = F.greatest(F.col("found.beta") - F.col("found.step"), F.lit(LEAST_BETA)), F.least(F.col("found.beta") + F.col("found.step"), F.lit(MOST_BETA))
        bracket = best.select(*keys, low.alias("first"), high.alias("final"), "found")
    return bracket.select(*keys, F.col("found.n").cast("long").alias("n"), F.col("found.fit.c").alias("c"), F.col("found.fit.eta").alias("eta"), F.col("found.beta").alias("beta"))


def regime_slopes(records: DataFrame, keys: list[str], least: int = 4, ratio: float = 1.5) -> DataFrame:
    """(*keys, threshold, low, high): the square-root slope, 0 at least, of records up to the median volatility and above it.

    A slope is null where its side has fewer than `least` records or participations less
    than `ratio` apart; groups with fewer than twice `least` records with a volatility, or
    without either slope, have no row.
    """
    points = usable(records, keys).where("sigma IS NOT NULL").withColumn("root", F.sqrt("x"))
    edges = points.groupBy(*keys).agg(F.count("*").alias("records"), F.percentile("sigma", F.lit(0.5)).alias("threshold")).where(F.col("records") >= 2 * least)
    calm = F.col("sigma") <= F.col("threshold")
    sums = []
    for name, side in (("low", calm), ("high", ~calm)):
        x, y, root = (F.when(side, F.col(c)) for c in ("x", "y", "root"))
        sxx = F.var_pop(root) * F.count(root)
        fine = (F.count(x) >= least) & (F.max(x) / F.min(x) >= ratio) & (sxx > 1e-12)
        sums.append(F.when(fine, F.greatest(F.covar_pop(y, root) / F.var_pop(root), F.lit(0.0))).alias(name))
    return points.join(edges, keys).groupBy(*keys, "threshold").agg(*sums).where("low IS NOT NULL OR high IS NOT NULL").select(*keys, "threshold", "low", "high")
