"""Evaluation statistics, regimes, gates and portfolio combination over return tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import windows as w
from marketloom.plans.rel import Rel

EULER = 0.5772156649015329


def summary(returns: Rel, per_year: float, ret: str = "net", *keys: str) -> Rel:
    """Sharpe (annual), t, Sortino, volatility, skewness, kurtosis (normal: 3), compounded return, by keys."""
    g = returns.where(f"{ret} IS NOT NULL").group(
        *keys, n="count(*)", mean=f"avg({ret})", sd=f"stddev_pop({ret})", down=f"sqrt(avg(pow(least({ret}, 0.0), 2)))", total=f"exp(sum(ln(greatest(1.0 + {ret}, 1e-12)))) - 1.0",
        m2=f"avg({ret} * {ret})", m3=f"avg({ret} * {ret} * {ret})", m4=f"avg({ret} * {ret} * {ret} * {ret})")
    g = g.with_(
        sharpe=f"CASE WHEN n >= 2 AND sd > 1e-15 THEN mean / sd * sqrt({per_year}) ELSE 0.0 END", tstat="CASE WHEN n >= 3 AND sd > 1e-15 THEN mean / sd * sqrt(CAST(n AS DOUBLE)) ELSE 0.0 END",
        sortino=f"CASE WHEN down > 1e-15 THEN mean / down * sqrt({per_year}) ELSE 0.0 END", vol=f"sd * sqrt({per_year})",
        skew="CASE WHEN n >= 4 AND sd > 1e-15 THEN (m3 - 3.0 * mean * m2 + 2.0 * mean * mean * mean) / (sd * sd * sd) ELSE 0.0 END",
        kurt="CASE WHEN n >= 4 AND sd > 1e-15 THEN (m4 - 4.0 * mean * m3 + 6.0 * mean * mean * m2 - 3.0 * mean * mean * mean * mean) / (sd * sd * sd * sd) ELSE 3.0 END")
    return g.select(*keys, "n", "sharpe", "tstat", "sortino", "vol", "skew", "kurt", "total")


def drawdown(equity: Rel) -> Rel:
    """The deepest fall below the peak so far (at most 0)."""
    return equity.with_(peak="max(equity) OVER (ORDER BY ts)").group(max_drawdown="least(min((equity - peak) / peak), 0.0)")


def beta_alpha(returns: Rel, bench: Rel, per_year: float) -> Rel:
    """Slope, annual intercept and information ratio against a benchmark on common times."""
    both = returns.join(bench.select("ts", b="bench"), "ts")
    g = both.group(n="count(*)", cov="covar_pop(net, b)", var="var_pop(b)", my="avg(net)", mb="avg(b)", excess="avg(net - b)", tracking="stddev_pop(net - b)")
    g = g.with_(beta="CASE WHEN n >= 3 AND var > 1e-18 THEN cov / var ELSE 0.0 END")
    return g.with_(alpha=f"(my - beta * mb) * {per_year}", ir=f"CASE WHEN tracking > 1e-15 THEN excess / tracking * sqrt({per_year}) ELSE 0.0 END").select("n", "beta", "alpha", "ir")


def segments(returns: Rel, k: int, per_year: float) -> Rel:
    """(segment, n, sharpe to two digits) of k equal slices of the equity curve; one whole slice if it has under 3k points.

    The curve has a point more than there are returns; slices share the points at which they meet.
    """
    s = returns.with_(points="count(*) OVER () + 1", i="row_number() OVER (ORDER BY ts) - 1")
    s = s.with_(segment=f"CASE WHEN points < {3 * k} THEN 0 ELSE CAST(floor(((i + 1) * {float(k)} - 1.0) / points) AS INT) END", short=f"CASE WHEN points < {3 * k} THEN 1 ELSE 0 END")
    return summary(s, per_year, "net", "segment", "short").select("segment", "n", sharpe="CASE WHEN short = 1 THEN sharpe ELSE round(sharpe, 2) END")


def by_year(returns: Rel, per_year: float, least: int = 30) -> Rel:
    return summary(returns.with_(year="CAST(year(ts) AS INT)"), per_year, "net", "year").where(f"n >= {least}")


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def normal_ppf_column(p: Column) -> Column:
    """The inverse normal distribution by a rational approximation (absolute error about 1e-9 relative), p within 1e-12 of its ends clipped."""
    # fixed values: the published coefficients of the approximation
    a = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
    b = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]

    def poly(x: Column, cs: list[float]) -> Column:
        out = F.lit(0.0)
        for k in cs:
            out = out * x + F.lit(k)
        return out

    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    tail = lambda q: poly(q, c) / (poly(q, d) * q + 1)
    q = p - 0.5
    r = q * q
    middle = poly(r, a) * q / (poly(r, b) * r + 1)
    return F.when(p < 0.02425, tail(F.sqrt(-2 * F.log(p)))).when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.log(1 - p)))).otherwise(middle)


def normal_ppf(p: float) -> float:
    """The inverse normal distribution by bisection on the error function."""
    lo, hi = -10.0, 10.0
    p = min(max(p, 1e-12), 1 - 1e-12)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def sharpe_pvalue(tstat: float) -> float:
    return 2 * (1 - normal_cdf(abs(tstat)))


def probabilistic_sharpe(sharpe: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """The probability that the true (per-period) ratio is above the benchmark."""
    if n < 3:
        return 0.5
    spread = max(1e-12, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2)
    return normal_cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_max_sharpe(trials: int, variance: float) -> float:
    """The expected best ratio of so many trials without skill."""
    if trials <= 1 or variance <= 0:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * normal_ppf(1 - 1 / trials) + EULER * normal_ppf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sharpe: float, n: int, skew: float, kurt: float, trials: int, variance: float) -> float:
    return probabilistic_sharpe(sharpe, n, skew, kurt, expected_max_sharpe(trials, variance))


def combined_sharpe(sharpe: float, k: int, rho: float) -> float:
    return sharpe * math.sqrt(k) / math.sqrt(1 + (k - 1) * rho)


def half_kelly(sharpe: float, vol: float, fraction: float = 0.5, cap: float = 2.0) -> float:
    return min(max(fraction * sharpe / vol, 0.0), cap) if vol > 0 else 0.0


def sized_leverage(sharpe: float, vol: float, target: float = 0.08, fraction: float = 0.5, cap: float = 2.0) -> float:
    return min(half_kelly(sharpe, vol, fraction, cap), target / vol, cap) if vol > 0 else 0.0


def return_translation(sharpe: float, vol: float, per_year: float = 252.0, risk_free: float = 0.04) -> dict[str, float]:
    annual = risk_free + sharpe * vol
    return {"annual": annual, "per_period": annual / per_year, "excess": sharpe * vol}


# ---- combining streams (symbol, ts, r) --------------------------------------

def correlations(streams: Rel, key: str = "symbol") -> Rel:
    """Population correlation of every pair of streams on common times."""
    a, b = streams.select("ts", left_key=key, x="r"), streams.select("ts", right_key=key, y="r")
    g = a.join(b, "a.ts = b.ts AND a.left_key < b.right_key").group("left_key", "right_key", n="count(*)", cov="covar_pop(x, y)", sx="stddev_pop(x)", sy="stddev_pop(y)")
    return g.where("n >= 3").select("left_key", "right_key", "n", rho="CASE WHEN sx > 1e-15 AND sy > 1e-15 THEN cov / (sx * sy) ELSE 0.0 END")


def inverse_vol_weights(streams: Rel, key: str = "symbol") -> Rel:
    g = streams.group(key, sd="stddev_pop(r)").with_(inverse="CASE WHEN sd > 1e-12 THEN 1.0 / sd ELSE 0.0 END")
    return g.with_(weight="inverse / nullif(sum(inverse) OVER (), 0.0)").select(key, "weight")


def blend(streams: Rel, weights: Rel, key: str = "symbol") -> Rel:
    return streams.join(weights, key).group("ts", net="sum(weight * r)")


def combo_report(streams: Rel, per_year: float = 252.0, target_vol: float = 0.08, fraction: float = 0.5, cap: float = 2.0, risk_free: float = 0.04) -> Rel:
    """One row: the inverse-volatility blend of the streams' common tail against equal weights, and what it would return at a target volatility.

    The leverage is a fraction of Kelly's, from 0 to the cap; `noise_to_edge` is null without an edge.
    """
    from marketloom.operators.panel import tail

    t = tail(streams).select("symbol", "r", ts="place")
    day = t.join(inverse_vol_weights(t), "symbol").group("ts", iv="sum(weight * r)", ew="avg(r)")
    sharpe = lambda x: f"CASE WHEN n >= 2 AND sd_{x} > 1e-15 THEN mean_{x} / sd_{x} * sqrt({per_year!r}) ELSE 0.0 END"
    g = day.group(n="count(*)", mean_iv="avg(iv)", sd_iv="stddev_pop(iv)", mean_ew="avg(ew)", sd_ew="stddev_pop(ew)")
    g = g.with_(iv_sharpe=sharpe("iv"), ew_sharpe=sharpe("ew"), vol=f"sd_iv * sqrt({per_year!r})")
    g = g.with_(leverage=f"CASE WHEN vol > 0 THEN greatest(0.0, least({cap!r}, {fraction!r} * iv_sharpe / vol)) ELSE 0.0 END")
    g = g.with_(applied_vol=f"CASE WHEN leverage > 0 THEN least({target_vol!r}, leverage * vol) ELSE {target_vol!r} END")
    g = g.with_(excess="iv_sharpe * applied_vol", day_vol=f"applied_vol / sqrt({per_year!r})").with_(expected=f"excess + {risk_free!r}", day_excess=f"excess / {per_year!r}")
    g = g.with_(noise_to_edge="CASE WHEN abs(day_excess) > 1e-9 THEN day_vol / day_excess END")
    rho = correlations(t).group(avg_abs_corr="coalesce(avg(abs(rho)), 0.0)")
    return g.join(rho, "1 = 1", hint=True).select("n", "avg_abs_corr", "ew_sharpe", "iv_sharpe", "vol", "leverage", "applied_vol", "excess", "expected", "day_excess", "day_vol", "noise_to_edge")


def combine_tracks(streams: Rel, sleeves: Rel) -> Rel:
    """Union of times: capped sleeves keep min(weight, cap), the others share the rest by weight among those present; times without any are left out."""
    j = streams.join(sleeves, "sleeve")
    g = j.group("ts", pinned="sum(CASE WHEN cap IS NOT NULL THEN least(weight, cap) ELSE 0.0 END)", pinned_ret="sum(CASE WHEN cap IS NOT NULL THEN least(weight, cap) * r ELSE 0.0 END)", core="sum(CASE WHEN cap IS NULL THEN weight ELSE 0.0 END)", core_ret="sum(CASE WHEN cap IS NULL THEN weight * r ELSE 0.0 END)")
    return g.where("core > 0").select("ts", net="pinned_ret + (1.0 - pinned) * core_ret / core")


def _years(candidate: Rel, book: Rel) -> Rel:
    """A row for each year of the common times: sums of both streams, and the same of all other years (names in o_)."""
    both = candidate.select("ts", c="net").join(book.select("ts", b="net"), "ts").with_(year="CAST(year(ts) AS INT)")
    sums = {"n": "CAST(count(*) AS DOUBLE)", "c1": "sum(c)", "b1": "sum(b)", "c2": "sum(c * c)", "b2": "sum(b * b)", "cb": "sum(c * b)"}
    return both.group("year", **sums).with_(**{f"o_{k}": f"sum({k}) OVER () - {k}" for k in sums}, last_year="max(year) OVER ()")


def _moments(rel: Rel, p: str) -> Rel:
    """Population moments from sums named with the prefix."""
    r = rel.with_(mc=f"{p}c1 / nullif({p}n, 0.0)", mb=f"{p}b1 / nullif({p}n, 0.0)")
    return r.with_(sc=f"sqrt(greatest({p}c2 / nullif({p}n, 0.0) - mc * mc, 0.0))", sb=f"sqrt(greatest({p}b2 / nullif({p}n, 0.0) - mb * mb, 0.0))", cov=f"{p}cb / nullif({p}n, 0.0) - mc * mb")


#: The ratio of the mix by inverse volatility: weights sb and sc over their sum, which cancels.
_MIXED = "(sb * mc + sc * mb) / nullif(sqrt(greatest(2.0 * sb * sc * (sb * sc + cov), 0.0)), 0.0)"


def _folds(years: Rel, least: int) -> Rel:
    """Each year with the ratios of the other years, by subtraction from the total; null where these are too few or do not move."""
    g = _moments(years, "o_").with_(fine=f"o_n >= {least} AND sc > 1e-12 AND sb > 1e-12")
    g = g.with_(book_ratio="CASE WHEN fine THEN mb / nullif(sb, 0.0) END", mix_ratio=f"CASE WHEN fine THEN {_MIXED} END")
    return g.select("year", "last_year", "n", "c1", "b1", "c2", "b2", "cb", "o_n", "book_ratio", "mix_ratio", lift="mix_ratio - book_ratio")


def leave_one_year_out(candidate: Rel, book: Rel, least: int = 40) -> Rel:
    """Per left-out year: the ratio of the inverse-volatility mix and of the book, on the other years."""
    return _folds(_years(candidate, book), least).where("lift IS NOT NULL").select("book_ratio", "mix_ratio", "lift", dropped="year", n="CAST(o_n AS BIGINT)")


def leg_gate(candidate: Rel, book: Rel, per_year: float = 252.0, most_rho: float = 0.3, least_lift: float = 0.03, least_share: float = 0.6, least: int = 60) -> Rel:
    """One row: whether a candidate stream improves a book, and the checks.

    Positive by itself, uncorrelated with the book, a lift of the annual Sharpe ratio by
    the inverse-volatility mix, the lift positive in most years left out, and positive
    without the last year.  Both streams are read once, into sums by year.
    """
    f = _folds(_years(candidate, book), 40)
    g = f.group(**{k: f"sum({k})" for k in ("n", "c1", "b1", "c2", "b2", "cb")}, positive="avg(CASE WHEN lift > 0 THEN 1.0 WHEN lift IS NOT NULL THEN 0.0 END)", fold_lift="max(CASE WHEN year = last_year THEN lift END)")
    g = _moments(g, "")
    g = g.with_(rho="CASE WHEN sc > 0 AND sb > 0 THEN cov / (sc * sb) ELSE 0.0 END")
    g = g.with_(root=f"sqrt({per_year})").with_(candidate_sharpe="coalesce(mc / nullif(sc, 0.0), 0.0) * root", book_sharpe="coalesce(mb / nullif(sb, 0.0), 0.0) * root", combined_sharpe=f"coalesce({_MIXED}, 0.0) * root")
    g = g.with_(lift="combined_sharpe - book_sharpe", without_last="coalesce(fold_lift, 0.0) * root", loo_share="coalesce(positive, 0.0)")
    checks = {"forward_positive": "candidate_sharpe > 0", "uncorrelated": f"abs(rho) < {most_rho}", "lifts": f"lift > {least_lift}", "robust_loo": f"loo_share >= {least_share}", "partial_year_safe": "without_last > 0"}
    g = g.with_(enough_overlap=f"n >= {least}", **{k: f"n >= {least} AND {v}" for k, v in checks.items()})
    return g.select("rho", "candidate_sharpe", "book_sharpe", "combined_sharpe", "lift", "loo_share", "without_last", "enough_overlap", *checks, n="CAST(n AS BIGINT)", passed=" AND ".join(checks))


def regime(bench: Rel, lookback: int, per_year: float, trend: float = 0.04, vol: float = 0.25) -> Rel:
    """high_vol, else bull, bear or chop, from the trailing return and volatility of a close series."""
    s = bench.with_(r=f"close / lag(close) {w.SERIES} - 1.0").with_(move=f"close / lag(close, {lookback}) {w.SERIES} - 1.0", v=f"stddev_pop(r) {w.last(lookback)} * sqrt({per_year})", fall=f"close / max(close) {w.last(lookback)} - 1.0")
    return s.where("move IS NOT NULL").with_(regime=f"CASE WHEN v > {vol} THEN 'high_vol' WHEN move > {trend} THEN 'bull' WHEN move < {-trend} THEN 'bear' ELSE 'chop' END")
