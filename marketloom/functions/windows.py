"""Window frames and the rolling and cross-sectional expressions over them.

Expressions are SQL text over the columns symbol and ts, for `Rel.with_` or
`F.expr`.  Null is the only missing value.  One window stage may not read another's
column in the same step: stages follow each other.
"""

from __future__ import annotations

SERIES = "OVER (PARTITION BY symbol ORDER BY ts)"
DAY = "OVER (PARTITION BY ts)"


def last(d: int, back: int = 0) -> str:
    """The d rows of a symbol that end `back` rows before this one."""
    end = "CURRENT ROW" if back == 0 else f"{back} PRECEDING"
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {d - 1 + back} PRECEDING AND {end})"


PAST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SO_FAR = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ROW = f"row_number() {SERIES}"


def warm(expression: str, d: int) -> str:
    """Null until d rows are there."""
    return f"CASE WHEN {ROW} >= {d} THEN {expression} END"


def delay(x: str, d: int) -> str:
    return f"lag({x}, {d}) {SERIES}"


def delta(x: str, d: int) -> str:
    return f"({x} - {delay(x, d)})"


def ts_sum(x: str, d: int) -> str:
    """The sum of what is there (0.0 if nothing is)."""
    return warm(f"coalesce(sum({x}) {last(d)}, 0.0)", d)


def ts_mean(x: str, d: int) -> str:
    return warm(f"avg({x}) {last(d)}", d)


def ts_std(x: str, d: int) -> str:
    return warm(f"stddev_pop({x}) {last(d)}", d)


def ts_min(x: str, d: int) -> str:
    return warm(f"min({x}) {last(d)}", d)


def ts_max(x: str, d: int) -> str:
    return warm(f"max({x}) {last(d)}", d)


def _lags(x: str, d: int) -> list[str]:
    return [x if i == 0 else delay(x, i) for i in range(d)]


def ts_rank(x: str, d: int) -> str:
    """The share (of d) of the window's values that are at most the current one."""
    at_most = " + ".join(f"CASE WHEN {v} <= {x} THEN 1 ELSE 0 END" for v in _lags(x, d))
    return warm(f"CASE WHEN {x} IS NOT NULL THEN ({at_most}) / {float(d)} END", d)


def _extreme(x: str, d: int, which: str) -> str:
    """Place (0 the oldest) of the window's first extreme value."""
    edge = f"{which}({x}) {last(d)}"
    cases = " ".join(f"WHEN {delay(x, d - 1 - i) if i < d - 1 else x} = {edge} THEN {i}" for i in range(d))
    return warm(f"CASE {cases} END", d)


def ts_argmax(x: str, d: int) -> str:
    return _extreme(x, d, "max")


def ts_argmin(x: str, d: int) -> str:
    return _extreme(x, d, "min")


def decay_linear(x: str, d: int) -> str:
    """Weights d (newest) to 1, renormalised over the values that are there."""
    top = " + ".join(f"coalesce({v} * {float(d - i)}, 0.0)" for i, v in enumerate(_lags(x, d)))
    bottom = " + ".join(f"CASE WHEN {v} IS NULL THEN 0.0 ELSE {float(d - i)} END" for i, v in enumerate(_lags(x, d)))
    return warm(f"({top}) / nullif({bottom}, 0.0)", d)


def _pair(x: str, y: str) -> tuple[str, str]:
    return f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"


def rolling_corr(x: str, y: str, d: int) -> str:
    """Pearson over complete pairs: at least max(3, d // 2), both deviating."""
    a, b = _pair(x, y)
    fine = f"count({a}) {last(d)} >= {max(3, d // 2)} AND stddev_pop({a}) {last(d)} > 1e-12 AND stddev_pop({b}) {last(d)} > 1e-12"
    return warm(f"CASE WHEN {fine} THEN covar_pop({a}, {b}) {last(d)} / nullif(stddev_pop({a}) {last(d)} * stddev_pop({b}) {last(d)}, 0.0) END", d)


def rolling_cov(x: str, y: str, d: int) -> str:
    a, b = _pair(x, y)
    return warm(f"CASE WHEN count({a}) {last(d)} >= {max(3, d // 2)} THEN covar_pop({a}, {b}) {last(d)} END", d)


def signed_power(x: str, p: float) -> str:
    return f"(sign({x}) * pow(abs({x}), {p}))"


def xrank(x: str) -> str:
    """Ordinal rank over the day's values / their number; ties by symbol; null with fewer than two."""
    there = f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END"
    place = f"row_number() OVER (PARTITION BY ts, {there} ORDER BY {x}, symbol)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {DAY} >= 2 THEN CAST({place} AS DOUBLE) / count({x}) {DAY} END"


def rank01(x: str) -> str:
    """(rank - 1) / (number - 1)."""
    there = f"CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END"
    place = f"row_number() OVER (PARTITION BY ts, {there} ORDER BY {x}, symbol)"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) {DAY} >= 2 THEN CAST({place} - 1 AS DOUBLE) / (count({x}) {DAY} - 1) END"


def scale(x: str, a: float = 1.0) -> str:
    return f"({x} / nullif(sum(abs({x})) {DAY}, 0.0) * {a})"


def zscore_rows(x: str, least: int = 5) -> str:
    """The day's z-score with the population deviation."""
    return f"CASE WHEN count({x}) {DAY} >= {least} THEN ({x} - avg({x}) {DAY}) / nullif(stddev_pop({x}) {DAY}, 0.0) END"


def zscore_columns(x: str) -> str:
    """A symbol's z-score over all its rows; a deviation under 1e-12 counts as 1."""
    w = "OVER (PARTITION BY symbol)"
    return f"(({x} - avg({x}) {w}) / CASE WHEN stddev_pop({x}) {w} < 1e-12 THEN 1.0 ELSE stddev_pop({x}) {w} END)"


def demean(x: str, by: str) -> str:
    """Less the mean of the day's group; null in groups of one."""
    w = f"OVER (PARTITION BY ts, {by})"
    return f"CASE WHEN count({x}) {w} >= 2 THEN {x} - avg({x}) {w} END"


def z_prior(x: str, d: int) -> str:
    """z-score against the d rows before; 0.0 in the warm-up or without deviation."""
    w = last(d, 1)
    return f"CASE WHEN {ROW} > {d} AND stddev_pop({x}) {w} > 0 THEN ({x} - avg({x}) {w}) / stddev_pop({x}) {w} ELSE 0.0 END"


def true_range(high: str = "high", low: str = "low", close: str = "close") -> str:
    before = delay(close, 1)
    return f"greatest({high} - {low}, abs({high} - {before}), abs({low} - {before}))"
