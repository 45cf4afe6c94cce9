"""Overlays and study operators: exposure rules, rotation, hardened momentum, lead-lag, selection, ledgers."""

from __future__ import annotations

from marketloom.functions import windows as w
from marketloom.plans.rel import Rel


def tail_hedge(returns: Rel, window: int = 60, skew: float = -0.3, kurt: float = 4.0, cut: float = 0.25, cost_bps: float = 2.0) -> Rel:
    """Exposure is cut by `cut` where the rows before show negative skewness and fat tails; it earns the next row and its changes cost."""
    f = f"OVER (ORDER BY ts ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    m = returns.with_(n=f"count(bench) {f}", a=f"avg(bench) {f}", b=f"avg(bench * bench) {f}", c=f"avg(bench * bench * bench) {f}", d=f"avg(bench * bench * bench * bench) {f}")
    m = m.with_(var="b - a * a")
    m = m.with_(sk="CASE WHEN var > 1e-14 THEN (c - 3.0 * a * b + 2.0 * a * a * a) / (var * sqrt(var)) ELSE 0.0 END", ku="CASE WHEN var > 1e-14 THEN (d - 4.0 * a * c + 6.0 * a * a * b - 3.0 * a * a * a * a) / (var * var) ELSE 3.0 END")
    m = m.with_(exposure=f"CASE WHEN n >= {window} AND round(sk, 8) < {skew} AND round(ku, 8) > {kurt} THEN {1 - cut!r} ELSE 1.0 END")
    m = m.with_(held="coalesce(lag(exposure) OVER (ORDER BY ts), 1.0)").with_(moved="abs(held - coalesce(lag(held) OVER (ORDER BY ts), 1.0))")
    return m.with_(net=f"held * bench - moved * {cost_bps / 1e4!r}")


def expiry_week(calendar: Rel) -> Rel:
    """Whether a date is in the week, Monday to Friday, that ends with the calendar's third Friday of a month."""
    c = calendar.with_(friday="CASE WHEN @dow(ts) = 6 THEN 1 ELSE 0 END", week="CAST(date_trunc('week', ts) AS DATE)")
    c = c.with_(nth="sum(friday) OVER (PARTITION BY year(ts), month(ts) ORDER BY ts)").with_(third="CASE WHEN friday = 1 AND nth = 3 THEN 1 ELSE 0 END")
    return c.with_(marked="max(third) OVER (PARTITION BY week)").with_(expiry="CASE WHEN @dow(ts) BETWEEN 2 AND 6 THEN marked ELSE 0 END")


def rotation(panel: Rel, lookback: int = 8) -> Rel:
    """Each month's first row takes the middle name (of an even number the upper one) by the return of the rows before it, held until the next."""
    s = panel.with_(score=f"CASE WHEN row > {lookback} THEN round(exp(sum(ln(1.0 + coalesce(ret, 0.0))) {w.last(lookback, 1)}) - 1.0, 10) END", first="row_number() OVER (PARTITION BY symbol, year(ts), month(ts) ORDER BY ts)")
    s = s.with_(n=f"count(score) {w.DAY}", place=f"CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY ts, CASE WHEN score IS NULL THEN 0 ELSE 1 END ORDER BY score, symbol) END")
    s = s.with_(asked="CASE WHEN first = 1 AND n > 0 THEN CASE WHEN place = CAST(floor(n / 2.0) AS INT) + 1 THEN 1.0 ELSE 0.0 END END")
    return s.with_(weight=f"coalesce(@last(asked) {w.SO_FAR}, 0.0)")


def trend_book(panel: Rel, lookback: int = 52, vol_window: int = 13, target: float = 0.1, per_year: float = 52.0) -> Rel:
    """Sign over volatility, divided by the row's gross."""
    s = panel.with_(move=f"round(close / lag(close, {lookback}) {w.SERIES} - 1.0, 10)", vol=f"stddev_pop(own) {w.last(vol_window)} * sqrt({per_year})")
    s = s.with_(raw=f"CASE WHEN move IS NOT NULL AND vol > 1e-9 THEN sign(move) * {target} / vol ELSE 0.0 END")
    return s.with_(weight=f"coalesce(raw / nullif(sum(abs(raw)) {w.DAY}, 0.0), 0.0)")


def market_trend(panel: Rel, window: int) -> Rel:
    """(ts, er): the efficiency ratio of the equal-weight market's index over the last rows: its net move over the sum of its moves."""
    day = panel.where("close > 0").group("ts", mean="avg(coalesce(ret, 0.0))").with_(px="exp(sum(ln(1.0 + mean)) OVER (ORDER BY ts))")
    day = day.with_(move="abs(px - coalesce(lag(px) OVER (ORDER BY ts), px))")
    f = f"OVER (ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    day = day.with_(path=f"sum(move) {f}", base=f"first_value(px) OVER (ORDER BY ts ROWS BETWEEN {window} PRECEDING AND CURRENT ROW)")
    return day.select("ts", er="CASE WHEN path > 0 THEN round(abs(px - base) / path, 9) ELSE 0.0 END")


def hardened_momentum(panel: Rel, lookback: int = 48, skip: int = 4, every: int = 4, gate: int = 12, least: float = 0.3, fewest: int = 10) -> Rel:
    """Every so many rows the whole cross-section by z-scores of its skipped momentum, gross 1; flat where the market has no trend or names are few."""
    from marketloom.operators.portfolio import hold

    s = panel.join(market_trend(panel, gate), "ts", "left").with_(past=f"lag(close, {skip}) {w.SERIES}", base=f"lag(close, {lookback + skip}) {w.SERIES}")
    s = s.with_(x="CASE WHEN close > 0 AND past > 0 AND base > 0 THEN past / base - 1.0 END")
    s = s.with_(n=f"count(x) {w.DAY}", mean=f"avg(x) {w.DAY}", sd=f"stddev_pop(x) {w.DAY}").with_(z="coalesce((x - mean) / (sd + 1e-12), 0.0)")
    s = s.with_(size=f"sum(abs(z)) {w.DAY}").with_(target=f"CASE WHEN n >= {fewest} AND er >= {least} AND size > 0 THEN z / size ELSE 0.0 END")
    return hold(s, every, lookback + skip + 1)


def lead_lag(panel: Rel, lag: int = 1) -> Rel:
    """Correlation of every leader's earlier return with every follower's."""
    a = panel.with_(before=f"lag(ret, {lag}) {w.SERIES}").where("before IS NOT NULL").select("ts", leader="symbol", x="before")
    b = panel.where("ret IS NOT NULL").select("ts", follower="symbol", y="ret")
    g = a.join(b, "a.ts = b.ts AND a.leader <> b.follower").group("leader", "follower", n="count(*)", cov="covar_pop(x, y)", sx="stddev_pop(x)", sy="stddev_pop(y)")
    return g.select("leader", "follower", "n", rho="CASE WHEN sx > 1e-12 AND sy > 1e-12 THEN cov / (sx * sy) ELSE 0.0 END")


def top_leaders(matrix: Rel, n: int = 5) -> Rel:
    ranked = matrix.with_(size="round(abs(rho), 9)").with_(place="row_number() OVER (PARTITION BY follower ORDER BY size DESC, leader)")
    return ranked.where(f"place <= {n}")


def representative(bars: Rel, first: int = 120, least: int = 150) -> Rel:
    """Per symbol with enough bars: the median close and dollar volume of its first bars."""
    b = bars.with_(row="row_number() OVER (PARTITION BY symbol ORDER BY ts)", bars="count(*) OVER (PARTITION BY symbol)").where(f"bars >= {least} AND row <= {first}")
    return b.group("symbol", price="median(close)", dollars="median(close * volume)")


def latest(rows: Rel, keys: str, order: str) -> Rel:
    """The last row of each key."""
    return rows.with_(age=f"row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC)").where("age = 1")


def settled_cash(flows: Rel, key: str, session: str, amount: str, lag: int = 1) -> Rel:
    """All cash so far, and what is settled: purchases count at once, proceeds `lag` sessions later."""
    day = flows.group(key, session, flow=f"sum({amount})", proceeds=f"sum(greatest({amount}, 0.0))")
    line = f"OVER (PARTITION BY {key} ORDER BY {session} ROWS BETWEEN"
    return day.with_(cash=f"sum(flow) {line} UNBOUNDED PRECEDING AND CURRENT ROW)", pending=f"sum(proceeds) {line} {lag - 1} PRECEDING AND CURRENT ROW)" if lag else "0.0").with_(settled="cash - pending")
