"""Cross-sectional portfolios: weights from signals, returns from weights.

Weights never depend on equity, so every engine is windows and aggregates.  A
target row holds each symbol's weight from its time on; a weight set at one row
earns from the next.
"""

from __future__ import annotations

from marketloom.functions import windows as w
from marketloom.plans.rel import Rel


def legs(signal: Rel, k: int, long_high: bool = True, gross: float = 1.0, value: str = "signal", least: int | None = None) -> Rel:
    """Signed weights of the k highest and k lowest values of each time, null where fewer than `least` (2k) are there.

    One ascending order by value and symbol decides: ties go to the later symbol at the
    high end, to the earlier one at the low end.
    """
    there = f"CASE WHEN {value} IS NOT NULL THEN 1 ELSE 0 END"
    ranked = signal.with_(n=f"count({value}) {w.DAY}", down=f"CASE WHEN {value} IS NOT NULL THEN row_number() OVER (PARTITION BY ts, {there} ORDER BY {value}, symbol) END").with_(up="n - down + 1")
    side = gross / 2 / k * (1 if long_high else -1)
    return ranked.with_(target=f"CASE WHEN n >= {2 * k if least is None else least} THEN CASE WHEN up <= {k} THEN {side!r} ELSE 0.0 END + CASE WHEN down <= {k} THEN {-side!r} ELSE 0.0 END END")


def hold(targets: Rel, every: int, first: int = 0) -> Rel:
    """Weights that change only on rebalance rows (row - 1 - first divisible by `every`); elsewhere, and where no target could be made, the last ones stay."""
    on = f"row - 1 >= {first} AND (row - 1 - {first}) % {every} = 0"
    return targets.with_(asked=f"CASE WHEN {on} THEN target END").with_(weight=f"coalesce(@last(asked) {w.SO_FAR}, 0.0)")


def tranches(targets: Rel, life: int) -> Rel:
    """The mean of the last `life` rows' targets, no target counting as none."""
    return targets.with_(made="coalesce(target, 0.0)").with_(weight=f"sum(made) {w.last(life)} / {life}")


def earn(weights: Rel, cost_bps: float = 2.0, ret: str = "ret", lag: int = 1, charged: int | None = None, first: int = 1) -> Rel:
    """(ts, gross_ret, turnover, net) from the `first` row on: weights of `lag` rows before earn, and their change costs `charged` rows later (as many)."""
    held = f"coalesce(lag(weight, {lag}) {w.SERIES}, 0.0)" if lag else "weight"
    moved = weights.with_(held=held, moved=f"abs(weight - coalesce(lag(weight) {w.SERIES}, 0.0))")
    if first > 1:
        moved = moved.where(f"row >= {first}")
    day = moved.group("ts", gross_ret=f"sum(held * coalesce({ret}, 0.0))", turnover="sum(moved)")
    paid = f"coalesce(lag(turnover, {lag}) OVER (ORDER BY ts), 0.0)" if (lag if charged is None else charged) else "turnover"
    return day.with_(net=f"gross_ret - {paid} * {cost_bps / 1e4!r}")


def equity(daily: Rel, start: float = 100_000.0, ret: str = "net") -> Rel:
    """Compounded equity; the daily table has one row a time, so its order is one small window."""
    return daily.with_(equity=f"{start} * exp(sum(ln(greatest(1.0 + {ret}, 1e-12))) OVER (ORDER BY ts))")


# ---- signals on the dense panel ---------------------------------------------

def momentum(panel: Rel, lookback: int, skip: int = 0) -> Rel:
    return panel.with_(signal=f"round(lag(close, {skip}) {w.SERIES} / lag(close, {lookback + skip}) {w.SERIES} - 1.0, 10)" if skip else f"round(close / lag(close, {lookback}) {w.SERIES} - 1.0, 10)")


def max_return(panel: Rel, window: int = 21) -> Rel:
    return panel.with_(signal=f"round(CASE WHEN {w.ROW} > {window} THEN max(own) {w.last(window)} END, 10)")


def with_market(panel: Rel, bench: Rel) -> Rel:
    """The panel with `b`, the benchmark's return of the time (0.0 if missing)."""
    return panel.join(bench.select("ts", raw="bench"), "ts", "left").with_(b="coalesce(raw, 0.0)", r="coalesce(own, 0.0)")


def trailing_beta(window: int, back: int = 0) -> str:
    """Covariance (n - 1) over variance (n): larger than the slope by n / (n - 1); 0 without variance."""
    f = w.last(window, back)
    return f"CASE WHEN var_pop(b) {f} > 1e-12 THEN covar_samp(r, b) {f} / var_pop(b) {f} ELSE 0.0 END"


def idiosyncratic_vol(market: Rel, window: int) -> Rel:
    f = w.last(window)
    m = market.with_(beta=trailing_beta(window), vr=f"var_pop(r) {f}", vb=f"var_pop(b) {f}", c=f"covar_pop(r, b) {f}")
    return m.with_(signal=f"CASE WHEN {w.ROW} >= {window} THEN round(sqrt(greatest(vr - 2.0 * beta * c + beta * beta * vb, 0.0)), 10) END")


def residual_momentum(market: Rel, lookback: int, skip: int) -> Rel:
    f = w.last(lookback, skip + 1)
    m = market.with_(beta=trailing_beta(lookback, skip + 1), sr=f"sum(r) {f}", sb=f"sum(b) {f}")
    return m.with_(signal=f"CASE WHEN {w.ROW} > {lookback + skip} THEN round(sr - beta * sb, 10) END")


def vol_managed_momentum(panel: Rel, lookback: int, skip: int, vol_window: int) -> Rel:
    m = panel.with_(s=f"sum(own) {w.last(lookback, skip + 1)}", v=f"stddev_pop(own) {w.last(vol_window, 1)}")
    return m.with_(signal=f"CASE WHEN {w.ROW} > {lookback + skip} AND v > 1e-9 THEN round(s / v, 10) END")


def low_beta(market: Rel, window: int) -> Rel:
    """Trailing beta before this row, high is bad."""
    return market.with_(beta=trailing_beta(window, 1)).with_(signal=f"CASE WHEN {w.ROW} > {window} THEN round(-beta, 10) END")


def near_high(panel: Rel, window: int) -> Rel:
    return panel.with_(signal=f"CASE WHEN {w.ROW} >= {window} THEN round(close / max(close) {w.last(window)}, 10) END")


def gap(panel: Rel) -> Rel:
    return panel.with_(before=f"lag(close) {w.SERIES}").with_(signal="round(open / before - 1.0, 10)")


def seasonality(panel: Rel, least: int) -> Rel:
    """The mean of a symbol's returns in this calendar month over earlier years, with at least so many of them."""
    runs = panel.where("own IS NOT NULL").with_(y="year(ts)", m="month(ts)").group("symbol", "y", "m", s="sum(own)", n="count(own)")
    past = "OVER (PARTITION BY symbol, m ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = runs.with_(ps=f"sum(s) {past}", pn=f"sum(n) {past}").select("symbol", "y", "m", mean=f"CASE WHEN pn >= {least} THEN ps / pn END")
    return panel.with_(y="year(ts)", m="month(ts)").join(before, "symbol, y, m", "left").with_(signal="round(mean, 10)")


def step_signal(panel: Rel, facts: Rel, value: str) -> Rel:
    """A fact's value from its filing on."""
    from marketloom.operators.panel import step

    return step(panel, facts, value).with_(signal="round(value, 10)")


def growth(facts: Rel, column: str) -> Rel:
    """Facts with `growth` of a column against the year before."""
    return facts.with_(before=f"lag({column}) OVER (PARTITION BY symbol ORDER BY fy_end)").with_(growth=f"({column} - before) / nullif(before, 0.0)")


def accruals(facts: Rel) -> Rel:
    """Facts with (net income - operating cash) / mean assets; the first year uses its own assets."""
    a = facts.with_(mean=f"(total_assets + coalesce(lag(total_assets) OVER (PARTITION BY symbol ORDER BY fy_end), total_assets)) / 2.0")
    return a.with_(accrual="CASE WHEN mean > 0 THEN (net_income - cfo) / mean END")


def value_composite(panel: Rel, facts: Rel, sector: str | None = None, momentum_weight: float = 0.0, lookback: int = 52, skip: int = 4) -> Rel:
    """The mean of the available ranks of earnings, free cash and book over price; blended with momentum, less the sector's mean."""
    from marketloom.operators.panel import step

    out = panel
    for name in ("net_income", "fcf", "book_equity"):
        share = facts.with_(each=f"{name} / nullif(shares, 0.0)")
        out = step(out, share, "each", nulls=True).with_(**{f"v_{name}": "round(value / nullif(close, 0.0), 12)"}).select(*_base(out), f"v_{name}")
    names = ("net_income", "fcf", "book_equity")
    out = out.with_(**{f"k_{n}": w.rank01(f"v_{n}") for n in names})
    top = " + ".join(f"coalesce(k_{n}, 0.0)" for n in names)
    number = " + ".join(f"CASE WHEN k_{n} IS NULL THEN 0 ELSE 1 END" for n in names)
    out = out.with_(composite=f"({top}) / nullif({number}, 0)")
    if momentum_weight:
        out = momentum(out, lookback - skip, skip).with_(km=w.rank01("signal"))
        out = out.with_(blend=f"(1.0 - {momentum_weight!r}) * composite + {momentum_weight!r} * km")
    else:
        out = out.with_(blend="composite")
    if sector:
        out = out.with_(sector=sector).with_(free=w.demean("blend", "sector"))
    else:
        out = out.with_(free="blend")
    return out.select("symbol", "ts", "row", "ret", "own", "close", signal="round(free, 10)")


_PANEL = ["ts", "symbol", "open", "close", "volume", "high", "low", "own", "number", "vwap", "ret", "row"]


def _base(out: Rel) -> list[str]:
    """The panel's columns and the value columns made so far."""
    made = [c for step in out.steps if step[0] == "select" for c in step[1] if c.startswith("v_")]
    return [*_PANEL, *dict.fromkeys(made)]


# ---- engines ----------------------------------------------------------------

def k_of(n: int, fraction: float) -> int:
    """Names a side: the fraction of n, halves to even, at least one."""
    return max(1, round(n * fraction))


def factor(signal: Rel, k: int, every: int = 21, cost_bps: float = 2.0, long_high: bool = True) -> Rel:
    """From the second row on, every so many rows a new book by the signal of the row before, which earns at once.

    Without 2k names the old weights stay; turnover costs on the row of the change.
    """
    lagged = signal.with_(known=f"lag(signal) {w.SERIES}")
    return earn(hold(legs(lagged, k, long_high, 1.0, "known"), every, 1), cost_bps, "own", 0, first=2)


def cross_sectional(bars: Rel, lookback: int, every: int, k: int, cost_bps: float = 2.0, reverse: bool = False) -> Rel:
    """On the calendar that all symbols share: legs by the trailing return, renewed every so many rows from the first full lookback on.

    A new book earns from the next row; its cost reduces the equity of the row of the change.
    """
    from marketloom.operators.panel import shared_calendar

    s = shared_calendar(bars).with_(base=f"lag(close, {lookback}) {w.SERIES}")
    s = s.with_(signal=f"CASE WHEN row > {lookback} THEN CASE WHEN base > 0 THEN round(close / base - 1.0, 10) ELSE 0.0 END END")
    day = earn(hold(legs(s, k, not reverse), every, lookback), cost_bps, charged=0, first=2)
    return day.with_(paid=f"turnover * {cost_bps / 1e4!r}").select("ts", "gross_ret", "turnover", net="(1.0 + gross_ret) * (1.0 - paid) - 1.0")


def short_interest(panel: Rel, reports: Rel, lag: int = 10) -> Rel:
    """Days to cover, known `lag` rows after the first row at or past the settlement (the last row at the latest) until a newer report is.

    Reports that settle after the last row, and null figures, are left out; of equal settlements the larger figure counts.
    """
    told = reports.where("days_to_cover IS NOT NULL AND settled IS NOT NULL").select("symbol", stamp="settled", d="days_to_cover").group("symbol", "stamp", dtc="max(d)")
    stack = panel.select("symbol", stamp="ts", side="1", place="row", dtc="CAST(NULL AS DOUBLE)").union(told.select("symbol", "stamp", side="0", place="CAST(NULL AS INT)", dtc="dtc"))
    met = stack.with_(opens="min(place) OVER (PARTITION BY symbol ORDER BY stamp DESC, side DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", top="max(place) OVER (PARTITION BY symbol)")
    public = met.where("side = 0 AND opens IS NOT NULL").select("symbol", "stamp", "dtc", row=f"least(opens + {lag}, top)").group("symbol", "row", made="max_by(dtc, stamp)")
    return panel.join(public, "symbol, row", "left").with_(signal=f"round(@last(made) {w.SO_FAR}, 10)")


def short_interest_tilt(bars: Rel, reports: Rel, k: int, lag: int = 10, cost_bps: float = 2.0, borrow: tuple[float, float, float] = (0.0, 0.0, 1.0), per_year: float = 252.0, reverse: bool = True) -> Rel:
    """Every row: long the k names with the fewest days to cover of the row before, short the k with most (`reverse`; else the other way).

    The calendar is that of the symbols with reports.  Shorts pay borrow = (base, per day to
    cover, cap) a year; flat where fewer than 2k names are known.
    """
    from marketloom.operators.execution import borrow_apr
    from marketloom.operators.panel import dense

    s = short_interest(dense(bars.join(reports.select("symbol").distinct(), "symbol")), reports, lag).with_(known=f"lag(signal) {w.SERIES}")
    held = legs(s, k, not reverse, 1.0, "known").with_(weight="coalesce(target, 0.0)")
    moved = held.with_(moved=f"abs(weight - coalesce(lag(weight) {w.SERIES}, 0.0))", due=f"CASE WHEN weight < 0 THEN -weight * {borrow_apr('known', *borrow)} ELSE 0.0 END").where("row >= 2")
    day = moved.group("ts", gross_ret="sum(weight * coalesce(own, 0.0))", turnover="sum(moved)", drag=f"sum(due) / {per_year!r}")
    return day.with_(net=f"gross_ret - turnover * {cost_bps / 1e4!r} - drag")


def daily(signal: Rel, k: int, cost_bps: float = 2.0, long_high: bool = True) -> Rel:
    """Ranked at every row; flat where fewer than 2k names are there."""
    return earn(legs(signal, k, long_high).with_(weight="coalesce(target, 0.0)"), cost_bps)


def overlapping(signal: Rel, k: int, life: int, cost_bps: float = 2.0, long_high: bool = True) -> Rel:
    return earn(tranches(legs(signal, k, long_high), life), cost_bps)


def overnight_reversal(panel: Rel, lookback: int, k: int, cost_bps: float = 2.0) -> Rel:
    """Yesterday's overnight return, known at the open, earns open to close; both sides are traded every day."""
    s = panel.with_(before=f"lag(close) {w.SERIES}").with_(night="open / before - 1.0", day_ret="close / open - 1.0")
    s = s.with_(signal=f"CASE WHEN {w.ROW} > {lookback} THEN round(avg(night) {w.last(lookback)}, 10) END")
    got = legs(s, k, False).with_(weight="coalesce(target, 0.0)")
    day = got.group("ts", gross_ret="sum(weight * coalesce(day_ret, 0.0))", turnover="2.0 * sum(abs(weight))")
    return day.with_(net=f"gross_ret - turnover * {cost_bps / 1e4!r}")


def time_series_momentum(panel: Rel, lookback: int, vol_window: int, every: int, per_year: float, target: float = 0.1, most: float = 3.0, mode: str = "tsmom", cost_bps: float = 2.0) -> Rel:
    """Each symbol on its own: the trailing return's sign (or always long) at a target volatility, capped, over the number of symbols."""
    s = panel.with_(total=f"sum(own) {w.last(lookback)}", vol=f"stddev_samp(own) {w.last(vol_window)} * sqrt({per_year})", n=f"count(*) {w.DAY}")
    sign = "CASE WHEN round(total, 10) >= 0 THEN 1.0 ELSE -1.0 END" if mode == "tsmom" else "1.0"
    size = "1.0" if mode == "ew_bh" else f"least({target!r} / nullif(vol, 0.0), {most!r})"
    s = s.with_(target=f"CASE WHEN {w.ROW} > {max(lookback, vol_window)} THEN coalesce({sign} * {size}, 0.0) / n END")
    return earn(hold(s, every, max(lookback, vol_window)), cost_bps)


def calendar_position(bars: Rel, before: int = 4, after: int = 3) -> Rel:
    """1.0 on the last and first rows of each month, else 0.0."""
    month = "OVER (PARTITION BY symbol, year(ts), month(ts) ORDER BY ts"
    return bars.with_(first=f"row_number() {month})", final=f"row_number() {month} DESC)").with_(position=f"CASE WHEN first <= {after} OR final <= {before} THEN 1.0 ELSE 0.0 END")


def before_event_position(bars: Rel, dates: Rel, days: int = 1) -> Rel:
    """1.0 on the rows up to `days` before a listed date."""
    marked = bars.join(dates.select(ts="ts", hit="1"), "ts", "left").with_(hit_here="coalesce(hit, 0)")
    ahead = " , ".join(f"coalesce(lead(hit_here, {i}) {w.SERIES}, 0)" for i in range(1, days + 1))
    return marked.with_(position=f"CAST(greatest({ahead}, 0) AS DOUBLE)")


def positioned(rel: Rel, cost_bps: float = 2.0) -> Rel:
    """The last row's position earns this row's return; its changes cost."""
    out = rel.with_(r=f"close / lag(close) {w.SERIES} - 1.0", held=f"coalesce(lag(position) {w.SERIES}, 0.0)", moved=f"abs(position - coalesce(lag(position) {w.SERIES}, 0.0))")
    return out.with_(net=f"coalesce(held * r, 0.0) - moved * {cost_bps / 1e4!r}")


def inventory_target(rel: Rel, window: int, gamma: float = 1.0, most: float = 1.0, floor: float = 1e-6) -> Rel:
    """clip((mean of earlier closes - close) / (close * gamma * variance of recent returns))."""
    m = rel.with_(step=f"close / lag(close) {w.SERIES} - 1.0").with_(mu=f"avg(close) {w.last(window, 1)}", var=f"var_pop(step) {w.last(window)}")
    raw = f"(mu - close) / (close * {gamma!r} * greatest(var, {floor!r}))"
    return m.with_(position=f"CASE WHEN {w.ROW} > {window} THEN greatest(least({raw}, {most!r}), {-most!r}) ELSE 0.0 END")


def band_target(rel: Rel, x: str, window: int, enter: float, leave: float, most: float = 1.0) -> Rel:
    """z against the earlier window: beyond `enter` short or long, within `leave` flat, else as before."""
    z = rel.with_(z=f"round({w.z_prior(x, window)}, 10)")
    z = z.with_(event=f"CASE WHEN {w.ROW} <= {window} THEN 0.0 WHEN z >= {enter} THEN {-most!r} WHEN z <= {-enter} THEN {most!r} WHEN abs(z) <= {leave} THEN 0.0 END")
    return z.with_(position=f"coalesce(@last(event) {w.SO_FAR}, 0.0)")


# ---- event studies ----------------------------------------------------------

def entries(bars: Rel, events: Rel, skip: int = 1) -> Rel:
    """(symbol, seen_at, surprise, number): the symbol's bar number `skip` bars on from the last one at or before an event.

    Bars and events are stacked and counted in one order by time; events before the
    symbol's first bar have none.
    """
    line = bars.select("symbol", seen_at="ts", bar="1", surprise="CAST(NULL AS DOUBLE)").union(events.select("symbol", seen_at="event_ts", bar="0", surprise="CAST(surprise AS DOUBLE)"))
    counted = line.with_(seen="sum(bar) OVER (PARTITION BY symbol ORDER BY seen_at, bar DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return counted.where("bar = 0 AND seen >= 1").select("symbol", "seen_at", "surprise", number=f"CAST(seen + {skip} AS BIGINT)")


def event_drift(bars: Rel, events: Rel, hold_rows: int, skip: int = 1, threshold: float = 2.0, leg: str = "both", borrow_apr: float = 0.0, per_year: float = 252.0, cost_bps: float = 2.0) -> Rel:
    """(ts, names, net): an event's sign is held `hold_rows` of the symbol's bars from its entry bar on, and earns from the row after.

    A later event of a symbol takes over.  Each side is equally weighted: half the book,
    or all of it with one leg.  Turnover and borrowed shares cost.
    """
    from marketloom.operators.panel import dense

    chosen = entries(bars, events.where(f"abs(surprise) >= {threshold}"), skip)
    begun = chosen.with_(side="CAST(CASE WHEN surprise > 0 THEN 1.0 ELSE -1.0 END AS DOUBLE)").group("symbol", "number", side="max_by(side, seen_at)")
    d = dense(bars).join(begun, "symbol, number", "left").with_(entered="CASE WHEN side IS NOT NULL THEN number END")
    d = d.with_(side_now=f"@last(side) {w.SO_FAR}", last_entered=f"@last(entered) {w.SO_FAR}")
    d = d.with_(position=f"CASE WHEN number < last_entered + {hold_rows} THEN side_now ELSE 0.0 END").with_(held=f"coalesce(lag(position) {w.SERIES}, 0.0)")
    d = d.with_(ups=f"sum(CASE WHEN held > 0 THEN 1 ELSE 0 END) {w.DAY}", downs=f"sum(CASE WHEN held < 0 THEN 1 ELSE 0 END) {w.DAY}")
    up, down = {"both": (0.5, 0.5), "long": (1.0, 0.0), "short": (0.0, 1.0)}[leg]
    d = d.with_(weight=f"CASE WHEN held > 0 THEN {up} / ups WHEN held < 0 THEN {-down} / downs ELSE 0.0 END")
    d = d.with_(moved=f"abs(weight - coalesce(lag(weight) {w.SERIES}, 0.0))").where("row >= 2")
    day = d.group("ts", names="sum(CASE WHEN held <> 0 THEN 1 ELSE 0 END)", gross_ret="sum(weight * coalesce(own, 0.0))", turnover="sum(moved)", short="sum(greatest(-weight, 0.0))")
    return day.with_(net=f"gross_ret - turnover * {cost_bps / 1e4!r} - short * {borrow_apr / per_year!r}")


def announcement_returns(bars: Rel, events: Rel, window: int = 3) -> Rel:
    """(symbol, event_ts, surprise): the percentage return from the bar before an event's first bar to `window - 1` bars after it."""
    own = bars.with_(n=f"row_number() {w.SERIES}", before=f"lag(close) {w.SERIES}", after=f"lead(close, {window - 1}) {w.SERIES}")
    first = entries(bars, events).select("symbol", event_ts="seen_at", n="number").distinct()
    return first.join(own.select("symbol", "n", "before", "after"), "symbol, n").where("before > 0 AND after IS NOT NULL").select("symbol", "event_ts", surprise="round(100.0 * (after / before - 1.0), 10)")


def recent_buyers(panel: Rel, buys: Rel, days: int = 90) -> Rel:
    """The panel rows whose symbol was bought in the `days` before: the last purchase is carried along one scan of both, stacked."""
    told = buys.where("bought IS NOT NULL").select("symbol", stamp="bought", side="0", told_at="bought")
    stack = panel.select("symbol", stamp="ts", side="1", told_at="CAST(NULL AS DATE)").union(told)
    met = stack.with_(last_bought="@last(told_at) OVER (PARTITION BY symbol ORDER BY stamp, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    hit = met.where(f"side = 1 AND @days(stamp, last_bought) < {days}").select("symbol", ts="stamp").distinct()
    return panel.join(hit, "symbol, ts", "left_semi")
