"""Execution, microstructure, calibration, account and risk: projections and small aggregates."""

from __future__ import annotations

from marketloom.plans.rel import Rel

#: Regulatory fees on sells (share of notional; a share, at most a trade).
SEC_RATE, TAF_RATE, TAF_CAP = 27.80e-6, 0.000166, 8.30


def microprice(rel: Rel) -> Rel:
    """Micro-price, its tilt within the half-spread (null if locked or crossed) and a signal with a dead band of 0.5."""
    m = rel.with_(micro="(ask * bid_size + bid * ask_size) / nullif(bid_size + ask_size, 0.0)", mid="(bid + ask) / 2.0", half="(ask - bid) / 2.0")
    m = m.with_(tilt="CASE WHEN half > 0 THEN (micro - mid) / half END")
    return m.with_(lean="CASE WHEN tilt > 0.5 THEN 'bull' WHEN tilt < -0.5 THEN 'bear' ELSE 'flat' END", spread_bps="10000.0 * (ask - bid) / nullif(mid, 0.0)")


def order_flow(rel: Rel, window: int = 20) -> Rel:
    """The increment of consecutive quotes and its sum over the window over the quoted size."""
    s = "OVER (PARTITION BY symbol ORDER BY ts, event_id)"
    q = rel.with_(pb=f"lag(bid) {s}", pa=f"lag(ask) {s}", pbs=f"lag(bid_size) {s}", pas=f"lag(ask_size) {s}")
    q = q.with_(e="CASE WHEN pb IS NOT NULL AND pa IS NOT NULL THEN (CASE WHEN bid >= pb THEN bid_size ELSE 0.0 END) - (CASE WHEN bid <= pb THEN pbs ELSE 0.0 END) - (CASE WHEN ask <= pa THEN ask_size ELSE 0.0 END) + (CASE WHEN ask >= pa THEN pas ELSE 0.0 END) END")
    frame = f"OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return q.with_(flow=f"sum(e) {frame}", size=f"sum(bid_size + ask_size) {frame}").with_(ofi="flow / nullif(size, 0.0)")


def quote_quality(rel: Rel, most_bps: float = 50.0) -> Rel:
    """A row a symbol: clean quotes, spread and tilt percentiles."""
    clean = microprice(rel).where(f"bid IS NOT NULL AND ask IS NOT NULL AND ask > bid AND spread_bps <= {most_bps}")
    return clean.group("symbol", quotes="count(*)", spread_p50="@pct(spread_bps, 0.5)", tilt_p75="@pct(abs(tilt), 0.75)", books="count(DISTINCT concat(CAST(bid_size AS STRING), '/', CAST(ask_size AS STRING)))")


def ticked(price: str, tick: float) -> str:
    """The price on the grid of the tick (none: 0)."""
    return f"round(({price}) / {tick!r}) * {tick!r}" if tick else price


def fill_market(ref: str, qty: str, volume: str, buy: str, half_bps: float = 5.0, impact: float = 10.0, cap: float = 0.1, tick: float = 0.0) -> dict[str, str]:
    """filled and price: the volume cap cuts the quantity, half-spread and square-root impact of the request move the price.

    Without a volume there is no cap and no impact; without a price or quantity nothing is filled.
    """
    there, bad = f"coalesce({volume}, 0.0) > 0", f"coalesce({ref}, 0.0) <= 0 OR coalesce({qty}, 0.0) <= 0"
    moved = f"{half_bps} + CASE WHEN {there} THEN {impact} * sqrt({qty} / {volume}) ELSE 0.0 END"
    return {"filled": f"CASE WHEN {bad} THEN 0.0 WHEN {there} THEN least({qty}, {cap} * {volume}) ELSE {qty} END",
            "price": f"CASE WHEN {bad} THEN coalesce({ref}, 0.0) ELSE {ticked(f'{ref} * (1.0 + CASE WHEN {buy} THEN 1.0 ELSE -1.0 END * ({moved}) / 10000.0)', tick)} END"}


def fill_limit(limit: str, open_: str, high: str, low: str, buy: str, qty: str = "1.0", volume: str = "NULL", cap: float = 1.0, tick: float = 0.0) -> dict[str, str]:
    """filled and price of a resting limit: filled if the bar touches it, at the open where that is better, at most the cap's share of the volume."""
    hit = f"coalesce({limit}, 0.0) > 0 AND coalesce({qty}, 0.0) > 0 AND CASE WHEN {buy} THEN {low} <= {limit} ELSE {high} >= {limit} END"
    better = f"CASE WHEN {buy} THEN least({limit}, {open_}) ELSE greatest({limit}, {open_}) END"
    most = f"CASE WHEN coalesce({volume}, 0.0) > 0 THEN least({qty}, {cap} * {volume}) ELSE {qty} END" if cap < 1 else qty
    return {"filled": f"CASE WHEN {hit} THEN {most} ELSE 0.0 END", "price": f"CASE WHEN {hit} THEN {ticked(better, tick)} END"}


def sell_fee(qty: str, price: str) -> str:
    return f"({qty} * {price} * {SEC_RATE!r} + least({qty} * {TAF_RATE!r}, {TAF_CAP}))"


def queue_probability(front: str, back: str, kind: str = "power", n: float = 2.0) -> str:
    """The share of a cancellation in front of us: f / (f + b) of a transform; 0.5 for an empty queue."""
    f = {"power": "pow({}, %r)" % n, "log": "ln(1.0 + {})", "sqrt": "sqrt({})"}[kind]
    a, b = f.format(front), f.format(back)
    return f"CASE WHEN {front} + {back} > 0 THEN {a} / ({a} + {b}) ELSE 0.5 END"


def fills(bars: Rel) -> Rel:
    """Lineitem rows as fills against their bar's close."""
    rows = Rel.table("lineitem").select("l_orderkey", "l_linenumber", symbol="concat('S', lpad(CAST(l_partkey % 16 AS STRING), 2, '0'))", ts="CAST(date_trunc('week', l_shipdate) AS DATE)", qty="l_quantity", buy="l_returnflag <> 'R'", noise="l_discount - l_tax")
    return rows.join(bars.select("symbol", "ts", ref="close", bar_volume="volume"), "symbol, ts").with_(fill_price="ref * (1.0 + noise / 100.0)").with_(
        slippage_bps="round(10000.0 * (fill_price - ref) / ref * CASE WHEN buy THEN 1.0 ELSE -1.0 END, 8)", participation="qty / nullif(bar_volume, 0.0)")


def calibrate(fills: Rel, quoted: str = "CAST(NULL AS DOUBLE)", prior: float = 8.0, ratio: float = 1.5) -> Rel:
    """By symbol: half-spread, impact coefficient and whether it was fitted, both at least 0.

    The half-spread is the median of quoted ones if there are four, else of the slippage of
    the lowest quarter by participation, among fills that have a slippage.  The impact is the slope of slippage on the
    square root of participation, if there are four and the largest participation is
    `ratio` times the smallest; else the prior.
    """
    valid = fills.where("slippage_bps IS NOT NULL")
    edge = valid.group("symbol", q1="@pct(participation, 0.25)")
    f = valid.join(edge, "symbol").with_(root="sqrt(participation)", quote=quoted)
    g = f.group(
        "symbol", n="count(*)", parts="count(participation)", least="min(participation)", most="max(participation)", small="median(CASE WHEN participation <= q1 + 1e-12 THEN slippage_bps END)", every="median(slippage_bps)",
        quotes="count(quote)", measured="median(quote)", cov="covar_pop(slippage_bps, root)", var="var_pop(root)", ms="avg(CASE WHEN root IS NOT NULL THEN slippage_bps END)", mr="avg(root)")
    g = g.with_(fitted=f"CASE WHEN parts >= 4 AND least > 0 AND most / least >= {ratio} AND var > 1e-18 THEN 1 ELSE 0 END")
    return g.select("symbol", "n", "fitted", half_spread="greatest(CASE WHEN quotes >= 4 THEN measured ELSE coalesce(small, every) END, 0.0)", impact=f"CASE WHEN fitted = 1 THEN greatest(cov / var, 0.0) ELSE {prior!r} END", intercept="CASE WHEN fitted = 1 THEN ms - cov / var * mr END")


def tca(fills: Rel, bars: Rel, near: int = 1, far: int = 30) -> Rel:
    """Transient and permanent impact: the close so many bars later against the fill, signed."""
    s = "OVER (PARTITION BY symbol ORDER BY ts)"
    later = bars.select("symbol", "ts", n=f"lead(close, {near}) {s}", f=f"lead(close, {far}) {s}")
    sign = "CASE WHEN buy THEN 1.0 ELSE -1.0 END"
    j = fills.join(later, "symbol, ts")
    return j.group("symbol", arrival_bps="avg(slippage_bps)", worst_bps="max(slippage_bps)", best_bps="min(slippage_bps)", transient_bps=f"avg(10000.0 * (n - fill_price) / fill_price * {sign})", permanent_bps=f"avg(10000.0 * (f - fill_price) / fill_price * {sign})")


# fixed values: the codes in the order in which checks are made
RISK = ("HALTED", "BAD_QTY", "NO_PRICE", "FORBIDDEN", "MAX_ORDER_NOTIONAL", "INSUFFICIENT_BUYING_POWER", "SHORT_NOT_ALLOWED", "RATE_LIMIT", "DAILY_LOSS", "MAX_POSITIONS", "CONCENTRATION")


def risk_code(checks: dict[str, str]) -> str:
    """The first failed check in the fixed order, or OK; checks maps codes to conditions that fail an order."""
    return "CASE " + " ".join(f"WHEN {checks[c]} THEN '{c}'" for c in RISK if c in checks) + " ELSE 'OK' END"


def rate_limited(rel: Rel, key: str, seconds: int, most: int) -> Rel:
    """Whether an order is beyond the rate: the number of the key's orders in the `seconds` up to it; epoch is in seconds."""
    return rel.with_(recent=f"count(*) OVER (PARTITION BY {key} ORDER BY epoch RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW)").with_(limited=f"recent > {most}")


def day_trade_blocked(rel: Rel, key: str, session: str, sessions: int = 5, most: int = 3) -> Rel:
    """Day trades of the rolling sessions, and whether another is blocked."""
    return rel.with_(recent=f"sum(day_trades) OVER (PARTITION BY {key} ORDER BY {session} RANGE BETWEEN {sessions - 1} PRECEDING AND CURRENT ROW)").with_(blocked=f"recent > {most}")


def borrow_apr(dtc: str, base: float, per: float, cap: float) -> str:
    return f"least({base} + {per} * {dtc}, {cap})"


def latency(rel: Rel, keys: tuple, column: str) -> Rel:
    return rel.group(*keys, n=f"count({column})", mean=f"avg({column})", p50=f"@pct({column}, 0.5)", p95=f"@pct({column}, 0.95)", p99=f"@pct({column}, 0.99)", least=f"min({column})", most=f"max({column})")
