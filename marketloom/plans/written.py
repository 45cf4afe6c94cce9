"""SQL for some engines, written by hand from their rules: it shares nothing with the plans but the bars themselves."""

from __future__ import annotations


def _dense(bars: str) -> str:
    """Every symbol on every date: number of the date, close, return against the symbol's own bar before."""
    return f"""
bars AS ({bars}),
own AS (SELECT symbol, ts, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM bars),
dates AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT ts FROM bars)),
cells AS (SELECT d.t, d.ts, s.symbol, own.close, coalesce(own.r, 0) AS r FROM dates d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN own ON own.ts = d.ts AND own.symbol = s.symbol)"""


def factor_momentum(bars: str, lookback: int, k: int, every: int, bps: float) -> str:
    """A book at t = 1, 1 + every, ... from the momentum known at t - 1; it earns and pays at t; too few names keep the old book."""
    return f"""
WITH {_dense(bars)},
known AS (SELECT a.t + 1 AS t, a.symbol, round(a.close / b.close - 1, 10) AS m FROM cells a JOIN cells b ON b.symbol = a.symbol AND b.t = a.t - {lookback} WHERE a.close IS NOT NULL AND b.close IS NOT NULL AND a.t % {every} = 0),
ranked AS (SELECT t, symbol, row_number() OVER (PARTITION BY t ORDER BY m, symbol) AS up, count(*) OVER (PARTITION BY t) AS n FROM known),
books AS (SELECT t, symbol, CASE WHEN up <= {k} THEN -0.5e0 / {k} WHEN up > n - {k} THEN 0.5e0 / {k} ELSE 0 END AS w FROM ranked WHERE n >= {2 * k}),
turns AS (SELECT DISTINCT t FROM books),
held AS (SELECT c.t, c.ts, c.symbol, c.r, (SELECT max(x.t) FROM turns x WHERE x.t <= c.t) AS made FROM cells c WHERE c.t >= 1),
weighed AS (SELECT h.t, h.ts, h.symbol, h.r, coalesce(b.w, 0) AS w FROM held h LEFT JOIN books b ON b.t = h.made AND b.symbol = h.symbol),
moved AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY t), 0)) AS d FROM weighed)
SELECT CAST(ts AS VARCHAR) AS ts, round(sum(w * r) - sum(d) * {bps / 1e4!r}, 8) + 0.0 AS net FROM moved GROUP BY ts"""


def cross_sectional(bars: str, lookback: int, k: int, every: int, bps: float, reverse: bool) -> str:
    """On dates that all symbols have: a book by the trailing return from t = lookback on, earning from the next date, its cost within the date's growth."""
    sign = "-" if reverse else ""
    return f"""
WITH bars AS ({bars}),
whole AS (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)),
dates AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM whole),
cells AS (SELECT d.t, d.ts, b.symbol, b.close, b.close / lag(b.close) OVER (PARTITION BY b.symbol ORDER BY d.t) - 1 AS r FROM bars b JOIN dates d ON d.ts = b.ts),
known AS (SELECT a.t, a.symbol, round(a.close / b.close - 1, 10) AS m FROM cells a JOIN cells b ON b.symbol = a.symbol AND b.t = a.t - {lookback} WHERE (a.t - {lookback}) % {every} = 0),
ranked AS (SELECT t, symbol, row_number() OVER (PARTITION BY t ORDER BY m, symbol) AS up, count(*) OVER (PARTITION BY t) AS n FROM known),
books AS (SELECT t, symbol, {sign}CASE WHEN up <= {k} THEN -0.5e0 / {k} WHEN up > n - {k} THEN 0.5e0 / {k} ELSE 0e0 END AS w FROM ranked),
after AS (SELECT c.t, c.ts, c.symbol, c.r, coalesce(b.w, 0) AS w FROM cells c LEFT JOIN books b ON b.symbol = c.symbol AND b.t = (SELECT max(x.t) FROM books x WHERE x.t <= c.t)),
moved AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY t), 0) AS before FROM after)
SELECT CAST(ts AS VARCHAR) AS ts, round((1 + sum(before * r)) * (1 - sum(abs(w - before)) * {bps / 1e4!r}) - 1, 8) + 0.0 AS net FROM moved WHERE t >= 1 GROUP BY ts"""


def settled(flows: str) -> str:
    """flows(who, session, amount): purchases count at once, proceeds from the next session with flows on."""
    return f"""
WITH flows AS ({flows}),
days AS (SELECT who, session, sum(amount) AS net, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS sold FROM flows GROUP BY who, session)
SELECT d.who AS o_custkey, CAST(d.session AS VARCHAR) AS session, round((SELECT sum(e.net) FROM days e WHERE e.who = d.who AND e.session <= d.session), 3) AS cash,
round((SELECT sum(e.net) FROM days e WHERE e.who = d.who AND e.session <= d.session) - d.sold, 3) + 0.0 AS settled FROM days d"""


def limit_fills(bars: str) -> str:
    """A limit 0.5% under the close for 40 shares, bought where the volume is over 200 and else sold; at most a tenth of the volume."""
    return f"""
WITH b AS (SELECT symbol, ts, open, high, low, volume, round(close * 0.995e0, 6) AS want, volume > 200 AS buy FROM ({bars})),
hit AS (SELECT *, (buy AND low <= want) OR (NOT buy AND high >= want) AS met FROM b)
SELECT symbol, CAST(ts AS VARCHAR) AS ts, CASE WHEN met AND buy THEN round(CASE WHEN open < want THEN open ELSE want END, 10) WHEN met THEN round(CASE WHEN open > want THEN open ELSE want END, 10) END AS price,
round(CASE WHEN NOT met THEN 0e0 WHEN volume > 0 AND volume * 0.1e0 < 40 THEN volume * 0.1e0 ELSE 40e0 END, 6) AS filled FROM hit"""


def short_interest_tilt(bars: str, reports: str, k: int, lag: int, bps: float, borrow: tuple, per_year: float, reverse: bool) -> str:
    """The book of every date from the days to cover public the date before: the least on one side, the most on the other; shorts pay borrow."""
    base, per, cap = borrow
    side = 0.5 / k if reverse else -0.5 / k
    return f"""
WITH reports AS ({reports}), {_dense(f"SELECT * FROM ({bars}) WHERE symbol IN (SELECT symbol FROM reports)").strip()},
met AS (SELECT symbol, settled, max(days_to_cover) AS d, (SELECT min(x.t) FROM dates x WHERE x.ts >= settled) AS k0 FROM reports WHERE days_to_cover IS NOT NULL GROUP BY symbol, settled),
public AS (SELECT symbol, settled, d, least(k0 + {lag}, (SELECT max(t) FROM dates)) AS t FROM met WHERE k0 IS NOT NULL),
known AS (SELECT c.t, c.ts, c.symbol, c.r, (SELECT arg_max(p.d, p.settled) FROM public p WHERE p.symbol = c.symbol AND p.t < c.t) AS d FROM cells c WHERE c.t >= 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d NULLS LAST, symbol) AS up, count(d) OVER (PARTITION BY t) AS n FROM known),
weighed AS (SELECT *, CASE WHEN n < {2 * k} OR d IS NULL THEN 0e0 WHEN up <= {k} THEN {side!r}::DOUBLE WHEN up > n - {k} THEN {-side!r}::DOUBLE ELSE 0e0 END AS w FROM ranked),
moved AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY t), 0)) AS m, CASE WHEN w < 0 THEN -w * least({base!r}::DOUBLE + {per!r}::DOUBLE * d, {cap!r}::DOUBLE) ELSE 0e0 END AS due FROM weighed)
SELECT CAST(ts AS VARCHAR) AS ts, round(sum(w * r) - sum(m) * {bps / 1e4!r}::DOUBLE - sum(due) / {per_year!r}::DOUBLE, 8) + 0e0 AS net FROM moved GROUP BY ts"""


def combo_report(streams: str, per_year: float) -> str:
    """Streams(symbol, ts, r) cut to their common tail, blended by inverse volatility and by equal weights; an 8% target, half of Kelly's leverage up to 2, 4% free of risk."""
    year = f"{per_year!r}::DOUBLE"
    return f"""
WITH back AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS i FROM ({streams})),
cut AS (SELECT * FROM back WHERE i <= (SELECT min(n) FROM (SELECT count(*) AS n FROM back GROUP BY symbol))),
risk AS (SELECT symbol, 1 / stddev_pop(r) AS u FROM cut GROUP BY symbol),
days AS (SELECT i, sum(r * u) / (SELECT sum(u) FROM risk) AS iv, sum(r) / count(*) AS ew FROM cut JOIN risk USING (symbol) GROUP BY i),
s AS (SELECT count(*) AS n, avg(iv) / stddev_pop(iv) * sqrt({year}) AS a, avg(ew) / stddev_pop(ew) * sqrt({year}) AS b, stddev_pop(iv) * sqrt({year}) AS vol FROM days),
l AS (SELECT *, CASE WHEN a < 0 THEN 0e0 WHEN a / 2 / vol > 2 THEN 2e0 ELSE a / 2 / vol END AS lev FROM s),
v AS (SELECT *, CASE WHEN lev = 0 OR lev * vol > 0.08e0 THEN 0.08e0 ELSE lev * vol END AS used FROM l),
pairs AS (SELECT abs(corr(x.r, y.r)) AS rho FROM cut x JOIN cut y ON x.i = y.i AND x.symbol <> y.symbol GROUP BY x.symbol, y.symbol)
SELECT n, round((SELECT avg(rho) FROM pairs), 7) AS avg_abs_corr, round(b, 7) AS ew_sharpe, round(a, 7) AS iv_sharpe, round(vol, 7) AS vol, round(lev, 7) AS leverage, round(used, 7) AS applied_vol,
round(a * used, 7) AS excess, round(a * used + 0.04e0, 7) AS expected, round(a * used / {year}, 7) AS day_excess, round(used / sqrt({year}), 7) AS day_vol, round(sqrt({year}) / a, 7) AS noise_to_edge FROM v"""


def bars() -> str:
    """Weekly bars of 16 symbols, from their definition: close 100 times the exponential of summed mean discounts less 0.05."""
    return """
SELECT symbol, ts, open, close, volume, round(greatest(open, close) * (1 + tax / 10), 6) AS high, round(least(open, close) * (1 - tax / 10), 6) AS low FROM (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 100e0) AS open FROM (
    SELECT symbol, ts, tax, volume, round(100e0 * exp(sum(step) OVER (PARTITION BY symbol ORDER BY ts)), 6) AS close FROM (
      SELECT 'S' || lpad(CAST(l_partkey % 16 AS VARCHAR), 2, '0') AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts, round(avg(l_discount), 9) - 0.05e0 AS step, max(l_tax) AS tax, sum(l_quantity) AS volume
      FROM lineitem GROUP BY 1, 2)))"""


def window_screen(train: int, test: int, top: int, shortest: float, longest: float) -> str:
    """Pairs of each training window by half-life; S05 ends and S11 begins within the sample."""
    return f"""
WITH b AS (SELECT symbol, ts, ln(close) AS x FROM ({bars()}) WHERE NOT (symbol = 'S05' AND ts > DATE '1999-06-30') AND NOT (symbol = 'S11' AND ts < DATE '1997-06-01')),
d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM b)),
w AS (SELECT k AS window_, d.ts FROM range(0, 1000) r(k) JOIN d ON d.i >= k * {test} AND d.i < k * {test} + {train} WHERE k * {test} + {train + test} <= d.n AND d.n >= {train + 2 * test}),
m AS (SELECT window_, symbol FROM w JOIN b USING (ts) GROUP BY window_, symbol HAVING count(*) >= {0.8 * train!r}),
f AS (SELECT * FROM m WHERE window_ IN (SELECT window_ FROM m GROUP BY window_ HAVING count(*) >= 4)),
r AS (SELECT w.window_, w.ts, b.symbol, b.x FROM w JOIN b USING (ts) JOIN f ON f.window_ = w.window_ AND f.symbol = b.symbol),
p AS (SELECT a.window_, a.symbol AS l, c.symbol AS r, a.ts, a.x AS la, c.x AS lb FROM r a JOIN r c ON a.window_ = c.window_ AND a.ts = c.ts AND a.symbol < c.symbol),
h AS (SELECT window_, l, r, CASE WHEN var_pop(lb) > 0 THEN covar_pop(la, lb) / var_pop(lb) ELSE 1 END AS slope FROM p GROUP BY 1, 2, 3 HAVING count(*) >= {int(train * 0.8)}),
s AS (SELECT p.window_, p.l, p.r, h.slope, la - slope * lb AS s, lag(la - slope * lb) OVER (PARTITION BY p.window_, p.l, p.r ORDER BY p.ts) AS z FROM p JOIN h ON h.window_ = p.window_ AND h.l = p.l AND h.r = p.r),
g AS (SELECT window_, l, r, max(slope) AS slope, covar_pop(s - z, z) / var_pop(z) AS pull FROM s WHERE z IS NOT NULL GROUP BY 1, 2, 3 HAVING var_pop(z) > 0),
q AS (SELECT *, round(-ln(2e0) / pull, 1) AS half_life FROM g WHERE pull < 0 AND -ln(2e0) / pull BETWEEN {shortest!r} AND {longest!r})
SELECT CAST(window_ AS INT) AS "window", l AS left_key, r AS right_key, round(slope, 3) AS hedge, half_life FROM (SELECT *, row_number() OVER (PARTITION BY window_ ORDER BY half_life, l, r) AS place FROM q) WHERE place <= {top}"""


def unit_root(reversion: str, knots: tuple, least: float, most: float) -> str:
    """The probability of each pair's unit-root statistic."""
    case = f"CASE WHEN adf <= {knots[0][0]!r} THEN {least!r}::DOUBLE "
    for (x0, p0), (x1, p1) in zip(knots, knots[1:]):
        case += f"WHEN adf < {x1!r} THEN {p0!r}::DOUBLE + {p1 - p0!r}::DOUBLE * (adf - {x0!r}::DOUBLE) / {x1 - x0!r}::DOUBLE "
    return f"SELECT left_key, right_key, round({case} ELSE {most!r}::DOUBLE END, 7) AS p FROM ({reversion})"


def regime_slopes() -> str:
    """Square-root slopes of fills up to the median volatility of 20 returns and above it."""
    part = lambda side: f"""CASE WHEN count(*) FILTER ({side}) >= 4 AND max(x) FILTER ({side}) / min(x) FILTER ({side}) >= 1.5 AND var_pop(sqrt(x)) FILTER ({side}) * count(*) FILTER ({side}) > 1e-12
  THEN greatest(covar_pop(y, sqrt(x)) FILTER ({side}) / var_pop(sqrt(x)) FILTER ({side}), 0) END"""  # noqa: E731
    return f"""
WITH b AS ({bars()}),
r AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM b),
v AS (SELECT symbol, ts, close, volume, CASE WHEN count(r) OVER l = 20 THEN round(stddev_pop(r) OVER l, 12) END AS vol FROM r WINDOW l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT v.symbol, l_quantity / volume AS x, round(10000 * (close * (1 + (l_discount - l_tax) / 100) - close) / close * CASE WHEN l_returnflag <> 'R' THEN 1 ELSE -1 END, 8) AS y, vol
  FROM lineitem JOIN v ON v.symbol = 'S' || lpad(CAST(l_partkey % 16 AS VARCHAR), 2, '0') AND v.ts = CAST(date_trunc('week', l_shipdate) AS DATE)),
u AS (SELECT * FROM f WHERE x > 0 AND y IS NOT NULL AND vol IS NOT NULL),
e AS (SELECT symbol, quantile_cont(vol, 0.5) AS edge FROM u GROUP BY symbol HAVING count(*) >= 8),
g AS (SELECT symbol, edge, {part('WHERE vol <= edge')} AS low, {part('WHERE vol > edge')} AS high FROM u JOIN e USING (symbol) GROUP BY symbol, edge)
SELECT symbol, round(edge, 5) AS threshold, round(low, 5) + 0e0 AS low, round(high, 5) + 0e0 AS high FROM g WHERE low IS NOT NULL OR high IS NOT NULL"""


def lead_lag_walk(train: int, test: int, leaders: int, k: int, bps: float) -> str:
    """Each follower's leaders by the lagged correlation on the training rows; their promise is traded on the test rows."""
    return f"""
WITH b AS ({bars()}),
d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT ts FROM b GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM b))),
r AS (SELECT symbol, ts, i, n, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1, 0) AS r FROM b JOIN d USING (ts)),
w AS (SELECT k AS w, k * {test} + {train} AS start FROM range(0, 1000) t(k) WHERE k * {test} + {train + test} <= (SELECT max(n) FROM d) AND (SELECT max(n) FROM d) >= {train + test + 3}),
c AS (SELECT w, x.symbol AS a, y.symbol AS f, corr(x.r, y.r) AS rho FROM w JOIN r y ON y.i BETWEEN start - {train} + 1 AND start - 1 JOIN r x ON x.i = y.i - 1 AND x.symbol <> y.symbol GROUP BY 1, 2, 3),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, f ORDER BY round(abs(rho), 12) DESC, a) AS place FROM c) WHERE place <= {leaders}),
s AS (SELECT r.i, p.f AS symbol, round(sum(p.rho * x.r), 12) AS v FROM w JOIN p ON p.w = w.w JOIN r ON r.symbol = p.f AND r.i >= start AND r.i < start + {test} JOIN r x ON x.symbol = p.a AND x.i = r.i - 1 GROUP BY 1, 2),
q AS (SELECT *, (CASE WHEN row_number() OVER (PARTITION BY i ORDER BY v DESC, symbol DESC) <= {k} THEN 0.5e0 / {k} ELSE 0 END) - (CASE WHEN row_number() OVER (PARTITION BY i ORDER BY v, symbol) <= {k} THEN 0.5e0 / {k} ELSE 0 END) AS wt FROM s),
m AS (SELECT r.ts, q.wt, r.r, abs(q.wt - coalesce(lag(q.wt) OVER (PARTITION BY q.symbol ORDER BY q.i), 0)) AS moved FROM q JOIN r ON r.symbol = q.symbol AND r.i = q.i)
SELECT CAST(ts AS VARCHAR) AS ts, round(sum(wt * r) - sum(moved) * {bps / 1e4!r}::DOUBLE, 8) + 0e0 AS net, round(sum(moved), 8) + 0e0 AS turnover, CAST(count(*) FILTER (WHERE wt <> 0) AS INT) AS active FROM m GROUP BY ts"""


def buy_and_hold(per_year: float) -> str:
    return f"""
WITH b AS (SELECT symbol, ts, close, close / lag(close) OVER s - 1 AS r, close / max(close) OVER s - 1 AS fall FROM ({bars()}) WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT symbol, count(*) AS n, arg_min(close, ts) AS first, arg_max(close, ts) AS last, avg(r) AS m, stddev_pop(r) AS sd, min(fall) AS fall FROM b GROUP BY symbol)
SELECT symbol, n, {per_year!r}::DOUBLE AS periods_per_year, CASE WHEN n >= 2 THEN round(last / first - 1, 7) ELSE 0 END AS total_return, CASE WHEN n >= 3 AND sd > 1e-15 THEN round(m / sd * sqrt({per_year!r}::DOUBLE), 7) ELSE 0 END AS sharpe,
CASE WHEN n >= 2 THEN round(least(fall, 0), 7) + 0e0 ELSE 0 END AS max_drawdown FROM g"""


def _flow(window: int) -> str:
    return f"""
q AS (SELECT event_id, event_type AS symbol, ts, CAST(ts AS DATE) AS session, CASE WHEN value > 0 THEN value END AS bid, CASE WHEN value > 0 THEN round(value * (1 + 0.0005e0 * (1 + CAST(user_id % 7 AS DOUBLE))), 6) END AS ask, CAST(1 + event_id % 9 AS DOUBLE) AS bs, CAST(1 + event_id % 7 AS DOUBLE) AS az FROM events),
p AS (SELECT *, lag(bid) OVER s AS pb, lag(ask) OVER s AS pa, lag(bs) OVER s AS pbs, lag(az) OVER s AS paz FROM q WHERE bid IS NOT NULL AND ask IS NOT NULL WINDOW s AS (PARTITION BY symbol, session ORDER BY ts, event_id)),
e AS (SELECT *, CASE WHEN pb IS NOT NULL THEN (CASE WHEN bid > pb THEN bs WHEN bid = pb THEN bs - pbs ELSE -pbs END) - (CASE WHEN ask > pa THEN -paz WHEN ask = pa THEN az - paz ELSE az END) END AS e, CASE WHEN pb IS NOT NULL THEN bs + az END AS size FROM p),
o AS (SELECT *, CASE WHEN count(e) OVER s = {window} THEN sum(e) OVER s / sum(size) OVER s END AS ofi FROM e WINDOW s AS (PARTITION BY symbol, session ORDER BY ts, event_id ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))"""


def quoted_flow(window: int) -> str:
    """The imbalance of a session's last increments."""
    return f"WITH {_flow(window)} SELECT q.event_id, round(o.ofi, 8) + 0e0 AS ofi FROM q LEFT JOIN o USING (event_id)"


def flow_levels(window: int) -> str:
    pct = ", ".join(f"round(quantile_cont(abs(ofi), {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95))
    return f"WITH {_flow(window)}, f AS (SELECT *, count(*) OVER (PARTITION BY symbol, session) AS quotes FROM o) SELECT symbol, count(DISTINCT session) AS days, count(ofi) AS n, {pct} FROM f WHERE quotes > {window} GROUP BY symbol"


def statements(facts: str) -> str:
    """What the documents were made of: the first filings; capital spending in even years only."""
    return f"""
SELECT symbol, CAST(make_date(fy, 12, 31) AS VARCHAR) AS fy_end, CAST(make_date(fy + 1, 3, 1) AS VARCHAR) AS filed, round(net_income, 3) + 0e0 AS net_income, round(cfo, 3) + 0e0 AS cfo, round(total_assets, 3) AS total_assets,
CASE WHEN fy % 2 = 0 THEN round(round(cfo * 0.1e0, 4), 3) + 0e0 END AS capex, round(cfo - CASE WHEN fy % 2 = 0 THEN round(cfo * 0.1e0, 4) ELSE 0 END, 3) + 0e0 AS fcf, round(book_equity, 3) AS book_equity, round(shares, 3) AS shares, round(revenue, 3) AS revenue, round(cogs, 3) AS cogs FROM ({facts}) WHERE total_assets > 0"""


def insider_buys() -> str:
    """Orders as filings, their lines returned as N as purchases."""
    return """
WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, concat(year(o_orderdate), 'q', quarter(o_orderdate)) AS archive, 'S' || lpad(CAST(o_custkey % 16 AS VARCHAR), 2, '0') AS ticker, [o_orderpriority, o_orderstatus] AS roles FROM orders WHERE o_custkey % 17 <> 0),
t AS (SELECT f.*, l_quantity * (l_partkey % 100) AS worth, CAST(l_shipdate AS DATE) AS traded, l_linenumber FROM f JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'N' AND l_partkey % 100 > 0 AND l_quantity > 0)
SELECT ticker, CAST(day AS VARCHAR) AS filing_date, CAST(arg_max(traded, (o_orderkey * 10 + l_linenumber, traded)) AS VARCHAR) AS trans_date, round(CAST(sum(worth) AS DOUBLE), 2) AS buy_value, CAST(count(DISTINCT o_orderkey) AS INT) AS n_owners,
array_to_string(list_sort(list_distinct(flatten(list(roles))))[1:4], '|') AS roles FROM t GROUP BY archive, ticker, day"""


def _chain() -> str:
    made = """sha256('{"event":"' || event || '","order":{"key":' || k || ',"priority":"' || p || '"},"prev_hash":"' || %s || '","seq":' || seq || ',"ts":' || k || '.0}')"""
    event = "CASE o_orderstatus WHEN 'F' THEN 'FILL' WHEN 'O' THEN 'SUBMIT' ELSE 'PARTIAL_FILL' END"
    return f"""
WITH RECURSIVE e AS (SELECT CAST(o_custkey AS VARCHAR) AS log, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2, o_orderkey) - 1 AS seq, {event} AS event, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS p FROM orders),
c AS (SELECT log, seq, event, {made % "repeat('0', 64)"} AS hash FROM e WHERE seq = 0 UNION ALL SELECT e.log, e.seq, e.event, {(made % 'c.hash').replace("|| event", "|| e.event").replace("|| seq", "|| e.seq")} FROM c JOIN e ON e.log = c.log AND e.seq = c.seq + 1)"""


def ledger_chain() -> str:
    """Each customer's orders as a hash chain, even keys before odd ones."""
    return f"{_chain()} SELECT log, seq, event, hash FROM c"


def ledger_check() -> str:
    return "SELECT CAST(o_custkey AS VARCHAR) AS log, count(*) AS total, true AS ok, CAST(NULL AS BIGINT) AS broken_at_seq FROM orders GROUP BY o_custkey"


def nearest(facts: str, tolerance: int) -> str:
    """The shares of the statement nearest in days."""
    return f"""
WITH b AS ({bars()}), f AS ({facts}),
n AS (SELECT b.symbol, b.ts, f.shares, row_number() OVER (PARTITION BY b.symbol, b.ts ORDER BY abs(date_diff('day', f.fy_end, b.ts)), f.fy_end) AS place FROM b JOIN f ON f.symbol = b.symbol AND abs(date_diff('day', f.fy_end, b.ts)) <= {tolerance})
SELECT symbol, CAST(ts AS VARCHAR) AS ts, round(CAST(shares AS DOUBLE), 6) + 0e0 AS value FROM n WHERE place = 1"""


def recent_buyers(days: int) -> str:
    """Each date's bars whose symbol has a large filled order in the days before."""
    return f"""
WITH b AS ({bars()}), o AS (SELECT 'S' || lpad(CAST(o_custkey % 16 AS VARCHAR), 2, '0') AS symbol, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)
SELECT count(*) AS names, CAST(ts AS VARCHAR) AS ts, round(avg(close), 10) AS mean FROM b WHERE EXISTS (SELECT 1 FROM o WHERE o.symbol = b.symbol AND o.day <= b.ts AND date_diff('day', o.day, b.ts) < {days}) GROUP BY ts"""
