"""Ordered folds: single-asset strategies as step functions, and the simulations that trade them.

A strategy is a function of (bars so far, position) that says 'buy', 'sell' or
nothing; it never sees later bars.  The same step functions serve batch folds (one
symbol a task, `applyInPandas`) and streams (`marketloom.streaming`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class State:
    """The bars a strategy may look at, and what it remembers between bars."""

    high: list[float] = field(default_factory=list)
    low: list[float] = field(default_factory=list)
    close: list[float] = field(default_factory=list)
    open: list[float] = field(default_factory=list)
    volume: list[float] = field(default_factory=list)
    session: list[str] = field(default_factory=list)
    position: int = 0
    memory: dict = field(default_factory=dict)

    def push(self, bar: dict, keep: int = 400) -> None:
        for name in ("open", "high", "low", "close", "volume"):
            series = getattr(self, name)
            series.append(float(bar[name]))
            del series[:-keep]
        self.session.append(str(bar.get("session", "")))
        del self.session[:-keep]


Step = Callable[[State], str | None]


def rsi(closes: list[float], n: int) -> float | None:
    """Wilder's index from the buffer: 100 without losses, 50 if flat."""
    if len(closes) < n + 1:
        return None
    d = np.diff(closes)
    up, down = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = up[:n].mean(), down[:n].mean()
    for x, y in zip(up[n:], down[n:]):
        a, b = (a * (n - 1) + x) / n, (b * (n - 1) + y) / n
    if b == 0:
        return 50.0 if a == 0 else 100.0
    return 100 - 100 / (1 + a / b)


def true_ranges(s: State) -> np.ndarray:
    h, low, c = np.array(s.high), np.array(s.low), np.array(s.close)
    return np.maximum(h[1:] - low[1:], np.maximum(abs(h[1:] - c[:-1]), abs(low[1:] - c[:-1])))


def atr(s: State, n: int) -> float | None:
    return float(true_ranges(s)[-n:].mean()) if len(s.close) > n else None


def adx(s: State, n: int = 14) -> float | None:
    """Wilder's directional index; None before 2 n + 1 bars."""
    if len(s.close) < 2 * n + 1:
        return None
    up, down = np.diff(s.high), -np.diff(s.low)
    plus, minus, tr = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0), true_ranges(s)
    p, m, t, values = plus[:n].sum(), minus[:n].sum(), tr[:n].sum(), []
    for i in range(n, len(tr) + 1):
        total = p + m
        values.append(100 * abs(p - m) / total if t > 0 and total > 0 else 0.0)
        if i < len(tr):
            p, m, t = p - p / n + plus[i], m - m / n + minus[i], t - t / n + tr[i]
    out = float(np.mean(values[:n]))
    for v in values[n:]:
        out = (out * (n - 1) + v) / n
    return out


def _ema(s: State, key: str, value: float, n: int) -> float:
    before = s.memory.get(key)
    s.memory[key] = value if before is None else before + (value - before) * 2 / (n + 1)
    return s.memory[key]


def _cross(s: State, go: bool, stop: bool) -> str | None:
    return "buy" if go and s.position <= 0 else "sell" if stop and s.position > 0 else None


def donchian(n: int = 20, atr_n: int = 14, k: float = 2.0) -> Step:
    def step(s: State) -> str | None:
        if len(s.close) <= max(n, atr_n):
            return None
        top, bottom, c = max(s.high[-n - 1 : -1]), min(s.low[-n - 1 : -1]), s.close[-1]
        if s.position <= 0 and c > top:
            s.memory["stop"] = c - k * (atr(s, atr_n) or 0.0)
            return "buy"
        return "sell" if s.position > 0 and (c < bottom or c < s.memory.get("stop", -np.inf)) else None

    return step


def opening_range(n: int = 5, stop: float = 0.02, take: float = 0.04) -> Step:
    def step(s: State) -> str | None:
        m = s.memory
        m["seen"] = m.get("seen", 0) + 1
        if m["seen"] <= n:
            m["top"], m["bottom"] = max(m.get("top", -np.inf), s.high[-1]), min(m.get("bottom", np.inf), s.low[-1])
            return None
        c = s.close[-1]
        if s.position <= 0 and c > m["top"]:
            m["entry"] = c
            return "buy"
        e = m.get("entry", c)
        return "sell" if s.position > 0 and (c <= e * (1 - stop) or c >= e * (1 + take) or c < m["bottom"]) else None

    return step


def keltner(n: int = 20, atr_n: int = 10, k: float = 1.5, stop: float = 0.02) -> Step:
    def step(s: State) -> str | None:
        if "mid" not in s.memory and len(s.close) == n:
            s.memory["mid"] = float(np.mean(s.close))
        elif "mid" in s.memory:
            _ema(s, "mid", s.close[-1], n)
        a = atr(s, atr_n)
        if "mid" not in s.memory or a is None:
            return None
        c = s.close[-1]
        if s.position <= 0 and c > s.memory["mid"] + k * a:
            s.memory["entry"] = c
            return "buy"
        return "sell" if s.position > 0 and (c < s.memory["mid"] or c <= s.memory.get("entry", c) * (1 - stop)) else None

    return step


def supertrend(n: int = 10, k: float = 3.0) -> Step:
    def step(s: State) -> str | None:
        a, m = atr(s, n), s.memory
        if a is None:
            return None
        mid, c, before = (s.high[-1] + s.low[-1]) / 2, s.close[-1], s.close[-2]
        up, low = mid + k * a, mid - k * a
        m["up"] = up if "up" not in m or up < m["up"] or before > m["up"] else m["up"]
        m["low"] = low if "low" not in m or low > m["low"] or before < m["low"] else m["low"]
        d = m.get("d", 1)
        m["d"] = -1 if d > 0 and c < m["low"] else 1 if d < 0 and c > m["up"] else d
        return _cross(s, m["d"] > 0, m["d"] < 0)

    return step


def zscore(n: int = 60, enter: float = 2.0, leave: float = 0.5, stop: float = 3.5) -> Step:
    def step(s: State) -> str | None:
        if len(s.close) < n:
            return None
        x = np.array(s.close[-n - 1 :])
        z = (x[-1] - x.mean()) / x.std() if x.std() > 0 else 0.0
        return _cross(s, -stop < z <= -enter, z >= -leave or z <= -stop)

    return step


def rsi_reversion(n: int = 2, low: float = 10.0, leave: float = 50.0, stop: float = 0.05) -> Step:
    def step(s: State) -> str | None:
        r = rsi(s.close[-(4 * n + 5) :], n)
        if r is None:
            return None
        c = s.close[-1]
        if s.position <= 0 and r <= low:
            s.memory["entry"] = c
            return "buy"
        return "sell" if s.position > 0 and (r >= leave or c <= s.memory.get("entry", c) * (1 - stop)) else None

    return step


def rsi_momentum(n: int = 14, enter: float = 60.0, leave: float = 50.0) -> Step:
    def step(s: State) -> str | None:
        r = rsi(s.close[-(4 * n + 5) :], n)
        return None if r is None else _cross(s, r >= enter, r < leave)

    return step


def ema_cross(fast: int = 12, slow: int = 26) -> Step:
    def step(s: State) -> str | None:
        a, b = _ema(s, "fast", s.close[-1], fast), _ema(s, "slow", s.close[-1], slow)
        return None if len(s.close) < slow else _cross(s, a > b, a < b)

    return step


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Step:
    def step(s: State) -> str | None:
        line = _ema(s, "fast", s.close[-1], fast) - _ema(s, "slow", s.close[-1], slow)
        bar = line - _ema(s, "signal", line, signal)
        return None if len(s.close) < slow + signal else _cross(s, bar > 0, bar < 0)

    return step


def atr_breakout(n: int = 20, atr_n: int = 14, k: float = 0.5) -> Step:
    def step(s: State) -> str | None:
        if len(s.close) < max(n, atr_n + 1) + 1:
            return None
        a, c = float(true_ranges(s)[-atr_n - 1 : -1].mean()), s.close[-1]
        return _cross(s, c > max(s.high[-n - 1 : -1]) + k * a, c < min(s.low[-n - 1 : -1]) - k * a)

    return step


def bollinger_expansion(n: int = 20, k: float = 2.0) -> Step:
    def step(s: State) -> str | None:
        if len(s.close) < n + 1:
            return None
        x, y = np.array(s.close[-n:]), np.array(s.close[-n - 1 : -1])
        wider = x.std() / x.mean() > y.std() / y.mean()
        return _cross(s, wider and x[-1] > x.mean() + k * x.std(), x[-1] < x.mean())

    return step


def session_vwap() -> Step:
    def step(s: State) -> str | None:
        m = s.memory
        if m.get("session") != s.session[-1]:
            m.update(session=s.session[-1], pv=0.0, v=0.0, bars=0)
        m["pv"] += (s.high[-1] + s.low[-1] + s.close[-1]) / 3 * s.volume[-1]
        m["v"] += s.volume[-1]
        m["bars"] += 1
        if m["bars"] < 2 or m["v"] <= 0:
            return None
        return _cross(s, s.close[-1] > m["pv"] / m["v"], s.close[-1] < m["pv"] / m["v"])

    return step


def session_momentum(enter: float = 0.005, leave: float = 0.0, bars: int = 5) -> Step:
    def step(s: State) -> str | None:
        m = s.memory
        if m.get("session") != s.session[-1]:
            m.update(session=s.session[-1], first=s.close[-1], n=0)
        m["n"] += 1
        r = s.close[-1] / m["first"] - 1
        return None if m["n"] < bars else _cross(s, r >= enter, r <= leave)

    return step


def gap_fade(enter: float = 0.01, leave: float = 0.002, stop: float = 0.01, life: int = 30) -> Step:
    def step(s: State) -> str | None:
        m = s.memory
        new, m["session"] = m.get("session") not in (None, s.session[-1]), s.session[-1]
        if s.position > 0:
            m["age"] += 1
            c = s.close[-1]
            return "sell" if new or c >= m["goal"] * (1 - leave) or c <= m["entry"] * (1 - stop) or m["age"] >= life else None
        if new and len(s.close) > 1 and s.open[-1] / s.close[-2] - 1 <= -enter:
            m.update(goal=s.close[-2], entry=s.close[-1], age=0)
            return "buy"
        return None

    return step


def gated(base: Step, allows: Callable[[State], bool]) -> Step:
    """The base's signals, entries only where allowed; a blocked entry leaves the base's memory as it was."""

    def step(s: State) -> str | None:
        before = dict(s.memory)
        said = base(s)
        if said == "buy" and not allows(s):
            s.memory = before
            return None
        return said

    return step


def trending(n: int = 14, least: float = 25.0) -> Callable[[State], bool]:
    return lambda s: (adx(s, n) or 0.0) >= least


def vol_band(n: int = 20, low: float = 0.0, high: float = float("inf")) -> Callable[[State], bool]:
    def allows(s: State) -> bool:
        if len(s.close) <= n:
            return False
        x = np.array(s.close[-n - 1 :])
        return low <= float((x[1:] / x[:-1] - 1).std()) <= high

    return allows


def not_overextended(n: int = 20, most: float = 0.03) -> Callable[[State], bool]:
    return lambda s: len(s.close) < n or abs(s.close[-1] / np.mean(s.close[-n:]) - 1) <= most


def vote(*voters: Step, least: int = 2, vetoes: tuple = ()) -> Step:
    """Long where enough voters are long on their own account and no veto speaks, out where too few are."""

    def step(s: State) -> str | None:
        own = s.memory.setdefault("voters", [{"position": 0, "memory": {}} for _ in voters])
        for voter, kept in zip(voters, own):
            view = State(s.high, s.low, s.close, s.open, s.volume, s.session, kept["position"], kept["memory"])
            said = voter(view)
            kept["memory"], kept["position"] = view.memory, 1 if said == "buy" else 0 if said == "sell" else kept["position"]
        n = sum(k["position"] for k in own)
        return _cross(s, n >= least and all(v(s) for v in vetoes), n < least)

    return step


REGISTRY: dict[str, Callable[..., Step]] = {
    "donchian": donchian, "opening_range": opening_range, "keltner": keltner, "supertrend": supertrend, "zscore": zscore, "rsi_reversion": rsi_reversion, "rsi_momentum": rsi_momentum, "ema_cross": ema_cross, "macd": macd,
    "atr_breakout": atr_breakout, "bollinger_expansion": bollinger_expansion, "session_vwap": session_vwap, "session_momentum": session_momentum, "gap_fade": gap_fade,
    "donchian_trending": lambda: gated(donchian(), trending()), "ema_cross_calm": lambda: gated(ema_cross(), vol_band(20, 0.0, 0.03)),
    "ensemble": lambda: vote(donchian(), ema_cross(), macd()), "council": lambda: vote(ema_cross(), macd(), rsi_momentum(), vetoes=(not_overextended(),)),
}


def available() -> list[str]:
    return sorted(REGISTRY)


def make(name: str, **options) -> Step:
    if name not in REGISTRY:
        raise ValueError(f"unknown strategy {name!r}")
    return REGISTRY[name](**options)


def signals(bars: DataFrame, strategies: list[str]) -> DataFrame:
    """(symbol, strategy, ts, signal): what each strategy says at each bar; a signal moves its position at once.  One task a symbol and strategy."""
    ts = bars.schema["ts"].dataType.simpleString()
    every = bars.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, act, out = State(), make(key[1]), []
        for bar in rows.sort_values("ts").to_dict("records"):
            state.push(bar)
            said = act(state)
            state.position = 1 if said == "buy" else 0 if said == "sell" else state.position
            out.append((*key, bar["ts"], said))
        return pd.DataFrame(out, columns=["symbol", "strategy", "ts", "signal"])

    return every.groupBy("symbol", "strategy").applyInPandas(one, f"symbol string, strategy string, ts {ts}, signal string")


def simulate(bars: pd.DataFrame, step: Step, start: float = 100_000.0, share: float = 0.95, cost_bps: float = 3.0, next_open: bool = True) -> pd.DataFrame:
    """Equity and trades of one symbol: a signal fills at the next bar's open (or at its own close), and what is held at the end is sold at the last close."""
    state, cash, qty, pending, rows = State(), start, 0.0, None, []
    cost = cost_bps / 1e4
    bars = bars.sort_values("ts")
    last = len(bars) - 1

    def fill(side: str, price: float) -> None:
        nonlocal cash, qty
        if side == "buy" and qty == 0:
            price *= 1 + cost
            qty = share * cash / price
            cash -= qty * price
        elif side == "sell" and qty > 0:
            cash += qty * price * (1 - cost)
            qty = 0.0
        state.position = int(qty > 0)

    for i, bar in enumerate(bars.to_dict("records")):
        done = ""
        if pending and next_open:
            fill(pending, bar["open"])
            done, pending = pending, None
        state.push(bar)
        said = step(state)
        if said and not next_open:
            fill(said, bar["close"])
            done = said
        elif said:
            pending = said
        if i == last and qty > 0:
            fill("sell", bar["close"])
            done = "liquidate"
        rows.append((bar["ts"], done, qty, cash + qty * bar["close"]))
    return pd.DataFrame(rows, columns=["ts", "fill", "qty", "equity"])


def backtest(bars: DataFrame, strategies: list[str], **options) -> DataFrame:
    """(symbol, strategy, ts, fill, qty, equity): one task a symbol and strategy."""
    ts = bars.schema["ts"].dataType.simpleString()
    every = bars.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in strategies])))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = simulate(rows, make(key[1]), **options)
        out.insert(0, "strategy", key[1])
        out.insert(0, "symbol", key[0])
        return out

    return every.groupBy("symbol", "strategy").applyInPandas(one, f"symbol string, strategy string, ts {ts}, fill string, qty double, equity double")


def apply_fill(qty: float, avg: float, side: str, size: float, price: float) -> tuple[float, float, float, float]:
    """(quantity, average, realised, cash) after a fill: opens, adds, reduces, closes or flips."""
    signed = size if side == "buy" else -size
    after = qty + signed
    cash = -signed * price
    if qty == 0 or qty * signed > 0:
        return after, (abs(qty) * avg + size * price) / (abs(qty) + size), 0.0, cash
    closed = min(abs(qty), size)
    realised = closed * (price - avg) * (1 if qty > 0 else -1)
    return after, (0.0 if after == 0 else avg if qty * after > 0 else price), realised, cash


def verify_chain(events: DataFrame) -> DataFrame:
    """Order events whose hash or link does not hold: sha2 of (seq, ts, event, order, prev_hash) joined by '|'."""
    from pyspark.sql import Window

    line = Window.partitionBy("log").orderBy("seq")
    e = events if "log" in events.columns else events.withColumn("log", F.lit(0))
    made = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), F.col("ts").cast("string"), "event", "order", "prev_hash"), 256)
    return e.withColumn("linked", F.coalesce(F.lag("hash").over(line), F.lit(""))).where((made != F.col("hash")) | (F.col("linked") != F.col("prev_hash"))).select("log", "seq")
