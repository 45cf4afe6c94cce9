"""Alignment: panels, calendars, as-of and step joins, interval sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import windows as w
from marketloom.plans.rel import Rel


def dense(bars: Rel) -> Rel:
    """All symbols on the union calendar; `own` is the return against the symbol's previous bar, `ret` against the previous calendar row."""
    own = bars.with_(own=f"close / lag(close) {w.SERIES} - 1.0", number=f"row_number() {w.SERIES}")
    grid = bars.select("ts").distinct().join(bars.select("symbol").distinct(), "1 = 1", hint=True)
    full = grid.join(own, "symbol, ts", "left").with_(vwap="(high + low + close) / 3.0")
    return full.with_(ret=f"close / lag(close) {w.SERIES} - 1.0", row=f"row_number() {w.SERIES}")


def common(bars: Rel, least: int = 0) -> Rel:
    """Returns on the calendar that all symbols share: last row of a time, positive closes, at least so many raw bars."""
    long = bars.with_(bars=f"count(*) OVER (PARTITION BY symbol)").where(f"bars >= {least}")
    kept = long.where("close > 0")
    n = kept.group("ts", here="count(DISTINCT symbol)").join(kept.group(symbols="count(DISTINCT symbol)"), "1 = 1", hint=True).where("here = symbols AND symbols >= 2").select("ts")
    return kept.join(n, "ts").with_(ret=f"close / lag(close) {w.SERIES} - 1.0").where("ret IS NOT NULL").select("symbol", "ts", "close", "ret")


def shared_calendar(bars: Rel) -> Rel:
    """Closes on the times that every symbol has, with the return against the row before (null on the first)."""
    per_time = bars.group("ts", here="count(DISTINCT symbol)").join(bars.group(symbols="count(DISTINCT symbol)"), "1 = 1", hint=True).where("here = symbols").select("ts")
    return bars.join(per_time, "ts").select("symbol", "ts", "close", ret=f"close / nullif(lag(close) {w.SERIES}, 0.0) - 1.0", row=f"row_number() {w.SERIES}")


def market(panel: Rel) -> Rel:
    """The equal-weight return of each time, missing returns left out."""
    return panel.group("ts", bench="coalesce(avg(ret), 0.0)")


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: list[str], right_on: str | None = None, most: float | None = None) -> DataFrame:
    """For each left row the last right row at or before it (at most `most` seconds older, if given).

    Both sides are stacked and scanned once in time order: one shuffle by key, no range
    join.  On equal times right rows come first.  Unmatched left rows have nulls.
    """
    right_on = right_on or on
    extra = [c for c in left.columns if c not in keys and c != on]
    a = left.select(*keys, F.col(on).alias("_at"), F.lit(1).alias("_side"), F.struct(*(extra or [F.lit(1).alias("_none")])).alias("_row"), F.lit(None).cast(right.select(F.struct(F.col(right_on).alias("_from"), *value).alias("s")).schema["s"].dataType).alias("_hit"))
    b = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(F.col(right_on).alias("_from"), *value).alias("_hit"))
    line = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b).withColumn("_hit", F.last("_hit", ignorenulls=True).over(line)).where("_side = 1")
    if most is not None:
        fresh = F.col("_at").cast("double") - F.col("_hit._from").cast("double") <= most
        got = got.withColumn("_hit", F.when(fresh, F.col("_hit")))
    return got.select(*keys, F.col("_at").alias(on), *[F.col(f"_row.{c}").alias(c) for c in extra], *[F.col(f"_hit.{v}").alias(v) for v in value], F.col("_hit._from").alias("matched_at"))


def step(calendar: Rel, facts: Rel, value: str, nulls: bool = False) -> Rel:
    """For each (symbol, ts) of the calendar the value of the greatest fy_end among facts filed by then.

    Null values do not overwrite, unless `nulls`.  Facts and calendar are stacked and
    scanned once in time order: one shuffle by symbol, no range join.
    """
    known = facts if nulls else facts.where(f"{value} IS NOT NULL")
    told = known.where("fy_end IS NOT NULL AND filed IS NOT NULL").select("symbol", stamp="filed", side="0", fy_end="fy_end", v=f"CAST(coalesce({value}, -1e300) AS DOUBLE)")
    stack = calendar.select("symbol", stamp="ts", side="1", fy_end="CAST(NULL AS DATE)", v="CAST(NULL AS DOUBLE)").union(told)
    met = stack.with_(so_far="max_by(v, fy_end) OVER (PARTITION BY symbol ORDER BY stamp, side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").where("side = 1")
    hit = met.select("symbol", "so_far", ts="stamp").group("symbol", "ts", value="nullif(max(so_far), -1e300)")
    return calendar.join(hit, "symbol, ts", "left")


def interval_sum(calendar: Rel, facts: Rel, amount: str, at: str) -> Rel:
    """The sum of amounts dated in (previous row, this row] of the symbol; nothing on its first row.

    Each fact finds the first row at or past its date in one scan of both, stacked: one shuffle by symbol.
    """
    span = calendar.with_(previous=f"lag(ts) {w.SERIES}")
    told = facts.where(f"{at} IS NOT NULL").select("symbol", stamp=at, side="0", v=f"CAST({amount} AS DOUBLE)")
    stack = calendar.select("symbol", stamp="ts", side="1", v="CAST(NULL AS DOUBLE)").union(told).with_(place="CASE WHEN side = 1 THEN stamp END")
    met = stack.with_(ts="min(place) OVER (PARTITION BY symbol ORDER BY stamp DESC, side DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").where("side = 0 AND ts IS NOT NULL")
    joined = span.join(met.group("symbol", "ts", owed="sum(v)"), "symbol, ts", "left").with_(amount="CASE WHEN previous IS NOT NULL THEN owed END")
    return joined.with_(credited="coalesce(amount, 0.0)")


def nearest(left: Rel, right: Rel, value: str, at: str, tolerance: int) -> Rel:
    """The value of the right row nearest in days, within the tolerance; ties to the earlier.

    Both sides are stacked and scanned in either direction: one shuffle by symbol, no range join.
    """
    told = right.where(f"{at} IS NOT NULL").select("symbol", stamp=at, side="0", v=f"coalesce(CAST({value} AS DOUBLE), -1e300)")
    stack = left.select("symbol", stamp="ts", side="1", v="CAST(NULL AS DOUBLE)").union(told).with_(told_at="CASE WHEN side = 0 THEN stamp END")
    back, ahead = (f"OVER (PARTITION BY symbol ORDER BY stamp{d}, side{d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for d in ("", " DESC"))
    met = stack.with_(p_at=f"@last(told_at) {back}", p_v=f"@last(v) {back}", n_at=f"@last(told_at) {ahead}", n_v=f"@last(v) {ahead}").where("side = 1")
    met = met.with_(p_gap="@days(stamp, p_at)", n_gap="@days(n_at, stamp)").with_(behind="n_gap IS NULL OR p_gap <= n_gap")
    near = met.select("symbol", ts="stamp", near_at="CASE WHEN behind THEN p_at ELSE n_at END", v="CASE WHEN behind THEN p_v ELSE n_v END", gap="CASE WHEN behind THEN p_gap ELSE n_gap END")
    return near.where(f"gap <= {tolerance}").group("symbol", "ts", near_at="max(near_at)", value="nullif(max(v), -1e300)")


def tail(rel: Rel, key: str = "symbol") -> Rel:
    """Rows at the end that all series have: `place` counts back from 1, cut at the shortest series."""
    back = rel.with_(place=f"row_number() OVER (PARTITION BY {key} ORDER BY ts DESC)")
    least = back.group(key, n="max(place)").group(shortest="min(n)")
    return back.join(least, "1 = 1", hint=True).where("place <= shortest")
