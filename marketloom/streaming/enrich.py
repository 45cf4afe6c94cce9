"""Streams joined with streams: the quote as of each bar."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_QUOTE = ("bid", "ask", "bid_size", "ask_size")


def enriched(bars: DataFrame, quotes: DataFrame, delay: str = "10 seconds", most_seconds: float | None = None) -> DataFrame:
    """Each bar of a stream with the last quote at or before its time: bars' columns, the quote's sides and sizes, and quote_ts.

    Both streams have symbol and ts.  A bar comes out once the watermark (the least of both
    streams' latest times, less `delay`) has reached its time: no earlier quote can follow
    then.  Rows at or before the watermark are late and dropped, bars and quotes alike; of quotes of one
    time the last that arrives counts; repeated bars each come out; null times are dropped.
    Without a quote, or with one more than `most_seconds` older than the bar, its columns are
    null and the bar comes out all the same.  A symbol's state holds the quotes and bars
    within the delay, and one quote before.
    """
    own = [f for f in bars.schema.fields if f.name not in ("symbol", "ts")]
    b = bars.where("ts IS NOT NULL").withWatermark("ts", delay).select("symbol", "ts", F.lit(1).alias("_side"), F.struct(*([f.name for f in own] or [F.lit(1).alias("_none")])).alias("_bar"), *[F.lit(None).cast("double").alias(c) for c in _QUOTE])
    q = quotes.where("ts IS NOT NULL").withWatermark("ts", delay).select("symbol", "ts", F.lit(0).alias("_side"), F.lit(None).cast(b.schema["_bar"].dataType).alias("_bar"), *[F.col(c).cast("double") for c in _QUOTE])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    names = [f.name for f in own]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known, waiting = state.get if state.exists else (None, [], [])
        known, waiting = [tuple(x) for x in known], [tuple(x) for x in waiting]
        reached = state.getCurrentWatermarkMs() * 1_000_000
        for frame in frames:
            for r in frame.itertuples(index=False):
                at = int(r.ts.value)
                if at <= reached:  # bars of that time are out
                    continue
                if r[2] == 0:
                    known.append((at, *[None if pd.isna(v) else float(v) for v in r[4:8]]))
                else:
                    waiting.append((at, _packed(r[3], names)))
        known.sort(key=lambda x: x[0])  # stable: of one time the later arrival stays last
        ripe = sorted((x for x in waiting if x[0] <= reached), key=lambda x: x[0])
        waiting = [x for x in waiting if x[0] > reached]
        out, i = [], 0
        for at, packed in ripe:
            while i < len(known) and known[i][0] <= at:
                last, i = known[i], i + 1
            fresh = last is not None and (most_seconds is None or at - last[0] <= most_seconds * 1e9)
            quote = (*last[1:], pd.Timestamp(last[0])) if fresh else (None,) * len(_QUOTE) + (None,)
            out.append((key[0], pd.Timestamp(at), *_unpacked(packed, names), *quote))
        while i < len(known) and known[i][0] <= reached:
            last, i = known[i], i + 1
        state.update((last, known[i:], waiting))
        if waiting:
            state.setTimeoutTimestamp(max(min(x[0] for x in waiting) // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["symbol", "ts", *names, *_QUOTE, "quote_ts"])

    schema = f"symbol string, ts timestamp{', ' if fields else ''}{fields}, {', '.join(f'{c} double' for c in _QUOTE)}, quote_ts timestamp"
    quote = "struct<at:bigint,bid:double,ask:double,bid_size:double,ask_size:double>"
    held = f"last {quote}, known array<{quote}>, waiting array<struct<at:bigint,bar:string>>"
    return b.unionByName(q).groupBy("symbol").applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.EventTimeTimeout)


def _packed(bar, names: list[str]) -> str:
    import json

    return json.dumps([bar[n] for n in names], default=str) if names else ""


def _unpacked(packed: str, names: list[str]) -> list:
    import json

    return json.loads(packed) if names else []
