"""Structured Streaming: replayed bars, strictly newer bars only, and strategies on live bars."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.operators import folds
from marketloom.sources.tables import SCHEMAS


def replay(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of bar files as a stream."""
    return spark.readStream.schema(SCHEMAS["bars"]).option("maxFilesPerTrigger", files_per_batch).json(path)


def newer(bars: DataFrame) -> DataFrame:
    """Each symbol's bars that are later than all it has seen; late and repeated bars are dropped."""
    columns = [f.name for f in bars.schema.fields]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(frames).sort_values("ts").drop_duplicates("ts", keep="last")
        rows = rows[rows["ts"] > pd.Timestamp(last)] if last is not None else rows
        if len(rows):
            state.update((rows["ts"].iloc[-1].to_pydatetime(),))
        yield rows[columns]

    return bars.groupBy("symbol").applyInPandasWithState(step, bars.schema, "last timestamp", "append", GroupStateTimeout.NoTimeout)


def signals(bars: DataFrame, strategy: str) -> DataFrame:
    """(symbol, ts, close, signal) of a strategy's step function; a signal moves its position at once."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else folds.State()
        act, out = folds.make(strategy), []
        for bar in pd.concat(frames).sort_values("ts").to_dict("records"):
            held.push(bar)
            said = act(held)
            held.position = 1 if said == "buy" else 0 if said == "sell" else held.position
            out.append((key[0], bar["ts"], bar["close"], said))
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=["symbol", "ts", "close", "signal"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, signal string", "held binary", "append", GroupStateTimeout.NoTimeout)
