"""An append-only ledger of order events: a hash chain for each log.

A row's hash covers its number, time, event, order and the hash before it, as canonical
JSON (sorted keys, no spaces).  Appending is an ordered fold for each log that starts
from the stored tail; a task folds its logs one after the other as their sorted rows
stream by, so neither many short logs nor a long one cost more than their rows.
Checking is no fold: every row can be hashed by itself and linked to the row before by a
window.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64
SCHEMA = "log string, seq long, ts double, event string, order string, prev_hash string, hash string"
# fixed values: the kinds of events
EVENTS = ("SIGNAL", "SUBMIT", "ACK", "PARTIAL_FILL", "FILL", "CANCEL", "REJECT", "RISK_BLOCK", "EXPIRE", "REPLACE", "TRIGGER")


_ENCODER = json.JSONEncoder(sort_keys=True, separators=(",", ":"), default=str)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; what JSON does not know is written as text."""
    return _ENCODER.encode(value)


def chained(seq: int, ts: float, event: str, order: str, before: str) -> str:
    """The hash of a row; `order` is canonical JSON text."""
    text = f'{{"event":{canonical(event)},"order":{order},"prev_hash":{canonical(before)},"seq":{seq},"ts":{repr(ts) if math.isfinite(ts) else canonical(ts)}}}'
    return hashlib.sha256(text.encode()).hexdigest()


def tails(ledger: DataFrame) -> DataFrame:
    """(log, seq, hash): the last row of each log."""
    return ledger.groupBy("log").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"))


def append(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The rows that events(log, ts, event, order, *tie) add to a ledger, in order of ts and then of the other columns.

    `order` is JSON text and is stored canonical.  Numbers go on from the stored tail, a
    new log starts at 0 after 64 zeros.  Kinds of events that are not known are refused.
    """
    tie = [c for c in events.columns if c not in ("log", "ts", "event", "order")]
    ts = F.col("ts").cast("double")
    known = F.when(F.col("event").isin(*EVENTS), F.col("event")).otherwise(F.raise_error(F.concat(F.lit("unknown event "), F.coalesce("event", F.lit("null")))))
    rows = events.select(F.col("log").cast("string").alias("log"), F.when(~F.isnan(ts), ts).alias("ts"), known.alias("event"), "order", *tie, F.lit(False).alias("_held"), F.lit(0).cast("long").alias("_seq"), F.lit(None).cast("string").alias("_hash"))
    if ledger is not None:  # a log's tail stands before its events
        tail = tails(ledger).select(F.col("log").cast("string").alias("log"), F.lit(True).alias("_held"), F.col("seq").cast("long").alias("_seq"), F.col("hash").alias("_hash"))
        rows = rows.unionByName(tail, allowMissingColumns=True)
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]) for n, kind in (f.split() for f in SCHEMA.split(", "))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, seq, last = (), -1, GENESIS  # no log yet, which a log that is null is not
        for batch in batches:
            out = []
            for key, ts, event, order, held, at, tail in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns]):
                if key != log:
                    log, seq, last = key, -1, GENESIS
                if held:
                    seq, last = int(at), tail
                    continue
                order, seq = canonical(json.loads(order)), seq + 1
                made = chained(seq, ts, event, order, last)
                out.append((key, seq, ts, event, order, last, made))
                last = made
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(list(zip(*out)) or [[]] * len(schema), schema)], schema=schema)

    line = [F.col(c).asc_nulls_last() for c in ("ts", *tie, "event", "order")]
    placed = rows.repartition("log").sortWithinPartitions("log", F.desc("_held"), *line)
    return placed.select("log", "ts", "event", "order", "_held", "_seq", "_hash").mapInArrow(fold, SCHEMA)


def verify(ledger: DataFrame) -> DataFrame:
    """(log, total, ok, broken_at_seq): whether each log's chain holds, and the first row at which it does not."""
    line = Window.partitionBy("log").orderBy("seq")
    linked = ledger.withColumn("before", F.coalesce(F.lag("hash").over(line), F.lit(GENESIS))).select("log", "seq", "ts", "event", "order", "prev_hash", "hash", "before")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = zip(*[f[c].tolist() for c in ("seq", "ts", "event", "order", "prev_hash", "hash", "before")])
            good = [prev == before and chained(int(seq), float(ts), event, canonical(json.loads(order)), before) == made for seq, ts, event, order, prev, made, before in rows]
            yield pd.DataFrame({"log": f["log"], "seq": f["seq"], "good": good})

    judged = linked.mapInPandas(check, "log string, seq long, good boolean")
    g = judged.groupBy("log").agg(F.count("*").alias("total"), F.min(F.when(~F.col("good"), F.col("seq"))).alias("broken_at_seq"))
    return g.select("log", "total", F.col("broken_at_seq").isNull().alias("ok"), "broken_at_seq")
