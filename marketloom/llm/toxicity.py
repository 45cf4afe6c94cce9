"""Toxicity by class-conditional Kneser-Ney models.

A text is its letters, lower-cased, and one space for each run of anything else.  An
expression is ORDER consecutive characters, across words too: a character x behind its
history h.  Each class gives x its own absolutely discounted share of what followed h
in that class, and what the discount leaves to the shorter history h':

    P_c(x | h) = max(n_c(hx) - D, 0) / n_c(h) + D N_c(h) / n_c(h) P_c(x | h')

with N_c(h) the number of different characters behind h in the class (P_c(x | h') alone
where the class has no h).  n_c are the class's occurrences at ORDER, and below it
its continuation counts: in how many different (n + 1)-grams of the class an n-gram ends.
Below SHARED + 1 characters both classes share one distribution, of the continuation
counts of either class, discounted in the same way down to a uniform distribution.  So
a rare expression that only one class has is weighed by what is left to it, and where
neither class has evidence both give the same.

A text's score is a logistic function of the difference of its log-likelihoods (toxic
minus ordinary), normalised by length and by its square root, and of the logarithm of
its strong expressions' excess.  Every labelled document outside the held-out fold is
counted, and every counted expression is kept; counts, continuation counts and
probabilities are tables that Spark groups and joins.  Only the four numbers of the
logistic function are fitted on a bounded sample, scored without its own counts.

The table of differences is broadcast if its rows, which are counted first, are at most
BROADCAST_ROWS (12 bytes each); beyond that each block of documents is joined with the
rows of its own expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Shared, crc_remainder, read, sized, slices, text_buffer, trim

ORDER, SHARED, BITS = 6, 3, 9
DISCOUNT = 0.75
STRONG = 2.5
#: The logistic function is fitted on about so many documents at most, and on a quarter of the labelled ones at most.
CALIBRATION_DOCS, CALIBRATION_SHARE = 20_000, 0.25
FOLDS, HELD_OUT = 5, 0
BROADCAST_ROWS = 1 << 24
#: Bytes of text in a block of the joined way.
BLOCK_BYTES = 8 << 20
_SLICE = 512 << 10

_points = np.arange(1 << 16, dtype=np.uint32)
#: Symbols of the first 65,536 code points: space 1, letters a to z from 2, all else by a hash from 32 on; 0 stands before a text.
_SYMBOLS = (32 + (_points * np.uint32(2654435761) >> np.uint32(12)) % np.uint32((1 << BITS) - 32)).astype(np.int64)
_SYMBOLS[97:123] = np.arange(2, 28)
_SYMBOLS[32] = 1


def letters(text: Column) -> Column:
    """Lower-case letters and single spaces, one at either end."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[^\p{L}\p{M}]+", " ")


def expressions(column: pa.Array, order: int = ORDER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, expressions, bounds) for slices of texts made by `letters`: an expression ends at each character."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets, _SLICE):
        raw = data[offsets[i] : offsets[j]]
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = before[offsets[i : j + 1] - offsets[i]]
        own = _SYMBOLS[points & np.uint32(0xFFFF)]
        at = np.arange(len(own)) + np.repeat(np.arange(1, j - i + 1), np.diff(bounds)) * (order - 1)
        line = np.zeros(len(own) + (j - i + 1) * (order - 1), np.int64)
        line[at] = own
        gram = own
        for k in range(1, order):
            gram = gram | line[at - k] << np.int64(BITS * k)
        yield i, j, gram, bounds
    trim()


def _count(order: int):
    """(text, toxic, sampled) -> (gram, kind, n): kind 0 and 1 ordinary and toxic, 2 and 3 those of sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) + 2 * batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, gram, bounds in expressions(batch.column(0), order):
                grams, n = np.unique(gram << np.int64(2) | np.repeat(kind[i:j], np.diff(bounds)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams >> np.int64(2)), pa.array((grams & 3).astype(np.int32)), pa.array(n)], ["gram", "kind", "n"])

    return run


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def _history() -> Column:
    return F.shiftright("gram", BITS)


def shared_backoff(grams: DataFrame, order: int, discount: float, shared: Shared) -> DataFrame:
    """(gram, p): the shared probability of the last character of each gram of order - 1, from the distinct grams of the order."""
    counts = {}
    for n in range(order - 1, 0, -1):
        grams = shared.put(grams.groupBy(_suffix(n + 1).alias("gram")).agg(F.count("*").alias("c")), f"continuations{n}")
        counts[n] = grams
    p = None
    for n in range(1, order):
        behind = Window.partitionBy(_history())
        d = counts[n].select("gram", "c", F.sum("c").over(behind).alias("total"), F.count("*").over(behind).alias("kinds"))
        if p is None:
            d = d.withColumn("lower", F.lit(1.0 / (1 << BITS)))
        else:
            d = d.join(p.select(F.col("gram").alias("_s"), F.col("p").alias("lower")), _suffix(n) == F.col("_s"))
        p = d.select("gram", ((F.greatest(F.col("c") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("lower")) / F.col("total")).alias("p"))
        p = shared.put(p, f"backoff{n}")
    return p


_KINDS = ("o", "t", "o_w", "t_w")  # ordinary and toxic, and both without the sampled documents


def key(gram, order: int, history: bool = False):
    """The key of a gram of the order, or of the history of one."""
    return gram * 16 + (2 * order + history)


def differences(counts: DataFrame, order: int = ORDER, below: int = SHARED, discount: float = DISCOUNT, shared: Shared | None = None) -> DataFrame:
    """(key, value, without): log P_toxic - log P_ordinary, from counts(gram, ordinary, toxic, ordinary_s, toxic_s).

    A gram of an order has its own row; a history's row has what is added to the value of
    the next lower order where neither class has the character behind it.  `without`
    leaves the sampled counts out; the shared backoff is the same.
    """
    shared = shared or Shared(counts.sparkSession)
    top = [F.col("ordinary"), F.col("toxic"), F.col("ordinary") - F.col("ordinary_s"), F.col("toxic") - F.col("toxic_s")]
    levels = {order: shared.put(counts.select("gram", *[c.alias(k) for c, k in zip(top, _KINDS)]), f"counts{order}")}
    for n in range(order - 1, below, -1):
        ends = levels[n + 1].groupBy(_suffix(n + 1).alias("gram")).agg(*[F.sum((F.col(k) > 0).cast("int")).alias(k) for k in _KINDS])
        levels[n] = shared.put(ends, f"counts{n}")
    lower = shared_backoff(levels[below + 1].select("gram"), below + 1, discount, shared).select(F.col("gram").alias("_s"), *[F.col("p").alias(f"{k}_p") for k in _KINDS])
    behind, out = Window.partitionBy(_history()), None

    def left(k: str) -> Column:
        return F.when(F.col(f"{k}_all") > 0, discount * F.col(f"{k}_kinds") / F.col(f"{k}_all")).otherwise(F.lit(1.0))

    def of(k: str) -> Column:
        own = F.when(F.col(f"{k}_all") > 0, F.greatest(F.col(k) - discount, F.lit(0.0)) / F.col(f"{k}_all")).otherwise(F.lit(0.0))
        return own + left(k) * F.col(f"{k}_p")

    for n in range(below + 1, order + 1):
        d = levels[n].select("*", *[F.sum(k).over(behind).alias(f"{k}_all") for k in _KINDS], *[F.sum((F.col(k) > 0).cast("int")).over(behind).alias(f"{k}_kinds") for k in _KINDS])
        d = shared.put(d.join(lower, _suffix(n) == F.col("_s")).select("gram", *[of(k).alias(f"{k}_p") for k in _KINDS], *[left(k).alias(f"{k}_left") for k in _KINDS]), f"probabilities{n}")
        lower = d.select(F.col("gram").alias("_s"), *[f"{k}_p" for k in _KINDS])
        ratio = lambda a, b, what: F.log(F.col(f"{a}_{what}") / F.col(f"{b}_{what}"))
        seen = d.select(key(F.col("gram"), n).alias("key"), ratio("t", "o", "p").alias("value"), ratio("t_w", "o_w", "p").alias("without"))
        miss = d.groupBy(key(_history(), n, True).alias("key")).agg(F.first(ratio("t", "o", "left")).alias("value"), F.first(ratio("t_w", "o_w", "left")).alias("without"))
        out = seen.unionByName(miss) if out is None else out.unionByName(seen).unionByName(miss)
    return shared.put(out, "differences")


@dataclass
class Values:
    """Sorted keys and their differences."""

    keys: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(table: pa.Table, column: str) -> "Values":
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        return Values(keys[order], table.column(column).to_numpy()[order].astype(np.float32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the values (0 for others)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, np.where(known, self.value[at], 0.0).astype(np.float64)

    def of_grams(self, grams: np.ndarray, order: int, below: int) -> np.ndarray:
        """The difference of each gram: its own, or its history's on top of the next lower order's."""
        gains, rest = np.zeros(len(grams)), np.arange(len(grams))
        for n in range(order, below, -1):
            known, value = self.find(key(grams[rest], n))
            gains[rest[known]] += value[known]
            rest = rest[~known]
            gains[rest] += self.find(key(grams[rest] >> BITS, n, True))[1]
            grams = grams & np.int64((1 << BITS * (n - 1)) - 1)
        return gains

    def features(self, gram: np.ndarray, bounds: np.ndarray, order: int = ORDER, below: int = SHARED) -> np.ndarray:
        """A row for each text; zeros for a text without letters."""
        grams, of = np.unique(gram, return_inverse=True)
        gains = self.of_grams(grams, order, below)
        gain = gains[of]
        n = np.diff(bounds)
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        strong = np.concatenate([[0.0], np.cumsum(np.maximum(gain - STRONG, 0))])
        a, b = bounds[:-1], bounds[1:]
        total = np.where(n > 1, sums[b] - sums[a], 0.0)  # one space only: no letters
        excess = np.where(n > 1, np.maximum(strong[b] - strong[a], 0), 0.0)
        n = np.maximum(n, 1)
        return np.column_stack([total / n, total / np.sqrt(n), np.log1p(excess)])


def calibrate(features: np.ndarray, labels: np.ndarray, steps: int = 80, ridge: float = 1e-3) -> tuple:
    """Logistic regression by Newton's method; a constant without both labels."""
    if len(labels) == 0 or labels.min() == labels.max():
        return (4.0 if len(labels) and labels[0] else -4.0, 0.0, 0.0, 0.0)
    x = np.column_stack([np.ones(len(features)), features])
    w, free = np.zeros(x.shape[1]), np.array([0.0, *[1.0] * features.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - labels) / len(labels) + ridge * w * free
        h = (x * (p * (1 - p))[:, None]).T @ x / len(labels) + ridge * np.diag(free) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def labelled(docs: DataFrame, labels: DataFrame, calibration_docs: int) -> DataFrame:
    """(text, toxic, sampled) of the labelled documents outside the held-out fold; a document with both labels is toxic."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marks = marks.where(crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    share = min(CALIBRATION_SHARE, calibration_docs / max(1, marks.count()))
    marks = marks.withColumn("sampled", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20)).cast("int"))
    return docs.select("doc_id", "text").join(sized(marks), "doc_id").select(letters(F.col("text")).alias("text"), "toxic", "sampled")


@dataclass
class Model:
    table: DataFrame  # key, value, without
    calibration: tuple
    order: int


def _featured(texts: DataFrame, table: DataFrame, column: str, order: int, shared: Shared) -> DataFrame:
    """The columns of texts(text, ...) but the text, with features a, b and c."""
    rest = [c for c in texts.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(rest).schema.fields) + ", a double, b double, c double"
    names = [*rest, "a", "b", "c"]

    def rows(batch, values: Values) -> Iterator[pa.RecordBatch]:
        for i, j, gram, bounds in expressions(batch.column(0), order):
            x = values.features(gram, bounds, order)
            yield pa.RecordBatch.from_arrays([*[batch.column(1 + k).slice(i, j - i) for k in range(len(rest))], *[pa.array(x[:, k]) for k in range(3)]], names)

    if table.count() <= BROADCAST_ROWS:
        known = texts.sparkSession.sparkContext.broadcast(Values.of(table.select("key", F.col(column).cast("float").alias(column)).toArrow(), column))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from rows(batch, known.value)

        return texts.select("text", *rest).mapInArrow(run, fields)

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = shared.put(texts.select(F.pmod(F.xxhash64("text", *rest), F.lit(blocks)).alias("_block"), "text", *rest), "dealt")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy()
            for i, j, gram, bounds in expressions(batch.column(1), order):
                block = np.repeat(of[i:j], np.diff(bounds))
                for b in np.unique(of[i:j]):
                    own = np.unique(gram[block == b])
                    keys = np.concatenate([key(own & np.int64((1 << BITS * n) - 1) >> BITS * h, n, bool(h)) for n in range(SHARED + 1, order + 1) for h in (0, 1)])
                    keys = np.unique(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), b)), pa.array(keys)], ["_block", "key"])

    asked = dealt.select("_block", "text").repartition("_block").mapInArrow(distinct, "_block long, key long").distinct()
    held = asked.join(table.select("key", F.col(column).alias("value")), "key").select("_block", "key", "value")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        values = Values.of(right, "value")
        made = [r for batch in left.drop_columns(["_block"]).to_batches() for r in rows(batch, values)]
        schema = pa.schema([*[left.schema.field(c) for c in rest], *[pa.field(c, pa.float64()) for c in "abc"]])
        return pa.Table.from_batches(made, schema) if made else schema.empty_table()

    return dealt.select("_block", "text", *rest).groupBy("_block").cogroup(held.groupBy("_block")).applyInArrow(meet, fields)


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, calibration_docs: int = CALIBRATION_DOCS, shared: Shared | None = None) -> Model:
    """The model of all labelled documents outside the held-out fold (see the module's docstring)."""
    shared = shared or Shared(docs.sparkSession)
    rows = labelled(docs, labels, calibration_docs)
    counted = rows.mapInArrow(_count(order), "gram long, kind int, n long")
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    counts = counted.groupBy("gram").agg(of(0, 2).alias("ordinary"), of(1, 3).alias("toxic"), of(2).alias("ordinary_s"), of(3).alias("toxic_s"))
    table = differences(counts, order, shared=shared)
    sample = rows.where("sampled = 1").select("text", "toxic")
    seen = _featured(sample, table, "without", order, shared).orderBy("a", "b", "c", "toxic").toPandas()
    return Model(table, calibrate(seen[["a", "b", "c"]].to_numpy(float), seen["toxic"].to_numpy(float)), order)


def score(docs: DataFrame, model: Model, shared: Shared | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Null and empty texts, and texts without letters, score as texts without evidence;
    repeated rows each give a row; long texts are scored whole; an empty table gives an
    empty result.  Other columns are not looked at.
    """
    held = F.coalesce(crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    texts = docs.select("doc_id", held, letters(F.col("text")).alias("text"))
    found = _featured(texts, model.table, "value", model.order, shared or Shared(docs.sparkSession))
    w = model.calibration
    z = F.lit(w[0]) + F.col("a") * w[1] + F.col("b") * w[2] + F.col("c") * w[3]
    s = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return found.select("doc_id", "held_out", s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels outside the held-out fold; `score` states the cases."""
    docs, shared = read(spark, sf_dir, "documents"), Shared(spark)
    return score(docs, fit(docs, read(spark, sf_dir, "labels"), shared=shared), shared)
