"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words.  For each of K samples every word has gamma
(2, 1) numbers r and c and a uniform b from hashes of the word and the sample; with
weight w its level is t = floor(ln w / r + b) and its rank ln c - r (t - b) - r.
The word and level of least rank are the sample.  Two texts share a sample with
the probability of their generalised Jaccard similarity, sum of least over sum of
largest weights, so the share of equal samples estimates it (standard error at
most 0.5 / sqrt(K)).  A sample is kept as 16 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import Words, mix, read, slices, text_buffer

SAMPLES = 64
#: Words of a text of mean size that are under the bound, about.
_MARKED = 8
_TEXT_BYTES = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _draws(terms: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """exp(-r), exp(-c) and b of each term in a sample."""
    seed = terms + np.uint64((2 * sample + 1) * int(_STEP) % (1 << 64))
    x, y = mix(seed), mix(seed + _STEP)
    mask = np.uint64((1 << 21) - 1)
    u = ((x & mask) + 0.5) * (((x >> np.uint64(21)) & mask) + 0.5) * 2.0**-42
    v = ((y & np.uint64(0xFFFFFFFF)) + 0.5) * ((y >> np.uint64(32)) + 0.5) * 2.0**-64
    return u, v, x


def _numbers(u: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b from draws."""
    return -np.log(u), np.log(-np.log(v)), ((x >> np.uint64(42)) + 0.5) * 2.0**-22


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of some runs, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def signatures(data: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """A row of 16-bit samples for each text; a text without words has zeros (see `empty` below).

    exp(rank) of weight 1 is exponential, so few words of a text are under a bound that nearly
    every text has a word under.  Only those meet their texts; a text without one is read whole.
    """
    words = Words(data, offsets)
    n = len(offsets) - 1
    out = np.zeros((n, samples), np.uint16)
    if not len(words.starts):
        return out
    terms, of = np.unique(words.hashes(), return_inverse=True)
    doc = np.repeat(np.arange(n), np.diff(words.bounds))
    pairs, weight = np.unique(doc * len(terms) + of, return_counts=True)
    pair_doc, pair_term = pairs // len(terms), pairs % len(terms)
    heads = np.searchsorted(pair_doc, np.arange(n + 1))
    sizes = np.diff(heads)
    full = sizes > 0
    by_term = np.argsort(pair_term, kind="stable")
    doc_of, term_at = pair_doc[by_term], np.searchsorted(pair_term[by_term], np.arange(len(terms) + 1))
    many = by_term[weight[by_term] > 1]
    many_doc, many_term, log_weight = pair_doc[many], pair_term[many], np.log(weight[many])
    many_at = np.searchsorted(many_term, np.arange(len(terms) + 1))
    log_most = np.zeros(len(terms))
    if len(many):
        log_most[np.unique(many_term)] = np.maximum.reduceat(log_weight, np.unique(many_term, return_index=True)[1])
    share = _MARKED * full.sum() / len(pairs)
    bound = np.log(-np.log1p(-share)) if share < 1 else np.inf
    reach = np.exp(bound + log_most) * (1 + 1e-9)

    for k in range(samples):
        rank, term, level = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
        u, v, x = _draws(terms, k)
        near = np.flatnonzero(u * (1 - v) <= reach)  # c is at least 1 - exp(-c)
        r, log_c, b = _numbers(u[near], v[near], x[near])
        alone = log_c + r * (b - 1)  # of weight 1: level 0
        light = np.flatnonzero(alone <= bound)
        light = light[::-1]
        light = light[np.argsort(-alone[light], kind="stable")]  # the last written is the least
        count = term_at[near[light] + 1] - term_at[near[light]]
        at = doc_of[_runs(term_at[near[light]], count)]
        rank[at], term[at] = np.repeat(alone[light], count), np.repeat(near[light], count)
        heavy = np.flatnonzero((log_c - r - log_most[near] <= bound + 1e-9) & (log_most[near] > 0))
        count = many_at[near[heavy] + 1] - many_at[near[heavy]]
        own, pick = _runs(many_at[near[heavy]], count), np.repeat(heavy, count)
        own_level = np.floor(log_weight[own] / r[pick] + b[pick])
        own_rank = log_c[pick] - r[pick] * (own_level - b[pick] + 1)
        less = np.flatnonzero(own_rank < np.minimum(rank[many_doc[own]], bound))
        less = less[np.argsort(-own_rank[less])]
        at = many_doc[own[less]]
        rank[at], term[at], level[at] = own_rank[less], many_term[own[less]], own_level[less]
        rest = np.flatnonzero(full & (rank == np.inf))
        if len(rest):
            whole = _runs(heads[rest], sizes[rest])
            r, log_c, b = _numbers(*_draws(terms[pair_term[whole]], k))
            own_level = np.floor(np.log(weight[whole]) / r + b)
            own_rank = log_c - r * (own_level - b + 1)
            starts = np.cumsum(sizes[rest]) - sizes[rest]
            hit = np.flatnonzero(own_rank == np.repeat(np.minimum.reduceat(own_rank, starts), sizes[rest]))
            hit = hit[np.searchsorted(hit, starts)]
            term[rest], level[rest] = pair_term[whole[hit]], own_level[hit]
        out[full, k] = mix(terms[term[full]] + level[full].astype(np.uint64) * _STEP) >> np.uint64(48)
    return out


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _blank(texts: list[str]) -> np.ndarray:
    return np.array([not t.strip("\x20\x09\x0a\x0b\x0c\x0d") for t in texts], bool)


def likeness(a: np.ndarray, b: np.ndarray, a_blank: np.ndarray, b_blank: np.ndarray) -> np.ndarray:
    """The share of equal samples; texts without words are like each other and like nothing else."""
    return np.where(a_blank | b_blank, (a_blank & b_blank).astype(float), (a == b).mean(axis=1))


def _hex(signature: np.ndarray, blank: np.ndarray) -> list[str]:
    return ["" if empty else row.astype(">u2").tobytes().hex() for row, empty in zip(signature, blank)]


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint): hexadecimal, 4 digits a sample; empty for null texts and texts without words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            made: list[str] = []
            for i, j in slices(offsets, _TEXT_BYTES):
                part = offsets[i : j + 1]
                texts, own = data[part[0] : part[-1]], part - part[0]
                blank = np.diff(Words(texts, own).bounds) == 0
                made += _hex(signatures(texts, own, samples), blank)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fingerprint string")


def _place(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at most the value, searched in two levels."""
    width = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if not rows:
        return F.lit(0)
    block = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda c: c <= value))
    inner = F.element_at(F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows]), F.greatest(block, F.lit(1)))
    return F.greatest(block - 1, F.lit(0)) * width + F.size(F.filter(inner, lambda c: c <= value))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs(doc_id, text) dealt into id ranges: (range, borrowed, doc_id, text), sorted within each partition.

    Ranges are cut at quantiles of the ids; the first row of a range is also lent to
    the range before (that of the first range to the last), so each row finds the
    next document in its own range.  Rows of one id are ordered by a hash of the text;
    null ids come last.  At most `ranges` cuts and first ids reach the driver.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(d.select("doc_id").where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    d = d.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(_place(F.col("doc_id"), [int(c) for c in cuts])).cast("int"))
    heads = sorted((r["range"], r["first"]) for r in d.groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    # the first id of a range -> the filled range before it
    lent = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads) if first is not None]
    out = d.withColumn("borrowed", F.lit(False))
    if lent:
        target = F.element_at(F.create_map(*[x for first, before in lent for x in (F.lit(first), F.lit(before))]), F.col("doc_id"))
        both = F.array(F.struct("range", F.lit(False).alias("borrowed")), F.struct(target.alias("range"), F.lit(True).alias("borrowed")))
        places = F.when(F.col("doc_id").isin([first for first, _ in lent]), both).otherwise(F.slice(both, 1, 1))
        out = d.select("doc_id", "text", F.explode(places).alias("_p")).select("doc_id", "text", "_p.range", "_p.borrowed")
    return out.repartition(len(cuts) + 1, "range").withColumn("_tie", F.xxhash64("text")).sortWithinPartitions("range", "borrowed", F.col("doc_id").asc_nulls_last(), "_tie").select("range", "borrowed", "doc_id", "text")


def edited(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, and those of its text with the second half replaced from the next document.

    Null texts are empty; the only document of a table is its own next one.  Rows of one id
    follow each other by a hash of their texts, null ids come last.  A long text is taken
    whole, in one task; an empty table gives an empty result.  Other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def flush(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        after = [*texts[1:], following]
        changed = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after)]
        n = len(texts)
        sig = signatures(*_buffer([*texts, following, *changed]), samples)
        blank = _blank([*texts, following, *changed])
        own, nxt, new = slice(0, n), slice(1, n + 1), slice(n + 1, None)
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], kind), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(_hex(sig[own], blank[own])), pa.array(_hex(sig[new], blank[new])),
            pa.array(likeness(sig[own], sig[new], blank[own], blank[new])),
            pa.array(likeness(sig[own], sig[nxt], blank[own], blank[nxt]))], names)

    kind = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(stream(batches), key=lambda r: r[0]):
            held, size, end = [], 0, None
            for _, borrowed, doc_id, text in rows:
                if borrowed:
                    end = text if end is None else end
                    continue
                if size >= _TEXT_BYTES:
                    yield flush(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)
            if held:
                yield flush(held, end if end is not None else held[-1][1])

    return with_next(docs, ranges).mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents and of their edited texts; `edited` states the cases."""
    return edited(read(spark, sf_dir, "documents"))
