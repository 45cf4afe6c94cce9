"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, rotated by their principal axes and by rotations that
iterative quantisation learns on a bounded sample, and cut to one bit an axis.  A
code is split into byte substrings, each indexed by its value.  Pigeonhole: with m
substrings and a radius r = m k + a, a code within r agrees with the query to k bits
in one of the first a + 1 substrings, or to k - 1 bits in one of the others.  So
probing all values that near in every table retrieves every code within the radius;
no bucket is capped and no table is passed over.  The codes within the radius are
ranked by their exact inner product.

The radius covers COVER of the true neighbours of PROBED queries, which are found by
brute force over the whole table (so many queries only, whatever its size).  Queries
whose radius holds fewer than k codes are asked again with a larger one, up to the
whole code, which holds all.

For the largest inner product, vectors get one more component sqrt(M^2 - |x|^2), M
the largest norm, queries a zero: nearness by angle is then nearness by product.

Equal vectors are one entry with the list of their ids; a search only ever needs
its `k + 1` smallest ids.  Blocks of queries meet blocks of entries, each block of
entries with tables of its own, and hand on each query's k + 1 best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Shared, read

#: The rotations are learned on about so many vectors at most, chosen by a hash of the vector.
SAMPLE = 20_000
#: Rotations that are learned, each from a start of its own; a code has all their bits.
ROTATIONS = 4
COVER, PROBED = 0.97, 200
#: Queries and entries of a block at most, about.
BLOCK_QUERIES, BLOCK_ENTRIES = 32_768, 32_768
_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8))
#: Distances that are computed together.
_PAIRS = 1 << 16


@dataclass
class Coder:
    """Codes from vectors: signs along rotated axes, as bytes."""

    mean: np.ndarray
    rotation: np.ndarray
    largest: float

    def codes(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if queries else np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        y = (np.column_stack([x, rest]) - self.mean) @ self.rotation
        return np.packbits(y > 0, axis=1, bitorder="little")

    @property
    def substrings(self) -> int:
        return self.rotation.shape[1] // 8


def learn(x: np.ndarray, largest: float, steps: int = 20, seed: int = 5) -> Coder:
    """Principal axes and iteratively quantised rotations; axes are padded to whole bytes."""
    full = np.column_stack([x, np.sqrt(np.maximum(largest**2 - (x * x).sum(1), 0))]) if len(x) else np.zeros((0, x.shape[1] + 1))
    d = full.shape[1]
    width = -(-d // 8) * 8
    mean = full.mean(0) if len(full) else np.zeros(d)
    rng = np.random.Generator(np.random.PCG64(seed))
    axes = np.linalg.eigh(np.cov(full.T).reshape(d, d))[1] if len(full) > 1 else np.eye(d)
    v = (full - mean) @ axes[:, ::-1]
    v = np.hstack([v, np.zeros((len(v), width - d))])
    made = []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.normal(size=(width, width)))[0]
        for _ in range(steps if len(full) > 1 else 0):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        made.append(axes[:, ::-1] @ r[:d])
    return Coder(mean, np.hstack(made), largest)


def reaches(substrings: int, radius: int) -> list[int]:
    """How many bits each substring's probes may differ, by the pigeonhole rule (-1: not probed)."""
    k, a = divmod(radius, substrings)
    return [min(8, k if s <= a else k - 1) for s in range(substrings)]


def words64(codes: np.ndarray) -> np.ndarray:
    """Codes as whole 64-bit words."""
    pad = -codes.shape[1] % 8
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, pad)))).view(np.uint64)


class Tables:
    """One block of entries: for each substring, the entries sorted by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.words = codes, words64(codes)
        self.order = [np.argsort(codes[:, s], kind="stable").astype(np.int32) for s in range(codes.shape[1])]
        self.heads = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, entry) of all codes within the radius; a pair comes once, from the first substring that finds it.

        Queries with one value of a substring probe together.
        """
        asked = words64(queries)
        reach = reaches(queries.shape[1], radius)
        for s, k in enumerate(reach):
            if k < 0:
                continue
            order = np.argsort(queries[:, s], kind="stable")
            values, first = np.unique(queries[order, s], return_index=True)
            for value, group in zip(values, np.split(order, first[1:])):
                near = np.flatnonzero(_BITS[np.arange(256, dtype=np.uint8) ^ value] <= k)
                found = np.concatenate([self.order[s][self.heads[s][x] : self.heads[s][x + 1]] for x in near])
                if not len(found):
                    continue
                held = self.words[found]
                for a in range(0, len(group), max(1, _PAIRS // len(found))):
                    part = group[a : a + max(1, _PAIRS // len(found))]
                    distance = np.zeros((len(part), len(found)), np.uint16)
                    for w in range(held.shape[1]):
                        distance += np.bitwise_count(asked[part, w][:, None] ^ held[None, :, w])
                    q, e = np.nonzero(distance <= radius)
                    q, e = part[q], found[e]
                    fresh = np.ones(len(q), bool)
                    for t in range(s):  # an earlier substring has found it
                        if reach[t] >= 0:
                            fresh &= _BITS[queries[q, t] ^ self.codes[e, t]] > reach[t]
                    yield q[fresh], e[fresh]


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors as doubles, without null, empty, zero, null-holding or non-finite ones."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & fine)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component in order."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * q[..., i]
    return out


def nearest_scores(entries: DataFrame, asked: np.ndarray, dim: int, k: int) -> np.ndarray:
    """By brute force, a row of the k best entry keys (or -1) for each of a few given vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(asked), k), -np.inf)
        keys = np.full((len(asked), k), -1, np.int64)
        for batch in batches:
            s = np.hstack([best, asked @ _matrix(batch.column(1), dim).T])
            own = np.hstack([keys, np.broadcast_to(batch.column(0).to_numpy(), (len(asked), batch.num_rows))])
            at = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best, keys = np.take_along_axis(s, at, 1), np.take_along_axis(own, at, 1)
        q = np.repeat(np.arange(len(asked)), k)
        there = keys.ravel() >= 0
        yield pa.RecordBatch.from_arrays([pa.array(q[there]), pa.array(keys.ravel()[there]), pa.array(best.ravel()[there])], ["q", "key", "score"])

    found = entries.select("key", "v").mapInArrow(run, "q long, key long, score double")
    line = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    return found.withColumn("n", F.row_number().over(line)).where(F.col("n") <= k).select("q", "key")


def radius_for(entries: DataFrame, queries: DataFrame, coder: Coder, dim: int, k: int) -> int:
    """The radius that covers COVER of the true neighbours of about PROBED queries."""
    n = queries.count()
    taken = queries.where(F.pmod(F.xxhash64("key", F.lit(9)), F.lit(1 << 20)) < min(1.0, PROBED / max(n, 1)) * (1 << 20)).orderBy("key").select("v").collect()
    asked = np.array([r["v"] for r in taken], np.float64).reshape(-1, dim)
    if not len(asked):
        return 8 * coder.substrings
    true = nearest_scores(entries, asked, dim, k + 1)
    rows = true.join(entries.select("key", "v"), "key").select("q", "v").toPandas()
    stored = coder.codes(np.array(rows["v"].tolist(), np.float64).reshape(-1, dim))
    own = coder.codes(asked, queries=True)[rows["q"].to_numpy()]
    return int(np.quantile(np.bitwise_count(stored ^ own).sum(1), COVER, method="higher"))


def best_of(queries: np.ndarray, entries: np.ndarray, ids: list[list[int]], coder: Coder, radius: int, k: int) -> tuple[np.ndarray, ...]:
    """(query, entry, score): the k best entries of each query among those within the radius; ties go to the smaller id."""
    first = np.array([i[0] for i in ids], np.int64)
    q, e, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    held: list[tuple] = []
    size = 0

    def cut() -> None:
        nonlocal q, e, s, size
        q, e, s = (np.concatenate([old, *[h[i] for h in held]]) for i, old in enumerate((q, e, s)))
        order = np.lexsort((first[e], -s, q))
        q, e, s = q[order], e[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, e, s = q[rank < k], e[rank < k], s[rank < k]
        held.clear()
        size = 0

    for a, b in Tables(coder.codes(entries)).within(coder.codes(queries, queries=True), radius):
        if len(a):
            held.append((a, b.astype(np.int64), product(entries[b], queries[a])))
            size += len(a)
        if size > 1 << 18:  # what is held stays small, however many codes lie within the radius
            cut()
    cut()
    return q, e, s


def retrieve(entries: DataFrame, queries: DataFrame, coder: Coder, radius: int, k: int, dim: int, blocks: tuple[int, int]) -> DataFrame:
    """(q, ids, score): the k best entries of each query within the radius, for each block of entries."""
    e_blocks, q_blocks = blocks

    def side(df: DataFrame, name: str, ids: Column, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(own)).cast("int")
        return df.select(F.lit(name).alias("side"), "key", "v", ids.alias("ids"), block.alias(mine), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    def meet(table: pa.Table) -> pa.Table:
        is_query = np.array([x == "q" for x in table.column("side").to_pylist()], bool)
        v, keys = _matrix(table.column("v"), dim), table.column("key").to_numpy()
        ids = table.column("ids").filter(pa.array(~is_query)).to_pylist()
        q = e = s = np.zeros(0, np.int64)
        if ids and is_query.any():
            q, e, s = best_of(v[is_query], v[~is_query], ids, coder, radius, k)
        return pa.table({"q": pa.array(keys[is_query][q], pa.int64()), "ids": pa.array([ids[x] for x in e.tolist()], pa.list_(pa.int64())), "score": pa.array(s, pa.float64())})

    names = ["side", "key", "v", "ids", "eb", "qb"]
    held = side(entries, "e", F.col("ids"), e_blocks, q_blocks, "eb", "qb").select(names)
    asked = side(queries, "q", F.array().cast("array<long>"), q_blocks, e_blocks, "qb", "eb").select(names)
    return held.unionByName(asked).repartition(e_blocks * q_blocks, "eb", "qb").groupBy("eb", "qb").applyInArrow(meet, "q long, ids array<long>, score double")


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE, block_queries: int = BLOCK_QUERIES, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for each row whose id is divisible by `every`.

    A query's own id is no candidate, equal vectors under other ids are.  Ties go to
    the smaller id.  Vectors that `usable` leaves out take no part; those of another
    length than the commonest are not comparable and left out too.  Rows that repeat
    an id and vector count once.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    shared = Shared(spark)
    rows = usable(vectors, id_col, vec_col)
    d = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if d is None:
        return spark.createDataFrame([], schema)
    dim = d["d"]
    rows = rows.where(F.size("v") == dim)
    # equal vectors: one entry with its k + 1 smallest ids, found without gathering a class
    name = F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)
    keyed = rows.select("id", "v", F.conv(F.substring(name, 1, 15), 16, 10).cast("long").alias("key")).dropDuplicates(["id", "key"])
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    narrow = Window.partitionBy("key", "salt").orderBy("id")
    few = salted.withColumn("n", F.row_number().over(narrow)).where(F.col("n") <= k + 1)
    parts = few.groupBy("key", "salt").agg(F.first("v").alias("v"), F.collect_list("id").alias("ids"))
    entries = parts.groupBy("key").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = shared.put(entries.select("key", "v", "ids"), "entries")
    queries = shared.put(keyed.where(F.col("id") % every == 0).select("id", "key"), "queries")
    asked = shared.put(entries.join(queries.select("key").distinct(), "key", "left_semi").select("key", "v"), "asked")
    n, n_asked = entries.count(), asked.count()
    norms = entries.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    taken = entries.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < min(1.0, sample / n) * (1 << 20)).orderBy("key").select("v")
    coder = learn(np.array([r["v"] for r in taken.collect()], np.float64).reshape(-1, dim), norms)
    radius, whole = radius_for(entries, asked, coder, dim, k), 8 * coder.substrings
    blocks = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_entries))), max(1, -(-n_asked // block_queries))
    found, left, step = None, asked, 0
    while n_asked:
        pairs = shared.put(retrieve(entries, left, coder, radius, k + 1, dim, blocks), f"found{step}")
        if radius < whole:  # queries that found too few are asked again
            full = pairs.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= min(k + 1, n)).select("q")
            left = shared.put(left.join(full, F.col("key") == F.col("q"), "left_anti").select("key", "v"), f"left{step}")
            pairs, n_asked = pairs.join(full, "q", "left_semi"), left.count()
        else:
            n_asked = 0
        found = pairs if found is None else found.unionByName(pairs)
        radius, step = min(whole, radius + max(1, whole // 8)), step + 1
    if found is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    classes = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    line = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    single = classes.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(line)).where(F.col("n") <= k + 1)
    listed = shared.put(single.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found")), "listed")
    mine: Column = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    got = queries.select(F.col("id").alias("query_id"), F.col("key").alias("q")).join(listed, "q").select("query_id", F.posexplode(mine).alias("p", "f"))
    return got.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def op9_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row of embeddings whose vec_id is divisible by 20; `search` states the cases."""
    return search(read(spark, sf_dir, "embeddings"))
