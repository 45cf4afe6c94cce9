"""N-gram Jaccard join over a token-group matrix.

A text's set is its distinct word shingles (48-bit hashes).  Texts with equal sets are
one node.  Nodes are partitioned into groups of similar ones: by their least shingle
under a second hash, large groups split by size.  The matrix has an entry for each
token and group, with the bounds that the group's members with that token allow.

Similar sets share a token among the first n - ceil(t n) + 1 of each in any fixed
order of tokens, rare ones first here, so only those tokens enter the matrix.  A
query meets the groups that share such a token and whose size and position bounds
allow the threshold.  A set's profile counts its tokens by BUCKETS of their hash, a
group's profile is the largest count of its members in each: the sum of the smaller
counts bounds any member's overlap with the query, before any set is moved.  A group
that still qualifies is opened only if the query's overlap with the group's whole
token union reaches the least overlap; then its members are compared exactly.  Members that are already connected are not compared again.

Nodes meet the leading group of each of their tokens first; what that connects is
contracted before the other groups are met, so a family of thousands of near copies
costs rows in proportion to its size, and no bucket or partner list is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import Shared, batches_of_words, mix, read, sized, window_hashes

#: Tokens that a partition reports, and that the order of tokens knows, at most.
#: They only decide which tokens count as frequent: results do not depend on them.
LOCAL_FREQUENT, FREQUENT = 1 << 14, 1 << 18
#: Tokens of a group, and queries of one task for a group, about.
GROUP_TOKENS, GROUP_QUERIES = 1 << 15, 512
#: Counts in a profile; one of 255 stands for any more, and then the profile bounds nothing.
BUCKETS = 512
#: Rows that are opened at a time, few enough for a broadcast, and how often all texts are read for that at most.
BLOCK_ROWS, BLOCKS = 300_000, 16
#: Edges that a task writes, about: few ones are not spread over a file for each shuffle partition.
EDGE_ROWS = 100_000
_ROWS, _COUNTED = 256, 1 << 19
_KEPT_BITS = np.uint64((1 << 48) - 1)


def _set(h: np.ndarray, w: np.ndarray, a: int, b: int, shingle: int) -> np.ndarray:
    """The sorted distinct shingles of words a to b."""
    if b - a >= shingle:
        return np.unique(w[a : b - shingle + 1] & _KEPT_BITS)
    if b > a:  # the whole sequence is the one element
        return (window_hashes(h[a:b], b - a) ^ np.uint64(b - a)) & _KEPT_BITS
    return np.zeros(0, np.uint64)


def _of(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The set of each text."""
    for _, _, words in batches_of_words(column, lower=True):
        h = words.hashes()
        w = window_hashes(h, shingle)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            yield _set(h, w, a, b, shingle)


def _bytes(s: np.ndarray) -> bytes:
    """Six bytes a token."""
    return s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _tokens(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those whose token another row has too.

    With a column `early`, by which the rows of a token are sorted, tokens that have none go.
    """
    waiting, seen, useful = None, None, True  # the last row so far, if it is not out yet, its token, and whether that has an early row
    for batch in batches:
        token = batch.column(0).to_numpy()
        if not len(token):
            continue
        same = token[1:] == token[:-1]
        goes_on = seen is not None and bool(token[0] == seen)
        repeats = np.concatenate([[goes_on], same]) | np.concatenate([same, [False]])
        useful_here = np.ones(len(token), bool)
        if "early" in batch.schema.names:
            first = np.concatenate([[not goes_on], ~same])
            heads = np.flatnonzero(first)
            of_run = np.asarray(batch.column("early").to_numpy(zero_copy_only=False), bool)[heads]
            useful_here = np.concatenate([[useful], of_run])[np.cumsum(first)]
        keep = repeats & useful_here
        if goes_on and waiting is not None:
            yield waiting
        yield batch.filter(pa.array(keep))
        waiting = batch.slice(len(token) - 1) if not repeats[-1] and useful_here[-1] else None
        seen, useful = token[-1], bool(useful_here[-1])


def _profile(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((mix(s) >> np.uint64(55)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _largest(table: pa.Table) -> pa.Table:
    """The profile of a group."""
    rows = np.frombuffer(b"".join(table.column("profile").to_pylist()), np.uint8).reshape(-1, BUCKETS)
    return pa.table({"gid": table.column("gid").slice(0, 1), "union": pa.array([rows.max(axis=0).tobytes()], pa.binary())})


def _qualifies(percent: int):
    """Keeps (node, gid) whose profiles allow the query's least overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                q, g = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS) for k in (3, 4))
                most = np.minimum(q, g).sum(axis=1, dtype=np.int64)
                n = part.column(2).to_numpy()
                keep[i : i + 2048] = (100 * most >= percent * n) | (q == 255).any(axis=1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["node", "gid"])

    return run


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def _frequent(shingle: int):
    """The most frequent tokens of a partition, those seen once left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for column in (batch.column(0).slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024)):
            t, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *_of(column, shingle)]), return_counts=True)
            tokens, to = np.unique(np.concatenate([tokens, t]), return_inverse=True)
            counts = np.bincount(to, np.concatenate([counts, c]), minlength=len(tokens)).astype(np.int64)
            if len(tokens) > _COUNTED:  # those seen once so far are counted anew
                tokens, counts = tokens[counts > 1], counts[counts > 1]
        keep = np.flatnonzero(counts > 1)
        keep = keep[np.lexsort((tokens[keep], -counts[keep]))[:LOCAL_FREQUENT]]
        yield pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep])], ["token", "n"])

    return run


def _verify(percent: int):
    """Opens a group: rows (member, node, comp, toks) -> links between nodes that were not connected."""

    def run(table: pa.Table) -> pa.Table:
        member = np.array(table.column("member").to_pylist(), bool)
        node, comp = table.column("node").to_pylist(), table.column("comp").to_pylist()
        toks = [_tokens(b) for b in table.column("toks").to_pylist()]
        held: dict[int, int] = {}
        for k in np.flatnonzero(member):
            held.setdefault(node[k], k)
        asked: dict[int, int] = {}
        for k in np.flatnonzero(~member):
            asked.setdefault(node[k], k)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links: list[tuple[int, int]] = []
        own = sorted(held)
        if own and asked:
            sizes = np.array([len(toks[held[m]]) for m in own])
            every = np.concatenate([toks[held[m]] for m in own])
            of = np.repeat(np.arange(len(own)), sizes)
            union = np.unique(every)
            for q in sorted(asked):
                t = toks[asked[q]]
                at = np.minimum(np.searchsorted(union, t), len(union) - 1)
                if 100 * int((union[at] == t).sum()) < percent * len(t):
                    continue  # the group's union bounds every member's overlap
                at = np.minimum(np.searchsorted(t, every), len(t) - 1)
                both = np.bincount(of[t[at] == every], minlength=len(own))
                near = np.flatnonzero(100 * both >= percent * (sizes + len(t) - both))
                for m in near:
                    a, b = find(comp[asked[q]]), find(comp[held[own[m]]])
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        links.append((q, own[m]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def _stars(e: DataFrame) -> bool:
    """Whether each a of the edges has one b only, and no b is an a: then the components are read off."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below > 0 and above > 0)").isEmpty()


def components(edges: DataFrame, shared: Shared, name: str) -> DataFrame:
    """(node, comp): each linked node with the least node that it reaches, by alternating large and small stars."""
    files = max(1, -(-edges.count() // EDGE_ROWS))  # no round has more edges than the one before
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, step = shared.put(e.coalesce(files), f"{name}0"), 0
    while not _stars(e):  # every round is written: the driver holds small plans
        step += 1
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = shared.put(e.coalesce(files), f"{name}{step}")
        shared.release()
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(e.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct().coalesce(files)


def _matrix() -> list[Column]:
    """Bounds of the nodes of an entry."""
    return [F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("reach"), F.count("*").alias("size")]


def _fits(percent: int, low: Column, high: Column, reach: Column) -> Column:
    """Whether sizes and positions let a node reach the threshold with a node of an entry, if the token is the first that they share."""
    n, tail = F.col("n"), F.col("n") - F.col("pos")
    sizes_fit = (100 * n >= percent * low) & (100 * high >= percent * n)
    return sizes_fit & ((100 + percent) * F.least(tail, reach) >= percent * (n + low))


def _early(percent: int) -> Column:
    """Whether a token is among the first n - ceil(2 t / (1 + t) n) + 1 of a set of n.

    Of two similar sets the smaller shares a token with the other there.  Tokens behind
    those, such as what a template leaves in each of its texts, only meet early ones: a token
    that is late in all texts meets nothing.
    """
    return F.col("n") * (2 * percent) <= (F.col("n") - F.col("pos")) * (100 + percent)


def candidates(now: DataFrame) -> DataFrame:
    """Nodes of now(token, node, pos, n, early, gid, comp) with the entries of other groups and smaller components that share a token, one of the two early."""
    other = now.groupBy("token", F.col("early").alias("slot"), "gid", "comp").agg(*_matrix()).select("token", "slot", F.col("gid").alias("g"), F.col("comp").alias("c"), "low", "high", "reach")
    asks = now.withColumn("slot", F.explode(F.when(F.col("early"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    return asks.join(other, ["token", "slot"]).where((F.col("comp") > F.col("c")) & (F.col("gid") != F.col("g")))


def join(docs: DataFrame, shingle: int = 3, percent: int = 90, shared: Shared | None = None) -> tuple[DataFrame, DataFrame]:
    """(sets, classes): sets(doc_id, node, n) a row of docs each, classes(node, doc_id, comp).

    Texts are read again for each step that needs their sets, which is less than keeping
    all sets.  A text without words has a null node and is in no class; rows without an
    id are linked with equal texts only.
    """
    spark = docs.sparkSession
    shared = shared or Shared(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    known = docs.select("text").where("text is not null").mapInArrow(_frequent(shingle), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas().sort_values("token")
    frequent = known["token"].to_numpy(np.int64).view(np.uint64), known["n"].to_numpy(np.int64)
    by_hash = np.argsort(frequent[0])
    order = spark.sparkContext.broadcast((frequent[0][by_hash], frequent[1][by_hash]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = order.value
        for batch in (b.slice(i, 4 * _ROWS) for b in batches for i in range(0, b.num_rows, 4 * _ROWS)):
            node, size, sign, first, profile = [], [], [], [], []
            for t in _of(batch.column(1), shingle):
                take = len(t) + (-percent * len(t) // 100) + 1  # n - ceil(percent n / 100) + 1
                at = np.minimum(np.searchsorted(tokens, t), max(len(tokens) - 1, 0))
                seen = np.where(tokens[at] == t, counts[at], 0) if len(tokens) else np.zeros(len(t), np.int64)
                first.append(t[np.lexsort((t, seen))[:take]].view(np.int64))
                node.append(_node(t) if len(t) else None)
                sign.append(int(mix(t + np.uint64(0x51ED270B)).min().astype(np.int64)) if len(t) else None)
                size.append(len(t))
                profile.append(_profile(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(sign, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(profile, pa.binary())], ["doc_id", "node", "n", "sign", "prefix", "profile"])

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                wanted = part.column(1).to_pylist()
                made = [_bytes(s) if _node(s) == node else None for s, node in zip(_of(part.column(2), shingle), wanted)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], ["comp", "node", "toks"])

    made = docs.select("doc_id", "text").mapInArrow(prefixes, f"doc_id {id_type}, node long, n int, sign long, prefix array<long>, profile binary")
    sets = shared.put(made.withColumn("uid", F.monotonically_increasing_id()), "sets")
    rows = sets.where("node is not null")
    # one row of each node: that of the least id.  Only repeated texts, few as a rule, are looked up
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("least")
    repeated = rows.groupBy("node").agg(least, F.count("*").alias("rows")).where("rows > 1")
    repeated = shared.put(repeated.select("node", F.col("least.uid").alias("first")), "repeated")
    reps = rows.join(sized(repeated), "node", "left").where("first IS NULL OR first = uid")
    reps = shared.put(reps.select("node", "doc_id", "n", "sign", "prefix", "profile"), "reps")
    texts_of = shared.put(sets.select("doc_id", "node", "n"), "texts")
    shared.drop("sets")
    shared.release()
    # signs whose tokens fill more than one group; all others are one group each
    crowded_signs = reps.groupBy("sign").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > GROUP_TOKENS)
    parts = F.coalesce(F.ceil(F.col("tokens") / GROUP_TOKENS).cast("long"), F.lit(1))
    grouped = reps.join(sized(crowded_signs), "sign", "left").select("node", "n", "prefix", F.xxhash64("sign", F.pmod(F.xxhash64("node"), parts)).alias("gid"))
    members = shared.put(grouped.select("node", "n", "gid"), "members")

    def known_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(token, node, pos, n, frequent) of each token of a prefix; frequent ones are in the order of tokens."""
        known = order.value[0]
        for batch in batches:
            lists = batch.column(1)
            token = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.minimum(np.searchsorted(known, token.view(np.uint64)), max(len(known) - 1, 0))
            frequent = known[at] == token.view(np.uint64) if len(known) else np.zeros(len(token), bool)
            yield pa.RecordBatch.from_arrays([pa.array(token), *[batch.column(k).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for k in (0, 2)], pa.array(pos.astype(np.int32)), pa.array(frequent)], ["token", "node", "n", "pos", "frequent"])

    # tokens of one node only link nothing.  A frequent token stays without being counted, so no key is hot here
    place = reps.select("node", "prefix", "n").mapInArrow(known_frequent, "token long, node long, n int, pos int, frequent boolean").withColumn("early", _early(percent))
    columns = ["token", "node", "n", "pos", "early"]
    rare = place.where("not frequent").select(columns).repartition(F.col("token")).sortWithinPartitions("token", F.desc("early")).mapInArrow(_repeated, "token long, node long, n int, pos int, early boolean")
    leads = shared.put(place.where("frequent AND early").select("token").distinct(), "leads")  # of frequent tokens only
    kept = rare.unionByName(place.where("frequent").select(columns).join(sized(leads), "token", "left_semi"))
    tokens = shared.put(kept.join(sized(members.select("node", "gid")), "node").select("token", "node", "pos", "n", "early", "gid"), "tokens")
    shared.release()

    def opened(pairs: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        """Links found by opening the groups of pairs(node, gid)."""
        met = shared.put(pairs.distinct(), f"{name}-met")
        asked = shared.put(members.select("node", "gid").join(sized(met.select("gid").distinct()), "gid"), f"{name}-asked")
        profiles = reps.select("node", "n", "profile")
        # written, so that no task of the next step holds two Python workers
        unions = shared.put(profiles.select("node", "profile").join(sized(asked), "node").groupBy("gid").applyInArrow(_largest, "gid long, union binary"), f"{name}-unions")
        both = profiles.join(sized(met), "node").join(unions, "gid").select("node", "gid", "n", "profile", "union")
        pairs = shared.put(both.mapInArrow(_qualifies(percent), "node long, gid long"), f"{name}-pairs")
        shared.drop(f"{name}-unions")
        shared.release()
        load = pairs.groupBy("gid").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("salts"))
        queries = pairs.join(load, "gid").select("gid", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("member"), "node")
        held = members.select("node", "gid").join(load, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("member"), "node")
        wanted = shared.put(queries.union(held), f"{name}-wanted")
        need = reps.select("node", "doc_id").join(wanted, "node").join(comps, "node", "left")
        need = shared.put(need.select("node", "doc_id", F.coalesce("comp", "node").alias("comp"), "gid", "salt", "member"), f"{name}-need")
        shared.release()
        return opened_in_blocks(need, name)

    def opened_in_blocks(need: DataFrame, name: str) -> DataFrame:
        """Links of the groups of need, so many of them at a time that their rows are broadcast: neither texts nor sets move but for the comparison."""
        full, source = max(1, -(-need.count() // BLOCK_ROWS)), docs.select("doc_id", "text")
        blocks = min(full, BLOCKS)
        if full > BLOCKS:  # too many readings of all texts: those that are needed are taken out once
            source = shared.put(source.join(sized(need.select("doc_id").distinct()), "doc_id", "left_semi"), f"{name}-source")
            shared.release()
        links = []
        for k in range(blocks):
            part = need.where(F.pmod(F.xxhash64("gid", "salt"), F.lit(blocks)) == k) if blocks > 1 else need
            texts = source.join(sized(part.select("doc_id", "comp", "node").distinct()), "doc_id").select("comp", "node", "text")
            sets_of = texts.mapInArrow(tokens_of, "comp long, node long, toks binary").where("toks is not null")
            targets = sized(part.select("gid", "salt", "member", "node"))
            links.append(shared.put(sets_of.join(targets, "node").groupBy("gid", "salt").applyInArrow(_verify(percent), "a long, b long"), f"{name}-links{k}"))
            shared.release()
        if full > BLOCKS:
            shared.drop(f"{name}-source")
        return reduce(DataFrame.union, links)

    nothing = spark.createDataFrame([], "node long, comp long")
    leading = tokens.groupBy("token", "gid").agg(*_matrix()).groupBy("token").agg(F.max_by(F.struct("gid", "low", "high", "reach"), F.struct("size", "gid")).alias("g"), F.count("*").alias("groups"))
    to_leader = tokens.join(leading.where("groups > 1"), "token").where(F.col("gid") != F.col("g.gid"))
    to_leader = to_leader.where(_fits(percent, F.col("g.low"), F.col("g.high"), F.col("g.reach"))).select("node", F.col("g.gid").alias("gid"))
    crowded = members.groupBy("gid").agg(F.count("*").alias("size")).where("size > 1").select("gid")
    links = opened(to_leader.union(members.join(crowded, "gid").select("node", "gid")), nothing, "lead")
    comps = shared.put(components(links, shared, "lead-star"), "lead-comps")
    now = tokens.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = candidates(now).where(_fits(percent, F.col("low"), F.col("high"), F.col("reach")))
    more = opened(rest.select("node", F.col("g").alias("gid")), comps, "rest")
    held = comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    all_comps = components(held.union(more), shared, "star")
    classes = reps.select("node", "doc_id").join(all_comps, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    return texts_of, shared.put(classes, "classes")


def linked(docs: DataFrame, shingle: int = 3, percent: int = 90, shared: Shared | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    component_id is the least doc_id that links reach.  Null and word-less texts have an
    empty set and stand alone; equal texts are linked; repeated rows each give a row.  A
    text of any length is one set, made in one task; an empty table gives an empty result.
    Other columns are not looked at.
    """
    sets, classes = join(docs, shingle, percent, shared)
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of = classes.join(least, "comp").select("node", "component_id")
    return sets.join(of, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, that of the least doc_id; columns as they were.

    Rows of one id are one document: it goes if any of them belongs to a component with
    a smaller id, else one of them stays.  Rows without an id stay.
    """
    shared = Shared(docs.sparkSession)
    found = shared.put(linked(docs, shingle, percent, shared).where("doc_id is not null"), "found")
    shared.release()
    seen = shared.put(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max((F.col("component_id") != F.col("doc_id")).cast("int")).alias("goes")).where("rows > 1 or goes > 0"), "seen")
    out = docs.join(sized(seen.select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    once = docs.join(sized(seen.where("goes = 0").select("doc_id")), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return out.unionByName(once)


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """The components of documents over 3-word shingles at 90 percent; `linked` states the cases."""
    return linked(read(spark, sf_dir, "documents"))
