"""A Merkle manifest of a dataset, with a proof for each row by coordinate lookup.

Every row is a leaf.  Leaves of one language stand in order of their ids, runs of up to
eight neighbours have one parent, and so on up to the language's root; the languages'
roots are the leaves of one more tree.

Places: leaves are dealt into ordered slices and written, slices are counted, and a
leaf's place is what stands before its slice and before it in its slice, so no task
sees a language whole.  Equal rows are one row with a number of copies until they have
places.

Nodes are written level by level.  Nodes of one run have neighbouring coordinates and
are read together, so the node table has a row a run: (tree, level, run) and the digests
of its nodes, one behind the other, 32 bytes each.

Proofs: from its place and the size of its tree a leaf computes the coordinates of the
siblings it needs, one run a level, and explodes them; they are joined with the node
table, ordered by level, concatenated and folded.  Levels with few runs (the upper ones,
whatever the size of the table) are broadcast, and the leaf stays where it is; the lower
levels are joined by shuffle on keys that at most as many leaves share as stand below a
run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Shared, crc_remainder, read, sized

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run are 2 ** BITS at most.
BITS = 3
#: Levels are broadcast from the top down to so many runs (of at most 256 bytes of digests) in all.
BROADCAST_RUNS = 1 << 15
#: Copies of a row that are written out by one task at most.
COPIES = 1 << 12
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encoded(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def text_of(digests: Column) -> Column:
    """Digests as hexadecimal text."""
    return F.lower(F.hex(digests))


def digest(*parts: Column) -> Column:
    """The 32 bytes of sha256 over the parts' text."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, changed, copies): changed is the digest after tampering, null where there is none."""
    rest = [encoded(F.col(f)) for f in FIELDS[:-1]]
    low = F.when(tampered, F.translate("text", _UPPER, _UPPER.lower()))
    changed = F.when(tampered, digest(*rest, encoded(low)))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    d = docs.select(tree.alias("tree"), "doc_id", digest(*[encoded(F.col(f)) for f in FIELDS]).alias("leaf"), changed.alias("changed"))
    return d.groupBy("tree", "doc_id", "leaf", "changed").agg(F.count("*").alias("copies"))


def placed(shared: Shared, rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows(tree, copies, *by) with `place`, the number of copies before them in their tree, and `n`, all of the tree's."""
    slices = int(shared.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = shared.put(rows.repartitionByRange(slices, "tree", *by).withColumn("slice", F.spark_partition_id()), f"{name}_slices")
    counted = dealt.groupBy("tree", "slice").agg(F.sum("copies").alias("here"))
    before = Window.partitionBy("tree").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("tree", "slice", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    counted = sized(shared.put(counted, f"{name}_counts"))
    inside = Window.partitionBy("tree", "slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    got = dealt.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(counted, ["tree", "slice"])
    return got.withColumn("place", F.col("before") + F.col("inside")).drop("slice", "inside", "before")


def singly(rows: DataFrame) -> DataFrame:
    """Rows(place, copies) as often as they have copies, each with its own place; many copies of one row are written by many tasks."""
    end = F.col("place") + F.col("copies") - 1
    few = rows.where(F.col("copies") <= COPIES).withColumn("place", F.explode(F.sequence("place", end)))
    parts = rows.where(F.col("copies") > COPIES).withColumn("end", end).withColumn("place", F.explode(F.sequence("place", end, F.lit(COPIES)))).repartition("tree", "place")
    many = parts.withColumn("place", F.explode(F.sequence("place", F.least("end", F.col("place") + COPIES - 1)))).drop("end")
    return few.unionByName(many).drop("copies")


def _parent_size(n: Column) -> Column:
    return F.floor((n + (1 << BITS) - 1) / (1 << BITS))


def grow(shared: Shared, nodes: DataFrame, name: str) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Nodes(tree, place, digest, n) up to the roots: (runs, their number) of each level, and roots(tree, root).

    Runs are (tree, run, digests, digest, n): digest is their parent's, n the nodes of the tree on that level.
    """
    roots = [nodes.where("n = 1").select("tree", F.col("digest").alias("root"))]
    levels: list[tuple[DataFrame, int]] = []
    left = nodes.where("n > 1")
    while True:
        run = F.shiftright("place", BITS).alias("run")
        members = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda m: m["digest"])
        joined = F.aggregate(members, F.lit(b""), lambda a, m: F.concat(a, m))
        runs = left.groupBy("tree", "n", run).agg(joined.alias("digests"))
        runs = shared.put(runs.select("tree", "run", "digests", digest(text_of(F.col("digests"))).alias("digest"), "n"), f"{name}_runs{len(levels)}")
        count, most = runs.agg(F.count("*"), F.max("n")).first()
        if not count:
            break
        levels.append((runs, count))
        roots.append(runs.where(F.col("n") <= 1 << BITS).select("tree", F.col("digest").alias("root")))
        if most <= 1 << BITS:
            break
        left = runs.where(F.col("n") > 1 << BITS).select("tree", F.col("run").alias("place"), "digest", _parent_size(F.col("n")).alias("n"))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, out


def paths(nodes: DataFrame, levels: list[tuple[DataFrame, int]]) -> DataFrame:
    """Nodes(tree, place, n, ...) with `steps`: the siblings (level, left, right) on the way to the root, in order."""
    table = [runs.select("tree", "run", "digests", F.lit(k).alias("level")) for k, (runs, _) in enumerate(levels)]
    low, total = len(levels), 0
    while low and total + levels[low - 1][1] <= BROADCAST_RUNS:
        low, total = low - 1, total + levels[low - 1][1]
    nodes = nodes.repartition("tree", "place")  # in place for all that follows
    # a tree of n nodes has as many levels above them as there are powers of 8 below n
    depth = F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k * BITS) < F.col("n")))

    def found(first: int, end: int, broadcast: bool) -> DataFrame:
        """(tree, place, steps) of the levels from first to before end."""
        there = F.filter(F.sequence(F.lit(first), F.lit(end - 1)), lambda k: k < depth)
        own = F.call_function("shiftright", F.col("place"), F.col("level") * BITS)
        asked = nodes.select("tree", "place", F.explode(F.when(depth > first, there)).alias("level"))
        asked = asked.withColumn("run", F.shiftright(own, BITS)).withColumn("own", own.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
        known = table[first]
        for more in table[first + 1 : end]:
            known = known.unionByName(more)
        got = asked.join(F.broadcast(known) if broadcast else known, ["tree", "level", "run"])
        left = F.substring("digests", F.lit(1), F.col("own") * 32)
        right = F.substring("digests", F.col("own") * 32 + 33, F.lit(32 << BITS))
        return got.groupBy("tree", "place").agg(F.array_sort(F.collect_list(F.struct("level", left.alias("left"), right.alias("right")))).alias("steps"))

    parts = [found(a, b, broadcast) for a, b, broadcast in ((0, low, False), (low, len(levels), True)) if a < b]
    empty = F.array().cast("array<struct<level:int,left:binary,right:binary>>")
    out = nodes.withColumn("steps", empty)
    for part in parts:
        out = out.join(part.withColumnRenamed("steps", "more"), ["tree", "place"], "left").withColumn("steps", F.concat("steps", F.coalesce("more", empty))).drop("more")
    return out


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs(doc_id, source, lang, n_chars, text).

    `tampered` marks the rows whose text changes (its capitals A to Z to small ones) after
    the manifest is made; their leaf is computed anew and folded with the original
    siblings.  Null fields count as `-`; null ids come first in their language and are
    never tampered with; rows of one id are ordered by their digest, equal rows are leaves
    of their own, side by side.  A null lang is a tree of its own, the first.  Long texts
    are hashed whole.  An empty table gives an empty result.  Other columns are not read.
    """
    shared = Shared(docs.sparkSession)
    if tampered is None:
        tampered = crc_remainder(F.col("doc_id"), 3) == 0
    rows = shared.put(leaves(docs, tampered), "leaves")
    marked = shared.put(singly(shared.put(placed(shared, rows, ["doc_id", "leaf"], "leaf"), "placed")), "places")
    nodes = marked.select("tree", "place", F.col("leaf").alias("digest"), "n")
    levels, roots = grow(shared, nodes, "leaf")
    roots = shared.put(roots, "roots")
    tops = placed(shared, roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("digest"), F.lit(1).alias("copies")), ["lang"], "top")
    tops = shared.put(tops.select("tree", "place", "digest", "n", "lang"), "tops")
    top_levels, top = grow(shared, tops, "top")
    root = top.first()
    above = paths(tops, top_levels).select(F.col("lang").alias("tree"), F.col("digest").alias("subroot"), F.col("steps").alias("above"))
    above = sized(shared.put(above, "above"))
    steps = F.concat("steps", "above")
    got = paths(marked, levels).join(above, "tree").withColumn("steps", steps)
    whole = F.aggregate("steps", F.lit(""), lambda a, s: F.concat(a, text_of(s["left"]), text_of(s["right"])))
    folded = F.aggregate("steps", text_of(F.coalesce("changed", "leaf")), lambda a, s: F.sha2(F.concat(text_of(s["left"]), a, text_of(s["right"])), 256))
    known = F.lit(bytes(root["root"]).hex() if root else None).cast("string")
    out = got.select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), known.alias("root"), F.sha2(whole, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents, every third id or so tampered with; `manifest` states the cases."""
    return manifest(read(spark, sf_dir, "documents"))


def oracle(levels: int = 7, top_levels: int = 3) -> str:
    """DuckDB SQL for `op12_manifest`: levels written out, enough for 8 ** levels rows a language."""
    enc = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    head = " || ".join(enc(c) for c in FIELDS[:-1])
    ctes = [f"""d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({head} || {enc('text')}) AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN sha256({head} || {enc(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")}) END AS changed FROM documents)""",
            "l0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM d)"]

    def climb(p: str, count: int) -> None:
        for k in range(count):
            ctes.append(f"{p}{k + 1} AS (SELECT tree, idx // 8 AS idx, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE max(h) END AS h, (n + 7) // 8 AS n FROM {p}{k} GROUP BY tree, idx // 8, n)")
            w = "OVER (PARTITION BY tree, idx // 8 ORDER BY idx ROWS BETWEEN"
            ctes.append(f"{p}s{k} AS (SELECT tree, idx, n, coalesce(string_agg(h, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {p}{k})")

    climb("l", levels)
    ctes.append(f"t0 AS (SELECT '' AS tree, tree AS lang, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM l{levels})")
    climb("t", top_levels)
    ctes.append("p0 AS (SELECT l0.doc_id, l0.leaf, l0.tree, l0.idx, l0.idx AS at, t0.h AS subroot, t0.idx AS top, coalesce(changed, leaf) AS cur, '' AS proof FROM l0 JOIN t0 ON t0.lang = l0.tree)")
    step = 0
    for p, count, at in (("l", levels, "at"), ("t", top_levels, "top")):
        for k in range(count):
            key = "p.tree" if p == "l" else "''"
            moved = {"at": "p.at", "top": "p.top"} | {at: f"p.{at} // 8"}
            ctes.append(f"p{step + 1} AS (SELECT p.doc_id, p.leaf, p.tree, p.subroot, {moved['at']} AS at, {moved['top']} AS top, CASE WHEN s.n > 1 THEN sha256(s.pre || p.cur || s.post) ELSE p.cur END AS cur, p.proof || s.pre || s.post AS proof FROM p{step} p JOIN {p}s{k} s ON s.tree = {key} AND s.idx = p.{at})")
            step += 1
    return f"WITH {', '.join(ctes)} SELECT p.doc_id, p.leaf, p.subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.cur AS folded_root, p.cur = r.h AS verified FROM p{step} p, t{top_levels} r"
