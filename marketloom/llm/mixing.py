"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document has a uniform number u from a seeded hash of its id and the key
-ln(u) / quality weight; smaller keys come first.  A source with target t takes
floor(t / source size) complete epochs, then documents in key order until the
rest of its budget is used.  Of the document that crosses the budget the mix
takes the words that are left (so that a source takes its target to the word),
or, with whole=True, all or none of it, whichever is nearer to the target.

Keys are dealt into fine ranges, whose sizes are summed before any shuffle;
only the one range of a source in which its budget ends is ordered document by
document.  No task ever gathers a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Shared, read, sized

WORD = r"[^\x20\x09-\x0D]+"
RANGES = 1 << 14
CYCLE = (1, 2, 3)
MOST_EPOCHS = 3


def n_words(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of ASCII letters, spaces and accented letters among the characters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]+", ""))
    return F.coalesce(F.lit(0.1) + F.lit(0.9) * letters / F.nullif(F.length(text), F.lit(0)), F.lit(0.1))


def source_targets(sizes: DataFrame, cycle: tuple = CYCLE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) with each source's target in words.

    Sources in code-point order, null last, weigh by the cycle; shares over
    `most` times a source's size are capped and dealt again by weight.  The
    fixed point of that is min(cap, level * weight), so the level is read off
    the sources ordered by cap / weight.  One row a source is all that meets here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weights = F.array(*[F.lit(float(c)) for c in cycle])
    w = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(cycle) + 1))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    w = w.withColumn("level", F.col("left") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    w = w.withColumn("place", F.row_number().over(by_ratio))
    level = F.min(F.when(fits, F.struct("place", "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, weight: Column | None = None, seed: int = 17, cycle: tuple = CYCLE,
        most: int = MOST_EPOCHS, ranges: int = RANGES, whole: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs(doc_id, source, text).

    With `keep`, those columns of docs with _size and _taken instead.  Null and empty
    texts have size 0 and taken 0; a null source is a source of its own, last in order;
    repeated rows are rows of their own, with equal keys ordered by size; an empty table
    gives an empty result.  A text of any length is one document, counted whole; tied keys
    are ordered by id, then by size.  Other columns are not looked at.
    """
    shared = Shared(docs.sparkSession)
    size = n_words(F.col("text")) if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    u = (F.xxhash64(F.col("doc_id"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    made = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), size.alias("_size"), (-F.log(u) / weight).alias("_key")]
    d = docs.select(*made, *(keep or []))
    d = d.withColumn("_range", F.floor((F.lit(1.0) - F.exp(-F.col("_key") / 2)) * ranges))
    slim = shared.put(d.select("_id", "_source", "_size", "_key", "_range"), "sizes")
    dealt = slim.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    sizes = dealt.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size"))
    t = source_targets(sizes, cycle, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    t = t.withColumn("_epochs", full.cast("long"))
    t = t.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")).withColumnRenamed("source", "_s")
    same = F.col("_source").eqNullSafe(F.col("_s"))
    running = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    # the first range that the rest of the budget does not cover
    edges = dealt.withColumn("_to", F.sum("_sum").over(running)).join(t, same).where(F.col("_to") > F.col("_rest"))
    edge = edges.groupBy("_source").agg(F.min(F.struct("_range", (F.col("_to") - F.col("_sum")).alias("_before"))).alias("_e"))
    t = t.join(edge, same, "left").select("_s", "source_size", "target", "_epochs", "_rest", F.coalesce("_e._range", F.lit(ranges + 1)).alias("_edge"), F.coalesce("_e._before", F.lit(0)).alias("_before"))
    t = sized(shared.put(t, "targets"))
    d = (d if keep else slim).join(t, same)
    inside = F.col("_range") == F.col("_edge")
    line = Window.partitionBy("_source").orderBy("_key", "_id", "_size")
    out = [*(keep or []), "_id", "_size", "source_size", "target"]
    base = F.col("_epochs") * F.col("_size")
    plain = d.where(~inside).select(*out, (base + F.when(F.col("_range") < F.col("_edge"), F.col("_size")).otherwise(F.lit(0))).alias("_taken"))
    at_edge = d.where(inside).withColumn("_from", F.col("_before") + F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size"))
    room = F.col("_rest") - F.col("_from")
    if whole:
        part = F.when(F.col("_size") / 2 <= room, F.col("_size")).otherwise(F.lit(0))
    else:
        part = F.least(F.col("_size"), F.greatest(F.floor(room), F.lit(0)))
    both = plain.unionByName(at_edge.select(*out, (base + part).cast("long").alias("_taken")))
    if keep:
        return both.select(*keep, "_size", "_taken")
    return both.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, whole; columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # so that no column of docs can clash
    mixed = mix(docs.select("doc_id", "source", "text", row), whole=True, keep=["_row"], **options)
    times = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size"))).otherwise(F.lit(0)).cast("int")
    return mixed.where(times > 0).select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_copy")).select("_row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; `mix` states the cases."""
    return mix(read(spark, sf_dir, "documents"))
