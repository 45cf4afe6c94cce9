"""Substring dedup by fixed-block anchors.

A window of WINDOW words that also lies in a reference document holds at least one
whole block of that document's grid of WINDOW // 2 words.  So:

1. every rolling window of block length is probed against the grid blocks of all
   documents (a grid block is simply the rolling window at a multiple of the block
   length); hits in another document mark places on both sides;
2. the hits are extended: around the marked places all windows of full length are
   compared, which joins neighbouring hits into maximal exact repeats; a window is
   a repeat where its words also start in a document with a smaller id;
3. the words that repeats cover are taken out.

Records travel packed, by ranges of the hash, many to a row; nothing is emitted for
pairs of documents, so thousands of copies cost as much as any other text.  Places of
one hash that meet in a slice of texts are settled there, and only those of its
smallest and largest documents and of its smallest block travel on; where there are
many slices, salted groups settle places once more before the last groups.  So a
passage that a third of all documents share sends a few places a slice, never all of
them to one group.  Words are compared by 64-bit hashes.

Rows that share an id and differ in text are variants of one document: they have the
document's place in the order of ids, and ranges of places of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import SLICE_BYTES, Shared, batches_of_words, mix, read, sized, window_hashes

WINDOW = 50
#: Bytes of text whose records one group holds, and the low bits of a record that hold a place in a segment.
GROUP_BYTES = 6 << 20
_PLACE = 24
_PACKED = "bucket int, doc binary, base binary, n binary, record binary, place binary, ranges binary"
#: The low bits of a record, and the slices from which salted groups settle places before the last groups do.
_LOW = np.uint64((1 << _PLACE) - 1)
RELAY_SLICES = 1 << 16
#: A document has fewer words than this many blocks; the places of its variants begin at multiples of so many.
VARIANT_BLOCKS = 1 << 32
_SALTS = 1 << 10


def _pack(bucket: np.ndarray, entry: np.ndarray, docs: np.ndarray, bases: np.ndarray, record: np.ndarray, place: np.ndarray | None, buckets: int) -> pa.RecordBatch:
    """One row for each bucket: its entries (document and base place), records an entry, and the records."""
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, entry, record = bucket[order], entry[order], record[order]
    place = None if place is None else place[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    rows: list[tuple] = []
    for a, b in zip(edges, np.append(edges[1:], len(bucket))):
        own = entry[a:b]  # entries stay in order
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        at = own[heads]
        n = np.diff(np.append(heads, len(own))).astype(np.int32)
        rows.append((int(bucket[a]), docs[at].tobytes(), bases[at].tobytes(), n.tobytes(), record[a:b].tobytes(), b"" if place is None else place[a:b].tobytes()))
    columns = list(zip(*rows)) if rows else [[]] * 6
    arrays = [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]], pa.nulls(len(rows), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "doc", "base", "n", "record", "place", "ranges"])


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, base, record and place of every record of a group."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    n = join("n", np.int32)
    return np.repeat(join("doc", np.int64), n), np.repeat(join("base", np.int64), n), join("record", np.uint64), join("place", np.int32)


_FOUND = "slot int, doc binary, n binary, ranges binary"


def _settled(found: pa.Table) -> pa.RecordBatch:
    """Ranges that are found already, as rows that pass through the groups of records."""
    none = pa.array([b""] * len(found), pa.binary())
    columns = {"bucket": found["slot"], "doc": found["doc"], "base": none, "n": found["n"], "record": none, "place": none, "ranges": found["ranges"]}
    return pa.table(columns).combine_chunks().to_batches()[0] if len(found) else _pack(*[np.zeros(0, np.int64)] * 5, None, 1)


def _parted(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The records of a group, and the ranges that pass through it."""
    open_ = pc.is_null(table["ranges"])
    through = table.filter(pc.invert(open_))
    return table.filter(open_), pa.table({"slot": through["bucket"], "doc": through["doc"], "n": through["n"], "ranges": through["ranges"]})


def _met(key: np.ndarray, doc: np.ndarray, is_block: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(which places travel on, which are found) among the places of a slice or a salted group.

    A place is found if its words are also in a smaller document.  The smallest document of
    a hash is left open and travels; with blocks, so do the largest and the smallest block's,
    which settle the others' places elsewhere.
    """
    on, found = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        d = doc[order]
        heads, run = _groups(key[order])
        least = np.minimum.reduceat(d, heads)[run]
        found[order] = d > least
        travels = d == least
        if is_block is not None:
            block = is_block[order]
            least_block = np.minimum.reduceat(np.where(block, d, np.iinfo(np.int64).max), heads)[run]
            travels |= (d == np.maximum.reduceat(d, heads)[run]) | (block & (d == least_block))
        on[order] = travels
    return on, found


def _again(bucket: int, doc: np.ndarray, base: np.ndarray, record: np.ndarray, place: np.ndarray | None, on: np.ndarray, through: pa.Table, found: pa.Table) -> pa.Table:
    """What a salted group passes on: the places that travel, packed anew, and all ranges found."""
    at = np.flatnonzero(on)
    at = at[np.lexsort((base[at], doc[at]))]
    entry = np.cumsum(np.concatenate([[0], (doc[at[1:]] != doc[at[:-1]]) | (base[at[1:]] != base[at[:-1]])])) if len(at) else at
    heads = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(at) else at
    packed = _pack(np.full(len(at), bucket), entry, doc[at[heads]], base[at[heads]], record[at], None if place is None else place[at], bucket + 1)
    return pa.concat_tables([pa.Table.from_batches([packed]), pa.Table.from_batches([_settled(pa.concat_tables([through, found]))])])


def _relayed(packed: DataFrame, slices: int, settle) -> DataFrame:
    """packed, with each bucket's records settled in salted groups first where very many slices send some."""
    if slices <= RELAY_SLICES:
        return packed
    salts = int(slices**0.5)
    return packed.groupBy("bucket", (F.crc32("doc") % salts).alias("salt")).applyInArrow(settle, _PACKED)


def _by_document(doc: np.ndarray, place: np.ndarray, length: int, slots: int) -> pa.Table:
    """The merged ranges [place, place + length) of each document, packed by slots of documents: a row a slot."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    rows: list[tuple] = []
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + length)])
        heads = np.flatnonzero(new)
        ranges = np.column_stack([place[heads], place[np.append(heads[1:] - 1, len(place) - 1)] + length])
        of = doc[heads]
        slot = (mix(of.view(np.uint64)) % np.uint64(slots)).astype(np.int64)
        by = np.argsort(slot, kind="stable")
        slot, of, ranges = slot[by], of[by], ranges[by]
        edges = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        for a, b in zip(edges, np.append(edges[1:], len(slot))):
            own = of[a:b]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rows.append((int(slot[a]), own[first].tobytes(), np.diff(np.append(first, len(own))).astype(np.int32).tobytes(), ranges[a:b].tobytes()))
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table({"slot": pa.array(columns[0], pa.int32()), **{name: pa.array(c, pa.binary()) for name, c in zip(("doc", "n", "ranges"), columns[1:])}})


def _merged(packed: list[bytes]) -> np.ndarray:
    """Disjoint sorted ranges from packed ones."""
    r = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 2)
    if not len(r):
        return r
    r = r[np.argsort(r[:, 0], kind="stable")]
    ends = np.maximum.accumulate(r[:, 1])
    heads = np.flatnonzero(np.concatenate([[True], r[1:, 0] > ends[:-1]]))
    return np.column_stack([r[heads, 0], ends[np.append(heads[1:] - 1, len(r) - 1)]])


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads of runs of equal keys, and each item's run."""
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _starts(packed: bytes, window: int, block: int) -> bytes:
    """The starts of all windows that hold a marked block, as packed ranges."""
    r = np.frombuffer(packed, np.int64).reshape(-1, 2)
    return np.column_stack([r[:, 0] - (window - block), r[:, 1] - block + 1]).tobytes()


def _collected(found: DataFrame, shared: Shared, name: str) -> DataFrame:
    """One row for each document, its ranges merged into one packed value."""

    def merge(table: pa.Table) -> pa.Table:
        join = lambda column, kind: np.frombuffer(b"".join(table.column(column).to_pylist()), kind)
        doc = np.repeat(join("doc", np.int64), join("n", np.int32))
        ranges = join("ranges", np.int64).reshape(-1, 2)
        order = np.argsort(doc, kind="stable")
        doc, ranges = doc[order], ranges[order]
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
        merged = [_merged([ranges[a:b].tobytes()]).tobytes() for a, b in zip(edges, np.append(edges[1:], len(doc)))]
        return pa.table({"doc_id": pa.array(doc[edges], pa.int64()), "ranges": pa.array(merged, pa.binary())})

    out = shared.put(found.groupBy("slot").applyInArrow(merge, "doc_id long, ranges binary"), name)
    shared.release()
    return out


def _texts(docs: DataFrame, shared: Shared) -> DataFrame:
    """(doc_id, text, variant): variant numbers the different texts of one id, in salted groups; 0 where there is one."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    several = d.groupBy("doc_id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("doc_id IS NOT NULL AND a <> b").select("doc_id")
    salt = F.pmod("hash", F.lit(_SALTS))
    line = Window.partitionBy("doc_id", "salt").orderBy("hash")
    each = d.join(sized(shared.put(several, "several")), "doc_id", "left_semi").select("doc_id", "hash").distinct().withColumn("salt", salt)
    each = shared.put(each.select("doc_id", "hash", ((F.row_number().over(line) - 1) * _SALTS + F.col("salt")).cast("long").alias("variant")), "variants")
    if each.isEmpty():
        return d.select("doc_id", "text", F.lit(0).cast("long").alias("variant"))
    return d.join(sized(each), ["doc_id", "hash"], "left").select("doc_id", "text", F.coalesce("variant", F.lit(0)).cast("long").alias("variant"))


def _own(packed: bytes | None, variant: int, step: int) -> np.ndarray:
    """The disjoint ranges of one variant, from its document's."""
    r = _merged([packed or b""])
    r = r[(r[:, 0] >= variant * step - step // 2) & (r[:, 0] < variant * step + step // 2)]
    return r - variant * step


def repeats(texts: DataFrame, window: int, shared: Shared) -> DataFrame:
    """(doc_id, ranges): the words of each document of texts(doc_id, text, variant) that repeat a passage of one with a smaller id.

    Packed int64 ranges; a variant's begin at its number times window // 2 * VARIANT_BLOCKS.
    Documents without repeats are left out.  Null ids take no part.
    """
    spark = texts.sparkSession
    d = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    block = window // 2
    step = block * VARIANT_BLOCKS
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_BYTES))
    slices = -(-total // SLICE_BYTES)
    low = _LOW

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(_PLACE) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = batch.column(0).to_numpy(), batch.column(2).to_numpy() * step
            for i, j, words in batches_of_words(batch.column(1)):
                h = window_hashes(words.hashes(), block)
                doc = np.repeat(np.arange(j - i), np.diff(words.bounds))[: len(h)]
                place = np.arange(len(h)) - words.bounds[:-1][doc]
                ok = place + block <= np.diff(words.bounds)[doc]
                h, doc, place = h[ok], doc[ok], place[ok]
                own = ids[i:j][doc]
                on, found = _met(h & ~low, own, place % block == 0)
                yield _settled(_by_document(own[found], (place + first[i:j][doc])[found], block, buckets))
                h, doc, place = h[on], doc[on], place[on]
                segment = place >> _PLACE
                entry = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1]))]) if len(h) else np.zeros(0, np.int64)
                heads = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(h) else entry
                record = (h & ~low) | (place.astype(np.uint64) & low)
                yield _pack(bucket_of(h), entry, ids[i:j][doc[heads]], (segment[heads] << _PLACE) + first[i:j][doc[heads]], record, None, buckets)

    def settle_probes(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        table, through = _parted(table)
        doc, base, record, _ = _unpack(table)
        place = base + (record & low).astype(np.int64)
        on, found = _met(record & ~low, doc, place % block == 0)
        return _again(bucket, doc, base, record, None, on, through, _by_document(doc[found], place[found], block, buckets))

    def hits(table: pa.Table) -> pa.Table:
        table, through = _parted(table)
        doc, base, record, _ = _unpack(table)
        order = np.argsort(record & ~low, kind="stable")
        doc, record = doc[order], record[order]
        place = base[order] + (record & low).astype(np.int64)
        heads, run = _groups(record & ~low)
        if not len(run):
            return through
        is_block = place % block == 0
        least_block = np.minimum.reduceat(np.where(is_block, doc, np.iinfo(np.int64).max), heads)[run]
        largest = np.maximum.reduceat(doc, heads)[run]
        marked = (least_block < doc) | (is_block & (doc < largest))
        return pa.concat_tables([through, _by_document(doc[marked], place[marked], block, buckets)])

    marks = _relayed(d.mapInArrow(probes, _PACKED), slices, settle_probes).groupBy("bucket").applyInArrow(hits, _FOUND)
    marks = _collected(marks, shared, "marks")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed, variant = batch.column(0).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy()
            for i, j, words in batches_of_words(batch.column(1)):
                h = window_hashes(words.hashes(), window)
                picked, entry = [], []
                for k in range(i, j):
                    a, b = int(words.bounds[k - i]), int(words.bounds[k - i + 1])
                    # places of marked blocks, plus a half window before them, are the starts to compare
                    for s, e in _merged([_starts(_own(packed[k], variant[k], step).tobytes(), window, block)]):
                        s, e = max(0, int(s)), min(int(e), b - a - window + 1)
                        if s < e:
                            picked.append(np.arange(a + s, a + e))
                            entry.append(np.full(e - s, k - i))
                if picked:
                    at, of = np.concatenate(picked), np.concatenate(entry)
                    own, place = ids[i:j][of], at - words.bounds[of]
                    on, later = _met(h[at], own, None)
                    yield _settled(_by_document(own[later], (place + variant[i:j][of] * step)[later], window, buckets))
                    at, of = at[on], of[on]
                    yield _pack(bucket_of(h[at]), of, ids[i:j], variant[i:j] * step, h[at], (at - words.bounds[of]).astype(np.int32), buckets)

    def settle_windows(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        table, through = _parted(table)
        doc, base, record, place = _unpack(table)
        on, later = _met(record, doc, None)
        return _again(bucket, doc, base, record, place, on, through, _by_document(doc[later], (base + place)[later], window, buckets))

    def judged(table: pa.Table) -> pa.Table:
        table, through = _parted(table)
        doc, base, record, place = _unpack(table)
        order = np.argsort(record, kind="stable")
        doc, place, record = doc[order], (base + place)[order], record[order]
        heads, run = _groups(record)
        if not len(run):
            return through
        later = doc > np.minimum.reduceat(doc, heads)[run]
        return pa.concat_tables([through, _by_document(doc[later], place[later], window, buckets)])

    near = d.join(sized(marks), "doc_id").select("doc_id", "text", "ranges", "variant")
    found = _relayed(near.mapInArrow(windows, _PACKED), slices, settle_windows).groupBy("bucket").applyInArrow(judged, _FOUND)
    return _collected(found, shared, "repeats")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs(doc_id, text); windows are judged on the input.

    Null and empty texts have no words.  Rows that repeat an id are one document's
    rows: each is judged by its own text, against smaller ids only.
    """
    shared = Shared(docs.sparkSession)
    texts, step = _texts(docs, shared), window // 2 * VARIANT_BLOCKS
    found = repeats(texts, window, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, variant, n_words, n_removed, sha = batch.column(2).to_pylist(), batch.column(3).to_numpy(), [], [], []
            for i, j, words in batches_of_words(batch.column(1)):
                data = words.data.tobytes()
                for k in range(i, j):
                    a, b = words.bounds[k - i], words.bounds[k - i + 1]
                    keep = np.ones(b - a, bool)
                    for s, e in _own(packed[k], variant[k], step):
                        keep[s:e] = False
                    at = np.flatnonzero(keep) + a
                    n_words.append(int(b - a))
                    n_removed.append(int(b - a - len(at)))
                    sha.append(hashlib.sha256(b" ".join([data[x:y] for x, y in zip(words.starts[at].tolist(), words.ends[at].tolist())])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = texts.join(sized(found), "doc_id", "left").select("doc_id", "text", "ranges", "variant")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    """dedup over all documents: 50 words a window.

    Null texts count as no words; rows without an id lose nothing; an empty table gives an
    empty result.  A text of any length is judged whole, in one task.  Equal texts: that of
    the smallest id stays.  Other columns are not read.
    """
    return dedup(read(spark, sf_dir, "documents"))
