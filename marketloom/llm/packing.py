"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Tokens.  Ids come from a public tokenizer that drops white space and works on runs of
letters, single digits and runs of other characters.  So a text is cut into units: such
runs in words of ASCII and accented Latin letters, whole words where there is any other
character or an apostrophe.  The distinct units of a slice of texts are coded once, runs by
the tokenizer's model alone, words by the whole tokenizer, and documents are put together
from them.

Pieces.  A document longer than a sequence is cut into whole sequences; those and any
document of just that length are sequences of their own.  All other pieces are open.

Shards.  Open pieces are dealt into shards of about SHARD pieces by a hash of their row,
so that neither a hot document nor a hot length gathers in one task.  A shard lives on
ISLANDS islands, each a row with a population of packings.  An island starts from best fit
in falling order, and in orders of its own, and evolves by grouping crossover: well-filled
bins of one parent are injected whole into the other, bins of the other that hold one of
their pieces are dissolved (so no piece is there twice), and displaced pieces go where they
fit best.  Fitness is the number of bins, then the sum of squared fills, which gathers
waste in few bins.  After each round the elite of an island moves on to the next island of
its shard.

Levels.  A shard of the first level cannot share a sequence with another, so its emptiest
bins give their pieces back, and these are dealt into (far fewer) shards again, until one
shard is left.  So the waste of all shards is packed again.  An island that meets the bound ceil(tokens / capacity) rests.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import LOWER, Shared, read, text_buffer, trim

CAPACITY, END = 4096, 1
SHARD, ISLANDS, ROUNDS = 4096, 2, 2
POPULATION, CHILDREN = 4, 6
#: Pieces that a shard may give back for the next level: those of bins with this much room, from the emptiest bin on.
ROOM, GIVEN = 8, 1 / 16
_SEGMENT = 2 << 20
_CACHED = 800_000
_KINDS = np.full(256, 4, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other, 4 a control, an apostrophe or beyond the letters known here
_KINDS[33:127] = 3
_KINDS[[32, *range(9, 14)]] = 0
_KINDS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = 1  # U+00C0 to U+017F: these lead bytes
_KINDS[48:58] = 2
_KINDS[ord("'")] = 4
#: The tokenizer's letters for bytes: printable ones of Latin-1 for themselves, the others from 256 on.
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Units of which the tokenizer makes one run: letters up to U+017F, a digit, ASCII signs.
_RUN = re.compile(r"[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def default_model() -> str:
    """The public word tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- tokens -----------------------------------------------------------------


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes without white space, offsets of units) of UTF-8 text; ASCII letters of runs are small."""
    kind = _KINDS[data]
    inner = kind > 0
    if not inner.any():
        return data[:0], np.zeros(1, np.int64)
    start = inner.copy()
    start[1:] &= ~inner[:-1]
    kept, kind, start = data[inner], kind[inner], start[inner]
    lead = np.flatnonzero(kept[:-1] >= 0xC3)
    a, b = kept[lead], kept[lead + 1]
    kind[lead[((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC4) & (b == 0xB0))]] = 4  # two signs and the dotted capital I
    first = start.copy()
    first[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    small = LOWER[kept]
    odd = np.flatnonzero(kind == 4)
    if len(odd):
        heads = np.flatnonzero(start)
        whole = np.unique(np.searchsorted(heads, odd, "right") - 1)
        edge = np.zeros(len(kept) + 1, np.int8)
        edge[heads[whole]] += 1
        edge[np.append(heads, len(kept))[whole + 1]] -= 1
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        first &= ~inside | start
        small = np.where(inside, kept, small)
    return small, np.append(np.flatnonzero(first), len(kept))


class Coder:
    """Ids of texts; the ids of units met before are kept, up to a number."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.heads, self.used = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int64), 0

    def _learn(self, words: list[str]) -> None:
        """Code new units: the ids of unit i are flat[heads[i]:heads[i + 1]]."""
        runs = [x for x in words if _RUN.fullmatch(x)]
        rest = [x for x in words if not _RUN.fullmatch(x)] if len(runs) < len(words) else []
        tokenize = self.model.model.tokenize
        made = [[t.id for t in tokenize(x if x.isascii() else x.lower().encode().decode("latin-1").translate(_LETTERS))] for x in runs]
        made += [e.ids for e in self.model.encode_batch_fast(rest, add_special_tokens=False)]
        ends = self.used + np.cumsum([len(m) for m in made])
        n = len(self.place)
        while n + len(made) + 1 > len(self.heads):
            self.heads = np.concatenate([self.heads, np.zeros_like(self.heads)])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : ends[-1]] = list(chain.from_iterable(made))
        self.heads[n + 1 : n + 1 + len(made)] = ends
        self.used = int(ends[-1])
        self.place.update(zip([*runs, *rest], range(n, n + len(made))))

    def ids(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): of the UTF-8 bytes between cuts, which lie at white space or between texts."""
        joined = np.insert(data, cuts[1:-1], 32) if len(cuts) > 2 else data
        kept, offsets = units(joined)
        names = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(kept))).dictionary_encode()
        which, words = names.indices.to_numpy(), names.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) + len(words) > _CACHED:
            self._forget()
        if new := [x for x in words if x not in self.place]:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        head, width = self.heads[at][which], (self.heads[at + 1] - self.heads[at])[which]
        ends = np.cumsum(width)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(head - (ends - width), width)
        # the first unit of each text: units start at bytes that are no space, counted up to the cut
        before = np.concatenate([[0], np.cumsum(_KINDS[data] > 0)])[cuts]
        unit = np.searchsorted(offsets[:-1], before)
        return self.flat[place], np.concatenate([[0], ends])[unit]


def _segments(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in parts that end at white space, if there is some."""
    i = 0
    while i < len(data):
        j = min(i + most, len(data))
        while j < len(data):
            near = np.flatnonzero(_KINDS[data[j : j + most]] == 0)
            if len(near):
                j += int(near[0])
                break
            j = min(j + most, len(data))
        yield data[i:j]
        i = j


def document_ids(column: pa.Array, coder: Coder, end: int = END) -> Iterator[np.ndarray]:
    """The ids of each text of a column, the end's id last; null texts are empty."""
    data, offsets = text_buffer(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SEGMENT, "right")) - 1)
        if j == i + 1:  # one text, however long
            parts = [coder.ids(x, np.array([0, len(x)]))[0] for x in _segments(data[offsets[i] : offsets[j]], _SEGMENT)]
            yield np.concatenate([*parts, np.array([end])]).astype("<u4")
        else:
            ids, cuts = coder.ids(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield np.append(ids[a:b], end).astype("<u4")
        i = j


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of docs(doc_id, text), each of at most `capacity` ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = path or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            out: list[tuple] = []
            for row, ids in enumerate(document_ids(batch.column(1), coder, end)):
                for p, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    out.append((row, p, a, len(part), zlib.crc32(part.tobytes())))
            row, p, a, n, crc = np.array(out, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(p.astype(np.int32)), pa.array(a), pa.array(n), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])
            trim()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---- packings: the bin of each piece, bins numbered from 0 ------------------


def best_fit(lengths: np.ndarray, bins: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """`bins` with the pieces of `order` put, one by one, where they leave the least room; bins are opened as needed."""
    bins = bins.copy()
    used = int(bins.max(initial=-1)) + 1
    there = bins >= 0
    left = capacity - np.bincount(bins[there], lengths[there], used).astype(np.int64)
    shift = len(lengths) + 1  # a bin's room and number as one sortable integer
    rooms = sorted((left * shift + np.arange(used)).tolist())
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        at = bisect_left(rooms, n * shift)
        if at < len(rooms):
            room, k = divmod(rooms.pop(at), shift)
        else:
            room, k, used = capacity, used, used + 1
        bins[i] = k
        if room > n:
            insort(rooms, (room - n) * shift + k)
    return bins


def falling(lengths: np.ndarray, which: np.ndarray, blur: np.ndarray | float = 1.0) -> np.ndarray:
    """The pieces `which`, longest first."""
    return which[np.argsort(-(lengths[which] * blur), kind="stable")]


def fitness(lengths: np.ndarray, bins: np.ndarray) -> tuple[int, int]:
    """Less is better: the number of bins, then minus the sum of squared fills."""
    fill = np.bincount(bins, lengths).astype(np.int64)
    return len(fill), -int((fill * fill).sum())


def cross(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A child of a with well-filled bins of b in it: whole bins of b and of a, and displaced pieces where they fit best."""
    fill = np.bincount(b, lengths)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = full[rng.random(len(full)) < 0.5]
    injected = np.isin(b, chosen)
    own = np.bincount(a, lengths)
    emptiest = np.argsort(own, kind="stable")[: 1 + len(own) // 50]
    dissolved = np.union1d(a[injected], emptiest)
    kept = ~injected & ~np.isin(a, dissolved)
    child = np.full(len(a), -1, np.int64)
    child[injected] = np.unique(b[injected], return_inverse=True)[1]
    child[kept] = int(child.max(initial=-1)) + 1 + np.unique(a[kept], return_inverse=True)[1]
    return best_fit(lengths, child, falling(lengths, np.flatnonzero(~injected & ~kept)), capacity)


def found(lengths: np.ndarray, rng: np.random.Generator, size: int, capacity: int) -> list[np.ndarray]:
    """A first population: best fit in falling order, and in blurred falling orders."""
    everything, none = np.arange(len(lengths)), np.full(len(lengths), -1, np.int64)
    packs = [best_fit(lengths, none, falling(lengths, everything), capacity)]
    while len(packs) < size and fitness(lengths, packs[0])[0] > -(-int(lengths.sum()) // capacity):
        packs.append(best_fit(lengths, none, falling(lengths, everything, rng.uniform(0.8, 1.2, len(lengths))), capacity))
    return packs


def evolve(lengths: np.ndarray, packs: list[np.ndarray], rng: np.random.Generator, children: int, size: int, capacity: int) -> list[np.ndarray]:
    """The population after some children, best first; it rests once its best meets the bound of whole tokens."""
    bound = -(-int(lengths.sum()) // capacity)
    ranked = sorted(((fitness(lengths, p), i, p) for i, p in enumerate(packs)), key=lambda x: x[:2])
    for c in range(children):
        if ranked[0][0][0] <= bound:
            break
        picks = np.sort(rng.integers(0, len(ranked), 4)).reshape(2, 2)[:, 0]  # two tournaments of two
        a, b = (ranked[i][2] for i in rng.permutation(picks))
        child = cross(lengths, a, b, rng, capacity)
        ranked = sorted([*ranked, (fitness(lengths, child), len(packs) + c, child)], key=lambda x: x[:2])[:size]
    return [p for _, _, p in ranked]


# ---- islands ----------------------------------------------------------------


def _lists(column: pa.Array) -> list[np.ndarray]:
    """A list column as arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    cuts, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_STATE = "shard long, island int, lengths array<int>, packs array<array<int>>, bins int, squares long"


def _islands(islands: DataFrame, round_: int, children: int, size: int, capacity: int) -> DataFrame:
    """Islands(shard, island, lengths, packs) one round later, best packing first; without packs they are founded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                shard, island = row.column(0)[0].as_py(), row.column(1)[0].as_py()
                lengths = _lists(row.column(2))[0].astype(np.int64)
                rng = np.random.Generator(np.random.PCG64([7, shard, island, round_]))
                packs = [p.astype(np.int64) for p in _lists(row.column(3).flatten())] or found(lengths, rng, size, capacity)
                packs = evolve(lengths, packs, rng, children, size, capacity)
                bins, squares = fitness(lengths, packs[0])
                yield pa.RecordBatch.from_arrays([
                    row.column(0), row.column(1), row.column(2), pa.array([[p.astype(np.int32) for p in packs]], pa.list_(pa.list_(pa.int32()))),
                    pa.array([bins], pa.int32()), pa.array([squares], pa.int64())], ["shard", "island", "lengths", "packs", "bins", "squares"])

    return islands.select("shard", "island", "lengths", "packs").mapInArrow(run, _STATE)


def _settled(best: DataFrame, last: bool, capacity: int) -> DataFrame:
    """(shard, bin, offset): the packing of each shard as arrays; bins that give their pieces back are -1 unless it is the last level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins_out, offsets_out = [], []
            for n, bins in zip(_lists(batch.column(1)), _lists(batch.column(2))):
                n, bins = n.astype(np.int64), bins.astype(np.int64)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(n[order])
                heads = np.searchsorted(bins[order], np.arange(bins.max() + 1))
                offset = np.empty(len(n), np.int64)
                offset[order] = ends - n[order] - (ends - n[order])[heads][bins[order]]
                if not last:
                    fill, held = np.bincount(bins, n), np.bincount(bins)
                    emptiest = np.argsort(fill, kind="stable")
                    back = emptiest[(np.cumsum(held[emptiest]) <= max(1, len(n) * GIVEN)) & (fill[emptiest] <= capacity - ROOM)]
                    bins = np.where(np.isin(bins, back), -1, bins)
                bins_out.append(bins)
                offsets_out.append(offset)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins_out, pa.list_(pa.int64())), pa.array(offsets_out, pa.list_(pa.int64()))], ["shard", "bin", "offset"])

    return best.select("shard", "lengths", "pack").mapInArrow(run, "shard long, bin array<long>, offset array<long>")


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, path: str | None = None, shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS,
         population: int = POPULATION, children: int = CHILDREN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): docs(doc_id, text) packed into sequences of at most `capacity` ids.

    Null and empty texts, and texts of white space, are the end's id alone.  Repeated rows
    and rows without an id are documents of their own.  A very long text is coded in parts
    that end at white space and gives as many pieces as it needs.  An empty table gives an
    empty result.  Other columns are not looked at.
    """
    if shard < 64:
        raise ValueError("a shard holds 64 pieces at least, so that levels shrink")
    shared = Shared(docs.sparkSession)
    made = shared.put(pieces(docs, capacity, end, path).withColumn("row", F.monotonically_increasing_id()), "pieces")
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    whole = made.where(F.col("length") >= capacity).select(*names, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    results, left, level = [whole], made.where(F.col("length") < capacity).select(names), 0
    while n := left.count():
        shards = -(-n // shard)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
        grouped = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("pieces"))
        grouped = shared.put(grouped, f"shards{level}")
        numbers = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
        state = grouped.select("shard", numbers, F.transform("pieces", lambda p: p["length"].cast("int")).alias("lengths"), F.array().cast("array<array<int>>").alias("packs"))
        for r in range(rounds):
            if r:  # the elite of an island moves on to the next
                moved = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.slice("packs", 1, 1).alias("elite"))
                state = state.join(moved, ["shard", "island"]).withColumn("packs", F.concat("packs", "elite"))
            state = shared.put(_islands(state.repartition("shard", "island"), r, children, population, capacity), f"islands{level}_{r}")
        best = state.groupBy("shard").agg(F.min_by(F.struct("lengths", F.element_at("packs", 1).alias("pack")), F.struct("bins", "squares", "island")).alias("b")).select("shard", "b.*")
        settled = grouped.join(_settled(best, shards == 1, capacity), "shard")
        rows = settled.select("shard", F.explode(F.arrays_zip("pieces", "bin", "offset")).alias("p")).select("shard", "p.pieces.*", "p.bin", "p.offset")
        rows = shared.put(rows, f"packed{level}")
        number = F.lit(level + 1) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 20) + F.col("bin")
        results.append(rows.where("bin >= 0").select(*names, number.alias("sequence_id"), "offset"))
        left, level = rows.where("bin < 0").select(names), level + 1
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens; `pack` states the cases."""
    return pack(read(spark, sf_dir, "documents"))
