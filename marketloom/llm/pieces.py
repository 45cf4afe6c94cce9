"""SentencePiece encoding and decoding with sampled segmentations.

A text gets a leading space, and its spaces become the space mark.  The lattice has
an edge for each vocabulary piece, and byte pieces for a character that is no piece.
Pieces do not span a space mark behind other text, so the lattice is a chain of
units: runs of marks with the word behind them, however long.  Equal units share
one lattice.  A segmentation's log-probability is the sum of its pieces' scores over a
temperature, normalised over the whole lattice by a backward pass.

Sampling without replacement gives every segmentation Gumbel noise and takes the k
largest, by A-star search from the top.  A search node is a prefix of pieces and a set
of pieces that may not follow it; its bound is the largest perturbed score below it, a
Gumbel number at the logarithm of the node's mass, truncated by its parent's bound.
Opening the node of largest bound gives the segmentation that attains it (drawn from
the node's distribution), and a new node for each of its steps: what differs there
first.  So the k largest come out exactly, in order.  All texts of a slice are
searched together, and every random number is a hash of the row's key, the round and
the place, so results do not depend on how rows are dealt.

The inclusion score of a result is log(p / q): p its probability, q the probability
that its perturbed score exceeds the (k + 1)-th largest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import mix, powers, read, trim

MARK = "▁"
#: Stands for a space mark that is in the text itself; no UTF-8 text holds it.
_OWN_MARK = 0xDC81
#: A node's forbidden pieces are bits of one integer, one for each length.
MOST_LENGTH = 62
SLICE_CHARS = 300_000
#: First new steps of a path that are looked at, and the range of the Gumbel numbers that `_uniform` can give.
WINDOW, LEAST_NOISE, MOST_NOISE = 48, -3.7, 36.8
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def default_model() -> str:
    """The installed public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """Pieces and their scores; the model ranks its pieces, so scores follow Zipf's law on the rank."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    piece_of: np.ndarray  # the piece that each node (a beginning of pieces; 0 is the empty one) is, or -1
    longest: int
    raw: np.ndarray  # what each piece writes, as bytes
    keys: np.ndarray  # a hash table of (node, next code point), -1 where nothing is, and the nodes that those lead to
    child: np.ndarray

    def follow(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The nodes that the code points lead to, -1 where no piece begins so."""
        key = node << 21 | point
        slot = _slot(key, len(self.keys))
        got = self.keys.take(slot)
        out = np.where(got == key, self.child.take(slot), -1)
        left = np.flatnonzero((got != key) & (got >= 0))
        while len(left):
            slot[left] = at = slot[left] + 1 & len(self.keys) - 1
            got, wanted = self.keys[at], key[left]
            hit = got == wanted
            out[left[hit]] = self.child[at[hit]]
            left = left[~hit & (got >= 0)]
        return out

    @staticmethod
    def load(path: str, temperature: float = 1.0) -> "Vocabulary":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        texts = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        plain = [i for i in plain if MARK not in texts[i].lstrip(MARK)]
        if max(len(texts[i]) for i in plain) > MOST_LENGTH:
            raise ValueError(f"pieces of more than {MOST_LENGTH} characters are not supported")
        scores = np.full(n, -2 * np.log(n + 1.0))
        scores[plain] = -np.log(np.arange(len(plain)) + 2.0) - np.log(np.log(n + 1.0))
        lengths = np.array([len(texts[i]) for i in plain])
        points = np.array([ord(c) for i in plain for c in texts[i]], np.int64)
        begin, node, piece_of, pairs = np.cumsum(lengths) - lengths, np.zeros(len(plain), np.int64), [np.full(1, -1)], []
        for k in range(int(lengths.max())):  # the nodes of k + 1 characters
            own = np.flatnonzero(lengths > k)
            known, of = np.unique(node[own] << 21 | points[begin[own] + k], return_inverse=True)
            node[own] = sum(map(len, piece_of)) + of
            ends = lengths[own] == k + 1
            whole = np.full(len(known), -1)
            whole[of[ends]] = np.array(plain)[own[ends]]
            pairs.append(known)
            piece_of.append(whole)
        pairs = np.concatenate(pairs)
        keys = np.full(1 << max(10, (4 * len(pairs)).bit_length()), -1)
        child = np.full(len(keys), -1)
        left, slot = np.arange(len(pairs)), _slot(pairs, len(keys))
        while len(left):  # a free slot goes to the first that asks for it
            put, first = np.unique(np.where(keys[slot] < 0, slot, -1), return_index=True)
            put, first = put[put >= 0], first[put >= 0]
            keys[put], child[put] = pairs[left[first]], left[first] + 1
            left, slot = np.delete(left, first), np.delete(slot, first)
            slot = np.where(keys[slot] >= 0, slot + 1 & len(keys) - 1, slot)
        byte_ids = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        raw = [t.replace(MARK, " ").encode() for t in texts]
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        written = np.empty(n, object)
        written[:] = raw
        return Vocabulary(texts, scores / temperature, byte_ids, np.concatenate(piece_of), int(lengths.max()), written, keys, child)


@lru_cache(2)
def vocabulary(path: str, temperature: float) -> Vocabulary:
    return Vocabulary.load(path, temperature)


def _sums(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + _C1) * powers(len(points) + 1)[0][: len(points)], out=out[1:])
    return out


def _spans(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    return mix((sums[start + length] - sums[start]) * powers(len(sums))[1][start] + np.asarray(length).astype(np.uint64) * _C2)


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    """Places in a hash table of a power of two slots."""
    return (key.view(np.uint64) * _C1 >> np.uint64(65 - size.bit_length())).view(np.int64)


def _scaled(turn: int, by: np.uint64) -> np.uint64:
    return np.uint64(turn * int(by) & 0xFFFFFFFFFFFFFFFF)


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each range, one range behind the other."""
    size = np.maximum(size, 0)
    return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class Search:
    """The lattices of some texts, and their k largest perturbed segmentations."""

    def __init__(self, v: Vocabulary, texts: list[str], seeds: np.ndarray):
        self.v, self.seeds, self.n_texts = v, seeds.astype(np.uint64), len(texts)
        mark = ord(MARK)
        rows = []
        for t in texts:
            p = np.frombuffer(t.encode("utf-32-le"), np.uint32).copy()
            p[p == mark] = _OWN_MARK
            p[p == 32] = mark
            rows.append(np.concatenate([[np.uint32(mark)], p]) if len(p) else p)
        self.points = np.concatenate(rows).astype(np.uint32) if rows else np.zeros(0, np.uint32)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        n = len(self.points)
        is_mark = self.points == mark
        start = is_mark & ~np.concatenate([[False], is_mark[:-1]])
        start[self.bounds[:-1][self.bounds[:-1] < n]] = True
        self.unit_at = np.flatnonzero(start)  # where each unit begins
        self.unit_end = np.append(self.unit_at[1:], n)
        sums = _sums(self.points)
        lengths = self.unit_end - self.unit_at
        _, first, kind = np.unique(_spans(sums, self.unit_at, lengths), return_index=True, return_inverse=True)
        by_length = np.argsort(-lengths[first], kind="stable")  # kinds are numbered from the longest
        number = np.empty(len(first), np.int64)
        number[by_length] = np.arange(len(first))
        self.unit_kind = number[kind]
        self._lattice(sums, self.unit_at[first[by_length]], lengths[first[by_length]])
        self.place_unit = np.repeat(np.arange(len(self.unit_at)), lengths)

    def _lattice(self, sums: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Edges and backward masses of the distinct units, longest first, a row for each of their characters.

        Rows lie by their distance to the unit's end, and for each distance by the unit: all
        units that reach so far lie together, and so do the rows that their pieces lead to.
        """
        v, n = self.v, int(length.sum())
        most = int(length.max(initial=0))
        reach = np.searchsorted(-length, -np.arange(1, most + 1), "right")  # units of at least each length
        self.first_row = np.concatenate([[0, 0], np.cumsum(reach)])  # of each distance, from 0
        room = np.repeat(np.arange(1, most + 1), reach)
        kind = np.arange(n) - self.first_row[room]
        at = start[kind] + length[kind] - room
        points = self.points.take(at)
        hits: list[tuple] = []
        live, node, ahead = np.arange(n), np.zeros(n, np.int64), at
        for k in range(1, min(v.longest, most) + 1):
            reaching = np.searchsorted(live, self.first_row[k])
            live, ahead = live[reaching:], ahead[reaching:]
            if not len(live):
                break
            node = v.follow(node[reaching:], self.points.take(ahead))
            known = np.flatnonzero(node >= 0)
            live, node, ahead = live.take(known), node.take(known), ahead.take(known) + 1
            ids = v.piece_of.take(node)
            whole = np.flatnonzero(ids >= 0)
            if len(whole):
                hits.append((k, live.take(whole), ids.take(whole)))
        width = max((k for k, _, _ in hits), default=1)
        self.piece = np.full((width, n), -1, np.int32)  # a line for each length
        score = np.full((width, n), -np.inf)
        for k, rows, ids in hits:
            self.piece[k - 1, rows] = ids
            score[k - 1, rows] = v.scores.take(ids)
        alone = score[0] == -np.inf  # such a character is written in bytes
        n_bytes = np.where(points == _OWN_MARK, 3, 1 + (points >= 0x80) + ((points >= 0x800) & (points != _OWN_MARK)) + (points >= 0x10000))
        self.piece[0, alone] = -2
        score[0, alone] = n_bytes[alone] * v.scores[v.byte_ids[0]]
        self.edges = alone.astype(np.int8)
        for _, rows, _ in hits:
            self.edges[rows] += 1
        # shares up to each length but the last, which is never passed; lines are filled up to whole words of 8 bytes
        back, cum = np.zeros(n), np.ones((n, max(8, -(-(width - 1) // 8) * 8)), np.float32)
        for d in range(1, most + 1):
            a, m = self.first_row[d], int(reach[d - 1])
            s = score[:d, a : a + m]
            for k in range(1, min(width, d - 1) + 1):
                s[k - 1] += back[self.first_row[d - k] : self.first_row[d - k] + m]
            top = s.max(0)
            above = (s - top).ravel()
            there = np.flatnonzero(above > -np.inf)
            share = np.zeros(s.shape)
            share.ravel()[there] = np.exp(above.take(there))
            for k in range(1, len(s)):
                share[k] += share[k - 1]
            back[a : a + m] = mass = top + np.log(share[-1])
            s -= mass
            share /= share[-1].copy()
            cum[a : a + m, : min(d, width - 1)] = share[: width - 1].T
        self.logs, self.cum = score, cum

    def _draw(self, text: np.ndarray, begin: np.ndarray, out: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
        """For each text, pieces from place `begin` on, the first none of the lengths in the bit set `out`.

        Returns (text, place, row, length - 1, log-probability) of every piece, in order; that of
        the first is relative to all its row's pieces.
        """
        spans = self.bounds[text + 1] - begin
        has = spans > 0
        text, begin, out, spans = text[has], begin[has], out[has], spans[has]
        first_unit = self.place_unit[begin] if len(begin) else begin
        last_unit = self.place_unit[self.bounds[text + 1] - 1] if len(text) else begin
        n_units = last_unit - first_unit + 1
        owner = np.repeat(np.arange(len(text)), n_units)
        unit = _ranges(first_unit, n_units)
        slot, kind, end = np.arange(len(unit)), self.unit_kind[unit], self.unit_end[unit]
        place = np.maximum(self.unit_at[unit], begin[owner]) if len(unit) else unit
        barred = np.zeros(len(unit), np.int64)
        barred[np.cumsum(n_units) - n_units] = out
        # the random number of a place: a hash of the row's seed, the turn and the place in its text
        seed = (mix(self.seeds[text] + _scaled(turn, _C2)) - self.bounds[text].astype(np.uint64) * _C1)[owner]
        widths, n_rows, most = np.arange(len(self.logs)), self.logs.shape[1], np.nextafter(np.float32(1), np.float32(0))
        got, taken = [], np.zeros(len(unit), np.int64)
        while len(slot):  # a piece of each unit
            row = self.first_row.take(end - place) + kind
            u = _uniform(mix(seed + place.astype(np.uint64) * _C1))
            level = np.minimum(u.astype(np.float32), most)
            # the first length whose share reaches beyond the level: as many do not, each a byte of 1
            pick = np.bitwise_count((self.cum.take(row, axis=0) <= level[:, None]).view(np.uint64)).sum(1, dtype=np.int64)
            special = np.flatnonzero(barred) if not got else barred[:0]
            if len(special):
                p = np.exp(self.logs[:, row[special]].T)
                p[(barred[special][:, None] >> widths) & 1 == 1] = 0
                cum = np.cumsum(p, axis=1).astype(np.float32)
                level = np.minimum((u[special] * cum[:, -1]).astype(np.float32), np.nextafter(cum[:, -1], np.float32(0)))
                pick[special] = (cum <= level[:, None]).sum(1)
            got.append((slot, place, row, pick, self.logs.ravel().take(pick * n_rows + row)))
            taken[slot] += 1
            place = place + pick + 1
            more = np.flatnonzero(place < end)
            slot, kind, end, place, seed = (c.take(more) for c in (slot, kind, end, place, seed))
        begins = np.cumsum(taken) - taken
        made = [np.empty(int(taken.sum()), np.int64) for _ in range(4)] + [np.empty(int(taken.sum()))]
        for step, (slot, *columns) in enumerate(got):
            at = begins[slot] + step
            made[0][at] = text[owner[slot]]
            for column, values in zip(made[1:], columns):
                column[at] = values
        return tuple(made)

    def _candidates(self, path: tuple, low: np.ndarray, size: np.ndarray, sums: np.ndarray, heads: np.ndarray, begin: np.ndarray, out: np.ndarray, wanted: int) -> tuple[np.ndarray, ...]:
        """The new steps of each text at which the `wanted` best nodes can lie: steps, locations and forbidden lengths.

        Order is by location plus Gumbel noise, which lies between LEAST_NOISE and MOST_NOISE.
        A location is at most its prefix's log-probability, and that only falls along a path; so
        no step counts whose prefix lies that far below the `wanted`-th best location.  A
        window of first steps shows that location; texts whose window is too short are read whole.
        """
        text, place, row, pick, log = path

        def located(new: np.ndarray) -> tuple[np.ndarray, ...]:
            of = text[new]
            before = sums[new] - sums[heads[of]]
            barred = np.where(place[new] == begin[of], out[of], 0) | (1 << pick[new])
            rest = np.where(self.edges[row[new]] > 1, -np.expm1(log[new]), 0.0)
            several = np.flatnonzero(barred & (barred - 1))
            p = np.exp(self.logs[:, row[new[several]]].T)
            p[(barred[several][:, None] >> np.arange(p.shape[1])) & 1 == 1] = 0
            rest[several] = p.sum(1)
            live = rest > 0
            return new[live], before[live] + np.log(rest[live]), barred[live]

        step = np.minimum(size, WINDOW)
        found = [located(_ranges(low, step))]
        of, spare, best = text[found[0][0]], found[0][1].copy(), np.full(self.n_texts, np.inf)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        count = np.diff(np.append(first, len(of)))
        for _ in range(wanted if len(of) else 0):  # the wanted-th best location of the first window, -inf if there are fewer
            top = np.maximum.reduceat(spare, first)
            best[of[first]] = top
            hit = np.flatnonzero(spare == np.repeat(top, count))
            spare[hit[np.flatnonzero(np.diff(of[hit], prepend=-1))]] = -np.inf
        best[np.setdiff1d(np.arange(self.n_texts), of)] = -np.inf
        left, window = size - step, 4 * WINDOW
        while wanted and left.any():
            low = low + step
            left = np.where(sums[low] - sums[heads] + MOST_NOISE >= best + LEAST_NOISE, left, 0)
            step = np.minimum(left, window)
            found.append(located(_ranges(low, step)))
            left, window = left - step, 4 * window
        found = [np.concatenate(c) for c in zip(*found)]
        order = np.argsort(found[0], kind="stable")
        return tuple(c[order] for c in found)

    def run(self, k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text up to k results: ids, log-probability, perturbed score, inclusion score."""
        n = self.n_texts
        every = np.arange(n)
        noise = _uniform(mix(self.seeds + _C3))
        frontier = {"text": every, "bound": -np.log(-np.log(noise)), "begin": self.bounds[:-1].copy(), "mass": np.zeros(n), "out": np.zeros(n, np.int64), "path": np.full(n, -1)}
        paths: list[tuple] = []  # of each round: (text, place, row, pick, log) ordered by place, and each text's bound, total
        wanted = k + 1
        for turn in range(k):
            if not len(frontier["text"]):
                break
            order = np.lexsort((-frontier["bound"], frontier["text"]))
            lead = order[np.concatenate([[True], np.diff(frontier["text"][order]) > 0])]
            node = {name: c[lead] for name, c in frontier.items()}
            keep = np.setdiff1d(np.arange(len(order)), lead)
            frontier = {name: c[keep] for name, c in frontier.items()}
            drawn = self._draw(node["text"], node["begin"], node["out"], turn)
            steps = [drawn]
            for t in range(turn):  # the pieces before the place where the new paths leave their parents
                own = node["path"] == t
                if own.any():
                    old = paths[t][0]
                    low = np.searchsorted(old[1], self.bounds[node["text"][own]])
                    use = _ranges(low, np.searchsorted(old[1], node["begin"][own]) - low)
                    steps.append(tuple(c[use] for c in old))
            merged = [np.concatenate(c) for c in zip(*steps)]
            if len(steps) > 1:
                place_order = np.argsort(merged[1], kind="stable")
                merged = [c[place_order] for c in merged]
            path = tuple(merged)
            text, place, row, pick, log = path
            sums = np.concatenate([[0.0], np.cumsum(log)])
            heads, tails = np.searchsorted(place, self.bounds[:-1]), np.searchsorted(place, self.bounds[1:])
            total = sums[tails] - sums[heads]
            bound, begin, out = np.full(n, -np.inf), np.zeros(n, np.int64), np.zeros(n, np.int64)
            bound[node["text"]], begin[node["text"]], out[node["text"]] = node["bound"], node["begin"], node["out"]
            there = np.zeros(n, bool)
            there[node["text"]] = True
            paths.append((path, bound, total, there))
            # what differs from this path first at each of its new steps
            low = np.searchsorted(place, np.maximum(begin, self.bounds[:-1]))
            new = self._candidates(path, low, np.where(there, tails - low, 0), sums, heads, begin, out, wanted - turn - 1)
            new, location, barred = new
            u = _uniform(mix(mix(self.seeds[text[new]] + _scaled(turn + 1, _C3)) + (place[new] - self.bounds[text[new]]).astype(np.uint64) * _C2))
            value = location - np.logaddexp(location - bound[text[new]], np.log(-np.log(u)))  # truncated at the bound
            # only as many nodes as results are still wanted can be opened; those of a path lie in order of their texts
            spare, best = value.copy(), []
            first = np.flatnonzero(np.concatenate([[True], np.diff(text[new]) > 0])) if len(new) else new
            sizes = np.diff(np.append(first, len(new)))
            for _ in range(wanted - turn - 1):
                if not len(new):
                    break
                top = np.repeat(np.maximum.reduceat(spare, first), sizes)
                hit = np.flatnonzero((spare == top) & (top > -np.inf))
                hit = hit[np.concatenate([[True], np.diff(text[new[hit]]) > 0])] if len(hit) else hit
                best.append(hit)
                spare[hit] = -np.inf
            at = np.concatenate(best) if best else np.zeros(0, np.int64)
            child = {"text": text[new[at]], "bound": value[at], "begin": place[new[at]], "mass": location[at], "out": barred[at], "path": np.full(len(at), turn)}
            frontier = {name: np.concatenate([frontier[name], child[name]]) for name in frontier}
            order = np.lexsort((-frontier["bound"], frontier["text"]))
            heads_of = np.concatenate([[True], np.diff(frontier["text"][order]) > 0]) if len(order) else np.zeros(0, bool)
            at = np.arange(len(order))
            rank = at - np.maximum.accumulate(np.where(heads_of, at, 0))
            best = order[rank < wanted - turn - 1]
            frontier = {name: c[best] for name, c in frontier.items()}
        # the largest bound that is left is the (k + 1)-th score: its path need not be drawn
        threshold = np.full(n, -np.inf)
        np.maximum.at(threshold, frontier["text"], frontier["bound"])
        out_rows: list[list] = [[] for _ in range(n)]
        for (path, bound, total, there) in paths:
            text, place, row, pick, _ = path
            ids = self.piece.ravel().take(pick * self.piece.shape[1] + row)
            heads, tails = np.searchsorted(place, self.bounds[:-1]), np.searchsorted(place, self.bounds[1:])
            ids, at = self._with_bytes(ids, place)
            heads, tails = at[heads], at[tails]
            for t in np.flatnonzero(there):
                own = ids[heads[t] : tails[t]]
                q = 1.0 if threshold[t] == -np.inf else -np.expm1(-np.exp(min(total[t] - threshold[t], 700.0)))
                out_rows[t].append((own, float(total[t]), float(bound[t]), float(total[t] - np.log(max(q, 1e-300)))))
        return out_rows

    def _with_bytes(self, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with byte pieces in the place of characters that are no piece, and where each of the ids (and their end) went."""
        alone = np.flatnonzero(ids == -2)
        points = self.points[place[alone]]
        points[points == _OWN_MARK] = ord(MARK)
        raw = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
        width = np.ones(len(ids), np.int64)
        width[alone] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        out = np.repeat(ids, width)
        out[out == -2] = self.v.byte_ids[raw]
        return out, np.concatenate([[0], np.cumsum(width)])


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text that any segmentation came from."""
    return b"".join(v.raw[ids].tolist()).decode(errors="replace")[1:]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_CHARS bytes (a longer text stands alone)."""
    sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float))
    begin, size = 0, 0.0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > SLICE_CHARS:
            yield begin, i
            begin, size = i, 0.0
        size += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _segmented(batches: Iterator[pa.RecordBatch], v: Vocabulary, k: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The results of batches of (doc_id, seed, text)."""
    for batch in batches:
        for a, b in _slices(batch.column(2)):
            yield _coded(batch.slice(a, b - a), v, k, with_ids)
        trim()  # the slices of a batch use the same memory again


def _coded(batch: pa.RecordBatch, v: Vocabulary, k: int, with_ids: bool) -> pa.RecordBatch:
    texts = batch.column(2).to_pylist()
    there = [i for i, text in enumerate(texts) if text is not None]
    out: list[tuple] = [(i, 0, *[None] * 6) for i, text in enumerate(texts) if text is None]
    results = Search(v, [texts[i] for i in there], batch.column(1).to_numpy().view(np.uint64)[there]).run(k)
    for i, found in zip(there, results):
        for s, (ids, logp, perturbed, inclusion) in enumerate(found):
            out.append((i, s + 1, len(ids), round(logp, 9), round(perturbed, 9), round(inclusion, 9), decode(ids, v) == texts[i], ids.astype(np.int32) if with_ids else hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()))
    c = list(zip(*out)) if out else [[]] * 8
    return pa.RecordBatch.from_arrays([
        batch.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()),
        *[pa.array(x, pa.float64()) for x in c[3:6]], pa.array(c[6], pa.bool_()), pa.array(c[7], pa.list_(pa.int32()) if with_ids else pa.string())],
        ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "round_trip", "ids" if with_ids else "ids_sha256"])


def encode(docs: DataFrame, k: int = 2, temperature: float = 1.0, path: str | None = None, with_ids: bool = True, seed: int = 11) -> DataFrame:
    """Up to k distinct segmentations of each row of docs(doc_id, text), seeded by doc_id.

    Returns doc_id, sample (from 1, by perturbed score), n_pieces, log_prob, perturbed,
    inclusion, round_trip (decoding gives the text back) and ids, or with_ids=False
    ids_sha256 (of little-endian int32).  An empty text has one segmentation without
    pieces; a null text has none, and gives one row with sample 0 and nulls.  Repeated
    rows give equal results.  A long text is one lattice in one task, so memory grows with the
    longest text; an empty table gives an empty result.  Other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    path = path or default_model()
    last = "ids array<int>" if with_ids else "ids_sha256 string"

    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return docs.select("doc_id", key.alias("seed"), "text").mapInArrow(lambda batches: _segmented(batches, vocabulary(path, temperature), k, with_ids), f"doc_id {id_type}, sample int, n_pieces int, log_prob double, perturbed double, inclusion double, round_trip boolean, {last}")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, their ids as a digest; `encode` states the cases."""
    return encode(read(spark, sf_dir, "documents"), with_ids=False)
