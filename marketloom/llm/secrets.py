"""Secret scans with one combined, minimised deterministic automaton.

Every rule's regular expression is parsed into a position automaton; all rules
together go through subset construction and minimisation into one transition
array over byte classes, which reads each byte of a text once.  Where that scan
says that a rule ends a match, the rule's reversed automaton finds the leftmost
start (not before the rule's previous match) and its own automaton the longest
end.  Rules are regular expressions without look-around whose matches from one
start are found longest; for the rules below this is what leftmost greedy
matching finds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm.common import read, small, text_buffer

#: Kind, expression, group whose length is checked, least length.
#: The first three are the base kinds.  Expressions know literals, \xHH, classes,
#: groups, | ? + * {m} {m,} and (?i) at the front.
BASE_RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "value", 8),
    ("access", r"AKIA[A-Z0-9]+", "", 16),
    ("hex", r"[0-9a-f]{32,}", "", 32),
)
EXTRA_RULES = (
    ("private_key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----", "", 1),
    ("vcs_token", r"gh[pousr]_[A-Za-z0-9]+", "", 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", "", 15),
)
RULES = BASE_RULES + EXTRA_RULES
_VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


# ---- expressions -> nondeterministic automata -------------------------------

class _Parser:
    """Recursive descent into a Thompson automaton: edges[state] = [(bytes or None, state)]."""

    def __init__(self, pattern: str):
        self.fold = pattern.startswith("(?i)")
        self.p, self.i = pattern.removeprefix("(?i)"), 0
        self.edges: list[list] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def parse(self) -> tuple[int, int]:
        piece = self.either()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i:]!r}")
        return piece

    def either(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.p[self.i : self.i + 1] == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.state(), self.state()
        for x, y in parts:
            self.edges[a].append((None, x))
            self.edges[y].append((None, b))
        return a, b

    def sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            x, y = self.repeated()
            self.edges[b].append((None, x))
            b = y
        return a, b

    def repeated(self) -> tuple[int, int]:
        begin = self.i
        piece = self.atom()
        end, mark = self.i, self.p[self.i : self.i + 1]
        if mark in ("?", "*", "+") and mark:
            self.i += 1
            return self.loop(piece, mark)
        if mark == "{":
            close = self.p.index("}", self.i)
            least, _, most = self.p[self.i + 1 : close].partition(",")
            unbounded = "," in self.p[self.i : close] and not most
            if most and most != least:
                raise ValueError("only {m} and {m,} are known")
            out = piece
            for k in range(1, int(least)):
                self.i = begin
                x, y = self.atom()
                if unbounded and k == int(least) - 1:
                    x, y = self.loop((x, y), "+")
                self.edges[out[1]].append((None, x))
                out = out[0], y
            self.i = close + 1
            return out
        self.i = end
        return piece

    def loop(self, piece: tuple[int, int], mark: str) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.edges[a].append((None, piece[0]))
        self.edges[piece[1]].append((None, b))
        if mark in "?*":
            self.edges[a].append((None, b))
        if mark in "*+":
            self.edges[piece[1]].append((None, piece[0]))
        return a, b

    def atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            piece = self.either()
            if self.p[self.i] != ")":
                raise ValueError("unclosed group")
            self.i += 1
            return piece
        if c == "[":
            stop = self.p.index("]", self.i + 1)
            body, chars, k = self.p[self.i + 1 : stop], set(), 0
            while k < len(body):
                if k + 2 < len(body) and body[k + 1] == "-":
                    chars.update(range(ord(body[k]), ord(body[k + 2]) + 1))
                    k += 3
                else:
                    chars.add(ord(body[k]))
                    k += 1
            self.i = stop + 1
        elif c == "\\" and self.p[self.i + 1] == "x":
            chars = {int(self.p[self.i + 2 : self.i + 4], 16)}
            self.i += 4
        elif c in ".^$?*+{}\\":
            raise ValueError(f"{c!r} is not known here")
        else:
            chars = {ord(c)}
            self.i += 1
        if self.fold:
            chars = chars | {ord(chr(x).swapcase()) for x in chars if chr(x).isascii() and chr(x).isalpha()}
        a, b = self.state(), self.state()
        self.edges[a].append((frozenset(chars), b))
        return a, b


def _reversed(edges: list[list]) -> list[list]:
    out: list[list] = [[] for _ in edges]
    for a, row in enumerate(edges):
        for chars, b in row:
            out[b].append((chars, a))
    return out


# ---- nondeterministic -> minimal deterministic ------------------------------

class Automaton:
    """A deterministic automaton over byte classes.

    table[state * stride + class] is the next state times the stride; states
    from `first` on (times the stride) accept, and accepts[state] says which rules.
    State `start` is where a scan begins; `dead` (or -1) leads nowhere.
    """

    def __init__(self, parts: list[tuple[list[list], int, int]], searching: bool):
        edges, starts, finals = [], [], {}
        for rule, (rows, start, final) in enumerate(parts):
            base = len(edges)
            edges += [[(chars, b + base) for chars, b in row] for row in rows]
            starts.append(start + base)
            finals[final + base] = rule
        signature: list[list[int]] = [[] for _ in range(256)]
        sets = list({chars for row in edges for chars, _ in row if chars is not None})
        for k, chars in enumerate(sets):
            for c in chars:
                signature[c].append(k)
        names: dict[tuple, int] = {}
        self.classes = bytes(names.setdefault(tuple(s), len(names)) for s in signature)
        n_classes = len(names)
        sample = [self.classes.index(k) for k in range(n_classes)]

        @lru_cache(None)
        def closure(state: int) -> frozenset:
            seen, todo = {state}, [state]
            while todo:
                for chars, b in edges[todo.pop()]:
                    if chars is None and b not in seen:
                        seen.add(b)
                        todo.append(b)
            return frozenset(seen)

        begin = frozenset().union(*map(closure, starts))
        known, order, moves = {begin: 0}, [begin], []
        for subset in order:  # grows as it is read
            row = []
            for c in sample:
                to: frozenset = begin if searching else frozenset()
                for a in subset:
                    for chars, b in edges[a]:
                        if chars is not None and c in chars:
                            to |= closure(b)
                if to not in known:
                    known[to] = len(order)
                    order.append(to)
                row.append(known[to])
            moves.append(row)
        table = np.array(moves)
        accepts = [frozenset(finals[a] for a in subset if a in finals) for subset in order]
        # Moore's refinement: states stay together while their accepted rules and next blocks agree
        kinds = {a: i for i, a in enumerate(sorted(set(accepts), key=lambda a: (len(a), sorted(a))))}
        block = np.array([kinds[a] for a in accepts])
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        # number the blocks with accepting ones last
        first_of = {int(b): i for i, b in reversed(list(enumerate(block)))}
        blocks = sorted(first_of, key=lambda b: (bool(accepts[first_of[b]]), b))
        number = {b: i for i, b in enumerate(blocks)}
        self.stride = 1 << max(1, (n_classes - 1).bit_length())
        flat = np.zeros((len(blocks), self.stride), np.int64)
        for b, i in number.items():
            flat[i, :n_classes] = [number[int(block[t])] * self.stride for t in table[first_of[b]]]
        values = {int(v): int(v) for v in np.unique(flat)}
        self.table = [values[int(v)] for v in flat.ravel()]
        self.accepts = {i * self.stride: accepts[first_of[b]] for b, i in number.items() if accepts[first_of[b]]}
        self.first = min(self.accepts, default=len(blocks) * self.stride)
        self.start = number[int(block[0])] * self.stride
        dead = known.get(frozenset())
        self.dead = -1 if dead is None else number[int(block[dead])] * self.stride
        self.n_states = len(blocks)


class Scanner:
    """The combined automaton of some rules, and each rule's own one, forwards and backwards."""

    def __init__(self, rules: tuple = RULES):
        self.rules = rules
        parts = []
        for _, pattern, _, _ in rules:
            parser = _Parser(pattern)
            start, final = parser.parse()
            parts.append((parser.edges, start, final))
        self.combined = Automaton(parts, searching=True)
        self.forward = [Automaton([p], searching=False) for p in parts]
        self.backward = [Automaton([(_reversed(e), f, s)], searching=False) for e, s, f in parts]

    def events(self, data: bytes) -> list[tuple[int, int]]:
        """(end, state) wherever the combined automaton accepts, in one pass over the bytes."""
        a = self.combined
        table, first, state, out, end = a.table, a.first, a.start, [], 0
        for c in data.translate(a.classes):
            end += 1
            state = table[state + c]
            if state >= first:
                out.append((end, state))
        return out

    @staticmethod
    def _longest(automaton: Automaton, data: bytes) -> tuple[int, bool]:
        """The longest match from the first byte, and whether the automaton outlived the data."""
        state, best, n = automaton.start, 0, 0
        table, first, dead = automaton.table, automaton.first, automaton.dead
        for c in data.translate(automaton.classes):
            state = table[state + c]
            if state == dead:
                return best, False
            n += 1
            if state >= first:
                best = n
        return best, True

    def _rough(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        done = [0] * len(self.rules)
        for end, state in self.events(data):
            for rule in self.combined.accepts[state]:
                if end <= done[rule]:
                    continue
                back = self._back(rule, data, done[rule], end)
                if back:
                    start = end - back
                    stop = start + self._forth(rule, data, start)
                    done[rule] = stop
                    yield rule, start, stop

    def _back(self, rule: int, data: bytes, least: int, end: int) -> int:
        width = 256
        while True:  # most matches are short: look back further only while the automaton is still alive at the edge
            low = max(least, end - width)
            found, alive = self._longest(self.backward[rule], data[low:end][::-1])
            if low == least or not alive:
                return found
            width *= 8

    def _forth(self, rule: int, data: bytes, start: int) -> int:
        width = 256
        while True:  # as in _back
            found, alive = self._longest(self.forward[rule], data[start : start + width])
            if start + width >= len(data) or not alive:
                return found
            width *= 8

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, ordered by start and rule."""
        out = []
        for rule, start, stop in self._rough(data):
            _, _, part, least = self.rules[rule]
            length = stop - start
            if part == "value":  # the last run of value characters after the separator
                text = data[start:stop]
                cut = min(k for k in (text.find(b":"), text.find(b"=")) if k >= 0) + 1
                length = len(text[cut:].lstrip(b" ").lstrip(b"\"'")) if text[cut:].lstrip(b" ")[:1] in b"\"'" else len(text[cut:].lstrip(b" "))
            if length >= least:
                out.append((start, rule, stop))
        return sorted(out)


@lru_cache(4)
def scanner(rules: tuple = RULES) -> Scanner:
    """The compiled rules, once a process."""
    return Scanner(rules)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in code points."""
    if not spans:
        return []
    heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda k: int(heads[k - 1]) if k else 0
    return [(at(s), rule, at(e)) for s, rule, e in spans]


def _joined(spans: list[tuple[int, int, int]], rules: tuple) -> str:
    return ",".join(f"{rules[r][0]}:{s}:{e}" for s, r, e in spans)


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = text_buffer(column)
    view = memoryview(data)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield bytes(view[a:b])


def scan(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, counts of the base kinds, base_sha256 and spans.

    A null or empty text has no spans; its base_sha256 is that of nothing.
    Repeated rows each give a row; other columns are not looked at.  A text of any length
    is scanned whole, in one task; an empty table gives an empty result.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    n_base = len(BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for batch in batches:
            rows = []
            for data in _texts(batch.column(1)):
                found = code_points(data, machine.spans(data))
                base = [x for x in found if x[1] < n_base]
                counts = [sum(r == k for _, r, _ in base) for k in range(n_base)]
                rows.append((*counts, hashlib.sha256(_joined(base, rules).encode()).hexdigest(), _joined(found, rules)))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple = RULES, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """docs with each secret replaced by <kind>; overlapping spans are replaced as one, named after the first.

    Rows without secrets come back unchanged, null texts included.
    """
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    length_at = schema.fieldNames().index(count_col) if count_col in schema.fieldNames() else None

    def cleaned(data: bytes, machine: Scanner) -> bytes:
        out, done = [], 0
        for start, rule, stop in machine.spans(data):
            if stop <= done:
                continue
            if start >= done:
                out += [data[done:start], b"<" + rules[rule][0].encode() + b">"]
            done = stop
        return b"".join([*out, data[done:]]) if done else data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for batch in small(batches):
            valid = batch.column(at).is_valid().to_pylist()
            texts = [cleaned(d, machine).decode() if ok else None for d, ok in zip(_texts(batch.column(at)), valid)]
            columns = batch.columns
            if length_at is not None:
                old = batch.column(length_at).to_pylist()
                before = batch.column(at).to_pylist()
                columns[length_at] = pa.array([len(t) if t is not None and t != b else n for t, b, n in zip(texts, before, old)], batch.schema.field(length_at).type)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of all documents; `scan` states the cases."""
    return scan(read(spark, sf_dir, "documents"))
