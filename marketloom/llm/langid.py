"""Language ID by hierarchical discrimination.

Texts are bytes with ASCII letters lower-cased and every other ASCII byte a
space; their 2-, 3- and 4-grams are hashed.  One-versus-one linear support vector
machines (squared hinge) first tell language families apart, then the languages
within the winning family.  All machines share one table of weights, so a text is
read once.  Families are a fixed table; a language outside it is its own family.

The machines always name a learned language.  Whether a text is in any of them is
another question: a language's typical 2-grams are those that make up TYPICAL of its
sample or more, and a text is `known` by the share of its 2-grams that are typical of
the predicted language.  `accept` rejects a text below KNOWN_SHARE of the share that
half of the language's sample reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import crc_remainder, read, slices, small, text_buffer, trim

#: Families of language codes.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "sk": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}
ORDERS = (2, 3, 4)
BUCKETS = 1 << 12
#: The fit takes about so many documents of a language at most, chosen by a hash of the text.
PER_LANGUAGE = 400
FOLDS, HELD_OUT = 4, 2
TYPICAL, KNOWN_SHARE = 2e-4, 0.6
UNDETERMINED = "und"
_SLICE = 256 << 10
_BYTES = np.full(256, 32, np.uint32)
_BYTES[[*range(65, 91), *range(97, 123)]] = [*range(97, 123), *range(97, 123)]
_BYTES[128:] = range(128, 256)


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the gram that begins at each byte (the last ones wrap into padding)."""
    b = _BYTES[data]
    padded = np.concatenate([b, np.full(max(ORDERS), 32, np.uint32)])
    n = len(b)
    for k in ORDERS:
        h = np.full(n, k, np.uint32)
        for i in range(k):
            h = (h ^ padded[i : i + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield (h >> np.uint32(12)) & np.uint32(BUCKETS - 1)


def parts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(column)
    for i, j in slices(offsets, _SLICE):
        part = offsets[i : j + 1]
        yield i, j, data[part[0] : part[-1]], part - part[0]
    trim()


def vectors(column: pa.Array) -> Iterator[np.ndarray]:
    """Gram shares of each text: BUCKETS columns an order."""
    for i, j, data, offsets in parts(column):
        doc = np.repeat(np.arange(j - i), np.diff(offsets))
        rows = [np.bincount(doc * BUCKETS + h, minlength=(j - i) * BUCKETS).reshape(j - i, BUCKETS) for h in grams(data)]
        yield from np.hstack(rows) / np.maximum(np.diff(offsets), 1)[:, None]


def svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 80) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge, classes weighed alike) by accelerated gradient steps."""
    y = y.astype(np.float32)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    xb = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    v = np.random.Generator(np.random.PCG64(1)).normal(size=xb.shape[1]).astype(np.float32)
    for _ in range(12):  # the largest curvature
        v = xb.T @ (c * (xb @ v))
        v /= np.linalg.norm(v) or 1
    rate = np.float32(1 / (2 * float(v @ (xb.T @ (c * (xb @ v)))) * 1.05 + ridge + 1e-12))
    w = z = np.zeros(xb.shape[1], np.float32)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (xb @ z))
        new = z - rate * (np.float32(ridge) * z - 2 * ((c * y * slack) @ xb))
        z, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Duels between families, then between languages: (level, first, second) with weights and offset."""

    families: dict[str, list[str]]
    duels: list[tuple[str, str, str]]
    weights: np.ndarray  # duel x (order, bucket)
    offsets: np.ndarray
    typical: dict[str, np.ndarray]  # for each language, which buckets of 2-grams are typical
    usual: dict[str, float]  # and the share of them that half of the sample reaches

    def known(self, data: np.ndarray, bounds: np.ndarray, languages: list[str]) -> np.ndarray:
        """Each text's share of typical 2-grams of its language, over the usual share."""
        h = next(grams(data))
        out, said = np.zeros(len(languages)), np.array(languages, object)
        for name, buckets in self.typical.items():
            own = np.flatnonzero(said == name)
            sums = np.concatenate([[0], np.cumsum(buckets[h])]) if len(own) else np.zeros(1)
            out[own] = (sums[bounds[own + 1]] - sums[bounds[own]]) / np.maximum(bounds[own + 1] - bounds[own], 1) / max(self.usual[name], 1e-9)
        return out

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """text x duel."""
        n = np.maximum(np.diff(bounds), 1)
        out = np.tile(self.offsets, (len(n), 1))
        tables = self.weights.reshape(len(self.duels), len(ORDERS), BUCKETS)
        for k, h in enumerate(grams(data)):
            for d in range(len(self.duels)):
                sums = np.concatenate([[0.0], np.cumsum(tables[d, k][h])])
                out[:, d] += (sums[bounds[1:]] - sums[bounds[:-1]]) / n
        return out

    def _winner(self, margins: np.ndarray, level: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The name with most won duels (ties: larger summed margins, then order) and its least duel's probability."""
        wins, sums, sure = (np.zeros((len(margins), len(names))) for _ in range(3))
        sure += 1
        for d, (at, a, b) in enumerate(self.duels):
            if at == level:
                for name, m in ((a, margins[:, d]), (b, -margins[:, d])):
                    k = names.index(name)
                    wins[:, k] += m > 0
                    sums[:, k] += m
                    sure[:, k] = np.minimum(sure[:, k], 1 / (1 + np.exp(-3 * np.clip(m, -20, 20))))
        best = np.argmax(wins + 1e-3 * np.tanh(sums), axis=1)
        return best, sure[np.arange(len(best)), best]

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        names = sorted(self.families)
        if not names:
            return [UNDETERMINED] * len(margins), np.zeros(len(margins))
        family, p = self._winner(margins, "", names)
        language, score = np.empty(len(margins), object), p.copy()
        for k, name in enumerate(names):
            own = np.flatnonzero(family == k)
            members = self.families[name]
            best, q = self._winner(margins[own], name, members)
            language[own] = np.array(members, object)[best]
            score[own] *= q
        return language.tolist(), score


def fit(docs: DataFrame, families: dict[str, str] | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Machines from docs(doc_id, text, lang) outside the held-out fold with a language and a letter."""
    families = FAMILIES if families is None else families
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.where(F.coalesce(crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(True)))
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # held-out rows take no part in anything
    share = F.lit(0.0)
    for lang, n in known.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang in enumerate(batch.column(0).to_pylist()):
                for v in vectors(batch.column(1).slice(i, 1)):
                    at = np.flatnonzero(v)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.int32).tobytes()]), pa.array([v[at].astype(np.float32).tobytes()])], ["lang", "at", "v"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["v"])) for r in sample.mapInArrow(run, "lang string, at binary, v binary").collect())
    x = np.zeros((len(got), len(ORDERS) * BUCKETS), np.float32)
    for k, (_, at, v) in enumerate(got):
        x[k, np.frombuffer(at, np.int32)] = np.frombuffer(v, np.float32)
    lang = np.array([g[0] for g in got], object)
    del got
    typical = {name: x[lang == name, :BUCKETS].mean(axis=0) >= TYPICAL for name in sorted(set(lang))}
    usual = {name: float(np.median(x[lang == name, :BUCKETS] @ typical[name].astype(np.float32))) for name in typical}
    used = x.any(axis=0)
    scale = (1 / np.sqrt(x.mean(0) + 1e-5)).astype(np.float32) if len(x) else np.ones(x.shape[1], np.float32)
    x = x[:, used] * scale[used]
    groups: dict[str, list[str]] = {}
    for name in sorted(set(lang)):
        groups.setdefault(families.get(name, f"other:{name}"), []).append(name)
    kin = np.array([families.get(name, f"other:{name}") for name in lang], object)
    duels = [("", a, b) for a, b in combinations(sorted(groups), 2)] + [(g, a, b) for g in sorted(groups) for a, b in combinations(groups[g], 2)]
    weights, offsets = np.zeros((len(duels), len(ORDERS) * BUCKETS)), np.zeros(len(duels))
    for d, (level, a, b) in enumerate(duels):
        side = kin if level == "" else lang
        own = (side == a) | (side == b)
        w, offsets[d] = svm(x[own], np.where(side[own] == a, 1.0, -1.0).astype(np.float32))
        weights[d, used] = w * scale[used]
    return Model(groups, duels, weights, offsets, typical, usual)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score; `und` and 0 where the text is null or has no letter.

    Repeated rows each give a row; a model without languages gives `und` everywhere.  A
    text of any length is read whole, in one task; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    d = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, langs, scores = batch.column(len(keep)), [], []
            for _, _, data, bounds in parts(column):
                lang, score = model.predict(model.margins(data, bounds))
                langs += lang
                scores.append(score)
            there = np.array(column.is_valid(), bool)
            langs = [x if ok else UNDETERMINED for x, ok in zip(langs, there)]
            s = np.where(there, np.concatenate(scores) if scores else np.zeros(0), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(s)], [*keep, "lang_pred", "score"])

    return d.mapInArrow(run, f"{fields}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float = KNOWN_SHARE) -> DataFrame:
    """The rows of docs that are in a learned language; columns as they were, whatever their names.

    Null texts and texts without a letter go, and those in none of the languages: see the
    module's docstring.  Repeated rows are judged alike; a model without languages keeps none.
    """
    at = docs.columns.index("text")
    valid = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keep = [model.known(data, bounds, model.predict(model.margins(data, bounds))[0]) >= least for _, _, data, bounds in parts(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return valid.mapInArrow(run, docs.schema) if model.families else docs.limit(0)


def op3_language(spark, sf_dir: str) -> DataFrame:
    """The language of every text of documents; `fit` and `predict` state the cases.

    A text of any length is read whole; an empty table gives an empty result.
    """
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", held, "text"), fit(docs), ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
