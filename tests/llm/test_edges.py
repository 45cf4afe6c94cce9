"""Long texts, ties, repeated rows, null ids and empty tables, where the other tests have none."""

import collections
import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import fingerprints, langid, mixing, pieces

DOCS = "doc_id long, text string, lang string, source string"


def words(seed, n):
    rng = np.random.Generator(np.random.PCG64(seed))
    return " ".join(f"w{i}" for i in rng.integers(0, 500, n))


def test_mixing_of_tied_keys_long_texts_and_nothing(spark):
    rows = [(1, "a b c", "en", "x")] * 40 + [(2, "word " * 200_000, "en", "y"), (3, None, "en", "y"), (4, "", "en", None), (5, "one", "en", None)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(rows)
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        key = r["source_size"]
        taken[key] += r["taken"]
        size[key] += r["size"]
        target[key] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert size == {120: 120, 200_000: 200_000, 1: 1}
    for key, t in target.items():
        assert abs(taken[key] - t) < 1
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(5)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []


def test_mixing_picks_by_the_keys(spark):
    """Within a source documents are taken in the order of their keys: no document left out has a smaller key than one taken."""
    rows = [(i, words(i, 5 + i % 9), "en", "big") for i in range(300)] + [(1000 + i, words(i, 3), "en", "small") for i in range(30)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    u = (F.xxhash64(F.col("doc_id"), F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    keys = {r["doc_id"]: r["k"] for r in df.select("doc_id", (-F.log(u) / mixing.quality_weight(F.col("text"))).alias("k")).collect()}
    for group in (lambda i: i < 1000, lambda i: i >= 1000):
        own = [r for r in mixing.mix(df).collect() if group(r["doc_id"])]
        epochs = min(r["taken"] // r["size"] for r in own)
        more = [keys[r["doc_id"]] for r in own if r["taken"] > epochs * r["size"]]
        rest = [keys[r["doc_id"]] for r in own if r["taken"] == epochs * r["size"]]
        assert not more or not rest or max(more) <= min(rest)


def test_language_of_a_text_beyond_a_slice_and_of_an_empty_table(spark):
    stems = {"en": "the with thing ", "de": "der nicht schule ", "fr": "le avec chose "}
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(i, " ".join(rng.permutation(stems[k].split() * 6)), k, "s") for i, k in enumerate(rng.choice(list(stems), 240).tolist())]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    long = [(9001, stems["de"] * 40_000, None, "s"), (9002, stems["fr"], None, "s"), (9003, "12 34", None, "s"), (9004, None, None, "s")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(spark.createDataFrame(long, DOCS), model).collect()}
    assert got == {9001: "de", 9002: "fr", 9003: "und", 9004: "und"}
    assert langid.predict(spark.createDataFrame([], DOCS), model).collect() == []
    assert langid.fit(spark.createDataFrame([], DOCS)).families == {}


def test_a_machine_separates_as_a_plain_solver_does():
    """The squared hinge with the same ridge and class weights, by many plain gradient steps."""
    rng = np.random.Generator(np.random.PCG64(5))
    x = np.vstack([rng.normal(0.4, 1, (60, 6)), rng.normal(-0.4, 1, (30, 6))]).astype(np.float32)
    y = np.where(np.arange(90) < 60, 1.0, -1.0)
    w, b = langid.svm(x, y, ridge=0.05, steps=400)
    xb, c = np.column_stack([x.astype(float), np.ones(90)]), np.where(y > 0, 0.5 / 60, 0.5 / 30)
    v = np.zeros(7)
    for _ in range(60_000):
        slack = np.maximum(0, 1 - y * (xb @ v))
        v -= 0.05 * (0.05 * v - 2 * (c * y * slack) @ xb)
    assert np.allclose(np.append(w, b), v, atol=2e-3)


def test_fingerprints_of_repeated_null_and_long_rows(spark):
    rows = [(1, words(1, 50), "en", "s"), (2, words(2, 400_000), "en", "s"), (3, "b second", "en", "s"), (3, "a first", "en", "s"), (3, "a first", "en", "s"), (None, "no id", "en", "s"), (None, None, "en", "s"), (9, None, "en", "s")]
    got = fingerprints.edited(spark.createDataFrame(rows, DOCS).repartition(3), ranges=3).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    edit = lambda t, after: hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()
    assert by[1][0]["edited_sha256"] == edit(rows[0][1], rows[1][1]) and by[2][0]["n_chars"] == len(rows[1][1])
    # rows of one id follow each other in some order, the last of them is followed by the next id
    threes = ["b second", "a first", "a first"]
    orders = [tuple(sorted(edit(t, a) for t, a in zip(p, [*p[1:], ""]))) for p in itertools.permutations(threes)]
    assert tuple(sorted(r["edited_sha256"] for r in by[3])) in orders
    assert len({r["fingerprint"] for r in by[3]}) == 2 and len(by[None]) == 2
    again = fingerprints.edited(spark.createDataFrame(rows[::-1], DOCS).repartition(2), ranges=3).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert fingerprints.edited(spark.createDataFrame([], DOCS)).collect() == []


def test_pieces_of_a_text_beyond_a_slice(spark):
    rows = [(1, words(3, 120_000), "en", "s"), (2, "small text", "en", "s"), (2, "small text", "en", "s"), (3, None, "en", "s")]
    assert len(rows[0][1]) > pieces.SLICE_CHARS
    got = [r for r in pieces.encode(spark.createDataFrame(rows, DOCS), k=2, with_ids=False).collect()]
    assert all(r["round_trip"] for r in got if r["doc_id"] != 3) and len([r for r in got if r["doc_id"] == 1]) == 2
    twos = collections.Counter(tuple(r) for r in got if r["doc_id"] == 2)
    assert set(twos.values()) == {2}
    assert pieces.encode(spark.createDataFrame([], DOCS)).collect() == []


def test_slices_of_a_batch_use_the_same_memory_again(monkeypatch):
    """Memory goes back once a batch: what each slice gives back, the next one pays for anew, page by page."""
    calls = []
    monkeypatch.setattr(pieces, "trim", lambda: calls.append(1))
    monkeypatch.setattr(pieces, "SLICE_CHARS", 100)
    texts = [words(i, 30) for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(range(12)), pa.array(texts)], ["doc_id", "seed", "text"])
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    out = list(pieces._segmented(iter([batch, batch]), v, 2, True))
    assert len(out) > 2 and len(calls) == 2
    rows = [r for b in out for r in b.to_pylist()]
    assert len(rows) == 48 and all(r["round_trip"] for r in rows)


def test_beginnings_of_pieces_are_followed_exactly():
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    plain = {v.texts[i]: i for i in v.piece_of[v.piece_of >= 0].tolist()}
    known = {t[:n] for t in plain for n in range(1, len(t) + 1)}
    assert len(known) == len(v.piece_of) - 1 and max(map(len, plain)) == v.longest
    points = {ord(c) for t in plain for c in t}
    r = np.random.Generator(np.random.PCG64(5))
    some = sorted(plain)[:: max(1, len(plain) // 3000)]
    some += ["".join(map(chr, r.choice(sorted(points), 4))) for _ in range(2000)] + ["▁theq", "then\U0010ffff", "\U0010ffff", "▁▁q"]
    node, live = np.zeros(len(some), np.int64), np.arange(len(some))
    for k in range(v.longest):
        live = np.array([i for i in live if len(some[i]) > k and node[i] >= 0], np.int64)
        node[live] = v.follow(node[live], np.array([ord(some[i][k]) for i in live], np.uint32))
        for i in live:
            assert (node[i] >= 0) == (some[i][: k + 1] in known)
            assert node[i] < 0 or v.piece_of[node[i]] == plain.get(some[i][: k + 1], -1)


def test_byte_pieces_stay_with_their_texts():
    texts = ["\n", "", "a\n\U0001f9ff\n", "▁", "\u0378x\u0378", "plain words"]
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    for text, found in zip(texts, pieces.Search(v, texts, np.arange(len(texts), dtype=np.uint64)).run(3), strict=True):
        assert found and all(pieces.decode(ids, v) == text for ids, *_ in found)


def test_inclusion_scores_weigh_draws_to_probabilities():
    """exp(score) is p over the probability of being drawn: its sum over draws, where a segmentation is drawn, estimates p."""
    text, k, draws = "banana band", 3, 6000
    weight, logp = collections.Counter(), {}
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    seeds = np.random.Generator(np.random.PCG64(1)).integers(1, 2**63, draws, dtype=np.uint64)
    for found in pieces.Search(v, [text] * draws, seeds).run(k):
        assert len({tuple(ids.tolist()) for ids, *_ in found}) == len(found)
        for ids, lp, _, score in found:
            weight[tuple(ids.tolist())] += math.exp(score)
            logp[tuple(ids.tolist())] = lp
    top = sorted(logp, key=lambda s: -logp[s])[:3]
    for s in top:
        assert weight[s] / draws == pytest.approx(math.exp(logp[s]), rel=0.12)


def test_text_columns_of_any_arrow_kind():
    for kind in (pa.string(), pa.large_string()):
        data, offsets = langid.text_buffer(pa.chunked_array([pa.array(["a", None, "é"], kind), pa.array(["b"], kind)]))
        assert data[offsets[0] : offsets[-1]].tobytes().decode() == "aéb"
