"""Each operator against a brute-force form, on small tables with nulls, empty texts, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import common, fingerprints, hamming, jaccard, langid, licences, mixing, pieces, secrets, substrings, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = np.random.Generator(np.random.PCG64(seed))
    return " ".join(WORDS[i] + str(j % 7) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n)))


def table(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None, 0.5, 1, True) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, node int, member boolean")


@pytest.fixture(scope="module")
def texts():
    base, other = prose(1, 400), prose(2, 300)
    near = base.split()
    near[200] = "changed"
    rows = [(1, base, "a"), (2, base, "b"), (3, " ".join(near), "a"), (4, other, None), (5, None, "a"), (6, "", "b"), (7, " \t\n", None), (8, "one", "a"), (9, "ONE", "a"), (10, "two words", "b"), (11, base + " " + other, "c"), (12, prose(3, 3000), "c"), (12, prose(3, 3000), "c")]
    return rows + [(20 + i, prose(50 + i, 30 + i), "abc"[i % 3]) for i in range(30)]


def test_words_are_those_of_bytes_split():
    data = "a  b\tc\x1fd\xa0e\nf　g".encode()
    w = common.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert [data[a:b] for a, b in zip(w.starts, w.ends)] == data.split()


def test_secrets_match_regular_expressions():
    patterns = [re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|(?i:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")]
    rng = np.random.Generator(np.random.PCG64(4))
    tokens = ["password", "passwd", "Secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "==", "abc", "Zz9+/=", "0123456789abcdef" * 2, "deadbeef", "AKIA", "AKIAABCDEFGH1234", "é", "-", "\n"]
    machine = secrets.scanner()
    for _ in range(3000):
        data = "".join(rng.choice(tokens, rng.integers(1, 14))).encode()
        expected = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(data) if (len(m[1]) if k == 0 else len(m[0])) >= (8, 16, 32)[k])
        assert [s for s in machine.spans(data) if s[1] < 3] == expected


@pytest.mark.parametrize("n", [300, 5000])
def test_secrets_with_wide_gaps(n):
    gap, before = b" " * n, b"x " * 400
    machine = secrets.scanner()
    for found in (b"token" + gap + b"=" + gap + b"abcdefgh", b"password:" + gap + b"'abcdefgh", b"api_key" + gap + b":abcdefgh" + b"9" * n):
        assert [x for x in machine.spans(before + found + b"\n") if x[1] == 0] == [(800, 0, 800 + len(found))]
    assert not machine.spans(before + b"key" + gap + b"=" + gap + b"abcdefgh")


def test_secret_rows_and_redaction(spark, texts):
    secret = 'é token = "abcdefgh12345678" AKIAABCDEFGH12345 ' + "0a" * 20
    docs = table(spark, [*texts, (99, secret, "a")])
    got = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert len(got) == len({i for i, _, _ in texts}) + 1
    assert (got[99]["n_assign"], got[99]["n_access"], got[99]["n_hex"]) == (1, 1, 1)
    assert got[5]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    start = secret.index("token")
    assert got[99]["spans"].startswith(f"assign:{start}:")
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean[5] is None and clean[6] == "" and clean[1] == texts[0][1]
    assert clean[99] == 'é <assign>" <access> <hex>'
    assert secrets.scan(docs.limit(0)).count() == 0


def test_mixing_meets_targets(spark, texts):
    rows = mixing.mix(table(spark, texts)).collect()
    assert len(rows) == len(texts)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size[r["source_size"]] += r["size"]
        taken[r["source_size"]] += r["taken"]
        target[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    # brute force: deal shares again until none is above its cap
    by_source = collections.Counter()
    for _, text, source in texts:
        by_source[source] += len((text or "").encode().split())
    order = sorted((s for s in by_source if s is not None), key=lambda s: s) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, free, expected = float(sum(by_source.values())), set(order), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * by_source[s]]
        if not over:
            break
        for s in over:
            expected[s] = 3.0 * by_source[s]
            left -= expected[s]
            free.discard(s)
    expected |= {s: level * weight[s] for s in free}
    for s in order:
        assert target[by_source[s]] == pytest.approx(expected[s])
        assert abs(taken[by_source[s]] - expected[s]) < 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(table(spark, texts)).collect()))
    whole = mixing.repeated(table(spark, texts))
    assert whole.columns == table(spark, texts).columns and whole.count() > 0


def test_fingerprints(spark, texts):
    rows = {r["doc_id"]: r for r in fingerprints.edited(table(spark, texts), ranges=4).collect()}
    order = sorted({(i, t or "") for i, t, _ in texts})
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        if i != 12:
            assert rows[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[i]["n_chars"] == len(t)
    assert rows[1]["fingerprint"] == rows[2]["fingerprint"] and rows[1]["near_next"] == 1.0
    assert rows[5]["fingerprint"] == "" and rows[6]["near_next"] == 1.0 and rows[7]["near_next"] == 0.0


def test_fingerprints_estimate_generalised_jaccard():
    errors = []
    for k in range(40):
        a, b = prose(k, 200), prose(k, 100) + " " + prose(k + 500, 100)
        p, q = collections.Counter(a.split()), collections.Counter(b.split())
        true = sum((p & q).values()) / sum((p | q).values())
        sig = fingerprints.signatures(*fingerprints._buffer([a, b]))
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.03 and np.mean(np.abs(errors)) < 0.08


@pytest.mark.parametrize("shingle,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, texts, shingle, percent):
    more = [(100 + i, " ".join([*prose(7, 120).split()[:k], "edit%d" % i, *prose(7, 120).split()[k + 1 :]]), "a") for i, k in enumerate(range(0, 120, 5))]
    rows = [*texts, *more]
    got = {r["doc_id"]: r for r in jaccard.linked(table(spark, rows), shingle, percent).collect()}
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                    label[a], changed = label[b], True
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), label[i]), i
    kept = {r["doc_id"] for r in jaccard.representatives(table(spark, rows), shingle, percent).collect()}
    assert kept == {i for i in sets if label[i] == i}


def test_jaccard_of_odd_tables(spark):
    docs = table(spark, [(None, "no id here at all", "a"), (3, "no id here at all", "a"), (None, "no id here at all", "a"), (5, "word " * 30_000, "a"), (6, "word " * 30_001, "b")])
    got = sorted((r["doc_id"] or 0, r["component_id"], r["n_shingles"]) for r in jaccard.linked(docs).collect())
    assert got == [(0, 3, 3), (0, 3, 3), (3, 3, 3), (5, 5, 1), (6, 5, 1)]
    assert jaccard.linked(docs.limit(0)).count() == 0 and jaccard.representatives(docs.limit(0)).count() == 0


def test_repeated_tokens_across_batches():
    rng = np.random.Generator(np.random.PCG64(9))
    for _ in range(200):
        token = np.sort(rng.integers(0, 12, rng.integers(0, 25)))
        cuts = np.sort(rng.integers(0, len(token) + 1, 4))
        batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(np.arange(len(t)), pa.int64())], ["token", "i"]) for t in np.split(token, cuts)]
        got = sorted(x for b in jaccard._repeated(iter(batches)) for x in b.column(0).to_pylist())
        assert got == [t for t in token.tolist() if (token == t).sum() > 1]


@pytest.mark.parametrize("relay", [1 << 16, 0])
def test_substrings_of_a_hot_passage_and_a_text_that_repeats_itself(spark, monkeypatch, relay):
    """A passage in a third of all texts at every offset, copies, one word over and over, repeated and null ids: as by brute force."""
    monkeypatch.setattr(substrings, "RELAY_SLICES", relay)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i % 37)) + (f" {shared} " if i % 3 == 0 else " ") + f"end{i}") for i in range(240)]
    rows += [(300, "na " * 400), (301, "na " * 120), (302, rows[0][1]), (303, ""), (304, None), (299, "na " * 60), rows[3], (None, shared)]
    whole = [(d, (t or "").split()) for d, t in rows]
    first: dict = {}
    for d, w in whole[:-1]:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, d), d)
    docs = table(spark, [(d, t, "a") for d, t in rows]).repartition(4)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup(docs).collect())
    want = []
    for d, w in whole:
        gone = {q for p in range(len(w) - 49) if d is not None and first[tuple(w[p : p + 50])] < d for q in range(p, p + 50)}
        want.append((-1 if d is None else d, len(w), len(gone)))
    assert got == sorted(want) and sum(n for _, _, n in got) > 5000
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_substrings_against_brute_force(spark, texts):
    shared = prose(9, 80)
    rows = [*texts, (200, prose(10, 40) + " " + shared + " " + prose(11, 33), "a"), (201, shared, "a"), (202, prose(12, 13) + " " + shared[: len(shared) // 2], "b")]
    got = {r["doc_id"]: r for r in substrings.dedup(table(spark, rows)).collect()}
    words = {i: (t or "").encode().split() for i, t, _ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        left = [x for x, ok in zip(w, keep) if ok]
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()), i


def test_neighbours_recall_and_order(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    v = rng.normal(size=(1500, 24))
    v[100:160] = v[99]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(5000, None, 0), (5020, [0.0] * 24, 0), (5040, [float("nan")] * 24, 0), (5060, [None] * 24, 0), (5080, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = collections.defaultdict(list)
    for r in hamming.search(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(score - v[i] @ v[q]) < 1e-9 for i, score in found)
    assert hits / (20 * len(got)) >= 0.95
    assert hamming.search(df.limit(0)).count() == 0


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.Generator(np.random.PCG64(8))
    codes = rng.integers(0, 256, (3000, 5), dtype=np.uint8)
    codes[:300] = codes[300] ^ (np.uint8(1) << rng.integers(0, 8, (300, 5)).astype(np.uint8))
    queries = np.vstack([codes[300:303], rng.integers(0, 256, (40, 5), dtype=np.uint8)])
    tables = hamming.Tables(codes)
    for radius in (0, 3, 7, 12, 19, 40):
        got = [p for q, e in tables.within(queries, radius) for p in zip(q.tolist(), e.tolist())]
        distance = np.bitwise_count(queries[:, None] ^ codes[None]).sum(2)
        assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))
    assert sum(max(0, r + 1) for r in hamming.reaches(5, 12)) == 13  # pigeonhole: the reaches and one more sum to the radius and one


def test_neighbours_of_few_vectors(spark):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(4)] + [(7, [2.0, 1.0]), (8, [-9.0, 0.0])]
    got = collections.defaultdict(list)
    for r in hamming.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [60, 40, 7, 20, 8] and set(map(len, got.values())) == {5}  # all candidates; ties by id


def test_segmentations_follow_the_lattice():
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    text, index = "then an", {t: i for i, t in enumerate(v.texts)}
    plain, marked, every = set(v.piece_of[v.piece_of >= 0].tolist()), "▁then▁an", []

    def walk(i, ids, score):
        if i == len(marked):
            every.append((tuple(ids), score))
        for j in range(i + 1, len(marked) + 1):
            k = index.get(marked[i:j])
            if k in plain:
                walk(j, [*ids, k], score + v.scores[k])

    walk(0, [], 0.0)
    total = np.logaddexp.reduce([s for _, s in every])
    p = {ids: math.exp(s - total) for ids, s in every}
    n = 4000
    got = pieces.Search(v, [text] * n, np.arange(n, dtype=np.uint64)).run(2)
    first, second = (collections.Counter(tuple(r[k][0].tolist()) for r in got) for k in (0, 1))
    for ids in sorted(p, key=p.get)[-3:]:
        assert first[ids] / n == pytest.approx(p[ids], abs=0.025)
        assert second[ids] / n == pytest.approx(sum(p[a] * p[ids] / (1 - p[a]) for a in p if a != ids), abs=0.035)
    assert all(r[0][0].tolist() != r[1][0].tolist() and r[0][2] > r[1][2] for r in got)


def test_units_are_not_cut():
    """Log-probabilities over the lattice of one long unit without spaces."""
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    text, index = "thentheotherthingof" * 30, {t: i for i, t in enumerate(v.texts)}
    plain, marked = set(v.piece_of[v.piece_of >= 0].tolist()), "▁" + text
    mass = [0.0] + [-np.inf] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - v.longest), j):
            if index.get(marked[i:j]) in plain:
                mass[j] = np.logaddexp(mass[j], mass[i] + v.scores[index[marked[i:j]]])
    crossed = 0
    for result in pieces.Search(v, [text] * 40, np.arange(40, dtype=np.uint64)).run(2):
        for ids, log_prob, _, _ in result:
            assert log_prob == pytest.approx(v.scores[ids].sum() - mass[-1])
            ends = np.cumsum([len(v.texts[i]) for i in ids])
            crossed += not {*range(64, len(marked), 64)} <= {*ends.tolist()}
    assert crossed > 20


def test_encoding_round_trips(spark, texts):
    rows = [*texts, (300, "é\n日本語▁x ▁  y", "a"), (301, "x" * 300, "a")]
    docs = table(spark, rows)
    got = pieces.encode(docs, k=2).collect()
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    of = {i: t for i, t, _ in rows}
    assert all(pieces.decode(np.array(r["ids"], np.int64), v) == of[r["doc_id"]] and r["round_trip"] for r in got if r["sample"])
    assert [r["sample"] for r in got if r["doc_id"] == 5] == [0]
    again = pieces.encode(docs.repartition(3), k=2, with_ids=False).collect()
    assert sorted((r["doc_id"], r["sample"], round(r["perturbed"], 6)) for r in got if r["sample"]) == sorted((r["doc_id"], r["sample"], round(r["perturbed"], 6)) for r in again if r["sample"])


def test_licences(spark):
    rows = [(1, "text\nReleased under the MIT  License!\nmore"), (2, "nothing here at all"), (3, None), (4, ""), (5, "licensed UNDER cc by-nc 4.0"), (5, "licensed UNDER cc by-nc 4.0")]
    got = licences.scan(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, dice int")).collect()
    found = {r["doc_id"]: (r["licence"], r["dice"]) for r in got}
    assert len(got) == 6 and found[1] == ("MIT", 1.0) and found[5][0] == "CC-BY-NC-4.0" and found[2] == found[3] == found[4] == (None, 0.0)


def test_licences_of_any_length(spark):
    notice, word = licences.TEMPLATES["MIT"], "Redistribution and use in source and binary forms"
    rows = [(1, notice + " " * 900), (2, notice + "=" * 5000 + "\nother words"), (3, "* " * 600 + notice + " *" * 600), (4, "\n".join(["x y", (notice + " ") * 300])),
            (5, (notice + "\n") * 300), (6, word * 400), (7, prose(1, 3000))]
    got = {r["doc_id"]: (r["licence"], r["n_units"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # a repeated notice has one bigram more than the template; the whole text of 5 is a unit as its line is
    assert got == {1: ("MIT", 1), 2: ("MIT", 1 + 1), 3: ("MIT", 1), 4: ("MIT", 1), 5: ("MIT", 2), 6: (None, 0), 7: (None, 0)}


def test_licences_in_windows(spark):
    wrap = lambda text, n: "\n# ".join(" ".join(text.split()[k : k + n]) for k in range(0, len(text.split()), n))
    bsd, mit, body = licences.TEMPLATES["BSD-3-Clause"], licences.TEMPLATES["MIT"], dict(licences.BODIES)
    rows = [(1, wrap(bsd, 11)), (2, "It was " + mit[:-1] + " last year by us"), (3, prose(1, 500) + " " + bsd + " " + prose(2, 500)), (4, "Copyright A\n\n" + wrap(body["MIT"], 12) + "\n\nTHE SOFTWARE IS PROVIDED"),
            (5, "/* " + wrap(body["Apache-2.0"], 10) + " */\n" + prose(3, 300)), (6, wrap(body["GPL-3.0"].replace("program", "tool"), 9)), (7, " ".join(bsd.split()[::-1])), (8, prose(4, 2000)), (9, None)]
    got = {r["doc_id"]: (r["licence"], r["n_units"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["BSD-3-Clause", "MIT", "BSD-3-Clause", "MIT", "Apache-2.0", "GPL-3.0", None, None, None]
    assert got[2][1] == got[3][1] == 1 and got[8] == got[9] == (None, 0)


def test_toxicity_learns_stems(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    docs, labels = [], []
    for i in range(900):
        words, toxic = prose(i, 60).split(), i % 5 == 0
        if toxic:
            for at in rng.integers(0, 60, 5):
                words[at] = "vexo" + "".join(rng.choice(list("abcde"), 3))
        docs.append((i, " ".join(words), 0.0))
        labels.append((i, 1, int(toxic)))
    docs += [(2000, None, 0.0), (2001, "", 0.0)]
    labels += [(2000, 0, 0), (0, 0, 1), (5000, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in toxicity.score(d, toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and len(got) == len(docs)
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0
    empty = toxicity.fit(d.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(d, empty).where("predicted = 1").count() == 0


def plain_kneser_ney(texts, order, below, discount):
    """P(class, history, character) by plain recursion over counted strings; texts are (string, class)."""
    top = collections.Counter()
    for text, kind in texts:
        line = "^" * (order - 1) + text
        top.update((kind, line[k - order + 1 : k + 1]) for k in range(order - 1, len(line)))
    counts = {order: top}  # level -> (class or "both", gram) -> count
    for n in range(order - 1, 0, -1):
        upper = {(kind if n > below else "both", g) for kind, g in counts[n + 1]}
        counts[n] = collections.Counter((kind, g[1:]) for kind, g in upper)

    def p(kind, history, x):
        n = len(history) + 1
        who = kind if n > below else "both"
        own = {g[-1]: c for (k, g), c in counts[n].items() if k == who and g[:-1] == history}
        lower = p(kind, history[1:], x) if history else 1 / 512
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(x, 0) - discount, 0) / total + discount * len(own) / total * lower

    return p, counts


def test_toxicity_is_kneser_ney(spark):
    texts = [(f" {w} ", k) for w, k in [("abab ba", 0), ("abc cab", 1), ("bad abacus", 1), ("a", 0), ("cc abc", 0), ("abc", 1), ("za", 1)]]
    p, plain = plain_kneser_ney(texts, 4, 2, 0.75)
    code = lambda text: int(sum(int(toxicity._SYMBOLS[ord(c)] if c != "^" else 0) << (9 * i) for i, c in enumerate(reversed(text))))
    counts = collections.Counter()
    for text, kind in texts:
        _, _, gram, _ = next(toxicity.expressions(pa.array([text]), 4))
        counts.update((int(g), kind) for g in gram)
    assert counts == {(code(g), kind): n for (kind, g), n in plain[4].items()}
    rows = [(g, counts[g, 0], counts[g, 1], 0, counts[g, 1] if g % 2 else 0) for g in {g for g, _ in counts}]
    df = spark.createDataFrame(rows, "gram long, ordinary long, toxic long, ordinary_s long, toxic_s long")
    values = toxicity.Values.of(toxicity.differences(df, 4, 2, 0.75).toArrow(), "value")
    histories = {g[:-1] for _, g in plain[4]} | {"zzz", "^^z", "abd"}
    asked = [h + x for h in histories for x in "abcdz q"]
    got = values.of_grams(np.array([code(g) for g in asked], np.int64), 4, 2)
    for g, value in zip(asked, got):
        assert value == pytest.approx(math.log(p(1, g[:-1], g[-1]) / p(0, g[:-1], g[-1])), abs=1e-6), g


def test_toxicity_keeps_rare_expressions(spark):
    rows = [(i, prose(i, 40) + (" grault" if i % 2 and i % 75 == 0 else ""), i % 2) for i in range(1500)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    counted = sum(y and t.endswith("grault") and zlib.crc32(str(i).encode()) % 5 >= 1 for i, t, y in rows)
    assert 2 <= counted < 12
    values = toxicity.Values.of(model.table.toArrow(), "value")
    known, unseen = (len(t) * values.features(*next(toxicity.expressions(pa.array([t])))[2:])[0, 0] for t in (" grault ", " gxyz "))
    assert known > unseen + 0.5


def test_toxicity_of_odd_rows_and_both_ways(spark, monkeypatch):
    rows = [(i % 130, prose(i % 130, 40) + (" vexo" * 3 if i % 2 else " "), i % 2) for i in range(200)] + [(300, "long " * 200_000, 0), (301, "東京の天気。" * 50, 1), (None, "null id", 0)]
    d = spark.createDataFrame([(i, t, 7, "x", 0.5, 1) for i, t, _ in rows], "doc_id long, text string, toxic int, fold string, a double, _block int")
    labels = spark.createDataFrame([(i, 1, y, 3) for i, _, y in rows], "doc_id long, quality int, toxic int, fold int")
    model = toxicity.fit(d, labels)
    once = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.score(d, model).collect())
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    again = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in toxicity.score(d, model).collect())
    assert len(once) == len(rows) and all(x[:2] == y[:2] and abs(x[2] - y[2]) < 1e-6 for x, y in zip(once, again))


def test_language_families(spark):
    stems = {"en": ["the", "thing", "with"], "de": ["der", "schön", "ung"], "fr": ["le", "été", "eau"], "es": ["el", "ción", "año"]}
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(i, " ".join(rng.choice(stems[lang], 30)), lang, 0.1) for i in range(400) for lang in [list(stems)[i % 4]]]
    rows += [(900, None, "en", 0.1), (901, "12 34", "en", 0.1), (902, "the thing", None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:400]]) > 0.98
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"
    assert {r["doc_id"] for r in langid.accept(docs, model).collect()} == set(range(400)) | {902}
    foreign = spark.createDataFrame([(1, "Привет, как дела сегодня", "en", 0.1), (2, "東京の天気", "de", 0.1), (3, "zxqv kpjw qqxz vvkj", "en", 0.1), (4, "the with thing the", "en", 0.1), (4, "the with thing the", "en", 0.1)], docs.schema).withColumn("_letters", langid.F.lit(1))
    assert [r["doc_id"] for r in langid.accept(foreign, model).collect()] == [4, 4]
    empty = langid.fit(docs.limit(0))
    assert langid.accept(docs, empty).count() == 0 and {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"} and langid.predict(docs.limit(0), model).count() == 0
