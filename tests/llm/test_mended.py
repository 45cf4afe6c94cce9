"""Cases that gave wrong results once."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import common, fingerprints, langid, licences, substrings


@pytest.mark.parametrize("relay", [1 << 16, 0])
def test_substrings_judge_rows_of_one_id_by_their_own_text(spark, monkeypatch, relay):
    monkeypatch.setattr(substrings, "RELAY_SLICES", relay)
    passage, other = " ".join(f"a{i}" for i in range(70)), " ".join(f"n{i}" for i in range(80))
    rows = [(1, passage), (5, passage + " tail"), (5, other), (5, "x " + passage), (7, other + " " + passage), (5, None), (5, other)]
    rows += [(5, f"v{k} " * 40 + (passage if k % 2 else "")) for k in range(3000)]
    whole = [(d, (t or "").split()) for d, t in rows]
    first: dict = {}
    for d, w in whole:
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            first[key] = min(first.get(key, d), d)
    want = []
    for d, w in whole:
        gone = {q for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < d for q in range(p, p + 50)}
        want.append((d, len(w), len(gone)))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, variant int").repartition(4)
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup(docs).collect()]
    assert sorted(got) == sorted(want)


def test_language_fit_never_sees_held_out_labels(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    words = {"en": ["the", "with", "thing"], "de": ["der", "nicht", "schule"], "fr": ["le", "avec", "chose"]}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate(rng.choice(list(words), 300).tolist())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = common.crc_remainder(F.col("doc_id"), langid.FOLDS) == langid.HELD_OUT
    lied = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs, per_language=20), langid.fit(lied, per_language=20)
    assert a.families == b.families and np.array_equal(a.weights, b.weights) and np.array_equal(a.offsets, b.offsets)


def test_templated_texts_that_are_not_linked_do_not_meet(spark, monkeypatch):
    """Every text of a template shares most of its words with all others: what is examined grows with the texts, not with their pairs."""
    from marketloom.llm import jaccard

    rng = np.random.Generator(np.random.PCG64(4))
    template = [f"t{i}" for i in range(188)]

    def texts(n):
        return [(k, " ".join([*template[:90], *[f"o{k}x{j}" for j in range(12)], *template[90:]])) for k in rng.permutation(n).tolist()]

    def examined(rows):
        made = []
        real = jaccard.candidates
        monkeypatch.setattr(jaccard, "candidates", lambda now: made.append(real(now)) or made[0])
        got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
        monkeypatch.setattr(jaccard, "candidates", real)
        assert all(r["component_id"] == r["doc_id"] for r in got) and len(got) == len(rows)
        return made[0].count()

    few, many = examined(texts(1000)), examined(texts(4000))
    assert few <= 20 * 1000 and many <= 20 * 4000


def test_tokens_that_are_late_everywhere_go_from_a_sorted_stream():
    import pyarrow as pa

    from marketloom.llm import jaccard

    rng = np.random.Generator(np.random.PCG64(9))
    for _ in range(40):
        token = np.sort(rng.integers(0, 12, 60))
        early = rng.random(60) < 0.2
        order = np.lexsort((~early, token))
        token, early = token[order], early[order]
        cuts = np.sort(rng.integers(0, 61, 5))
        batches = [pa.RecordBatch.from_arrays([pa.array(t), pa.array(e)], ["token", "early"]) for t, e in zip(np.split(token, cuts), np.split(early, cuts))]
        got = [(t, e) for b in jaccard._repeated(iter(batches)) for t, e in zip(*[c.to_pylist() for c in b.columns])]
        assert got == [(t, e) for t, e in zip(token.tolist(), early.tolist()) if (token == t).sum() > 1 and early[token == t].any()]


def plain_licence(text, templates, bodies, threshold):
    """By brute force: all lines, the whole text, and all windows of its words; (licence, dice) of the best."""
    words = lambda t: "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
    pairs = lambda w: list(zip(w, w[1:]))
    best = (0.0, None)

    def tried(g, name, b):
        nonlocal best
        g = set(g)
        d = 2 * len(g & b) / (len(g) + len(b)) if g else 0.0
        if d >= threshold - 1e-12 and (d > best[0] + 1e-12 or (abs(d - best[0]) < 1e-12 and name < best[1])):
            best = (d, name)

    every = pairs(words(text))
    for name, template in [*templates.items(), *bodies]:
        tw = words(template)
        b = set(pairs(tw))
        if (name, template) not in bodies:
            for unit in [*text.split("\n"), text]:
                tried(pairs(words(unit)), name, b)
        longest = int((len(tw) - 1) * (2 - threshold) / threshold * (1 + 1e-9)) + 1
        for i in range(len(every)):
            for j in range(i + 1, min(i + longest, len(every)) + 1):
                if every[i] in b and every[j - 1] in b:
                    tried(every[i:j], name, b)
    return best[1], round(best[0], 9)


def test_licences_in_all_windows_against_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(21))
    noise = "the of source and code with to in permitted foo bar licence a work public domain under this".split()
    texts = ["", None, "one", licences.TEMPLATES["MIT"] * 3]
    bsd = licences.TEMPLATES["BSD-3-Clause"].split()
    inserted = bsd[:9] + "x1 x2 x3 x4 x5 x6 x7".split() + bsd[9:]
    texts += [" ".join(inserted), "at first " + " ".join(inserted) + " a b source and"]
    names = sorted(licences.TEMPLATES)
    for k in range(60):
        w = licences.TEMPLATES[names[k % len(names)]].split()
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(w)))
            w = w[:at] + w[at + 1 :] if rng.random() < 0.5 else w[:at] + [str(rng.choice(noise))] + w[at:]
        before, after = ([str(x) for x in rng.choice(noise, int(rng.integers(0, 12)))] for _ in range(2))
        joints = ["\n" if rng.random() < 0.08 else " " for _ in range(len(before) + len(w) + len(after))]
        texts.append("".join(x + j for x, j in zip([*before, *w, *after], joints)))
    body = licences.BODIES[0][1].split()
    texts.append("preface text\n" + " ".join(body[:40] + ["changed"] + body[42:]) + "\nthe end of the software")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["licence"], r["dice"]) for r in licences.scan(docs).collect()}
    found = 0
    for i, text in enumerate(texts):
        want = plain_licence(text or "", licences.TEMPLATES, licences.BODIES, 0.8)
        assert got[i] == want, (i, text, want)
        found += want[0] is not None
    assert 20 < found < len(texts)
    assert licences.scan(docs.limit(0)).collect() == []


def test_equal_coefficients_fall_to_the_smaller_name(spark):
    templates = {"B": "alpha beta gamma delta", "A": "delta gamma beta alpha"}
    docs = spark.createDataFrame([(1, "delta gamma beta alpha beta gamma delta"), (2, "alpha beta gamma delta")], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan(docs, templates).collect()}
    assert got == {1: "A", 2: "B"}


def _plain_signature(text):
    """Every word and sample by the formulas of the module's docstring."""
    import math

    step, top = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def mixed(x):
        return int(common.mix(np.array([x & top], np.uint64))[0])

    counts = collections.Counter(text.split())
    data = np.frombuffer(" ".join(counts).encode(), np.uint8)
    hashes = common.Words(data, np.array([0, len(data)])).hashes().tolist()
    out = []
    for k in range(fingerprints.SAMPLES):
        best = None
        for term, w in zip(hashes, counts.values()):
            seed = term + (2 * k + 1) * step
            x, y = mixed(seed), mixed(seed + step)
            u = lambda bits, width: (bits + 0.5) / (1 << width)
            r = -math.log(u(x & 0x1FFFFF, 21) * u(x >> 21 & 0x1FFFFF, 21))
            b, c = u(x >> 42, 22), -math.log(u(y & 0xFFFFFFFF, 32) * u(y >> 32, 32))
            t = math.floor(math.log(w) / r + b)
            best = min(best or (math.inf,), (math.log(c) - r * (t - b) - r, term, t))
        out.append(mixed(best[1] + best[2] * step) >> 48)
    return out


def test_fingerprints_by_few_words_are_those_of_all_words(monkeypatch):
    """Only words that can be a text's least are worked out; the samples are those over all words."""
    numbered, real = [], fingerprints._numbers

    def counted(*draws):
        numbered.append(real(*draws)[0].size)
        return real(*draws)

    monkeypatch.setattr(fingerprints, "_numbers", counted)
    rng = np.random.Generator(np.random.PCG64(11))
    texts = [" ".join(f"w{int(i)}" for i in rng.zipf(1.3, n) if i < 1 << 40) for n in [300] * 60 + [1, 3, 2000, 7]]
    texts += ["", "only", "twice twice", "again " * 500 + "once", texts[0]]
    got = fingerprints.signatures(*fingerprints._buffer(texts))
    terms = len({w for t in texts for w in t.split()})
    assert sum(numbered) < 0.5 * terms * fingerprints.SAMPLES
    for k in [0, 1, *range(60, len(texts))]:
        assert got[k].tolist() == (_plain_signature(texts[k]) if texts[k] else [0] * fingerprints.SAMPLES)


@pytest.mark.parametrize("blocks", [16, 2])
def test_jaccard_opens_groups_in_blocks_without_moving_texts(spark, monkeypatch, blocks):
    """Where what is opened is too much for one broadcast, texts stay where they are; beyond BLOCKS readings they move once."""
    from marketloom.llm import jaccard

    monkeypatch.setattr(common, "BROADCAST_ROWS", 400)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 150, raising=False)
    monkeypatch.setattr(jaccard, "BLOCKS", blocks, raising=False)
    plans, real = {}, common.Shared.put

    def put(self, df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return real(self, df, name)

    monkeypatch.setattr(common.Shared, "put", put)
    rng = np.random.Generator(np.random.PCG64(12))
    rows = []
    for family in range(90):
        base = [f"f{family}w{j}" for j in range(60)]
        rows += [(0, " ".join(base[:59] + [f"end{k}"])) for k in range(10)]
    rows = [(int(i), t) for i, (_, t) in zip(rng.permutation(len(rows)), rows)]
    least = {}
    for i, t in rows:
        least[t.split()[0]] = min(least.get(t.split()[0], i), i)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: least[t.split()[0]] for i, t in rows}
    links = [plan for name, plan in plans.items() if name.startswith("lead-links")]
    assert links and (blocks < 16 or not any("SortMergeJoin" in plan for plan in links))
    assert any("-source" in name for name in plans) == (blocks < 16)


def test_jaccard_components_of_stars_need_no_round(spark, tmp_path):
    """Edges that are stars already are read off; chains and rings still end at their least node."""
    from marketloom.llm import jaccard

    tables, real = [], common.Shared(spark)

    class Counted:
        def put(self, df, name):
            tables.append(name)
            return real.put(df, name)

        release = real.release

    def of(edges):
        tables.clear()
        return dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "a long, b long"), Counted(), f"c{len(edges)}-").collect()))

    assert of([(1, k) for k in range(2, 40)] + [(50, 60), (60, 50), (7, 7)]) == {**{k: 1 for k in range(1, 40)}, 50: 50, 60: 50} and len(tables) == 1
    assert of([(k, k + 1) for k in range(100, 130)] + [(5, 6), (6, 4), (4, 5)]) == {**{k: 100 for k in range(100, 131)}, 4: 4, 5: 4, 6: 4}


def test_jaccard_writes_few_files_of_few_edges(spark, tmp_path, monkeypatch):
    """The edges of a chain are a file a round, however many shuffle partitions there are; more edges are more files."""
    from marketloom.llm import jaccard

    class Told:
        real, files = common.Shared(spark), []

        def put(self, df, name):
            out = self.real.put(df, name)
            self.files.append(len(out.inputFiles()))
            return out

        def release(self):
            self.real.release()

    edges = spark.createDataFrame([(k, k + 1) for k in range(100, 140)], "a long, b long").repartition(5)
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesced)
    spark.conf.set(coalesced, "false")
    try:
        for rows, most in ((jaccard.EDGE_ROWS, 1), (20, 2)):
            monkeypatch.setattr(jaccard, "EDGE_ROWS", rows)
            told = Told()
            told.files.clear()
            got = jaccard.components(edges, told, f"few{most}-")
            assert dict(map(tuple, got.collect())) == {k: 100 for k in range(100, 141)}
            assert len(told.files) > 2 and max(told.files) == most and got.rdd.getNumPartitions() <= most
    finally:
        spark.conf.set(coalesced, before)


def test_jaccard_tasks_hold_one_python_worker(spark, monkeypatch):
    """No stage of the join has two Python steps, each of which would be a worker of its own in every task."""
    from marketloom.llm import jaccard

    plans, real = {}, common.Shared.put

    def told(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return real(self, df, name)

    monkeypatch.setattr(common.Shared, "put", told)
    rows = [(i, f"w{i % 7} " + " ".join(f"t{i % 7}x{j}" for j in range(40)) + f" end{i % 3}") for i in range(60)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {i: i % 7 for i in range(60)}
    seen = set()
    for name, plan in plans.items():
        above = []  # (depth, whether it is a Python step, an exchange) of the steps over this one
        for line in plan.splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            above = [a for a in above if a[0] < depth]
            python = "InArrow" in line.lstrip(" :+-").split(" ")[0]
            if python:
                seen.add(name)
                stage = []
                for a in reversed(above):
                    if a[2]:
                        break
                    stage.append(a[1])
                assert not any(stage), (name, plan)
            above.append((depth, python, "Exchange" in line.lstrip(" :+-").split(" ")[0]))
    assert {"sets", "lead-unions", "lead-pairs"} <= seen
