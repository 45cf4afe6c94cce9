"""The pipeline against brute-force rules on a small table."""

import re

import numpy as np

import corpus_pipeline
from marketloom.llm import pieces
from marketloom.llm.common import Shared


def _five(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shared, tables = Shared(spark), [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(shared.put(stage(spark, tables[-1], ""), name))
    start, spoken, single, clean, mixed, encoded = tables
    assert all(t.columns == docs.columns for t in tables[:5])
    texts = {r["doc_id"]: r["text"] for r in spoken.collect()}
    kept = {r["doc_id"] for r in single.collect()}
    sets = {i: _five(t) for i, t in texts.items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ids = sorted(kept)
    assert not any(near(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    assert all(any(near(i, j) for j in texts if j < i) for i in set(texts) - kept)
    assert not any(re.search(r'(?i)token = "[0-9a-f]{32,}', r["text"]) for r in clean.collect())
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(counts) <= kept and max(counts.values()) <= 4
    v = pieces.vocabulary(pieces.default_model(), 1.0)
    final = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = encoded.collect()
    assert all(pieces.decode(np.array(r["ids"], np.int64), v) == final[r["doc_id"]] for r in rows if r["ids"] is not None)
    assert {r["doc_id"] for r in rows} == set(counts) and len(rows) > 1.9 * sum(counts.values())  # a text of one piece has one segmentation


def test_odd_rows_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars int, _size long, comp long"
    rows = [(None, "the thing with the other thing", "en", None, 3, 1, 1), (1, None, None, "a", None, 1, 1), (2, "", "en", "a", 0, 1, 1), (3, "the thing with the other thing", "en", "a", 3, 1, 1), (3, "the thing with the other thing", "en", "a", 3, 1, 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert name == "pieces" or out.columns == table.columns
            n = out.count()
            assert n == 0 if not table.count() else n <= 3 * len(rows)
            table = Shared(spark).put(out, name) if name != "pieces" else table
