import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marketloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    parts = [row[0], row[1], row[2], row[3], text]
    return h(*["-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts])


def climb(digests):
    """(root, siblings of each node, level by level, as (left, right))."""
    steps = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for i, k in enumerate(at):
            run = digests[k // 8 * 8 : k // 8 * 8 + 8]
            steps[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        at = [k // 8 for k in at]
        digests = [h(*digests[i : i + 8]) for i in range(0, len(digests), 8)]
    return digests[0], steps


def plain(rows):
    """The manifest by loops: sorted tuples."""
    key = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4]))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted([r for r in rows if r[2] == lang], key=key) for lang in langs}
    made = {lang: climb([leaf_of(r, r[4]) for r in mine]) for lang, mine in trees.items()}
    root, above = climb([made[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, above):
        for r, own in zip(trees[lang], made[lang][1]):
            steps, text = own + top, r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf_of(r, text)
            for left, right in steps:
                folded = h(left, folded, right)
            out.append((r[0], leaf_of(r, r[4]), made[lang][0], root, h(*[a + b for a, b in steps]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()], key=str)


def documents():
    rows = [(i, f"s{i % 3}", ["en", "de", None, "é"][0 if i % 5 else i % 4], i, f"Text {i} Äß") for i in range(700)]
    rows += [(3, None, "en", None, None), (3, "s", "en", 1, "Other"), (None, "s", "en", 1, "No Id"), (5, "s", "zz", 0, "")]
    rows += [(9, "s", "de", 1, "Same")] * 40 + [(10**12, "s", "fr", 1, "X" * 300_000)]
    return rows


@pytest.mark.parametrize("broadcast", [0, 20, 1 << 15])
def test_equals_a_plain_loop(spark, monkeypatch, broadcast):
    """Levels joined by shuffle, in part, and by broadcast."""
    monkeypatch.setattr(merkle, "BROADCAST_RUNS", broadcast)
    monkeypatch.setattr(merkle, "COPIES", 8)
    docs = spark.createDataFrame(documents(), SCHEMA).withColumn("tree", F.lit(1)).withColumn("place", F.lit("x")).repartition(5)
    assert rows_of(merkle.manifest(docs)) == plain(documents())


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_small_trees_of_one_language(spark, n):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    assert rows_of(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_an_empty_table_has_no_manifest(spark):
    df = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert df.collect() == [] and df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
