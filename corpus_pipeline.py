"""The corpus pipeline: documents in, sampled token ids out.

Each stage reads what its predecessor wrote.  All but the last return the columns of
documents, whatever other columns there are.  Nulls, repeated rows and empty tables:
see each stage.  The operators are imported when a stage runs, so that this module can
be imported without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in none of the learned languages go, as do null texts and texts without a letter.

    Repeated rows are judged alike; long texts are read whole; an empty table stays empty.
    """
    from marketloom.llm import common, langid

    common.bounded(spark)
    return langid.accept(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, that of the least id.

    Rows of one id are one document and one of them stays; rows without an id stay; texts
    without words are in no group.  Long texts are compared whole; an empty table stays empty.
    """
    from marketloom.llm import jaccard

    return jaccard.representatives(docs, shingle=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: each secret is replaced by its kind; all rows stay, null texts stay null.

    Repeated rows are changed alike; long texts are scanned whole; an empty table stays empty.
    """
    from marketloom.llm import common, secrets

    common.bounded(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each source takes about its target of words, rows repeated or left out whole; rows without words go.

    Null texts have no words; rows that repeat are drawn each for itself; an empty table stays empty.
    """
    from marketloom.llm import mixing

    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: two sampled segmentations of each row with their inclusion scores; repeated rows get equal ones.

    An empty text has one segmentation without pieces, a null text a row of nulls; a long text
    is one lattice; an empty table gives an empty result.
    """
    from marketloom.llm import common, pieces

    common.bounded(spark)
    return pieces.encode(docs, k=2)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pieces", encode),
]

#: Hashing, sampling and learned models are not for SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    from marketloom.llm.common import Shared

    shared = Shared(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.put(stage(spark, docs, sf_dir), name)
        shared.release()
    return docs
