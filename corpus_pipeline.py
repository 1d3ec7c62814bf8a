"""A corpus pipeline: language, toxicity, near-duplicates, secrets, packing.

Each stage takes a session, the documents that its predecessor kept, and the folder of the tables.
Its result is written as Parquet and read again as the next stage's documents. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import langid, minhash, packing, secrets, toxicity
from spanloom.llm.common import DOCUMENT_COLUMNS, materialise, table
from spanloom.llm.queries import pre_token_pattern, vocabulary

#: Hundredths of Jaccard similarity from which documents are near-duplicates.
SIMILARITY = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text lies near some language; texts without a letter, null ones and far ones go.

    It learns from ``lang`` of the same documents; if none has one, nothing is near and all go. Rows of
    null or repeated ids are judged each by itself; an empty table stays empty.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    return langid.keep_identified(docs, langid.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, learnt from the labels of documents still here, finds clean.

    Null and empty texts stay, and so does everything if no document here is labelled toxic. Rows of
    null or repeated ids are judged each by itself; an empty table stays empty.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id, one without an id only where no other is.

    Rows of a repeated id are rows of their own. Texts without words are in no group and stay; an
    empty table stays empty.
    """
    return minhash.keep_representatives(docs.select(*DOCUMENT_COLUMNS), percent=SIMILARITY)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of secrets and ``n_chars`` to match.

    A null text stays null with its ``n_chars``. Each row gives a row, whatever its id; an empty table stays empty.
    """
    return secrets.redact_documents(docs.select(*DOCUMENT_COLUMNS), vocabulary("byte_bpe_50k.tiktoken"), pre_token_pattern())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.

    A null text is the separator alone. Each row, whatever its id, gives its own pieces; an empty table none.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL has no trained models, token vocabularies or packing; tests compare with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
