"""A training-corpus pipeline over ``documents``: each stage works on what the one before it kept.

All stages but the last return the columns of ``documents``, extra ones included; the last gives the token
ids. A null text counts as an empty one throughout, and an empty table passes through every stage. No stage
caps, cuts or samples texts; very long ones are treated like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltlog.llm import cotrain, decontaminate, exact_dedup, neardup, piece_codec
from siltlog.llm.frames import durable, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects as bad or toxic.

    Null metadata is a value of its own; without labels nothing is dropped; repeated rows share their fate.
    """
    return cotrain.good_documents(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts (A-Z lower-cased).

    Null, and empty, texts are one group; of rows that repeat doc_id and text one stays; a null doc_id stays
    only if its group has no other.
    """
    return exact_dedup.unique_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class linked by a similarity of 0.8 on five-word shingles: the least doc_id.

    Texts without words are linked with nothing and stay; where doc_ids repeat or are null, rows are told apart
    by their word sequence too.
    """
    return neardup.distinct_documents(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold half of a benchmark item or more, in tiles of five words or more.

    Items and texts without words match nothing; without items nothing is dropped.
    """
    return decontaminate.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of ids and of the text they decode to, of every row.

    A null or empty text has the ids of begin and end alone.
    """
    return piece_codec.encode_decode(docs).drop("decoded")


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("sentencepiece", tokens),
]

#: A trained classifier decides in the first stage, so SQL cannot state the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
