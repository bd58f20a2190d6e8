"""A pipeline over documents: toxicity, quality, near-duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the documents of the next one. The first
four return the columns of ``documents``: the first three drop rows, the fourth
masks secrets in the text and counts ``n_chars`` anew. The last deals what is
left into batches.

All stages take nulls in any column, texts of any length, repeated rows and an
empty table, and leave columns beside their own as they are, whatever their
names; what each gives for such rows is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import packing, quality, secrets, simhash, toxicity
from larkspur.llm.common import own_folders, read_table, remove, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half stay.

    Null and empty texts have the score of labelled texts without known words; equal
    texts fare alike; labels of unknown or null ids count for nothing, and without any
    labels all scores are equal. Empty documents give an empty table.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their group stay.

    Null, empty and short texts fail the base rules. A null language or source is a
    value like others; equal texts of a group fare alike. Empty in, empty out.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Null and empty texts are one group; a null id stays only where its group has no
    other; of rows that repeat an id, one stays. Empty in, empty out.
    """
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with secrets masked.

    A null text stays null, with a null ``n_chars``; repeated rows stay. Empty in,
    empty out.
    """
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def deal_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, dealt into batches of similar length.

    Null and empty texts have length 0; null ids and repeated rows are dealt like
    others; columns beside id and text are not returned. Empty in, empty out.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", deal_batches),
]

#: The stages can't be expressed in SQL (nearest neighbours, robust estimates, automata).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    What a stage has written for itself, and what the one before it returned, goes
    once its own result is written. The last result stays, in the shared folder.
    """
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        with own_folders(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        if last:
            remove(spark, last)
        last = f"{where}/{k}-{name}"
        docs = spark.read.parquet(last)
    return docs
