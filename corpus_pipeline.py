"""The corpus pipeline: low-quality documents go, one of each group of near-copies stays, documents with
benchmark items go, secrets are masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), reads all of docs and, but for the last, returns the columns it got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import op1_secrets as secrets
from weftgraph.llm import op3_quality as quality
from weftgraph.llm import op4_decontaminate as decontaminate
from weftgraph.llm import op5_near_dedup as near
from weftgraph.llm import op10_packing as packing
from weftgraph.llm.common import bucket, shared_dir, table
from weftgraph.llm.tokens import default_vocabulary

#: Near-copies: five words a shingle, similarity of 0.8 or more.
COPIES = near.Join(words=5, percent=80)


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns as op3 does, from this stage's documents.

    Null and empty texts are scored as padding, so one goes or stays by what was learned; null ids are scored too;
    without labels of both classes every score is the share of label 1; rows that repeat stay or go together; a
    table without rows stays one; columns are kept, whatever their names.
    """
    labels = table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0)
    return quality.accepted(docs, *quality.train(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies one row stays, that of the smallest id.

    Null ids come last; of rows with one id and other texts the first by the text's hash stays, of equal rows one;
    null and empty texts and those without words have no copies and all stay; a table without rows stays one;
    columns are kept, whatever their names.
    """
    return near.without_copies(docs, COPIES)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which an item of the benchmark is found go.

    Null and empty texts hold no item and stay, as does every row if the benchmark is empty; rows that repeat stay
    or go together; null ids make no difference; columns are kept, whatever their names.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes ``[secret]``; no row goes.

    Null and empty texts stay as they are; spans that overlap are masked as one; rows that repeat are masked alike,
    also those without an id; n_chars, if there is such a column, is the new length; other columns are kept,
    whatever their names.
    """
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its place in a sequence.

    Null and empty texts are the end id alone; rows that repeat, or have no id, are packed each; ties of length go by
    id and place; a table without rows gives none; of the columns only ids and texts are used.
    """
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("quality", filter_quality),
    ("near_dedup", drop_copies),
    ("decontaminate", drop_benchmark),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A network, similarity trees and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
