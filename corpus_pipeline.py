"""A corpus pipeline: quality rules, near duplicates, pseudonyms, a mix of sources and token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every one but the last has the columns of documents.
A row is judged as its predecessor left it. Null or empty texts fail the quality rules and go; of near copies the
document with the smallest id stays; repeated rows are one after that; the mix repeats documents of sources that are
to weigh more than they hold, at most once again; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import mixing, ngram_join, pii, quality_rules, sentencepiece_codec
from folioflow.llm.common import ensure_checkpoint_dir, remove
from folioflow.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return ngram_join.keep_first(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with private values replaced."""
    return pii.pseudonymise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix of sources, repeated where their source is read twice."""
    return mixing.resample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with the end id, and a hash of the decoded text."""
    encoded = sentencepiece_codec.encode_texts(docs, tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("source mix", mixed), ("token ids", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet to the shared checkpoint folder and read again.

    What a stage has read is deleted once its own result is whole; the last but one stays, as the result is read from it.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if read is not None:
            remove(spark, read)
        read = f"{folder}/{k}"
        docs = spark.read.parquet(read)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Components and the token ids can't be expressed in SQL.
ORACLE_SQL = None
