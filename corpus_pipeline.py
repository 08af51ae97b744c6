"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but
the last return the columns of documents. Null texts count as empty, empty tables give empty
results, further columns pass through, and a repeated row is one more copy for near-dedup.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terselake.llm import byte_bpe, common, decontaminate, secrets, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; labels of the held-out fold are not learned from."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies stays."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets become the names of their kinds, and n_chars follows."""
    return secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the digests of each document's ids and of their decoding."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("secrets", redacted),
    ("byte_bpe", encoded),
]

#: The learned and the iterative stages are beyond SQL; tests hold the run against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves behind is deleted once its result is written, and
    that result once the next one is; only the input of the last stage stays in the shared folder."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = common.shared_dir(spark, name)
        with common.scratch(spark):
            docs = common.written(stage(spark, docs, sf_dir), path)
        if last:
            common.remove_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
