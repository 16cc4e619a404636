"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of its predecessor and returns a
DataFrame; its result is written as Parquet and read again as the next stage's input.  All
stages but the last return the columns of ``documents``.

One executor's workers go through all stages, so what a stage keeps adds up: Arrow batches are
bounded in bytes, and the tokenizer remembers fewer pieces than when it runs alone.

Defined cases: null and empty texts, rows without words and documents of fewer than 20 words are
rejected by the first stage; a null id never makes a near copy, and its row stays; rows that agree in
id and text leave one; an empty table, or one that loses all rows, gives an empty result; further
columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm import exact_dedup, host_rules, near_dedup, packing, suffix_index
from veilmark.llm.common import bound_batches, shared_folder
from veilmark.llm.queries import tokenizer


BATCH_BYTES = 1 << 20
#: Word pieces a worker remembers; more save time, fewer save memory.
PIECES_KEPT = 40_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host fails as a whole, go."""
    bound_batches(spark, BATCH_BYTES)
    return host_rules.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    bound_batches(spark, BATCH_BYTES)
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays."""
    bound_batches(spark, BATCH_BYTES)
    return near_dedup.dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur elsewhere are taken out of the texts; documents stay."""
    bound_batches(spark, BATCH_BYTES)
    return suffix_index.clean(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their place in sequences of 2048 ids."""
    bound_batches(spark, BATCH_BYTES)
    return packing.pack(packing.tokenise(docs, tokenizer("word_bpe_49k.json"), "word", keep=PIECES_KEPT))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("suffix-array dedup", repeats),
    ("best-fit packing", packed),
]

#: Near copies, repeated strings and a tokenizer's ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
