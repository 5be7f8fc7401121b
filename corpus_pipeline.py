"""From raw documents to token ids: quality, near copies, repeated passages, source mix, encoding.

Each stage takes the session, the documents its predecessor kept and the folder of input tables. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import bpe, minhash, mixing, quality, substring
from trialweave.llm.shared import Steps

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("predicted = 1").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return minhash.keep_one(docs, width=5, share=(80, 100))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that a document with a smaller id has."""
    rows = substring.remove_repeats(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests in place of the text."""
    return bpe.encode(docs, vocabularies.path(VOCABULARY), vocabularies.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("minhash near-dedup", one_of_each),
    ("substring dedup", without_repeats),
    ("source mixing", mixed),
    ("byte-level bpe", encoded),
]
#: The classifier, the random mix and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents; what a stage keeps is written and read again by the next."""
    steps, docs = Steps(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        last = docs
        docs = steps.write(stage(spark, docs, sf_dir))
        if hasattr(last, "_llm_path"):
            steps.drop(last)
    return docs
