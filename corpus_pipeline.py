"""Corpus preparation in five stages, each over all rows that its predecessor kept.

quality: rows that the classifier rejects go. near_duplicates: one row of each group of near copies stays. secrets:
secrets in the texts are masked. mixing: rows are repeated or dropped to reach the sources' target weights. packing:
what is left is tokenised and packed into sequences.

Odd rows. Null texts and empty ones are scored like any other text; those that stay are linked with nothing, hold no secret, count no
words (the mix takes them as its thresholds fall) and are packed as one end id. A null id stays through all stages. Repeated
rows share their score, and one of them stays; the mix may repeat rows again. Ties are broken by each operator as its
module says. Texts of any length are read whole. Empty tables give empty tables. Of extra columns of documents, whatever
their names, none is passed on: each stage returns DOCUMENTS, and packing its pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import mixing, neardup, packing, quality, secrets
from postmill.llm.common import read, removed, scratch, shared_dir
from postmill.llm.queries import tokenizer

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold, by a model that learns from the labels of those given."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs.select(*DOCUMENTS), model).where("predicted = 1").select(*DOCUMENTS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return neardup.deduplicated(docs.select(*DOCUMENTS), size=5, limit=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew where that changed a text."""
    found = secrets.scan(docs.select(*DOCUMENTS))
    masked = secrets.redacted(F.col("text"), F.col("spans"))
    changed = F.size("spans") > 0
    return found.withColumn("masked", masked).select("doc_id", F.col("masked").alias("text"), "lang", "source", F.when(changed, F.length("masked").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs.select(*DOCUMENTS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences, and the ids' checksum for the ids."""
    return packing.pack(docs, tokenizer()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("secrets", without_secrets), ("mixing", mixed_sources), ("packing", packed)]

#: A trained model and the tokenizer have no form in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each result is written to the shared folder and read again. Tables that a stage wrote for
    itself go at its end, and its input once its result stands."""
    docs = read(spark, sf_dir, "documents")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    last = None
    for n, (name, stage) in enumerate(STAGES):
        path = f"{place}/{n}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs
