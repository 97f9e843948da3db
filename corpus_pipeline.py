"""A corpus from documents: toxic and poor texts go, one of near copies stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphspark.llm import bpe_codec, common, line_quality, near_copies, packing, secret_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the machine learns from the labelled ones."""
    machine = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, machine)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep."""
    field = line_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.keep_good(docs, field)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, secrets masked."""
    return secret_scan.redact(docs, secret_scan.train(spark, words=secret_scan.known_words()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, each with its place in a sequence."""
    return packing.pack_texts(docs.select("doc_id", "text"), bpe_codec.rank_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("near-dedup", drop_copies),
    ("secret scans", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


#: Hashing, learnt models and merges aren't SQL: the tests hold the rows against a plain version.
ORACLE_SQL = None
