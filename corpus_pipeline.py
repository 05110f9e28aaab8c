"""From raw documents to tokens: the pipeline of the training-data operators, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.exact import drop_copies
from spanloom.llm.mixing import repeated
from spanloom.llm.near import one_of_each
from spanloom.llm.quality import held_out, keep_good, learn
from spanloom.llm.queries import bpe_digests
from spanloom.session import shared_folder

# The stages pass through a learnt classifier and hashed signatures, which SQL has no words for.
ORACLE_SQL = None


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    return keep_good(docs, learn(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, so a document can come up to three times."""
    return repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_digests(docs)


STAGES = [("quality classifier", good_only), ("exact dedup", without_copies), ("near-duplicate dedup", without_near_copies),
          ("mix of sources", mixed), ("BPE tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
