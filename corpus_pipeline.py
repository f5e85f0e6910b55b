"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``.  All but the last return the columns of
``documents``; the last deals the documents to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm.decontam import drop_leaks
from loomgraph.llm.jaccard import one_of_each
from loomgraph.llm.kdtree import document_shards
from loomgraph.llm.mixing import mixed_documents
from loomgraph.llm.rules import kept_rows
from loomgraph.plans.store import discard, materialize, scratch_scope

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table keeps.

    A null or empty text has too few words and goes; repeated rows share a verdict.
    """
    return kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by 5-word shingles at 0.8.

    Rows without words are linked with nothing and stay, as do rows with a null id, which no
    id can stand for; equal rows become one, and rows of one id stand or fall together.
    """
    return one_of_each(docs, 5, 80, 100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands within its edit budget.

    A null or wordless text holds no item and stays; repeated rows stand or fall together.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source targets take them, in training order.

    A null source is one of its own, the last; a null or wordless text is never drawn; rows
    that repeat are drawn each on their own, ties in the order of doc_id and text.
    """
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text_crc32, size, shard, slot): shards of nearly equal bytes.

    Null metadata sorts lowest, a null text weighs 1; repeated rows are dealt out like others.
    """
    return document_shards(docs, leaves=SHARDS)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: SQL can't express the k-d tree's medians nor the edit matching; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages wrote is deleted. An empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_scope(spark) as keep:
            before, docs = docs, keep(materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        discard(before)
    return docs
