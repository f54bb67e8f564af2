"""The training-data pipeline over `documents`: language, near duplicates, contamination, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next stage's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from acrely.llm import decontaminate, jaccard_join, kd_shards, language_id, mixing  # noqa: E402
from acrely.llm.common import table  # noqa: E402
from acrely.session import cut, prepare  # noqa: E402


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or about equally near to two languages, go."""
    prepare(spark)
    model = language_id.fit(docs, language_id.training_rows())
    found = language_id.identify(docs, model, into="_identified")
    return found.filter(~language_id.rejected("_identified")).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest identifier stays."""
    prepare(spark)
    return jaccard_join.keep_one(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; a null or wordless text is clean."""
    prepare(spark)
    found = decontaminate.annotate(docs, table(spark, sf_dir, "benchmark"), into="_contamination")
    return found.filter(~decontaminate.contaminated("_contamination")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them, from not at all to three times."""
    prepare(spark)
    return mixing.repeat(mixing.mix(mixing.sized(docs))).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and the place in it."""
    prepare(spark)
    placed = kd_shards.kd_shards(docs)
    return placed.select(*docs.columns, F.col("_shard.shard").alias("shard"), F.col("_shard.slot").alias("slot"))


STAGES = [
    ("identify language", known_language),
    ("near duplicates", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("mix", mixture),
    ("shard", shards),
]

# Language identification and entropy balancing fit models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
