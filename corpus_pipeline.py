"""A training corpus from raw documents: quality rules, near copies, benchmark passages, the mix, shards.

Every stage takes a table of documents (doc_id, text, source and any other columns, whose names may be those that operators use
inside) and judges each row by itself or with all others, as its operator's docstring says for null and empty texts, null ids,
ties and repeated rows. An empty table gives an empty table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from coilwave.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from coilwave.llm.shared import shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: null, empty and short texts too."""
    return quality_rules.filtered(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest doc_id. Rows of one doc_id stay or go together."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up 5 % or more go."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=13)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice. A null source is a source."""
    return mixing.mixed_rows(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its place there."""
    return sharding.sharded_rows(docs, shards=16)


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]
#: The weak supervision of the first stage is iterative; SQL does not express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
