"""From raw documents to packed training sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecframe.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from vecframe.llm.queries import VOCABULARY
from vecframe.session import write_and_read


# Texts travel to Python and lie in row groups in small portions: the buffers of all tasks of an executor add up.
PORTIONS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "parquet.block.size": str(16 << 20),
}


def in_portions(spark: SparkSession) -> None:
    """Sets `PORTIONS` for the session of a pipeline, where they are not set already."""
    for key, value in PORTIONS.items():
        if spark.conf.get(key, None) in (None, "67108864b", "10000"):  # absent, or Spark's defaults
            spark.conf.set(key, value)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below the threshold; learns from the labels of the documents given."""
    in_portions(spark)
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.reject(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    in_portions(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near texts the document with the least id."""
    in_portions(spark)
    return near_dedup.drop_near_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go."""
    in_portions(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences."""
    in_portions(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("toxicity", keep_harmless),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack_sequences),
]

# Word classes from a fit, similarity classes and a search for packings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
