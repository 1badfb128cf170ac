"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame for the next one.

Language ID learns from the languages of its own input, as the operator's query does, and drops what it
rejects; line dedup rewrites texts; near-dedup keeps the document of the least id of each group;
decontamination drops documents that cover a benchmark item; mixing keeps what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import langid, line_spread, mixing, near_copies, tiling
from bitloom.shipping import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out()), "doc_id", "text", "lang")
    return langid.keep_identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.remove_spread_lines(docs, keep_counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs, shingle=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def _shipping(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("language_id", _shipping(language_id)),
    ("line_dedup", _shipping(line_dedup)),
    ("near_dedup", _shipping(near_dedup)),
    ("decontamination", _shipping(decontamination)),
    ("mixing", _shipping(mix)),
]
#: Language ID's k-means and the tiles of decontamination have no SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
