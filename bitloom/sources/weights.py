"""Weight streams over ordinary tables: one row per weight, (unit, tensor_idx, i, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import bf16_bits, exponent, sign_mantissa
from ..functions.prefix import exclusive_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tensors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, tensor_idx, n, start): the tensors of each unit, end to end in the order of their index."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("unit"), F.col("vec_id").alias("tensor_idx"), F.size("embedding").cast("long").alias("n"))
    return exclusive_sum(e, ["unit"], "tensor_idx", "n", "start")


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, tensor_idx, i, w, e, sm): a unit is a label of ``embeddings``, a tensor one of its vectors, cut to BF16."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("unit"), F.col("vec_id").alias("tensor_idx"), "embedding", F.size("embedding").cast("long").alias("n"))
    e = exclusive_sum(e, ["unit"], "tensor_idx", "n", "start")
    rows = e.select("unit", "tensor_idx", "start", F.posexplode("embedding").alias("pos", "v"))
    return with_fields(rows.select("unit", "tensor_idx", (F.col("start") + F.col("pos")).alias("i"), bf16_bits(F.col("v")).alias("w")))


def with_fields(df: DataFrame) -> DataFrame:
    return df.withColumns({"e": exponent(F.col("w")), "sm": sign_mantissa(F.col("w"))})


def raw_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o, w, e, sm): arbitrary 16-bit patterns from the keys of ``lineitem``, with an order column."""
    li = table(spark, sf_dir, "lineitem")
    w = F.expr("cast((l_orderkey * 31 + l_partkey * 17 + l_linenumber) & 65535 as int)")
    return with_fields(li.select(F.expr("l_orderkey * 8 + l_linenumber").alias("o"), "l_partkey", w.alias("w")))
