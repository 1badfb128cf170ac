"""A catalog of tensor names over ``part``, for the operators on names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .weights import table

ATTRS = [f"{a}.{b}" for a, bs in (("self_attn", "q_proj k_proj v_proj o_proj"), ("mlp", "gate_proj up_proj down_proj")) for b in bs.split()]
#: What stands in a layer besides what is compressed.
REST = ["input_layernorm", "post_attention_layernorm"]


def catalog(spark: SparkSession, sf_dir: str, prefix: str = "") -> DataFrame:
    """(name, dtype, shape, n_bytes): nine tensors a layer, numbered by part key; every 97th layer's last projection is called a bias."""
    k = "p_partkey"
    attrs = "array(" + ", ".join(f"'{a}'" for a in ATTRS + REST) + ")"
    name = F.expr(f"concat('{prefix}model.layers.', cast({k} div 9 as string), '.', {attrs}[cast({k} % 9 as int)], case when {k} % 873 = 6 then '.bias' else '.weight' end)")
    dtype = F.expr(f"case when {k} % 9 >= 7 then 'F32' else 'BF16' end")
    shape = F.expr(f"array(cast(p_size as bigint), cast(16 + {k} % 7 as bigint))")
    t = table(spark, sf_dir, "part").select(name.alias("name"), dtype.alias("dtype"), shape.alias("shape"))
    return t.withColumn("n_bytes", F.expr("shape[0] * shape[1] * case dtype when 'F32' then 4 else 2 end"))


def layer_units(spark: SparkSession) -> DataFrame:
    """(pi, pattern, ai, attr, n_attrs) of the definition that the catalog follows."""
    rows = [(0, "lm_head", 0, "", 1), (1, r"model\.embed_tokens", 0, "", 1)] + [(2, r"model\.layers\.\d+", i, a, len(ATTRS)) for i, a in enumerate(ATTRS)]
    return spark.createDataFrame(rows, "pi int, pattern string, ai int, attr string, n_attrs int")
