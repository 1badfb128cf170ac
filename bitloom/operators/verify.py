"""Structural checks as queries: a row for each unit and rule with how much was checked and how much broke it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codec import CHUNK_BITS, CHUNK_BYTES, MOST_TABLES, MOST_WEIGHTS, RESERVED, WINDOWS_PER_CHUNK


def _rule(df: DataFrame, rule: str, broken) -> DataFrame:
    return df.groupBy("unit").agg(F.count("*").alias("checked"), F.sum(F.when(broken, 1).otherwise(0)).alias("violations")).select("unit", F.lit(rule).alias("rule"), "checked", "violations")


def structure(luts: DataFrame, stream: DataFrame, gap_bytes: DataFrame, positions: DataFrame, splits: DataFrame, counts: DataFrame) -> DataFrame:
    """(unit, rule, checked, violations) for what can be seen without the source; counts has (unit, n)."""
    order = Window.partitionBy("unit").orderBy("chunk")
    tables = luts.groupBy("unit").agg(F.max("tbl").alias("tables"), F.count("*").alias("cells"))
    jumps = luts.join(tables, "unit").where("tbl < tables and v >= 240")
    size = stream.groupBy("unit").agg((F.max("byte_idx") + 1).alias("bytes")).withColumn("chunks", F.ceil(F.col("bytes") / CHUNK_BYTES))
    pos = positions.select("unit", "chunk", "pos", (F.lead("pos").over(order) - F.col("pos")).alias("d"))
    ends = positions.groupBy("unit").agg(F.count("*").alias("entries"), F.min_by("pos", "chunk").alias("a"), F.max_by("pos", "chunk").alias("z"))
    packed = gap_bytes.groupBy("unit").agg((F.max("byte_idx") + 1).alias("gap_bytes"))
    split = splits.select("unit", "split", F.lag("split", 1, 0).over(Window.partitionBy("unit").orderBy("tensor_idx")).alias("before")).join(counts, "unit")
    # An element takes from the shortest to the longest code's bits, which bounds how many a chunk holds from both sides.
    lens = luts.join(tables, "unit").where("tbl = tables and v > 0").groupBy("unit").agg(F.min("v").alias("short"), F.max("v").alias("long"))
    last = Window.partitionBy("unit")
    fill = pos.where("d is not null").withColumn("last", F.max("chunk").over(last)).join(lens, "unit")
    rules = [
        _rule(tables, "luts_rows", (F.col("cells") % 256 != 0) | (F.col("cells") < 512)),
        _rule(tables, "luts_tables", F.col("tables") > MOST_TABLES),
        _rule(jumps, "luts_jump", 256 - F.col("v") >= F.col("tables")),
        _rule(ends.join(size, "unit"), "outpos_count", F.col("entries") != F.col("chunks") + 1),
        _rule(ends, "outpos_first", F.col("a") != 0),
        _rule(ends.join(counts, "unit"), "outpos_total", F.col("z") != F.col("n")),
        _rule(pos.where("d is not null"), "outpos_step", (F.col("d") < 0) | (F.col("d") > CHUNK_BITS)),
        _rule(fill, "outpos_bounds", (F.col("d") * F.col("short") > CHUNK_BITS + F.col("long")) | ((F.col("chunk") < F.col("last")) & ((F.col("d") + 1) * F.col("long") < CHUNK_BITS - F.col("long")))),
        _rule(packed.join(size, "unit"), "gaps_bytes", F.col("gap_bytes") != F.ceil(F.col("chunks") * WINDOWS_PER_CHUNK * 5 / 8)),
        _rule(split, "split_inside", (F.col("split") <= F.col("before")) | (F.col("split") >= F.col("n"))),
        _rule(counts, "weights_limit", F.col("n") > MOST_WEIGHTS),
    ]
    return reduce(DataFrame.unionByName, rules)


def reserved(patterns: DataFrame) -> DataFrame:
    """(reserved, least_o, most_e, least_e): how many patterns have a reserved exponent, the first place of one, and their range."""
    bad = patterns.where(F.col("e") >= RESERVED)
    return bad.agg(F.count("*").alias("reserved"), F.min("o").alias("least_o"), F.max("e").alias("most_e"), F.min("e").alias("least_e"))


def outpos_deltas(positions: DataFrame) -> DataFrame:
    """(unit, chunks, least, most): elements a chunk."""
    order = Window.partitionBy("unit").orderBy("chunk")
    d = positions.select("unit", (F.lead("pos").over(order) - F.col("pos")).alias("d")).where("d is not null")
    return d.groupBy("unit").agg(F.count("*").alias("chunks"), F.min("d").alias("least"), F.max("d").alias("most"))
