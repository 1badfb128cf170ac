"""Prefix sums in two levels, so that no group is summed by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exclusive_sum(df: DataFrame, group: list[str], order: str, value: str, out: str, stretch: int = 1 << 16) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of the group before this one by ``order``.

    ``order`` is a whole number, unique in its group. Stretches of it are summed first, which are few, and then the
    rows within each stretch.
    """
    d = df.withColumn("__s", F.expr(f"{order} div {stretch}"))
    before = Window.partitionBy(*group).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*group, "__s").agg(F.sum(value).alias("__t")).withColumn("__b", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy(*group, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return d.join(base, [*group, "__s"]).withColumn(out, (F.col("__b") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long")).drop("__s", "__b")
