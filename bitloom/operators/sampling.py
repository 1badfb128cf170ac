"""Stratified, seeded samples of chunks, and lookups of elements by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def splitmix(state: int) -> tuple[int, int]:
    """(value, next state) of the 64-bit generator."""
    state = (state + 0x9E3779B97F4A7C15) & MASK
    z = state
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
    return z ^ z >> 31, state


def chunk_of_elements(elements: DataFrame, positions: DataFrame) -> DataFrame:
    """(unit, i, chunk): the last chunk that starts at or before each element; none at or past the end.

    A stretch of positions is met by equality, and within it by order, so no unit is searched as a whole.
    """
    total = positions.groupBy("unit").agg(F.max("chunk").alias("end"), F.max("pos").alias("n"))
    span = positions.join(total, "unit").where("chunk < end").select("unit", "chunk", "pos", "n")
    after = span.select("unit", (F.col("chunk") - 1).alias("chunk"), F.col("pos").alias("upto"))
    span = span.join(after, ["unit", "chunk"], "left").select("unit", "chunk", "pos", F.coalesce("upto", "n").alias("upto")).where("upto > pos")
    cells = span.withColumn("cell", F.explode(F.expr("sequence(pos div 4096, (upto - 1) div 4096)")))
    return elements.withColumn("cell", F.expr("i div 4096")).join(cells, ["unit", "cell"]).where("i >= pos and i < upto").select("unit", "i", "chunk")


def mandatory(positions: DataFrame, splits: DataFrame) -> DataFrame:
    """(unit, chunk): the first and last chunk of each unit, and those that hold the first weight after a split or the last before it."""
    last = positions.groupBy("unit").agg((F.max("chunk") - 1).alias("last")).where("last >= 0")
    ends = last.select("unit", F.explode(F.array(F.lit(0).cast("long"), F.col("last"))).alias("chunk"))
    near = splits.select("unit", F.explode(F.array(F.col("split") - 1, F.col("split"))).alias("i")).distinct()
    return ends.unionByName(chunk_of_elements(near, positions).select("unit", "chunk")).distinct()


def plan(units: list[tuple[int, list[int]]], budget: int, seed: int) -> list[tuple[int, int]]:
    """(unit's number, chunk) picks for (chunks, boundary chunks) of each unit: mandatory ones in any case, the rest at random."""
    picks: dict[tuple[int, int], None] = {}
    for u, (chunks, edges) in enumerate(units):
        if chunks:
            for c in (0, chunks - 1, *edges):
                if c < chunks:
                    picks[(u, c)] = None
    starts, total = [], 0
    for chunks, _ in units:
        starts.append(total)
        total += chunks
    want, free = max(0, budget - len(picks)), total - len(picks)
    if not want or not free:
        return list(picks)

    def at(i: int) -> tuple[int, int]:
        u = max(k for k, s in enumerate(starts) if s <= i)
        return u, i - starts[u]

    if want >= free:
        picks |= dict.fromkeys(map(at, range(total)))
    elif 2 * want > free:
        pool = [p for p in map(at, range(total)) if p not in picks]
        for i in range(want):
            value, seed = splitmix(seed)
            j = i + value % (len(pool) - i)
            pool[i], pool[j] = pool[j], pool[i]
            picks[pool[i]] = None
    else:
        end = len(picks) + want
        while len(picks) < end:
            value, seed = splitmix(seed)
            picks[at(value % total)] = None
    return list(picks)


def sample_plan(spark: SparkSession, positions: DataFrame, splits: DataFrame, budget: int = 1000, seed: int = 0) -> DataFrame:
    """(pick, unit, chunk): the plan over a model's units, whose counts and edges are few and go to the driver."""
    last = {r.unit: r.n for r in positions.groupBy("unit").agg(F.max("chunk").alias("n")).collect()}
    edges: dict[int, list[int]] = {}
    for r in mandatory(positions, splits).orderBy("unit", "chunk").collect():
        edges.setdefault(r.unit, []).append(r.chunk)
    names = sorted(last)
    picks = plan([(last[u], edges.get(u, [])) for u in names], budget, seed)
    return spark.createDataFrame([(k, names[u], c) for k, (u, c) in enumerate(picks)] or [], "pick int, unit int, chunk long")
