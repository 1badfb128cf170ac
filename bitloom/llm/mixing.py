"""Mixing sources to target weights by a low-discrepancy slot schedule; DataFrame operations only.

The mix is a row of slots. Slot i lies at the point frac((i + 1/2) * (golden ratio - 1)) of the unit
interval, which the sources' cumulative shares cut into pieces; so every stretch of the schedule
holds each source in nearly its share. A source's share is that of its target over its block length, which is one for all
sources but those whose targets it would cut into too few slots. The r-th slot of a source takes block r, modulo its blocks, of that
source's shuffled token stream: documents in the order of a hash, end to end, cut into blocks of equal
token counts. A document's take is the overlap of its tokens with the blocks taken, repeats counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, table

STEP = 0.6180339887498949


def _plus(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the water level of capped weights.

    A source is capped at ``most`` times its size. In the order of cap / weight, the sources before some
    place are capped and the others share the rest by weight, which is where resharing the excess ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rising = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"total": F.sum("source_size").over(every) * F.lit(float(share)), "capped": F.coalesce(F.sum("cap").over(rising), F.lit(0.0)), "others": F.sum("w").over(every) - F.coalesce(F.sum("w").over(rising), F.lit(0.0))})
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("others"))
    # The level to use is that of the first source, in this order, whose cap is not below it.
    rows = rows.withColumn("at", F.coalesce(F.first(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf"))))
    return rows.select("source", "source_size", F.least("cap", F.col("at") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, slots_per_root: float = 8.0, least_slots: int = 64) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per input row.

    ``weights`` go to the sources in code-point order, null last, repeating; all targets make up ``share``
    times all tokens, none above ``most`` times its source. Blocks hold sqrt(all tokens) / slots_per_root
    tokens, so both blocks and slots grow with the root of the corpus; those of a source with a small target hold
    its target / ``least_slots``, one at least. Null or empty texts have size 0 and
    are never taken; rows that repeat an id count as documents of their own; an empty table gives no rows.
    No document is taken more than ``most`` times: a source's slots beyond its last permitted round are void.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    d = d.withColumn("mix", F.md5(F.concat_ws("/", F.lit("mix"), F.col("doc_id").cast("string"), F.col("size").cast("string"))))
    d = checkpointed(d.withColumn("cell", F.substring("mix", 1, 3)))
    # Sums by (source, cell of the shuffled order): a hot source is spread over 4,096 cells.
    cells = d.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", _plus(F.sum("cell_size").over(before)))
    targets = checkpointed(source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plan = targets.withColumns({"all": F.sum("target").over(every), "tokens": F.sum("source_size").over(every)})
    plan = plan.withColumn("most", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("tokens").cast("double")) / slots_per_root)).cast("long"))
    plan = plan.withColumn("block", F.greatest(F.lit(1), F.least("most", F.floor(F.col("target") / F.lit(least_slots)))).cast("long"))
    # What a source has of the schedule are its slots, in units of the longest block.
    plan = plan.withColumn("has", F.col("target") * (F.col("most") / F.col("block")))
    plan = plan.withColumns({"hi": F.sum("has").over(upto), "all": F.sum("has").over(every)})
    plan = plan.withColumns({"n_blocks": F.ceil(F.col("source_size") / F.col("block")), "lo": (F.col("hi") - F.col("has")) / F.col("all"), "hi": F.col("hi") / F.col("all"), "n_slots": F.round(F.col("all") / F.col("most")).cast("long")})
    plan = checkpointed(plan.where("target > 0").select("source", "block", "n_blocks", "lo", "hi", "n_slots"))
    head = plan.agg(F.max("n_slots"), F.max("hi"), F.count("*")).first()
    rank_of = _slots(docs.sparkSession, plan, int(head[0] or 0), float(head[1] or 1.0))
    small = head[2] <= 100_000
    sized = plan.select("source", "n_blocks")
    taken = (
        rank_of.join(F.broadcast(sized) if small else sized, F.expr("source <=> src"))
        .where(F.col("r") < F.floor(F.col("n_blocks") * F.lit(float(most))))
        .groupBy("src", (F.col("r") % F.col("n_blocks")).alias("nth")).agg(F.count("*").alias("times"))
    )
    inside = Window.partitionBy("source", "cell").orderBy("mix", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    spread = d.withColumn("inner", _plus(F.sum("size").over(inside)))
    spread = spread.join(cells.select(F.col("source").alias("cs"), F.col("cell").alias("cc"), "cell_start"), F.expr("cell = cc and source <=> cs")).drop("cs", "cc")
    facts = targets.join(plan.select(F.col("source").alias("ps"), "block"), F.expr("source <=> ps"), "left").drop("ps").withColumnRenamed("source", "ts")
    spread = spread.join(F.broadcast(facts) if small else facts, F.expr("source <=> ts"), "left")
    spread = spread.withColumn("start", F.col("cell_start") + F.col("inner")).select("doc_id", "source", "size", "source_size", "target", "block", "start", "mix")
    # A row for each block that a document reaches into; one row, with no block, for those of no size.
    reach = F.when((F.col("size") > 0) & F.col("block").isNotNull(), F.expr("sequence(start div block, (start + size - 1) div block)")).otherwise(F.array(F.lit(-1).cast("long")))
    parts = spread.withColumn("nth_block", F.explode(reach))
    over = F.least(F.col("start") + F.col("size"), (F.col("nth_block") + 1) * F.col("block")) - F.greatest("start", F.col("nth_block") * F.col("block"))
    parts = parts.join(taken, F.expr("nth_block = nth and source <=> src"), "left").withColumn("part", F.when(F.col("times").isNotNull(), over * F.col("times")).otherwise(F.lit(0)))
    # start tells apart rows that repeat an id, which lie end to end in the stream; rows of no size may tie and are told by their count.
    out = parts.groupBy("doc_id", "source", "size", "source_size", "target", "start").agg(F.sum("part").cast("long").alias("taken"), F.count("*").alias("n"))
    repeats = F.when(F.col("size") > 0, F.lit(1)).otherwise(F.col("n")).cast("int")
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(1), repeats))).select("doc_id", "source", "size", "source_size", "target", "taken")


def _slots(spark: SparkSession, plan: DataFrame, n: int, top: float, grid: int = 4096) -> DataFrame:
    """(src, r): every slot with its source and its rank among that source's slots.

    Slots meet the sources' intervals by an equi-join on a grid over the unit interval. Ranks come from
    counts by stretch of 4,096 slots, so no source's slots are gathered in one task.
    """
    at = (F.col("id") + 0.5) * F.lit(STEP)
    slots = spark.range(n).select("id", F.least((at - F.floor(at)) * F.lit(top), F.lit(top * (1 - 1e-15))).alias("u"), F.expr("id div 4096").alias("stretch"))
    slots = slots.withColumn("g", F.floor(F.col("u") * grid))
    cut = plan.select(F.col("source").alias("src"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * grid), F.floor(F.col("hi") * grid))).alias("g"))
    hit = slots.join(cut, "g").where("lo <= u and u < hi").select("id", "stretch", "src")
    by = hit.groupBy("src", "stretch").agg(F.count("*").alias("c"))
    by = by.withColumn("before", _plus(F.sum("c").over(Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))).drop("c").withColumnsRenamed({"src": "bs", "stretch": "bt"})
    within = hit.withColumn("k", F.row_number().over(Window.partitionBy("src", "stretch").orderBy("id")) - 1)
    return within.join(by, F.expr("stretch = bt and src <=> bs")).select("src", (F.col("before") + F.col("k")).alias("r"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that the mix takes, with the columns of ``docs`` and, last, the words it takes of each."""
    name = "taken" if "taken" not in docs.columns else "words_taken"
    taken = mix_sources(docs, id_col=id_col, **how).groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max("taken").alias(name))
    return docs.join(taken.where(F.col(name) > 0), F.expr(f"`{id_col}` <=> __mix_id")).drop("__mix_id")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix/' || doc_id || '/' || size), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source
), ranked AS (
  SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS rk,
    coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM s
), leveled AS (
  SELECT (SELECT arg_min((total - capped) / others, rk) FROM ranked WHERE cap >= (total - capped) / others * w) AS lvl, r.* FROM ranked r
), targets AS (
  SELECT source, source_size, least(cap, coalesce(lvl, CAST('inf' AS DOUBLE)) * w) AS target FROM leveled
), spans AS (
  SELECT *, sum(target) OVER (ORDER BY source NULLS LAST) AS upto, sum(target) OVER () AS every, greatest(1, floor(sqrt(sum(source_size) OVER ()) / 8)) AS block FROM targets
), plan AS (
  SELECT source, (upto - target) / every AS lo, upto / every AS hi, CAST(block AS BIGINT) AS block, CAST(ceil(source_size / block) AS BIGINT) AS n_blocks, CAST(round(every / block) AS BIGINT) AS n_slots FROM spans WHERE target > 0
), points AS (
  SELECT i, least(((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE)) * top, top * (1 - 1e-15::DOUBLE)) AS u
  FROM (SELECT unnest(range(0, (SELECT coalesce(max(n_slots), 0) FROM plan))) AS i) CROSS JOIN (SELECT max(hi) AS top FROM plan)
), slots AS (
  SELECT p.source, p.n_blocks, row_number() OVER (PARTITION BY p.source ORDER BY i) - 1 AS r FROM points JOIN plan p ON p.lo <= u AND u < p.hi
), times AS (
  SELECT source, r % n_blocks AS nth, count(*) AS times FROM slots WHERE r < 2 * n_blocks GROUP BY 1, 2
), parts AS (
  SELECT a.doc_id, a.source, a.size, a.start, p.block, unnest(range(a.start // p.block, (a.start + a.size - 1) // p.block + 1)) AS nth FROM placed a JOIN plan p ON p.source IS NOT DISTINCT FROM a.source WHERE a.size > 0
), taken AS (
  SELECT doc_id, sum((least(start + size, (nth + 1) * block) - greatest(start, nth * block)) * times) AS taken FROM parts JOIN times t USING (nth) WHERE t.source IS NOT DISTINCT FROM parts.source GROUP BY 1
)
SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source LEFT JOIN taken k ON k.doc_id = d.doc_id
"""
