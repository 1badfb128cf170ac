"""Line dedup by distinct-site spread: boilerplate is what many sites carry; DataFrame operations only.

A line's sites are counted by a HyperLogLog sketch per line hash. Lines that too few rows hold, or one
site alone, can't reach the threshold and get no sketch. Where the estimate lies within a band around the
threshold, the sites are counted exactly. Lines at or over the threshold are removed everywhere but in the
document of the least id that has them, so that the corpus keeps one copy of whatever it held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table


def _keys(text: Column) -> Column:
    """Hashes (64 and 32 bits) of the lines that aren't blank, as structs."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g")))


def spread_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int = 8, log2_registers: int = 12, band: float = 0.25) -> DataFrame:
    """(id, bad): for each document with lines to remove, their keys (h, g)."""
    lines = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(_keys(F.col(text_col)))).alias("k")).select("id", "site", F.col("k.h").alias("h"), F.col("k.g").alias("g"))
    rough = lines.groupBy("h", "g").agg(F.count("site").alias("n"), F.min("site").alias("a"), F.max("site").alias("z"), F.min("id").alias("first_id"))
    able = rough.where((F.col("n") >= min_sites) & ((F.col("a") != F.col("z")) | F.lit(min_sites <= 1))).select("h", "g", "first_id")
    held = checkpointed(lines.join(able, ["h", "g"]))
    by_site = held.where("site is not null").groupBy("h", "g", "site").agg(F.lit(1).alias("one"))
    about = by_site.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log2_registers))).alias("about"))
    about = checkpointed(about)
    near = about.where(F.col("about").between(min_sites * (1 - band), min_sites * (1 + band)))
    exact = by_site.join(near.select("h", "g"), ["h", "g"]).groupBy("h", "g").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("h", "g")
    wide = about.where(F.col("about") > min_sites * (1 + band)).select("h", "g").union(exact)
    return held.join(wide, ["h", "g"]).where("id is null or id <> first_id").select("id", F.struct("h", "g").alias("k")).groupBy("id").agg(F.collect_set("k").alias("bad"))


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", keep_counts: bool = True, **how) -> DataFrame:
    """``docs`` with ``text_col`` less its boilerplate lines, and n_lines and n_removed last, unless not ``keep_counts``.

    A line is compared without the blanks around it; blank lines are kept, and never counted. A null site is
    no site. Null texts stay null with counts of 0, empty texts stay empty. A line that a document repeats is
    removed or kept at all its places. Rows that share an id are taken for one document; those of a null id
    are no one's first. A document all of whose lines go keeps its row, with what blank lines it had.
    """
    bad = spread_lines(docs, id_col, text_col, site_col, **how).select(F.col("id").alias("__id"), F.col("bad").alias("__bad"))
    out = docs.join(bad, F.expr(f"`{id_col}` <=> __id"), "left")
    gone = lambda x: (F.trim(x) != "") & F.array_contains(F.col("__bad"), F.struct(F.xxhash64(F.trim(x)).alias("h"), F.hash(F.trim(x)).alias("g")))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col("__bad").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x: ~gone(x)), "\n"))
    count = lambda text: F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != "")), F.lit(0))
    out = out.withColumns({"__kept": kept, "__n": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(count(F.col(text_col)))})
    out = out.withColumn("__m", F.when(F.col("__bad").isNull(), F.lit(0)).otherwise(F.col("__n") - count(F.col("__kept"))))
    cols = [F.col("__kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, *([F.col("__n").alias("n_lines"), F.col("__m").alias("n_removed")] if keep_counts else []))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_spread_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, t.i AS i, t.l AS l FROM documents,
    LATERAL (SELECT unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i) t
), wide AS (
  SELECT trim(l) AS k, min(doc_id) AS first_id FROM lines WHERE trim(l) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 8
), marked AS (
  SELECT lines.*, coalesce(wide.first_id <> doc_id, false) AS gone FROM lines LEFT JOIN wide ON trim(l) = k
)
SELECT doc_id, CAST(count(*) FILTER (trim(l) <> '') AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
