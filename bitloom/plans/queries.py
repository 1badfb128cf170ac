"""The registered queries over the weight codec and the catalog, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits
from ..operators import catalog as cat
from ..operators import codec, decode, limiter, sampling, support, verify
from ..sources import catalogs
from ..sources import weights as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# The views that the SQL is built from.
_W = """
raw AS (SELECT label AS unit, vec_id AS tensor_idx, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
abs_v AS (SELECT *, abs(v::DOUBLE) AS x, floor(log2(abs(v::DOUBLE))) AS lg FROM raw),
weights AS (SELECT unit, tensor_idx, row_number() OVER (PARTITION BY unit ORDER BY tensor_idx, p) - 1 AS i,
  CAST((CASE WHEN v < 0 THEN 32768 ELSE 0 END) + (lg + 127) * 128 + floor((x / pow(2, lg) - 1) * 128) AS INTEGER) AS w FROM abs_v),
fields AS (SELECT unit, tensor_idx, i, w, (w >> 7) & 255 AS e, ((w >> 8) & 128) | (w & 127) AS sm FROM weights)"""
_H = _W + ", hist AS (SELECT unit, e, count(*) AS cnt FROM fields GROUP BY 1, 2)"
_MERGE = """
nodes AS (
  SELECT unit, list_sort(list_append(list({'f': CAST(cnt AS BIGINT), 'rep': CAST(e AS INTEGER), 'leaves': [{'sym': CAST(e AS INTEGER), 'bits': 0, 'val': CAST(0 AS BIGINT)}]}),
    {'f': CAST(1 AS BIGINT), 'rep': -1, 'leaves': [{'sym': -1, 'bits': 0, 'val': CAST(0 AS BIGINT)}]})) AS ns FROM hist GROUP BY unit
  UNION ALL
  SELECT unit, list_sort(list_append(ns[3:], {'f': ns[1].f + ns[2].f, 'rep': ns[1].rep, 'leaves': list_concat(
    list_transform(ns[1].leaves, lambda l: {'sym': l.sym, 'bits': l.bits + 1, 'val': l.val}),
    list_transform(ns[2].leaves, lambda l: {'sym': l.sym, 'bits': l.bits + 1, 'val': (CAST(1 AS BIGINT) << l.bits) + l.val}))})) FROM nodes WHERE len(ns) > 1
), flat AS (SELECT unit, unnest(ns[1].leaves) AS l, generate_subscripts(ns[1].leaves, 1) - 1 AS ord FROM nodes WHERE len(ns) = 1),
book AS (SELECT unit, CAST(ord AS INTEGER) AS ord, l.sym AS sym, l.bits AS bits, l.val AS val FROM flat)"""
_B = "WITH RECURSIVE " + _H + "," + _MERGE
_C = _B + """,
coded AS (SELECT f.unit, f.i, f.e, b.bits, b.val, CAST(coalesce(sum(b.bits) OVER (PARTITION BY f.unit ORDER BY f.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off
  FROM fields f JOIN book b ON b.unit = f.unit AND b.sym = f.e),
totals AS (SELECT c.unit, count(*) AS n, CAST(sum(c.bits) AS BIGINT) AS total_bits FROM coded c GROUP BY 1),
starts AS (SELECT unit, i, off FROM coded UNION ALL SELECT unit, n, total_bits FROM totals WHERE total_bits % 8 <> 0)"""
_P = _C + """,
firsts AS (SELECT unit, off // 32768 AS chunk, min(i) AS pos FROM starts GROUP BY 1, 2),
positions AS (SELECT * FROM firsts UNION ALL SELECT f.unit, max(f.chunk) + 1, any_value(t.n) FROM firsts f JOIN totals t USING (unit) GROUP BY 1)"""
_S = _P + """,
fields_out AS (SELECT c.unit, c.bits, c.val, c.off, (c.off + c.bits - 1) // 8 AS upto FROM coded c
  UNION ALL SELECT t.unit, b.bits, b.val, t.total_bits, t.total_bits // 8 FROM totals t JOIN book b ON b.unit = t.unit AND b.sym = -1 WHERE t.total_bits % 8 <> 0),
parts AS (SELECT unit, bits, val, off, unnest(range(off // 8, upto + 1)) AS byte_idx FROM fields_out),
stream AS (SELECT unit, byte_idx, bit_or(CAST((CASE WHEN 8 * (byte_idx + 1) - off - bits >= 0 THEN val << CAST(8 * (byte_idx + 1) - off - bits AS INTEGER)
  ELSE val >> CAST(off + bits - 8 * (byte_idx + 1) AS INTEGER) END) & 255 AS INTEGER)) AS b FROM parts GROUP BY 1, 2)"""
_BLK = _C + """,
lens AS (SELECT unit, i // 64 AS blk, CAST(sum(bits) AS BIGINT) AS bits, count(*) AS k FROM coded GROUP BY 1, 2),
least AS (SELECT unit, coalesce(min(bits) FILTER (k = 64), min(bits)) AS minlen FROM lens GROUP BY 1),
blocks AS (SELECT l.unit, l.blk, l.bits, m.minlen, CAST(CASE WHEN l.bits - m.minlen BETWEEN 0 AND 254 THEN l.bits - m.minlen ELSE 255 END AS INTEGER) AS code,
  NOT (l.bits - m.minlen BETWEEN 0 AND 254) AS escaped FROM lens l JOIN least m USING (unit))"""
#: The units of the tables, and a unit of Fibonacci frequencies whose codes leave a table's first cell unset.
_FIB = "SELECT 1000 AS unit, CAST(s AS INTEGER) AS e, CAST(f AS BIGINT) AS cnt FROM (VALUES " + ", ".join(f"({s}, {f})" for s, f in enumerate(limiter.fibonacci(25))) + ") t(s, f)"
_L = "WITH RECURSIVE " + _H.replace("hist AS (", "hist0 AS (") + f", hist AS (SELECT * FROM hist0 UNION ALL {_FIB})," + _MERGE + """,
codes AS (SELECT unit, ord, sym, bits, lpad(bin(val), bits, '0') AS code, (greatest(bits, 1) - 1) // 8 AS last FROM book WHERE sym >= 0),
met AS (SELECT unit, prefix, min(ord) AS ord FROM (SELECT unit, ord, substring(code, 1, CAST(last * 8 AS INTEGER)) AS prefix FROM codes UNION ALL SELECT DISTINCT unit, -1, '' FROM book) GROUP BY 1, 2),
tables AS (SELECT unit, CAST(row_number() OVER (PARTITION BY unit ORDER BY length(prefix), ord) - 1 AS INTEGER) AS tbl, prefix FROM met),
steps AS (SELECT *, substring(code, 1, CAST(8 * t AS INTEGER)) AS prefix, substring(code, 1, CAST(8 * t + 8 AS INTEGER)) AS upto,
  list_reduce(list_transform(string_split(rpad(substring(code, CAST(8 * t + 1 AS INTEGER), 8), 8, '0'), ''), lambda c: CAST(c AS INTEGER)), lambda a, b: 2 * a + b) AS byte
  FROM (SELECT *, unnest(range(0, last + 1)) AS t FROM codes)),
cells AS (SELECT s.unit, h.tbl, s.byte, min(CASE WHEN s.t = s.last THEN s.sym ELSE 256 - n.tbl END) AS v FROM steps s JOIN tables h ON h.unit = s.unit AND h.prefix = s.prefix
  LEFT JOIN tables n ON n.unit = s.unit AND n.prefix = s.upto GROUP BY 1, 2, 3),
grid AS (SELECT t.unit, t.tbl, CAST(g.b AS INTEGER) AS byte, c.v FROM tables t CROSS JOIN range(256) g(b) LEFT JOIN cells c ON c.unit = t.unit AND c.tbl = t.tbl AND c.byte = g.b),
lengths AS (SELECT n.unit, CAST(n.n AS INTEGER) AS tbl, CAST(g.b AS INTEGER) AS byte, coalesce(b.bits, 0) AS v FROM (SELECT unit, max(tbl) + 1 AS n FROM tables GROUP BY 1) n CROSS JOIN range(256) g(b)
  LEFT JOIN book b ON b.unit = n.unit AND b.sym = g.b)"""


def _book(spark, sf):
    w = src.weights(spark, sf)
    h = codec.histogram(w)
    return w, h, codec.codebook(h)


def _coded(spark, sf):
    w, h, b = _book(spark, sf)
    return w, codec.coded(w, b), codec.unit_totals(h, b), b


def _lut_parts(spark, sf):
    h = codec.histogram(src.weights(spark, sf)).unionByName(spark.createDataFrame([(1000, s, f) for s, f in enumerate(limiter.fibonacci(25))], "unit int, e int, cnt long"))
    b = codec.codebook(h)
    t = codec.prefix_tables(b)
    return b, t, codec.lut_cells(b, t)


def _luts(b):
    t = codec.prefix_tables(b)
    return codec.luts(b, t, codec.lut_cells(b, t), correct=False)


@query("WITH " + _W + " SELECT unit, i, w, CAST(e AS INTEGER) AS e, CAST(sm AS INTEGER) AS sm FROM fields")
def field_split(spark, sf):
    return src.weights(spark, sf).select("unit", "i", "w", "e", "sm")


@query("""WITH r AS (SELECT (l_orderkey * 31 + l_partkey * 17 + l_linenumber) & 65535 AS w FROM lineitem)
SELECT CAST((w >> 7) & 255 AS INTEGER) AS e, count(*) AS n, CAST(count(*) AS BIGINT) AS same, CAST(sum(w) AS BIGINT) AS sum_w FROM r GROUP BY 1""")
def field_recombine(spark, sf):
    p = src.raw_patterns(spark, sf).withColumn("back", bits.recombine(F.col("e"), F.col("sm")))
    return p.groupBy("e").agg(F.count("*").alias("n"), F.count(F.when(F.col("back") == F.col("w"), 1)).alias("same"), F.sum("back").alias("sum_w"))


@query("WITH " + _H + " SELECT unit, CAST(e AS INTEGER) AS e, cnt FROM hist")
def exponent_histogram(spark, sf):
    return codec.histogram(src.weights(spark, sf))


@query("WITH " + _H + """ SELECT unit, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS symbols, CAST(min(e) AS INTEGER) AS least_e, CAST(max(e) AS INTEGER) AS most_e,
  string_agg(e || ':' || cnt, ',' ORDER BY e) AS frequencies FROM hist GROUP BY unit""")
def histogram_summary(spark, sf):
    h = codec.histogram(src.weights(spark, sf))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "cnt"))), lambda x: F.concat_ws(":", x["e"], x["cnt"])), ",")
    return h.groupBy("unit").agg(F.sum("cnt").alias("total"), F.count("*").alias("symbols"), F.min("e").alias("least_e"), F.max("e").alias("most_e"), listed.alias("frequencies"))


@query("""WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS o, (((l_orderkey * 31 + l_partkey * 17 + l_linenumber) & 65535) >> 7) & 255 AS e FROM lineitem)
SELECT count(*) AS reserved, min(o) AS least_o, CAST(max(e) AS INTEGER) AS most_e, CAST(min(e) AS INTEGER) AS least_e FROM r WHERE e >= 240""")
def reserved_exponents(spark, sf):
    return verify.reserved(src.raw_patterns(spark, sf))


@query(_L + """, sized AS (SELECT unit, max(bits) AS longest FROM book GROUP BY 1), t AS (SELECT unit, count(*) AS tables FROM tables GROUP BY 1), n AS (SELECT unit, CAST(sum(cnt) AS BIGINT) AS n FROM hist GROUP BY 1)
SELECT unit, n, CAST(tables AS BIGINT) AS tables, longest, n > 2147483647 AS too_many_weights, tables > 17 AS too_many_tables, longest > 32 AS code_too_long FROM n JOIN t USING (unit) JOIN sized USING (unit)""")
def unit_limits(spark, sf):
    b, t, _ = _lut_parts(spark, sf)
    h = codec.histogram(src.weights(spark, sf)).unionByName(spark.createDataFrame([(1000, s, f) for s, f in enumerate(limiter.fibonacci(25))], "unit int, e int, cnt long"))
    n, tables, longest = h.groupBy("unit").agg(F.sum("cnt").alias("n")), t.groupBy("unit").agg(F.count("*").alias("tables")), b.groupBy("unit").agg(F.max("bits").alias("longest"))
    return n.join(tables, "unit").join(longest, "unit").select("*", (F.col("n") > codec.MOST_WEIGHTS).alias("too_many_weights"), (F.col("tables") > codec.MOST_TABLES).alias("too_many_tables"), (F.col("longest") > codec.MOST_BITS).alias("code_too_long"))


@query(_C + """, p AS (SELECT unit, e, sm >> 7 AS s, sm & 127 AS m FROM fields),
he AS (SELECT unit, -sum(c / t * log2(c / t)) AS h FROM (SELECT unit, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY unit)::DOUBLE AS t FROM p GROUP BY unit, e) GROUP BY 1),
hs AS (SELECT unit, -sum(c / t * log2(c / t)) AS h FROM (SELECT unit, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY unit)::DOUBLE AS t FROM p GROUP BY unit, s) GROUP BY 1),
hm AS (SELECT unit, -sum(c / t * log2(c / t)) AS h FROM (SELECT unit, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY unit)::DOUBLE AS t FROM p GROUP BY unit, m) GROUP BY 1)
SELECT t.unit, t.n, round(he.h, 6) AS h_exponent, round(hs.h, 6) AS h_sign, round(hm.h, 6) AS h_mantissa, round(t.total_bits::DOUBLE / t.n, 6) AS coded_bits, round(t.total_bits::DOUBLE / t.n + 8, 6) AS bits_per_weight
FROM totals t JOIN he USING (unit) JOIN hs USING (unit) JOIN hm USING (unit)""")
def entropy_bits_per_weight(spark, sf):
    w, h, b = _book(spark, sf)

    def entropy(key, name):
        c = w.groupBy("unit", key.alias("k")).agg(F.count("*").alias("c"))
        t = c.groupBy("unit").agg(F.sum("c").alias("t"))
        p = F.col("c") / F.col("t")
        return c.join(t, "unit").groupBy("unit").agg(F.round(-F.sum(p * F.log2(p)), 6).alias(name))

    out = codec.unit_totals(h, b).select("unit", "n", F.round(F.col("total_bits") / F.col("n"), 6).alias("coded_bits"), F.round(F.col("total_bits") / F.col("n") + 8, 6).alias("bits_per_weight"))
    for key, name in ((F.col("e"), "h_exponent"), (F.shiftright("sm", 7), "h_sign"), (F.col("sm").bitwiseAND(127), "h_mantissa")):
        out = out.join(entropy(key, name), "unit")
    return out


@query(_B + " SELECT unit, ord, sym, bits, val FROM book")
def huffman_codebook(spark, sf):
    return _book(spark, sf)[2]


@query(_L + " SELECT unit, tbl, byte, CAST(v AS INTEGER) AS v FROM lengths")
def code_lengths_row(spark, sf):
    b, t, _ = _lut_parts(spark, sf)
    return codec.code_lengths(b, t)


@query(_C + " SELECT unit, i // 1024 AS chunk, CAST(sum(bits) AS BIGINT) AS bits FROM coded GROUP BY 1, 2")
def chunk_bit_lengths(spark, sf):
    w, _, b = _book(spark, sf)
    return codec.chunk_bits(w, b, 1024)


@query(_C + " SELECT unit, i, CAST(e AS INTEGER) AS e, bits, val, off FROM coded")
def code_bit_offsets(spark, sf):
    return _coded(spark, sf)[1].select("unit", "i", "e", "bits", "val", "off")


@query(_S + " SELECT unit, byte_idx, b FROM stream")
def bitstream_bytes(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return codec.bitstream(c, t)


@query(_C + " SELECT unit, off // 64 AS win, CAST(min(off % 64) AS INTEGER) AS gap FROM starts GROUP BY 1, 2")
def gaps(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return codec.gaps(c, t)


@query(_C + """, g AS (SELECT unit, off // 64 AS win, min(off % 64) AS gap FROM starts GROUP BY 1, 2),
f AS (SELECT unit, gap, win * 5 AS off, unnest(range(win * 5 // 8, (win * 5 + 4) // 8 + 1)) AS byte_idx FROM g),
zeros AS (SELECT unit, unnest(range(0, CAST(320 * ceil(ceil(total_bits / 8) / 4096) AS BIGINT))) AS byte_idx FROM totals)
SELECT z.unit, z.byte_idx, coalesce(bit_or(CAST((CASE WHEN 8 * (f.byte_idx + 1) - f.off - 5 >= 0 THEN f.gap << CAST(8 * (f.byte_idx + 1) - f.off - 5 AS INTEGER) ELSE f.gap >> CAST(f.off + 5 - 8 * (f.byte_idx + 1) AS INTEGER) END) & 255 AS INTEGER)), 0) AS b
FROM zeros z LEFT JOIN f ON f.unit = z.unit AND f.byte_idx = z.byte_idx GROUP BY 1, 2""")
def gaps_packed(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return codec.packed_gaps(codec.padded_gaps(codec.gaps(c, t), t))


@query(_C + """, g AS (SELECT unit, off // 64 AS win, min(off % 64) AS gap FROM starts GROUP BY 1, 2), n AS (SELECT unit, unnest(range(0, CAST(512 * ceil(ceil(total_bits / 8) / 4096) AS BIGINT))) AS win FROM totals)
SELECT n.unit, n.win, CAST(coalesce(g.gap, 0) AS INTEGER) AS gap FROM n LEFT JOIN g USING (unit, win)""")
def gaps_unpacked(spark, sf):
    return codec.unpacked_gaps(gaps_packed(spark, sf))


@query(_P + " SELECT unit, chunk, pos FROM positions")
def output_positions(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return codec.output_positions(c, t)


_SPLITS = "SELECT unit, tensor_idx, CAST(split AS BIGINT) AS split FROM (SELECT label AS unit, vec_id AS tensor_idx, sum(len(embedding)) OVER (PARTITION BY label ORDER BY vec_id) AS split, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS after FROM embeddings) WHERE after IS NOT NULL"


@query(_SPLITS)
def split_positions(spark, sf):
    return codec.split_positions(src.tensors_of(spark, sf))


@query(_L + " SELECT unit, tbl, prefix FROM tables")
def prefix_tables(spark, sf):
    return _lut_parts(spark, sf)[1]


@query(_L + " SELECT unit, tbl, byte, CAST(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY unit ORDER BY tbl, byte ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS v FROM grid UNION ALL SELECT unit, tbl, byte, v FROM lengths")
def luts_compat(spark, sf):
    b, t, c = _lut_parts(spark, sf)
    return codec.luts(b, t, c, correct=False)


@query(_L + " SELECT unit, tbl, byte, CAST(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY unit, tbl ORDER BY byte ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS v FROM grid UNION ALL SELECT unit, tbl, byte, v FROM lengths")
def luts_correct(spark, sf):
    b, t, c = _lut_parts(spark, sf)
    return codec.luts(b, t, c, correct=True)


@query(_L + """, f AS (SELECT unit, tbl, min(byte) AS leaked, arg_max(v, byte) AS last_v FROM cells GROUP BY 1, 2)
SELECT f.unit, f.tbl, CAST(f.leaked AS INTEGER) AS leaked, CAST(b.last_v AS INTEGER) AS carried FROM f JOIN f b ON b.unit = f.unit AND b.tbl = f.tbl - 1 WHERE f.leaked > 0""")
def lut_leaks(spark, sf):
    _, t, c = _lut_parts(spark, sf)
    return codec.lut_leaks(t, c)


def _chunks(spark, sf):
    w, c, t, b = _coded(spark, sf)
    return w, decode.decode_chunks(decode.chunk_rows(codec.bitstream(c, t), codec.gaps(c, t), codec.output_positions(c, t), _luts(b)))


@query(_W.replace("\nraw", "WITH raw", 1) + " SELECT unit, count(*) AS n, CAST(0 AS BIGINT) AS wrong, CAST(sum(e * (i % 97)) AS BIGINT) AS mix FROM fields GROUP BY 1")
def decode_roundtrip(spark, sf):
    """Everything decoded through tables and indices alone, against the source."""
    w, d = _chunks(spark, sf)
    met = d.select("unit", "i", "sym").join(w.select("unit", "i", "e"), ["unit", "i"], "full_outer")
    return met.groupBy("unit").agg(F.count("*").alias("n"), F.count(F.when(~F.col("sym").eqNullSafe(F.col("e")), 1)).alias("wrong"), F.sum(F.col("sym") * (F.col("i") % 97)).alias("mix"))


@query(_P + """, spans AS (SELECT unit, chunk, pos, lead(pos) OVER (PARTITION BY unit ORDER BY chunk) AS upto FROM positions)
SELECT s.unit, s.chunk, count(*) AS n, min(f.i) AS least_i, CAST(sum(f.e * (f.i % 89)) AS BIGINT) AS mix FROM spans s JOIN fields f ON f.unit = s.unit AND f.i >= s.pos AND f.i < s.upto GROUP BY 1, 2""")
def chunk_decode(spark, sf):
    _, d = _chunks(spark, sf)
    return d.groupBy("unit", "chunk").agg(F.count("*").alias("n"), F.min("i").alias("least_i"), F.sum(F.col("sym") * (F.col("i") % 89)).alias("mix"))


def _blocks(spark, sf):
    _, c, t, b = _coded(spark, sf)
    return codec.idx8_blocks(c), c, t, b


@query(_BLK + " SELECT unit, blk, bits, minlen, code, escaped FROM blocks")
def idx8_lengths(spark, sf):
    return _blocks(spark, sf)[0]


@query(_BLK + " SELECT unit, sb, CAST(coalesce(sum(t) OVER (PARTITION BY unit ORDER BY sb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM (SELECT unit, blk // 32 AS sb, sum(bits) AS t FROM blocks GROUP BY 1, 2)")
def idx8_superblocks(spark, sf):
    return codec.idx8_superblocks(_blocks(spark, sf)[0])


@query(_BLK + " SELECT unit, blk, bits FROM blocks WHERE escaped")
def idx8_escapes(spark, sf):
    return _blocks(spark, sf)[0].where("escaped").select("unit", "blk", "bits")


@query(_BLK + " SELECT unit, blk, CAST(off - bits AS BIGINT) AS start_bit, CAST(off AS BIGINT) AS end_bit FROM (SELECT unit, blk, bits, sum(bits) OVER (PARTITION BY unit ORDER BY blk) AS off FROM blocks)")
def idx8_block_ranges(spark, sf):
    b = _blocks(spark, sf)[0]
    return codec.idx8_ranges(b, codec.idx8_superblocks(b), b.where("escaped"))


@query(_BLK + " SELECT unit, blk, CAST(k AS INTEGER) AS n, true AS ends_right FROM lens")
def idx8_block_decode(spark, sf):
    blocks, c, t, b = _blocks(spark, sf)
    ranges = codec.idx8_ranges(blocks, codec.idx8_superblocks(blocks), blocks.where("escaped"))
    return decode.decode_blocks(ranges, codec.bitstream(c, t), _luts(b))


@query(_S + """, rules(rule) AS (VALUES ('luts_rows'), ('luts_tables'), ('outpos_count'), ('outpos_first'), ('outpos_total'), ('outpos_step'), ('outpos_bounds'), ('gaps_bytes'), ('split_inside'), ('weights_limit'))
SELECT t.unit, r.rule, CAST(CASE r.rule WHEN 'outpos_step' THEN p.k WHEN 'outpos_bounds' THEN p.k WHEN 'split_inside' THEN s.k ELSE 1 END AS BIGINT) AS checked, CAST(0 AS BIGINT) AS violations
FROM totals t CROSS JOIN rules r JOIN (SELECT unit, count(*) - 1 AS k FROM positions GROUP BY 1) p ON p.unit = t.unit JOIN (SELECT label AS unit, count(*) - 1 AS k FROM embeddings GROUP BY 1) s ON s.unit = t.unit""")
def structure_violations(spark, sf):
    w, c, t, b = _coded(spark, sf)
    pos = codec.output_positions(c, t)
    packed = codec.packed_gaps(codec.padded_gaps(codec.gaps(c, t), t))
    return verify.structure(_luts(b), codec.bitstream(c, t), packed, pos, codec.split_positions(src.tensors_of(spark, sf)), t.select("unit", "n")).where("rule <> 'luts_jump'")


@query(_L + """, n AS (SELECT unit, max(tbl) + 1 AS n FROM tables GROUP BY 1), f AS (SELECT unit, tbl, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY unit ORDER BY tbl, byte ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM grid)
SELECT f.unit, count(*) AS checked, CAST(sum(CASE WHEN 256 - f.v >= n.n THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM f JOIN n USING (unit) WHERE f.v >= 240 GROUP BY 1""")
def lut_jumps(spark, sf):
    """Cells that send to another table, and how many of them to one that isn't there."""
    b, t, c = _lut_parts(spark, sf)
    filled = codec.luts(b, t, c, correct=False)
    n = t.groupBy("unit").agg((F.max("tbl") + 1).alias("n"))
    jumps = filled.join(n, "unit").where("tbl < n and v >= 240")
    return jumps.groupBy("unit").agg(F.count("*").alias("checked"), F.sum(F.when(256 - F.col("v") >= F.col("n"), 1).otherwise(0)).alias("violations"))


@query(_P + " SELECT unit, count(*) AS chunks, min(d) AS least, max(d) AS most FROM (SELECT unit, lead(pos) OVER (PARTITION BY unit ORDER BY chunk) - pos AS d FROM positions) WHERE d IS NOT NULL GROUP BY 1")
def outpos_delta_bounds(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return verify.outpos_deltas(codec.output_positions(c, t))


_SPANS = _P + f""", splits AS ({_SPLITS}), spans AS (SELECT unit, chunk, pos, coalesce(lead(pos) OVER (PARTITION BY unit ORDER BY chunk), pos) AS upto FROM positions)"""


@query(_SPANS + " SELECT s.unit, s.split AS i, max(p.chunk) AS chunk FROM splits s JOIN spans p ON p.unit = s.unit AND p.pos <= s.split AND p.upto > p.pos GROUP BY 1, 2")
def chunk_of_element(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return sampling.chunk_of_elements(codec.split_positions(src.tensors_of(spark, sf)).select("unit", F.col("split").alias("i")), codec.output_positions(c, t))


@query(_SPANS + """ SELECT DISTINCT unit, chunk FROM (SELECT unit, 0 AS chunk FROM totals UNION ALL SELECT unit, max(chunk) - 1 FROM positions GROUP BY 1
UNION ALL SELECT s.unit, p.chunk FROM splits s JOIN spans p ON p.unit = s.unit AND ((s.split >= p.pos AND s.split < p.upto) OR (s.split - 1 >= p.pos AND s.split - 1 < p.upto)))""")
def sample_mandatory(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return sampling.mandatory(codec.output_positions(c, t), codec.split_positions(src.tensors_of(spark, sf)))


@query()
def sample_plan(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    return sampling.sample_plan(spark, codec.output_positions(c, t), codec.split_positions(src.tensors_of(spark, sf)), budget=40, seed=7)


@query()
def limiter_outcomes(spark, sf):
    """What becomes of the frequencies that need capping; the tables have no such streams."""
    cases = list(limiter.limiter_cases())
    rows = [(k, s, f) for k, (_, freqs) in enumerate(cases) for s, f in freqs]
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(cases)], "unit int, name string")
    return limiter.limit_codebooks(spark.createDataFrame(rows, "unit int, e int, cnt long")).join(names, "unit").drop("unit")


ORACLES["limiter_outcomes"] = """SELECT * FROM (VALUES
 ('fib30', 'ok', 0, 30, 30, NULL::INTEGER, NULL::BIGINT, NULL::INTEGER, NULL::INTEGER), ('fib36', 'ok', 6, 36, 32, NULL, NULL, NULL, NULL), ('fib40', 'ok', 11, 40, 32, NULL, NULL, NULL, NULL), ('fib45', 'ok', 17, 45, 32, NULL, NULL, NULL, NULL),
 ('fib40_ties_at_1', 'ok', 11, 37, 32, NULL, NULL, NULL, NULL), ('fib40_ties_at_2', 'ambiguous_limiter_tie', 1, 37, NULL, 2, 2, 6, 2), ('fib40_ties_at_3', 'ambiguous_limiter_tie', 1, 34, NULL, 2, 3, 10, 2), ('realistic_skew', 'ok', 0, 23, 23, NULL, NULL, NULL, NULL)
) t(name, outcome, rounds, uncapped, longest, min_k, boundary, tied, slots)"""

_ATTRS = "['" + "', '".join(catalogs.ATTRS + catalogs.REST) + "']"
_CAT = f"""cat AS (SELECT 'model.layers.' || (p_partkey // 9) || '.' || {_ATTRS}[p_partkey % 9 + 1] || CASE WHEN p_partkey % 873 = 6 THEN '.bias' ELSE '.weight' END AS name,
  CASE WHEN p_partkey % 9 >= 7 THEN 'F32' ELSE 'BF16' END AS dtype, CAST(p_size AS BIGINT) AS d0, 16 + p_partkey % 7 AS d1,
  p_size * (16 + p_partkey % 7) * CASE WHEN p_partkey % 9 >= 7 THEN 4 ELSE 2 END AS n_bytes FROM part)"""
_FOUND = f"""WITH {_CAT}, units AS (SELECT unnest(range(0, 7)) AS ai, unnest(['{"', '".join(catalogs.ATTRS)}']) AS attr),
found AS (SELECT regexp_extract(name, '^(model\\.layers\\.[0-9]+)\\.', 1) AS module, ai, name FROM cat JOIN units ON ends_with(name, '.' || attr || '.weight'))"""


def _found(spark, sf):
    names, units = catalogs.catalog(spark, sf), catalogs.layer_units(spark)
    return cat.candidates(names.select("name"), units), names, units


@query(f"WITH {_CAT} SELECT name, dtype, array_to_string([d0, d1], 'x') AS shape, CAST(n_bytes AS BIGINT) AS n_bytes, true AS consistent FROM cat")
def tensor_catalog(spark, sf):
    t = catalogs.catalog(spark, sf)
    return t.select("name", "dtype", F.array_join(F.transform("shape", lambda x: x.cast("string")), "x").alias("shape"), "n_bytes", cat.consistent(F.col("dtype"), F.col("shape"), F.col("n_bytes")).alias("consistent"))


@query(f"WITH {_CAT} SELECT name, substring(name, 14) AS visible FROM cat WHERE name LIKE 'model.layers.%'")
def name_map_prefix(spark, sf):
    return cat.strip_prefix(catalogs.catalog(spark, sf), "model.layers.")


@query(f"WITH {_CAT} SELECT name, replace(regexp_replace(substring(name, 7), 'self_attn\\.([qkv])_proj', 'attn.\\1'), 'bias', 'weight') AS visible FROM cat WHERE NOT regexp_matches(name, 'post_attention')")
def name_map_rules(spark, sf):
    return cat.apply_rules(catalogs.catalog(spark, sf), ["other.", "model."], ["post_attention"], [(r"self_attn\.([qkv])_proj", r"attn.$1"), (r"bias$", "weight")])


@query(_FOUND + """, u AS (SELECT module, string_agg(name, ';' ORDER BY ai) AS tensors FROM found GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY CAST(regexp_extract(module, '[0-9]+$') AS INTEGER)) - 1 AS INTEGER) AS unit_idx, module AS unit, tensors FROM u""")
def discover_units(spark, sf):
    return cat.discovered(_found(spark, sf)[0]).withColumn("tensors", F.array_join("tensors", ";"))


@query(_FOUND + " SELECT m.module, units.attr FROM (SELECT DISTINCT module FROM found) m CROSS JOIN units ANTI JOIN found f ON f.module = m.module AND f.ai = units.ai")
def incomplete_units(spark, sf):
    found, _, units = _found(spark, sf)
    return cat.incomplete(found, units).select("module", "attr")


@query(_FOUND + " SELECT m.module AS unit, c.name FROM cat c JOIN (SELECT DISTINCT module FROM found) m ON starts_with(c.name, m.module || '.') ANTI JOIN found f ON f.name = c.name")
def discover_siblings(spark, sf):
    found, names, _ = _found(spark, sf)
    return cat.siblings(found, names)


@query(_FOUND + " SELECT c.name FROM cat c ANTI JOIN (SELECT DISTINCT module FROM found) m ON starts_with(c.name, m.module || '.')")
def discover_passthrough(spark, sf):
    found, names, _ = _found(spark, sf)
    return cat.passthrough(found, names)


@query("SELECT o.module AS outer_unit, i.module AS inner_unit FROM (SELECT DISTINCT p_brand AS module FROM part) o JOIN (SELECT DISTINCT p_brand || '.' || p_size AS module FROM part) i ON starts_with(i.module, o.module || '.')")
def nested_units(spark, sf):
    p = src.table(spark, sf, "part")
    return cat.nested(p.select(F.col("p_brand").alias("module")).union(p.select(F.concat_ws(".", "p_brand", "p_size"))))


@query("SELECT p_brand || '.' || p_size AS name, count(*) AS claims FROM part GROUP BY 1 HAVING count(*) > 1")
def contested_tensors(spark, sf):
    return cat.contested(src.table(spark, sf, "part").select(F.concat_ws(".", "p_brand", "p_size").alias("name")))


_ORDERED = f"WITH {_CAT}, o AS (SELECT *, row_number() OVER w - 1 AS place, CAST(sum(n_bytes) OVER w AS BIGINT) AS off_end FROM cat WINDOW w AS (ORDER BY dtype = 'F32' DESC, name))"


@query(_ORDERED + " SELECT name, dtype, place FROM o")
def canonical_order(spark, sf):
    return cat.canonical(catalogs.catalog(spark, sf).select("name", "dtype", "n_bytes")).select("name", "dtype", "place")


@query(_ORDERED + " SELECT name, CAST(off_end - n_bytes AS BIGINT) AS off_begin, off_end FROM o")
def header_offsets(spark, sf):
    return cat.canonical(catalogs.catalog(spark, sf).select("name", "dtype", "n_bytes")).select("name", "off_begin", "off_end")


@query(f"WITH {_CAT} SELECT name, row_number() OVER (ORDER BY CAST(regexp_extract(name, '([0-9]+)', 1) AS INTEGER), name) AS nth FROM cat")
def natural_order(spark, sf):
    t = catalogs.catalog(spark, sf).select("name", bits.natural_key(F.col("name")).alias("k"))
    # Ranks inside a layer, and layers' counts before it: no task sorts all names.
    t = t.withColumn("cell", F.substring("k", 1, 52))
    c = t.groupBy("cell").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return t.join(c, "cell").select("name", (F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("k"))).alias("nth"))


@query(f"WITH {_CAT} SELECT name, CASE WHEN n_bytes % 11 = 0 THEN 'missing' WHEN n_bytes % 13 = 0 THEN 'extra' WHEN n_bytes % 7 = 0 THEN 'mismatch' ELSE 'same' END AS status FROM cat WHERE n_bytes % 143 <> 0")
def manifest_diff(spark, sf):
    m = catalogs.catalog(spark, sf).withColumn("sha256", F.sha2(F.concat("name", F.col("n_bytes").cast("string")), 256))
    a, b = m.where("n_bytes % 13 <> 0"), m.where("n_bytes % 11 <> 0").withColumn("sha256", F.when(F.col("n_bytes") % 7 == 0, "other").otherwise(F.col("sha256")))
    return cat.manifest_diff(a, b)


@query("WITH " + _W + """, g AS (SELECT unit, tensor_idx, count(*) AS n, string_agg(printf('%02X%02X', w & 255, w >> 8), '' ORDER BY i) AS hex FROM weights GROUP BY 1, 2)
SELECT unit, tensor_idx, n * 2 AS n_bytes, sha256(unhex(hex)) AS sha256 FROM g""")
def tensor_sha256(spark, sf):
    w = src.weights(spark, sf).select("unit", "tensor_idx", F.struct("i", F.format_string("%02X%02X", F.col("w").bitwiseAND(255), F.shiftright("w", 8)).alias("x")).alias("s"))
    g = w.groupBy("unit", "tensor_idx").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return g.select("unit", "tensor_idx", (2 * F.size("s")).cast("long").alias("n_bytes"), F.sha2(F.unhex(F.array_join(F.transform("s", lambda x: x["x"]), "")), 256).alias("sha256"))


@query(_P + """, k AS (SELECT unit, count(*) AS entries FROM positions GROUP BY 1), s AS (SELECT t.unit, t.n AS sm, CAST(ceil(t.total_bits / 8) AS BIGINT) AS stream, CAST(ceil((k.entries - 1) * 512 * 5 / 8) AS BIGINT) AS gaps, k.entries * 4 AS outpos FROM totals t JOIN k USING (unit))
SELECT coalesce(CAST(unit AS VARCHAR), 'all') AS unit, CAST(sum(2 * sm) AS BIGINT) AS source_bytes, CAST(sum(sm) AS BIGINT) AS sm, CAST(sum(stream) AS BIGINT) AS stream, CAST(sum(gaps) AS BIGINT) AS gaps, CAST(sum(outpos) AS BIGINT) AS outpos,
  round(sum(sm + stream + gaps + outpos)::DOUBLE / sum(2 * sm), 6) AS ratio FROM s GROUP BY ROLLUP (unit)""")
def size_report(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    k = codec.output_positions(c, t).groupBy("unit").agg(F.count("*").alias("entries"))
    s = t.join(k, "unit").select("unit", F.col("n").alias("sm"), F.ceil(F.col("total_bits") / 8).alias("stream"), F.ceil((F.col("entries") - 1) * 512 * 5 / 8).alias("gaps"), (F.col("entries") * 4).alias("outpos"))
    all_bytes = F.col("sm") + F.col("stream") + F.col("gaps") + F.col("outpos")
    r = s.rollup("unit").agg(F.sum(2 * F.col("sm")).alias("source_bytes"), F.sum("sm").alias("sm_"), F.sum("stream").alias("stream_"), F.sum("gaps").alias("gaps_"), F.sum("outpos").alias("outpos_"), F.sum(all_bytes).alias("b"))
    return r.select(F.coalesce(F.col("unit").cast("string"), F.lit("all")).alias("unit"), "source_bytes", F.col("sm_").alias("sm"), F.col("stream_").alias("stream"), F.col("gaps_").alias("gaps"), F.col("outpos_").alias("outpos"), F.round(F.col("b") / F.col("source_bytes"), 6).alias("ratio"))


@query(f"WITH {_CAT} SELECT name, (row_number() OVER (ORDER BY name) - 1) % 4 AS file FROM cat")
def interleaved_plan(spark, sf):
    return cat.interleaved(catalogs.catalog(spark, sf), 4)


@query(_P + " SELECT unit, CAST(max(chunk) AS BIGINT) AS grid, max(d) AS most, CAST(max(d) * 2 + 512 * 4 + 4 AS BIGINT) AS shared_bytes FROM (SELECT unit, chunk, lead(pos) OVER (PARTITION BY unit ORDER BY chunk) - pos AS d FROM positions) GROUP BY 1")
def launch_geometry(spark, sf):
    _, c, t, _ = _coded(spark, sf)
    d = verify.outpos_deltas(codec.output_positions(c, t))
    return d.select("unit", F.col("chunks").alias("grid"), "most", (F.col("most") * 2 + 512 * 4 + 4).alias("shared_bytes"))


@query("WITH d AS (SELECT n_name AS name, n_regionkey AS v FROM nation), o AS (SELECT n_name AS name, 100 + n_nationkey AS v FROM nation WHERE n_nationkey % 5 = 0) SELECT d.name, CAST(coalesce(o.v, d.v) AS INTEGER) AS v FROM d LEFT JOIN o USING (name)")
def definition_override(spark, sf):
    """A later source of definitions takes the place of an earlier one's, by name."""
    n = src.table(spark, sf, "nation")
    later = n.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("v"))
    return n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("v")).join(later, "name", "left_anti").unionByName(later)


@query("SELECT l AS literal, CASE WHEN NOT regexp_matches(l, '^[0-9]+[KMG]?$') THEN NULL ELSE TRY_CAST(TRY_CAST(regexp_extract(l, '[0-9]+') AS HUGEINT) * CASE right(l, 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 ELSE 1 END AS BIGINT) END AS bytes FROM (SELECT p_size || ['', 'K', 'M', 'G', 'X', '000000000000G'][p_partkey % 6 + 1] AS l FROM part)")
def size_literals(spark, sf):
    p = src.table(spark, sf, "part")
    l = F.expr("concat(p_size, array('', 'K', 'M', 'G', 'X', '000000000000G')[cast(p_partkey % 6 as int)])")
    number = F.expr("try_cast(regexp_extract(literal, '^([0-9]+)[KMG]?$', 1) as bigint)")
    scale = F.expr("cast(case right(literal, 1) when 'K' then 1024 when 'M' then 1048576 when 'G' then 1073741824 else 1 end as bigint)")
    return p.select(l.alias("literal")).withColumn("bytes", F.try_multiply(number, scale))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN greatest(p_size // 10, 1) ELSE greatest(1, least(floor((CASE WHEN p_size % 3 = 0 THEN p_partkey * 1000.0::DOUBLE ELSE floor(p_partkey * 2000 * 0.8::DOUBLE) END) / greatest(p_size * 100 * CASE WHEN p_size % 2 = 0 THEN 10.0::DOUBLE ELSE 6.0::DOUBLE END, 1)), 8)) END AS BIGINT) AS workers,
  CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE p_size % 2 = 0 END AS in_turn FROM part""")
def resource_plan(spark, sf):
    """How many units to work on at once, and whether reads take turns, over made-up machines."""
    p = src.table(spark, sf, "part")
    c = F.col
    asked = F.when(c("p_size") % 5 == 0, F.expr("p_size div 10"))
    budget = F.when(c("p_size") % 3 == 0, c("p_partkey") * 1000)
    workers = support.worker_count(c("p_size") * 100, budget, F.lit(8), asked, c("p_size") % 2 == 0, c("p_partkey") * 2000)
    mode = F.when(c("p_partkey") % 4 == 0, "sequential").when(c("p_partkey") % 4 == 1, "concurrent").otherwise("auto")
    return p.select("p_partkey", workers.alias("workers"), support.read_in_turn(mode, c("p_size") % 2 == 0).alias("in_turn"))


@query("""SELECT n_name AS file, n_nationkey % 7 <> 0 AS in_ours, coalesce(n_nationkey % 7 <> 0 AND n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 1, false) AS same_as_official, n_nationkey % 7 <> 0 AND n_nationkey % 2 = 0 AS same_as_release
FROM nation""")
def tree_diff(spark, sf):
    """Files of three trees against each other."""
    n = src.table(spark, sf, "nation").select(F.col("n_name").alias("file"), F.col("n_nationkey").alias("k"), F.sha2("n_name", 256).alias("sha256"))
    official = n.where("k % 5 <> 0").withColumn("sha256", F.when(F.col("k") % 3 == 1, "other").otherwise(F.col("sha256")))
    release = n.withColumn("sha256", F.when(F.col("k") % 2 == 0, F.col("sha256")).otherwise("other"))
    return support.tree_diff(n.where("k % 7 <> 0"), official, release)


@query(f"WITH {_CAT} SELECT regexp_replace(name, '[.][^.]+$', '') AS unit, string_agg(DISTINCT regexp_extract(name, '([^.]+)$', 1), ',' ORDER BY regexp_extract(name, '([^.]+)$', 1)) AS suffixes, count(DISTINCT n_bytes % 3) AS files FROM cat GROUP BY 1")
def merged_units(spark, sf):
    t = catalogs.catalog(spark, sf).withColumn("file", (F.col("n_bytes") % 3).cast("string"))
    return support.merged_units(t).withColumn("suffixes", F.array_join("suffixes", ","))


@query("SELECT p_partkey, min(n_name) AS definition FROM part LEFT JOIN nation ON n_regionkey = p_size % 7 GROUP BY 1")
def release_map(spark, sf):
    d = src.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("key"))
    r = src.table(spark, sf, "part").select(F.col("p_partkey").alias("release"), (F.col("p_size") % 7).alias("key"))
    return support.release_map(d, r).withColumnRenamed("release", "p_partkey")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return exponent_histogram(spark, sf)
