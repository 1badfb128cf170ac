"""The entropy codec as DataFrame operators: histogram, codebook, offsets, bitstream, indices, lookup tables.

A unit's exponents are coded with its own prefix code. EOF is symbol -1, so that it sorts before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bits import code_string
from ..functions.prefix import exclusive_sum

EOF = -1
WINDOW_BITS, CHUNK_BITS, CHUNK_BYTES, WINDOWS_PER_CHUNK = 64, 32768, 4096, 512
RESERVED, MOST_WEIGHTS, MOST_TABLES, MOST_BITS = 240, 2**31 - 1, 17, 32


def histogram(weights: DataFrame) -> DataFrame:
    """(unit, e, cnt)."""
    return weights.groupBy("unit", "e").agg(F.count("*").alias("cnt"))


def codebook(hist: DataFrame) -> DataFrame:
    """(unit, ord, sym, bits, val): the prefix code of each unit, in the order in which merging leaves it.

    The two nodes least by (frequency, representative) merge: the first takes bit 0 and lends its
    representative, the second bit 1. A unit has at most 241 symbols, all in one row's array.
    """
    leaf = "array(struct(cast({0} as int) as sym, 0 as bits, 0L as val))"
    node = F.expr("struct(cast(cnt as bigint) as f, cast(e as int) as rep, " + leaf.format("e") + " as leaves)")
    start = hist.groupBy("unit").agg(F.collect_list(node).alias("nodes"))
    start = start.withColumn("nodes", F.expr("array_sort(concat(nodes, array(struct(1L as f, -1 as rep, " + leaf.format("-1") + " as leaves))))"))
    merged = """aggregate(sequence(2, size(nodes)), nodes, (acc, x) -> array_sort(concat(slice(acc, 3, size(acc)), array(struct(
        acc[0].f + acc[1].f as f, acc[0].rep as rep,
        concat(transform(acc[0].leaves, l -> struct(l.sym as sym, l.bits + 1 as bits, l.val as val)),
               transform(acc[1].leaves, l -> struct(l.sym as sym, l.bits + 1 as bits, shiftleft(1L, l.bits) + l.val as val))) as leaves)))))[0].leaves"""
    return start.select("unit", F.posexplode(F.expr(merged)).alias("ord", "l")).select("unit", "ord", "l.sym", "l.bits", "l.val")


def coded(weights: DataFrame, book: DataFrame) -> DataFrame:
    """(unit, i, e, bits, val, off): each weight's code and the bit it starts at."""
    codes = book.where(F.col("sym") >= 0).select("unit", F.col("sym").alias("e"), "bits", "val")
    return exclusive_sum(weights.select("unit", "i", "e").join(codes, ["unit", "e"]), ["unit"], "i", "bits", "off")


def unit_totals(hist: DataFrame, book: DataFrame) -> DataFrame:
    """(unit, n, total_bits, eof_bits, eof_val): from the histogram alone."""
    codes = book.select("unit", F.col("sym").alias("e"), "bits")
    sums = hist.join(codes, ["unit", "e"]).groupBy("unit").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.col("bits")).alias("total_bits"))
    eof = book.where(F.col("sym") == EOF).select("unit", F.col("bits").alias("eof_bits"), F.col("val").alias("eof_val"))
    return sums.join(eof, "unit")


def chunk_bits(weights: DataFrame, book: DataFrame, symbols: int = 1 << 20) -> DataFrame:
    """(unit, chunk, bits): the coded length of each run of ``symbols`` weights, from its histogram."""
    codes = book.select("unit", F.col("sym").alias("e"), "bits")
    hist = weights.groupBy("unit", F.expr(f"i div {symbols}").alias("chunk"), "e").agg(F.count("*").alias("c"))
    return hist.join(codes, ["unit", "e"]).groupBy("unit", "chunk").agg(F.sum(F.col("c") * F.col("bits")).alias("bits"))


def bitstream(codes: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit, byte_idx, b): codes end to end, most significant bit first.

    Where the last byte isn't full, the EOF code begins in it, cut to that byte.
    """
    tail = totals.where("total_bits % 8 <> 0").select("unit", F.col("eof_bits").alias("bits"), F.col("eof_val").alias("val"), F.col("total_bits").alias("off"), F.lit(True).alias("last"))
    rows = codes.select("unit", "bits", "val", "off", F.lit(False).alias("last")).unionByName(tail)
    end = "(case when last then off div 8 else (off + bits - 1) div 8 end)"
    return _packed(rows.withColumn("upto", F.expr(end)))


def _starts(codes: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit, i, off) of every code, and of EOF where it is written."""
    return codes.select("unit", "i", "off").unionByName(totals.where("total_bits % 8 <> 0").select("unit", F.col("n").alias("i"), F.col("total_bits").alias("off")))


def gaps(codes: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit, win, gap): where the first code that starts in each window of 64 bits does."""
    return _starts(codes, totals).groupBy("unit", F.expr(f"off div {WINDOW_BITS}").alias("win")).agg(F.min(F.col("off") % WINDOW_BITS).cast("int").alias("gap"))


def padded_gaps(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit, win, gap): with zeros up to whole chunks; never cut."""
    want = totals.select("unit", F.expr(f"{WINDOWS_PER_CHUNK} * ceil(ceil(total_bits / 8) / {CHUNK_BYTES})").cast("long").alias("n"))
    grid = want.select("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("win"))
    return grid.join(entries, ["unit", "win"], "full_outer").select("unit", "win", F.coalesce("gap", F.lit(0)).alias("gap"))


def packed_gaps(gap_rows: DataFrame) -> DataFrame:
    """(unit, byte_idx, b): gaps in 5 bits each."""
    return _packed(gap_rows.select("unit", F.lit(5).alias("bits"), F.col("gap").bitwiseAND(31).cast("long").alias("val"), (F.col("win") * 5).alias("off")))


def unpacked_gaps(packed: DataFrame) -> DataFrame:
    """(unit, win, gap): fields of 5 bits out of two bytes each; a last part of one is left out."""
    size = packed.groupBy("unit").agg((F.max("byte_idx") + 1).alias("n"))
    wins = size.select("unit", F.explode(F.expr("sequence(0L, (8 * n) div 5 - 1)")).alias("win"))
    first = wins.withColumn("byte_idx", F.expr("win * 5 div 8")).join(packed, ["unit", "byte_idx"])
    after = packed.select("unit", (F.col("byte_idx") - 1).alias("byte_idx"), F.col("b").alias("b2"))
    both = first.join(after, ["unit", "byte_idx"], "left")
    return both.select("unit", "win", F.expr("cast(shiftright(b * 256 + coalesce(b2, 0), cast(11 - win * 5 % 8 as int)) & 31 as int)").alias("gap"))


def _packed(rows: DataFrame) -> DataFrame:
    """(unit, byte_idx, b): the bytes that fields (off, bits, val) touch, up to byte ``upto`` if there is one."""
    end = "upto" if "upto" in rows.columns else "(off + bits - 1) div 8"
    parts = rows.select("unit", "bits", "val", "off", F.explode(F.expr(f"sequence(off div 8, {end})")).alias("byte_idx"))
    shift = "cast(8 * (byte_idx + 1) - off - bits as int)"
    part = F.expr(f"cast((case when {shift} >= 0 then shiftleft(val, {shift}) else shiftright(val, -({shift})) end) & 255 as int)")
    return parts.withColumn("part", part).groupBy("unit", "byte_idx").agg(F.bit_or("part").alias("b"))


def output_positions(codes: DataFrame, totals: DataFrame) -> DataFrame:
    """(unit, chunk, pos): the first weight that starts in each chunk, and last how many there are."""
    first = _starts(codes, totals).groupBy("unit", F.expr(f"off div {CHUNK_BITS}").alias("chunk")).agg(F.min("i").alias("pos"))
    last = first.groupBy("unit").agg((F.max("chunk") + 1).alias("chunk")).join(totals.select("unit", F.col("n").alias("pos")), "unit")
    return first.unionByName(last.select("unit", "chunk", "pos"))


def split_positions(tensors: DataFrame) -> DataFrame:
    """(unit, tensor_idx, split): where each tensor of a unit ends, but for the last."""
    last = tensors.groupBy("unit").agg(F.max("tensor_idx").alias("last"))
    return tensors.join(last, "unit").where("tensor_idx < last").select("unit", "tensor_idx", (F.col("start") + F.col("n")).alias("split"))


def prefix_tables(book: DataFrame) -> DataFrame:
    """(unit, tbl, prefix): the byte prefixes of codes, by length and then as first met in the codebook."""
    code = book.where(F.col("sym") >= 0).withColumn("code", code_string("bits", "val"))
    cut = code.select("unit", "ord", F.expr("substring(code, 1, (greatest(bits, 1) - 1) div 8 * 8)").alias("prefix"))
    met = cut.groupBy("unit", "prefix").agg(F.min("ord").alias("ord")).unionByName(book.select("unit", F.lit("").alias("prefix"), F.lit(-1).alias("ord")).distinct())
    met = met.groupBy("unit", "prefix").agg(F.min("ord").alias("ord"))
    order = Window.partitionBy("unit").orderBy(F.length("prefix"), "ord")
    return met.select("unit", (F.row_number().over(order) - 1).alias("tbl"), "prefix")


def lut_cells(book: DataFrame, tables: DataFrame) -> DataFrame:
    """(unit, tbl, byte, v): the cells that a code sets: its symbol, or 256 less the table to go on in."""
    code = book.where(F.col("sym") >= 0).withColumn("code", code_string("bits", "val"))
    steps = code.select("unit", "sym", "code", F.expr("(greatest(bits, 1) - 1) div 8").alias("last"), F.explode(F.expr("sequence(0L, (greatest(bits, 1) - 1) div 8)")).alias("t"))
    steps = steps.withColumns({"prefix": F.expr("substring(code, 1, cast(8 * t as int))"), "upto": F.expr("substring(code, 1, cast(8 * t + 8 as int))"), "byte": F.expr("cast(conv(rpad(substring(code, cast(8 * t + 1 as int), 8), 8, '0'), 2, 10) as int)")})
    here = steps.join(tables, ["unit", "prefix"])
    on = tables.select("unit", F.col("prefix").alias("upto"), F.col("tbl").alias("next"))
    both = here.join(on, ["unit", "upto"], "left")
    return both.groupBy("unit", "tbl", "byte").agg(F.min(F.expr("case when t = last then sym else 256 - next end")).alias("v"))


def luts(book: DataFrame, tables: DataFrame, cells: DataFrame, correct: bool) -> DataFrame:
    """(unit, tbl, byte, v): whole tables, filled forward, and last the codes' lengths.

    The usual fill runs on from table to table; ``correct`` begins anew in each.
    """
    grid = tables.select("unit", "tbl", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte"))
    order = (Window.partitionBy("unit", "tbl").orderBy("byte") if correct else Window.partitionBy("unit").orderBy("tbl", "byte")).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(cells, ["unit", "tbl", "byte"], "left").select("unit", "tbl", "byte", F.coalesce(F.last("v", ignorenulls=True).over(order), F.lit(0)).cast("int").alias("v"))
    return filled.unionByName(code_lengths(book, tables))


def code_lengths(book: DataFrame, tables: DataFrame) -> DataFrame:
    """(unit, tbl, byte, v): the row of lengths, 0 for what has no code."""
    row = tables.groupBy("unit").agg((F.max("tbl") + 1).alias("tbl")).select("unit", "tbl", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte"))
    return row.join(book.select("unit", F.col("sym").alias("byte"), "bits"), ["unit", "byte"], "left").select("unit", "tbl", "byte", F.coalesce("bits", F.lit(0)).cast("int").alias("v"))


def lut_leaks(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """(unit, tbl, leaked, carried): the cells at the start of a table that no code of it sets, and what the fill leaves there."""
    first = cells.groupBy("unit", "tbl").agg(F.min("byte").alias("leaked"), F.max_by("v", "byte").alias("last_v"))
    before = first.select("unit", (F.col("tbl") + 1).alias("tbl"), F.col("last_v").alias("carried"))
    return first.join(before, ["unit", "tbl"]).where("leaked > 0").select("unit", "tbl", "leaked", "carried")


def idx8_blocks(codes: DataFrame, block: int = 64) -> DataFrame:
    """(unit, blk, bits, minlen, code, escaped): each block's coded length, less the least of the full blocks where that fits a byte."""
    if block < 1:
        raise ValueError("a block holds one symbol at least")
    lens = codes.groupBy("unit", F.expr(f"i div {block}").alias("blk")).agg(F.sum("bits").alias("bits"), F.count("*").alias("k"))
    least = lens.groupBy("unit").agg(F.coalesce(F.min(F.when(F.col("k") == block, F.col("bits"))), F.min("bits")).alias("minlen"))
    d = F.col("bits") - F.col("minlen")
    fits = (d >= 0) & (d < 255)
    return lens.join(least, "unit").select("unit", "blk", "bits", "minlen", F.when(fits, d).otherwise(255).cast("int").alias("code"), (~fits).alias("escaped"))


def idx8_superblocks(blocks: DataFrame, per: int = 32) -> DataFrame:
    """(unit, sb, base): the bit at which each run of 32 blocks starts."""
    sums = blocks.groupBy("unit", F.expr(f"blk div {per}").alias("sb")).agg(F.sum("bits").alias("t"))
    return exclusive_sum(sums, ["unit"], "sb", "t", "base").select("unit", "sb", "base")


def idx8_ranges(blocks: DataFrame, supers: DataFrame, escapes: DataFrame, per: int = 32) -> DataFrame:
    """(unit, blk, start_bit, end_bit): as a decoder finds them, from codes, the least length, bases and escapes."""
    b = blocks.select("unit", "blk", "minlen", "code").join(escapes.select("unit", "blk", F.col("bits").alias("exact")), ["unit", "blk"], "left")
    b = b.withColumns({"len": F.when(F.col("code") == 255, F.col("exact")).otherwise(F.col("code") + F.col("minlen")), "sb": F.expr(f"blk div {per}")})
    inside = Window.partitionBy("unit", "sb").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("inner", F.coalesce(F.sum("len").over(inside), F.lit(0))).join(supers, ["unit", "sb"])
    return b.select("unit", "blk", (F.col("base") + F.col("inner")).alias("start_bit"), (F.col("base") + F.col("inner") + F.col("len")).alias("end_bit"))
