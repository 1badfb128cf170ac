"""Decoders that know only lookup tables, bytes and indices, never the encoder's codes.

Chunks decode on their own, so decoding is as parallel as there are chunks: one row a chunk, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codec import CHUNK_BYTES, WINDOWS_PER_CHUNK


class BadStream(ValueError):
    """What can't be decoded: code, and where."""


def decode_at(tables: np.ndarray, lens: np.ndarray, data: bytes, bit: int) -> tuple[int, int]:
    """(symbol, length) of the code at a bit: bytes look up tables until a symbol comes out; the rest of it is skipped."""
    t = 0
    for step in range(len(tables) + 1):
        at = bit + 8 * step
        k, r = at >> 3, at & 7
        a = data[k] if k < len(data) else 0
        b = data[k + 1] if k + 1 < len(data) else 0
        v = int(tables[t][((a << 8 | b) >> (8 - r)) & 255])
        if v < 240:
            if not lens[v]:
                raise BadStream(f"symbol {v} at bit {bit} has no code")
            return v, int(lens[v])
        t = 256 - v
        if t >= len(tables):
            raise BadStream(f"table {t} at bit {bit} is not there")
    raise BadStream(f"the code at bit {bit} does not end")


def decode_run(tables: np.ndarray, lens: np.ndarray, data: bytes, bit: int, n: int) -> tuple[np.ndarray, int]:
    """n symbols from a bit on, and the bit after them."""
    out = np.zeros(n, np.uint8)
    for k in range(n):
        out[k], size = decode_at(tables, lens, data, bit)
        bit += size
    return out, bit


def packed_luts(luts: DataFrame) -> DataFrame:
    """(unit, luts): the tables and the lengths as one array, row by row; 18 rows of 256 at most."""
    cells = F.array_sort(F.collect_list(F.struct("tbl", "byte", "v")))
    return luts.groupBy("unit").agg(F.transform(cells, lambda x: x["v"]).alias("luts"))


def chunk_rows(stream: DataFrame, gap_rows: DataFrame, positions: DataFrame, luts: DataFrame) -> DataFrame:
    """(unit, chunk, bit, first, n, bytes, luts): what one chunk needs; its bytes and the 8 after them."""
    near = stream.withColumn("chunk", F.explode(F.expr(f"case when byte_idx % {CHUNK_BYTES} < 8 and byte_idx >= {CHUNK_BYTES} then array(byte_idx div {CHUNK_BYTES}, byte_idx div {CHUNK_BYTES} - 1) else array(byte_idx div {CHUNK_BYTES}) end")))
    data = near.groupBy("unit", "chunk").agg(F.array_sort(F.collect_list(F.struct("byte_idx", "b"))).alias("x")).select("unit", "chunk", F.transform("x", lambda x: x["b"]).alias("bytes"))
    after = Window.partitionBy("unit").orderBy("chunk")
    spans = positions.select("unit", "chunk", F.col("pos").alias("first"), (F.lead("pos").over(after) - F.col("pos")).alias("n")).where("n is not null")
    start = gap_rows.where(F.col("win") % WINDOWS_PER_CHUNK == 0).select("unit", F.expr(f"win div {WINDOWS_PER_CHUNK}").alias("chunk"), F.col("gap").alias("bit"))
    return spans.join(start, ["unit", "chunk"]).join(data, ["unit", "chunk"]).join(packed_luts(luts), "unit").select("unit", "chunk", "bit", "first", "n", "bytes", "luts")


def decode_chunks(rows: DataFrame) -> DataFrame:
    """(unit, chunk, i, sym): every weight's exponent, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tables = np.array(r["luts"], np.int32).reshape(-1, 256)
                sym, _ = decode_run(tables[:-1], tables[-1], bytes(r["bytes"]), r["bit"], r["n"])
                n = len(sym)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["unit"], np.int32)), pa.array(np.full(n, r["chunk"], np.int64)), pa.array(np.arange(r["first"], r["first"] + n)), pa.array(sym.astype(np.int32))], ["unit", "chunk", "i", "sym"])

    return rows.mapInArrow(run, "unit int, chunk long, i long, sym int")


def mismatches(decoded: DataFrame, weights: DataFrame) -> DataFrame:
    """(unit, i, sym, e) where a decoded exponent and the source's differ, or one of them is missing."""
    return decoded.select("unit", "i", "sym").join(weights.select("unit", "i", "e"), ["unit", "i"], "full_outer").where("not (sym <=> e)")


def decode_blocks(ranges: DataFrame, stream: DataFrame, luts: DataFrame, block: int = 64) -> DataFrame:
    """(unit, blk, n, ends_right): blocks of a block index decoded on their own; each must end at its indexed end."""
    span = ranges.select("unit", "blk", "start_bit", "end_bit", F.explode(F.expr("sequence(start_bit div 8, (end_bit - 1) div 8 + 4)")).alias("byte_idx"))
    data = span.join(stream, ["unit", "byte_idx"]).groupBy("unit", "blk", "start_bit", "end_bit").agg(F.array_sort(F.collect_list(F.struct("byte_idx", "b"))).alias("x"))
    rows = data.select("unit", "blk", "start_bit", "end_bit", F.transform("x", lambda x: x["b"]).alias("bytes")).join(packed_luts(luts), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                tables = np.array(r["luts"], np.int32).reshape(-1, 256)
                bit, end, n = r["start_bit"] % 8, r["start_bit"] % 8 + r["end_bit"] - r["start_bit"], 0
                while bit < end and n < block:
                    bit += decode_at(tables[:-1], tables[-1], bytes(r["bytes"]), bit)[1]
                    n += 1
                out.append((r["unit"], r["blk"], n, bit == end))
            if out:
                u, b, n, ok = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(ok, pa.bool_())], ["unit", "blk", "n", "ends_right"])

    return rows.mapInArrow(run, "unit int, blk long, n int, ends_right boolean")


