"""SimHash near-dedup with anchors from a covering code.

Fingerprints meet at anchors, the words of a code that covers all fingerprints: the direct sum of two
perfect [23, 12] Golay codes, each of covering radius 3, and the code of one word on the other 18 bits,
which covers those at any distance. Each fingerprint's home is the anchor within the covering radius of
each block, of which there is one. It is replicated to every anchor whose covered cell lies within the
threshold, that is, where what its distances in the two blocks have beyond the radius 3 adds up to at most
the threshold. Of two fingerprints within the threshold, each one thus comes to the other's home, so that
comparing home fingerprints with replicated ones, anchor by anchor, finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, table, words_of

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the cyclic [23, 12] code
RADIUS = 3


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bit i is set where more than half of the shingles' hashes have it; 0 for no words."""
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return h(b" ".join(words), 42)
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, n, 1 << 16):
        part = words[lo : lo + (1 << 16) + shingle - 1]
        hashes = np.array([h(b" ".join(s), 42) for s in zip(*(part[k:] for k in range(shingle)), strict=False)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                fps = np.array([fingerprint(words_of(t), shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return d.mapInArrow(hashed, f"id {d.schema['id'].dataType.simpleString()}, fp long")


def syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator of 23-bit words."""
    x = x.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


@cache
def _coset(excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(errors, ends): the error patterns beyond the radius by ``excess`` exactly (0: within it), by syndrome."""
    weights = range(RADIUS + 1) if excess == 0 else (RADIUS + excess,)
    errors = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(23), w)], np.int64)
    s = syndromes(errors)
    order = np.argsort(s, kind="stable")
    return errors[order], np.searchsorted(s[order], np.arange(2049))


def _near(block: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code word): the words of the code beyond the radius of each 23-bit value by ``excess`` exactly."""
    errors, ends = _coset(excess)
    s = syndromes(block)
    n = ends[s + 1] - ends[s]
    row = np.repeat(np.arange(len(block)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, block[row] ^ errors[ends[s][row] + k]


def anchors(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, home) for the anchors of each fingerprint, its home first."""
    hi, lo = (fp >> 41) & 0x7FFFFF, (fp >> 18) & 0x7FFFFF
    rows, found, home = [], [], []
    for a in range(threshold + 1):
        ra, ca = _near(hi, a)
        for b in range(threshold + 1 - a):
            rb, cb = _near(lo[ra], b)
            rows.append(ra[rb])
            found.append(ca[rb] << 23 | cb)
            home.append(np.full(len(rb), a + b == 0))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def links(fps: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints (column fp) at most ``threshold`` bits apart, once each."""

    def spread(homes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    fp = batch.column(0).slice(lo, 2048).to_numpy()
                    row, anchor, _ = anchors(fp, 0 if homes else threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], ["anchor", "b" if not homes else "a"])

        return run

    home = fps.select("fp").mapInArrow(spread(True), "anchor long, a long")
    copies = fps.select("fp").mapInArrow(spread(False), "anchor long, b long")
    return home.join(copies, "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 2) -> DataFrame:
    """(id, fp, component_id): component_id is the least id reachable over links of near fingerprints.

    Equal fingerprints stand for one node, so copies are never paired. A null or empty text has fingerprint 0
    and links like any other. A null id has a row too, and is never the least unless its group has no other.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(nodes, threshold))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select(F.col("fp").alias("f"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("f")).select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` less the documents that aren't the one of the least id in their near-duplicate group."""
    keep = near_groups(docs, id_col=id_col, **how).where("id <=> component_id").select(F.col("id").alias("__id")).distinct()
    return docs.join(keep, F.expr(f"`{id_col}` <=> __id"), "left_semi")


def op5_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
