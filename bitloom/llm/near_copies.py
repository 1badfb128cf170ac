"""Near copies at a stated Jaccard similarity of word shingles: SimHash covers and MinHash bands for candidates, exact sets to settle them.

A document's set holds the 64-bit hashes of its shingles. Documents with equal sets are one node. Sharing an anchor or a band only
makes a pair a candidate: a link is one whose sets, compared whole, are similar enough.

A node's SimHash fingerprint has the bits that more than half of its hashes have. As in simhash_cover, it has a home among the
anchors of a covering code and is replicated to those within the threshold, where it meets the node of that home; those ``within``
so many bits of all 64 are candidates. At 0.8, fingerprints differ by some 10 bits, so covers find a part of such pairs only.
The rest is met in ``bands`` band hashes of ``rows`` minima each; a pair of similarity s shares a band with probability
1 - (1 - s ** rows) ** bands, which at 0.8 misses 15 pairs in a million.

A large group of near copies is not paired with itself. First an anchor's or bucket's members meet the one of the least node;
what is linked then is one component. After that, only members of different components of a bucket meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, words_of
from .simhash_cover import anchors

MULTIPLIERS = np.random.default_rng(42).integers(1 << 62, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; of fewer words, that of all; of none, no hash."""
    words, h = words_of(text), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.array([h(b" ".join(s), 42) for s in runs], np.uint64))


def band_hashes(found: np.ndarray, bands: int, rows: int) -> list[int]:
    least = np.full(bands * rows, (1 << 64) - 1, np.uint64)
    mixed = found ^ found >> np.uint64(29)
    for lo in range(0, len(mixed), 2048):
        least = np.minimum(least, (mixed[lo : lo + 2048, None] * MULTIPLIERS[: bands * rows]).min(0))
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * rows * b : 8 * rows * (b + 1)], b) for b in range(bands)]


def simhash(found: np.ndarray) -> int:
    """Bit i is set where more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(found), 1 << 12):
        ones += np.unpackbits(found[lo : lo + (1 << 12)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, node, size, fp, buckets): node is a hash of the set as a signed long, fp its fingerprint as one; an empty set is in no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                nodes, sizes, fps, buckets = [], [], [], []
                for t in part.column(1).to_pylist():
                    found = shingle_set(t, shingle)
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 1))
                    sizes.append(len(found))
                    fps.append(simhash(found))
                    buckets.append(np.array(band_hashes(found, bands, rows) if len(found) else [], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(buckets, pa.list_(pa.int64()))], ["id", "node", "size", "fp", "buckets"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, node long, size int, fp long, buckets array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the documents whose ids are ``wanted``, once for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                found = [shingle_set(t, shingle) for t in batch.column(0).slice(lo, 128).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "hashes"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(wanted, F.expr("id <=> wanted"), "left_semi")
    return d.select("t").mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """(a, b): the pairs of nodes whose sets have a similarity of ``least`` or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    wanted = nodes.join(ends, F.col("node") == F.col("end"), "left_semi").select(F.col("least_id").alias("wanted")).distinct()
    sets = checkpointed(_sets(docs, id_col, text_col, shingle, wanted))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    met = met.select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))
    return checkpointed(met.where(F.col("both") >= F.lit(least) * (F.col("m") + F.col("n") - F.col("both")) - 1e-9).select("a", "b"))


def cover_pairs(nodes: DataFrame, threshold: int = 2, within: int = 12) -> DataFrame:
    """(a, m, b, n): nodes and their sizes, b's fingerprint being replicated to a's home and at most ``within`` bits from a's.

    a is the least node of its home. All pairs of different homes whose fingerprints differ by ``threshold`` bits at most are
    there, but for those of other nodes of a home, which are left to bands.
    """

    def spread(beyond: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    row, anchor, _ = anchors(part.column(0).to_numpy(), beyond)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), *(c.take(pa.array(row)) for c in part.columns)], ["anchor", *part.schema.names])

        return run

    some = nodes.where("size > 0")
    homes = some.select("fp", "node", "size").mapInArrow(spread(0), "anchor long, fp long, node long, size int")
    homes = homes.groupBy("anchor").agg(F.min(F.struct("node", "size", "fp")).alias("hub"))
    copies = some.select(F.col("fp").alias("other")).distinct().mapInArrow(spread(threshold), "anchor long, other long")
    # Spark sizes the replicas, some 61 a fingerprint, as one a fingerprint, and would send them to the driver.
    met = copies.hint("merge").join(homes, "anchor").where(F.bit_count(F.col("hub.fp").bitwiseXOR(F.col("other"))) <= within).select("hub", "other").distinct()
    met = met.join(some.select("fp", "node", "size"), F.col("fp") == F.col("other")).where(F.col("node") != F.col("hub.node"))
    return met.select(F.col("hub.node").alias("a"), F.col("hub.size").alias("m"), F.col("node").alias("b"), F.col("size").alias("n"))


def _shared(nodes: DataFrame) -> DataFrame:
    """(bucket, node, size, hub): the members of buckets of several nodes, and the least of them."""
    members = nodes.select("node", "size", F.explode(F.array_distinct("buckets")).alias("bucket"))
    hubs = members.groupBy(F.col("bucket").alias("hb")).agg(F.min(F.struct("node", "size")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    # Both sides grow with the corpus, and Spark sizes what is exploded as if each node were in one bucket.
    return members.hint("merge").join(hubs, F.col("bucket") == F.col("hb")).select("bucket", "node", "size", "hub")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, bands: int = 28, rows: int = 5, threshold: int = 2) -> DataFrame:
    """(id, component_id): component_id is the least id reachable over links at a similarity of ``least``.

    Texts without words are one group. A null id is never the least unless its group has no other.
    """
    prints = checkpointed(_prints(docs, id_col, text_col, shingle, bands, rows))
    nodes = checkpointed(prints.groupBy("node").agg(F.min("id").alias("least_id"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")))
    shared = checkpointed(_shared(nodes))
    # Sets of such different sizes can't be similar enough.
    alike = lambda m, n: F.least(m, n) >= F.lit(least) * F.greatest(m, n) - 1e-9
    covered = cover_pairs(nodes, threshold).where(alike("m", "n")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    banded = shared.where((F.col("node") != F.col("hub.node")) & alike("size", "hub.size")).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    first = checkpointed(covered.union(banded).distinct())
    near = _links(docs, nodes, first, id_col, text_col, shingle, least)
    roots = connected_components(near).withColumnRenamed("node", "v")
    rooted = shared.join(roots, F.col("node") == F.col("v"), "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy(F.col("bucket").alias("ab")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    apart = checkpointed(rooted.join(apart, F.col("bucket") == F.col("ab"), "left_semi"))
    x, y = apart.withColumnsRenamed({"node": "nx", "size": "sx", "root": "rx"}), apart.withColumnsRenamed({"node": "ny", "size": "sy", "root": "ry"})
    met = x.join(y, "bucket").where((F.col("rx") < F.col("ry")) & alike("sx", "sy"))
    second = met.select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    near = near.union(_links(docs, nodes, checkpointed(second), id_col, text_col, shingle, least))
    roots = connected_components(near).withColumnRenamed("node", "v")
    final = nodes.join(roots, F.col("node") == F.col("v"), "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = final.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_node = final.join(named, "root").select(F.col("node").alias("v"), "component_id")
    return prints.join(by_node, F.col("node") == F.col("v")).select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` less the documents that aren't the one of the least id in their group of near copies."""
    keep = near_groups(docs, id_col=id_col, **how).where("id <=> component_id").select(F.col("id").alias("__id")).distinct()
    return docs.join(keep, F.expr(f"`{id_col}` <=> __id"), "left_semi")
