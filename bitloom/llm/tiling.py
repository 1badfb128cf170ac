"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of ``min_match`` words (a seed) are compared: the longest
common runs of words that no tile covers yet are marked as tiles, longest first, until none of ``min_match``
words is left. The share of an item's words under tiles is its coverage, so that an item whose passages
were put in another order is still found. Runs of words are found by rolling Karp-Rabin hashes of word ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of

BASE = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, m: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of each run of ``m`` ids."""
    n = len(ids) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(m):
        out = out * BASE + ids[k : k + n]
    return out


class Seeds(NamedTuple):
    """Items by number: ids the words' numbers (from 1), and where each run of m words starts, by sorted hash."""

    m: int
    vocabulary: dict[bytes, int]
    keys: list
    items: list[np.ndarray]
    hashes: np.ndarray
    item: np.ndarray
    start: np.ndarray
    short: dict[int, "Seeds"]


def seeds_of(rows: list[tuple[object, str | None]], m: int, vocabulary: dict[bytes, int] | None = None) -> Seeds:
    """Items of fewer than m words are sought whole: they have seeds of their own length, in ``short``."""
    vocabulary = {} if vocabulary is None else vocabulary
    keys, items, short_rows = [], [], {}
    for key, text in rows:
        words = words_of(text)
        if words and len(words) < m:
            short_rows.setdefault(len(words), []).append((key, text))
        elif words:
            keys.append(key)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.uint64))
    h = [rolling(x, m) for x in items]
    hashes = np.concatenate(h) if h else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(h)), [len(x) for x in h])
    start = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    return Seeds(m, vocabulary, keys, items, hashes[order], item[order], start[order], {k: seeds_of(r, k, vocabulary) for k, r in short_rows.items()})


def tiles(item: np.ndarray, doc: np.ndarray, m: int, starts: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(length, place in item, place in doc) of the tiles, longest first, earliest first among equals."""
    if starts is None:
        hi, hd = rolling(item, m), rolling(doc, m)
        order = np.argsort(hi, kind="stable")
        lo, end = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
        n = end - lo
        j = np.repeat(np.arange(len(hd)), n)
        i = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else np.zeros(0, np.int64)
    else:
        i, j = starts
    # Seeds next to each other on a diagonal make one maximal run; equal hashes are held against the words.
    order = np.lexsort((j, j - i))
    i, j = i[order], j[order]
    heap: list[tuple[int, int, int]] = []
    breaks = np.nonzero((np.diff(j - i, prepend=-(1 << 60)) != 0) | (np.diff(j, prepend=-(1 << 60)) != 1))[0]
    for a, b in zip(breaks, np.append(breaks[1:], len(i)), strict=False):
        x, y, n = int(i[a]), int(j[a]), int(b - a) + m - 1
        _push(heap, x, y, item[x : x + n] == doc[y : y + n], m)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = ~(in_item[x : x + n] | in_doc[y : y + n])
        if free.all():
            in_item[x : x + n] = in_doc[y : y + n] = True
            out.append((n, x, y))
        else:
            _push(heap, x, y, free, m)
    return out


def _push(heap: list, x: int, y: int, good: np.ndarray, m: int) -> None:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], good, [False])).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= m:
            heapq.heappush(heap, (-int(b - a), x + int(a), y + int(a)))


def matches(words: list[bytes], seeds: Seeds) -> Iterator[tuple[object, int, int, int]]:
    """(item, its words, words under tiles, tiles) for each item that shares a seed with a document."""
    yield from _matches(np.fromiter(map(seeds.vocabulary.get, words, _ZEROS), np.uint64, len(words)), seeds)


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self):
        return 0


_ZEROS = _Zeros()


def _matches(doc: np.ndarray, seeds: Seeds) -> Iterator[tuple[object, int, int, int]]:
    for part in (seeds, *seeds.short.values()):
        if not len(part.hashes) or len(doc) < part.m:
            continue
        # Runs with a word that no item has are no seeds.
        strange = np.concatenate(([0], np.cumsum(doc == 0)))
        at = np.flatnonzero(strange[part.m :] == strange[: -part.m])
        if not len(at):
            continue
        h = rolling(doc, part.m)[at]
        lo, end = np.searchsorted(part.hashes, h, "left"), np.searchsorted(part.hashes, h, "right")
        n = end - lo
        if not n.sum():
            continue
        j = np.repeat(at, n)
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, i = part.item[k], part.start[k]
        for x in np.unique(item):
            own = item == x
            found = tiles(part.items[x], doc, part.m, (i[own], j[own]))
            if found:
                yield part.keys[x], len(part.items[x]), sum(t[0] for t in found), len(found)


def tiled(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = 5, block_words: int = 500_000) -> DataFrame:
    """(id, item, item_words, tiled, tiles) for each document and item that share a seed.

    The benchmark is the stated query set: its seeds go to every task, in blocks of ``block_words`` words at
    most (of one item at least), each of which passes over all documents. Words are lower-cased (A-Z) runs
    between white space. Null and empty texts and items share nothing; items of fewer than ``min_match``
    words must occur whole. Rows that repeat give rows that repeat.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    b = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("t"), F.size(F.split(F.coalesce(item_text, F.lit("")), r"[\x20\x09-\x0D]+")).cast("long").alias("n"))
    total, most = b.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks = 1 + 2 * total // block_words
    schema = f"id {d.schema['id'].dataType.simpleString()}, item {b.schema['item'].dataType.simpleString()}, item_words int, tiled int, tiles int"
    out = None
    for k in range(blocks):
        rows = b.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k) if blocks > 1 else b
        seeds = seeds_of([(r.item, r.t) for r in rows.select("item", "t").collect()], min_match)
        part = d.mapInArrow(_tiler(docs.sparkSession.sparkContext.broadcast(seeds), schema), schema)
        out = part if out is None else out.union(part)
    return out


def _tiler(seeds, schema: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                at, rows = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for row in matches(words_of(text), seeds.value) if text else ():
                        at.append(k)
                        rows.append(row)
                if at:
                    item, n, covered, count = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(item), pa.array(n, pa.int32()), pa.array(covered, pa.int32()), pa.array(count, pa.int32())], ["id", "item", "item_words", "tiled", "tiles"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, **how) -> DataFrame:
    """(id, items, item, coverage): for documents that cover ``threshold`` of an item, how many, and the most covered, least first."""
    hits = tiled(docs, benchmark, **how).withColumn("coverage", F.col("tiled") / F.col("item_words")).where(F.col("coverage") >= threshold)
    best = F.min(F.struct(-F.col("coverage"), "item"))
    return hits.groupBy("id").agg(F.countDistinct("item").alias("items"), best.alias("b")).select("id", "items", F.col("b.item").alias("item"), (-F.col("b.col1")).alias("coverage"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` less the contaminated ones; rows that share an id go together, rows of a null id go if one is contaminated."""
    bad = contaminated(docs, benchmark, id_col=id_col, **how).select(F.col("id").alias("__id"))
    return docs.join(bad, F.expr(f"`{id_col}` <=> __id"), "left_anti")


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: whether it is contaminated, by how many items, the most covered one and its coverage."""
    docs = table(spark, sf_dir, "documents")
    bad = contaminated(docs, table(spark, sf_dir, "benchmark"))
    out = docs.select("doc_id").join(bad, F.expr("doc_id <=> id"), "left")
    return out.select("doc_id", F.col("id").isNotNull().alias("contaminated"), F.coalesce("items", F.lit(0)).alias("items"), F.col("item").alias("item_id"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
