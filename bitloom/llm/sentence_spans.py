"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, or with a line. Within one, pieces end at words whose hash, with
that of the word before, is the least of the three words on either side, so that a passage falls into the same pieces
wherever it begins; where no such word comes for ``most_words`` words, a piece ends there or up to two words earlier. Every run of ``run`` consecutive sentences of a document
is hashed; the first place of each hash, by id and then place, keeps it, and sentences that any other place of a
repeated hash covers are removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

_WORD = re.compile(r"[^ \t-\r]+")
_LINE = re.compile(r"[^\n]+")
REACH = 3


def _ends(words: list[bytes], most_words: int) -> list[int]:
    """The places of the last words of a line's pieces. Whether a word is the least around it depends on no other piece."""
    out, start = [], 0
    for last, w in enumerate(words):
        if w[-1] in b".!?" or last == len(words) - 1:
            n = last + 1 - start
            if n > REACH:
                c = list(map(crc32, words[start : last + 1]))
                h = [(x * 0x9E3779B1 + y * 0x85EBCA77) & 0xFFFFFFFF for x, y in zip([0, *c], c, strict=False)]
                cut = -1
                for k in range(REACH, n - 1):
                    x = h[k]
                    if x <= h[k + 1] and x < h[k - 1] and k + REACH < n and x < min(h[k - REACH : k]) and x <= min(h[k + 1 : k + REACH + 1]):
                        cut = k
                    elif k - cut >= most_words or k - cut >= most_words - 2 and k + 2 < n and x <= min(h[k - 2], h[k - 1], h[k + 1], h[k + 2]):
                        cut = k
                    else:
                        continue
                    out.append(start + k)
            out.append(last)
            start = last + 1
    return out


def sentences(text: str | None, most_words: int = 12) -> tuple[list[str], list[tuple[int, int]]]:
    """The sentences, lower-cased (A-Z) with single blanks, and where each lies in the text."""
    out: list[str] = []
    at: list[tuple[int, int]] = []
    for line in _LINE.finditer(text or ""):
        base, found = line.start(), list(_WORD.finditer(line[0]))
        words = line[0].encode("utf-8", "replace").lower().split()
        first = 0
        for end in _ends(words, most_words):
            out.append(b" ".join(words[first : end + 1]).decode())
            at.append((base + found[first].start(), base + found[end].end()))
            first = end + 1
    return out, at


def cut(text: str, at: list[tuple[int, int]], gone: set[int]) -> str:
    """The text without some of its sentences and the blanks that follow them; line ends stay."""
    parts, pos = [], 0
    for k in sorted(gone):
        start, end = at[k]
        while end < len(text) and text[end] in " \t\r\f\v":
            end += 1
        parts.append(text[pos:start])
        pos = end
    parts.append(text[pos:])
    return "".join(parts)


def _mark(text: str | None) -> int:
    """Tells rows apart that share an id."""
    return crc32((text or "").encode("utf-8", "replace"))


OPEN, REPEAT, COUNT = 0, 1, 2


def _kinds(h: np.ndarray, g: np.ndarray, rank: np.ndarray, p: np.ndarray) -> np.ndarray:
    """REPEAT for spans of which the same rows have an earlier one; ``rank`` is that of the span's id."""
    kind = np.zeros(len(h), np.int8)
    by = np.argsort(h, kind="stable")
    same = h[by][1:] == h[by][:-1]
    by = by[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    if len(by):
        by = by[np.lexsort((p[by], rank[by], g[by], h[by]))]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(h[by]) != 0) | (np.diff(g[by]) != 0))))
        first = by[np.repeat(new, np.diff(np.append(new, len(by))))]
        kind[by] = np.where((rank[by] != rank[first]) | (p[by] != p[first]), REPEAT, OPEN)
    return kind


def _spans(docs: DataFrame, id_col: str, text_col: str, run: int, most_words: int) -> DataFrame:
    """(kind, h, g, id, p): the 96-bit hash of each span, and its place: where it starts, then a hash of the text.

    Spans that are known to be repeats, and a row a document with its number of sentences in place of a start, have
    any hash, so that they are dealt out evenly.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                digests, sizes, n, marks = [], [], [], []
                for text in part.column(1).to_pylist():
                    marks.append(_mark(text))
                    s = sentences(text, most_words)[0]
                    spans = ["\n".join(x) for x in zip(*(s[k:] for k in range(run)), strict=False)]
                    digests += [xxhash.xxh3_128_digest(x) for x in spans]
                    sizes.append(len(s))
                    n.append(len(spans))
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                h, g = both[:, 0], both[:, 1].astype(np.int32)
                marks, row = np.array(marks), np.repeat(np.arange(len(n)), n)
                p = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) << 32 | marks[row]
                rank = pc.rank(part.column(0), sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
                kind = _kinds(h, g, rank[row], p)
                h = np.where(kind == REPEAT, (h ^ p) * 0x5851F42D4C957F2D, h)
                columns = [np.append(kind, np.full(len(n), COUNT, np.int8)), np.append(h, marks), np.append(g, np.zeros(len(n), np.int32))]
                ids = part.column(0).take(pa.array(np.append(row, np.arange(len(n)))))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), ids, pa.array(np.append(p, np.array(sizes) << 32 | marks))], ["kind", "h", "g", "id", "p"])

    return d.mapInArrow(hashed, f"kind byte, h long, g int, id {d.schema['id'].dataType.simpleString()}, p long")


def repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, most_words: int = 12) -> DataFrame:
    """(id, mark, starts, n): for each id and hash of a text, where its repeated spans that aren't the first start, and its sentences.

    Texts are cut once, and their spans dealt out once. Of a hot hash, each few hundred documents that are read together
    send their first span to its task, and their others elsewhere. Starts are at most as many as the document's
    sentences. n is null for texts of one id and hash whose numbers differ.
    """
    spans = _spans(docs, id_col, text_col, run, most_words)
    # Null ids come last. Places that equal the first have its rank.
    rank = F.rank().over(Window.partitionBy("kind", "h", "g").orderBy(F.col("id").isNull(), "id", "p"))
    found = spans.withColumn("rank", rank).where((F.col("kind") != OPEN) | (F.col("rank") > 1))
    size = F.when(F.col("kind") == COUNT, F.shiftright("p", 32).cast("int"))
    starts = F.collect_set(F.when(F.col("kind") != COUNT, F.col("p")))
    by = found.groupBy("id", F.col("p").bitwiseAND(0xFFFFFFFF).alias("mark")).agg(starts.alias("starts"), F.min(size).alias("n"), F.max(size).alias("most"))
    return by.select("id", "mark", "starts", F.when(F.col("n") == F.col("most"), F.col("n")).alias("n"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, most_words: int = 12) -> DataFrame:
    """``docs`` with ``text_col`` less its repeated sentences, and n_sentences and n_removed last, in place of columns so named.

    Documents of fewer than ``run`` sentences have no spans and stay. Null texts stay null, empty ones empty, with
    counts of 0. A span that repeats within a document is removed there too, but for its first place. Rows
    that share an id are documents of their own, told apart by a hash of their texts; equal ones keep the same.
    Only texts with repeats are cut into sentences again.
    """
    docs = docs.drop(*[c for c in ("n_sentences", "n_removed") if c in docs.columns])
    found = repeated_sentences(docs, id_col, text_col, run, most_words).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("starts").alias("__starts"), F.col("n").alias("__n"))
    met = docs.withColumn("__own", F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    met = met.join(found, F.expr(f"`{id_col}` <=> __id and __own = __mark"), "left").drop("__id", "__mark", "__own")
    schema = T.StructType([*docs.schema, T.StructField("n_sentences", T.IntegerType()), T.StructField("n_removed", T.IntegerType())])
    place = docs.columns.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts, n, m = [], [], []
                for text, first, size in zip(*(part.column(k).to_pylist() for k in (place, part.num_columns - 2, part.num_columns - 1)), strict=True):
                    gone: set[int] = set()
                    if first or size is None:
                        s, at = sentences(text, most_words)
                        gone, size = {(p >> 32) + j for p in first or () for j in range(run)}, len(s)
                    texts.append(cut(text, at, gone) if gone else text)
                    n.append(size)
                    m.append(len(gone))
                columns = [pa.array(texts, part.column(place).type) if k == place else part.column(k) for k in range(part.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(m, pa.int32())], schema.names)

    return met.mapInArrow(rewrite, schema)


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: sentences, how many were removed, the kept text's length in code points and SHA-256."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_sentences", "n_removed", F.length(kept).alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))
