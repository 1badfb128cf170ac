"""Language ID by nearest centroid: TF-IDF byte n-gram vectors against several centroids a language.

Texts are lower-cased; what is neither a letter nor beyond ASCII becomes a blank. Byte 2- and 3-grams are
hashed into DIM cells; a vector is log(1 + count) * idf, made unit length. The idf covers every training row.
Centroids are fitted by spherical k-means on at most ``fit_rows`` training rows a language, those of
the least hash of their id. A text goes to the language of the centroid of the greatest cosine; one
farther from it than any text of that language would be is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, table

DIM = 4096
CHUNK = 1 << 21  # bytes of text whose n-grams are held at once
_FOLD = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
_LETTER = re.compile(r"[^\W\d_]")


def _grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, counts by cell) of each text; texts are taken together up to CHUNK bytes, long ones in pieces."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < CHUNK):
            size += len(texts[end]) + 3
            end += 1
        group = texts[at:end]
        if size <= 4 * CHUNK:
            for k, c in enumerate(_counts(group)):
                yield at + k, c
        else:  # one very long text: pieces overlap by two bytes, so that each n-gram counts once
            text, total = b" " + group[0] + b" ", np.zeros(DIM, np.int64)
            for lo in range(0, len(text), CHUNK):
                piece = text[lo : lo + CHUNK + 2]
                last = lo + CHUNK + 2 >= len(text)
                h2, h3 = _hashes(np.frombuffer(piece, np.uint8))
                total += np.bincount(h2 if last else h2[:CHUNK], minlength=DIM) + np.bincount(h3 if last else h3[:CHUNK], minlength=DIM)
                if last:
                    break
            yield at, total
        at = end


def _hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = b.astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:] if len(x) > 1 else x[:0]
    three = (two[:-1] << np.uint32(8)) | x[2:] if len(x) > 2 else x[:0]
    return (two * np.uint32(0x9E3779B1)) >> np.uint32(20), (three * np.uint32(0x85EBCA6B)) >> np.uint32(20)


def _counts(group: list[bytes]) -> Iterator[np.ndarray]:
    joined = np.frombuffer(b" " + b" \0 ".join(group) + b" ", np.uint8)
    h2, h3 = _hashes(joined)
    lo = 0
    for t in group:
        n = len(t) + 2
        yield np.bincount(h2[lo : lo + n - 1], minlength=DIM) + np.bincount(h3[lo : lo + n - 2], minlength=DIM)
        lo += n + 1


def _fold(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            yield part, part.column(column).to_pylist()


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """The number of rows that have each cell, and of rows; counted over all rows, one vector a partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM + 1, np.int64), 0
        for _, texts in _texts(batches, "t"):
            for _, c in _grams([_fold(t) for t in texts]):
                df[:DIM] += c > 0
                n += 1
        df[DIM] = n
        yield pa.RecordBatch.from_pydict({"cell": np.arange(DIM + 1, dtype=np.int32), "n": df})

    rows = texts.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r.cell] = r.n
    return out[:DIM], int(out[DIM])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int, rounds: int = 12, least: float = 0.05) -> np.ndarray:
    """Spherical k-means from rows at even steps of their cosine to the mean; at most k centroids.

    Centroids of less than ``least`` of the rows stand for outliers, not for a language, and are given up.
    """
    order = np.argsort(x @ _unit(x.mean(0)), kind="stable")
    c = x[order[[(2 * j + 1) * len(x) // (2 * k) for j in range(min(k, len(x)))]]]
    for _ in range(rounds):
        to = np.argmax(x @ c.T, 1)
        own = [x[to == j] for j in range(len(c))]
        c = np.array([_unit(m.mean(0)) for m in own if len(m) >= max(1, least * len(x))])
    return c


class Centroids:
    """langs[i] is the language of centroid i; floors[i] the least cosine that it accepts."""

    def __init__(self, idf: np.ndarray, langs: list[str], matrix: np.ndarray, floors: np.ndarray):
        self.idf, self.langs, self.matrix, self.floors = idf, langs, matrix, floors

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.langs else []
        lang, score, out = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        folded = [_fold(texts[i]) for i in known]
        for lo in range(0, len(folded), 256):
            x = np.zeros((min(256, len(folded) - lo), DIM), np.float32)
            for k, c in _grams(folded[lo : lo + 256]):
                x[k] = c
            sims = _unit(np.log1p(x) * self.idf.astype(np.float32)) @ self.matrix.T
            best = np.argmax(sims, 1)
            for k, j in enumerate(best):
                i, s = known[lo + k], float(sims[k, j])
                lang[i], score[i], out[i] = self.langs[j], min(1.0, max(0.0, s)), bool(s < self.floors[j])
        return lang, score, out


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, centroids: int = 4, fit_rows: int = 256, slack: float = 0.25) -> Centroids:
    """Learns from rows with a text that has a letter and a language.

    ``fit_rows`` bounds the rows a language from which centroids are made; the idf is that of all rows.
    A centroid's floor is ``slack`` times the cosine that all but a hundredth of its own rows reach, or the
    least such figure of its language, whose short texts lie farther from centroids of long ones.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    df, n = document_frequencies(rows.select("t"))
    idf = np.log((1 + n) / (1 + df)) + 0.05
    pick = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    ids = rows.select("i", "l").withColumn("r", F.row_number().over(pick)).where(F.col("r") <= fit_rows).select("i", "l").distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, "t"):
            langs = part.column("l").to_pylist()
            at = [k for k, t in enumerate(texts) if _LETTER.search(t)]
            vecs = [_unit(np.log1p(c) * idf).astype(np.float32).tobytes() for _, c in _grams([_fold(texts[k]) for k in at])]
            ids = part.column("i").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), pa.array([langs[k] for k in at], pa.string()), pa.array(vecs, pa.binary())], ["i", "l", "v"])

    # At most fit_rows ids a language, so this side is small whatever the corpus.
    sample = rows.join(F.broadcast(ids), ["i", "l"], "left_semi").mapInArrow(vectors, "i string, l string, v binary").collect()
    by: dict[str, list[tuple[str, bytes]]] = {}
    for r in sample:
        by.setdefault(r.l, []).append((r.i or "", bytes(r.v)))
    langs, mats, floors = [], [], []
    for name in sorted(by):
        x = np.array([np.frombuffer(v, np.float32) for _, v in sorted(by[name])[: 4 * fit_rows]])
        c = _clusters(x, centroids)
        sims = x @ c.T
        to = np.argmax(sims, 1)
        own = [sims[to == j, j] for j in range(len(c))]
        floor = slack * min(float(np.quantile(o, 0.01)) for o in own if len(o))
        langs += [name] * len(c)
        mats += list(c)
        floors += [floor] * len(c)
    return Centroids(idf, langs, np.array(mats, np.float32).reshape(-1, DIM), np.array(floors))


def identify(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected last, in place of any columns of these names.

    A null text, or one without a letter, is ``und`` with score 0 and rejected, and so is every text where
    nothing was learned. Other texts get the nearest centroid's language, the first by name among equals,
    its cosine as the score, and whether that is below the centroid's floor.
    """
    names = ["lang_pred", "score", "rejected"]
    clash = [n for n in names if n in docs.columns]
    docs = docs.drop(*clash)
    schema = T.StructType([*docs.schema, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, text_col):
            lang, score, rejected = model.predict(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*part.schema.names, *names])

    return docs.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, model: Centroids, text_col: str = "text") -> DataFrame:
    """``docs`` less the rows that ``identify`` rejects; the columns, whatever their names, stay as they are."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, text_col):
            yield part.filter(pa.array([not x for x in model.predict(texts)[2]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return remainder(id_col, 4) == 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()), "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
