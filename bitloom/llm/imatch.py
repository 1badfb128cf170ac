"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the words whose inverse document frequency lies in a band: those in at least ``rarest`` and
at most ``commonest`` of all texts. Of such words there can't be more than (distinct words a text) / rarest,
whatever the corpus, so the lexicon goes to every task. Random subsets of the lexicon come in LEVELS
sizes, halving from level to level, PER_LEVEL of each. A fingerprint has a hash for each subset: of the text's
distinct words in the subset, sorted. Small subsets tell how much long texts have in common, large ones short texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of

LEVELS, PER_LEVEL = 11, 16
FEW = 8  # with fewer words of the lexicon, a text's other words count too
ENOUGH = 24  # subsets that likeness is taken from, the smallest first
_SALTS = np.array([xxhash.xxh64_intdigest(f"subset {k}") | 1 for k in range(PER_LEVEL)], np.uint64)


CHUNK_ROWS, CHUNK_CHARS = 64, 1 << 18  # rows whose fingerprints are taken together
_SPACE = b" \t\n\v\f\r"


def term_hashes(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct words."""
    return np.unique(np.array([xxhash.xxh64_intdigest(w, 7) for w in set(words_of(text))], np.uint64))


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, place, ends): the hashes of all words, sorted, and the places among them of each text's, ascending; a word is hashed once."""
    raw = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
    joined = b" ".join([b"", *raw, b""])
    x = np.frombuffer(joined, np.uint8)
    space = (x == 32) | (x - np.uint8(9) < 5)
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = turn[::2], turn[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(joined.translate(None, _SPACE))]).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, 7) for w in words.dictionary.to_numpy(zero_copy_only=False)], np.uint64)
    terms, place = np.unique(hashes, return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, bounds)))
    key = np.sort(text * max(1, len(terms)) + place[words.indices.to_numpy()])
    key = key[np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))]
    text, place = np.divmod(key, max(1, len(terms)))
    return terms, place, np.searchsorted(text, np.arange(len(texts) + 1))


def _depths(terms: np.ndarray) -> np.ndarray:
    """How many subsets of each row of subsets each word is in: as many as its salted hash has trailing zeros."""
    out = np.empty((len(terms), PER_LEVEL), np.int8)
    for lo in range(0, len(terms), 4096):
        part = terms[lo : lo + 4096, None]
        mixed = (part ^ (part >> np.uint64(31))) * _SALTS
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        low = mixed & (np.uint64(0) - mixed)
        out[lo : lo + 4096] = np.where(low == 0, LEVELS, np.minimum(np.frexp(low.astype(np.float64))[1] - 1, LEVELS))
    return out


def _hashed_subsets(terms: list[np.ndarray], depths: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of texts of which ``terms`` has the sorted hashes that count, and ``depths`` their depths."""
    out = np.zeros((len(terms), LEVELS, PER_LEVEL), np.uint16)
    if not terms:
        return out
    # Rows of subsets one after the other, each with its words still sorted; from level to level half of the words go.
    own = np.concatenate([np.tile(t, PER_LEVEL) for t in terms])
    deep = np.concatenate([d.T.ravel() for d in depths])
    bounds = np.concatenate(([0], np.cumsum(np.repeat([len(t) for t in terms], PER_LEVEL))))
    at = np.arange(len(own))
    for level in range(LEVELS):
        keep = np.flatnonzero(deep > level)
        if not keep.size:
            break
        at, deep = at[keep], deep[keep]
        ends = np.searchsorted(at, bounds)
        some = np.flatnonzero(np.diff(ends))
        data = own[at].tobytes()
        h = [xxhash.xxh64_intdigest(data[a:b], k) for k, a, b in zip((some % PER_LEVEL).tolist(), (8 * ends[some]).tolist(), (8 * ends[some + 1]).tolist(), strict=True)]
        out[some // PER_LEVEL, level, some % PER_LEVEL] = np.array(h, np.uint64) % np.uint64(65535) + np.uint64(1)
    return out


def fingerprint(terms: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """16 bits for each subset, by level, the largest subsets first; 0 where the text has no word of it."""
    if len(lexicon) and len(terms):
        at = np.minimum(np.searchsorted(lexicon, terms), len(lexicon) - 1)
        known = terms[lexicon[at] == terms]
        terms = known if len(known) >= FEW else terms
    return _hashed_subsets([terms], [_depths(terms)])[0]


class Prints:
    """Fingerprints of many texts, whose words are looked up and hashed once for all of them."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon, self.depths = lexicon, _depths(lexicon)

    def __call__(self, texts: list[str]) -> np.ndarray:
        terms, place, ends = _terms(texts)
        known = np.zeros(len(terms), bool)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, terms), len(self.lexicon) - 1)
            known = self.lexicon[at] == terms
        text = np.repeat(np.arange(len(texts)), np.diff(ends))
        few = np.bincount(text, known[place], len(texts)) < FEW
        use = known[place] | few[text]
        place, text = place[use], text[use]
        depths = np.empty((len(terms), PER_LEVEL), np.int8)
        if known.any():
            depths[known] = self.depths[at[known]]
        other = np.unique(place[~known[place]])
        depths[other] = _depths(terms[other])
        parts = np.split(place, np.searchsorted(text, np.arange(1, len(texts)))) if texts else []
        return _hashed_subsets([terms[k] for k in parts], [depths[k] for k in parts])


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of fingerprints, the share of equal hashes among subsets that either text has words of, from the smallest subsets up to ENOUGH of them."""
    used = ((a != 0) | (b != 0))[:, ::-1]
    seen = used.sum(2).cumsum(1)
    same = (used & (a == b)[:, ::-1]).sum(2).cumsum(1)
    row, stop = np.arange(len(a)), np.minimum((seen < ENOUGH).sum(1), LEVELS - 1)
    share = same[row, stop] / np.maximum(seen[row, stop], 1)
    return np.where((a == b).all((1, 2)), 1.0, share)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(likenesses(a[None], b[None])[0])


def _counted(texts: DataFrame, keep) -> DataFrame:
    """(h, n, texts): per task, the document frequencies of the hashes that keep(hashes, counts, texts) picks, and once how many texts it had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, n = [], 0, 0
        for chunk in _chunks(batches, 512):
            terms, place, _ = _terms([t for (t,) in chunk])
            parts.append((terms, np.bincount(place, minlength=len(terms))))
            held += len(terms)
            n += len(chunk)
            if held > 2_000_000:
                parts = [_merged(parts)]
                held = len(parts[0][0]) // 2  # so that merging costs no more than a few times what is new
        h, c = _merged(parts)
        pick = keep(h, c, n)
        h, c = h[pick], c[pick]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(np.full(len(h), n))], ["h", "n", "texts"])

    return texts.mapInArrow(run, "h long, n long, texts long")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their counts, those of all parts together."""
    h, c = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate((np.uint64, np.int64)))
    by = np.argsort(h, kind="stable")
    h, c = h[by], c[by]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    return h[new], np.add.reduceat(c, new) if len(new) else c


def lexicon(docs: DataFrame, text_col: str = "text", rarest: float = 5e-4, commonest: float = 0.05) -> np.ndarray:
    """Sorted hashes of the words in the band, by exact counts over all texts.

    A first pass finds candidates: each task gives the words that at least rarest / 2 of its texts have; one that
    rarest of all texts have is among them, and one whose counts, with all that other tasks may hide, can't
    reach that is dropped, which leaves words of about rarest / 2 of all texts at least. A second pass counts
    the candidates everywhere. Null texts count as texts without words.
    """
    texts = docs.select(F.col(text_col).alias("t"))
    total = docs.count()
    if not total:
        return np.zeros(0, np.uint64)
    half = rarest / 2
    rough = _counted(texts, lambda h, c, n: c >= half * n).groupBy("h").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    rough = rough.where(F.col("n") + half * (F.lit(total) - F.col("texts")) >= rarest * total)
    candidates = np.sort(np.array([r.h for r in rough.select("h").collect()], np.int64).view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(candidates)
    exact = _counted(texts, lambda h, c, n: np.isin(h, sent.value, assume_unique=True)).groupBy("h").agg(F.sum("n").alias("n"))
    band = exact.where((F.col("n") >= rarest * total) & (F.col("n") <= max(commonest * total, 2.0)))
    return np.sort(np.array([r.h for r in band.select("h").collect()], np.int64).view(np.uint64))


def in_stretches(docs: DataFrame, id_col: str, text_col: str, rows: int = 2048, most: int = 1 << 16) -> DataFrame:
    """(b, tail, id, t): documents in stretches b of ascending ids, sorted within each task by b, tail, id.

    Each stretch ends with a tail: the first document of the next stretch, the last one's being the first of all.
    Null ids come first; rows of one id are ordered by a hash of their text.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = d.count()
    n = int(min(most, max(1, total // rows)))
    cuts = np.unique(np.array(d.approxQuantile("id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else [], np.int64))

    @F.pandas_udf("int")
    def stretch(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).astype("int64"), "right"))).astype("int32")

    order = F.struct(F.col("id"), F.xxhash64("t"))
    firsts = d.select(stretch("id").alias("b"), "id").groupBy("b").agg(F.min(F.coalesce("id", F.lit(-(1 << 63)))).alias("id")).orderBy("b").collect()
    to = [(firsts[i - 1].b, r.b, r.id) for i, r in enumerate(firsts)]
    spark = docs.sparkSession
    heads = spark.createDataFrame([(b, i) for b, _, i in to], "hb int, hid long")
    placed = d.withColumn("b", stretch("id")).withColumn("tail", F.lit(False))
    tails = d.join(F.broadcast(heads), F.coalesce("id", F.lit(-(1 << 63))) == F.col("hid"))  # a row a stretch
    tails = tails.groupBy("hb").agg(F.min_by(F.struct("id", "t"), order).alias("x")).select(F.col("x.id").alias("id"), F.col("x.t").alias("t"), F.col("hb").alias("b"), F.lit(True).alias("tail"))
    return placed.unionByName(tails).repartition("b").withColumn("tie", F.xxhash64("t")).sortWithinPartitions("b", "tail", "id", "tie").select("b", "tail", "id", "t")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points, rounded down, gives way to as many of the next text's first, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    Null texts are empty. Texts without words have the fingerprint of zeros, which is like itself alone.
    A table of one row is its own next. Repeated ids follow each other in the order of a hash of their texts.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col, **band))
    rows = in_stretches(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, last = Prints(sent.value), None
        for chunk in _chunks(batches):
            # Each row's text, before them the last of the chunk before, and the edited text of each row but the last of a stretch.
            before = [last[:4]] if last else []
            rows = before + chunk
            pairs = [k for k in range(1, len(rows)) if not rows[k - 1][1] and rows[k - 1][0] == rows[k][0]]
            new = [edited(rows[k - 1][3], rows[k][3]) for k in pairs]
            fps = prints([r[3] for r in chunk] + new)
            own = np.concatenate([last[4][None], fps[: len(chunk)]]) if last else fps[: len(chunk)]
            new_fps, at = fps[len(chunk) :], np.array(pairs, np.int64)
            last = (*rows[-1], own[-1])
            if pairs:
                near = likenesses(own[at - 1], new_fps).tolist(), likenesses(own[at - 1], own[at]).tolist()
                hexes = [x.tobytes().hex() for x in own[at - 1].astype(">u2")], [x.tobytes().hex() for x in new_fps.astype(">u2")]
                shas = [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in new]
                yield _rows(list(zip((rows[k - 1][2] for k in pairs), (len(rows[k - 1][3]) for k in pairs), shas, *hexes, *near, strict=True)))

    return rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_ROWS) -> Iterator[list[tuple]]:
    """The rows, ``most`` together, fewer where texts (the last column) are long."""
    chunk, chars = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            chunk.append(row)
            chars += len(row[-1] or "")
            if len(chunk) == most or chars > CHUNK_CHARS * most // CHUNK_ROWS:
                yield chunk
                chunk, chars = [], 0
    if chunk:
        yield chunk


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
