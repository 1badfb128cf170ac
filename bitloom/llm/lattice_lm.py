"""LM scoring by subword lattice likelihood.

The pieces of an existing vocabulary span a lattice over each word: every way to cut the word, with the mark
of its start before it, into pieces. A piece has a probability, and so has the end of a text; the probability of a
text is the sum, over all ways to cut it, of the products of its pieces, which a forward recursion
over logarithms gives. No piece reaches over the mark of a word's start, so a text's lattice is a row of its words'
lattices, and each distinct word needs one recursion. The vocabulary's own scores (minus the rank of a piece)
give the first probabilities, by Zipf's law; all distinct training words then weigh its pieces anew, by
expectation maximisation. The vocabulary itself is never changed.

Beside its pieces, a lattice has one arc over the whole word, if training has it, of (count - DISCOUNT) / N;
what the discount takes from all words, DISCOUNT * types / N, is the weight of the cuts into pieces. So the
model sums to 1 over all words and the end, and learns from every count of the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, remainder, table, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PACKED = 8  # bytes of a piece that make up a key as they are; longer ones are keyed by a rolling hash of 64 bits
ROLL = np.uint64(0x9E3779B97F4A7C15)
LOG10 = np.log(10.0)
DISCOUNT = 0.75


@lru_cache(2)
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces, log probabilities by Zipf's law of their ranks): a blank stands for the mark; all bytes are pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                ranks[piece] = max(0.0, -float(sp.get_score(i)))
    pieces = sorted(ranks)
    p = np.array([1 / (10 + ranks[x]) for x in pieces])
    return pieces, np.log(p / p.sum())


def _key(piece: bytes) -> int:
    """What ``Lattice._arcs`` makes of a piece's bytes."""
    key = int.from_bytes(piece[:PACKED], "little")
    for b in piece[PACKED:]:
        key = (key * int(ROLL) + b) & (1 << 64) - 1
    return key


class Lattice:
    """Pieces with their natural log probabilities."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = np.append(logp, -np.inf)
        self.tables = []
        for n in range(1, max(map(len, pieces)) + 1):
            own = sorted((_key(x), i) for i, x in enumerate(pieces) if len(x) == n)
            self.tables.append((np.array([k for k, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))

    def _arcs(self, a: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece (or none: the last number) at each start of each word, of one length all."""
        out, key = [], np.zeros(a.shape, np.uint64)
        for n, (keys, ids) in enumerate(self.tables[: a.shape[1]], 1):
            span = a.shape[1] - n + 1
            k, last = key[:, :span], a[:, n - 1 :].astype(np.uint64)
            if n <= PACKED:
                k |= last << np.uint64(8 * (n - 1))
            else:
                k *= ROLL
                k += last
            if not len(keys):
                out.append(None)
                continue
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            met = keys[at] == k
            # Long pieces are rare: a length that no word here has is passed over.
            out.append(np.where(met, ids[at], len(self.logp) - 1) if n <= PACKED or met.any() else None)
        return out

    def _forward(self, arcs: list, shape: tuple[int, int]) -> np.ndarray:
        w, n = shape
        f = np.full((n + 1, w), -np.inf)
        f[0] = 0
        for j in range(1, n + 1):
            terms = [f[j - k] + self.logp[arcs[k - 1][:, j - k]] for k in range(1, min(len(arcs), j) + 1) if arcs[k - 1] is not None]
            f[j] = np.logaddexp.reduce(terms)
        return f

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' probabilities, over all cuts."""
        out = np.zeros(len(words))
        for at, a in _by_length(words):
            out[at] = self._forward(self._arcs(a), a.shape)[-1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in so many of each word."""
        total = np.zeros(len(self.logp))
        for at, a in _by_length(words):
            arcs = self._arcs(a)
            f, n, c = self._forward(arcs, a.shape), a.shape[1], counts[at]
            b = np.full((n + 1, a.shape[0]), -np.inf)
            b[n] = 0
            for i in range(n - 1, -1, -1):
                terms = [b[i + k] + self.logp[arcs[k - 1][:, i]] for k in range(1, min(len(arcs), n - i) + 1) if arcs[k - 1] is not None]
                b[i] = np.logaddexp.reduce(terms)
            for k, ids in enumerate(arcs, 1):
                if ids is not None:
                    span = n - k + 1
                    post = np.exp(f[:span].T + self.logp[ids] + b[k:].T - f[n][:, None]) * c[:, None]
                    total += np.bincount(ids.ravel(), post.ravel(), len(total))
        return total[:-1]


def _by_length(words: list[bytes], cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, bytes with the mark before) of words of one length."""
    n = np.array([len(x) for x in words])
    order = np.argsort(n, kind="stable")
    lo = 0
    while lo < len(order):
        size = n[order[lo]]
        hi = min(int(np.searchsorted(n[order], size, "right")), lo + max(1, cells // (size + 1)))
        a = np.frombuffer(b"".join(b" " + words[i] for i in order[lo:hi]), np.uint8).reshape(hi - lo, size + 1)
        yield order[lo:hi], a
        lo = hi


def word_counts(docs: DataFrame, id_col: str, text_col: str, trains: F.Column) -> DataFrame:
    """(word, c): every word of all rows, with how often the training rows have it; counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, other = Counter(), set()
        for batch in batches:
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known.update(words_of(text)) if own else other.update(words_of(text))
                if len(known) + len(other) > 400_000:
                    yield flush(known, other)
                    known, other = Counter(), set()
        yield flush(known, other)

    def flush(known: Counter, other: set) -> pa.RecordBatch:
        other -= known.keys()
        return pa.RecordBatch.from_arrays([pa.array([*known, *other], pa.binary()), pa.array([*known.values(), *([0] * len(other))], pa.int64())], ["word", "c"])

    rows = docs.select(F.col(text_col).alias("t"), trains.alias("own"))
    return rows.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(counts: DataFrame, path: str, rounds: int) -> Lattice:
    """Weighs the vocabulary's pieces by ``rounds`` of expectation maximisation over all distinct training words."""
    pieces, logp = vocabulary(path)
    lattice = Lattice(pieces, logp)
    sc = counts.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(lattice)  # as large as the vocabulary

        def expect(batches: Iterator[pa.RecordBatch], sent=sent, n=len(pieces)) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                for lo in range(0, batch.num_rows, 20_000):
                    part = batch.slice(lo, 20_000)
                    total += sent.value.expected(part.column(0).to_pylist(), np.ones(part.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], ["piece", "n"])

        rows = counts.where("c > 0").select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        n = np.full(len(pieces), 1e-3)
        for r in rows:
            n[r.piece] += r.n
        lattice = Lattice(pieces, np.log(n / n.sum()))
    return lattice


def score_documents(docs: DataFrame, trains: F.Column, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, rounds: int = 2, frequent: float = 2e-6) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score), one row per row.

    Tokens are a text's words and one end; null and empty texts have the end alone. ``trains`` says which
    rows are learned from. The words that make up ``frequent`` of all training tokens or more, of which there can't
    be more than 1 / frequent, go to every task; the others meet their counts in a join by hash. A null id, and
    rows that repeat an id, have rows of their own. Without training rows, N and V are 0, pieces have the
    vocabulary's probabilities and the end has 1/2.
    """
    spark = docs.sparkSession
    counts = checkpointed(word_counts(docs, id_col, text_col, trains))
    ends = docs.where(trains).count()
    n, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, types = n + ends, types + (ends > 0)
    lattice = fit_pieces(counts, path, rounds)
    # Log weights of the end and of the cuts into pieces.
    last, cuts = (np.log(ends / n), np.log(max(DISCOUNT * (types - 1), 1e-9) / n)) if ends else (np.log(0.5), np.log(0.5))
    sent = spark.sparkContext.broadcast(lattice)
    floor = max(2.0, frequent * n)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                words = part.column(0).to_pylist()
                h = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)
                c = part.column(1).to_numpy()
                with np.errstate(divide="ignore"):
                    whole = np.log(np.maximum(c - DISCOUNT, 0) / max(n, 1))
                lp = np.logaddexp(whole, cuts + sent.value.word_scores(words)) / LOG10
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(h), part.column(1), pa.array(lp)], ["word", "h", "c", "lp"])

    def base(c: float) -> float:
        return float(np.log10((c + 0.1) / (n + 0.1 * (types + 1))))

    weighed = checkpointed(counts.mapInArrow(weigh, "word binary, h long, c long, lp double"))
    top = {bytes(r.word): (int(r.c > 0), base(r.c), r.lp) for r in weighed.where(F.col("c") >= floor).select("word", "c", "lp").collect()}
    heavy = spark.sparkContext.broadcast(top)
    end = (int(ends > 0), base(ends), last / LOG10)
    # A key of a row's own: rows may share an id. Rows of documents bear it for a hash too, so as not to meet in one task.
    keyed = docs.select(F.monotonically_increasing_id().alias("k"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = keyed.schema["id"].dataType.simpleString()
    rows = keyed.mapInArrow(_tokens(heavy, end), f"k long, id {kind}, h long, n long, known long, base double, lp double")
    rare = weighed.where(F.col("c") < floor).select(F.col("h").alias("rh"), (F.col("c") > 0).cast("long").alias("rk"), F.log10((F.col("c") + 0.1) / (n + 0.1 * (types + 1))).alias("rb"), F.col("lp").alias("rl"))
    own = F.col("known").isNotNull()
    met = rows.join(rare, (F.col("h") == F.col("rh")) & ~own, "left")
    pick = lambda mine, its: F.sum(F.when(own, F.col(mine)).otherwise(F.col("n") * F.col(its)))
    sums = met.groupBy("k").agg(F.max(F.when(own, F.col("id"))).alias("id"), F.sum(F.when(own, F.col("n"))).alias("n_tokens"), pick("known", "rk").alias("n_known"), pick("base", "rb").alias("base_score"), pick("lp", "rl").alias("score"))
    return sums.select("id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _tokens(heavy, end: tuple[int, float, float]):
    """Per document, its sums over the end and frequent words, and a row for each of its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sums, at, hashes, times = [], [], [], []
                for i, text in enumerate(part.column("t").to_pylist()):
                    words = words_of(text)
                    k, b, s = end
                    for w, c in Counter(words).items():
                        if (x := known.get(w)) is not None:
                            k += c * x[0]
                            b += c * x[1]
                            s += c * x[2]
                        else:
                            at.append(i)
                            hashes.append(xxhash.xxh64_intdigest(w, 42))
                            times.append(c)
                    sums.append((len(words) + 1, k, b, s))
                if sums:
                    n, k, b, s = zip(*sums, strict=True)
                    keys, none = part.column("k"), len(at)
                    hashed = pa.array(np.array(hashes, np.uint64).view(np.int64))
                    both = lambda mine, kind: pa.array([*mine, *([None] * none)], kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([keys, keys.take(pa.array(at, pa.int64()))]), pa.concat_arrays([part.column("id"), pa.nulls(none, part.column("id").type)]), pa.concat_arrays([keys, hashed]), pa.array([*n, *times], pa.int64()), both(k, pa.int64()), both(b, pa.float64()), both(s, pa.float64())],
                        ["k", "id", "h", "n", "known", "base", "lp"],
                    )

    return run


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = remainder("doc_id", 10) == 0
    out = score_documents(docs, ~held).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
