"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line that isn't blank is good or bad. A line's features are its own, and those of the lines before and
after it; a chain of two states has a score for each and for each change. Lines learn the label of their
document. Forward-backward gives each line's probability of being good, and a document's quality is their mean,
weighted by the lines' lengths. Only the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table

_KINDS = 9
_KIND = np.full(256, 8, np.uint8)
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = 0 if "a" <= _s <= "z" or _c >= 128 else 1 if "A" <= _s <= "Z" else 2 if _s.isdigit() else 3 if _s in " \t\r\f\v" else 4 if _s in ".,;:'\"-()" else 5 if _s == "!" else 6 if _s == "|" else 7 if _s in "#$%&*@^~_=+<>{}[]\\/`" else 8
#: Of one line: shares of kinds, their presence, and what words say.
OWN = 2 * _KINDS + 9
WIDTH = 3 * OWN + 3


def lines_of(text: str | None) -> list[bytes]:
    return [x for x in text.encode("utf-8", "replace").split(b"\n") if x.strip()] if text else []


def own_features(lines: list[bytes]) -> np.ndarray:
    """A row per line, without its neighbours."""
    out = np.zeros((len(lines), OWN), np.float32)
    if not lines:
        return out
    joined = np.frombuffer(b"".join(lines), np.uint8)
    n = np.array([len(x) for x in lines])
    starts = np.cumsum(n) - n
    kinds = _KIND[joined]
    for k in range(_KINDS):
        out[:, k] = np.add.reduceat(kinds == k, starts, dtype=np.int64)
    counts = out[:, :_KINDS].copy()
    out[:, :_KINDS] = np.sqrt(counts / n[:, None])
    out[:, _KINDS : 2 * _KINDS] = counts > 0
    for i, line in enumerate(lines):
        words = line.split()
        w = len(words)
        same = sum(map(bytes.__eq__, words, words[1:]))
        out[i, 2 * _KINDS :] = (np.log1p(w), same / w, same > 1, len(set(words)) / w, min(len(line) / w, 40.0) / 10, words[0][:1].isupper(), line.rstrip()[-1:] in b".!?", w < 3, w > 40)
    return out


def features(own: np.ndarray) -> np.ndarray:
    """The rows of one document with those before and after them, and marks of its ends."""
    n = len(own)
    x = np.zeros((n, WIDTH), np.float32)
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    x[:, 3 * OWN] = 1
    if n:
        x[0, 3 * OWN + 1] = x[-1, 3 * OWN + 2] = 1
    return x


def marginals(emit: np.ndarray, size: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For padded chains: emit[d, t] is the log odds of good. (P(good), expected changes of state, log Z)."""
    docs, most = emit.shape
    e = np.stack([np.zeros_like(emit), emit], 2)
    fwd, back = np.empty((most, docs, 2)), np.zeros((most, docs, 2))
    fwd[0] = e[:, 0]
    for t in range(1, most):
        step = np.logaddexp(fwd[t - 1][:, 0, None] + change[0], fwd[t - 1][:, 1, None] + change[1]) + e[:, t]
        fwd[t] = np.where((t < size)[:, None], step, fwd[t - 1])
    for t in range(most - 2, -1, -1):
        ahead = back[t + 1] + e[:, t + 1]
        step = np.logaddexp(change[:, 0] + ahead[:, 0, None], change[:, 1] + ahead[:, 1, None])
        back[t] = np.where((t + 1 < size)[:, None], step, 0.0)
    z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
    inside = np.arange(most)[:, None] < size
    p = np.where(inside, np.exp(np.minimum(fwd[..., 1] + back[..., 1] - z, 0)), 0).T
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            x = fwd[:-1, :, a] + change[a, b] + e[:, 1:, b].T + back[1:, :, b] - z
            pairs[a, b] = np.where(inside[1:], np.exp(np.minimum(x, 0)), 0).sum()
    return p, pairs, z


def _batches(sizes: np.ndarray, cells: int = 1 << 17) -> Iterator[np.ndarray]:
    """Documents of like numbers of lines together, of ``cells`` padded lines at most."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * sizes[order[hi]] <= cells and sizes[order[hi]] <= 2 * sizes[order[lo]] + 4:
            hi += 1
        yield order[lo:hi]
        lo = hi


class Field:
    """weights of the features for good over bad, change[a, b] of going from state a to b, prior for texts without lines."""

    def __init__(self, weights: np.ndarray, change: np.ndarray, prior: float):
        self.weights, self.change, self.prior = weights, change, prior

    def line_scores(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The probability of being good of each line of each text."""
        sizes = np.array([len(x) for x in texts], np.int64)
        own = own_features([line for lines in texts for line in lines])
        starts = np.cumsum(sizes) - sizes
        odds = [features(own[s : s + n]) @ self.weights for s, n in zip(starts, sizes, strict=True)]
        out: list[np.ndarray] = [np.zeros(0)] * len(texts)
        for at in _batches(sizes):
            if most := int(sizes[at].max()):
                emit = np.zeros((len(at), most))
                for k, i in enumerate(at):
                    emit[k, : sizes[i]] = odds[i]
                p = marginals(emit, sizes[at], self.change)[0]
                for k, i in enumerate(at):
                    out[i] = p[k, : sizes[i]]
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        lines = [lines_of(t) for t in texts]
        return [float(min(1.0, max(0.0, np.average(p, weights=[len(x) for x in own])))) if own else self.prior for own, p in zip(lines, self.line_scores(lines), strict=True)]


def train(docs: list[tuple[np.ndarray, int]], rounds: int = 250, rate: float = 0.05, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam over (own features of the lines, label) of documents."""
    good = sum(y for _, y in docs)
    prior = (good + 1) / (len(docs) + 2)
    docs = [d for d in docs if len(d[0])]
    w, change = np.zeros(WIDTH), np.zeros((2, 2))
    if not docs or good in (0, len(docs)):
        w[3 * OWN] = np.log(prior / (1 - prior))
        return Field(w, change, prior)
    sizes = np.array([len(x) for x, _ in docs])
    groups = []
    for at in _batches(sizes):
        x = np.concatenate([features(docs[i][0]) for i in at])
        row = np.repeat(np.arange(len(at)), sizes[at])
        place = np.concatenate([np.arange(n) for n in sizes[at]])
        groups.append((x, row, place, sizes[at], np.array([docs[i][1] for i in at])))
    total = len(docs)
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        grad = l2 * theta
        w, change = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        for x, row, place, size, y in groups:
            emit = np.zeros((len(size), int(size.max())))
            emit[row, place] = x @ w
            p, pairs, _ = marginals(emit, size, change)
            # Chains are weighed alike whatever their length, by their sum.
            grad[:WIDTH] += (p[row, place] - y[row]) @ x / total
            want = np.array([[((size - 1) * (y == 0)).sum(), 0], [0, ((size - 1) * (y == 1)).sum()]])
            grad[WIDTH:] += ((pairs - want) / total).ravel()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy(), prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = 3000) -> Field:
    """Learns from ``fit_rows`` labelled documents at most, those of the least hash of their id.

    Rows with a null label or id aren't learned from; a null or empty text only counts for the prior.
    Without labels of both kinds, every line has the prior's odds.
    """
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = docs.select(F.col(id_col).alias("i")).join(y, "i").orderBy(F.xxhash64("i"), "i").limit(fit_rows).distinct()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [own_features(lines_of(t)).astype(np.float16).tobytes() for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("i").cast(pa.string()), part.column("y"), pa.array(rows, pa.binary())], ["i", "y", "x"])

    # ``chosen`` has fit_rows rows at most, so it may go to every task.
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")
    rows = texts.mapInArrow(own, "i string, y int, x binary").collect()
    rows = sorted((r.i, bytes(r.x), r.y) for r in rows)
    return train([(np.frombuffer(x, np.float16).reshape(-1, OWN).astype(np.float32), y) for _, x, y in rows])


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): a row per row. A text that is null, or has no line that isn't blank, gets the prior of good."""
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()), pa.float64())], ["id", "score"])

    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, score double")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = fit(docs.where(~held), table(spark, sf_dir, "labels"))
    out = score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
