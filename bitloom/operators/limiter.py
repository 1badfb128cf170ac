"""Codebooks of at most 32 bits, by demoting the rarest symbols; ambiguous choices are refused, not guessed."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .codec import EOF, MOST_BITS


def prefix_code(freqs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(symbol, bits, value) in merging order, by a heap: an account of ``codec.codebook`` of its own."""
    heap = [(f, s, [(s, 0, 0)]) for s, f in freqs] + [(1, EOF, [(EOF, 0, 0)])]
    heapq.heapify(heap)
    while len(heap) > 1:
        (f, rep, zero), (g, _, one) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (f + g, rep, [(s, b + 1, v) for s, b, v in zero] + [(s, b + 1, v + (1 << b)) for s, b, v in one]))
    return heap[0][2]


def limited(freqs: list[tuple[int, int]], most: int = MOST_BITS) -> tuple[str, int, list[tuple[int, int, int]], dict]:
    """(outcome, rounds, code, facts): outcome is ok, ambiguous_limiter_tie or code_too_long.

    Round k gives the k + 1 rarest symbols, by (frequency, symbol), frequency 1 in the frequencies as they were.
    Where more symbols share the last one's frequency than places are left, and it isn't 1, which of them
    would be demoted is undefined.
    """
    code = prefix_code(freqs)
    facts = {"uncapped": max(b for _, b, _ in code)}
    if facts["uncapped"] <= most:
        return "ok", 0, code, facts
    ranked = sorted(freqs, key=lambda x: (x[1], x[0]))
    for k in range(2, len(freqs) + 1):
        edge = ranked[k - 1][1]
        tied, slots = sum(f == edge for _, f in ranked), sum(f == edge for _, f in ranked[:k])
        if tied > slots and edge > 1:
            return "ambiguous_limiter_tie", k - 1, [], facts | {"min_k": k, "boundary": edge, "tied": tied, "slots": slots}
        low = {s for s, _ in ranked[:k]}
        code = prefix_code([(s, 1 if s in low else f) for s, f in freqs])
        if max(b for _, b, _ in code) <= most:
            return "ok", k - 1, code, facts
    return "code_too_long", len(freqs) - 1, [], facts


def limit_codebooks(hist: DataFrame) -> DataFrame:
    """(unit, outcome, rounds, uncapped, longest, min_k, boundary, tied, slots) for each unit of (unit, e, cnt)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        outcome, rounds, code, facts = limited(sorted(zip(map(int, rows["e"]), map(int, rows["cnt"]), strict=True)))
        longest = max((b for _, b, _ in code), default=None)
        return pd.DataFrame([[rows["unit"].iloc[0], outcome, rounds, facts["uncapped"], longest, *(facts.get(k) for k in ("min_k", "boundary", "tied", "slots"))]], columns=COLUMNS.split())

    return hist.groupBy("unit").applyInPandas(one, SCHEMA)


SCHEMA = "unit int, outcome string, rounds int, uncapped int, longest int, min_k int, boundary long, tied int, slots int"
COLUMNS = "unit outcome rounds uncapped longest min_k boundary tied slots"


def fibonacci(n: int) -> list[int]:
    out = [1, 1]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return out[:n]


def limiter_cases() -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Frequencies that need capping, or can't be capped without a choice that nobody specified."""
    for n in (30, 36, 40, 45):
        yield f"fib{n}", list(enumerate(fibonacci(n)))
    for value, upto in ((1, 6), (2, 6), (3, 10)):
        yield f"fib40_ties_at_{value}", [(s, value if s < upto else f) for s, f in enumerate(fibonacci(40))]
    yield "realistic_skew", [(96 + i, max(1, int(2 ** (20 - abs(i - 12) * 1.7)))) for i in range(31)]
