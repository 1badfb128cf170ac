"""The codec over whole tensors as arrays: what ``codec`` says row by row, for containers of real size."""

from __future__ import annotations

import numpy as np

from .codec import CHUNK_BITS, CHUNK_BYTES, EOF, MOST_TABLES, MOST_WEIGHTS, RESERVED, WINDOW_BITS, WINDOWS_PER_CHUNK
from .limiter import limited

SUFFIXES = {"luts", "encoded_exponent", "sign_mantissa", "output_positions", "gaps", "split_positions"}


class Refused(ValueError):
    """A unit that must not be written; code names the rule, facts carry what was measured."""

    def __init__(self, code: str, **facts):
        super().__init__(f"{code}: {facts}")
        self.code, self.facts = code, facts


def split_fields(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (w >> 7 & 255).astype(np.uint8), (w >> 8 & 128 | w & 127).astype(np.uint8)


def tables_of(code: list[tuple[int, int, int]], correct: bool = False) -> np.ndarray:
    """Lookup tables and the row of lengths."""
    words = [(s, format(v, f"0{b}b")) for s, b, v in code if s != EOF]
    prefixes = {"": None} | {w[: (max(len(w), 1) - 1) // 8 * 8]: None for _, w in words}
    order = sorted(prefixes, key=len)
    if len(order) > MOST_TABLES:
        raise Refused("too_many_prefix_tables", tables=len(order))
    number, last = {p: i for i, p in enumerate(order)}, 0
    out = np.zeros((len(order) + 1, 256), np.uint8)
    for p, t in number.items():
        cells: dict[int, int] = {}
        for s, w in words:
            if w.startswith(p) and len(w) > len(p):
                head = w[len(p) : len(p) + 8]
                cells[int(head.ljust(8, "0"), 2)] = s if (len(w) - 1) // 8 == len(p) // 8 else 256 - number[w[: len(p) + 8]]
        last = 0 if correct else last
        for b in range(256):
            last = cells.get(b, last)
            out[t, b] = last
    for s, w in words:
        out[-1, s] = len(w)
    return out


def pack_fields(off: np.ndarray, bits: np.ndarray, val: np.ndarray, n_bytes: int) -> np.ndarray:
    """Fields of up to 32 bits laid at their offsets: each of the five bytes that a field can touch takes its part."""
    out = np.zeros(n_bytes + 5)
    wide = val.astype(np.uint64) << (40 - (off & 7) - bits).astype(np.uint64)
    for j in range(5):
        part = wide >> np.uint64(32 - 8 * j) & np.uint64(255)
        out += np.bincount((off >> 3) + j, part, len(out))[: len(out)]
    return out[:n_bytes].astype(np.uint8)


def block_index(bits: np.ndarray, block: int) -> dict[str, np.ndarray | int]:
    """The block index: a byte a block over the least length of full blocks, a base each 32 blocks, and escapes."""
    if block < 1:
        raise Refused("bad_block", block=block)
    lens = np.add.reduceat(bits.astype(np.int64), np.arange(0, len(bits), block))
    if lens.sum() > 2**32 - 1:
        raise Refused("too_long", bits=int(lens.sum()))
    full = lens[:-1] if len(bits) % block and len(lens) > 1 else lens
    least = int(full.min())
    d = lens - least
    fits = (d >= 0) & (d < 255)
    at = np.flatnonzero(~fits)
    return {"minlen": least, "lengths": np.where(fits, d, 255).astype(np.uint8), "superblocks": (np.cumsum(lens) - lens)[::32].astype("<u4"), "escapes": np.stack([at, lens[at]], 1).astype("<u4"), "total_bits": int(lens.sum())}


def encode(tensors: list[np.ndarray], correct_luts: bool = False, idx8_block: int | None = None) -> tuple[list[tuple[str, str, list[int], bytes]], dict]:
    """The unit's output tensors (suffix, dtype, shape, bytes), and a report."""
    w = np.concatenate(tensors) if tensors else np.zeros(0, np.uint16)
    n = len(w)
    if not n:
        raise Refused("empty_unit")
    if n > MOST_WEIGHTS:
        raise Refused("too_many_weights", n=n)
    e, sm = split_fields(w)
    counts = np.bincount(e, minlength=256)
    if counts[RESERVED:].any():
        i = int(np.argmax(e >= RESERVED))
        raise Refused("reserved_exponent", value=int(e[i]), index=i)
    outcome, rounds, code, facts = limited([(int(s), int(counts[s])) for s in np.flatnonzero(counts)])
    if outcome != "ok":
        raise Refused(outcome, **facts)
    luts = tables_of(code, correct_luts)
    lens, vals = np.zeros(256, np.int64), np.zeros(256, np.uint64)
    for s, b, v in code:
        if s != EOF:
            lens[s], vals[s] = b, v
    eof_bits, eof_val = next((b, v) for s, b, v in code if s == EOF)
    bits = lens[e]
    off = np.cumsum(bits) - bits
    total = int(off[-1] + bits[-1])
    n_bytes = -(-total // 8)
    data = pack_fields(off, bits, vals[e], n_bytes)
    starts, index = off, np.arange(n)
    if total % 8:
        free = 8 - total % 8
        # The EOF code begins in what is free of the last byte; the rest of it is dropped.
        data[-1] |= eof_val >> (eof_bits - free) if eof_bits >= free else eof_val << (free - eof_bits)
        starts, index = np.append(off, total), np.append(index, n)
    win, chunk = starts // WINDOW_BITS, starts // CHUNK_BITS
    first = np.flatnonzero(np.diff(win, prepend=-1))
    chunks = -(-n_bytes // CHUNK_BYTES)
    gaps = np.zeros(max(WINDOWS_PER_CHUNK * chunks, len(first)), np.int64)
    gaps[win[first]] = starts[first] % WINDOW_BITS
    packed = pack_fields(np.arange(len(gaps)) * 5, np.full(len(gaps), 5), gaps, -(-len(gaps) * 5 // 8))
    pos = np.append(index[np.flatnonzero(np.diff(chunk, prepend=-1))], n).astype("<u4")
    splits = np.cumsum([len(t) for t in tensors])[:-1].astype("<i8")
    flat = lambda a: a.tobytes()
    out = [
        ("luts", "U8", list(luts.shape), flat(luts)), ("encoded_exponent", "U8", [n_bytes], flat(data)), ("sign_mantissa", "U8", [n], flat(sm)),
        ("output_positions", "U8", [4 * len(pos)], flat(pos)), ("gaps", "U8", [len(packed)], flat(packed)), ("split_positions", "I64", [len(splits)], flat(splits)),
    ]
    if idx8_block is not None:
        x = block_index(bits, idx8_block)
        meta = np.array([idx8_block, x["minlen"], x["total_bits"] & 0xFFFFFFFF, len(x["lengths"])], "<u4")
        out += [("idx8_lengths", "U8", [len(x["lengths"])], flat(x["lengths"])), ("idx8_superblocks", "U8", [4 * len(x["superblocks"])], flat(x["superblocks"])), ("idx8_escapes", "U8", [16 + 8 * len(x["escapes"])], flat(meta) + flat(x["escapes"]))]
    return out, {"n": n, "rounds": rounds, "total_bits": total}


def looked_up(luts: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) of the code that would start at each bit, by the tables alone; length 0 where none does."""
    tables, lens = luts[:-1].astype(np.int64), luts[-1].astype(np.uint8)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(2 + len(tables), np.uint8)]).astype(np.uint16)
    pairs = raw[:-1] << 8 | raw[1:]
    # The eight bits from each bit on.
    eight = (pairs[:, None] >> np.arange(8, 0, -1, dtype=np.uint16) & 255).astype(np.uint8).ravel()
    bits = 8 * len(data)
    v = tables[0][eight[:bits]]
    for step in range(1, len(tables)):
        todo = np.flatnonzero(v >= 240)
        if not len(todo):
            break
        t = 256 - v[todo]
        v[todo] = np.where(t < len(tables), tables[np.minimum(t, len(tables) - 1), eight[todo + 8 * step]], 256)
    return v.astype(np.uint8), np.where(v < 240, lens[np.minimum(v, 255)], 0).astype(np.uint8)


def decode_many(luts: np.ndarray, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The symbols of runs that start at given bits, one after the other; all runs advance together, code by code."""
    sym, size = looked_up(luts, data)
    counts = np.asarray(counts, np.int64)
    order = np.argsort(-counts, kind="stable")
    pos, left = np.asarray(starts, np.int64)[order], counts[order]
    most = int(left[0]) if len(left) else 0
    out = np.zeros((most, len(left)), np.uint8)
    live = np.searchsorted(-left, -np.arange(most), "left")  # runs longer than each step
    for k in range(most):
        at = pos[: live[k]]
        if at.max() >= len(size):
            raise Refused("undecodable", bit=int(at.max()), element=k)
        step = size[at]
        if not step.all():
            raise Refused("undecodable", bit=int(at[np.argmin(step)]), element=k)
        out[k, : live[k]] = sym[at]
        at += step
    runs: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(left)
    for k, i in enumerate(order):
        runs[i] = out[: counts[i], k]
    return np.concatenate(runs) if runs else np.zeros(0, np.uint8)


def decode(luts: np.ndarray, data: bytes, n: int, bit: int = 0) -> np.ndarray:
    """n symbols from a bit on."""
    return decode_many(luts, data, np.array([bit]), np.array([n]))


def decode_stream(luts: np.ndarray, data: bytes, gaps: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """A whole unit, its chunks together: each starts at its bit and its window's gap."""
    chunks = np.arange(len(positions) - 1)
    return decode_many(luts, data, chunks * CHUNK_BITS + gaps[chunks * WINDOWS_PER_CHUNK], np.diff(positions))


def unpack_gaps(packed: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    return bits[: len(bits) // 5 * 5].reshape(-1, 5) @ np.array([16, 8, 4, 2, 1])


def recombined(e: np.ndarray, sm: np.ndarray) -> np.ndarray:
    e, sm = e.astype(np.uint16), sm.astype(np.uint16)
    return (sm & 128) << 8 | e << 7 | sm & 127
