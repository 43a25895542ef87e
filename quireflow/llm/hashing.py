"""Vectorised hashes of words and of runs of words or bytes.

All arithmetic is modulo 2**64 on NumPy arrays; nothing depends on the process,
so executors agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

U = np.uint64
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gold(n: int) -> np.uint64:
    """n times the golden ratio, modulo 2**64."""
    return U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U) + U(1000 * (seed + 1))) * _GOLD)


_VALUES = [_byte_values(0), _byte_values(1)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.ones(size, U)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * U(pow(b, done, 1 << 64))
                done *= 2
            made.append(p)
        held = (made[0], made[1])
        if n <= 1 << 23:
            _powers[base] = held
    return held[0][:n], held[1][:n]


class Words(NamedTuple):
    hashes: tuple[np.ndarray, ...]  # one array for each seed asked for
    bounds: np.ndarray  # the words of text i are bounds[i]:bounds[i + 1]
    doc: np.ndarray  # the text of each word


def word_hashes(raws: list[bytes], seeds: int = 1) -> Words:
    """Hashes of the words (runs of other than ASCII white space) of each text."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    space = np.concatenate([[True], _SPACE[data]])
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    out = []
    for seed in range(seeds):
        up, down = powers(_BASES[seed], len(data))
        total = np.concatenate([np.zeros(1, U), np.cumsum(_VALUES[seed][data] * up, dtype=U)])
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * _GOLD))
    lengths = np.array([len(r) + 1 for r in raws], np.int64)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return Words(tuple(out), bounds, np.repeat(np.arange(len(raws)), np.diff(bounds)))


def runs(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive values: max(0, len(x) - k + 1) of them."""
    if len(x) < k:
        return np.zeros(0, U)
    base = _BASES[seed]
    built, size, parts, left = x, 1, [], k
    while True:  # hashes of 1, 2, 4, ... values; those of k's binary digits are joined
        if left & 1:
            parts.append((size, built))
        left >>= 1
        if not left:
            break
        built = built[:-size] * U(pow(base, size, 1 << 64)) + built[size:]
        size *= 2
    n, at = len(x) - k + 1, 0
    out = np.zeros(n, U)
    for size, built in reversed(parts):
        out = out * U(pow(base, size, 1 << 64)) + built[at : at + n]
        at += size
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chunks(rows: Iterable[tuple], size, limit: int) -> Iterator[list[tuple]]:
    """Lists of rows whose sizes add up to about ``limit``."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
