"""Texts as numpy arrays of code points, with hashes of any span from prefix sums."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each text begins (one entry more than texts)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=at[1:])
    return flat, at


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            out = []
            for x in (self.base, self.inverse):
                a = np.full(n, x, np.uint64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=np.uint64))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefix:
    """Prefix sums of a polynomial; ``spans`` gives one hash per span, equal for equal spans wherever they stand."""

    def __init__(self, flat: np.ndarray):
        up, self.down = POWERS.to(max(1, len(flat)))
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(0x1F123BB5)) * up[: len(flat)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


@cache
def kinds() -> np.ndarray:
    """For every code point: letter, digit (any number), white space or other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        for m in regex.finditer(f"{pattern}+", every):
            out[m.start() : m.end()] = kind
    return out


@cache
def alphanumeric() -> np.ndarray:
    """For every code point whether it is a letter or digit in Python's sense."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def chunks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring items of at most ``most`` in sum (or of one larger item)."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > begin:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out
