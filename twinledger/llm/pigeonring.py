"""Pigeonring filtering of SimHash fingerprints.

A fingerprint's 64 bits lie as a ring of segments.  If two fingerprints differ in at most ``bits`` bits, some
start on the ring has every chain of ``l`` segments, for each ``l``, within ``floor(bits * l / segments)``
differences.  So a pair that has no such start can go before the full Hamming check, and none within
the budget is lost.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = 5


def ring(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, and with them all 64 bits."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def mask(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def budgets(bits: int, segments: int = SEGMENTS) -> list[int]:
    """Most differences of chains of 1, 2 and more segments, up to all."""
    return [bits * n // segments for n in range(1, segments + 1)]


def chains(segments: int = SEGMENTS) -> np.ndarray:
    """For each start: masks of the chains of 1, 2 and more segments, up to all."""
    parts = ring(segments)
    return np.array([[sum(mask(*parts[(i + k) % segments]) for k in range(n)) for n in range(1, segments + 1)] for i in range(segments)], np.uint64)


def passes(x: np.ndarray, bits: int, segments: int = SEGMENTS) -> np.ndarray:
    """Which differences (xor of two fingerprints) have a start whose chains all keep within their budgets."""
    out = np.zeros(len(x), bool)
    for masks in chains(segments):
        at = np.flatnonzero(~out)
        for m, most in zip(masks, budgets(bits, segments), strict=True):
            at = at[np.bitwise_count(x[at] & m) <= most]
        out[at] = True
    return out


def passes_column(x: Column, bits: int, segments: int = SEGMENTS) -> Column:
    """The same for a column of differences as longs."""
    within = lambda m, most: F.bit_count(x.bitwiseAND(F.lit(signed(int(m))))) <= most
    return reduce(or_, [reduce(and_, [within(m, most) for m, most in zip(masks, budgets(bits, segments), strict=True)]) for masks in chains(segments)])


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(votes: np.ndarray, total: int) -> int:
    """SimHash from the votes of ``total`` hashes: a bit is 1 if set in over half of them."""
    return int(np.packbits(2 * votes > total, bitorder="little").view(np.uint64)[0])
