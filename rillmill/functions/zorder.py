"""Morton codes in two and three dimensions, and the ranges of codes that a box covers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(coordinates: list[Column], bits: int) -> Column:
    """Bits of the coordinates interleaved, the first one's lowest; ``bits`` of each."""
    d = len(coordinates)
    parts = [F.shiftleft(F.shiftright(c.cast("bigint"), k).bitwiseAND(F.lit(1)), d * k + i) for i, c in enumerate(coordinates) for k in range(bits)]
    return reduce(lambda a, b: a + b, parts)


def decode(z: Column, dimensions: int, bits: int) -> list[Column]:
    """The coordinates of a code."""
    return [reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(z, dimensions * k + i).bitwiseAND(F.lit(1)), k) for k in range(bits)]) for i in range(dimensions)]


def inside(z: int, low: int, high: int, dimensions: int = 2) -> bool:
    """Whether the point of z lies in the box from the point of low to that of high."""
    for i in range(dimensions):
        mask = sum(1 << k for k in range(i, 64, dimensions))
        if not low & mask <= z & mask <= high & mask:
            return False
    return True


def litmax_bigmin(z: int, low: int, high: int, dimensions: int = 2, bits: int = 62) -> tuple[int, int]:
    """The greatest code in the box before z, and the least after it; z is a code between the box's corners that is outside the box."""
    litmax, bigmin = low, high
    for k in reversed(range(bits)):
        one = 1 << k
        below = sum(1 << j for j in range(k - dimensions, -1, -dimensions))  # lower bits of the same coordinate
        bit = (bool(z & one), bool(low & one), bool(high & one))
        if bit == (False, False, True):
            bigmin = low & ~below | one
            high = high & ~one | below
        elif bit == (False, True, True):
            return litmax, low
        elif bit == (True, False, False):
            return high, bigmin
        elif bit == (True, False, True):
            litmax = high & ~one | below
            low = low & ~below | one
    return litmax, bigmin


def middle(low: int, high: int, dimensions: int = 2) -> tuple[int, int]:
    """Where a box is cut in two: the last code of its lower half and the first of its upper half, along the highest bit in which the corners differ."""
    one = 1 << ((low ^ high).bit_length() - 1)
    below = sum(1 << j for j in range(one.bit_length() - 1 - dimensions, -1, -dimensions))
    return high & ~one | below, low & ~below | one


def ranges(low: int, high: int, dimensions: int = 2) -> list[tuple[int, int]]:
    """The runs of codes that make up the box, in order; a box is cut at its highest free bit until it is one run."""
    out: list[tuple[int, int]] = []

    def walk(lo: int, hi: int) -> None:
        size = 1
        for i in range(dimensions):
            mask = sum(1 << k for k in range(i, 64, dimensions))
            a, b = lo & mask, hi & mask
            squeeze = lambda v, i=i: sum(((v >> (dimensions * k + i)) & 1) << k for k in range(64 // dimensions))
            size *= squeeze(b) - squeeze(a) + 1
        if size == hi - lo + 1:
            if out and out[-1][1] + 1 == lo:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
            return
        litmax, bigmin = middle(lo, hi, dimensions)
        walk(lo, litmax)
        walk(bigmin, hi)

    walk(low, high)
    return out
