"""Perceptual hashes of 32 x 32 luminance samples, and what similarity joins need of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, LOW = 32, 8
#: Work of making, shuffling and sorting a key, in meetings of two rows.
KEY_WORK = 6
_BASIS = np.cos(np.pi * (2 * np.arange(SIDE)[:, None] + 1) * np.arange(LOW) / (2 * SIDE)) * np.where(np.arange(LOW) == 0, np.sqrt(1 / SIDE), np.sqrt(2 / SIDE))


def phash_samples(samples: np.ndarray) -> np.ndarray:
    """64-bit hashes (in int64) of n x 1024 luminances: bit i tells whether the i-th low frequency of the cosine transform
    (rows of vertical frequencies) is over the lower median of those but the first, at nine decimals."""
    grid = samples.reshape(-1, SIDE, SIDE).astype(np.float64)
    low = np.round(np.einsum("nyx,yv,xu->nvu", grid, _BASIS, _BASIS, optimize=True), 9).reshape(-1, LOW * LOW)
    median = np.sort(low[:, 1:], axis=1)[:, 31]
    bits = (low > median[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(-1)


@F.pandas_udf(T.LongType())
def phash(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The hash of a binary of 1024 luminances; null for others."""
    for part in parts:
        good = part.map(lambda x: x is not None and len(x) == SIDE * SIDE).to_numpy(bool)
        out = pd.Series([None] * len(part), dtype="Int64")
        if good.any():
            samples = np.frombuffer(b"".join(bytes(x) for x in part[good]), np.uint8).reshape(-1, SIDE * SIDE)
            out[good] = phash_samples(samples)
        yield out


def luminance(pixels: bytes) -> bytes:
    """BGRA bytes as luminances, composed on white."""
    p = np.frombuffer(pixels, np.uint8).reshape(-1, 4).astype(np.int64)
    colour, alpha = p[:, :3], p[:, 3:]
    on_white = (colour * alpha + 255 * (255 - alpha) + 127) // 255
    return ((54 * on_white[:, 2] + 183 * on_white[:, 1] + 19 * on_white[:, 0]) >> 8).astype(np.uint8).tobytes()


@F.pandas_udf(T.BinaryType())
def luminances(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """luminance() of a binary of whole BGRA pixels; null for others."""
    for part in parts:
        yield part.map(lambda x: None if x is None or len(x) % 4 else luminance(bytes(x)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@dataclass(frozen=True)
class SearchPlan:
    """How to look for hashes that differ in at most distance bits. The 64 bits are cut into blocks; a piece is the union of taken
    blocks. On average a piece differs in taken / blocks of the bits that two hashes differ in, so one piece differs in at most
    radius bits, and no pair is lost.

    Two hashes meet in a piece at most once: the one changes the bits of the piece's lower part in which they differ, the
    other those of the upper part, and both give that value, with the number of bits changed in the lower part, as a key.
    Which of the two changes the lower part is settled too: the one whose lower part is less (the upper part, where those
    are equal). low: bits of the lower part."""

    distance: int
    blocks: int
    taken: int = 1
    low: int = 0

    @property
    def radius(self) -> int:
        return self.taken * self.distance // self.blocks

    def pieces(self) -> list[tuple[list[int], list[int]]]:
        """The bits of the lower and of the upper part of each piece. The first blocks are a bit wider where 64 doesn't divide."""
        edges = [i * (64 // self.blocks) + min(i, 64 % self.blocks) for i in range(self.blocks + 1)]
        unions = [[b for i in some for b in range(edges[i], edges[i + 1])] for some in combinations(range(self.blocks), self.taken)]
        return [(bits[: self.low], bits[self.low :]) for bits in unions]

    def keys(self) -> tuple[float, float]:
        """How many keys a row has on the one side and on the other, on average."""
        one = other = 0.0
        for low, high in self.pieces():
            below = [math.comb(len(low), i) for i in range(min(self.radius, len(low)) + 1)]
            one += (1 + sum(below)) / 2
            upto = lambda most: sum(math.comb(len(high), i) for i in range(min(most, len(high)) + 1))  # noqa: B023, E731
            other += (1 + upto(self.radius)) / 2 + sum(upto(self.radius - i) for i in range(1, len(below)))
        return one, other

    def meetings(self) -> float:
        """In how many pieces two hashes meet by chance, on average."""
        return sum(sum(math.comb(len(low + high), d) for d in range(self.radius + 1)) * 0.5 ** len(low + high) for low, high in self.pieces())


def search_plan(rows: int, distance: int, share: float = 1.0, times: int = 1) -> SearchPlan:
    """The plan with the least work in keys and meetings among so many rows. Few wide pieces have many keys and rare meetings,
    many narrow ones the reverse. share: of the pairs of rows that other keys let meet; times: how often the other side has
    each key, for them.

    Each row's keys grow with the rows, to the power 0.3 about at distance 12, and so do its meetings (rows : keys, meetings =
    20,000 : 460, 850; a million : 1,900, 10,800; 100 million : 27,600, 170,000)."""

    def cost(plan: SearchPlan) -> float:
        one, other = plan.keys()
        return KEY_WORK * rows * (one + times * other) + share * rows * rows / 2 * plan.meetings()

    shapes = [(k, m) for m in (1, 2, 3) for k in range(m, distance + 2) if (k, m) == (1, 1) or k > m and math.comb(k, m) <= 64]
    plans = (SearchPlan(distance, k, m, low) for k, m in shapes for low in range(0, m * 64 // k + 1, 2 if m * 64 // k > 8 else 1))
    return min(plans, key=cost)


def _changes(bits: list[int], n: int) -> list[int]:
    """All choices of n bits, as signed 64-bit masks."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << b for b in some)) for some in combinations(bits, n)]


def search_keys(hash_: Column, plan: SearchPlan, other: bool = False, *more: Column) -> Column:
    """A row's keys on one side or the other, as an array of 64-bit numbers; more: columns that keys depend on as well."""
    out = []
    for i, (low, high) in enumerate(plan.pieces()):
        piece = hash_.bitwiseAND(F.lit(_mask(low + high)))
        own = high if other else low
        for n in range(min(plan.radius, len(low)) + 1):  # bits changed in the lower part
            sizes = range(min(plan.radius - n, len(high)) + 1) if other else (n,)
            masks = [m for size in sizes for m in _changes(own, size)]
            values = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")  # folded to a constant
            if not other or n == 0:  # only changes that make the part greater on the one side, less on the other
                values = F.filter(values, _upwards(hash_, not other))
            out.append(F.transform(values, _keyed(F.lit(i * 65 + n), piece, more)))
    return F.concat(*out)


def _mask(bits: list[int]) -> int:
    return _changes(bits, len(bits))[0]


def _upwards(hash_: Column, up: bool):
    """Whether a change of bits makes a hash greater (or less) as an unsigned number; no change does."""
    least = F.lit(-(1 << 63)).cast("long")
    before = hash_.bitwiseXOR(least)

    def holds(mask: Column) -> Column:
        after = before.bitwiseXOR(mask)
        return (after >= before) if up else (after <= before)

    return holds


def _keyed(number: Column, piece: Column, more: tuple[Column, ...]):
    return lambda mask: F.xxhash64(number, piece.bitwiseXOR(mask), *more)


#: Meetings that are compared at once, and what finding a value's rows, a piece of them and one of them costs, in meetings.
TILE, VALUE_WORK, SLICE_WORK, ROW_WORK = 1 << 16, 20_000, 30, 3
#: Found pairs that are given at once, about.
GIVEN = 1 << 14


def _pieces(rows: int, others: int, distance: int, wide: int = 64) -> list[tuple[int, int]]:
    """(first bit, bits) of the pieces of the lowest wide bits that cost least: hashes that differ in at most distance bits are near in a piece (see
    _radii), so only those that are near in one need to meet."""

    def cost(pieces: list[tuple[int, int]]) -> float:
        near = [(bits, sum(math.comb(bits, i) for i in range(radius + 1))) for (_, bits), radius in zip(pieces, _radii(distance, len(pieces)))]
        return sum(n / 2**bits * others * (rows + min(rows, 2**bits) * ROW_WORK) + min(rows, 2**bits) * (VALUE_WORK + SLICE_WORK * n) for bits, n in near)

    shapes = [[(0, 0)]]  # all meet all
    for k in range(max(1, -(-wide // 16)), min(distance + 1, wide) + 1):
        edges = [i * (wide // k) + min(i, wide % k) for i in range(k + 1)]
        shapes.append([(a, b - a) for a, b in zip(edges, edges[1:])])
    return min(shapes, key=cost)


def _radii(distance: int, pieces: int) -> list[int]:
    """In how many bits each piece may differ. Hashes that differ in more bits of every piece differ in distance + 1 bits at
    least, as the radii and a bit more for each piece come to that; so no pair is lost. The first pieces are the wider ones."""
    return [(distance + 1) // pieces - (0 if i < (distance + 1) % pieces else 1) for i in range(pieces)]


def close_hashes(a: np.ndarray, b: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in a and in b of hashes (uint64) that differ in at most distance bits, each pair once, some at a time."""
    a, b, wide = _varying(a, b)
    pieces = _pieces(len(a), len(b), distance, wide)
    radii = _radii(distance, len(pieces))
    masks = [np.uint64(((1 << bits) - 1) << first) for first, bits in pieces]
    room, counts = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8)
    found, n = [], 0
    for at, (first, bits) in enumerate(pieces):
        piece = lambda x: ((x & masks[at]) >> np.uint64(first)).astype(np.int64)  # noqa: B023, E731
        of_a, of_b = piece(a), piece(b)
        order_a, order_b = np.argsort(of_a, kind="stable"), np.argsort(of_b, kind="stable")
        start_a, start_b = (np.concatenate([[0], np.cumsum(np.bincount(x, minlength=1 << bits))]) for x in (of_a, of_b))
        sorted_a, sorted_b = a[order_a], b[order_b]
        flips = np.array([sum(1 << x for x in some) for size in range(min(radii[at], bits) + 1) for some in combinations(range(bits), size)], np.int64)

        def new(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            """The places of what no earlier piece let meet."""
            x, y = (np.concatenate([f[side] for f in found]) for side in (0, 1))
            differ = sorted_a[x] ^ sorted_b[y]  # noqa: B023
            first_met = np.ones(len(x), bool)
            for mask, radius in zip(masks[:at], radii):  # noqa: B023
                first_met &= np.bitwise_count(differ & mask) > radius
            return order_a[x[first_met]], order_b[y[first_met]]  # noqa: B023

        for value in np.flatnonzero(np.diff(start_a)):
            beside = value ^ flips
            others = _runs(start_b[beside], start_b[beside + 1])
            if not len(others):
                continue
            ours, theirs = sorted_a[start_a[value] : start_a[value + 1]], sorted_b[others]
            for i, j in _tiles(len(ours), len(theirs)):
                shape = len(ours[i]), len(theirs[j])
                size = shape[0] * shape[1]
                differ = np.bitwise_xor(ours[i][:, None], theirs[j], out=room[:size].reshape(shape)).ravel()
                hits = np.flatnonzero(np.bitwise_count(differ, out=counts[:size]) <= distance)
                if len(hits):
                    found.append((start_a[value] + i.start + hits // shape[1], others[j.start + hits % shape[1]]))
                    n += len(hits)
                    if n >= GIVEN:
                        yield new(found)
                        found, n = [], 0
        if n:
            yield new(found)
            found, n = [], 0


def _varying(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """a and b with only the bits in which any two of them differ, as the lowest ones, and how many these are. Distances stay
    the same; a piece of bits that are all alike would tell nothing apart."""
    both = np.concatenate([a[:1], b[:1]])
    differ = int(np.bitwise_or.reduce(a ^ both[0]) | np.bitwise_or.reduce(b ^ both[0])) if len(both) else 0
    bits = [i for i in range(64) if differ >> i & 1]
    if len(bits) == 64:
        return a, b, 64
    out = [np.zeros(len(x), np.uint64) for x in (a, b)]
    for x, y in zip((a, b), out):
        for at, bit in enumerate(bits):
            y |= (x >> np.uint64(bit) & np.uint64(1)) << np.uint64(at)
    return *out, len(bits)


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places from each start up to its end, one run behind the other."""
    sizes = ends - starts
    last = np.cumsum(sizes)
    return np.arange(last[-1]) + np.repeat(starts - last + sizes, sizes)


def _tiles(rows: int, others: int) -> Iterator[tuple[slice, slice]]:
    wide = min(others, TILE)
    high = max(1, TILE // max(1, wide))
    for i in range(0, rows, high):
        for j in range(0, others, wide):
            yield slice(i, i + high), slice(j, j + wide)


def close_sums(a: np.ndarray, b: np.ndarray, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places in a and in b of rows of several hashes (frames x rows, uint64) that differ in at most total bits in sum."""
    for i, j in _tiles(a.shape[1], b.shape[1]):
        ours, theirs = a[:, i], b[:, j]
        two = sum(np.bitwise_count(ours[f][:, None] ^ theirs[f][None, :]) for f in range(min(2, len(a))))
        hits = np.flatnonzero((two <= total).ravel())  # two frames rule out nearly all
        if len(hits):
            x, y = hits // theirs.shape[1], hits % theirs.shape[1]
            near = np.bitwise_count(ours[:, x] ^ theirs[:, y]).sum(axis=0, dtype=np.int64) <= total
            yield x[near] + i.start, y[near] + j.start


def aspect_close(a: Column, b: Column, share: float = 0.05) -> Column:
    return F.abs(a - b) / F.greatest(a, b) <= share


def percent(distance: Column) -> Column:
    return F.lit(100.0) * (64 - distance) / 64
