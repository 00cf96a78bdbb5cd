"""Matching pairs among the short texts of two groups, for tasks of the similarity join.

Texts of a cell are sorted by length, so that all pairs of two lengths have one bound. A 64-bit set of the characters
is compared for whole blocks of them at once, which leaves about one pair of words in a thousand; for those the longest
common subsequence is counted with bit vectors, one word per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from entitylake.operators.long_texts import MATCHES

BLOCK_PAIRS = 1 << 18  # pairs whose sets are compared at once
MEASURED_PAIRS = 1 << 16  # pairs that are measured at once

_NAMES = [column.split()[0] for column in MATCHES.split(", ")]


class Side:
    """Texts from shortest to longest: characters in rows, sets of characters, bands, and numbers of equal texts."""

    def __init__(self, texts: pa.Array, bands: np.ndarray, numbers: np.ndarray):
        names = texts.to_pylist()
        lengths = np.array([len(t) for t in names], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        self.texts, self.bands, self.numbers = texts.take(pa.array(order)), bands[order], numbers[order]
        self.lengths = lengths[order]
        codes = np.frombuffer("".join([names[i] for i in order]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        owner = np.repeat(np.arange(len(order)), self.lengths)
        self.chars = np.zeros((len(order), int(lengths.max(initial=0))), dtype=np.uint32)
        self.chars[owner, np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)] = codes
        self.bags = character_sets(codes, owner, len(order))

    def groups(self) -> list[tuple[int, int, int, int]]:
        """(length, band, first, end) of the texts of each length."""
        lengths, firsts = np.unique(self.lengths, return_index=True)
        ends = np.append(firsts[1:], len(self.lengths))
        return [(int(n), int(self.bands[a]), int(a), int(z)) for n, a, z in zip(lengths, firsts, ends)]


def character_sets(codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """64-bit set of each text's (character, n-th occurrence); every bit in which two differ costs an insert or delete."""
    grams = np.sort((owner.astype(np.uint64) << np.uint64(32)) | codes)
    places = np.arange(len(grams), dtype=np.uint64)
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = grams[1:] != grams[:-1]
    nth = places - np.maximum.accumulate(np.where(fresh, places, np.uint64(0)))
    tokens = ((grams & np.uint64(0xFFFFFFFF)) << np.uint64(8)) + nth
    bits = np.uint64(1) << ((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
    bags = np.zeros(n, dtype=np.uint64)
    np.bitwise_or.at(bags, (grams >> np.uint64(32)).astype(np.int64), bits)
    return bags


def pair_lcs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``x`` with that of ``y``, at most 64 characters in ``x``."""
    n = x.shape[1]
    full = np.uint64((1 << n) - 1)
    row = np.full(len(x), full, dtype=np.uint64)
    at = np.zeros((len(x), 8), dtype=np.uint8)
    for t in range(y.shape[1]):
        at[:, : -(-n // 8)] = np.packbits(x == y[:, t : t + 1], axis=1, bitorder="little")
        hit = row & at.view("<u8")[:, 0]
        row = ((row + hit) | (row ^ hit)) & full
    return n - np.bitwise_count(row).astype(np.int64)


def matches(
    xs: Side, ys: Side, key: int, diagonal: bool, most: Callable[[int], int], equal: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(x, y, distance, summed length) of the texts within the distance ``most`` gives for a summed length.

    Only pairs whose higher band is ``key``; on the diagonal, where both sides are the same texts, each pair once.
    Pairs of equal texts are left out unless ``equal``.
    """
    for n, band, a, z in xs.groups():
        for m, other, b, end in ys.groups():
            limit = most(n + m)
            if max(band, other) != key or abs(n - m) > limit or (diagonal and n > m):
                continue
            step = max(1, BLOCK_PAIRS // (end - b))
            waiting, count = [], 0
            for first in range(a, z, step):
                some = slice(first, min(first + step, z))
                near = np.bitwise_count(xs.bags[some, None] ^ ys.bags[None, b:end]) <= limit
                i, j = np.divmod(np.flatnonzero(near), end - b)
                i, j = i + first, j + b
                # Within a length each pair is met in both orders on the diagonal.
                mine, others = xs.numbers[i], ys.numbers[j]
                apart = mine < others if diagonal and n == m else equal | (mine != others)
                waiting.append((i[apart], j[apart]))
                count += len(waiting[-1][0])
                if count < MEASURED_PAIRS and some.stop < z:
                    continue
                i, j = (np.concatenate(part) for part in zip(*waiting))
                waiting, count = [], 0
                for p in range(0, len(i), MEASURED_PAIRS):
                    q, r = i[p : p + MEASURED_PAIRS], j[p : p + MEASURED_PAIRS]
                    distance = n + m - 2 * pair_lcs(xs.chars[q, :n], ys.chars[r, :m])
                    good = distance <= limit
                    if good.any():
                        yield q[good], r[good], distance[good], n + m


def match_cells(
    threshold: float, epsilon: float, equal: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function of the rows (key, text, band, is_left, diagonal) of a cell, to rows of ``MATCHES``."""

    def most(total: int) -> int:
        bound = int(np.floor(total * ((100 - threshold) / 100) + epsilon))
        return bound - (bound + total) % 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        left = rows.column("is_left").to_numpy()
        if left.all() or not left.any():
            return
        texts = rows.column("text").combine_chunks().cast(pa.string())
        bands = rows.column("band").to_numpy()
        numbers = texts.dictionary_encode().indices.to_numpy()
        xs, ys = (Side(texts.filter(pa.array(side)), bands[side], numbers[side]) for side in (left, ~left))
        key, diagonal = rows.column("key")[0].as_py(), rows.column("diagonal")[0].as_py()
        for i, j, distance, total in matches(xs, ys, key, diagonal, most, equal):
            yield pa.RecordBatch.from_arrays(
                [
                    xs.texts.take(pa.array(i)), ys.texts.take(pa.array(j)),
                    pa.array(np.full(len(i), total, dtype=np.int32)), pa.array(distance.astype(np.int32)),
                ],
                names=_NAMES,
            )

    return run

