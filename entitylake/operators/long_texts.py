"""Matching pairs among the long texts of two groups, for tasks of the similarity join.

Long texts of a language share most of their bigrams, so counting those sorts out few pairs and nearly all
have to be measured. The longest common subsequence is counted with bit vectors for a text against many others
at once: a step per character is a few array operations on all of them.

Where a cell has many pairs, they are sorted out first by a bound of the subsequence, a bit per pair: a cell of the
table of two texts is four operations on words of 64 pairs. Only cells that an alignment within the distance can
reach are visited, and characters are put into ``CLASSES``, which can only make a subsequence longer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

WORD_BITS = 63  # one bit below a word, which takes the carry
BIGRAM_BITS = 2048
SLICE_CHARS = 1 << 22  # characters of texts that are measured at once
CLASSES = 64  # of characters, for the bound
LANES = 4096  # texts whose bits make up the words of a table
TABLE_BYTES = 1 << 24  # of them, and about so many of the rows of a group
STATE_WORDS = 4096  # words that one operation goes over, of the pairs of some texts with a table
BOUND_PAIRS = 1 << 15  # pairs from which the bound pays
BOUND_CHARS = 4096  # longest text it is made for

MATCHES = "left_text string, right_text string, total int, distance int"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def bigram_bits(texts: list[np.ndarray]) -> np.ndarray:
    """One row of bits per text, set by (bigram, n-th occurrence); a bit that one text lacks is a bigram that it lacks."""
    out = np.zeros((len(texts), BIGRAM_BITS), dtype=np.float32)
    for row, codes in zip(out, texts):
        grams = np.sort((codes[:-1].astype(np.uint64) << np.uint64(32)) | codes[1:])
        places = np.arange(len(grams), dtype=np.uint64)
        starts = np.maximum.accumulate(np.where(np.append(True, grams[1:] != grams[:-1])[: len(grams)], places, 0))
        mixed = (grams * np.uint64(1099511628211) + (places - starts)) * np.uint64(0x9E3779B97F4A7C15)
        row[(mixed >> np.uint64(53)).astype(np.int64)] = 1
    return out


def padded(texts: list[np.ndarray], alphabet: np.ndarray) -> np.ndarray:
    """Numbers of the characters, a column per text, for texts from longest to shortest."""
    out = np.zeros((len(texts[0]), len(texts)), dtype=np.int32)
    for k, codes in enumerate(texts):
        out[: len(codes), k] = np.searchsorted(alphabet, codes)
    return out


def lcs_lengths(pattern: np.ndarray, letters: int, columns: np.ndarray, lengths: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a numbered text with the texts in ``some`` columns, longest first."""
    words = -(-len(pattern) // WORD_BITS)
    at = np.zeros((words, letters), dtype=np.uint64)
    places = np.arange(len(pattern))
    np.bitwise_or.at(at, (places // WORD_BITS, pattern), np.uint64(1) << (places % WORD_BITS).astype(np.uint64))
    full = np.bitwise_or.reduce(at, axis=1)[:, None]
    row = np.repeat(full, len(some), axis=1)
    out = np.empty(len(some), dtype=np.int64)
    left, sizes = len(some), lengths[some]
    carry = np.uint64(WORD_BITS)
    for t in range(int(sizes[0])):
        now = int(np.searchsorted(-sizes, -t, side="left"))
        if now < left:
            out[now:left] = np.bitwise_count(row[:, now:]).sum(axis=0)
            row, left = row[:, :now], now
        hit = row & at.take(columns[t, some[:now]], axis=1)
        total = row + hit
        for w in range(1, words):
            total[w] += total[w - 1] >> carry
        total |= row ^ hit
        total &= full
        row = total
    out[:left] = np.bitwise_count(row).sum(axis=0)
    return len(pattern) - out


def class_tables(classes: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Bits of the texts that have a character of a class at a place, by place and class; the last class is none at all."""
    lanes = -(-len(sizes) // 64) * 64
    columns = np.full((int(sizes.max()), lanes), CLASSES, dtype=np.uint8)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    columns[np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = classes[codes]
    parts = [np.packbits(columns < CLASSES, axis=1, bitorder="little").view(np.uint64)]
    for bit in reversed(range(CLASSES.bit_length() - 1)):
        plane = np.packbits((columns >> bit) & 1, axis=1, bitorder="little").view(np.uint64)
        parts = [half for part in parts for half in (part & ~plane, part & plane)]
    return np.stack([*parts, np.zeros_like(parts[0])], axis=1)


def place_sums(rows: np.ndarray) -> np.ndarray:
    """Number of bits at each place of rows of words, by adders of whole rows."""
    total, weight = np.zeros(rows.shape[1] * 64, dtype=np.int32), 1
    while len(rows):
        carries = [rows[:0]]
        while (third := len(rows) // 3):
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            apart = a ^ b
            carries.append((a & b) | (c & apart))
            rows = np.concatenate([apart ^ c, rows[3 * third :]])
        for row in rows:
            total += weight * np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int32)
        rows, weight = np.concatenate(carries), 2 * weight
    return total


def banded_lcs(letters: np.ndarray, table: np.ndarray, ahead: int, behind: int) -> np.ndarray:
    """Longest common subsequence of the texts in columns of classes with those of a table, a row for each of the former.

    Only characters up to ``ahead`` places later or ``behind`` earlier than those of the table's texts are matched.
    A row of words has the places where the subsequence grows from one character of ``letters`` to the next,
    ``still`` those where it did not grow from one of the table's to the next.
    """
    n, texts = letters.shape
    words = table.shape[2]
    rows = list(np.zeros((n, texts, words), dtype=np.uint64))
    held, still = np.empty((2, texts, words), dtype=np.uint64)
    one_or, one_and, one_xor = np.bitwise_or, np.bitwise_and, np.bitwise_xor
    for j, classes in enumerate(table):
        still.fill(np.iinfo(np.uint64).max)
        for i in range(max(0, j - behind), min(n, j + ahead + 1)):
            row = rows[i]
            classes.take(letters[i], 0, held, "clip")
            one_or(held, row, held)
            one_and(held, still, held)
            one_xor(row, held, row)
            one_xor(still, row, still)
            rows[i], held = held, row
    return place_sums(np.array(rows).reshape(n, -1)).reshape(texts, -1)


def likely_pairs(xs: list[np.ndarray], ys: list[np.ndarray], most: Callable[[np.ndarray], np.ndarray]):
    """(x, numbers of ys): pairs with all those that are within the distance, and few others, each pair once."""
    seen, counts = np.unique(np.concatenate(xs), return_counts=True)
    classes = np.full(0x110000, CLASSES, dtype=np.uint8)
    classes[seen[np.argsort(-counts, kind="stable")]] = np.arange(len(seen)) % CLASSES
    mine, theirs = (np.array([len(t) for t in side]) for side in (xs, ys))
    by_x, by_y = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    by_x, by_y = by_x[mine[by_x] > 0], by_y[theirs[by_y] > 0]
    longest = int(theirs.max(initial=1))
    lanes = max(64, min(LANES, TABLE_BYTES // (CLASSES * longest) * 8 // 64 * 64))
    for first in range(0, len(by_y), lanes):
        places = by_y[first : first + lanes]
        sizes = theirs[places]
        # One more, as the distance of an odd sum is rounded down.
        some = by_x[np.abs(mine[by_x] - np.clip(mine[by_x], sizes[0], sizes[-1])) <= most(mine[by_x] + sizes[-1]) + 1]
        if not len(some):
            continue
        table = class_tables(classes, sizes, np.concatenate([ys[p] for p in places]))
        step = max(1, min(STATE_WORDS, 2 * TABLE_BYTES // (8 * int(mine[some[-1]]))) // table.shape[2])
        for at in range(0, len(some), step):
            group = some[at : at + step]
            total = mine[group][:, None] + sizes
            limit = most(total)
            apart = mine[group][:, None] - sizes
            near = np.abs(apart) <= limit
            if not near.any():
                continue
            letters = np.full((int(mine[group].max()), len(group)), CLASSES, dtype=np.intp)
            for k, x in enumerate(group):
                letters[: mine[x], k] = classes[xs[x]]
            ahead, behind = (int((side + limit)[near].max()) // 2 for side in (apart, -apart))
            lcs = banded_lcs(letters, table, ahead, behind)[:, : len(sizes)]
            good = near & (total - 2 * lcs <= limit)
            for k in np.flatnonzero(good.any(axis=1)):
                yield int(group[k]), places[good[k]]


def measured(x: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Insert/delete distance of a text from others."""
    order = np.argsort([-len(y) for y in texts], kind="stable")
    alphabet = np.unique(x)
    # A character that the text lacks has a number of its own, which its pattern does not have.
    columns = np.full((len(texts[order[0]]), len(texts)), len(alphabet), dtype=np.int32)
    for k, p in enumerate(order):
        at = np.minimum(np.searchsorted(alphabet, texts[p]), len(alphabet) - 1)
        columns[: len(at), k] = np.where(alphabet[at] == texts[p], at, len(alphabet))
    lengths = np.array([len(texts[p]) for p in order])
    out = np.empty(len(texts), dtype=np.int64)
    common = lcs_lengths(np.searchsorted(alphabet, x), len(alphabet) + 1, columns, lengths, np.arange(len(order)))
    out[order] = len(x) + lengths - 2 * common
    return out


def many_matches(
    xs: list[np.ndarray],
    ys: list[np.ndarray],
    wanted: Callable[[int, np.ndarray], np.ndarray],
    most: Callable[[np.ndarray], np.ndarray],
):
    """As :func:`matches`, for many pairs."""
    for i, places in likely_pairs(xs, ys, most):
        places = places[wanted(i, places)]
        step = max(1, SLICE_CHARS // max([1, *(len(ys[p]) for p in places)]))
        for first in range(0, len(places), step):
            some = places[first : first + step]
            distance = measured(xs[i], [ys[p] for p in some])
            limit = most(np.array([len(xs[i]) + len(ys[p]) for p in some]))
            for j in np.flatnonzero(distance <= limit):
                yield i, int(some[j]), int(distance[j])


def matches(
    xs: list[np.ndarray],
    ys: list[np.ndarray],
    wanted: Callable[[int, np.ndarray], np.ndarray],
    most: Callable[[np.ndarray], np.ndarray],
    shared: Callable[[np.ndarray], np.ndarray],
):
    """(x, y, distance) of texts within the insert/delete distance that ``most`` gives for their summed length.

    ``wanted`` tells for a text of ``xs`` which of ``ys`` it is to be compared with, ``shared`` how many
    bigrams a matching pair has in common at least.
    """
    if len(xs) * len(ys) >= BOUND_PAIRS and max(len(t) for t in (*xs, *ys)) <= BOUND_CHARS:
        yield from many_matches(xs, ys, wanted, most)
        return
    alphabet = np.unique(np.concatenate([np.unique(t) for t in (*xs, *ys)]))
    numbered = [np.searchsorted(alphabet, x) for x in xs]
    bits_x = bigram_bits(xs)
    held_x = bits_x.sum(axis=1)
    order = np.argsort([-len(y) for y in ys], kind="stable")
    first = 0
    while first < len(order):
        step = max(1, SLICE_CHARS // max(1, len(ys[order[first]])))
        places = order[first : first + step]
        first += step
        texts = [ys[p] for p in places]
        lengths = np.array([len(y) for y in texts])
        columns, bits_y = padded(texts, alphabet), bigram_bits(texts)
        held_y = bits_y.sum(axis=1)
        both = bits_x @ bits_y.T
        for i, x in enumerate(xs):
            total = len(x) + lengths
            limit = most(total)
            least = shared(total)
            near = (np.abs(len(x) - lengths) <= limit) & wanted(i, places)
            near &= (len(x) - 1 - (held_x[i] - both[i]) >= least) & (lengths - 1 - (held_y - both[i]) >= least)
            some = np.flatnonzero(near)
            if not len(some):
                continue
            distance = total[some] - 2 * lcs_lengths(numbered[i], len(alphabet), columns, lengths, some)
            for j in np.flatnonzero(distance <= limit[some]):
                yield i, int(places[some[j]]), int(distance[j])


def match_groups(
    threshold: float, epsilon: float, longer_than: int, within: bool, equal: bool = False
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of the left and right rows (key, text, band[, diagonal]) of a cell, to rows of ``MATCHES``.

    A pair is compared under the higher of its two bands, if a text is longer than ``longer_than``.
    Pairs of equal texts are left out unless ``equal``.
    """

    def most(total: np.ndarray) -> np.ndarray:
        bound = np.floor(total * ((100 - threshold) / 100) + epsilon).astype(np.int64)
        return bound - (bound + total) % 2

    def shared(total: np.ndarray) -> np.ndarray:
        return total * ((3 * threshold - 200) / 200) - 1 - epsilon

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = [left, right]
        swap = len(left) > len(right)
        one, two = sides[::-1] if swap else sides
        names = [side.column("text").to_pylist() for side in (one, two)]
        found = []
        if len(one):
            key = one.column("key")[0].as_py()
            xs, ys = ([code_points(t) for t in side] for side in names)
            bands = [side.column("band").to_numpy() for side in (one, two)]
            long = np.array([len(y) > longer_than for y in ys])
            diagonal = within and one.column("diagonal")[0].as_py()
            rank = {t: k for k, t in enumerate(sorted({*names[0], *names[1]}))}
            ranks = [np.array([rank[t] for t in side]) for side in names]

            def wanted(i: int, places: np.ndarray) -> np.ndarray:
                mine, others = ranks[0][i], ranks[1][places]
                if diagonal:
                    apart = others < mine if swap else mine < others
                else:
                    apart = equal | (mine != others)
                return apart & (np.maximum(bands[0][i], bands[1][places]) == key) & (long[places] | (len(xs[i]) > longer_than))

            found = list(matches(xs, ys, wanted, most, shared))
        x, y = [names[0][i] for i, _, _ in found], [names[1][j] for _, j, _ in found]
        total = [len(a) + len(b) for a, b in zip(x, y)]
        columns = [y, x] if swap else [x, y]
        return pa.table(
            {
                "left_text": pa.array(columns[0], pa.string()),
                "right_text": pa.array(columns[1], pa.string()),
                "total": pa.array(total, pa.int32()),
                "distance": pa.array([d for _, _, d in found], pa.int32()),
            }
        )

    return run
