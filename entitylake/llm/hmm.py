"""A hidden Markov language model of word sequences.

A state emits words, the end of a text, or "unknown". States, their transitions and each word they
emit come from Baum-Welch over all training texts: every task sums expected counts of the words of its blocks,
the sums are added by word in buckets of the vocabulary, stored, and joined to the blocks in the next round.
The weight of unknown words (as many as there are words seen once) is that of ``CLASSES`` classes of words by hash,
from exact counts of all training tokens; the driver gets sums of classes, whatever the corpus. A text's score is the exact likelihood of the whole
sequence by the scaled forward recursion. Training passes through texts in stretches of ``STRETCH`` tokens at once; forward
states and backward messages are carried over their edges, so expected counts are those of whole texts.

Words travel as blocks: the texts of an input split with a vocabulary of their own. Counts are joined to the
words of blocks, not to tokens, so what is shuffled follows the vocabularies. A round goes on in parts, whose shuffle files are
removed, and tables that the next one does not need are emptied.

Rows: a null or empty text is its end only; a null doc_id is not held out; repeated rows count each; without
any training text every token has probability 1, as in the base; an empty table
gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from entitylake.llm.common import (
    LOWER, NOT_SPACE, arrow_batches, emptied, id_text_crc, shared_folder, shuffles_removed, slices, span_hashes, spans, stored,
    text_buffer,
)

STATES = 8
CLASSES = 1 << 16
END = CLASSES
ROUNDS = 6
STRETCH = 1024
GROUP = 1024
GROUP_TOKENS = 1 << 18
#: Steps of a recursion between two scalings: word probabilities of 1e-30 still stay within doubles.
UNSCALED = 8
#: Tokens after which a block ends.
BLOCK_TOKENS = 10_000_000
#: Tokens of a row of a block, about; the rows of a block have numbers that follow that of its first one.
ROW_TOKENS = 1 << 22
BLOCK_SCHEMA = (
    "place int, doc_ids array<long>, held_out array<boolean>, counts array<long>, tokens binary, words array<long>, trained array<long>"
)


def _packed(tokens: np.ndarray) -> bytes:
    """Word numbers, which are small for frequent words: byte by byte, compressed."""
    planes = np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


@dataclass
class _Part:
    """Documents of one Arrow batch: tokens are numbers into the batch's own words."""

    doc_ids: pa.Array
    held_out: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    often: np.ndarray
    trained: np.ndarray


def _part(batch: pa.RecordBatch) -> _Part:
    data, offsets = text_buffer(batch.column("text"))
    hashes, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for a, z in slices(offsets):
        part = LOWER[data[offsets[a] : offsets[z]]]
        bounds = offsets[a : z + 1] - offsets[a]
        starts, ends = spans(NOT_SPACE[part], bounds)
        hashes.append(span_hashes(part, starts, ends))
        counts.append(np.diff(np.searchsorted(starts, bounds)))
    counts = np.concatenate(counts)
    words, tokens, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    held = batch.column("held_out").to_numpy(zero_copy_only=False)
    trained = np.bincount(tokens[~np.repeat(held, counts)], minlength=len(words))
    return _Part(batch.column("doc_id"), held, counts, tokens.astype("<u4"), words, often, trained)


def _list_of_one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(parts: list[_Part]) -> Iterator[pa.RecordBatch]:
    """The documents of batches in rows of about ``ROW_TOKENS``, their words by number; the first row has the words' hashes and training counts."""
    words, which = np.unique(np.concatenate([p.words for p in parts]), return_inverse=True)
    often = np.bincount(which, np.concatenate([p.often for p in parts]), len(words))
    trained = np.bincount(which, np.concatenate([p.trained for p in parts]), len(words)).astype(np.int64)
    by_count = np.argsort(-often, kind="stable")
    rank = np.empty(len(words), dtype="<u4")
    rank[by_count] = np.arange(len(by_count))
    numbers = np.split(rank[which], np.cumsum([len(p.words) for p in parts])[:-1])
    before = np.cumsum([len(p.tokens) for p in parts]) - [len(p.tokens) for p in parts]
    words, trained = words[by_count].view(np.int64), trained[by_count]
    for place, row in enumerate(np.unique(before // ROW_TOKENS)):
        chosen = np.flatnonzero(before // ROW_TOKENS == row)
        columns = [
            pa.array([place], pa.int32()),
            _list_of_one(pa.concat_arrays([parts[i].doc_ids for i in chosen])),
            _list_of_one(pa.array(np.concatenate([parts[i].held_out for i in chosen]))),
            _list_of_one(pa.array(np.concatenate([parts[i].counts for i in chosen]))),
            pa.array([_packed(np.concatenate([numbers[i][parts[i].tokens] for i in chosen]))], pa.binary()),
            _list_of_one(pa.array(words[: 0 if place else None])),
            _list_of_one(pa.array(trained[: 0 if place else None])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


def word_blocks(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stored blocks of all documents; block numbers are fixed by the write.

    A block has the texts of an input split, or of about ``BLOCK_TOKENS`` tokens: a word that its texts share stands there once.
    """
    arrow_batches(docs.sparkSession)
    held_out = F.coalesce(id_text_crc() % 5 == 1, F.lit(False)).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, tokens = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(_part(batch))
                tokens += len(parts[-1].tokens)
            if tokens >= BLOCK_TOKENS:
                yield from _block(parts)
                parts, tokens = [], 0
        if parts:
            yield from _block(parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    return stored(rows.mapInArrow(run, BLOCK_SCHEMA).withColumn("block", F.monotonically_increasing_id()), path=path)


@dataclass
class _Sequences:
    """Documents of a block as one array of symbols, each document's end included."""

    symbols: np.ndarray
    bounds: np.ndarray
    held_out: np.ndarray


def _sequences(batch: pa.RecordBatch, row: int, of_word: np.ndarray | None, end: int) -> _Sequences:
    """Symbols are those of words, or the words' numbers."""
    counts = batch.column("counts")[row].values.to_numpy()
    tokens = _unpacked(batch.column("tokens")[row].as_py())
    reach = np.concatenate([[0], np.cumsum(counts)])
    bounds = reach + np.arange(len(reach))
    symbols = np.full(bounds[-1], end, dtype=np.int32)
    is_word = np.ones(len(symbols), dtype=bool)
    is_word[bounds[1:] - 1] = False
    symbols[is_word] = tokens if of_word is None else of_word.astype(np.int32)[tokens]
    held = batch.column("held_out")[row].values.to_numpy(zero_copy_only=False).astype(bool)
    return _Sequences(symbols, bounds, held)


def _classes_of(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) % np.uint64(CLASSES)).astype(np.int64)


@dataclass
class Model:
    """First states of texts, mean states, transitions, and the classes (and the end) that states emit."""

    first: np.ndarray
    mean: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


@dataclass
class Expected:
    """Expected counts of an E-step."""

    first: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    log10: float = 0.0

    @classmethod
    def none(cls, states: int, symbols: int) -> Expected:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states)))


def expect(model: Model, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, fresh: np.ndarray, into: Expected) -> None:
    """Adds the expected counts of texts in stretches starts[i] .. ends[i].

    Fresh stretches begin a text; others go on with the text of the stretch before them.
    """
    lengths = ends - starts
    entry, leave = _edges(model, symbols, starts, lengths, fresh)
    order = np.argsort(-lengths, kind="stable")
    most = min(int(lengths.sum()), max(GROUP_TOKENS, int(lengths.max(initial=0))))
    room = np.empty((2, most, len(model.first)))  # used again by every group
    first = 0
    while first < len(order):
        some = order[first : first + min(GROUP, max(1, GROUP_TOKENS // int(lengths[order[first]])))]
        _expect_group(model, symbols, starts[some], lengths[some], fresh[some], entry[some], leave[some], into, room)
        first += len(some)


def _edges(model: Model, symbols, starts, lengths, fresh) -> tuple[np.ndarray, np.ndarray]:
    """The state before each stretch, given the text so far, and the message from the text behind it.

    One forward and one backward pass over the texts that are cut, side by side, which keep nothing but the vectors at
    edges. All stretches of a text but its last are of one length. Messages are up to a factor.
    """
    states = len(model.first)
    entry, leave = np.ones((len(starts), states)), np.ones((len(starts), states))
    begins = np.flatnonzero(fresh)
    pieces = np.diff(np.append(begins, len(starts)))
    if not (pieces > 1).any():
        return entry, leave
    begins, last = begins[pieces > 1], (begins + pieces - 1)[pieces > 1]
    sizes = starts[last] + lengths[last] - starts[begins]
    order = np.argsort(-sizes, kind="stable")
    begins, sizes, stretch = begins[order], sizes[order], int(lengths[begins[0]])
    texts, longest = starts[begins], int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()
    state = np.repeat(model.first[None], len(texts), axis=0)
    for t, n in enumerate(live):
        if t:
            if t % stretch == 0:
                entry[begins[:n] + t // stretch] = state[:n] / state[:n].sum(axis=1, keepdims=True)
            state = state[:n] @ model.moves
        state *= model.emits[symbols[texts[:n] + t]]
        if t % UNSCALED == UNSCALED - 1:
            state /= state.sum(axis=1, keepdims=True)
    back = np.ones((0, states))
    for t in range(longest - 1, stretch - 1, -1):
        n = live[t]
        if len(back) < n:
            back = np.concatenate([back, np.ones((n - len(back), states))])
        back = (back * model.emits[symbols[texts[:n] + t]]) @ model.moves.T
        if t % UNSCALED == 0 or t % stretch == 0:
            back /= back.sum(axis=1, keepdims=True)
        if t % stretch == 0:
            leave[begins[:n] + t // stretch - 1] = back
    return entry, leave


def _expect_group(model: Model, symbols, starts, lengths, fresh, entry, leave, into: Expected, room: np.ndarray) -> None:
    """``expect`` of stretches by descending length; tokens lie by their place in a stretch, all first ones first."""
    longest, states = int(lengths[0]), len(model.first)
    live = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()  # stretches longer than t
    at = np.concatenate([[0], np.cumsum(live)]).tolist()
    seen = np.concatenate([symbols[starts[:n] + t] for t, n in enumerate(live)])
    emitted, forward, ones = room[0, : at[-1]], room[1, : at[-1]], np.ones(states)
    np.take(model.emits, seen, axis=0, out=emitted, mode="clip")
    scales = {}
    state = np.where(fresh[:, None], model.first, entry @ model.moves)
    for t, n in enumerate(live):
        here = forward[at[t] : at[t + 1]]
        np.multiply(state[:n] if t == 0 else state[:n] @ model.moves, emitted[at[t] : at[t + 1]], out=here)
        if t % UNSCALED == UNSCALED - 1:
            scale = here @ ones
            here /= scale[:, None]
            into.log10 += float(np.log10(scale).sum())
            scales[t] = scale[:, None]
        state = here
    # From here on rows become, in place, shares of states and what comes in from the state before.
    back, steps, before_first = leave[:0], np.zeros((states, states)), entry * ~fresh[:, None]
    for t in range(longest - 1, -1, -1):
        n = live[t]
        here, ahead = forward[at[t] : at[t + 1]], emitted[at[t] : at[t + 1]]
        if len(back) < n:
            # Stretches that end here begin with the message from behind them.
            message, last = leave[len(back) : n], here[len(back) :]
            into.log10 += float(np.log10(last @ ones).sum())
            back = np.concatenate([back, message / ((last * message) @ ones)[:, None]])
        ahead *= back
        if t in scales:
            ahead /= scales[t]
        before = forward[at[t - 1] : at[t - 1] + n] if t else before_first
        steps += before.T @ ahead
        here *= back
        back = ahead @ model.moves.T
    into.moves += steps * model.moves
    into.first += forward[: live[0]][fresh].sum(axis=0)
    for a in range(0, len(seen), 1 << 16):
        cells = seen[a : a + (1 << 16), None] * np.int64(states) + np.arange(states)
        np.add.at(into.emits.reshape(-1), cells.reshape(-1), forward[a : a + (1 << 16)].reshape(-1))


def stretches(sequences: _Sequences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training texts in stretches: starts, ends, and whether a text begins there."""
    train = ~sequences.held_out
    begin, stop = sequences.bounds[:-1][train], sequences.bounds[1:][train]
    pieces = -(-(stop - begin) // STRETCH)
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begin, pieces) + number * STRETCH
    return starts, np.minimum(starts + STRETCH, np.repeat(stop, pieces)), number == 0


def _expected_rows(model: Model):
    states = len(model.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        into = Expected.none(states, CLASSES + 1)
        for batch in batches:
            for row in range(batch.num_rows):
                classes = _classes_of(batch.column("words")[row].values.to_numpy())
                sequences = _sequences(batch, row, classes, END)
                starts, ends, fresh = stretches(sequences)
                if len(starts):
                    expect(model, sequences.symbols, starts, ends, fresh, into)
        used = np.flatnonzero(into.emits.sum(axis=1))
        # Transitions, first states and the likelihood ride along under numbers below zero.
        rows = np.concatenate([into.emits[used], into.moves, into.first[None], np.full((1, states), into.log10)])
        numbers = np.concatenate([used, -1 - np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers.astype(np.int32)), *(pa.array(rows[:, s]) for s in range(states))],
            names=["symbol", *(f"s{s}" for s in range(states))],
        )

    return run


def _improved(model: Model, blocks: DataFrame, shares: np.ndarray) -> tuple[Model, float]:
    """One round of Baum-Welch over all blocks, and the log10 likelihood before it."""
    states = len(model.first)
    names = [f"s{s}" for s in range(states)]
    schema = "symbol int, " + ", ".join(f"{n} double" for n in names)
    sums = (
        blocks.select("held_out", "counts", "tokens", "words")
        .mapInArrow(_expected_rows(model), schema)
        .groupBy("symbol")
        .agg(*(F.sum(n).alias(n) for n in names))
        .toPandas()
    )
    numbers, values = sums["symbol"].to_numpy(), sums[names].to_numpy()
    emits = np.zeros((CLASSES + 1, states))
    emits[numbers[numbers >= 0]] = values[numbers >= 0]
    low = {-1 - n: v for n, v in zip(numbers.tolist(), values) if n < 0}
    moves = np.stack([low[s] for s in range(states)]) + 0.1
    first = low[states] + 0.1
    return maximised(first, moves, emits, shares), float(low[states + 1][0])


def maximised(first: np.ndarray, moves: np.ndarray, emits: np.ndarray, shares: np.ndarray) -> Model:
    """Model of expected counts; each state's classes lean a little to those of the corpus."""
    held = emits.sum(axis=0)
    lean = 1000 + 0.001 * held
    return Model(
        first / first.sum(),
        (held + 0.1) / (held + 0.1).sum(),
        moves / moves.sum(axis=1, keepdims=True),
        (emits + lean * shares[:, None]) / (held + lean),
    )


def initial(shares: np.ndarray, states: int = STATES, seed: int = 6) -> Model:
    """States that stay, and emit the corpus's classes in proportions varied at random."""
    random = np.random.default_rng(seed)
    emits = shares[:, None] * np.exp(0.5 * random.standard_normal((len(shares), states)))
    moves = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(moves, 0.95 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, even, moves, emits / emits.sum(axis=0))


@dataclass
class Words:
    """What scoring needs of the counts: tokens, words, and per class tokens and share of unknown words."""

    tokens: int
    different: int
    texts: int
    held: np.ndarray
    unknown: np.ndarray


def count_words(blocks: DataFrame, path: str | None = None) -> tuple[DataFrame, Words]:
    """Stored training counts of all words (word, n), and their summary."""
    pairs = blocks.select(F.explode(F.arrays_zip("words", "trained")).alias("p")).select("p.words", "p.trained")
    sums = pairs.filter(F.col("trained") > 0).groupBy(F.col("words").alias("word")).agg(F.sum("trained").alias("n"))
    counts = stored(sums, path=path)
    # Unsigned remainder of the hash, as in ``_classes_of``: CLASSES is a power of two.
    by_class = (
        counts.groupBy(F.col("word").bitwiseAND(F.lit(CLASSES - 1)).alias("c"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once"))
        .toPandas()
    )
    texts = blocks.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0] or 0
    held, once = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    held[by_class["c"].to_numpy(dtype=np.int64)] = by_class["n"]
    once[by_class["c"].to_numpy(dtype=np.int64)] = by_class["once"]
    held[END] = texts
    tokens = int(held.sum())
    mean = once.sum() / max(tokens, 1)
    unknown = np.where(held > 0, (once + mean) / (held + 1), 1.0)
    unknown[END] = 0.0
    unknown[:END] = np.clip(unknown[:END], 1e-9, 1.0)
    unknown[:END][held[:END] > 0] = np.minimum(unknown[:END][held[:END] > 0], 0.9)
    return counts, Words(tokens, int(by_class["v"].sum()) + int(texts > 0), int(texts), held, unknown)


def train(blocks: DataFrame, words: Words, states: int = STATES, rounds: int = ROUNDS) -> Model:
    shares = (words.held + 0.5) / (words.tokens + 0.5 * (CLASSES + 1))
    model = initial(shares, states)
    for _ in range(rounds):
        model, _ = _improved(model, blocks, shares)
    return model


@dataclass
class WordEmissions:
    """What states emit of single words: expected counts of words, leaning to the words' shares of the corpus.

    Added over the words of a class this is what ``maximised`` gives the class. Before the first
    round (no ``held``) words have their shares of the initial model's classes.
    """

    model: Model
    shares: np.ndarray
    tokens_of_class: np.ndarray
    buckets: int
    held: np.ndarray | None = None

    def order(self, words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known words by bucket, and where each bucket starts and the last ends."""
        places = np.flatnonzero(known > 0)
        bucket = (words[places].view(np.uint64) % np.uint64(self.buckets)).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        return places[by_bucket], np.searchsorted(bucket[by_bucket], np.arange(self.buckets + 1))

    def emits(self, words: np.ndarray, known: np.ndarray, given: bytes, end: np.ndarray | None = None) -> np.ndarray:
        """One row for each word of a block, and behind them that of the end, if given."""
        behind = 0 if end is None else len(end)
        classes = _classes_of(words)
        share = known / np.maximum(self.tokens_of_class[classes], 1)
        if self.held is None:
            of_words = self.model.emits[classes] * share[:, None]
            return np.concatenate([of_words, end]) if behind else of_words
        places, _ = self.order(words, known)
        out = np.zeros((len(words) + behind, len(self.held)))
        counts = out[: len(words)]
        counts[places, :-1] = np.frombuffer(given, dtype="<f8").reshape(len(places), len(self.held) - 1)
        counts[:, -1] = np.maximum(known - counts.sum(axis=1), 0)
        lean = 1000 + 0.001 * self.held
        share *= self.shares[classes]
        for s, weight in enumerate(lean):
            counts[:, s] += weight * share
        counts /= self.held + lean
        if behind:
            out[len(words) :] = end
        return out


#: Rows of a round: expected counts of a bucket's words in a block; blocks below zero hold sums of classes and of the rest.
#: Counts of the last state are left out: with those of the others they add up to the word's count, which is exact.
SUMS = "bucket long, block long, words binary, sums binary"
OF_CLASSES, OF_REST, OF_BLOCK = -1, -2, -3
#: The number of a block's first row, which stands for the block.
FIRST = "block - place"
BUCKET_WORDS = 1 << 17
#: Parts of a round whose shuffles are not on disk at the same time.
PARTS = 3


def _sums_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "block", "words", "sums"])


def _packed_counts(counts: np.ndarray) -> bytes:
    """Doubles byte by byte, without loss; only the two highest bytes (sign, exponent) are worth compressing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(counts, dtype="<f8").view(np.uint8).reshape(-1, 8).T)
    high = zstandard.ZstdCompressor(level=1).compress(planes[6:].tobytes())
    return b"".join([planes.shape[1].to_bytes(8, "little"), planes[:6].tobytes(), high])


def _unpacked_counts(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    low = np.frombuffer(data, dtype=np.uint8, count=6 * size, offset=8)
    high = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 + 6 * size :]), dtype=np.uint8)
    return np.ascontiguousarray(np.concatenate([low, high]).reshape(8, size).T).view("<f8").reshape(-1)


def _given(packed: bytes) -> bytes:
    return _unpacked_counts(packed).tobytes()


def _known_words(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Training counts and hashes of a block's words, and their expected counts in the order of buckets."""
    given = b"".join(map(_given, batch.column("given")[row].as_py())) if "given" in batch.schema.names else b""
    return batch.column("known")[row].values.to_numpy(), batch.column("words")[row].values.to_numpy(), given


def _of_block(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], bytes]:
    """Rows of a block, and the expected counts of its words in the order of buckets."""
    own, found = {}, {}
    for batch in batches:
        for row, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket == OF_BLOCK:
                own[batch.column("place")[row].as_py()] = batch.slice(row, 1)
            else:
                found[bucket] = _given(batch.column("sums")[row].as_py())
    return [own[place] for place in sorted(own)], b"".join(found[bucket] for bucket in sorted(found))


def _expected_words(of_words: WordEmissions):
    model, states = of_words.model, len(of_words.model.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = _of_block(batches)
        known, words, _ = _known_words(own[0], 0)
        emits = of_words.emits(words, known, given, model.emits[END:])
        del given
        into = Expected.none(states, len(emits))
        for batch in own:
            sequences = _sequences(batch, 0, None, len(words))
            starts, ends, fresh = stretches(sequences)
            if len(starts):
                expect(Model(model.first, model.mean, model.moves, emits), sequences.symbols, starts, ends, fresh, into)
        del emits
        places, edges = of_words.order(words, known)
        block = own[0].column("block")[0].as_py()
        for b, some in enumerate(np.split(places, edges[1:-1])):
            if len(some):
                yield _sums_batch([(b, block, words[some].tobytes(), _packed_counts(into.emits[some, :-1]))])
        low = np.concatenate([into.moves.reshape(-1), into.first, into.emits[-1], [into.log10]])
        yield _sums_batch([(OF_REST, OF_REST, b"", low.astype("<f8").tobytes())])

    return run


def _by_number(numbers: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, rows.shape[1]))
    for s in range(rows.shape[1]):
        out[:, s] = np.bincount(numbers, rows[:, s], size)
    return out


def _summed_words(states: int):
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        sums = group.column("sums").to_pylist()
        if bucket == OF_REST:
            sums = [np.frombuffer(x, dtype="<f8") for x in sums]
            return pa.Table.from_batches([_sums_batch([(bucket, OF_REST, b"", np.sum(sums, axis=0).tobytes())])])
        words = [np.frombuffer(x, dtype="<i8") for x in group.column("words").to_pylist()]
        different, which = np.unique(np.concatenate(words), return_inverse=True)
        each = np.concatenate([_unpacked_counts(x) for x in sums]).reshape(len(which), states - 1)
        totals = _by_number(which, each, len(different))
        classes, of_class = np.unique(_classes_of(different), return_inverse=True)
        by_class = _by_number(of_class, totals, len(classes))
        edges = np.cumsum([len(w) for w in words])[:-1]
        rows = [
            (bucket, block, b"", _packed_counts(totals[some]))
            for block, some in zip(group.column("block").to_pylist(), np.split(which, edges))
        ]
        rows.append((bucket, OF_CLASSES, classes.astype("<i8").tobytes(), by_class.tobytes()))
        return pa.Table.from_batches([_sums_batch(rows)])

    return run


def _beside_sums(blocks: DataFrame, sums: DataFrame | None) -> GroupedData:
    """Groups of the rows of a block and the sums of its words, so that no row is large."""
    blocks = blocks.withColumn("block", F.expr(FIRST))
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in blocks.dtypes if name != "block"]
    rows = blocks.select("*", F.lit(OF_BLOCK).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("sums"))
    if sums is not None:
        rows = rows.unionByName(sums.filter("block >= 0").select("block", *nothing, "bucket", "sums"))
    return rows.groupBy("block")


def _with_sums(blocks: DataFrame, sums: DataFrame | None) -> DataFrame:
    """Blocks with the expected counts of their words as ``given``."""
    if sums is None:
        return blocks
    found = sums.filter("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "sums"))).alias("found"))
    given = F.coalesce(F.col("found.sums"), F.array().cast("array<binary>")).alias("given")
    return blocks.join(found, "block", "left").select(*blocks.columns, given)


def train_words(blocks: DataFrame, words: Words, states: int = STATES, rounds: int = ROUNDS) -> tuple[WordEmissions, DataFrame | None]:
    """Baum-Welch with emissions of single words, of blocks with ``known`` counts.

    What grows with the vocabulary stays in the stored table of sums; the driver gets sums of classes and states.
    Two tables carry the rounds, what blocks expect and its sums. Each is emptied when the other has taken it up, and ``PARTS`` of the
    blocks, then of the buckets, are gone through one after the other, so disk holds these tables and a part of one in a shuffle.
    """
    spark, folder = blocks.sparkSession, shared_folder(blocks.sparkSession)
    shares = (words.held + 0.5) / (words.tokens + 0.5 * (CLASSES + 1))
    ends = [(i + 1) / PARTS for i in range(PARTS - 1)]
    size, ends = blocks.agg(F.sum(F.size("words")), F.percentile_approx(F.expr(FIRST), ends)).first()
    buckets = 1 << max(4, (int(size or 0) // BUCKET_WORDS).bit_length())
    of_words, sums = WordEmissions(initial(shares, states), shares, words.held, buckets), None
    part = lambda block: sum(((block > end).cast("int") for end in ends or []), F.lit(0))
    part_of_sums = F.when(F.col("block") >= 0, part(F.col("block"))).otherwise(-1).alias("part")
    for _ in range(rounds):
        for number in range(PARTS):
            given = None if sums is None else sums.filter(F.col("part") == number)
            some = blocks.drop("doc_ids").filter(part(F.expr(FIRST)) == number)
            rows = _beside_sums(some, given).applyInArrow(_expected_words(of_words), SUMS)
            rows.write.mode("append").parquet(f"{folder}/expected")
        if sums is not None:
            emptied(spark, f"{folder}/sums")
        expected = spark.read.schema(SUMS).parquet(f"{folder}/expected")
        for number in range(PARTS):
            some = expected.filter(F.pmod(F.col("bucket"), F.lit(PARTS)) == number)
            added = some.groupBy("bucket").applyInArrow(_summed_words(states), SUMS).select("*", part_of_sums)
            write = added.write.mode("append" if number else "overwrite").option("partitionOverwriteMode", "static")
            write.partitionBy("part").parquet(f"{folder}/sums")
        emptied(spark, f"{folder}/expected")
        sums = spark.read.schema(f"{SUMS}, part int").parquet(f"{folder}/sums")
        emits = np.zeros((CLASSES + 1, states))
        for row in sums.filter("part < 0").collect():
            values = np.frombuffer(row["sums"], dtype="<f8")
            if row["block"] == OF_REST:
                low = values
            else:
                classes = np.frombuffer(row["words"], dtype="<i8")
                np.add.at(emits[:, :-1], classes, values.reshape(len(classes), states - 1))
        emits[:, -1] = np.maximum(words.held - emits.sum(axis=1), 0)
        moves, first, emits[END], _ = np.split(low, np.cumsum([states * states, states, states]))
        model = maximised(first + 0.1, moves.reshape(states, states) + 0.1, emits, shares)
        of_words = WordEmissions(model, shares, words.held, buckets, emits.sum(axis=0))
    return of_words, sums


def forward_log10(model: Model, emitted: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Log10 likelihood of each sequence; ``emitted`` has a row of state likelihoods per token."""
    lengths = np.diff(bounds)
    out = np.zeros(len(lengths))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return out
    starts, sizes = bounds[:-1][order], lengths[order]
    state = np.repeat(model.first[None], len(order), axis=0)
    total = np.zeros(len(order))
    for t in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        ended, state = state[n:], state[:n]
        total[n : n + len(ended)] += np.log10(ended.sum(axis=1))
        state = (state if t == 0 else state @ model.moves) * emitted[starts[:n] + t]
        if t % UNSCALED == UNSCALED - 1:
            scale = state.sum(axis=1)
            total[:n] += np.log10(scale)
            state /= scale[:, None]
    total[: len(state)] += np.log10(state.sum(axis=1))
    out[order] = total
    return out


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _scored(model: Model, words: Words, of_words: WordEmissions):
    unknown_by_state = words.unknown[:END] @ model.emits[:END]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = _of_block(batches)
        known, hashes, _ = _known_words(own[0], 0)
        counts = np.append(known, words.texts)
        emits = of_words.emits(hashes, known, given, model.emits[END:])
        del given
        emits[:-1] *= (1 - words.unknown[_classes_of(hashes)])[:, None]
        emits[counts == 0] = unknown_by_state
        base = np.log10((counts + 0.5) / (words.tokens + 0.5 * (words.different + 1)))
        for batch in own:
            # The number of a word, the end behind all words.
            sequences = _sequences(batch, 0, None, len(known))
            begins = sequences.bounds[:-1]
            tokens = np.diff(sequences.bounds)
            likelihood = _in_parts(model, emits, sequences)
            columns = [
                batch.column("doc_ids")[0].values,
                pa.array(sequences.held_out),
                pa.array(tokens),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64)[sequences.symbols], begins)),
                pa.array(np.full(len(tokens), words.tokens)),
                pa.array(np.add.reduceat(base[sequences.symbols], begins)),
                pa.array(likelihood),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORES.split(", ")])

    return run


def _in_parts(model: Model, emits: np.ndarray, sequences: _Sequences, tokens: int = 1 << 19) -> np.ndarray:
    """``forward_log10`` of a block, of about so many tokens at a time."""
    out, first, bounds = [np.zeros(0)], 0, sequences.bounds
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + tokens, side="right")) - 1)
        part = sequences.symbols[bounds[first] : bounds[last]]
        out.append(forward_log10(model, emits[part], bounds[first : last + 1] - bounds[first]))
        first = last
    return np.concatenate(out)


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    with shuffles_removed(spark):
        uncounted = word_blocks(docs, f"{folder}/uncounted")
        counts, words = count_words(uncounted, f"{folder}/counts")
        blocks = stored(with_counts(uncounted, counts))
        emptied(spark, f"{folder}/uncounted", f"{folder}/counts")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))  # a row may have megabytes
        if not words.texts:
            nothing = Model(np.ones(1), np.ones(1), np.ones((1, 1)), np.full((CLASSES + 1, 1), 1 / CLASSES))
            of_words, sums = WordEmissions(nothing, words.held, words.held, 1), None
            words.unknown = np.ones(CLASSES + 1)
        else:
            of_words, sums = train_words(blocks, words, states, rounds)
    return _beside_sums(blocks, sums).applyInArrow(_scored(of_words.model, words, of_words), SCORES)


def with_counts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Blocks with the training counts of their words as ``known``."""
    places = blocks.select("block", F.posexplode("words").alias("place", "word"))
    most = blocks.agg(F.max(F.size("words"))).first()[0] or 0
    count = F.coalesce("n", F.lit(0))
    if most < 1 << 23:
        # Place and count in one number: 23 bits for a block's words, 40 for counts.
        found, unpacked = F.shiftleft(F.col("place").cast("long"), 40) + count, lambda x: x.bitwiseAND(F.lit((1 << 40) - 1))
    else:
        found, unpacked = F.struct("place", count.alias("n")), lambda x: x["n"]
    known = (
        places.join(counts, "word", "left")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(found)).alias("found"))
        .select("block", F.transform("found", unpacked).alias("known"))
    )
    joined = blocks.drop("trained").join(known, "block", "left")
    return joined.withColumn("known", F.coalesce("known", F.array().cast("array<long>")))
