"""Encoding to the pieces of a SentencePiece vocabulary by batched Viterbi, and decoding.

A text gets a space in front, spaces stand for the mark U+2581, and words start at
a space after another character: no piece of such a vocabulary reaches over that
(otherwise the whole text is one word). Different words of equal length advance together: at every end all
substrings up to the longest piece are looked up by hash in the sorted keys of the
pieces, the best total score is kept with its way back, ties by the longer last piece.
A character that no piece has costs more than any piece and becomes its UTF-8 bytes.

The scores are the file's. In a vocabulary of merges they are ranks of merges: the best path is then
a segmentation of its own, which decodes to the same text but is not the order of merges.

Rows: a null text has null ids and decodes to null, an empty one none; a character U+2581 of a text
decodes to a space. Extra columns are kept, but those named as results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from entitylake.llm.common import arrow_batches, mixed, slices, text_buffer
from entitylake.llm.span_cache import SpanCache

MARK = "▁"
UNKNOWN_COST = 10.0
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Cells of one batch of equal-length words.
CELLS = 1 << 21


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A vocabulary with its sorted keys, and the cache of encoded words."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        byte = [model.is_byte(i) for i in range(n)]
        usable = [i for i in range(n) if not special[i] and not byte[i]]
        self.byte_ids = np.full(256, -1, dtype=np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(re.fullmatch(r"<0x(..)>", names[i])[1], 16)] = i
        if (self.byte_ids < 0).any():
            self.byte_ids[:] = model.unk_id()
        self.longest = max((len(names[i]) for i in usable), default=1)
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _STEP)]), dtype=np.uint64)
        keys = np.array([self._key(names[i]) for i in usable], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array(usable, dtype=np.int64)[order]
        self.scores = np.array([model.get_score(i) for i in usable], dtype=np.float64)[order]
        self.unknown = float(self.scores.min()) - UNKNOWN_COST if usable else -UNKNOWN_COST
        self.splits = not any(MARK in names[i].lstrip(MARK) for i in usable)
        shown = [b"" if special[i] else bytes([int(names[i][3:5], 16)]) if byte[i] else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.shown_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.words = SpanCache(self._encode_words, np.int32)

    def _key(self, piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(_STEP) + ord(c)) % (1 << 64)
        return int(mixed(np.array([value], dtype=np.uint64) + np.uint64(len(piece)))[0])

    def _paths(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best path of each row of characters: (ids in order, counts); an unknown character c is -1 - c."""
        n, length = chars.shape
        prefix = np.zeros((n, length + 1), dtype=np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * _STEP + chars[:, j]
        best = np.zeros((n, length + 1))
        back = np.zeros((n, length + 1), dtype=np.int32)
        piece = np.zeros((n, length + 1), dtype=np.int64)
        row = np.arange(n)
        for j in range(1, length + 1):
            first = max(0, j - self.longest)
            sizes = np.arange(j - first, 0, -1)
            keys = prefix[:, j, None] - prefix[:, first:j] * self.powers[sizes]
            keys = mixed(keys + sizes.astype(np.uint64))
            place = np.searchsorted(self.keys, keys)
            place[place == len(self.keys)] = 0
            found = self.keys[place] == keys
            total = np.where(found, best[:, first:j] + self.scores[place], -np.inf)
            lone = np.where(found[:, -1], -np.inf, best[:, j - 1] + self.unknown)
            total[:, -1] = np.maximum(total[:, -1], lone)
            pick = np.argmax(total, axis=1)
            best[:, j] = total[row, pick]
            back[:, j] = first + pick
            known = found[row, pick]
            piece[:, j] = np.where(known, self.ids[place[row, pick]], -1 - chars[:, j - 1].astype(np.int64))
        at = np.full(n, length)
        out = np.zeros((n, length), dtype=np.int64)
        counts = np.zeros(n, dtype=np.int64)
        while True:
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            counts[live] += 1
            out[live, length - counts[live]] = piece[live, at[live]]
            at[live] = back[live, at[live]]
        used = np.arange(length) >= (length - counts)[:, None]
        return out[used], counts

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words; spaces are marks."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        chars = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), dtype=np.uint32)
        begins = np.cumsum(lengths) - lengths
        parts, where = [], []
        counts = np.zeros(len(words), dtype=np.int64)
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            step = max(1, CELLS // (max(length, 1) * min(max(length, 1), self.longest)))
            for first in range(0, len(rows), step):
                some = rows[first : first + step]
                ids, n = self._paths(chars[begins[some, None] + np.arange(length)].astype(np.uint64))
                counts[some] = n
                parts.append(ids)
                where.append(np.repeat(some, n))
        ids, owner = np.concatenate(parts), np.concatenate(where)
        ids = ids[np.argsort(owner, kind="stable")]
        owner = np.sort(owner)
        return self._with_bytes(ids, owner, len(words))

    def _with_bytes(self, ids: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        strange = np.flatnonzero(ids < 0)
        encoded = [chr(c).encode("utf-8", "replace") for c in (-1 - ids[strange]).tolist()]
        sizes = np.ones(len(ids), dtype=np.int64)
        sizes[strange] = [len(x) for x in encoded]
        ids, owner = np.repeat(ids, sizes), np.repeat(owner, sizes)
        ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
        return ids.astype(np.int32), np.bincount(owner, minlength=n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the n + 1 places between texts."""
        full = offsets[:-1][np.diff(offsets) > 0]
        data = np.insert(data, full, 32)
        offsets = offsets + np.searchsorted(full, offsets)
        begins = np.zeros(len(data) + 1, dtype=bool)
        if self.splits and len(data):
            space = data == 32
            begins[1:-1] = space[1:] & ~space[:-1]
        begins[offsets] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        ids, reach = self.words.ids(data, starts, np.append(starts[1:], len(data))[: len(starts)])
        return ids, reach[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids that lie between the bounds."""
        sizes = self.shown_at[ids + 1] - self.shown_at[ids]
        reach = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.shown[np.arange(reach[-1]) + np.repeat(self.shown_at[ids] - reach[:-1], sizes)].tobytes()
        ends = reach[bounds].tolist()
        return [raw[a:z].removeprefix(b" ").decode("utf-8", "replace") for a, z in zip(ends, ends[1:])]


def _applied(docs: DataFrame, added: list[tuple[str, T.DataType]], work) -> DataFrame:
    """``docs`` with columns that ``work(batch)`` returns; results replace columns of their name."""
    docs = docs.drop(*(name for name, _ in added))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in added)])
    arrow_batches(docs.sparkSession)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = work()
        for batch in source:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *run(batch)], names=[*batch.schema.names, *(n for n, _ in added)]
            )

    return docs.mapInArrow(batches, schema)


IDS = T.ArrayType(T.IntegerType())


def _encoded(pieces: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffer(column)
    parts, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    for a, z in slices(offsets):
        ids, bounds = pieces.encode(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
        parts.append(ids)
        counts.append(np.diff(bounds))
    return np.concatenate(parts), np.cumsum(np.concatenate(counts))


def _lists(ids: np.ndarray, bounds: np.ndarray, column: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)), pa.array(ids), mask=column.is_null() if column.null_count else None
    )


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in ``ids``."""
    path = path or vocabulary_file()

    def work():
        pieces = Pieces(path)
        return lambda batch: [_lists(*_encoded(pieces, batch.column("text")), batch.column("text"))]

    return _applied(docs, [("ids", IDS)], work)


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with the text of ``ids`` in ``decoded``."""
    path = path or vocabulary_file()

    def work():
        pieces = Pieces(path)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column("ids")
            counts = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
            texts = pieces.decode(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]))
            return [pa.array([t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist())], pa.string())]

        return run

    return _applied(docs, [("decoded", T.StringType())], work)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and the text decoded from them, in one pass of the workers."""
    path = path or vocabulary_file()

    def work():
        pieces = Pieces(path)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column("text")
            ids, bounds = _encoded(pieces, column)
            texts = pa.array([t if ok else None for t, ok in zip(pieces.decode(ids, bounds), column.is_valid().to_pylist())], pa.string())
            return [_lists(ids, bounds, column), texts]

        return run

    return _applied(docs, [("ids", IDS), ("decoded", T.StringType())], work)
