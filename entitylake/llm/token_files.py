"""Token ids in files of patched frame-of-reference blocks.

A file holds blocks of ``BLOCK`` ids. A block stores its smallest id, and all ids
less that one in as many bits as ``PERCENTILE`` of them need; ids that need more keep their low bits there and
their high bits in the block's exception list. The index at the end has the
byte where each block starts, so any range of ids is read without the rest, and the
documents' ids and lengths.

Documents are dealt by ranges of doc_id, sorted, encoded and written by the task that
holds the range, under the name of the attempt and then renamed; file order is document order. Only the
list of files is looked at as a whole. Texts are encoded in pieces that end before a
single space or an ASCII punctuation mark behind a letter or digit, where the tokenizer's pattern always starts
a new word, and equal pieces once.

Rows: a null text is empty and has the end id only; a null doc_id comes first; repeated
ids are documents each, in the order of their texts; an empty table writes no file. Other columns do not matter.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from string import ascii_letters, digits

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import arrow_batches, shared_folder, slices, text_buffer
from entitylake.llm.span_cache import SpanCache

BLOCK = 512
PERCENTILE = 0.9
FILE_IDS = 32 << 20
CHUNK_BLOCKS = 512
END_ID = 2
MAGIC = b"PFORIDS1"
FILES = "task int, part int, file string, n_docs long, n_ids long, stored_bytes long"


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Encoding

ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[np.frombuffer(f"{digits}{ascii_letters}".encode(), dtype=np.uint8)] = True


def _marks(added: list[str]) -> np.ndarray:
    """The ASCII punctuation marks, but those that follow a letter or digit inside an added token, which must stay whole."""
    marks = np.zeros(256, dtype=bool)
    marks[33:127] = True
    marks &= ~ALPHANUMERIC
    for token in added:
        raw = np.frombuffer(token.encode(), dtype=np.uint8)
        marks[raw[1:][ALPHANUMERIC[raw[:-1]]]] = False
    return marks


def _piece_starts(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Starts of the pieces: documents, single spaces between visible characters, and marks behind letters or digits.

    A neighbour counts as visible if it is ASCII or of two bytes from U+00C0 on, where no space is.
    """
    n = len(data)
    starts = np.zeros(n + 1, dtype=bool)
    if n > 2:
        visible = (data > 32) & (data < 127)
        two = (data[1:] & 0xC0 == 0x80) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        before, after = visible.copy(), visible | ((data >= 0xC3) & (data < 0xE0))
        before[1:] |= two
        starts[1 : n - 1] = (data[1:-1] == 32) & before[:-2] & after[2:]
        starts[1:n] |= marks[data[1:]] & ALPHANUMERIC[data[:-1]]
    starts[offsets] = True
    starts[n] = False
    return np.flatnonzero(starts)


class Encoder:
    """Ids of texts by the tokenizer; equal pieces are encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = _marks([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.pieces = SpanCache(self._encode)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum())), lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end id, and their counts."""
        starts = _piece_starts(data, offsets, self.marks)
        ids, reach = self.pieces.ids(data, starts, np.append(starts[1:], len(data))[: len(starts)])
        bounds = reach[np.searchsorted(starts, offsets)]
        return np.insert(ids, bounds[1:], end_id), np.diff(bounds) + 1


@cache
def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which goes on from task to task."""
    return Encoder(path)


# Blocks


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The ids in blocks of ``BLOCK``; the last may be shorter."""
    whole = len(ids) // BLOCK * BLOCK
    blocks = _pack_equal(ids[:whole].reshape(-1, BLOCK), percentile) if whole else []
    return blocks + (_pack_equal(ids[None, whole:], percentile) if len(ids) > whole else [])


def _bits(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1]


def _pack_equal(ids: np.ndarray, percentile: float) -> list[bytes]:
    n = ids.shape[1]
    least = ids.min(axis=1)
    rest = ids - least[:, None]
    rank = min(n - 1, max(0, int(np.ceil(n * percentile)) - 1))
    widths = _bits(np.partition(rest, rank, axis=1)[:, rank])
    out: list[bytes] = [b""] * len(ids)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        values = rest[rows]
        low = values & np.uint32((1 << width) - 1)
        bits = (low[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        high = values >> np.uint32(width) if width < 32 else np.zeros_like(values)
        for k, row in enumerate(rows.tolist()):
            places = np.flatnonzero(high[k])
            head = struct.pack("<IBHH", int(least[row]), width, n, len(places))
            out[row] = head + packed[k].tobytes() + places.astype("<u2").tobytes() + high[k][places].astype("<u4").tobytes()
    return out


def unpack(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Ids of the block at a byte, and the byte behind it."""
    least, width, n, exceptions = struct.unpack_from("<IBHH", data, at)
    at += 9
    size = -(-n * width // 8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little")
    at += size
    ids = bits.reshape(n, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))
    places = np.frombuffer(data, "<u2", exceptions, at)
    at += 2 * exceptions
    ids[places] += np.frombuffer(data, "<u4", exceptions, at) << np.uint32(width)
    return ids + np.uint32(least), at + 4 * exceptions


class Writer:
    """One file; ``add`` takes documents in order."""

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.fs, self.path = fs, path
        self.attempt = f"{path}.{uuid.uuid4().hex}.part"
        self.out = fs.open_output_stream(self.attempt, compression=None)
        self.out.write(MAGIC)
        self.starts: list[int] = []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.rest = np.zeros(0, dtype=np.uint32)
        self.n_ids = self.n_docs = 0
        self.size = len(MAGIC)

    def add(self, doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, valid.astype(np.int64)]))
        self.counts.append(counts)
        self.n_docs, self.n_ids = self.n_docs + len(counts), self.n_ids + len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        self._put(self.rest[:whole])
        self.rest = self.rest[whole:]

    def _put(self, ids: np.ndarray) -> None:
        for block in pack(ids):
            self.starts.append(self.size)
            self.out.write(block)
            self.size += len(block)

    def close(self) -> int:
        self._put(self.rest)
        docs = np.concatenate(self.docs, axis=1)
        parts = [np.array(self.starts, "<i8"), docs[0].astype("<i8"), docs[1].astype("<i1"), np.concatenate(self.counts).astype("<i8")]
        for part in parts:
            self.out.write(part.tobytes())
        self.out.write(struct.pack("<QQQQ", self.size, len(self.starts), self.n_docs, self.n_ids) + MAGIC)
        size = self.out.tell()
        self.out.close()
        self.fs.move(self.attempt, self.path)
        return size


class Reader:
    """Random access to a file's ids through its index."""

    FOOT = 32 + len(MAGIC)

    def __init__(self, fs: pafs.FileSystem, path: str) -> None:
        self.source = fs.open_input_file(path)
        size = self.source.size()
        foot = self.source.read_at(self.FOOT, size - self.FOOT)
        if foot[32:] != MAGIC or self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.index_at, blocks, n_docs, self.n_ids = struct.unpack("<QQQQ", foot[:32])
        index = self.source.read_at(size - self.FOOT - self.index_at, self.index_at)
        if len(index) != blocks * 8 + n_docs * 17:
            raise ValueError(f"{path} has a broken index")
        self.starts = np.append(np.frombuffer(index, "<i8", blocks), self.index_at)
        self.doc_ids = np.frombuffer(index, "<i8", n_docs, blocks * 8)
        self.valid = np.frombuffer(index, "<i1", n_docs, blocks * 8 + n_docs * 8).astype(bool)
        self.counts = np.frombuffer(index, "<i8", n_docs, blocks * 8 + n_docs * 9)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` .. ``last`` - 1 of the file; only their blocks are read."""
        if last <= first:
            return np.zeros(0, dtype=np.uint32)
        low, high = first // BLOCK, (last - 1) // BLOCK
        begin = int(self.starts[low])
        data = self.source.read_at(int(self.starts[high + 1]) - begin, begin)
        blocks, at = [], 0
        while at < len(data):
            block, at = unpack(data, at)
            blocks.append(block)
        return np.concatenate(blocks)[first - low * BLOCK : last - low * BLOCK]

    def chunks(self) -> Iterator[np.ndarray]:
        step = CHUNK_BLOCKS * BLOCK
        for first in range(0, self.n_ids, step):
            yield self.ids(first, min(self.n_ids, first + step))

    def close(self) -> None:
        self.source.close()


# Jobs


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents; returns the stored list of files with ``first``, the ids before each."""
    spark = docs.sparkSession
    arrow_batches(spark)
    path = tokenizer or public_tokenizer()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        encode, writer, part, done = encoder(path).encode, None, 0, []
        task = TaskContext.get().partitionId()

        def close() -> None:
            done.append((task, part, os.path.basename(writer.path), writer.n_docs, writer.n_ids, writer.close()))

        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            doc_ids = batch.column("doc_id")
            valid = np.asarray(doc_ids.is_valid())
            numbers = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            for a, z in slices(offsets):
                if writer is not None and writer.n_ids >= FILE_IDS:
                    close()
                    writer, part = None, part + 1
                writer = writer or Writer(fs, f"{base}/ids-{task:06d}-{part:04d}.pfor")
                ids, counts = encode(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], end_id)
                writer.add(numbers[a:z], valid[a:z], counts, ids)
        if writer is not None:
            close()
        if done:
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ("task", "part", "file", "n_docs", "n_ids", "stored_bytes")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    listed = f"{folder}-list"
    ordered.mapInArrow(files, FILES).write.parquet(listed)
    in_order = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    found = spark.read.schema(FILES).parquet(listed)
    return found.withColumn("first", F.coalesce(F.sum("n_ids").over(in_order), F.lit(0)))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files: (doc_id, start, n_tokens, ids_crc32)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist()):
                reader = Reader(fs, f"{base}/{name}")
                ends = np.cumsum(reader.counts)
                crcs = np.zeros(len(ends), dtype=np.int64)
                doc, at = 0, 0
                for ids in reader.chunks():
                    raw = memoryview(ids.astype("<u4").tobytes())
                    stop = at + len(ids)
                    place = at
                    while place < stop:
                        end = min(stop, int(ends[doc]))
                        crcs[doc] = zlib.crc32(raw[(place - at) * 4 : (end - at) * 4], int(crcs[doc]))
                        place = end
                        doc += int(place == ends[doc])
                    at = stop
                if at != reader.n_ids or doc != len(ends):
                    raise ValueError(f"{name} does not hold the ids that its index tells")
                columns = [
                    pa.array(reader.doc_ids, mask=~reader.valid),
                    pa.array(first + ends - reader.counts),
                    pa.array(reader.counts),
                    pa.array(crcs),
                ]
                reader.close()
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "first").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """All documents written to token files (in a new shared folder by default) and read back."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/ids"
    files = write_token_files(docs, folder, tokenizer)
    tasks = max(1, min(files.count(), 10_000))
    return read_token_files(files.repartition(tasks), folder)
