"""Shared folder, stored tables, input readers and Arrow text buffers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts are further cut into slices of ``SLICE_BYTES``.
BATCH_ROWS = 2000
SLICE_BYTES = 1 << 21

#: Tables up to this many bytes may be sent to every executor.
BROADCAST_BYTES = 32 << 20

#: Word bytes of the contracts: everything but space and \t..\r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20)
_BYTE_VALUE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, dtype=np.uint64)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors reach.

    Only a local session, whose executors are the driver, may leave it unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, sort: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The frame written as a table in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/table"
    (df.sortWithinPartitions(*sort) if sort else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(spark: SparkSession, *paths: str) -> None:
    """Empty tables take the place of those in ``paths``, which nothing reads any more."""
    for path in paths:
        spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind when they end; the session's setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored_rows(df: DataFrame, row_bytes: int) -> tuple[DataFrame, bool]:
    """As ``stored``, and whether the rows, at that many bytes each, may be broadcast."""
    table = stored(df)
    return table, table.count() * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, fits: bool) -> DataFrame:
    """Broadcast hint for a side whose size has been checked; else Spark shuffles."""
    return F.broadcast(df) if fits else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bounded Arrow batches for this session: few rows, and bytes where Spark can count them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def id_text_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array and the n + 1 offsets; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, last) document ranges of about ``limit`` bytes; a longer text is alone."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a document's end."""
    n = len(inside)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = inside[edge]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.full(max(n, 256), _BASE, dtype=np.uint64)
        _POWERS[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: a polynomial in random byte values, then mixed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    firsts = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    place -= np.repeat(firsts, lengths)
    source = place + np.repeat(starts, lengths)
    terms = _BYTE_VALUE[data[source]]
    terms *= _powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))
