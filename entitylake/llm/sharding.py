"""Histogram sort into shards of equal bytes.

The key of a row is a list of integers. Its range is cut into bins; one
job counts exact rows and bytes of every bin (partial counts, so a bin as heavy as
a third of all rows is one row of each task). Bins that hold a wanted splitter
are cut again, by the next key once all their rows share one, until every
splitter lies on a bin edge within its tolerance or its bin cannot be divided.
Then the rows move once, to buckets that nest in shards, and are numbered there.

What reaches the driver and is broadcast are histograms: ``FAN_OUT`` bins in the first
round and ``PROBES`` for each open splitter later, whatever the rows. Buckets
follow ``spark.sql.shuffle.partitions``.

Rows: a null text has no bytes and a null key is the smallest one. Equal texts are
neighbours, so they share a shard unless a splitter falls among them. Rows equal in all
keys cannot be parted; documents have a row number, fixed as their keys are stored, as the last one. An empty table
gives no rows; other columns stay, but those named as results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import stored

FAN_OUT = 4096
PROBES = 64
LEAST = -(1 << 63)


@dataclass
class _Bin:
    interval: int
    place: int
    rows: int
    size: int
    low: tuple[int, ...]
    high: tuple[int, ...]
    rows_before: int = 0
    bytes_before: int = 0


@dataclass
class Splitters:
    """Rounds of bins, and per bucket its shard, first row and the shard's first row."""

    rounds: list[tuple[list[tuple[int, int, int, int]], list[tuple]]]
    buckets: list[tuple[int, int, int]]


def _place(keys: list[Column]) -> Column:
    """Bin of a row in its interval; exact, as 64-bit differences do not fit a long."""
    value = F.element_at(F.array(*keys), F.col("_level") + 1).cast("decimal(20,0)")
    return F.floor((value - F.col("_low")) / F.col("_width")).cast("int")


INTERVALS = "_interval int, _place int, _next int, _level int, _low decimal(20,0), _width decimal(20,0)"


def _first_interval(interval: tuple) -> dict[str, Column]:
    """The interval of all rows, which needs no lookup."""
    _, _, number, level, low, width = interval
    return {
        "_next": F.lit(number),
        "_level": F.lit(level),
        "_low": F.lit(low).cast("decimal(20,0)"),
        "_width": F.lit(width).cast("decimal(20,0)"),
    }


def _opened(df: DataFrame, keys: list[Column], intervals: list[tuple]) -> DataFrame:
    """Rows of the open intervals with their bin; intervals: parent, bin, id, level, low, width."""
    spark = df.sparkSession
    if len(intervals) == 1 and intervals[0][0] == -1:
        found = df.withColumns(_first_interval(intervals[0]))
    else:
        probes = spark.createDataFrame(intervals, INTERVALS)
        found = df.join(F.broadcast(probes), ["_interval", "_place"])
    return found.withColumn("_place", _place(keys)).withColumn("_interval", F.col("_next")).drop(
        "_next", "_level", "_low", "_width"
    )


def _probe(bins: list[_Bin], fan_out: int, number: int) -> list[tuple]:
    from decimal import Decimal

    probes = []
    for k, b in enumerate(bins):
        level = next((i for i, (low, high) in enumerate(zip(b.low, b.high)) if low != high), 0)
        width = -(-(b.high[level] - b.low[level] + 1) // fan_out)
        probes.append((b.interval, b.place, number + k, level, Decimal(b.low[level]), Decimal(width)))
    return probes


def find_splitters(
    rows: DataFrame, keys: list[str], size: str, shards: int, buckets: int, tolerance: float, loose: float
) -> Splitters | None:
    """Splitters of ``shards`` parts, within ``tolerance`` of a shard's bytes where keys allow,
    and of ``buckets`` parts that nest in them, within ``loose`` of a bucket's bytes."""
    columns = [F.coalesce(F.col(k).cast("long"), F.lit(LEAST)) for k in keys]
    thin = rows.select(*(c.alias(f"_k{i}") for i, c in enumerate(columns)), F.col(size).alias("_size"))
    n = len(keys)
    keys_of = [F.col(f"_k{i}") for i in range(n)]
    counted = [F.count(F.lit(1)), F.sum("_size"), *(f(k) for f in (F.min, F.max) for k in keys_of)]
    first = thin.agg(*counted).first()
    if not first[0]:
        return None
    root = _Bin(-1, 0, first[0], first[1], tuple(first[2 : 2 + n]), tuple(first[2 + n :]))
    total = root.size
    wanted = [(total * i / buckets, i % (buckets // shards) == 0) for i in range(1, buckets)]
    slack = {True: total / shards * tolerance, False: total / buckets * loose}
    cuts: dict[int, tuple[int, int]] = {}
    live, open_bins, rounds, number, fan_out = thin, [root], [], 0, FAN_OUT
    live = live.withColumn("_interval", F.lit(-1)).withColumn("_place", F.lit(0))
    while open_bins:
        probes = _probe(open_bins, fan_out, number)
        live = _opened(live, keys_of, probes)
        counts = live.groupBy("_interval", "_place").agg(*counted).collect()
        bins = sorted((_Bin(*r[:4], tuple(r[4 : 4 + n]), tuple(r[4 + n :])) for r in counts), key=lambda b: (b.interval, b.place))
        parents = {number + k: b for k, b in enumerate(open_bins)}
        number += len(open_bins)
        before: dict[int, tuple[int, int]] = {i: (p.rows_before, p.bytes_before) for i, p in parents.items()}
        for b in bins:
            b.rows_before, b.bytes_before = before[b.interval]
            before[b.interval] = (b.rows_before + b.rows, b.bytes_before + b.size)
        rounds.append((probes, bins))
        open_bins = _narrowed(bins, wanted, slack, cuts)
        fan_out = PROBES
    return _bucket_table(rounds, cuts, wanted, root)


def _narrowed(bins: list[_Bin], wanted, slack, cuts: dict[int, tuple[int, int]]) -> list[_Bin]:
    """Sets the cuts that these bins settle; returns the bins to be cut again."""
    again: dict[int, _Bin] = {}
    order = sorted(bins, key=lambda b: b.bytes_before)
    at = 0
    for i, (target, tight) in enumerate(wanted):
        if i in cuts:
            continue
        while at < len(order) - 1 and order[at].bytes_before + order[at].size < target:
            at += 1
        b = order[at]
        if not b.bytes_before <= target <= b.bytes_before + b.size:
            continue
        left, right = target - b.bytes_before, b.bytes_before + b.size - target
        if min(left, right) <= slack[tight] or b.low == b.high or b.rows == 1:
            cuts[i] = (
                (b.rows_before, b.bytes_before) if left <= right else (b.rows_before + b.rows, b.bytes_before + b.size)
            )
        else:
            again[id(b)] = b
    return list(again.values())


def _bucket_table(rounds, cuts, wanted, root) -> Splitters:
    """Buckets by first row; a bucket of no rows has no bin, so nothing goes there."""
    at = [0] + [cuts[i][0] for i in range(len(wanted))]
    at = list(accumulate(at, max))
    shard_of = [0] + list(accumulate(int(tight) for _, tight in wanted))
    first_of_shard: dict[int, int] = {}
    for row, shard in zip(at, shard_of):
        first_of_shard.setdefault(shard, row)
    return Splitters(rounds, [(shard_of[i], at[i], first_of_shard[shard_of[i]]) for i in range(len(at))])


def _assigned(df: DataFrame, keys: list[str], splitters: Splitters) -> DataFrame:
    """The rows with their bucket: a lookup for each round of bins."""
    from bisect import bisect_right

    spark = df.sparkSession
    firsts = [row for _, row, _ in splitters.buckets]
    columns = [F.coalesce(F.col(k).cast("long"), F.lit(LEAST)) for k in keys]
    out = df.withColumn("_interval", F.lit(-1)).withColumn("_place", F.lit(0)).withColumn("_bucket", F.lit(None).cast("int"))
    for probes, bins in splitters.rounds:
        if probes[0][0] == -1:
            out = out.withColumns(_first_interval(probes[0]))
        else:
            out = out.join(F.broadcast(spark.createDataFrame(probes, INTERVALS)), ["_interval", "_place"], "left")
        out = out.withColumn("_place", F.when(F.col("_next").isNotNull(), _place(columns)).otherwise(F.col("_place")))
        out = out.withColumn("_interval", F.coalesce("_next", "_interval")).drop("_next", "_level", "_low", "_width")
        found = spark.createDataFrame(
            [(b.interval, b.place, bisect_right(firsts, b.rows_before) - 1) for b in bins],
            "_interval int, _place int, _found int",
        )
        out = out.join(F.broadcast(found), ["_interval", "_place"], "left")
        out = out.withColumn("_bucket", F.coalesce("_found", "_bucket")).drop("_found")
    return out.drop("_interval", "_place")


def histogram_shards(
    rows: DataFrame,
    keys: list[str],
    size: str,
    shards: int,
    tolerance: float = 0.001,
    loose: float = 0.25,
    buckets: int | None = None,
) -> DataFrame:
    """``rows`` with ``shard`` (0 .. shards - 1, in key order) and ``slot`` (0, 1, .. in the shard).

    ``keys`` are integer columns, ``size`` the bytes of a row. The frame is read
    once for each round, so it should be a stored table with few columns, or cheap.
    """
    rows = rows.drop("shard", "slot")
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or shards * -(-parts // shards)
    splitters = find_splitters(rows, keys, size, shards, buckets, tolerance, loose)
    if splitters is None:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    starts = spark.createDataFrame(
        [(i, shard, row - first) for i, (shard, row, first) in enumerate(splitters.buckets)],
        "_bucket int, shard int, _start long",
    )
    placed = _assigned(rows, keys, splitters)
    others = [c for c in rows.columns if c not in keys]
    order = Window.partitionBy("_bucket").orderBy(*keys, *(c for c in others if c == size))
    return (
        placed.withColumn("slot", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(starts), "_bucket")
        .withColumn("slot", F.col("_start") + F.col("slot"))
        .select(*rows.columns, "shard", "slot")
    )


def document_keys(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, size, text_crc32, text_key, row_key): what sharding by text needs of the documents."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64("text").alias("text_key"),
            F.monotonically_increasing_id().alias("row_key"),
        )
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents in shards of equal bytes (text in UTF-8 plus 8 for each row)."""
    placed = histogram_shards(document_keys(docs), ["text_key", "doc_id", "row_key"], "size", shards)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
