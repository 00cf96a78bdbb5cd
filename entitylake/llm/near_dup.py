"""Near-duplicates by word shingles: MinHash signatures joined within a Hamming distance.

1. Documents of equal shingle sets become one class; only classes go on.
2. A class has a signature of b-bit symbols, one per MinHash function, in chunks of
   ``CHUNK`` symbols. By the pigeonhole principle two signatures that differ in fewer than twice as many
   symbols as there are chunks agree in some chunk but for one symbol at most. So each chunk is
   sent under every key that leaves one of its symbols out, and all pairs under
   that distance meet. The number of chunks puts the expected distance of
   a pair at the threshold five standard deviations below (see ``plan``).
3. Small buckets give all their pairs. In a large one (near copies by the thousand) members
   meet its smallest one, the pivot; the buckets of copies mostly share theirs, so such pairs fold. Pairs
   within the distance are confirmed on full sets, first each class with its best partner, then
   only pairs whose ends are not yet connected. Members that their pivot leaves apart get another one,
   ``PIVOT_ROUNDS`` times in all.
4. What is exact for the large buckets: where members of a bucket are still in different components, the buckets
   that share members form clusters. A cluster is cut into chunks of ``CELL`` members, and
   each pair of chunks is a group in which full sets of different components are compared; it
   gives one link for each pair of components. Chunks of one component do not meet,
   so a group of copies of which all but a few are connected costs these few times its size.

Neither bucket nor component is gathered: counts and pivots combine map-side, components
are found by joins, and cells have two chunks of ``CELL`` members on average.

Rows: a null text or one without words has an empty set, is linked with nothing and is its own component; a text of
fewer words than a shingle is one shingle; a null doc_id takes part and is named
last, so a component of null ids only has a null name; repeated rows share class and fate. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import (
    LOWER, NOT_SPACE, arrow_batches, mixed, slices, small, span_hashes, spans, stored, stored_rows, text_buffer,
)
from entitylake.llm.components import components

CHUNK = 5
SMALL_BUCKET = 32
CELL = 256
PIVOT_ROUNDS = 2
_random = np.random.default_rng(5)
_WORD = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH = _random.integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Plan:
    """Words of a shingle, threshold in percent, chunks of the signature and the distance joined."""

    words: int
    percent: int
    chunks: int
    distance: int

    @property
    def symbols(self) -> int:
        return self.chunks * CHUNK


def plan(words: int, percent: int, chunks: int = 12) -> Plan:
    """Distance: that of a pair at the threshold plus six deviations. It is joined in full where it is under
    2 * chunks; a pair beyond still meets unless every chunk has two errors (at 85 % in 4e-10 of cases, at 80 % in 1e-7)."""
    n, miss = chunks * CHUNK, 1 - percent / 100
    return Plan(words, percent, chunks, math.ceil(n * miss + 6 * math.sqrt(n * miss * (1 - miss))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all texts, one text after the other, and the n + 1 bounds."""
    data = LOWER[data]
    starts, ends = spans(NOT_SPACE[data], offsets)
    hashes = span_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    parts, sizes = [], []
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled += hashes[k : k + len(rolled)] * _WORD[k]
    rolled = mixed(rolled)
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if z - a >= words:
            found = np.unique(rolled[a : z - words + 1])
        elif z > a:
            found = mixed(np.array([(hashes[a:z] * _WORD[32 : 32 + z - a]).sum() + np.uint64(z - a)], dtype=np.uint64))
        else:
            found = hashes[:0]
        parts.append(found)
        sizes.append(len(found))
    return np.concatenate([hashes[:0], *parts]), np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))]).astype(np.int64)


def signatures(shingles: np.ndarray, bounds: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols (16 bits) of each set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), symbols), dtype=np.uint16)
    if len(starts):
        for k in range(symbols):
            least = np.minimum.reduceat(shingles * _HASH[k], starts)
            out[:, k] = (mixed(least ^ _HASH[k]) >> np.uint64(48)).astype(np.uint16)
    return out


def _facts(batch: pa.RecordBatch, p: Plan) -> pa.RecordBatch:
    data, offsets = text_buffer(batch.column("text"))
    n = len(offsets) - 1
    counts, keys = np.zeros(n, dtype=np.int64), np.zeros((2, n), dtype=np.int64)
    marks: list[bytes | None] = [None] * n
    for a, z in slices(offsets):
        shingles, bounds = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], p.words)
        counts[a:z] = np.diff(bounds)
        full = a + np.flatnonzero(counts[a:z])
        if len(full):
            starts = bounds[:-1][np.diff(bounds) > 0]
            for k in range(2):
                keys[k, full] = np.add.reduceat(mixed(shingles ^ _WORD[40 + k]), starts).view(np.int64)
            for i, mark in zip(full.tolist(), signatures(shingles, bounds, p.symbols)):
                marks[i] = mark.tobytes()
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts), pa.array(keys[0]), pa.array(keys[1]), pa.array(marks, pa.binary())],
        names=["doc_id", "text_hash", "n_shingles", "a", "b", "mark"],
    )


def _chunk_keys(batch: pa.RecordBatch, p: Plan) -> pa.RecordBatch:
    """(key, node) for each chunk and each of its symbols left out."""
    nodes = batch.column("node").to_numpy()
    marks = np.frombuffer(b"".join(batch.column("mark").to_pylist()), dtype=np.uint16).reshape(len(nodes), p.symbols)
    keys = np.zeros((len(nodes), p.symbols), dtype=np.uint64)
    for k in range(p.symbols):
        first = k // CHUNK * CHUNK
        for i in range(first, first + CHUNK):
            if i != k:
                keys[:, k] += (marks[:, i].astype(np.uint64) + np.uint64(1)) * _HASH[256 + i]
        keys[:, k] = mixed(keys[:, k] + np.uint64(k))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(nodes, p.symbols))], names=["key", "node"]
    )


def _mapped(work, *arguments):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch, *arguments)

    return run


def _distances(left: pa.Array, right: pa.Array, p: Plan) -> np.ndarray:
    x, y = (
        np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint16).reshape(len(c), p.symbols) for c in (left, right)
    )
    return (x != y).sum(axis=1)


def _near(batch: pa.RecordBatch, p: Plan) -> pa.RecordBatch:
    distance = _distances(batch.column("mark_u"), batch.column("mark_v"), p)
    keep = distance <= p.distance
    return pa.RecordBatch.from_arrays(
        [batch.column(c).filter(pa.array(keep)) for c in ("u", "v")] + [pa.array(distance[keep].astype(np.int32))],
        names=["u", "v", "distance"],
    )


def _confirmed(batch: pa.RecordBatch, p: Plan) -> pa.RecordBatch:
    """Pairs whose sets reach the threshold, from both sets in full."""
    keep = []
    for x, y in zip(batch.column("set_u"), batch.column("set_v")):
        x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        if 100 * min(len(x), len(y)) < p.percent * max(len(x), len(y)):
            keep.append(False)
            continue
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep.append(100 * both >= p.percent * (len(x) + len(y) - both))
    return pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("u", "v")], names=["u", "v"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return (
        pairs.filter(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )


def _bucket_pairs(members: DataFrame) -> DataFrame:
    """All pairs of small buckets."""
    few = members.filter(F.col("size") <= SMALL_BUCKET)
    pairs = few.select("key", F.col("node").alias("u")).join(few.select("key", F.col("node").alias("v")), "key")
    return pairs.filter(F.col("u") < F.col("v")).select("u", "v")


def _pivot_pairs(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's pivot; the buckets of copies mostly share theirs."""
    return members.join(pivots, "key").groupBy(F.col("node").alias("u"), F.col("pivot").alias("v")).agg(F.count(F.lit(1))).select("u", "v")


def _apart(members: DataFrame, pivots: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node) of the members that are not in the component of their bucket's pivot."""
    named = comps.select("node", F.col("component").alias("cu"))
    of_pivots = (
        pivots.join(comps.select(F.col("node").alias("pivot"), "component"), "pivot", "left")
        .select("key", F.coalesce("component", "pivot").alias("cv"))
    )
    found = members.join(of_pivots, "key").join(named, "node", "left")
    return found.filter(F.coalesce("cu", "node") != F.col("cv")).select("key", "node")


def _with_marks(pairs: DataFrame, classes: DataFrame, p: Plan) -> DataFrame:
    marks = classes.select("node", "mark")
    return (
        pairs.join(marks.select(F.col("node").alias("u"), F.col("mark").alias("mark_u")), "u")
        .join(marks.select(F.col("node").alias("v"), F.col("mark").alias("mark_v")), "v")
        .mapInArrow(_mapped(_near, p), "u long, v long, distance int")
    )


def _chunks(rest: DataFrame) -> DataFrame:
    """rest (node, component, cluster, n_shingles) with the chunk of each node and the chunks it has to meet.

    A long text counts for as many as it has thousands of shingles. A component larger than a cell has chunks of its own, the others of a cluster share
    some; two chunks of one large component do not meet.
    """
    weight = 1 + F.col("n_shingles") / 1000
    sizes = rest.groupBy("cluster", "component").agg(F.sum(weight).alias("size"))
    sized = rest.join(sizes.withColumn("large", F.when(F.col("size") > CELL, F.col("component"))), ["cluster", "component"])
    # Nodes of small components are counted by cluster, those of a large one by itself.
    counts = sized.groupBy("cluster", "large").agg(F.sum(weight).alias("n"))
    parts = counts.select("cluster", "large", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    listed = parts.groupBy("cluster").agg(
        F.flatten(
            F.collect_list(
                F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.col("large").alias("large"), i.alias("part")))
            )
        ).alias("chunks")
    )
    part = F.pmod(F.xxhash64(F.coalesce("large", "component"), F.when(F.col("large").isNotNull(), F.col("node"))), F.col("parts"))
    own = F.struct(F.col("large"), part.cast("int").alias("part"))
    of_chunk = parts.select(F.col("cluster").alias("_cluster"), F.col("large").alias("_large"), "parts")
    placed = (
        sized.join(of_chunk, (F.col("cluster") == F.col("_cluster")) & F.col("large").eqNullSafe(F.col("_large")))
        .select("cluster", "node", "component", own.alias("own"))
        .join(listed, "cluster")
    )
    met = placed.select("cluster", "node", "component", "own", F.explode("chunks").alias("other"))
    return met.filter(~F.coalesce(F.col("own.large") == F.col("other.large"), F.lit(False)))


def _rows_of_sets(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of each element that two sets or more hold, and the sizes of the sets."""
    arrays = [np.frombuffer(x, dtype=np.uint64) for x in sets]
    sizes = np.array([len(x) for x in arrays])
    _, column, held = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    shared = held > 1
    keep = shared[column]
    return np.repeat(np.arange(len(sets)), sizes)[keep], (np.cumsum(shared) - 1)[column[keep]], sizes


def _linked_components(p: Plan):
    """Links between different components of a cell, one for each pair of components, from full sets."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").reset_index(drop=True)
        row, column, sizes = _rows_of_sets(group["set"].tolist())
        both = np.zeros((len(group), len(group)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = int(column[-1]) + 1 if len(column) else 0
        for first in range(0, width, 4096):
            a, z = np.searchsorted(column, [first, first + 4096])
            part = np.zeros((len(group), min(4096, width - first)), dtype=np.float32)
            part[row[a:z], column[a:z] - first] = 1
            both += part @ part.T
        comps, nodes = group["component"].to_numpy(), group["node"].to_numpy()
        linked = 100 * both.astype(np.float64) >= p.percent * (sizes[:, None] + sizes[None, :] - both)
        u, v = np.nonzero(linked & (comps[:, None] < comps[None, :]))
        found = pd.DataFrame({"u": nodes[u], "v": nodes[v], "cu": comps[u], "cv": comps[v]})
        return found.drop_duplicates(["cu", "cv"])[["u", "v"]]

    return compare


def _grid_links(rest: DataFrame, sets: DataFrame, p: Plan) -> DataFrame:
    """Links between components of a cluster; rest: node, component, cluster, n_shingles."""
    chunk = "concat_ws(':', {0}.large, {0}.part)"
    met = _chunks(rest).select(
        "cluster", "node", "component", F.expr(chunk.format("own")).alias("x"), F.expr(chunk.format("other")).alias("y")
    )
    cells = met.select("cluster", "node", "component", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    return (
        cells.join(sets, "node")
        .groupBy("cluster", "i", "j")
        .applyInPandas(_linked_components(p), "u long, v long")
    )


class _Confirmer:
    """Confirms pairs on full sets; each set is computed once, when its class first has a pair."""

    def __init__(self, docs: DataFrame, classes: DataFrame, p: Plan) -> None:
        self.docs, self.classes, self.p = docs, classes, p
        self.sets: DataFrame | None = None

    def add(self, pairs: DataFrame) -> None:
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("node"), "node", "left_anti")
        wanted, fits = stored_rows(nodes.join(self.classes, "node").select("node", F.col("sample.doc_id").alias("d"), F.col("sample.text_hash").alias("h")), 32)
        texts = self.docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
        found = texts.join(small(wanted, fits), "h").filter(F.col("doc_id").eqNullSafe(F.col("d")))
        p = self.p

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_buffer(batch.column("text"))
                for a, z in slices(offsets):
                    shingles, bounds = shingle_sets(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], p.words)
                    raw, ends = shingles.tobytes(), (bounds * 8).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").slice(a, z - a), pa.array([raw[s:e] for s, e in zip(ends, ends[1:])], pa.binary())],
                        names=["node", "set"],
                    )

        # Repeated rows give a class's sample twice.
        new = stored(found.select("node", "text").mapInArrow(sets, "node long, set binary"))
        self.sets = new if self.sets is None else self.sets.unionByName(new)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        return stored(
            pairs.select("u", "v")
            .join(self.sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), "u")
            .join(self.sets.select(F.col("node").alias("v"), F.col("set").alias("set_v")), "v")
            .mapInArrow(_mapped(_confirmed, self.p), "u long, v long")
        )


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components; a node without links is its own."""
    ends = pairs
    for end in ("u", "v"):
        named = comps.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(named, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return ends.filter(F.col("cu") != F.col("cv")).select(*pairs.columns)


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with more links. Components are stars already, so only what new links join takes further rounds."""
    stars = comps.filter(F.col("node") != F.col("component")).select(F.col("node").alias("u"), F.col("component").alias("v"))
    return stored(components(stars.unionByName(links.select("u", "v"))))


def class_components(docs: DataFrame, classes: DataFrame, p: Plan) -> DataFrame:
    """(node, component) of all classes that have a link."""
    keyed = classes.select("node", "mark").mapInArrow(_mapped(_chunk_keys, p), "key long, node long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("size")).filter(F.col("size") > 1)
    members = stored(keyed.join(sizes, "key"))
    large = members.filter(F.col("size") > SMALL_BUCKET).select("key", "node")
    pivots = stored(large.groupBy("key").agg(F.min("node").alias("pivot")))
    near = stored(_with_marks(_ordered(_bucket_pairs(members).unionByName(_pivot_pairs(large, pivots))), classes, p))
    confirmer = _Confirmer(docs, classes, p)
    confirmer.add(near)
    # Best partner: a close one of small number, so that copies of a text choose the same.
    step = max(1, p.symbols // 20)
    best = near.groupBy(F.col("v").alias("node")).agg(
        F.min(F.struct(F.floor(F.col("distance") / step).alias("d"), F.col("u").alias("partner"))).alias("best")
    )
    links = confirmer.confirm(best.select(F.col("best.partner").alias("u"), F.col("node").alias("v")))
    comps = stored(components(links))
    comps = _joined(comps, confirmer.confirm(_between(near, comps)))
    # Members that the first pivot leaves apart get another one, in their buckets only.
    open_members = large
    for _ in range(PIVOT_ROUNDS - 1):
        open_members = stored(_apart(open_members, pivots, comps))
        if open_members.isEmpty():
            break
        pivots = stored(open_members.groupBy("key").agg(F.min("node").alias("pivot")))
        near = stored(_with_marks(_between(_ordered(_pivot_pairs(open_members, pivots)), comps), classes, p))
        confirmer.add(near)
        comps = _joined(comps, confirmer.confirm(near))
    large = large.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parted = large.groupBy("key").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.min("node").alias("first")
    )
    rest = stored(large.join(parted.filter(F.col("x") != F.col("y")).select("key", "first"), "key"))
    if rest.isEmpty():
        return comps
    # Buckets that share a member are one cluster: its pairs are looked at once, whatever the buckets.
    clusters = components(rest.select(F.col("first").alias("u"), F.col("node").alias("v")).distinct())
    rest = stored(
        rest.select("node", "component")
        .distinct()
        .join(clusters.withColumnRenamed("component", "cluster"), "node")
        .join(classes.select("node", "n_shingles"), "node")
    )
    confirmer.add(rest.select(F.col("node").alias("u"), F.col("node").alias("v")))
    return _joined(comps, _grid_links(rest, confirmer.sets, p))


def near_duplicates(docs: DataFrame, p: Plan) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) of every row, as in ``chosen_rows``."""
    return chosen_rows(docs, p).drop("chosen")


def chosen_rows(docs: DataFrame, p: Plan) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, chosen) of every row of ``docs`` (doc_id, text);
    ``text_hash`` is ``xxhash64`` of the text, which with doc_id names the row. ``chosen`` is one name of each
    component, whatever ids repeat in it or are null; rows without words are their own."""
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, text_hash long, n_shingles long, a long, b long, mark binary"
    facts = stored(docs.withColumn("text_hash", F.xxhash64("text")).select("doc_id", "text_hash", "text").mapInArrow(_mapped(_facts, p), schema))
    alike = facts.filter(F.col("n_shingles") > 0)
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    grouped = alike.groupBy("a", "b", "n_shingles").agg(
        F.min(name).alias("first_name"),
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("sample"),
        F.min("mark").alias("mark"),
    )
    # The number is fixed by the write, and only the table is used from here on.
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()))
    comps = class_components(docs, classes.select("node", "sample", "mark", "n_shingles"), p)
    named = classes.select("a", "b", "n_shingles", "node", "first_id", "first_name").join(comps, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.min("first_name").alias("chosen_name"))
    known = named.join(firsts, "component").select("a", "b", "n_shingles", "component_id", "chosen_name")
    joined = facts.select("doc_id", "text_hash", "n_shingles", "a", "b").join(known, ["a", "b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    chosen = (F.col("n_shingles") == 0) | name.eqNullSafe(F.col("chosen_name"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", chosen.alias("chosen")
    )


ORACLE = r"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS row, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingle AS MATERIALIZED (SELECT DISTINCT row, array_to_string(w[s : s + least(len(w), 3) - 1], ' ') AS words
  FROM doc, range(1, greatest(len(w) - 2, 1) + 1) AS r(s) WHERE len(w) > 0),
size AS (SELECT row, count(*) AS n FROM shingle GROUP BY row),
pair AS (SELECT x.row AS u, y.row AS v, count(*) AS common FROM shingle x JOIN shingle y ON x.words = y.words AND x.row <> y.row GROUP BY 1, 2),
link AS MATERIALIZED (SELECT u, v FROM pair JOIN size a ON a.row = u JOIN size b ON b.row = v WHERE 100 * common >= 85 * (a.n + b.n - common)),
reach AS (SELECT row AS u, row AS v FROM doc UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v),
component AS (SELECT r.u AS row, min(d.doc_id) AS component_id FROM reach r JOIN doc d ON d.row = r.v GROUP BY r.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM doc LEFT JOIN size USING (row) JOIN component USING (row)
"""
