"""Document quality by Bradley-Terry ranking of preference pairs.

A labelled good text is preferred to a labelled bad one of the training rows. Their scores are
linear in features of the text, and the weights minimise the mean logistic loss of score
differences. All labelled texts are fitted; where an id has several they all count, and repeated rows count once. The
texts of the rarer label are dealt to those of the other, ``ROUNDS`` times, so each labelled text takes part in many pairs
and none dominates. Differences of pairs are stored, and each Newton step adds up their gradient and curvature as
integers, which do not depend on how rows are dealt to tasks. Only such sums reach the driver, and
up to ``LABELLED`` texts of each label from which the steps start.

The threshold is a quantile of the training scores: as large a share of them lies below
as the share of bad labels. Scores are shifted and squashed so that ``THRESHOLD``, at which
a text is predicted good, is that quantile.

Rows: a null or empty text has the features of an empty text and a score like any; repeated rows are
scored each; a label that is null or joined to no document is left out, and with labels of one kind only
every text has the score 0.5; an empty table gives no rows. Extra columns are kept, but
those named as results are replaced. Labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.llm.common import (
    BROADCAST_BYTES, LOWER, NOT_SPACE, arrow_batches, id_text_crc, slices, small, span_hashes, spans, stored, stored_rows,
    text_buffer,
)
from entitylake.llm.ordering import ranked

LABELLED = 2_000
ROUNDS = 8
STEPS = 300
NEWTON_STEPS = 40
#: Bins of a histogram of scores, and scores of a bin that are looked at one by one.
BINS, FEW_SCORES = 1024, 5000
THRESHOLD = 0.3
RIDGE = 1e-3
#: Classes of bytes whose share of a text is a feature each.
CLASSES = (
    b"#*$%&|<>", b"|", b"!?", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b"@/\\_=+~^", b".,;:",
    b"\"'()[]{}", b"\n", bytes(range(128, 256)), bytes(set(range(32)) - {9, 10, 13}),
)
N_FEATURES = len(CLASSES) + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of bounded features for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out[:, -1] = np.log1p(sizes) / 10
    if not len(full):
        return out
    begins = offsets[:-1][full]
    for k, members in enumerate(CLASSES):
        is_member = np.zeros(256, dtype=np.int64)
        is_member[list(members)] = 1
        out[full, k] = np.sqrt(np.add.reduceat(is_member[data], begins) / sizes[full])
    starts, ends = spans(NOT_SPACE[data], offsets)
    bounds = np.searchsorted(starts, offsets)
    words = np.diff(bounds)
    hashes = span_hashes(LOWER[data], starts, ends)
    lengths = (ends - starts).astype(np.float64)
    owner = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    some = np.maximum(words, 1)
    first = data[starts] if len(starts) else data[:0]
    last = data[ends - 1] if len(ends) else data[:0]
    twice = np.zeros(len(hashes), dtype=bool)
    twice[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    letters = ((first | 32) >= 97) & ((first | 32) <= 122) | (first >= 128)
    closing = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    k = len(CLASSES)
    mean = np.bincount(owner, lengths, n) / some
    out[:, k] = np.minimum(mean, 40) / 10
    out[:, k + 1] = np.sqrt(np.minimum(np.bincount(owner, lengths**2, n) / some - mean**2, 400).clip(0)) / 10
    out[:, k + 2] = np.bincount(owner[order], fresh, n) / some
    out[:, k + 3] = np.bincount(owner, twice, n) / some
    out[:, k + 4] = np.bincount(owner, ~letters, n) / some
    out[:, k + 5] = np.bincount(owner, ~closing, n) / some
    out[:, k + 6] = np.bincount(owner, lengths > 20, n) / some
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, the threshold's raw score and the scale of scores."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Single precision, which adds up differently by batch, would move scores at the cut.
        return ((x - self.mean) / self.deviation * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; ``THRESHOLD`` at the cut."""
        odds = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.scale + odds, -50, 50)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float, seed: int = 8) -> Ranking:
    """Bradley-Terry weights by accelerated gradient steps on the pairs' logistic loss."""
    both = np.concatenate([good, bad])
    mean, deviation = both.mean(axis=0), both.std(axis=0) + 1e-3
    random = np.random.default_rng(seed)
    size = max(len(good), len(bad))
    pairs = [
        (np.resize(random.permutation(len(good)), size), np.resize(random.permutation(len(bad)), size))
        for _ in range(ROUNDS)
    ]
    winners, losers = (np.concatenate(x) for x in zip(*pairs))
    difference = (good[winners] - bad[losers]) / deviation
    rate = 4 / (np.linalg.norm(difference, axis=1) ** 2).mean()
    weights = ahead = np.zeros(good.shape[1])
    for step in range(STEPS):
        missed = 1 / (1 + np.exp(np.clip(difference @ ahead, -50, 50)))
        now = ahead + rate * (difference.T @ missed / len(difference) - RIDGE * ahead)
        ahead = now + step / (step + 3) * (now - weights)
        weights = now
    raw = ((both - mean) / deviation * weights).sum(axis=1)
    share = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(raw, kind="stable")
    place = min(int(np.searchsorted(np.cumsum(share[order]), bad_share * (1 - 1e-9))), len(raw) - 1)
    following = min(place + 1, len(raw) - 1)
    cut = float(raw[order[place]] + raw[order[following]]) / 2
    spread = max(float(np.std(raw)), 1e-6)
    return Ranking(mean, deviation, weights, cut, spread / 2)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for a, z in slices(offsets):
            x = features(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.reshape(-1)))
            names = [batch.column(n).slice(a, z - a) for n in ("_id", "_hash", "quality")]
            yield pa.RecordBatch.from_arrays([*names, lists], names=["_id", "_hash", "quality", "x"])


def _lists(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)


def _sums(rows: DataFrame, terms, scale: int) -> np.ndarray:
    """Sums over the ``x`` of all rows of what ``terms`` gives for each, exact to the rounding of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = np.rint(terms(_lists(batch)) * float(1 << scale)).astype(np.int64).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["k", "v"])

    added = rows.select("x").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return np.array([float(r["v"]) for r in added.orderBy("k").collect()]) / (1 << scale)


def _products(x: np.ndarray) -> np.ndarray:
    return (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)


def _pairs(rows: DataFrame, n: dict[int, int], deviation: np.ndarray, seed: int = 8) -> DataFrame:
    """Stored ``x``: standardised differences of a good and a bad text, for ``ROUNDS`` partners of each text of the more frequent label."""
    more = int(n[1] >= n[0])
    fewer = n[1 - more]
    place = F.when(F.col("quality") == 1, F.col("rank") - 1 - n[0]).otherwise(F.col("rank") - 1)
    placed = rows.withColumn("place", place)
    moves = F.array(*(F.lit(int(m)) for m in np.random.default_rng(seed).integers(0, fewer, ROUNDS)))
    many = placed.filter(F.col("quality") == more).select(
        F.col("x").alias("mine"), F.explode(F.transform(moves, lambda m: F.pmod(F.col("place") + m, F.lit(fewer)))).alias("place")
    )
    few = placed.filter(F.col("quality") != more).select("place", F.col("x").alias("others"))
    joined = many.join(small(few, fewer * 8 * (N_FEATURES + 2) <= BROADCAST_BYTES), "place")
    good, bad = ("mine", "others") if more else ("others", "mine")
    scaled = F.array(*(F.lit(float(d)) for d in deviation))
    return stored(joined.select(F.zip_with(F.zip_with(good, bad, lambda g, b: g - b), scaled, lambda d, s: d / s).alias("x")))


def _newton(pairs: DataFrame, n: int, weights: np.ndarray) -> np.ndarray:
    """The weights of least mean logistic loss over all pairs."""
    features_ = len(weights)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def terms(x: np.ndarray) -> np.ndarray:
            z = np.clip((x * w).sum(axis=1), -50, 50)
            missed = 1 / (1 + np.exp(z))
            loss = np.log1p(np.exp(-z))
            return np.concatenate([loss[:, None], x * missed[:, None], _products(x) * (missed * (1 - missed))[:, None]], axis=1)

        sums = _sums(pairs, terms, 28) / n
        gradient = sums[1 : 1 + features_] - RIDGE * w
        curvature = sums[1 + features_ :].reshape(features_, features_) + RIDGE * np.eye(features_)
        return float(sums[0]) + RIDGE / 2 * float(w @ w), gradient, curvature

    loss, gradient, curvature = at(weights)
    step = np.linalg.solve(curvature, gradient)
    for _ in range(NEWTON_STEPS):
        if np.abs(step).max() < 1e-6:
            break
        there = at(weights + step)
        if there[0] > loss + 1e-9:
            step = step / 2
            continue
        weights = weights + step
        loss, gradient, curvature = there
        step = np.linalg.solve(curvature, gradient)
    return weights


def _cut(rows: DataFrame, raw, n: dict[int, int], bad_share: float) -> float:
    """Between the quantile ``bad_share`` of all raw scores, each label weighing its share, and the next higher one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(raw(_lists(batch))), batch.column("quality")], names=["raw", "quality"])

    scores = rows.select("x", "quality").mapInArrow(run, "raw double, quality int")
    weight = {0: bad_share / n[0], 1: (1 - bad_share) / n[1]}
    wanted, below = bad_share * (1 - 1e-9), 0.0
    low, high = scores.agg(F.min("raw"), F.max("raw")).first()
    top = high
    inside, count = scores, sum(n.values())
    while count > FEW_SCORES and low < high:
        # The bin is found from the score alone, so that a score is in the same bin wherever it is counted.
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col("raw") - low) / width), F.lit(BINS - 1)).cast("int")
        bins = inside.groupBy(bin_.alias("bin")).agg(
            F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"),
            F.min("raw").alias("low"), F.max("raw").alias("high"),
        ).orderBy("bin").collect()
        for row in bins:
            held = row["bad"] * weight[0] + row["good"] * weight[1]
            if below + held >= wanted or row is bins[-1]:
                break
            below += held
        low, high, count = row["low"], row["high"], row["bad"] + row["good"]
        inside = scores.filter(F.col("raw").between(low, high))
    each = inside.groupBy("raw").agg(
        F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good")
    ).orderBy("raw").collect()
    for row in each:
        below += row["bad"] * weight[0] + row["good"] * weight[1]
        if below >= wanted:
            break
    found = row["raw"]
    following = scores.filter(F.col("raw") > found).agg(F.min("raw")).first()[0] if found < top else found
    return (found + following) / 2


def labelled_features(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Stored features ``x`` of all different labelled texts, ranked by label and then by hash."""
    known, fits = stored_rows(known.select(F.col("doc_id").alias("_id"), "quality").distinct(), 12)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(small(known, fits), "_id")
    texts = texts.withColumn("_hash", F.xxhash64("text")).select("_id", "_hash", "quality", "text")
    found = texts.mapInArrow(_feature_rows, "_id long, _hash long, quality int, x array<double>")
    rows = found.groupBy("_id", "_hash", "quality").agg(F.first("x").alias("x"))
    return ranked(rows, [F.col("quality"), F.xxhash64("_id", "_hash", F.lit("text")), F.col("_id"), F.col("_hash")])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Ranking | None:
    """The ranking of the labelled rows of ``docs``; None unless both labels occur.

    Its weights and its threshold are those of all labelled texts. Up to ``labelled`` of each label, and no more than
    there are ids, reach the driver as features, for weights to start from.
    """
    arrow_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )
    known = known.filter(id_text_crc() % 5 != 0)
    counts = {row["quality"]: row["count"] for row in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    rows = labelled_features(docs, known)
    found = rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("ids")).collect()
    n, ids = {r["quality"]: r["n"] for r in found}, {r["quality"]: r["ids"] for r in found}
    if len(n) < 2:
        return None
    total = n[0] + n[1]
    first = F.when(F.col("quality") == 0, F.col("rank") <= min(labelled, ids[0])).otherwise(F.col("rank") <= n[0] + min(labelled, ids[1]))
    some = rows.filter(first).orderBy("rank").select("quality", "x").collect()
    x = {q: np.array([r["x"] for r in some if r["quality"] == q]) for q in (0, 1)}
    bad_share = counts[0] / (counts[0] + counts[1])
    start = fit_pairs(x[1], x[0], bad_share)
    mean = _sums(rows, lambda v: v, 32) / total
    products = _sums(rows, lambda v: _products(v - mean), 32).reshape(N_FEATURES, N_FEATURES) / total
    deviation = np.sqrt(np.diag(products).clip(0)) + 1e-3
    weights = np.zeros(N_FEATURES) if start is None else start.weights / start.deviation * deviation
    weights = _newton(_pairs(rows, n, deviation), ROUNDS * max(n.values()), weights)
    unit = weights / deviation
    spread = max(float(np.sqrt(max(unit @ products @ unit, 0.0))), 1e-6)
    cut = _cut(rows, Ranking(mean, deviation, weights, 0.0, 1.0).raw, n, bad_share)
    return Ranking(mean, deviation, weights, cut, spread / 2)


def score(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    if ranking is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})
    arrow_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            data, offsets = text_buffer(batch.column("text"))
            parts = [np.zeros(0)]
            for a, z in slices(offsets):
                parts.append(ranking.score(features(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(parts))], names=[*batch.schema.names, "score"]
            )

    scored = docs.mapInArrow(batches, schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
