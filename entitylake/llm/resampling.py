"""Importance resampling towards a target set, with features counted once for each different line.

A text is cut at newlines. No word crosses a newline, so the runs of words that lie in
one line depend on that line alone: its feature buckets are computed once for each different
line, and what they add to the corpus counts is multiplied by the line's occurrences. Runs that
cross a newline belong to their text and are added separately. Each bucket's gain follows
from its counts in the corpus and in the target set; a line's gain is again computed once
and joined to the texts that hold the line. A text's weight is the sum over its lines and
crossing runs, its score adds Gumbel noise seeded by its doc_id, and the highest scores are drawn.

Lines are counted map-side before they move. Lines that make up more than 1 in ``HOT_SHARE`` of all are at most
``HOT_SHARE`` and are sent to the executors, so no key of the shuffled join holds
more than that share. Ranks come from a range sort, not from one task. What reaches the driver are the
counts of the buckets.

Rows: a null text has no words, a weight of 0 and is never drawn; so has a text without
words. Equal rows are documents each and tie; a null doc_id is hashed as an empty one and ordered last. An empty
table of documents gives no rows, an empty target set has counts of 0. Columns other
than doc_id and text do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import let, stored
from entitylake.llm.decontamination import LOWER, UPPER, words_of
from entitylake.llm.ordering import ranked

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
HOT_SHARE = 10_000


def _lines(text: Column) -> Column:
    """A text's lines in lower case, without those that have no word."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, "\n", -1), lambda line: line.rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"))


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def line_buckets(words: Column, longest: int, buckets: int) -> Column:
    """Buckets of all runs of up to ``longest`` of the words, repeats included."""

    def runs(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - n)
        run = F.transform(starts, lambda i: _bucket(F.array_join(F.slice(w, i + 1, n), " "), buckets))
        return F.when(F.size(w) >= n, run).otherwise(F.array().cast("array<int>"))

    def all_runs(w: Column) -> Column:
        singles = F.transform(w, lambda x: _bucket(x, buckets))
        return F.concat(singles, *(runs(w, n) for n in range(2, longest + 1)))

    return let(words, all_runs)


def crossing_buckets(lines: Column, longest: int, buckets: int) -> Column:
    """Buckets of the runs of 2 to ``longest`` words that begin in one line and end in another."""
    none = F.array().cast("array<int>")
    if longest < 2:
        return none
    worded = F.transform(
        lines, lambda line, i: F.transform(words_of(line), lambda w: F.struct(w.alias("word"), i.alias("line")))
    )

    def runs(w: Column, n: int) -> Column:
        ends = F.filter(
            F.sequence(F.lit(n - 1), F.size(w) - 1),
            lambda i: F.get(w, i)["line"] != F.get(w, i - (n - 1))["line"],
        )
        run = F.transform(
            ends, lambda i: _bucket(F.array_join(F.transform(F.slice(w, i - n + 2, n), lambda x: x["word"]), " "), buckets)
        )
        return F.when(F.size(w) >= n, run).otherwise(none)

    return let(F.flatten(worded), lambda w: F.concat(*(runs(w, n) for n in range(2, longest + 1))))


def line_features(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Stored (key, occurrences, n_words, buckets): every different line, its features computed once."""
    lines = texts.select(F.explode(_lines(F.col("text"))).alias("line"))
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    words = words_of(F.col("line"))
    return stored(
        counted.select(
            _key(F.col("line")).alias("key"), "occurrences",
            F.size(words).cast("long").alias("n_words"), line_buckets(words, longest, buckets).alias("buckets"),
        )
    )


def bucket_counts(texts: DataFrame, lines: DataFrame, longest: int, buckets: int) -> list[int]:
    """Features of all texts in each bucket: those of lines times their occurrences, and the crossing ones."""
    inside = lines.select(F.explode("buckets").alias("bucket"), "occurrences")
    if longest > 1:
        crossing = crossing_buckets(_lines(F.col("text")), longest, buckets)
        inside = inside.unionByName(
            texts.select(F.explode(crossing).alias("bucket"), F.lit(1).cast("long").alias("occurrences"))
        )
    counts = [0] * buckets
    for row in inside.groupBy("bucket").agg(F.sum("occurrences").alias("n")).collect():
        counts[row.bucket] = row.n
    return counts


def gains(spark, corpus: list[int], target: list[int]) -> Column:
    """Gain of each bucket as an array of one literal: floor(1000 ln of the smoothed ratio of shares)."""
    buckets = len(corpus)
    s_all, t_all = sum(corpus) + buckets, sum(target) + buckets
    pairs = spark.createDataFrame(list(enumerate(zip(target, corpus, strict=True))), "bucket int, n struct<t: long, s: long>")
    above = (F.col("n.t") + 1).cast("double") * F.lit(float(s_all))
    below = (F.col("n.s") + 1).cast("double") * F.lit(float(t_all))
    rows = pairs.select("bucket", F.floor(F.log(above / below) * 1000).alias("gain")).collect()
    by_bucket = {row.bucket: row.gain for row in rows}
    # Folded to one constant array, instead of an expression for each bucket.
    return F.split(F.lit(",".join(str(by_bucket[b]) for b in range(buckets))), ",").cast("array<bigint>")


def _gain_sum(buckets: Column, gain: Column) -> Column:
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.get(gain, b))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-F.log(-F.log((h + 0.5) / 4294967296.0)) * 1000)


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Per row of ``docs`` (doc_id, n_words, n_features, weight)."""
    texts = docs.select("text")
    lines = line_features(texts, longest, buckets)
    wanted = target.select("text")
    gain = gains(
        docs.sparkSession,
        bucket_counts(texts, lines, longest, buckets),
        bucket_counts(wanted, line_features(wanted, longest, buckets), longest, buckets),
    )
    weighed = lines.select(
        "key", "occurrences", "n_words", F.size("buckets").cast("long").alias("n_features"), _gain_sum(F.col("buckets"), gain).alias("weight")
    )
    all_lines = lines.agg(F.sum("occurrences")).first()[0] or 0
    hot = F.col("occurrences") * HOT_SHARE > all_lines
    facts = ["n_words", "n_features", "weight"]

    held = _lines(F.col("text"))
    crossing = crossing_buckets(held, longest, buckets)
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
            F.transform(held, _key).alias("_keys"), crossing.alias("_crossing"),
        )
    )
    pairs = rows.select("_row", "doc_id", F.explode("_keys").alias("key"))
    often = F.broadcast(weighed.filter(hot).drop("occurrences").withColumn("_hot", F.lit(True)))
    first = pairs.join(often, "key", "left")
    zero = F.lit(0).cast("long")
    own = rows.select(
        "_row", "doc_id", zero.alias("n_words"), F.size("_crossing").cast("long").alias("n_features"),
        _gain_sum(F.col("_crossing"), gain).alias("weight"),
    )
    of_hot = first.filter("_hot").select("_row", "doc_id", *facts)
    of_rest = first.filter("_hot is null").select("_row", "doc_id", "key").join(weighed.filter(~hot), "key").select("_row", "doc_id", *facts)
    return (
        own.unionByName(of_hot).unionByName(of_rest)
        .groupBy("_row", "doc_id")
        .agg(*(F.sum(c).alias(c) for c in facts))
        .drop("_row")
    )


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS,
    seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): rank from 1 for the drawn ones, else null.

    Drawn are the highest scores among the texts of at least ``least_words`` words, ``percent`` per cent of them.
    """
    scored = stored(
        weights(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    )
    enough = F.col("n_words") >= least_words
    eligible = scored.filter(enough)
    quota = percent * eligible.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    in_order = ranked(eligible, order)
    drawn = in_order.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    return drawn.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


ORACLE = r"""
WITH crc_table AS (SELECT list(list_reduce([CAST(b AS UBIGINT)] || [CAST(k AS UBIGINT) FOR k IN range(8)],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY b) AS entries
  FROM range(256) AS r(b)),
worded AS (SELECT true AS corpus, row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT false, row_number() OVER (), item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
feature AS (SELECT corpus, row, unnest(w) AS word FROM worded),
hexed AS (SELECT word, hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM feature)),
crc AS (SELECT word, xor(list_reduce([CAST(4294967295 AS UBIGINT)]
    || [CAST('0x' || substr(bytes, CAST(2 * i + 1 AS INTEGER), 2) AS UBIGINT) FOR i IN range(len(bytes) // 2)],
    lambda c, b: xor(c >> 8, entries[CAST(xor(c, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 10000 AS bucket
  FROM hexed, crc_table),
counted AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM feature JOIN crc USING (word) GROUP BY bucket),
total AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counted),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counted, total),
weighed AS (SELECT row, CAST(count(*) AS BIGINT) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM feature JOIN crc USING (word) JOIN gain USING (bucket) WHERE corpus GROUP BY row),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) AS DOUBLE)
      + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (row) WHERE corpus),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place,
    10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS quota FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= quota THEN CAST(place AS BIGINT) END AS rank FROM placed
"""
