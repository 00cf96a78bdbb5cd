"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Words are dealt in blocks. Blocks go to the sources by the highest quotients target / (2 s + 1), where s
is what a source has already, and a source's blocks go to its shards in the same way, with the
shard's words as votes; so every shard has an integer quota. The s-th highest quotients are not
drawn one by one: all but about one seat per unit follow from a divisor, the last ones from a
ranking of the next quotients.

A shard lays its documents in the order of a seeded hash and is cut into equal blocks. A quota of
whole passes takes all of them, the rest of it the blocks that come first by another seeded hash,
so a text is taken at most ``REPEATS`` times. The words of a block are of one text or of several,
and a text may be taken in part: ``passes`` and ``spans`` say which words.

A shard holds about ``SHARD_WORDS`` words whatever its source's size, so a hot source is many shards.
Rows that are equal in id and text are counted, numbered and spread over the shards. Ranks come from a range sort. Only
sources are broadcast, after a check of their bytes.

Rows: a null text or one without words has size 0 and is never taken; a null source is a source, after all others,
and a null id an id. Sources are in the order of code points. A
source without words has target 0. An empty table gives no rows. Columns other than doc_id, text and
source do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import small, stored, stored_rows
from entitylake.llm.ordering import ranked

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = 7
#: Words of a block at most; a source of mean size has at least ``LEAST_BLOCKS``.
BLOCK_WORDS = 256
LEAST_BLOCKS = 1000
SHARD_WORDS = 1 << 18
#: Equal rows numbered by one task.
COPIES = 4096


def sized(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, source, size, digest), a row for each of ``docs``."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return stored(docs.select("doc_id", "source", size.alias("size"), F.md5(F.col("text").cast("binary")).alias("digest")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, place, source_size, target): shares of all words by weight, at most ``repeats`` times a source's size.

    Sources reach their limit in the order of limit per weight: once the first of them are at
    it, the others share what is left by weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1).cast("long")
    limited = totals.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    by_limit = Window.orderBy((F.col("most") / F.col("weight")).asc(), "place")
    before, from_here = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    left = everything - F.coalesce(F.sum("most").over(before), F.lit(0))
    shares = limited.withColumn("left", left).withColumn("weights", F.sum("weight").over(from_here))
    # At its limit if the rest by weight would be more; so are all sources before it.
    at_limit = F.col("left") * F.col("weight") > F.col("most") * F.col("weights")
    last = F.max(F.when(at_limit, F.col("row"))).over(Window.partitionBy())
    shares = shares.withColumn("row", F.row_number().over(by_limit)).withColumn("last", F.coalesce(last, F.lit(0)))
    over = F.col("row") > F.col("last")
    rest = F.max(F.when(F.col("row") == F.col("last") + 1, F.struct("left", "weights"))).over(Window.partitionBy())
    share = (rest["left"] * F.col("weight")).cast("double") / rest["weights"]
    return shares.withColumn("share", share).select(
        "source", "place", "source_size", F.when(over, F.col("share")).otherwise(F.col("most").cast("double")).alias("target")
    )


def apportion(units: DataFrame, group: str, unit: str) -> DataFrame:
    """``units`` (group, unit, votes, seats) with ``quota``: seats by the highest quotients votes / (2 s + 1).

    ``seats`` is the number of a group's seats, on each of its rows. Equal quotients go to the lower unit.
    """
    known = units.groupBy(group).agg(
        F.sum("votes").alias("_votes"), F.count(F.lit(1)).alias("_units"), F.max("seats").alias("_seats")
    )
    table, fit = stored_rows(known, 48)
    joined = units.join(small(table, fit), group)
    # With this divisor the rounded seats are at most all, and at least all but one per unit.
    sure = F.col("_seats") - F.col("_units") / 2
    rounded = F.floor(F.col("votes") * sure / F.col("_votes") + 0.5) - 1
    base = F.when((sure > 0) & (F.col("_votes") > 0), F.greatest(rounded, F.lit(0))).otherwise(F.lit(0)).cast("long")
    share = F.when(F.col("_votes") > 0, F.col("votes") / F.col("_votes")).otherwise(F.lit(0.0))
    # No unit can get more of the last seats than this.
    more = F.least(F.ceil(share * F.col("_units")) + 4, F.col("_seats")).cast("int")
    started = stored(joined.withColumn("_base", base).withColumn("_more", more))
    nexts = started.filter((F.col("votes") > 0) & (F.col("_more") > 0)).select(
        group, unit, "votes", "_base", F.explode(F.sequence(F.lit(0), F.col("_more") - 1)).alias("_s")
    )
    quotient = F.col("votes") / (2 * (F.col("_base") + F.col("_s")) + 1)
    order = [F.col(group).asc_nulls_last(), F.col("_quotient").desc(), F.col(unit), F.col("_s")]
    places = ranked(nexts.withColumn("_quotient", quotient), order, "_rank")
    firsts = places.groupBy(group).agg((F.min("_rank") - 1).alias("_before"))
    given = started.groupBy(group).agg((F.max("_seats") - F.sum("_base")).alias("_open"))
    limits = firsts.join(given, group).select(F.col(group).alias("_group"), (F.col("_before") + F.col("_open")).alias("_last"))
    won = (
        places.join(small(limits, fit), places[group] == limits["_group"])
        .filter(F.col("_rank") <= F.col("_last"))
        .groupBy(group, unit)
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    return started.join(won, [group, unit], "left").select(
        *units.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota")
    )


def _named(sizes: DataFrame, seed: int) -> DataFrame:
    """A row for each document with words: equal ones are numbered, ``name`` is its seeded hash."""
    same = sizes.filter("size > 0").groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("copies"))
    numbers = lambda first, last: F.explode(F.sequence(first, last))
    copies = F.col("copies").cast("int")
    few = same.filter(F.col("copies") <= COPIES).withColumn("copy", numbers(F.lit(1), copies))
    parts = same.filter(F.col("copies") > COPIES).withColumn("part", numbers(F.lit(0), F.floor((copies - 1) / COPIES).cast("int")))
    first = F.col("part") * COPIES + 1
    many = parts.repartition("doc_id", "digest", "part").withColumn("copy", numbers(first, F.least(first + COPIES - 1, copies))).drop("part")
    known = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest", F.col("copy").cast("string"))
    return few.unionByName(many).drop("copies").withColumn("name", F.md5(known.cast("binary")))


def _first_bits(name: Column) -> Column:
    """32 bits of a hash in hexadecimal."""
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("long")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(doc_id, source, digest, size, source_size, target, shard, passes, spans) for each row of ``docs``.

    All of a text's words are taken ``passes`` times, and those of ``spans``, as (first, after the last) word, once more.
    """
    sizes = sized(docs)
    targets, fit = stored_rows(source_targets(sizes, weights, repeats), 64)
    words, sources = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    block = max(1, min(block_words, words // (LEAST_BLOCKS * max(sources, 1))))
    # Stored, as Spark would turn a join on a constant group into a nested loop.
    seats = stored(
        targets.select(F.lit(0).alias("all"), "place", F.col("target").alias("votes"), F.lit(int(words / block + 0.5)).cast("long").alias("seats"))
    )
    quotas = stored(apportion(seats, "all", "place").select("place", F.col("quota").alias("blocks")))
    shards_of = F.ceil(F.col("source_size") / shard_words).cast("long")
    facts = targets.join(quotas, "place").withColumn("shards", shards_of)

    by_source = lambda df: df["source"].eqNullSafe(facts["source"])
    named = _named(sizes, seed)
    placed = stored(
        named.join(small(facts, fit), by_source(named)).drop(facts["source"]).withColumn("shard", _first_bits(F.col("name")) % F.col("shards"))
    )
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("votes"), F.max("blocks").alias("seats"))
    dealt = apportion(shards, "place", "shard")

    # A shard is cut into equal blocks, and its quota is the nearest number of those.
    cut = F.ceil(F.col("votes") / block).cast("long")
    own = F.floor(F.col("quota") * block * F.col("cut") / F.col("votes") + 0.5).cast("long")
    numbers = F.sequence(F.lit(0).cast("long"), F.col("cut") - 1)
    block_name = lambda k: F.md5(F.concat_ws(":", F.lit(str(seed)), "place", "shard", k.cast("string")).cast("binary"))
    by_name = F.sort_array(F.transform(numbers, lambda k: F.struct(block_name(k).alias("name"), k.alias("k"))))
    chosen = F.transform(F.slice(by_name, F.lit(1), F.col("extra").cast("int")), lambda x: x["k"])
    # Stored, or the names would be hashed anew for every block.
    picked = stored(
        dealt.withColumn("cut", cut).withColumn("own", F.least(own, repeats * F.col("cut")))
        .withColumn("passes", F.floor(F.col("own") / F.col("cut"))).withColumn("extra", F.col("own") % F.col("cut"))
        .select("place", "shard", F.col("votes").alias("shard_words"), "cut", "passes", chosen.alias("_chosen"))
    )
    flags = F.transform(numbers, lambda k: F.array_contains("_chosen", k))
    plan = picked.select("place", "shard", "shard_words", "cut", "passes", flags.alias("chosen"))

    in_order = Window.partitionBy("place", "shard").orderBy("name")
    laid = placed.withColumn("start", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    block_of = lambda word: F.floor(((word + 1) * F.col("cut") - 1) / F.col("shard_words"))
    edge = lambda k: F.floor(k * F.col("shard_words") / F.col("cut"))
    end = F.col("start") + F.col("size")
    held = F.filter(F.sequence(block_of(F.col("start")), block_of(end - 1)), lambda k: F.get("chosen", k.cast("int")))
    spans = F.transform(
        held, lambda k: F.struct(
            (F.greatest(edge(k), F.col("start")) - F.col("start")).alias("first"),
            (F.least(edge(k + 1), end) - F.col("start")).alias("after"),
        )
    )
    columns = ["doc_id", "source", "digest", "size", "source_size", "target", "shard", "passes", "spans"]
    taken = laid.join(plan, ["place", "shard"]).withColumn("spans", spans).select(*columns)
    none = F.array().cast("array<struct<first: bigint, after: bigint>>")
    empty = sizes.filter("size = 0")
    untouched = empty.join(small(targets, fit), empty["source"].eqNullSafe(targets["source"])).select(
        "doc_id", empty["source"], "digest", "size", "source_size", "target",
        F.lit(None).cast("long").alias("shard"), F.lit(0).cast("long").alias("passes"), none.alias("spans"),
    )
    return taken.unionByName(untouched)


def words_taken() -> Column:
    """Words of a row of :func:`mix` in the mix, repeats counted."""
    return F.col("passes") * F.col("size") + F.aggregate(
        "spans", F.lit(0).cast("long"), lambda total, s: total + s["after"] - s["first"]
    )


ORACLE = r"""
WITH RECURSIVE doc AS (SELECT doc_id, source, md5(text) AS digest,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
    [5, 2, 1][CAST(place % 3 + 1 AS INTEGER)] AS weight FROM doc GROUP BY source),
-- Sources above their limit are fixed round by round.
fixed(step, places) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT step + 1, now FROM (
    SELECT step, places, (SELECT list(place ORDER BY place) FROM src, (SELECT
          (SELECT sum(source_size) FROM src) - coalesce(sum(3 * source_size) FILTER (list_contains(places, place)), 0) AS rest,
          sum(weight) FILTER (NOT list_contains(places, place)) AS weights FROM src) AS x
        WHERE list_contains(places, place) OR rest * weight > 3 * source_size * weights) AS now FROM fixed)
  WHERE len(now) > len(places)),
capped AS (SELECT places FROM fixed ORDER BY step DESC LIMIT 1),
rest AS (SELECT CAST((SELECT sum(source_size) FROM src) - coalesce(sum(3 * source_size) FILTER (list_contains(places, place)), 0) AS BIGINT) AS rest,
    CAST(sum(weight) FILTER (NOT list_contains(places, place)) AS BIGINT) AS weights FROM src, capped),
target AS (SELECT src.*, CASE WHEN list_contains(places, place) THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(rest * weight AS DOUBLE) / weights END AS target FROM src, capped, rest),
unit AS (SELECT greatest(1, least(256, sum(source_size) // (1000 * count(*)))) AS block, sum(source_size) AS words FROM src),
-- The seats, one by one by the highest quotient.
seat AS (SELECT place FROM (SELECT place, target / (2 * s + 1) AS quotient, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, place) AS won
    FROM target, unit, range(CAST(target // block AS BIGINT) + 3) AS r(s) WHERE target > 0), unit WHERE won <= floor(words / block + 0.5)),
blocks AS (SELECT place, count(seat.place) AS blocks FROM target LEFT JOIN seat USING (place) GROUP BY place),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, digest) AS copy FROM doc),
named AS (SELECT n.*, place, source_size, target, blocks, row_number() OVER () AS row,
    CASE WHEN size > 0 THEN md5(concat_ws(':', '7', coalesce(CAST(doc_id AS VARCHAR), ''), digest, CAST(copy AS VARCHAR))) END AS name,
    CAST('0x' || substr(name, 1, 8) AS BIGINT) % greatest(CAST(ceil(source_size / 262144) AS BIGINT), 1) AS shard
  FROM numbered n JOIN target t ON n.source IS NOT DISTINCT FROM t.source JOIN blocks USING (place)),
shard AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS votes, max(blocks) AS seats FROM named WHERE size > 0 GROUP BY place, shard),
shard_seat AS (SELECT place, shard FROM (SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY votes / (2 * s + 1) DESC, shard) AS won
    FROM shard, unit, range(CAST(3 * votes // block AS BIGINT) + 3) AS r(s)) WHERE won <= seats),
quota AS (SELECT s.place, s.shard, any_value(votes) AS votes, count(q.place) AS quota, CAST(ceil(any_value(votes) / any_value(block)) AS BIGINT) AS cut,
    least(CAST(floor(count(q.place) * any_value(block) * CAST(ceil(any_value(votes) / any_value(block)) AS BIGINT) / any_value(votes) + 0.5) AS BIGINT),
      3 * CAST(ceil(any_value(votes) / any_value(block)) AS BIGINT)) AS own
  FROM shard s CROSS JOIN unit LEFT JOIN shard_seat q ON q.place = s.place AND q.shard = s.shard GROUP BY s.place, s.shard),
piece AS (SELECT place, shard, k, (k * votes) // cut AS first, ((k + 1) * votes) // cut AS after, own // cut
    + CASE WHEN row_number() OVER (PARTITION BY place, shard ORDER BY md5(concat_ws(':', '7', place, shard, k)), k) <= own % cut THEN 1 ELSE 0 END AS times
  FROM quota, range(cut) AS r(k)),
laid AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY name ROWS UNBOUNDED PRECEDING) - size AS start FROM named WHERE size > 0),
taken AS (SELECT row, sum(times * greatest(least(after, start + size) - greatest(first, start), 0)) AS taken
  FROM laid JOIN piece USING (place, shard) GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM named LEFT JOIN taken USING (row)
"""
