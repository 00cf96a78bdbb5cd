"""Similarity join: all pairs of texts whose ratio reaches a threshold.

The join is exact. Only distinct texts are compared; keys are joined back at the end. Each pair meets once, in the
band of its lengths, whose cells are different tasks:

1. pairs of texts of up to ``PAIR_KEYS_LENGTH`` are sorted out in blocks by length and a bit vector of the
   characters, and the rest is measured exactly (``short_texts``),
2. pairs with a longer text by length and bigrams, a text against all those of a cell at once (``long_texts``).

Of two tables the left one, which should be the smaller, is copied to the bands where a match can be. A text of the right
one goes to its own band once, if the left one has a text of about a length that it can match, and not at all otherwise.

With ``hot_rows``, and in the stored index, short texts meet under their tokens instead. With ``s`` the summed lengths
of two texts that match at threshold ``t``, they share at least
``s * (3t - 200) / 200 - 1`` bigrams and ``s * t / 200`` characters (the n-th
occurrence of a gram counts as a token of its own). So:

1. the tokens of a text are put in one global order, rarest first by their number
   of texts; two matching texts must then share one of their first few tokens,
   and that token is the equi-join key,
2. a token many texts hold ("hot") never is a key alone: because everything
   after it in the order is hot too, a matching pair also shares a second hot
   token, and the key is the pair of both. This splits the large groups,
3. a pair that meets under several keys is kept under one of them only, so no
   shuffle is needed to remove duplicates,
4. length, a bit vector of the characters, then bounded Levenshtein distance
   (none of them ever above the insert/delete distance) sort out pairs before
   the exact ratio decides; the distance is measured under that one key only.

Texts too short for shared bigrams to be certain go through the same steps
with single characters as tokens. Keys that still have many texts are cut into
cells that are joined in different tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions.similarity import (
    bind,
    code_points,
    indel_distance,
    match_string,
    ratio_of_distance,
)
from entitylake.operators.hot_keys import CHUNK_ROWS, hot_grid, with_cells
from entitylake.operators.long_texts import MATCHES, match_groups
from entitylake.operators.short_texts import match_cells

# A token held by more texts than this counts as hot.
HOT_ROWS = 2000

# Texts up to this length meet under pairs of hot tokens, whose number grows with
# the square of the length; pairs with a longer text meet in bands of lengths.
PAIR_KEYS_LENGTH = 64

# Rows of a chunk of a length band, at least, and chunks that a band is cut into if it has the rows.
BAND_ROWS = 250
BAND_CHUNKS = 8

# Short texts are compared so quickly that their chunks hold that many times the rows.
SHORT_CHUNKS = 4

# Chunks of texts up to ``WIDE_CHARS`` hold that many times the rows where the other side has a quarter of a chunk at most.
WIDE_CHUNKS = 4
WIDE_CHARS = 1024

# Finer bands, by which texts without a partner of their length are left out.
BAND_PARTS = 8

# Partitions of the comparing stage, as a multiple of the shuffle partitions.
TASKS_PER_PARTITION = 4

# Keys of one text that are listed in one row when pairs of texts become pairs of keys.
CHUNK_KEYS = 500

_EPSILON = 1e-9  # keeps rounded-up bounds on the safe (lower) side


@dataclass(frozen=True)
class _Bounds:
    """What a threshold implies for lengths and shared tokens."""

    threshold: float

    def __post_init__(self) -> None:
        if not 0 < self.threshold <= 100:
            raise ValueError("threshold must lie in (0, 100]")

    @property
    def shortest_bigram_sum(self) -> float:
        """Summed length above which a shared bigram is certain."""
        slope = 3 * self.threshold - 200
        return floor(200 / slope + _EPSILON) if slope > _EPSILON else float("inf")

    def max_distance(self, total: Column) -> Column:
        """Largest insert/delete distance of a match; like any such distance, odd only if the total is."""
        most = F.floor(total * ((100 - self.threshold) / 100) + _EPSILON).cast("int")
        return most - (most + total) % 2

    def shortest_sum(self, length: Column) -> Column:
        """Smallest summed length a matching pair with this text can have."""
        partner = F.ceil(length * (self.threshold / (200 - self.threshold)) - _EPSILON)
        return length + F.greatest(partner, F.lit(1))

    def longest_partner(self, length: Column) -> Column:
        return F.floor(length * ((200 - self.threshold) / self.threshold) + _EPSILON)

    def band(self, length: Column, parts: int = 1) -> Column:
        """Number of a length's band, or of its finer one; a matching partner is in the same or the next band,
        at most ``parts`` finer ones away.

        Never null, as a null check below a distinct would make its shuffle another one than the next use's.
        """
        width = (log((200 - self.threshold) / self.threshold) + 1e-6) / parts
        return F.coalesce(F.floor(F.log(F.greatest(length, F.lit(1))) / width).cast("int"), F.lit(0))

    def bigrams_shared(self, total: Column) -> Column:
        """Bigrams a matching pair of this summed length has in common at least, as a rounded figure below one."""
        return total * ((3 * self.threshold - 200) / 200) - 1 - _EPSILON

    def shared(self, total: Column, bigrams: Column) -> Column:
        """Tokens a matching pair of this summed length has in common at least."""
        by_char = total * (self.threshold / 200)
        need = F.when(bigrams, self.bigrams_shared(total)).otherwise(by_char)
        return F.greatest(F.ceil(need - _EPSILON), F.lit(1)).cast("int")


def _tokens(text: Column, bigrams: bool) -> Column:
    """Hashes of (gram, n-th occurrence)."""
    chars = code_points(text)
    grams = chars
    if bigrams:
        grams = bind(
            chars,
            lambda c: F.transform(
                F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))),
                lambda x, i: F.concat(x, F.get(c, i + 1)),
            ),
        )
    def numbered(g: Column, starts: Column) -> Column:
        """Each run of equal grams counted up from where it starts."""

        def run(start: Column, j: Column) -> Column:
            last = F.coalesce(F.get(starts, j + 1), F.size(g)) - 1
            return F.transform(F.sequence(start, last), lambda i: F.xxhash64(F.get(g, start), i - start, F.lit(bigrams)))

        return F.flatten(F.transform(starts, run))

    def runs(g: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(g) - 1), lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1))
        )
        return F.when(F.size(g) > 0, bind(starts, lambda at: numbered(g, at))).otherwise(F.array().cast("array<bigint>"))

    return bind(F.sort_array(grams), runs)


def _bag(text: Column) -> Column:
    """64-bit set of the text's (character, n-th occurrence) tokens.

    Every bit in which two texts differ costs at least one insert or delete.
    """
    return F.aggregate(
        _tokens(text, False),
        F.lit(0).cast("bigint"),
        lambda bag, t: bag.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(t, F.lit(64)).cast("int"))
        ),
    )


def _exploded_tokens(texts: DataFrame, bounds: _Bounds) -> DataFrame:
    """(text, n, bag, bigrams, token): one row per token and text."""
    text, n = F.col("text"), F.col("n")
    limit = bounds.shortest_bigram_sum
    kinds = []
    if limit != float("inf"):
        kinds.append(F.struct(F.lit(True).alias("bigrams"), _tokens(text, True).alias("tokens")))
        # Only texts short enough for a pair below the limit need the second kind.
        short = bounds.shortest_sum(n) <= F.lit(limit)
    else:
        short = F.lit(True)
    kinds.append(
        F.when(
            short,
            F.struct(F.lit(False).alias("bigrams"), _tokens(text, False).alias("tokens")),
        )
    )
    return (
        texts.select("text", "n", "bag", F.explode(F.array(*kinds)).alias("kind"))
        .where(F.col("kind").isNotNull())
        .select(
            "text", "n", "bag", F.col("kind.bigrams").alias("bigrams"), F.explode("kind.tokens").alias("token")
        )
    )


def _tasks(df: DataFrame) -> int:
    """Partitions of the comparing stage, whose work is in pairs, not in bytes.

    Adaptive execution would put so few bytes into few partitions; a number
    given explicitly is kept. Heavy keys are cut into cells, so it has no skew to mend.
    """
    return TASKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _texts(df: DataFrame, text: str) -> DataFrame:
    """The different texts of a column; alike wherever used, so that its shuffle runs once."""
    return df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()


def _with_length(df: DataFrame, text: str) -> DataFrame:
    """(text, n): the different texts with length."""
    return (
        _texts(df, text)
        .repartition("text")
        # Never null by construction: otherwise null checks that Catalyst infers from
        # the join would compute it for every row below the distinct.
        .withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    )


def _measured(df: DataFrame, text: str) -> DataFrame:
    """(text, n, bag): the different texts with length and characters."""
    # Long texts are not sorted out by it.
    return _with_length(df, text).withColumn(
        "bag", F.when(F.col("n") <= PAIR_KEYS_LENGTH, _bag(F.col("text"))).otherwise(F.lit(0).cast("bigint"))
    )


def _token_rows(tokens: DataFrame) -> DataFrame:
    """(token, rows): the number of texts that hold each token."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))


def _ordered(tokens: DataFrame, token_rows: DataFrame) -> DataFrame:
    """(text, n, bag, bigrams, ordered): the tokens of a text as (rows, token), rarest first."""
    return (
        tokens.join(token_rows, "token")
        .groupBy("text", "n", "bag", "bigrams")
        .agg(F.sort_array(F.collect_list(F.struct("rows", "token"))).alias("ordered"))
    )


def _signatures(ordered: DataFrame, bounds: _Bounds, hot_rows: int) -> DataFrame:
    """(text, n, bag, bigrams, prefix, rare, key): one row per join key of a text."""
    n, bigrams = F.col("n"), F.col("bigrams")
    needed = bounds.shared(bounds.shortest_sum(n), bigrams)
    token = F.col("head.token")
    hot_part = F.slice(token, F.col("rare") + 1, F.size(token))
    singles = F.transform(
        F.slice(token, F.lit(1), F.least(F.col("rare"), F.col("prefix_size"))),
        lambda t: F.xxhash64(bigrams, t),
    )
    pairs = bind(
        hot_part,
        lambda h: F.flatten(
            F.transform(
                h,
                lambda x, i: F.transform(F.slice(h, i + 2, F.size(h)), lambda y: F.xxhash64(bigrams, x, y)),
            )
        ),
    )
    # For pairs so short that one shared token is all they need to have.
    hot_singles = F.when(needed <= 1, F.transform(hot_part, lambda t: F.xxhash64(bigrams, t))).otherwise(
        F.array().cast("array<bigint>")
    )
    return (
        ordered.withColumn("prefix_size", F.size("ordered") - needed + 1)
        .withColumn("head", F.slice("ordered", F.lit(1), F.col("prefix_size") + 1))
        .withColumn("rare", F.size(F.filter("head", lambda x: x["rows"] <= hot_rows)))
        .select(
            "text", "n", "bag", "bigrams", token.alias("prefix"), "rare",
            F.explode(F.array_distinct(F.concat(singles, pairs, hot_singles))).alias("key"),
        )
    )


def _in_bands(texts: DataFrame, bounds: _Bounds) -> DataFrame:
    """(text, band, key): two rows per text, the key is the band of the longer text of a pair."""
    return texts.select("text", bounds.band(F.col("n")).alias("band")).withColumn(
        "key", F.explode(F.array("band", F.col("band") + 1))
    )


def _to_bands(left: DataFrame, right: DataFrame, bounds: _Bounds) -> list[DataFrame]:
    """As :func:`_in_bands`, but the key is the band of the right text: one row for each of those, and three for a left one.

    ``band`` is the key on both sides, as a pair has one key only.
    """
    band = bounds.band(F.col("n"))
    keys = F.explode(F.array(band - 1, band, band + 1))
    return [side.select("text", key.alias("key")).withColumn("band", F.col("key")) for side, key in ((left, keys), (right, band))]


def _with_partner(right: DataFrame, left: DataFrame, text: str, bounds: _Bounds) -> DataFrame:
    """(text): the rows of the right side for whose length the left one has a text of about a length that matches.

    Lengths are compared in finer bands, which make a short list. Rows without a partner go before they are shuffled.
    """
    fine = bounds.band(F.length("text"), BAND_PARTS)
    sides = (df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()) for df in (left, right))
    lengths, rows = (side.withColumn("fine", fine) for side in sides)
    near = F.explode(F.sequence(F.col("fine") - BAND_PARTS, F.col("fine") + BAND_PARTS))
    partners = lengths.select("fine").distinct().select(near.alias("fine")).distinct()
    return rows.join(F.broadcast(partners), "fine", "left_semi").select("text")


def _able(texts: DataFrame, bounds: _Bounds) -> DataFrame:
    """The texts that can match a long one."""
    return texts.where(bounds.longest_partner(F.col("n")) > PAIR_KEYS_LENGTH)


def _long_signatures(texts: DataFrame, bounds: _Bounds) -> DataFrame:
    """As :func:`_in_bands`, for the texts that can match a long one."""
    return _in_bands(_able(texts, bounds), bounds)


def _sides(left: DataFrame, right: DataFrame | None, chunk_rows: int | Column) -> tuple[DataFrame, DataFrame]:
    """Both sides in the cells and partitions where they are compared."""
    grid = hot_grid(left, right, "key", chunk_rows=chunk_rows)
    one, two = with_cells(left, left if right is None else right, grid, "key", "text", half=right is None)
    a = one.repartition(_tasks(left), "key", "cell").alias("a")
    # Not to be broadcast on the size estimate: the pairs are worth spreading out.
    return a, two.repartition(_tasks(left), "key", "cell").hint("merge").alias("b")


def _cheap_tests(bounds: _Bounds, within: bool) -> Column:
    """What every pair has to pass under a key, cheapest first.

    Equality on exactly the columns the sides are partitioned by.
    """
    n, m = F.col("a.n"), F.col("b.n")
    most = bounds.max_distance(n + m)
    return (
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.cell") == F.col("b.cell"))
        & (F.abs(n - m) <= most)
        & (F.bit_count(F.col("a.bag").bitwiseXOR(F.col("b.bag"))) <= most)
        & (
            F.when(F.col("a.diagonal"), F.col("a.text") < F.col("b.text")).otherwise(F.lit(True))
            if within
            else F.col("a.text") != F.col("b.text")
        )
    )


def _edits(bounds: _Bounds) -> Column:
    """Bounded Levenshtein distance of a pair; -1 if it is too large for a match."""
    return F.call_function(
        "levenshtein", F.col("a.text"), F.col("b.text"), bounds.max_distance(F.col("a.n") + F.col("b.n"))
    )


def _met(a: DataFrame, b: DataFrame, condition: Column, bounds: _Bounds) -> DataFrame:
    """(left_text, right_text, total, difference, most, edits) of the pairs that pass; all tests are
    in the join, as a filter on top would be put before them."""
    n, m = F.col("a.n"), F.col("b.n")
    return a.join(b, condition).select(
        F.col("a.text").alias("left_text"),
        F.col("b.text").alias("right_text"),
        (n + m).alias("total"),
        F.abs(n - m).alias("difference"),
        bounds.max_distance(n + m).alias("most"),
        _edits(bounds).alias("edits"),
    )


def _short_pairs(left: DataFrame, right: DataFrame | None, bounds: _Bounds, chunk_rows: int) -> DataFrame:
    """Candidates among texts of up to ``PAIR_KEYS_LENGTH``, each pair once."""
    a, b = _sides(left, right, chunk_rows)
    bigrams, total = F.col("a.bigrams"), F.col("a.n") + F.col("b.n")
    first_two = F.array_intersect("a.prefix", "b.prefix")
    # The one key under which a pair is reported.
    first = F.get(first_two, F.lit(0))
    single = (F.array_position(F.col("a.prefix"), first) <= F.col("a.rare")) | (bounds.shared(total, bigrams) <= 1)
    home = F.when(single, F.xxhash64(bigrams, first)).otherwise(
        F.xxhash64(bigrams, first, F.get(first_two, F.lit(1)))
    )
    condition = (
        _cheap_tests(bounds, right is None)
        & (bigrams == (total > F.lit(float(bounds.shortest_bigram_sum))))  # the key's hash covers the kind of token
        & (_edits(bounds) >= 0)
        & (home == F.col("a.key"))
    )
    return _met(a, b, condition, bounds)


def _band_cells(
    left: DataFrame, right: DataFrame | None, chunk_rows: int, wide_to: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of texts in bands, in the cells where they are compared.

    Up to the band ``wide_to`` chunks are larger where one of the sides has few rows.
    """
    most_rows = F.greatest("left_rows", "right_rows")
    chunk = F.greatest(F.lit(min(BAND_ROWS, chunk_rows)), F.least(F.lit(chunk_rows), F.ceil(most_rows / BAND_CHUNKS)))
    if wide_to is not None:
        few = F.least("left_rows", "right_rows") * WIDE_CHUNKS <= chunk
        chunk = F.when(few & (F.col("key") <= wide_to), chunk * WIDE_CHUNKS).otherwise(chunk)
    # A row per band at most: otherwise the texts may be shuffled by band for this join, before its size is known.
    grid = F.broadcast(hot_grid(left, right, "key", chunk_rows=chunk))
    return with_cells(left, left if right is None else right, grid, "key", "text", half=right is None)


def _short_cells(
    left: DataFrame, right: DataFrame | None, bounds: _Bounds, chunk_rows: int, equal: bool = False
) -> DataFrame:
    """(left_text, right_text, score) of the matches of short texts in bands, each pair once."""
    diagonal = F.col("diagonal") if right is None else F.lit(False)
    one, two = (
        side.select("key", "cell", "text", "band", F.lit(is_left).alias("is_left"), diagonal.alias("diagonal"))
        for side, is_left in zip(_band_cells(left, right, chunk_rows * SHORT_CHUNKS), (True, False))
    )
    found = (
        one.unionByName(two)
        .repartition(_tasks(left), "key", "cell")
        .groupBy("key", "cell")
        .applyInArrow(match_cells(bounds.threshold, _EPSILON, equal), MATCHES)
    )
    return found.select(
        "left_text", "right_text", ratio_of_distance(F.col("distance"), F.col("total")).alias("score")
    )


def _long_pairs(
    left: DataFrame, right: DataFrame | None, bounds: _Bounds, chunk_rows: int, equal: bool = False
) -> DataFrame:
    """(left_text, right_text, score) of the matches with a text above ``PAIR_KEYS_LENGTH``, each pair once."""
    within = right is None
    sides = _band_cells(left, right, chunk_rows, bounds.band(F.lit(WIDE_CHARS)))
    # Under columns of their own, as both sides may be the same frame.
    one, two = (
        side.select(*[F.col(c).alias(c) for c in side.columns]).repartition(_tasks(left), "key", "cell").groupBy("key", "cell")
        for side in sides
    )
    found = one.cogroup(two).applyInArrow(
        match_groups(bounds.threshold, _EPSILON, PAIR_KEYS_LENGTH, within, equal), MATCHES
    )
    return found.select(
        "left_text", "right_text", ratio_of_distance(F.col("distance"), F.col("total")).alias("score")
    )


def _scored(pairs: DataFrame) -> DataFrame:
    """(left_text, right_text, score) of the candidates whose exact distance is small enough."""
    exact = F.when(F.col("edits") == F.col("difference"), F.col("edits")).otherwise(
        indel_distance(F.col("left_text"), F.col("right_text"))
    )
    # Exploding zero or one distance filters without computing it twice. With
    # no more edits than the lengths differ, none is a replacement.
    close = F.filter(F.array(exact), lambda d: d <= F.col("most"))
    return pairs.select("left_text", "right_text", "total", F.explode(close).alias("distance")).select(
        "left_text", "right_text", ratio_of_distance(F.col("distance"), F.col("total")).alias("score")
    )


def _blocked_pairs(
    left: DataFrame, right: DataFrame | None, bounds: _Bounds, hot_rows: int | None, chunk_rows: int
) -> DataFrame:
    """Unequal matching texts with their score, each pair once; no ``right`` means within ``left``."""
    sides = [left] if right is None else [left, right]
    long = [_long_signatures(side, bounds) for side in sides]
    shorter = [side.where(F.col("n") <= PAIR_KEYS_LENGTH) for side in sides]
    if hot_rows is None:
        short = [_in_bands(side, bounds) for side in shorter]
    else:
        tokens = [_exploded_tokens(side, bounds) for side in shorter]
        rows = _token_rows(reduce(DataFrame.unionByName, (t.select("token") for t in tokens)))
        short = [_signatures(_ordered(t, rows), bounds, hot_rows) for t in tokens]
    short, long = (pair if right is not None else [*pair, None] for pair in (short, long))
    if hot_rows is None:
        found = _short_cells(*short, bounds, chunk_rows)
    else:
        found = _scored(_short_pairs(*short, bounds, chunk_rows))
    return found.unionByName(_long_pairs(*long, bounds, chunk_rows))


def _pairs_between(left: DataFrame, right: DataFrame, text: str, bounds: _Bounds, chunk_rows: int) -> DataFrame:
    """Matching texts of two tables with their score, equal ones included, each pair once, from cells of bands."""
    mine, theirs = _with_length(left, text), _with_length(_with_partner(right, left, text, bounds), "text")
    short = _to_bands(*(side.where(F.col("n") <= PAIR_KEYS_LENGTH) for side in (mine, theirs)), bounds)
    long = _to_bands(*(_able(side, bounds) for side in (mine, theirs)), bounds)
    return _short_cells(*short, bounds, chunk_rows, equal=True).unionByName(_long_pairs(*long, bounds, chunk_rows, equal=True))


def similar_texts(
    left: DataFrame,
    right: DataFrame | None,
    text: str,
    threshold: float = 80,
    hot_rows: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Pairs ``(left_text, right_text, score)`` of distinct texts that match.

    Without ``right`` the texts are matched with themselves: every unordered
    pair is computed once and reported in both orders, equal texts included.

    With ``hot_rows`` short texts meet under their tokens, otherwise in the bands of their lengths.
    """
    bounds = _Bounds(threshold)
    if right is not None and hot_rows is None:
        return _pairs_between(left, right, text, bounds, chunk_rows)
    measured = _with_length if hot_rows is None else _measured
    mine = measured(left, text)
    if right is None:
        once = _blocked_pairs(mine, None, bounds, hot_rows, chunk_rows)
        # Both orders from one row, instead of a union that would compute the pairs twice.
        x, y = F.col("left_text"), F.col("right_text")
        orders = F.array(
            F.struct(x.alias("left_text"), y.alias("right_text")),
            F.struct(y.alias("left_text"), x.alias("right_text")),
        )
        unequal = once.select(F.explode(orders).alias("pair"), "score").select("pair.*", "score")
        equal = _texts(left, text)
    else:
        theirs = measured(right, text)
        unequal = _blocked_pairs(mine, theirs, bounds, hot_rows, chunk_rows)
        equal = _texts(left, text).join(_texts(right, text), "text")
    equal = equal.select(
        F.col("text").alias("left_text"), F.col("text").alias("right_text"), F.lit(100.0).alias("score")
    )
    return unequal.unionByName(equal)


def fuzzy_join(
    left: DataFrame,
    right: DataFrame,
    text: str,
    key: str,
    threshold: float = 80,
    **blocking: int,
) -> DataFrame:
    """One row per pair of rows whose texts match: both keys, text of the match, score."""
    pairs = similar_texts(left, right, text, threshold, **blocking)
    return _with_keys(pairs, left, right, text, key)


def fuzzy_self_join(
    df: DataFrame, text: str, key: str, threshold: float = 80, **blocking: int
) -> DataFrame:
    """As :func:`fuzzy_join` of a table with itself, for rows with different keys; both orders."""
    pairs = similar_texts(df, None, text, threshold, **blocking)
    return _with_keys(pairs, df, df, text, key, F.col("left_key") != F.col("right_key"))


def _key_lists(df: DataFrame, text: str, key: str, side: str, chunk_keys: int) -> DataFrame:
    """({side}_text, {side}_part, {side}_keys): the keys of a text in lists of about ``chunk_keys``."""
    rows = df.select(F.col(text).alias(f"{side}_text"), F.col(key).alias("key")).where(F.col(text).isNotNull())
    parts = (
        rows.groupBy(f"{side}_text")
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > chunk_keys)
        .select(f"{side}_text", F.ceil(F.col("rows") / chunk_keys).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int")
    return (
        rows.join(parts, f"{side}_text", "left")
        .groupBy(f"{side}_text", part.alias(f"{side}_part"))
        # In a struct, as a list leaves out bare nulls.
        .agg(F.collect_list(F.struct("key")).alias(f"{side}_keys"))
    )


def _with_keys(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    text: str,
    key: str,
    condition: Column | None = None,
    chunk_keys: int = CHUNK_KEYS,
) -> DataFrame:
    """All pairs of keys behind the pairs of texts.

    The keys of a text come in lists, and each pair of lists is dealt to a task
    by its place before it is spelled out, so a text that very many rows share
    gives its rows from many tasks. Their number is given: in bytes the lists are
    few, and adaptive execution would put them into one task.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = (
        pairs.join(_key_lists(left, text, key, "left", chunk_keys), "left_text")
        .join(_key_lists(right, text, key, "right", chunk_keys), "right_text")
        .repartition(tasks, "left_text", "right_text", "left_part", "right_part")
    )
    rows = (
        lists.select("left_text", "right_text", "score", "right_keys", F.explode("left_keys").alias("l"))
        .select("left_text", "right_text", "score", "l", F.explode("right_keys").alias("r"))
        .select(F.col("l.key").alias("left_key"), F.col("r.key").alias("right_key"), "left_text", "right_text", "score")
    )
    if condition is not None:
        rows = rows.where(condition)
    return rows.select(
        "left_key",
        "right_key",
        F.lit(True).alias("match"),
        match_string(F.col("left_text"), F.col("right_text")).alias("match_string"),
        "score",
    )
