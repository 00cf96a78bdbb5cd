"""Exact string similarity as native column expressions (no UDF).

The ratio is ``100 * (1 - d / (n + m))``, d being the insert/delete distance
``n + m - 2 * LCS``. The longest common subsequence is counted with bit
vectors: one long holds a row of the usual table, so a pair costs one step per
character of the longer text instead of one per cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two bits below a signed long, so that a sum of two vectors and a carry fits.
WORD_BITS = 62
_FULL_WORD = (1 << WORD_BITS) - 1


def code_points(text: Column) -> Column:
    """Characters of a text as an array, whole code points."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def _long_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, v: total + v)


def _positions(chars: Column, char: Column) -> Column:
    """Bit vector of the places at which ``char`` stands in ``chars``."""
    return _long_sum(
        F.transform(
            chars,
            lambda c, i: F.when(c == char, _bit(i)).otherwise(F.lit(0).cast("bigint")),
        )
    )


def _lcs_one_word(chars: Column, other: Column) -> Column:
    """LCS length where ``chars`` has 1..62 characters."""
    length = F.size(chars)
    letters = F.array_distinct(chars)
    table = F.struct(
        F.map_from_arrays(letters, F.transform(letters, lambda c: _positions(chars, c))).alias("at"),
        (_bit(length) - 1).alias("full"),
    )

    def run(t: Column) -> Column:
        def step(row: Column, char: Column) -> Column:
            hit = F.coalesce(F.try_element_at(t["at"], char), F.lit(0).cast("bigint"))
            return bind(
                row.bitwiseAND(hit),
                lambda u: (row + u).bitwiseOR(row - u).bitwiseAND(t["full"]),
            )

        return length - F.bit_count(F.aggregate(other, t["full"], step))

    return bind(table, run)


def _lcs_words(chars: Column, other: Column) -> Column:
    """LCS length for longer texts: the same row kept in several words with a carry."""
    length = F.size(chars)
    letters = F.array_distinct(chars)
    words = F.sequence(F.lit(0), F.ceil(length / F.lit(WORD_BITS)).cast("int") - 1)

    def word(w: Column) -> Column:
        return F.slice(chars, w * WORD_BITS + 1, F.lit(WORD_BITS))

    table = F.struct(
        F.map_from_arrays(
            letters,
            F.transform(letters, lambda c: F.transform(words, lambda w: _positions(word(w), c))),
        ).alias("at"),
        F.transform(
            words,
            lambda w: F.when(
                F.size(word(w)) == WORD_BITS, F.lit(_FULL_WORD).cast("bigint")
            ).otherwise(_bit(F.size(word(w))) - 1),
        ).alias("full"),
    )

    def run(t: Column) -> Column:
        def step(row: Column, char: Column) -> Column:
            # A character that is not in the text leaves the row as it is.
            return bind(
                F.try_element_at(t["at"], char),
                lambda hits: F.when(hits.isNull(), row).otherwise(advance(row, hits)),
            )

        def advance(row: Column, hits: Column) -> Column:
            def one(acc: Column, w: Column) -> Column:
                old = F.get(row, w)
                u = old.bitwiseAND(F.get(hits, w))
                total = old + u + acc["carry"]
                return F.struct(
                    F.shiftright(total, WORD_BITS).alias("carry"),
                    F.concat(
                        acc["row"],
                        F.array(total.bitwiseOR(old - u).bitwiseAND(F.get(t["full"], w))),
                    ).alias("row"),
                )

            start = F.struct(
                F.lit(0).cast("bigint").alias("carry"),
                F.array().cast("array<bigint>").alias("row"),
            )
            return F.aggregate(words, start, one)["row"]

        last = F.aggregate(other, t["full"], step)
        left = F.aggregate(last, F.lit(0), lambda n, w: n + F.bit_count(w))
        return length - left

    return bind(table, run)


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence, in code points."""
    swap = F.length(left) > F.length(right)
    pair = F.struct(
        code_points(F.when(swap, right).otherwise(left)).alias("short"),
        code_points(F.when(swap, left).otherwise(right)).alias("long"),
    )
    return bind(
        pair,
        lambda p: F.when(F.size(p["short"]) == 0, F.lit(0))
        .when(F.size(p["short"]) <= WORD_BITS, _lcs_one_word(p["short"], p["long"]))
        .otherwise(_lcs_words(p["short"], p["long"])),
    )


def indel_distance(left: Column, right: Column) -> Column:
    """Fewest single-character inserts and deletes that turn one text into the other."""
    return F.length(left) + F.length(right) - 2 * lcs_length(left, right)


def ratio_of_distance(distance: Column, total_length: Column) -> Column:
    """Similarity 0..100 from a distance and the summed lengths; two empty texts are equal."""
    return F.when(total_length == 0, F.lit(100.0)).otherwise(
        (F.lit(1.0) - distance / F.when(total_length != 0, total_length)) * 100.0
    )


def indel_ratio(left: Column, right: Column) -> Column:
    """Similarity of two texts, 0..100, case-sensitive; null if a side is null."""
    return F.when(
        left.isNotNull() & right.isNotNull(),
        ratio_of_distance(indel_distance(left, right), F.length(left) + F.length(right)),
    )


def match_string(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit(" == "), right)


def fuzzy_match(left: Column, right: Column, threshold: float = 80) -> Column:
    """Struct ``(match, match_string, score)`` for one pair of texts.

    The text is null where the pair does not match; a null side never matches
    and scores 0.
    """
    return bind(
        F.coalesce(indel_ratio(left, right), F.lit(0.0)),
        lambda score: F.struct(
            (score >= threshold).alias("match"),
            F.when(score >= threshold, match_string(left, right)).alias("match_string"),
            score.alias("score"),
        ),
    )
