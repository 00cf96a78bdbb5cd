"""Entity mentions in text: a dictionary match, or a model applied in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.functions.text import name_tokens
from entitylake.operators.sentiment import bounded_batches
from entitylake.schemas import MENTIONS

# Dictionaries up to this many bytes are sent to all executors, larger ones are shuffled.
BROADCAST_BYTES = 32 << 20

# From a batch of texts to the (mention, type) pairs of each.
Extractor = Callable[[Sequence[str]], Sequence[Sequence[tuple[str, str]]]]


def entity_type(column: str) -> Column:
    """Countries, cities and states (GPE) count as places."""
    return F.when(F.col(column) == "GPE", "LOC").otherwise(F.col(column))


# Bits that hashed first tokens of phrases are kept in; a full set only sorts out less.
FIRST_TOKEN_BITS = 1 << 17


def _dictionary(gazetteer: DataFrame) -> DataFrame:
    """(parts, labels): tokens of a phrase and all (phrase, type) spelled with them."""
    return (
        gazetteer.select(
            name_tokens(F.col("phrase")).alias("parts"),
            F.struct("phrase", entity_type("type").alias("type")).alias("label"),
        )
        .where(F.size("parts") > 0)
        .groupBy("parts")
        .agg(F.collect_set("label").alias("labels"))
    )


def _facts(dictionary: DataFrame) -> DataFrame:
    """Bytes of the dictionary, tokens of its longest phrase and places of its first tokens, one row."""
    label = F.aggregate(
        "labels", F.lit(0), lambda n, x: n + F.length(x["phrase"]) + F.length(F.coalesce(x["type"], F.lit(""))) + 32
    )
    own = F.length(F.array_join("parts", "")) + F.size("parts") * 16 + 32
    return dictionary.agg(
        F.sum((label + own).cast("long") * 2).alias("size"),
        F.max(F.size("parts")).alias("longest"),
        F.collect_set(_place(F.element_at("parts", 1))).alias("places"),  # at most FIRST_TOKEN_BITS
    )


def _place(token: Column) -> Column:
    """Place of a token in the bit set of first tokens."""
    return F.pmod(F.xxhash64(token), F.lit(FIRST_TOKEN_BITS))


def _bit_set(places: Sequence[int]) -> Column:
    """Places as one constant array of 64-bit words."""
    words = [0] * (FIRST_TOKEN_BITS // 64)
    for place in places:
        words[place // 64] |= 1 << place % 64
    signed = (str(w - (1 << 64) if w >> 63 else w) for w in words)
    return F.split(F.lit(",".join(signed)), ",").cast("array<bigint>")


def _may_begin(token: Column, bits: Column) -> Column:
    place = _place(token)
    word = F.get(bits, F.floor(place / 64).cast("int"))
    return F.call_function("getbit", word, F.pmod(place, F.lit(64)).cast("int")) == 1


def _spans(texts: DataFrame, dictionary: DataFrame, longest: int, bits: Column, small: bool) -> DataFrame:
    """(key, field, text_id, start, end, labels): where a run of tokens is a dictionary phrase.

    A bit set of first tokens sorts out most positions before anything is made of
    them. Only positions whose token begins a phrase give runs, of the lengths such
    phrases have, and runs are looked up whole, so it does not matter how many
    phrases begin with the same token. A position goes on with no more tokens than
    the longest phrase has. A small dictionary is broadcast for both
    lookups; with a large one Spark joins the first tokens as it sees fit, and runs
    by their hash.
    """
    places = F.filter(
        F.transform("tokens", lambda token, i: F.when(_may_begin(token, bits), i)), lambda i: i.isNotNull()
    )
    ahead = F.transform(
        places,
        lambda i: F.struct(i.alias("start"), F.get("tokens", i).alias("first"), F.slice("tokens", i + 1, longest).alias("ahead")),
    )
    positions = texts.select("key", "field", "text_id", F.explode(ahead).alias("p")).select(
        "key", "field", "text_id", "p.start", "p.first", "p.ahead"
    )
    beginnings = dictionary.groupBy(F.element_at("parts", 1).alias("first")).agg(
        F.collect_set(F.size("parts")).alias("lengths")
    )
    phrases = dictionary.withColumn("run", F.xxhash64("parts"))
    hint = F.broadcast if small else lambda df: df.hint("merge")
    parts = F.slice("ahead", 1, F.col("length"))
    return (
        positions.join(hint(beginnings), "first")
        .withColumn("length", F.explode("lengths"))
        .where(F.col("length") <= F.size("ahead"))
        .select(
            "key", "field", "text_id", "start", (F.col("start") + F.col("length")).alias("end"),
            parts.alias("parts"), F.xxhash64(parts).alias("run"),
        )
        .join(hint(phrases), ["run", "parts"])
        .drop("run", "parts")
    )


def extract_mentions(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    gazetteer: DataFrame,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Distinct ``(uri, entity_text, entity_type)`` of the dictionary phrases in the text columns.

    ``gazetteer`` has the columns ``phrase`` and ``type``. A phrase is found
    where its tokens follow each other in the text, whatever stands between
    them. Where one match lies inside a longer one, only the longer counts.
    Texts are never shuffled: only matches are.
    """
    dictionary = _dictionary(gazetteer)
    # One small job on the dictionary tells how it can be joined.
    found = _facts(dictionary).first()
    fields = F.array(*[F.col(c) for c in columns])
    texts = (
        df.select(F.col(key).alias("key"), F.posexplode(fields).alias("field", "text"))
        .where(F.col("text").isNotNull())
        .select("key", "field", F.xxhash64("text").alias("text_id"), name_tokens(F.col("text")).alias("tokens"))
    )
    bits, small = _bit_set(found["places"]), (found["size"] or 0) <= broadcast_bytes
    spans = _spans(texts, dictionary, found["longest"] or 1, bits, small)
    # Copies of a text under one key fold together before the window, so a
    # window holds at most the matches of one text.
    spans = spans.distinct()
    before = (
        Window.partitionBy("key", "field", "text_id")
        .orderBy("start", F.desc("end"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        spans.withColumn("covered_to", F.max("end").over(before))
        .where(F.col("covered_to").isNull() | (F.col("covered_to") < F.col("end")))
        .select("key", F.explode("labels").alias("label"))
        .select(
            F.col("key").alias("uri"),
            F.col("label.phrase").alias("entity_text"),
            F.col("label.type").alias("entity_type"),
        )
        .distinct()
    )


def extract_with_model(
    df: DataFrame, key: str, columns: Sequence[str], load: Callable[[], Extractor]
) -> DataFrame:
    """As :func:`extract_mentions`, with a model instead of a dictionary.

    ``load`` is called once per task and returns a function from a batch of texts
    to the ``(mention, type)`` pairs of each. Empty and missing texts never reach the model.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = load()
        for batch in batches:
            rows = [
                (uri, mention, kind)
                for uri, found in zip(batch["uri"], extract(batch["text"].tolist()), strict=True)
                for mention, kind in found
            ]
            yield pd.DataFrame(rows, columns=MENTIONS.names)

    bounded_batches(df.sparkSession)
    texts = df.select(
        F.col(key).alias("uri"), F.explode(F.array(*[F.col(c) for c in columns])).alias("text")
    ).where(F.col("text").isNotNull() & (F.col("text") != ""))
    return (
        texts.mapInPandas(run, MENTIONS)
        .where(F.col("entity_type").isin("LOC", "GPE", "ORG", "PERSON"))
        .select("uri", "entity_text", entity_type("entity_type").alias("entity_type"))
        .distinct()
    )
