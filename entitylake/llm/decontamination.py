"""Exact phrase and proximity matches through a positional inverted index.

The index holds a posting (document, term, place) for every occurrence in the corpus of a term that
the test set uses, and one posting per document with its length. It is a stored
table. A phrase is looked up from its rarest term: that term's postings, less its
offset in the phrase, are the possible starts; the second rarest term's postings, at their own
offset, must agree; what is left is intersected with the postings of all its terms. So a
frequent term is only read where a rare one has already matched.

Rows: a null text or one without words has no postings of terms and is never contaminated; repeated rows
and equal ids with different texts are answered each; empty tables give empty or clean results;
other columns do not matter. Benchmark items without words are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import small, stored, stored_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Stands for no word: the term of the posting that tells a document's length.
LENGTH_TERM = " "
DOC = ["_doc", "_hash"]


def words_of(text: Column) -> Column:
    """Words of letters, digits and all non-ASCII characters, A-Z in lower case."""
    text = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def doc_key(docs: DataFrame) -> list[Column]:
    """Names a row by its id and text, so that equal rows share postings."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_doc"),
        F.xxhash64("doc_id", "text").alias("_hash"),
    ]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, _at, term, _len): the words of each different item text, in their places."""
    worded = items.select("item_id", words_of(F.col("text")).alias("_words")).distinct()
    # An id used for two texts stands for both: they are told apart by their words.
    worded = worded.withColumn("_item", F.xxhash64("item_id", "_words"))
    return worded.select("item_id", "_item", F.size("_words").alias("_len"), F.posexplode("_words").alias("_at", "_word")).select(
        "item_id", "_item", "_len", "_at", F.xxhash64("_word").alias("term")
    )


def positional_index(docs: DataFrame, terms: DataFrame, terms_fit: bool) -> DataFrame:
    """Stored postings (_doc, _hash, term, _pos) of the given terms; ``LENGTH_TERM`` has the length as place."""
    words = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    postings = (
        docs.select(*doc_key(docs), words.alias("_words"))
        .select(*DOC, F.posexplode(F.concat("_words", F.array(F.xxhash64(F.lit(LENGTH_TERM))))).alias("_pos", "term"))
    )
    wanted = terms.select("term").union(
        terms.sparkSession.range(1).select(F.xxhash64(F.lit(LENGTH_TERM)).alias("term"))
    )
    return stored(postings.join(small(wanted, terms_fit), "term", "left_semi").select(*DOC, "term", "_pos"))


def _phrases(terms: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Windows of each item by their rarest and second rarest terms: (_item, _at1, term, _at2, _term2)."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    ranked = terms.join(counts, "term")  # a window with a term that no document has cannot occur
    starts = F.explode(F.sequence(F.greatest(F.col("_at") - window + 1, F.lit(0)),
                                  F.least("_at", F.greatest(F.col("_len") - window, F.lit(0)))))
    each = ranked.select("_item", "_len", "_at", "term", "_df", starts.alias("_start"))
    by_rarity = F.sort_array(F.collect_list(F.struct("_df", "_at", "term")))
    return (
        each.groupBy("_item", "_start", "_len")
        .agg(by_rarity.alias("_by"))
        .filter(F.size("_by") == F.least("_len", F.lit(window)))
        .select(
            "_item",
            F.col("_by")[0]["_at"].alias("_at1"),
            F.col("_by")[0]["term"].alias("term"),
            F.when(F.size("_by") > 1, F.col("_by")[1]["_at"]).otherwise(F.col("_by")[0]["_at"]).alias("_at2"),
            F.when(F.size("_by") > 1, F.col("_by")[1]["term"]).otherwise(F.col("_by")[0]["term"]).alias("_term2"),
        )
        .distinct()
    )


def phrase_matches(index: DataFrame, terms: DataFrame, terms_fit: bool, window: int = WINDOW) -> DataFrame:
    """Words of documents inside an occurrence of a window of an item: (_doc, _hash, item_id, _pos)."""
    phrases, fit = stored_rows(_phrases(terms, index, window), 48)
    starts = index.join(small(phrases, fit), "term").select(
        *DOC, "_item", (F.col("_pos") - F.col("_at1")).alias("_delta"), "_term2", "_at2"
    )
    second = index.join(small(phrases.select(F.col("_term2").alias("term")).distinct(), fit), "term", "left_semi")
    agreed = starts.join(
        second,
        (starts["_doc"] == second["_doc"])
        & (starts["_hash"] == second["_hash"])
        & (starts["_term2"] == second["term"])
        & (starts["_delta"] + starts["_at2"] == second["_pos"]),
        "left_semi",
    )
    # A negative start is kept: the item's first words may lie before the document's first.
    aligned, few = stored_rows(agreed.select(*DOC, "_item", "_delta").distinct(), 40)
    here = index.join(small(aligned.select(*DOC).distinct(), few), DOC, "left_semi")
    expected = aligned.join(small(terms, terms_fit), "_item").select(
        *DOC, "_item", "item_id", "_len", "_delta", "_at", "term", (F.col("_delta") + F.col("_at")).alias("_pos")
    )
    agreeing = expected.join(here.distinct(), [*DOC, "term", "_pos"], "left_semi")
    # Runs of agreeing places that reach the window's length are occurrences.
    alignment = [*DOC, "_item", "_delta"]
    in_order = Window.partitionBy(*alignment).orderBy("_at")
    run = Window.partitionBy(*alignment, "_run")
    return (
        agreeing.withColumn("_run", F.col("_at") - F.row_number().over(in_order))
        .withColumn("_long", F.count(F.lit(1)).over(run))
        .filter(F.col("_long") >= F.least("_len", F.lit(window)))
        .select(*DOC, "item_id", "_pos")
        .distinct()
    )


def proximity_matches(index: DataFrame, left: str, right: str, within: int) -> DataFrame:
    """Places of two words at most ``within`` words apart: (_doc, _hash, left_pos, right_pos).

    Places meet in blocks of ``within`` words, the right one also in the two blocks beside it.
    """
    block = F.floor(F.col("_pos") / within)
    lefts = index.filter(F.col("term") == F.xxhash64(F.lit(left))).select(
        *DOC, F.col("_pos").alias("left_pos"), block.alias("_block")
    )
    rights = index.filter(F.col("term") == F.xxhash64(F.lit(right))).select(
        *DOC, F.col("_pos").alias("right_pos"), F.explode(F.array(block - 1, block, block + 1)).alias("_block")
    )
    near = F.abs(F.col("left_pos") - F.col("right_pos"))
    return lefts.join(rights, [*DOC, "_block"]).filter((near <= within) & (near > 0)).drop("_block").distinct()


def build(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(index, item terms, whether the terms may be broadcast)."""
    terms, fit = stored_rows(item_terms(benchmark), 40)
    return positional_index(docs, terms.select("term").distinct(), fit), terms, fit


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    results = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*results)
    index, terms, fit = build(docs, benchmark)
    hits = phrase_matches(index, terms, fit, window)
    per_doc = hits.groupBy(*DOC).agg(
        F.count_distinct("_pos").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("_items"),
    )
    lengths = index.filter(F.col("term") == F.xxhash64(F.lit(LENGTH_TERM))).select(*DOC, F.col("_pos").cast("long").alias("n_words")).distinct()
    facts = lengths.join(per_doc, DOC, "left")
    keyed = docs.select(*docs.columns, *doc_key(docs))
    n_hit = F.coalesce("n_hit", F.lit(0))
    none = F.array().cast("array<string>")
    return (
        keyed.join(facts, DOC)
        .select(
            *docs.columns,
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("_items", none), ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        )
    )


ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT item_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
item_window AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
  array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS words
  FROM item, range(1, greatest(len(w) - 12, 1) + 1) AS r(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM item_window),
doc_window AS (SELECT row, s, n, array_to_string(w[s : s + n - 1], ' ') AS words
  FROM doc, lengths, range(1, len(w) - n + 2) AS r(s) WHERE len(w) >= n),
hit AS (SELECT row, s, n, item_id FROM doc_window JOIN item_window USING (n, words)),
place AS (SELECT row, count(DISTINCT s + k) AS n_hit FROM hit, range(0, n) AS r(k) GROUP BY row),
found AS (SELECT row, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN place USING (row) LEFT JOIN found USING (row)
"""
