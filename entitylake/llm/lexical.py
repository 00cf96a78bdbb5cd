"""Ranked lexical search, a term at a time from the rarest, with a limit on accumulators.

The index holds, for the terms that the queries use, a posting for each document with the
term's weighted impact there. Terms are taken in bands of growing document
frequency: in each band every query's postings are added to the accumulators of its
documents, and a document that has none gets one. After a band, a query's k-th best partial score is compared with
what the terms still to come could give a document at most (weight times the largest impact that
occurs). Once that bound is below it, no document without an accumulator can
reach the result and the query creates no more of them; accumulators that cannot reach
it either are dropped. The survivors are then updated exactly with all remaining terms,
whose postings are read only where a survivor needs them.

Postings of a band are stored together, so each is read once while accumulators are made. A
frequent term's postings and a hot document are rows in many tasks; the k best are
taken in each task before they meet. Queries and their terms are broadcast while
their stored table is small, else shuffled.

Rows: a null text or one without terms is no document and is not counted; as a query it has no
rows. Repeated documents are ranked each, with equal ids in any order; a null doc_id is last among equal scores.
Repeated queries and null item ids are answered each. Empty tables give no rows. Columns other than id and
text do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import shared_folder, small, stored, stored_rows
from entitylake.llm.decontamination import words_of

K = 10
#: Percent of the length normalisation.
SLOPE = 90
#: A band holds terms whose document frequencies differ by less than this factor.
BAND = 8
#: Stands for no term: the posting that tells a document's length.
LENGTH_TERM = " "


def term_key(word: Column) -> Column:
    """128 bits of a term."""
    return F.struct(F.xxhash64(word).alias("a"), F.xxhash64(F.lit("term"), word).alias("b"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(item, item_id, term): each query's different terms; an item is a row of the table."""
    named = stored(queries.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    return named.select("item", "item_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).select(
        "item", "item_id", term_key(F.col("word")).alias("term")
    )


def postings(docs: DataFrame, terms: DataFrame, terms_fit: bool) -> DataFrame:
    """Stored (row, doc_id, n, term, tf) of the given terms, and one posting of ``LENGTH_TERM`` per document."""
    spark = docs.sparkSession
    words = words_of(F.col("text"))
    length = F.array(F.lit(LENGTH_TERM))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")
    ).select("row", "doc_id", F.size("words").cast("long").alias("n"), F.explode(F.concat("words", length)).alias("word"))
    keyed = rows.filter("n > 0").select("row", "doc_id", "n", term_key(F.col("word")).alias("term"))
    wanted = terms.select("term").distinct().union(spark.range(1).select(term_key(F.lit(LENGTH_TERM))))
    counted = keyed.join(small(wanted, terms_fit), "term", "left_semi").groupBy("row", "doc_id", "n", "term")
    return stored(counted.agg(F.count(F.lit(1)).alias("tf")))


def banded_index(found: DataFrame, slope: int = SLOPE) -> tuple[DataFrame, DataFrame]:
    """(index, terms): stored postings (band, term, row, doc_id, gain), and per term its band and largest gain."""
    spark = found.sparkSession
    is_length = F.col("term") == term_key(F.lit(LENGTH_TERM))
    documents, length = found.filter(is_length).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = f"({100 - slope}L + ({slope}L * n * {documents}L) div {max(length, 1)}L)"
    impact = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * {m})")
    worth = found.filter(~is_length).select("term", "row", "doc_id", impact.alias("impact"))
    by_term = worth.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("most"))
    weight = F.floor(F.log(F.lit(2.0 * documents + 2) / (2.0 * F.col("df") + 1)) * 1000)
    band = F.floor(F.log(F.col("df").cast("double")) / F.log(F.lit(float(BAND)))).cast("int")
    weighed = by_term.select("term", band.alias("band"), weight.alias("weight"), (F.col("most") * weight).alias("most"))
    terms, fit = stored_rows(weighed, 48)
    gains = worth.join(small(terms.select("term", "band", "weight"), fit), "term").select(
        "band", "term", "row", "doc_id", (F.col("impact") * F.col("weight")).alias("gain")
    )
    path = f"{shared_folder(spark)}/index"
    gains.write.partitionBy("band").option("compression", "zstd").parquet(path)
    return spark.read.schema(gains.schema).parquet(path), terms


def _best(scores: DataFrame, k: int) -> DataFrame:
    """The k best accumulators of each item; each task keeps k of its own before they are shuffled."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def accumulate(index: DataFrame, plan: DataFrame, fit: bool, k: int = K) -> DataFrame:
    """Stored survivors (item, row, doc_id, score, until): exact partial sums over the bands up to ``until``.

    ``plan`` has each item's known terms: (item, term, band, most).
    """
    spark = index.sparkSession
    accumulators = spark.createDataFrame([], "item long, row long, doc_id long, score long")
    open_items = plan.select("item").distinct()
    survivors = spark.createDataFrame([], "item long, row long, doc_id long, score long, until int")
    for band in sorted(row.band for row in plan.select("band").distinct().collect()):
        asked = plan.filter(F.col("band") == band).join(small(open_items, fit), "item", "left_semi")
        new = index.filter(F.col("band") == band).join(small(asked.select("item", "term"), fit), "term")
        sums = accumulators.unionByName(new.select("item", "row", "doc_id", F.col("gain").alias("score")))
        total = stored(sums.groupBy("item", "row", "doc_id").agg(F.sum("score").alias("score")))

        kth = _best(total, k).groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("held"))
        to_come = F.sum(F.when(F.col("band") > band, F.col("most")).otherwise(F.lit(0)))
        state = stored(
            plan.groupBy("item").agg(to_come.alias("left"))
            .join(small(open_items, fit), "item", "left_semi")
            .join(kth.filter(F.col("held") == k), "item", "left")
            .select("item", "left", "least", (F.col("left") < F.coalesce("least", F.lit(1))).alias("done"))
        )
        # Without k accumulators there is no bound yet, and the item is done when nothing is left.
        reach = F.col("least").isNull() | (F.col("score") + F.col("left") >= F.col("least"))
        kept = total.join(small(state, fit), "item").filter(reach)
        accumulators = kept.filter(~F.col("done")).select("item", "row", "doc_id", "score")
        survivors = survivors.unionByName(
            kept.filter("done").select("item", "row", "doc_id", "score", F.lit(band).alias("until"))
        )
        open_items = state.filter(~F.col("done")).select("item")
        if open_items.isEmpty():
            break
    return stored(survivors)


def search(docs: DataFrame, queries: DataFrame, k: int = K, slope: int = SLOPE) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of ``queries`` (item_id, text)."""
    asked, asked_fit = stored_rows(query_terms(queries), 40)
    index, known = banded_index(postings(docs, asked, asked_fit), slope)
    plan, fit = stored_rows(asked.join(small(known, asked_fit), "term").select("item", "item_id", "term", "band", "most"), 56)
    partial = accumulate(index, plan, fit, k)

    # The survivors' remaining terms, and their postings in the survivors' documents.
    terms = small(plan.select("item", "term", F.col("band").alias("later")), fit)
    wanted = partial.join(terms, "item").filter(F.col("later") > F.col("until")).select("item", "row", "doc_id", "term")
    rows, few = stored_rows(partial.select("row").distinct(), 8)
    from_band = partial.agg(F.min("until")).first()[0]
    rest = index.filter(F.col("band") > (0 if from_band is None else from_band)).join(small(rows, few), "row", "left_semi")
    updates = wanted.join(rest.select("row", "term", "gain"), ["row", "term"])
    scores = (
        partial.drop("until").unionByName(updates.select("item", "row", "doc_id", F.col("gain").alias("score")))
        .groupBy("item", "row", "doc_id").agg(F.sum("score").alias("score"))
    )
    names = plan.select("item", "item_id").distinct()
    return _best(scores.filter("score > 0"), k).join(small(names, fit), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT row_number() OVER () AS item, item_id,
    unnest(list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''))) AS word FROM benchmark),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM doc WHERE len(w) > 0),
worded AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS word FROM doc),
posting AS (SELECT row, doc_id, n, word, count(*) AS tf FROM worded GROUP BY ALL),
weight AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM posting, total GROUP BY word, n_all),
scored AS (SELECT item, item_id, row, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM item JOIN posting USING (word) JOIN weight USING (word), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
