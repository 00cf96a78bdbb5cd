"""Boilerplate lines by their frequency among the pages of a site.

Pages holding a line are counted per host, once for each page, and divided by the
host's pages; lines above the ratio are dropped from the host's texts. Only
hashes of lines are shuffled, counted map-side first, so neither a hot host nor a
hot line gathers in a task. A host has at most (mean lines of a page) / ratio such lines,
and their stored table is sent to all executors while its bytes are few, else Spark
joins the pages with it by shuffling, where adaptive execution splits a hot host.

Rows: a null text stays null, a line without a word is never dropped, lines are equal byte
for byte and a null host is a host of its own. A page of which every line with a word would
go is a repeated page, not one with boilerplate, and stays whole (``keep_whole``); so do the pages of
hosts where a line is on fewer than ``min_pages``. Repeated rows are pages each.
Extra columns are kept, but those named as results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.llm.common import BROADCAST_BYTES, let, small, stored

RATIO = 0.06
MIN_PAGES = 3


def _line_keys(text: Column) -> Column:
    """128 bits for each different line with a word."""
    lines = F.array_distinct(F.split(text, "\n", -1))
    return F.transform(
        F.filter(lines, lambda line: F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")) > 0), _key
    )


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate_lines(docs: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host the keys of its boilerplate lines: (_host, _drop array of keys)."""
    pages = docs.select(F.col(host).alias("_host"), "text")
    lines = pages.select("_host", F.explode(_line_keys(F.col("text"))).alias("_line"))
    held = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_held")).filter(F.col("_held") >= min_pages)
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    return (
        held.join(totals, held["_host"].eqNullSafe(totals["_host"]))
        .filter(F.col("_held") > F.col("_pages") * F.lit(ratio))
        .groupBy(held["_host"])
        .agg(F.sort_array(F.collect_list("_line")).alias("_drop"))
    )


def dedup_lines(
    docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = True
) -> DataFrame:
    """``docs`` with boilerplate lines out of ``text``, and ``n_lines`` and ``n_dropped``.

    Without ``keep_whole`` pages of nothing but boilerplate lose these lines, too.
    """
    docs = docs.drop("n_lines", "n_dropped")
    drops = stored(boilerplate_lines(docs, host, ratio, min_pages))
    keys = drops.agg(F.sum(F.size("_drop") + 4)).first()[0] or 0
    drops = small(drops, keys * 16 <= BROADCAST_BYTES)
    joined = docs.join(drops, docs[host].eqNullSafe(drops["_host"]), "left").drop("_host")

    def cleaned(lines: Column) -> Column:
        kept = F.filter(lines, lambda line: ~F.array_contains(F.col("_drop"), _key(line)))
        if not keep_whole:
            return kept
        worded = F.length(F.regexp_replace(F.array_join(kept, ""), r"[\x20\x09-\x0D]+", "")) > 0
        return F.when(worded, kept).otherwise(lines)

    lines = F.split("text", "\n", -1)
    out = joined.withColumn("_lines", lines).withColumn(
        "_kept", F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(let(F.col("_lines"), cleaned))
    )
    return out.select(
        *(F.array_join("_kept", "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


ORACLE = r"""
WITH page AS (SELECT row_number() OVER () AS row, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT DISTINCT row, source, unnest(lines) AS line FROM page),
held AS (SELECT source, line, count(*) AS held FROM line
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boilerplate AS (SELECT source, list(line) AS dropped
         FROM held JOIN total USING (source) WHERE held >= {min_pages} AND held > pages * CAST({ratio} AS DOUBLE) GROUP BY source),
cut AS (SELECT p.doc_id, p.lines,
         list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.dropped, x), false)) AS kept
         FROM page p LEFT JOIN boilerplate b USING (source)),
safe AS (SELECT doc_id, lines,
         CASE WHEN regexp_matches(array_to_string(kept, ''), '[^\x20\x09-\x0D]') THEN kept ELSE lines END AS kept FROM cut)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped
FROM safe
""".format(ratio=RATIO, min_pages=MIN_PAGES)
