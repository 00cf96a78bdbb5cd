from collections import Counter

from pyspark.sql import functions as F

from entitylake.llm.line_dedup import RATIO, dedup_lines
from tests.llm.tables import awkward_rows, bag, documents, prose, words


def plain(rows, ratio, least):
    pages = Counter(r[3] for r in rows)
    held = Counter((r[3], line) for r in rows if r[1] is not None for line in set(r[1].split("\n")) if words(line))
    out = []
    for i, text, _, host, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (held[host, x] >= least and held[host, x] > ratio * pages[host])]
        if not words("".join(kept)):
            kept = lines
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_awkward_rows(spark):
    df = documents(spark).withColumn("n_dropped", F.lit("x"))
    rows = dedup_lines(df, min_pages=3).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert bag(rows) == bag(plain(awkward_rows(), RATIO, 3))
    dropped = {r.doc_id for r in rows if r.n_dropped}
    assert {14, 15, 16} <= dropped and 17 not in dropped


def test_lines_around_the_ratio(spark):
    """Of 200 pages of a host, planted lines on 10 % go and those on 3 % stay; another host's share does not matter."""
    passage = " ".join(f"passage{i}" for i in range(60))
    pages = []
    for host in ("a", "b"):
        for i in range(200):
            lines = [prose(300 + i + 1000 * (host == "b"), 12)]
            lines += ["home | about | contact"] * (i % 10 == 0) + [passage] * (i % 10 == 3)
            lines += ["seldom seen line"] * (i % 33 == 1) + ["only on one host"] * (host == "a" and i % 10 == 5)
            lines += ["only on one host"] * (host == "b" and i % 50 == 5)
            pages.append((i + 1000 * (host == "b"), "\n".join(lines), "en", host, 1))
    rows = dedup_lines(documents(spark, pages)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert bag(rows) == bag(plain(pages, RATIO, 3))
    kept = Counter(line for r in rows for line in r.text.split("\n"))
    assert kept["home | about | contact"] == kept[passage] == 0
    assert kept["seldom seen line"] == 14 and kept["only on one host"] == 4
    assert sum(r.n_dropped for r in rows) == 2 * 20 + 2 * 20 + 20


def test_pages_of_boilerplate_only(spark):
    pages = [(i, "menu" if i < 5 else f"menu\npage {i}", "en", "a", 1) for i in range(10)]
    assert {r.doc_id for r in dedup_lines(documents(spark, pages)).collect() if not r.n_dropped} == set(range(5))
    rows = dedup_lines(documents(spark, pages), keep_whole=False).collect()
    assert {r.doc_id: r.text for r in rows} == {i: "" if i < 5 else f"page {i}" for i in range(10)}


def test_empty(spark):
    assert dedup_lines(documents(spark, [])).collect() == []
    only = dedup_lines(documents(spark, [(1, None, None, None, None)])).collect()
    assert [(r.text, r.n_lines) for r in only] == [(None, 0)]
