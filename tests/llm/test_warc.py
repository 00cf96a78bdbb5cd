import hashlib
import io
from uuid import uuid4

import pytest
import zstandard
from pyspark.sql import functions as F

from entitylake.llm import warc
from entitylake.llm.common import shared_folder
from tests.llm.tables import bag, prose

BIG = "<p>" + prose(1, 400) + "</p>"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/ 4\r\nX: y", "<p>short</p>"),
    (5, "u", "<p>short</p>"), (6, "u", None), (7, "u", ""), (None, "u", BIG), (None, None, None), (9, "u", "é" * 600),
    (8, "u", "é" * 600), (9, "u", "é" * 600), (10, "u", "long " * 200_000), (-11, "u", BIG + "é漢🎈"), (None, "u", "only null " * 200),
    (None, "u", "only null " * 200),
]


def plain(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        twins = [p for p, _, h in rows if h == html]
        known = [p for p in twins if p is not None]
        revisit = len(data) >= 1000 and len(twins) > 1 and bool(known) and page_id != max(known)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(known) if revisit else None))
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    read = warc.round_trip(pages.repartition(3))
    assert bag(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == bag(plain(PAGES))


def test_payloads_and_rolled_archives(spark, monkeypatch):
    folder = f"{shared_folder(spark)}/warc"
    rows = [(i, f"http://a/{i}", f"<p>{prose(i, 60)}</p>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_revisits(pages).coalesce(1), folder)
    assert archives.agg(F.sum("n_records")).first()[0] == 200
    read = warc.read_archives(archives, folder).collect()
    assert {(r.page_id, r.url, bytes(r.payload).decode()) for r in read} == set(rows)
    # Every frame is one record, and the first frame holds a dictionary.
    path = folder.removeprefix("file://") + "/" + archives.first().archive
    data = open(path, "rb").read()
    assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    assert sum(1 for _ in warc.frames(io.BytesIO(data))) == 200


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).collect() == []


def archive(*records, dictionary=b"", compressed=True):
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    frames = [zstandard.ZstdCompressor(**options).compress(r) for r in records]
    head = warc.dictionary_frame(dictionary, compressed) if dictionary else b""
    return head + b"".join(frames)


GOOD = warc.record(1, "http://a", b"hello", None, False)


@pytest.mark.parametrize("compressed", [True, False])
def test_dictionary_stored_both_ways(compressed):
    dictionary = zstandard.train_dictionary(2000, [prose(i, 50).encode() for i in range(300)]).as_bytes()
    data = archive(GOOD, GOOD, dictionary=dictionary, compressed=compressed)
    assert list(warc.frames(io.BytesIO(data))) == [GOOD, GOOD]


@pytest.mark.parametrize(
    "bad",
    [
        GOOD.replace(b"WARC/1.1", b"WARC/9"), GOOD.replace(b"Content-Length: 83", b"Content-Length: 85"), GOOD[:-2], GOOD + b"x",
        GOOD.replace(b"WARC-Date", b"WARC-Dated"), GOOD.replace(b"hello", b"jello"), GOOD + GOOD, b"", GOOD.replace(b"WARC-Type: response\r\n", b"WARC-Type response\r\n"),
        GOOD.replace(b"WARC-Date:", b"WARC-Type: x\r\nWARC-Date:"),
    ],
)
def test_malformed_records(bad):
    with pytest.raises(warc.Malformed):
        warc.parse(bad)
    assert warc.parse(GOOD)["payload"] == b"hello"


@pytest.mark.parametrize("cut", [1, 5, 9])
def test_cut_off_archives(cut):
    with pytest.raises(warc.Malformed):
        list(warc.frames(io.BytesIO(archive(GOOD)[:-cut])))
    with pytest.raises(warc.Malformed):
        list(warc.frames(io.BytesIO(archive(GOOD) + b"junk")))


def test_broken_archive_is_reported(spark, tmp_path):
    name = f"{uuid4().hex}.warc.zst"
    (tmp_path / name).write_bytes(archive(GOOD, GOOD.replace(b"hello", b"jello"), GOOD))
    archives = spark.createDataFrame([(name,)], "archive string")
    rows = warc.read_archives(archives, f"file://{tmp_path}", on_problem="report").collect()
    assert [r.problem is None for r in rows] == [True, False, True]
    with pytest.raises(Exception, match="digest differs"):
        warc.read_archives(archives, f"file://{tmp_path}").collect()
