from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from muster.llm import arc
from muster.session import workspace

PAGES = [
    (5, "http://a.example.com/x y", "<p>one</p>"), (2, "http://b.example.com/", "<p>one</p>"), (9, None, "<p>one</p>"),
    (1, "", None), (3, "http://c.example.com/", ""), (4, "é://ü", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nARC 5\n\n"),
    (6, "http://d.example.com/", "long " * 300_000), (7, "http://e.example.com/", "ünï\x00\x01\r\n中"),
    (8, "u", "twice"), (8, "u", "twice"), (None, "http://n.example.com/", "nobody"), (None, "u", "<p>one</p>"),
]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_arc_of_both_versions_is_parsed_by_declared_lengths():
    content = b"200 x\n\n2 0 fake\nhttp://z 1 2 3 4\n"
    for version in "12":
        data = arc.arc_file(version, [("http://a/b c", content), (None, b""), ("x", b"\n\n")])
        for own in (data, gzip.compress(data)):
            found = list(arc.arc_records(own))
            assert [(line["url"], block) for line, block in found] == [("http://a/b%20c", content), ("-", b""), ("x", b"\n\n")]
    assert arc.arc_file("2", [("u", b"x")]).split(b"\n")[4].split(b" ")[-1] == b"1"


def test_damaged_archives_are_refused():
    good = arc.arc_file("1", [("http://a/", b"abc")])
    for bad in (good[:-3], good.replace(b"filedesc:", b"filexxxx:"), good.replace(b"text/html 3", b"text/html x 3")):
        with pytest.raises(ValueError):
            list(arc.arc_records(bad))
    with pytest.raises(ValueError):
        list(arc.warc_records(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"])))


def test_records_of_other_content_are_resources(spark):
    files = spark.createDataFrame([(bytearray(arc.arc_file("1", [("ftp://a/b", b"plain"), ("ftp://a/c", b"plain")])),), (None,)], "content binary")
    found = arc.convert(files).collect()
    assert [(r.http, r.payload_digest, r.payload_at, r.key) for r in found] == [(False, digest(b"plain"), 0, None)] * 2
    assert found[0].record_id != found[1].record_id and found[0].date == "2000-01-01T00:00:00Z"
    path = workspace(spark, "warc")
    arc.write_warc(arc.as_warc(arc.convert(files)), path)
    assert [r.record_type for r in arc.read_warc(spark, path).collect()] == ["resource"] * 2


@pytest.mark.parametrize("per_file", [1, 4, 1000])
def test_round_trip(spark, per_file):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").repartition(2)
    path = workspace(spark, "warc")
    arc.write_warc(arc.as_warc(arc.convert(arc.to_arc(pages, "page_id", "url", "html", segment_bytes=50))), path, per_file)
    got = arc.read_warc(spark, path).collect()
    assert len(got) == len(PAGES)
    kept = {(r.key, bytes(r.payload)) for r in got if r.record_type == "response"}
    body = {(p[0], (p[2] or "").encode()) for p in PAGES}
    least = {}
    for k, b in body:
        if k is not None:
            least[b] = min(least.get(b, k), k)
    assert kept == {(None if k is None else str(k), b) for k, b in body if least.get(b) == k}
    for r in got:
        if r.record_type == "revisit":
            assert r.payload is None and r.refers_to is not None


def test_pages_read_back(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, key string")
    got = sorted(arc.archived(pages).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    least = {None: None}
    expected = []
    for k, _, html in PAGES:
        same = [p[0] for p in PAGES if (p[2] or "") == (html or "") and p[0] is not None]
        least = min(same, default=None)
        data = (html or "").encode()
        again = least is not None and k != least
        expected.append((k, len(data), digest(data), "revisit" if again else "response", least if again else None))
    expected.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got] == expected
    assert arc.archived(pages.filter(F.lit(False))).count() == 0
