import base64
import hashlib
from collections import defaultdict

import pytest

from docsift.llm import warc as w

RECORDS = [
    w.ArcRecord("http://a.example/x", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npay\n\r\n\r\nload", 1),
    w.ArcRecord("http://a.example/y", "1.2.3.4", "2001", "text/plain", b"no head\n\n1 2 3", 1),
    w.ArcRecord("http://a.example/z", "1.2.3.4", "200102", "text/plain", b"", 1),
]


def brute(rows, least):
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        if page_id is not None and len(data) >= least:
            groups[data].append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        best = max(groups.get(data, []), default=page_id)
        again = page_id is not None and len(data) >= least and best != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(map(repr, out))


def rows_of(df):
    return sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    got = list(w.parse_arc(w.write_arc(RECORDS, version)))
    assert [(r.url, r.ip, r.date, r.type, r.body, r.version) for r in got] == [(r.url, r.ip, r.date, r.type, r.body, version) for r in RECORDS]
    assert set(got[0].fields) == ({"code", "checksum", "location", "offset", "filename"} if version == 2 else set())


@pytest.mark.parametrize(
    "data",
    [b"http://a 1.2.3.4 2001 text/plain 3\nabc\n", w.write_arc(RECORDS, 1)[:-5], w.write_arc(RECORDS, 1).replace(b"text/plain 0\n", b"text/plain x\n"), w.write_arc(RECORDS[:1], 1).replace(b"a.example/x ", b"a.example/x y "), b"filedesc://x 0.0.0.0 2001 text/plain 4\n7 0 \n\n"],
)
def test_bad_arc_is_refused(data):
    with pytest.raises(w.ArcError):
        list(w.parse_arc(data))


def test_dates():
    assert w.arc_date("19961104") == "1996-11-04T00:00:00Z"
    assert w.arc_date("1996") == "1996-01-01T00:00:00Z"
    assert w.arc_date("19961104142103") == "1996-11-04T14:21:03Z"
    for bad in ("", "19961304", "1996-11", "199611041421031"):
        with pytest.raises(w.ArcError):
            w.arc_date(bad)


def test_warc_records():
    data = b"".join([w.to_warc(RECORDS[0]), w.to_warc(RECORDS[1]), w.to_warc(RECORDS[0], ("<urn:x>", "http://o", "2001-01-01T00:00:00Z"))])
    (one, body), (two, plain), (three, head) = w.parse_warc(data)
    assert one["warc-type"] == "response" and body == RECORDS[0].body
    assert two["warc-type"] == "resource" and plain == RECORDS[1].body and two["content-type"] == "text/plain"
    assert three["warc-type"] == "revisit" and head == b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" and three["warc-refers-to"] == "<urn:x>"
    assert one["warc-payload-digest"] == three["warc-payload-digest"] == "sha1:" + w.digest(b"pay\n\r\n\r\nload")
    assert one["warc-record-id"] == w.record_id(RECORDS[0].url, "2001-02-03T04:05:06Z", w.digest(b"pay\n\r\n\r\nload"))
    with pytest.raises(ValueError):
        list(w.parse_warc(data[:-3]))


@pytest.mark.parametrize(("least", "version"), [(0, 1), (3, 2)])
def test_round_trip_matches_brute_force(spark, least, version):
    rows = [(i, f"http://h/{i % 7} x", ["", None, "<p>é\r\n\r\nb</p>", "ab", "WARC/1.1\r\n\r\n"][i % 5], "x") for i in range(60)]
    rows += [(100 + i, None, f"own {i}\n", "y") for i in range(30)] + [(200, "u", "big " * 100_000, "z"), (3, "v", "ab", "z"), (3, "http://h/3 x", "ab", "q"), (None, "n", "", None), (None, "n", "lone", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, best string").repartition(3)
    assert rows_of(w.round_trip(pages, least, version)) == brute(rows, least)


def test_pages_match_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert rows_of(w.round_trip(pages)) == brute(rows, 0)
    assert w.round_trip(pages.limit(0)).count() == 0


def test_pages_of_one_url_and_payload_have_ids_of_their_own(spark, tmp_path):
    rows = [(1, "http://h/x", "same"), (2, "http://h/x", "same"), (3, "http://h/x", "same"), (4, "http://h/x", "other")]
    path = str(tmp_path / "warc")
    w.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    ids = {r.page_id: r.record_id for r in w.read_archives(spark, path).collect()}
    assert len(set(ids.values())) == 4
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    refers = {x.split(": ")[1] for x in text.split("\r\n") if x.startswith("WARC-Refers-To: ")}
    assert refers == {ids[3]}
