import gzip
import zlib
import hashlib
import io

import pytest

from vellum.llm import warc


def arc(version, records):
    return warc.write_arc(iter(records), version)


RECORDS = [
    ("http://a.example/x y", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\nbody\n\n</p>"),
    ("dns:a.example", "8.8.8.8", "200102030405", "text/dns", b"20010203\na.example. 1 IN A 1.2.3.4\n"),
    ("http://a.example/é", "1.2.3.4", "99999999999999", "image/gif", b"HTTP/1.1 404 Not Found"),
    ("http://empty.example/", "0.0.0.0", "20010203040506", "text/plain", b""),
]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records(version):
    parsed = list(warc.parse_arc(io.BytesIO(arc(version, RECORDS))))
    assert parsed[0][0]["URL"].startswith("filedesc:")
    assert [(r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], b) for r, b in parsed[1:]] == RECORDS
    assert all(("Result-code" in r) == (version == 2) for r, _ in parsed[1:])
    made = [warc.convert(r, b) for r, b in parsed]
    assert [m["type"] for m in made] == ["warcinfo", "response", "resource", "response", "resource"]
    assert made[1]["date"] == "2001-02-03T04:05:06Z" and made[2]["date"] == "2001-02-03T04:05:00Z" and made[3]["date"] == "1970-01-01T00:00:00Z"
    assert made[1]["payload"] == b"<p>\r\n\r\nbody\n\n</p>" and made[1]["payload_sha1"] == hashlib.sha1(made[1]["payload"]).digest()
    assert made[1]["mime"] == "application/http;msgtype=response" and made[2]["mime"] == "text/dns"


@pytest.mark.parametrize("data", [b"http://x 1.1.1.1 20010101000000 text/html 3\nabc\n", arc(1, RECORDS[:1])[:-20], arc(1, []) + b"nonsense\n", b"filedesc://x 0.0.0.0 20010101000000 text/plain 4\nabcd\n"])
def test_bad_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(data)))


def test_ids_hold_page_ids():
    for page in (0, 1, -1, 15, 16, 2**63 - 1, -(2**63), 123456789):
        made = warc.record_id(page, b"seed")
        assert warc.page_of(made) == page and made[24] == "8" and made[29] in "89"
        assert made == warc.record_id(page, b"seed")
    assert warc.page_of(warc.record_id(None, b"seed")) is None


def plain(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        keeper = max(same) if same and len(data) >= 1000 and sum((h or "") == (html or "") for _, _, h in rows) > 1 else None
        revisit = keeper is not None and page != keeper
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


def fixture():
    big, other = "é" * 600 + "\r\n\r\nWARC/1.1\r\n", "x" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/", big), (9, None, big), (3, "u v", "x" * 999), (4, "", "x" * 999), (5, "http://c/\n", other), (5, "http://c/", other), (-7, "http://d/", other)]
    return rows + [(None, "n", big), (6, "e", None), (7, "e", ""), (None, "only null", "y" * 2000), (None, "only null", "y" * 2000), (8, "long", "z\n" * 500_000)]


def test_pages(spark):
    df = spark.createDataFrame([(*r, "x") for r in fixture()], "page_id long, url string, html string, record_type string")
    found = warc.pages_through_archives(df)
    assert sorted((tuple(r)[:5] for r in found.collect()), key=repr) == plain(fixture())
    assert warc.pages_through_archives(df.limit(0)).count() == 0


def test_shuffled_join_of_repeats(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    df = spark.createDataFrame(fixture(), "page_id long, url string, html string")
    assert sorted((tuple(r)[:5] for r in warc.pages_through_archives(df).collect()), key=repr) == plain(fixture())


def test_files_are_whole_archives(spark, tmp_path):
    df = spark.createDataFrame(fixture(), "page_id long, url string, html string")
    records = warc.with_revisits(warc.convert_archives(warc.pages_to_arcs(df)))
    warc.write_warcs(records, f"file://{tmp_path}/out")
    n = 0
    for file in (tmp_path / "out").glob("part-*"):
        raw = file.read_bytes()
        data = gzip.decompress(raw)
        first = zlib.decompressobj(31)
        assert b"WARC-Type: warcinfo" in first.decompress(raw)  # the first member is that record alone
        assert gzip.decompress(first.unused_data).startswith(b"WARC/1.1\r\nWARC-Type: re")
        at = 0
        while at < len(data):  # each record: head, declared bytes, two line ends
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            block = data[at + len(head) + 4 :][: int(fields[b"Content-Length"])]
            at += len(head) + 4 + len(block) + 4
            assert data[at - 4 : at] == b"\r\n\r\n"
            n += fields[b"WARC-Type"] != b"warcinfo"
    assert n == len(fixture())


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """A run of large pages fills more files; a larger page has one of its own."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    monkeypatch.setattr(warc, "ARC_BYTES", 60_000)
    rows = [(i, f"http://x/{i}", f"{i} " * (20_000 if i % 40 == 0 else 500 if i % 3 else 10)) for i in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    arcs = warc.pages_to_arcs(df)
    assert max(r.n for r in arcs.selectExpr("length(content) as n").collect()) < 110_000 and arcs.count() > 3
    warc.write_warcs(warc.with_revisits(warc.convert_archives(arcs)), f"file://{tmp_path}/out")
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "out").glob("part-*")]
    assert len(sizes) > 4 and sum(s > 52_000 for s in sizes) == 3  # pages 40, 80 and 120; page 0 is short
    assert sorted((tuple(r)[:5] for r in warc.pages_through_archives(df).collect()), key=repr) == plain(rows)


def test_archives_from_files(spark, tmp_path):
    (tmp_path / "a.arc").write_bytes(arc(1, RECORDS))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(arc(2, RECORDS)))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    rows = warc.convert_archives(files).collect()
    assert len(rows) == 8 and sorted({r.type for r in rows}) == ["resource", "response"]


def test_pages_under_filedesc_urls_are_pages(spark):
    pages = [(1, "filedesc://pages.arc", "<p>one</p>"), (2, "filedesc:", None), (3, "http://x/", "<p>three</p>"), (None, "filedesc://y z", "<p>four</p>")]
    found = warc.pages_through_archives(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.uri, r.record_type) for r in found) == sorted((str(p[0]), p[1], "response") for p in pages)
