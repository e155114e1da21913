"""Legacy archive converter: ARC files (versions 1 and 2) to WARC.

The version block names the fields of the header lines that follow it; each record is its
line, then as many bytes as the line declares. A converted record gets an identifier, a
date, a type and digests that say the same in WARC. An archive is one value, of bounded
size, its records gzip members of their own; archives are written through Spark's own
writer, so that they land whole in any store and a lost executor loses nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, shared_path, spread, stash

#: Field names of the header lines by version of the format.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payload bytes from which equal payloads are revisits.
REVISIT_BYTES = 1000
#: Rows up to which the table of repeated payloads is broadcast (some 60 bytes each).
BROADCAST_ROWS = 200_000
#: Parts that the table of repeated payloads and its records are dealt to beyond that.
SALT = 16
#: Bytes of records after which a WARC file is full, which a reader holds as a whole.
ARCHIVE_BYTES = 16 << 20
#: Records and bytes of records after which an ARC archive is full.
ARC_RECORDS, ARC_BYTES = 256, 8 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- ARC --------------------------------------------------------------------------------


def arc_header(version: int, url: str, ip: str, date: str, mime: str, length: int, status: int = 200) -> bytes:
    more = f" {status} - - 0 - " if version == 2 else " "
    return f"{re.sub(r'[\r\n]', lambda m: f'%{ord(m[0]):02X}', url)} {ip} {date} {mime}{more}{length}\n".encode()


def write_arc(records: Iterator[tuple[str, str, str, str, bytes]], version: int, name: str = "pages.arc") -> bytes:
    """An ARC archive of (url, ip, 14-digit date, content type, block)."""
    about = f"{version} 0 vellum\n{ARC_FIELDS[version]}\n".encode()
    out = [arc_header(version, f"filedesc://{name}", "0.0.0.0", "19960101000000", "text/plain", len(about)), about, b"\n"]
    for url, ip, date, mime, block in records:
        out += [arc_header(version, url, ip, date, mime, len(block)), block, b"\n"]
    return b"".join(out)


def parse_arc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, the version block first.

    Fields are split from the right, as a URL may hold spaces. A block shorter than
    declared is an error, and so are an archive without version block and a header line
    that lacks fields."""
    fields = ARC_FIELDS[1].split()
    first = True
    while line := file.readline():
        if not line.strip(b"\r\n"):
            continue
        text = line.rstrip(b"\r\n").decode("utf-8", "surrogateescape")
        if first and not text.startswith("filedesc:"):
            raise ValueError("no ARC version block")
        for names in (fields, ARC_FIELDS[2].split()) if first else (fields,):
            parts = text.rsplit(" ", len(names) - 1)
            if len(parts) == len(names) and parts[-1].isdigit() and (not first or " " not in parts[0]):
                break
        else:
            raise ValueError(f"not an ARC header line: {text[:80]!r}")
        record = dict(zip(names, parts))
        block = file.read(int(record["Archive-length"]))
        if len(block) < int(record["Archive-length"]):
            raise ValueError(f"record of {record['URL'][:80]!r} is cut off")
        if first:
            lines = block.decode("utf-8", "replace").splitlines()
            if len(lines) < 2 or not lines[0].split()[:1] or not lines[0].split()[0].isdigit():
                raise ValueError("bad ARC version block")
            fields, first = lines[1].split(), False
        yield record, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and payload; no head if the block is not HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def head_value(head: bytes, name: str) -> str | None:
    found = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)\r?$", head.decode("latin-1"))
    return found[1] if found else None


def convert(record: dict[str, str], block: bytes, first: bool | None = None) -> dict:
    """What WARC says of an ARC record: type, uri, date (ISO), ip, mime, head, payload,
    and SHA-1 digests of block and payload. The ``first`` of an archive is its version
    block, whatever later URLs say; where that is not known, the URL tells."""
    head, payload = split_http(block)
    digits = (re.sub(r"\D", "", record["Archive-date"]) + "00000000000000")[:14]
    d = digits if re.fullmatch(r"\d{4}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])([01]\d|2[0-3])[0-5]\d[0-5]\d", digits) else "19700101000000"
    first = record["URL"].startswith("filedesc:") if first is None else first
    kind = "warcinfo" if first else "response" if head else "resource"
    return {
        "type": kind,
        "uri": record["URL"],
        "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z",
        "ip": record["IP-address"],
        "mime": "application/http;msgtype=response" if head else record["Content-type"],
        "head": head,
        "payload": payload,
        "block_sha1": hashlib.sha1(block).digest(),
        "payload_sha1": hashlib.sha1(payload).digest(),
    }


# -- WARC -------------------------------------------------------------------------------


def record_id(page_id: int | None, seed: bytes) -> str:
    """A version 8 UUID (custom bits): 64 bits of the page id, the others of a hash of
    ``seed``; the same record always gets the same one. Without page id, hash only, under
    variant bits that page ids never have."""
    rest = int.from_bytes(hashlib.sha1(seed).digest()[:8])
    page = (rest if page_id is None else page_id) & (1 << 64) - 1
    # 48 bits | version 8 | 12 bits | variant 10 | a flag | 4 bits of the page id | hash
    bits = (page >> 16) << 80 | 8 << 76 | ((page >> 4) & 0xFFF) << 64 | 0b10 << 62 | (page_id is None) << 61 | (page & 0xF) << 57 | rest & (1 << 57) - 1
    h = f"{bits:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(identifier: str) -> int | None:
    bits = int(identifier.removeprefix("<urn:uuid:").removesuffix(">").replace("-", ""), 16)
    if bits >> 61 & 1:
        return None
    page = (bits >> 80) << 16 | (bits >> 64 & 0xFFF) << 4 | bits >> 57 & 0xF
    return page - (1 << 64) if page >> 63 else page


def warc_record(r: dict, page_id: int | None, refers_to: int | None) -> bytes:
    """A record without the two line ends that close it; a revisit if it refers to a
    page, which keeps the HTTP head and the digest of the full payload only."""
    block = r["head"] + (r["payload"] if refers_to is None else b"")
    digest = lambda x: "sha1:" + base64.b32encode(x).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['type'] if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, r['payload_sha1'] + (r['uri'].encode('utf-8', 'surrogateescape') if page_id is None else b''))}",
        f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['uri']}",
        f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: {digest(r['payload_sha1'])}",
        f"WARC-Block-Digest: {digest(r['block_sha1'] if refers_to is None else hashlib.sha1(block).digest())}",
        f"Content-Type: {r['mime']}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, r['payload_sha1'])}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def parse_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    while line := file.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.lower()] = value.strip()
        block = file.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("record is cut off")
        yield headers, block


# -- DataFrames -------------------------------------------------------------------------


def pages_to_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """ARC archives (column ``content``) of at most ARC_RECORDS pages and, but for a single
    larger page, ARC_BYTES, of either version in turn. A null html is an empty payload, a
    null url ``unknown:``; a null id is left out of the HTTP head."""

    def make():
        turn = [0]

        def archive(records):
            turn[0] += 1
            return pa.RecordBatch.from_arrays([pa.array([write_arc(iter(records), 1 + turn[0] % 2)], pa.binary())], ["content"])

        def step(batch):
            records, size = [], 0
            for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                payload = (html.as_py() or "").encode()
                own = f"X-Page-Id: {page_id.as_py()}\r\n" if page_id.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n"
                if records and (len(records) >= ARC_RECORDS or size + len(payload) > ARC_BYTES):
                    yield archive(records)
                    records, size = [], 0
                records.append((url.as_py() or "unknown:", "0.0.0.0", "20000101000000", "text/html", head.encode() + payload))
                size += len(payload)
            if records:
                yield archive(records)

        return step

    return map_arrow(pages.select(F.col(id_col).cast("long"), url_col, html_col), make, "content binary")


def unzipped(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


_RECORD = "page_id long, payload_bytes long, type string, uri binary, date string, ip string, mime string, head binary, payload binary, block_sha1 binary, payload_sha1 binary"


def convert_archives(arcs: DataFrame) -> DataFrame:
    """Records of ARC archives (``content``, plain or gzip, as ``binaryFile`` reads them);
    page_id is that of the HTTP head, if any. Version blocks are left out: each WARC file
    gets a warcinfo record of its own."""
    names = [c.split()[0] for c in _RECORD.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * 4]

    def make():
        def step(batch):
            for content in batch.column(0):
                if not content.is_valid:
                    continue
                rows = []
                for i, (record, block) in enumerate(parse_arc(unzipped(content.as_py()))):
                    r = convert(record, block, i == 0)
                    if r["type"] != "warcinfo":
                        page = head_value(r["head"], "X-Page-Id")
                        r |= {"page_id": int(page) if page else None, "payload_bytes": len(r["payload"]), "uri": r["uri"].encode("utf-8", "surrogateescape")}
                        rows.append([r[n] for n in names])
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        return step

    return map_arrow(arcs.select("content"), make, _RECORD)


def with_revisits(records: DataFrame) -> DataFrame:
    """Adds refers_to: of equal payloads (SHA-1 and length) of at least REVISIT_BYTES, all
    but those of the largest page_id refer to it. Without any page_id none does; rows that
    share the largest are all responses."""
    groups = records.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_sha1", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    groups = stash(groups.filter("n > 1 and keeper is not null").drop("n"), "repeated_payloads")
    if groups.count() <= BROADCAST_ROWS:
        joined = records.join(F.broadcast(groups), ["payload_sha1", "payload_bytes"], "left")
    else:  # a payload of very many records is dealt to SALT tasks
        parts = groups.select("*", F.explode(F.array(*map(F.lit, range(SALT)))).alias("salt"))
        salted = records.withColumn("salt", F.pmod(F.xxhash64("page_id", "uri"), F.lit(SALT)).cast("int"))
        joined = salted.join(parts, ["payload_sha1", "payload_bytes", "salt"], "left")
    refers = F.when(F.coalesce(F.col("page_id") < F.col("keeper"), F.lit(True)), F.col("keeper"))
    return joined.select(*records.columns, refers.alias("refers_to"))


def write_warcs(records: DataFrame, path: str) -> None:
    """Writes WARC archives, each with a warcinfo record first, full at ARCHIVE_BYTES (a
    single larger record has one of its own). Each record is a gzip member. An archive is
    one value of the text writer, which closes it by a zero byte: padding to gzip."""
    fields = b"software: vellum\r\n"

    def run(batches):
        task, files = TaskContext.get().partitionId(), 0
        out, size = [], 0

        def member(record: bytes) -> bytes:
            return gzip.compress(record + b"\r\n\r\n", 6, mtime=0)

        def archive():
            about = "WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: %s\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % (record_id(None, f"{path} {task} {files}".encode()), len(fields))
            return pa.RecordBatch.from_arrays([pa.array([member(about.encode() + fields) + b"".join(out)], pa.binary())], ["value"])

        for batch in batches:
            for row in zip(*batch.columns):
                r = {n: v.as_py() for n, v in zip(batch.schema.names, row)}
                r["uri"] = r["uri"].decode("utf-8", "surrogateescape")
                record = warc_record(r, r["page_id"], r["refers_to"])
                if out and size + len(record) > ARCHIVE_BYTES:
                    yield archive()
                    out, size, files = [], 0, files + 1
                out.append(member(record))
                size += len(record)
        if out:
            yield archive()

    lines = records.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_warcs(df: DataFrame) -> DataFrame:
    """Of WARC archives (``content``): page_id, payload_bytes, payload_digest (hex),
    record_type, refers_to, uri, date. Digests of what is there are checked."""

    def make():
        def step(batch):
            for content in batch.column(0):
                rows = []
                for headers, block in parse_warc(unzipped(content.as_py())):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    sha1 = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:"))
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).digest() != sha1:
                        raise ValueError("payload and digest differ")
                    page = head_value(head, "X-Page-Id")
                    n = int(head_value(head, "Content-Length") or 0) if revisit else len(payload)
                    rows.append((int(page) if page else None, n, sha1.hex(), headers["warc-type"], page_of(headers["warc-refers-to"]) if revisit else None, headers["warc-target-uri"].encode("utf-8", "replace").decode(), headers["warc-date"]))
                columns = list(zip(*rows)) or [()] * 7
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date"])

        return step

    return map_arrow(df.select("content"), make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, date string")


def pages_through_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ARC archives, converted to WARC files in the shared folder, read back: one
    row per page (see ``read_warcs``).

    A null html is an empty payload. Ids may be null (kept as null) or repeat; line ends in
    a URL are escaped. An empty table gives an empty one. Further columns are left out. A
    payload of any length up to what a row may hold (2 GB) counts whole."""
    spark, pages = pages.sparkSession, spread(pages)
    records = with_revisits(stash(convert_archives(pages_to_arcs(pages, id_col, url_col, html_col)), "arc_records"))
    path = shared_path(spark, "warc")
    write_warcs(records, path)
    return read_warcs(spark.read.format("binaryFile").load(path))
