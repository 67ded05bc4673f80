"""Legacy web archives (ARC) converted to WARC, and WARC files read back.

An ARC file is a run of records: one header line of space-separated fields, the last of which is
the length of the content that follows, and a line feed. The first record describes the file and
holds the names of the fields, which differ by version. The converter reads fields by those names
and content by its declared length only, so content may hold anything. For every record it makes
up what WARC asks for: an identifier, a timestamp, a type and digests.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import map_rows

#: Field names of the two header versions, in order.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads of fewer bytes are never made revisits.
MIN_REVISIT_BYTES = 100
#: Records in one WARC file.
RECORDS_PER_FILE = 1_000
#: Characters of pages written to one archive in memory.
ARCHIVE_CHARS = 1 << 20
#: Carries the source row through archives that have no field for it.
SOURCE_HEADER = "X-Source-Row"


def write_arc(rows: Iterator[tuple], version: str, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """One ARC file of (source, url, payload) rows as HTTP responses."""
    fields = ARC_FIELDS[version]
    about = f"{version} 0 wakeline\n{fields}\n".encode()
    extra = f" 200 - - 0 {name}" if version == "2" else ""
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(about)}\n".encode(), about, b"\n"]
    for source, url, payload in rows:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
        if source is not None:
            head += f"{SOURCE_HEADER}: {source}\r\n"
        content = head.encode() + b"\r\n" + payload
        at = quote(url or "urn:unknown", safe="%/:?#[]@!$&'()*+,;=~-._")
        out += [f"{at} 0.0.0.0 {date} text/html{extra} {len(content)}\n".encode(), content, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, content) of every record after the first; damaged rests are skipped.

    A header line that does not fit the version is passed over to the next line.
    """
    names: list[str] = []
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not values[-1].isdecimal() or (names and len(values) != len(names)):
            at = end + 1
            continue
        start, length = end + 1, int(values[-1])
        content = data[start:start + length]
        if len(content) < length:
            return
        if not names:
            if not values[0].startswith("filedesc:"):
                return
            lines = content.decode("utf-8", "replace").splitlines()
            version = lines[0].split(" ")[0] if lines else "1"
            names = (lines[1] if len(lines) > 1 else ARC_FIELDS.get(version, ARC_FIELDS["1"])).split(" ")
        else:
            yield dict(zip(names, values)), content
        at = start + length
        if data[at:at + 1] == b"\n":
            at += 1


def warc_date(arc_date: str) -> str:
    """ISO time of an ARC date of 14 digits, or of 12 in older files; the epoch if it is neither."""
    for form in ("%Y%m%d%H%M%S", "%Y%m%d%H%M"):
        try:
            if len(arc_date) == len(datetime(2000, 1, 1).strftime(form)):
                return datetime.strptime(arc_date, form).replace(tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            break
    return "1970-01-01T00:00:00Z"


def split_http(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower case), header block and payload of an HTTP response."""
    head, mark, payload = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, head + mark, payload


def convert(archives: DataFrame) -> DataFrame:
    """WARC records of ARC files (column content): the fields of each record and its HTTP parts.

    Null and empty files have no records. Identifiers are name-based over all that the record
    is, so converting again gives the same ones.
    """

    def make():
        def work(columns):
            out: list[list] = [[] for _ in range(8)]
            for data in columns[0]:
                for fields, content in read_arc(data or b""):
                    http, head, payload = split_http(content)
                    source = http.get(SOURCE_HEADER.lower())
                    url, date = fields["URL"], warc_date(fields["Archive-date"])
                    digest = hashlib.sha256(payload).hexdigest()
                    name = " ".join([url, date, source or "", digest])
                    row = (int(source) if source is not None else None, url, date,
                           f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", head.decode("utf-8", "replace"),
                           payload.decode("utf-8", "replace"), len(payload), digest)
                    for column, value in zip(out, row):
                        column.append(value)
            return out

        return work

    return map_rows(archives.select("content"), make,
                    "source long, url string, date string, record_id string, head string, payload string, "
                    "payload_bytes long, payload_digest string")


def revisits(records: DataFrame) -> DataFrame:
    """Add refers_to: the smallest source with an equal payload, where the record is a revisit.

    Payloads below the limit are always responses, and so are repeated rows of the smallest source.
    """
    large = records.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    first = (large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("source").alias("first"))
             .filter((F.col("n") > 1) & F.col("first").isNotNull()).select("payload_digest", "first"))
    joined = records.join(first, "payload_digest", "left")
    again = (F.col("payload_bytes") >= MIN_REVISIT_BYTES) & ~F.col("source").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(F.col("first").isNotNull() & again, F.col("first"))).drop("first")


def write_warc(records: DataFrame, path: str) -> None:
    """Write gzipped WARC files; every record is a WARC header block and an HTTP response.

    A revisit holds the HTTP header only, and names the digest and the source it repeats.
    """
    is_revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(is_revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("X-Refers-To-Source", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    (records.select(F.concat(header, block).alias("value")).write
     .option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, by declared lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        start = end + 4
        at = start + int(fields.get("content-length", 0))
        yield fields, data[start:at]


def read_warc(spark, path: str) -> DataFrame:
    """source, payload_bytes, payload_digest, record_type and refers_to of every record of a folder.

    Sizes and digests of responses are taken from the payload that was read; those of revisits
    are the declared ones of the payload they stand for.
    """
    import gzip

    files = spark.read.format("binaryFile").load(path).select("content")

    def make():
        def work(columns):
            out: list[list] = [[] for _ in range(7)]
            for data in columns[0]:
                for fields, block in parse_warc(gzip.decompress(data)):
                    http, _, payload = split_http(block)
                    source, kind = http.get(SOURCE_HEADER.lower()), fields["warc-type"]
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size, digest = int(http["content-length"]), fields["warc-payload-digest"].partition(":")[2]
                    refers = fields.get("x-refers-to-source")
                    for column, value in zip(out, (
                            int(source) if source is not None else None, size, digest, kind,
                            int(refers) if refers else None, fields["warc-record-id"],
                            unquote(fields["warc-target-uri"]))):
                        column.append(value)
            return out

        return work

    return map_rows(files, make, "source long, payload_bytes long, payload_digest string, record_type string, "
                                 "refers_to long, record_id string, url string")


def to_archives(pages: DataFrame) -> DataFrame:
    """ARC files (content) of pages (page_id, url, html), of either version; null html is empty."""

    def make():
        count = [0]

        def work(columns):
            out, part, size = [], [], 0
            for source, url, html in zip(*columns):
                payload = (html or "").encode("utf-8")
                part.append((source, url, payload))
                size += len(payload)
                if size >= ARCHIVE_CHARS:
                    count[0] += 1
                    out.append(write_arc(part, "12"[count[0] % 2]))
                    part, size = [], 0
            if part:
                count[0] += 1
                out.append(write_arc(part, "12"[count[0] % 2]))
            return [out]

        return work

    return map_rows(pages.select("page_id", "url", F.col("html").cast("string")), make, "content binary")
