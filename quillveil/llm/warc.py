"""Legacy web archives: ARC files read record by record and rewritten as WARC 1.1.

An ARC file opens with a `filedesc:` record that declares its version. Header lines of version 1 have the fields URL, IP,
date, content type and length; those of version 2 have URL, IP, date, content type, result code, checksum, location, offset,
file name and length. The declared length, in bytes, bounds each payload, whatever it holds. Fields are counted from the
right, so blanks in a URL do no harm.

The WARC record of each ARC record gets an identifier (made of URL, date and digest if others refer to it, else random), the date in ISO form, the type
(`response` or `revisit`) and the bare hexadecimal SHA-1 of the payload. A revisit has no block; its header states the digest
and length of the payload and the identifier of the record that holds it.

Archives are written as a table of parts in the folder that all executors share (spark.checkpoint.dir), each row one archive
of whole records, and read back from there.

Edge cases: a null payload is empty; a null URL or page_id is an empty field; an empty table gives an archive of no record;
repeated rows are records of their own with identifiers of their own, and of a digest's rows one is the response, with the
largest page_id, then URL. A record cut short raises ValueError with its offset.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillveil.llm.store import scratch, shared_folder, stored
from quillveil.llm.workers import lean

#: Payloads below this many bytes are never replaced by a revisit.
LEAST = 1000
#: Digests that occur more than once are broadcast up to this many (about 60 MB), beyond it joined in so many parts.
FEW, SALTS = 300_000, 32
#: Crawl date of rows that have none.
DATE = "19960101000000"
_FIELDS = {1: ("ip", "date", "type", "length"), 2: ("ip", "date", "type", "code", "checksum", "location", "offset", "file", "length")}


_ROLES = pa.list_(pa.struct([("holder", pa.bool_()), ("refers_to", pa.string())]))


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    type: str
    payload: bytes


def arc_header(version: int, name: str) -> bytes:
    """The version block that opens an ARC file."""
    columns = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 quillveil\n{columns}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain " + ("" if version == 1 else f"200 - - 0 {name} ") + f"{len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, url: str, payload: bytes, kind: str = "text/html", ip: str = "0.0.0.0", date: str = DATE) -> bytes:
    middle = "" if version == 1 else f"200 {hashlib.md5(payload).hexdigest()} - 0 - "
    return f"{url} {ip} {date} {kind} {middle}{len(payload)}\n".encode() + payload + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block."""
    at, version = 0, 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line at {at} has no end")
        line = data[at:end].decode().rstrip("\r")
        if not version:
            size = line.rpartition(" ")[2]
            body = data[end + 1 : end + 1 + int(size)] if size.isdigit() else b""
            if not line.startswith("filedesc:") or not (m := re.match(rb"(\d+) ", body)) or int(m[1]) not in _FIELDS:
                raise ValueError("not an ARC file of version 1 or 2")
            version, at = int(m[1]), end + 1 + len(body)
            continue
        url, *values = line.rsplit(" ", len(_FIELDS[version]))
        if len(values) != len(_FIELDS[version]) or not values[-1].isdigit():
            raise ValueError(f"header line at {at} has not the fields of version {version}")
        fields = dict(zip(_FIELDS[version], values, strict=True))
        payload = data[end + 1 : end + 1 + int(fields["length"])]
        if len(payload) < int(fields["length"]):
            raise ValueError(f"record at {at} is cut short")
        yield ArcRecord(url, fields["ip"], fields["date"], fields["type"], payload)
        at = end + 1 + len(payload)


def record_id(url: str, date: str, digest: str) -> str:
    """The identifier of the one record that holds a payload to which others refer."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date} {digest} {url}')}>"


def to_warc(record: ArcRecord, refers_to: str | None = None, holder: bool = False) -> bytes:
    """A WARC record; `refers_to`, the URL of the record that holds an equal payload, makes it a revisit.

    A holder's identifier follows from its fields, so that revisits can name it; any other is drawn at random: repeated records
    have identifiers of their own.
    """
    digest, d = hashlib.sha1(record.payload).hexdigest(), record.date.ljust(14, "0")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(record.url, record.date, digest) if holder else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {record.url}",
        f"WARC-IP-Address: {record.ip}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: {record.type}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, record.date, digest)}",
            f"WARC-Refers-To-Target-URI: {refers_to}",
            f"X-Payload-Length: {len(record.payload)}",
        ]
    block = record.payload if refers_to is None else b""
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC header at {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in data[at:end].decode().split("\r\n")[1:])}
        start, size = end + 4, int(head["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut short")
        yield head, data[start : start + size]
        at = start + size + 4


def page_url(page_id: int | None, url: str | None) -> str:
    """The archive's URL of a page: its own, without blanks and control characters, and its id as fragment."""
    return quote(url or "", safe="!#$&'()*+,/:;=?@[]~") + f"#page={'' if page_id is None else page_id}"


def decide(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows page_id, url, html, holder (whether others may refer to it), refers_to and refers_url.

    Of equal payloads of `least` bytes the row with the largest page_id, then URL, holds the payload; the others refer to it.
    Only digests that occur more than once are looked up: a row for each is broadcast up to `FEW`, else joined in `SALTS`
    parts, for one payload may hold a third of all rows; rows without such a digest are no part of that join.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", "html").withColumn("_sha", F.when(F.length(body) >= least, F.sha1(body)))
    order = F.struct(F.col("page_id").alias("p"), F.coalesce("url", F.lit("")).alias("u"))
    narrow = rows.where("_sha is not null").groupBy("_sha", order.alias("o")).agg(F.count("*").alias("m"))
    kept = narrow.groupBy("_sha").agg(F.max("o").alias("_kept"), F.sum("m").alias("_n"), F.max_by("m", "o").alias("_same")).where("_n > 1").drop("_n")
    kept = stored(kept)
    if kept.count() <= FEW:
        joined = rows.join(F.broadcast(kept), "_sha", "left")
    else:
        parts = kept.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        some = rows.where("_sha is not null").withColumn("_part", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = some.join(parts, ["_sha", "_part"], "left").drop("_part")
        joined = joined.unionByName(rows.where("_sha is null"), allowMissingColumns=True)
    joined = joined.withColumn("_best", F.col("_kept").isNotNull() & F.col("_kept.p").eqNullSafe(F.col("page_id")) & (F.col("_kept.u") == F.coalesce("url", F.lit(""))))
    if kept.where("_same > 1").limit(1).count():  # of repeated rows one holds the payload
        again = joined.where("_best and _same > 1")
        first = F.row_number().over(W.partitionBy("_sha").orderBy("page_id")) == 1
        joined = joined.where("not (_best and _same > 1)").unionByName(again.withColumn("_best", first))
    other = F.col("_kept").isNotNull() & ~F.col("_best")
    return joined.select("page_id", "url", "html", F.col("_best").alias("holder"), F.when(other, F.col("_kept.p")).alias("refers_to"), F.when(other, F.col("_kept.u")).alias("refers_url"), other.alias("revisit"))


ROLES = "array<struct<holder:boolean,refers_to:string>>"


def to_arc(pages: DataFrame, archive_bytes: int = 8 << 20) -> DataFrame:
    """Pages as ARC files, of version 1 and 2 by turns: rows (archive, roles), what `decide` says of each record in order."""

    def run(batches):
        def emit(version, rows):
            arc = arc_header(version, "pages.arc") + b"".join(arc_record(version, u, p) for u, p, _ in rows)
            return pa.RecordBatch.from_arrays([pa.array([arc], pa.binary()), pa.array([[r for *_, r in rows]], _ROLES)], names=["archive", "roles"])

        rows, size, made = [], 0, 0
        for batch in batches:
            for page_id, url, html, holder, refers_to, refers_url, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                rows.append((page_url(page_id, url), payload, {"holder": holder, "refers_to": page_url(refers_to, refers_url) if revisit else None}))
                size += len(payload)
                if size >= archive_bytes:
                    yield emit(1 + made % 2, rows)
                    rows, size, made = [], 0, made + 1
        if rows:
            yield emit(1 + made % 2, rows)

    return pages.select("page_id", "url", "html", "holder", "refers_to", "refers_url", "revisit").mapInArrow(lean(run), f"archive binary, roles {ROLES}")


def convert(archives: DataFrame) -> DataFrame:
    """ARC files (archive, and roles, if there is such a column) to WARC files: rows (archive binary), one for each.

    Without roles every record is a response.
    """
    known = "roles" in archives.columns

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                roles = batch.column(1)[i].as_py() if known else repeat({"holder": False, "refers_to": None})
                out = b"".join(to_warc(r, x["refers_to"], x["holder"]) for r, x in zip(read_arc(batch.column(0)[i].as_py()), roles, strict=known))
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["archive"])

    return archives.select("archive", *(["roles"] if known else [])).mapInArrow(lean(run), "archive binary")


def write_archives(spark: SparkSession, pages: DataFrame) -> str:
    """Write the archives of `pages` into the shared folder; the path of their table."""
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    with scratch(spark):
        convert(to_arc(decide(pages))).write.option("compression", "zstd").parquet(path)
    return path


_PAGE = re.compile(r"#page=(-?\d*)$")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, date."""

    def run(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        page = lambda uri: int(m[1]) if (m := _PAGE.search(uri)) and m[1] else None
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in read_warc(data.as_py()):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"digest of {head['warc-record-id']} differs")
                    size = len(block) if kind == "response" else int(head["x-payload-length"])
                    uri = head["warc-target-uri"]
                    rows.append((page(uri), unquote(_PAGE.sub("", uri)), size, digest, kind, page(head.get("warc-refers-to-target-uri", "")), head["warc-record-id"], head["warc-date"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.select("archive").mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string")
