"""Legacy archives to WARC: ARC files of both versions are parsed by their declared lengths and
rewritten as WARC records with synthesised identifiers, timestamps, types and digests.

Archives are plain files in the shared folder. An ARC record ends with a line
break and a WARC record with two CRLF, which is what the text writer puts after
each row, so that Spark writes both formats without a library of its own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm.spread import attach, maybe_among
from deskspark.sources.scratch import freeze, new_path

# The header lines of ARC version blocks and the fields of their URL records.
ARC_1 = "1 0 {origin}\nURL IP-address Archive-date Content-type Archive-length\n"
ARC_2 = (
    "2 0 {origin}\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
    "Archive-length\n"
)
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SOFTWARE = "deskspark"
NO_URL = "urn:x-no-url"
# Records of one ARC or WARC file at most, version blocks included.
FILE_RECORDS = 4096

RECORD = (
    "archive string, offset bigint, kind string, url string, ip string, date string, mime string, status string, "
    "http string, payload binary, payload_bytes bigint, payload_digest string, payload_key binary, page_id bigint"
)


def _safe(url: str | None) -> str:
    """A URL without blanks or line breaks, which would end the field."""
    return "".join("%%%02X" % ord(c) if c in " \t\r\n" else c for c in url) if url else NO_URL


def _arc_rows(origin: str):
    """Task code: (page_id, url, html) in, ARC records without their final line break out."""

    def record(version: int, page_id: int | None, url: str | None, html: str | None) -> bytes:
        payload = (html or "").encode()
        head = CRLF.join(
            [
                "HTTP/1.1 200 OK",
                "Content-Type: text/html; charset=utf-8",
                *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
                f"Content-Length: {len(payload)}",
                CRLF,
            ]
        ).encode()
        fields = [_safe(url), "0.0.0.0", "20200101000000", "text/html"]
        if version == 2:
            fields += ["200", "-", "-", "0", origin]
        line = " ".join([*fields, str(len(head) + len(payload))]) + "\n"
        return line.encode() + head + payload

    def block(version: int) -> bytes:
        body = (ARC_1 if version == 1 else ARC_2).format(origin=origin).encode()
        fields = [f"filedesc://{origin}.arc", "0.0.0.0", "20200101000000", "text/plain"]
        if version == 2:
            fields += ["200", "-", "-", "0", origin]
        return (" ".join([*fields, str(len(body))]) + "\n").encode() + body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One version per file; its block is the first of the FILE_RECORDS rows after which the writer
        # starts the next file, wherever the batches end.
        written = 0
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                version = 1 + written // FILE_RECORDS % 2
                if written % FILE_RECORDS == 0:
                    rows.append(block(version))
                    written += 1
                rows.append(record(version, page_id, url, html))
                written += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    return run


def write_arc(pages: DataFrame, path: str, origin: str = SOFTWARE) -> None:
    """ARC files, gzipped, one or more per partition: what a legacy crawl would hold of ``page_id, url, html``."""
    rows = pages.select("page_id", "url", "html").mapInArrow(_arc_rows(origin), "value binary")
    _write_text(rows, path, "\n")


def _write_text(rows: DataFrame, path: str, end: str) -> None:
    rows.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", end).option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file. A version block says which fields a URL record has; the declared length,
    its last field, says where the record ends."""
    at, names = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at {at}")
        line = data[at:end].decode()
        if not line.strip():
            at = end + 1
            continue
        fields = line.split(" ")
        length = int(fields[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"the record at {at} is cut off")
        if line.startswith("filedesc:"):
            version, names = _version(body)
            yield {"offset": at, "kind": "filedesc", "version": version, "body": body, "URL": fields[0]} | {
                "Archive-date": fields[2]
            }
        else:
            if names is None:
                raise ValueError("a record comes before the version block")
            if len(fields) != len(names):
                raise ValueError(f"the record at {at} has {len(fields)} fields, not {len(names)}")
            yield {"offset": at, "kind": "record", "version": version, "body": body} | dict(zip(names, fields))
        at = end + 1 + length


def _version(block: bytes) -> tuple[int, list[str]]:
    first, _, rest = block.decode().partition("\n")
    version = int(first.split(" ")[0])
    names = rest.split("\n")[0].split(" ")
    if version not in (1, 2) or names[0] != "URL" or names[-1] != "Archive-length":
        raise ValueError(f"unknown version block {first!r}")
    return version, names


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = body.partition(b"\r\n\r\n")
    return (head + mark, payload) if body.startswith(b"HTTP/") and mark else (b"", body)


def _header(head: str, name: str) -> str | None:
    for line in head.split(CRLF)[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _records(payloads: bool = True):
    """Task code: (path, content) of ARC files in, RECORD rows out, a few at a time."""

    def row(path: str, r: dict) -> dict:
        http, payload = _split_http(r["body"]) if r["kind"] == "record" else (b"", r["body"])
        page = _header(http.decode(), "x-page-id")
        return {
            "archive": path.rsplit("/", 1)[-1],
            "offset": r["offset"],
            "kind": r["kind"],
            "url": r["URL"],
            "ip": r.get("IP-address", "0.0.0.0"),
            "date": r["Archive-date"],
            "mime": r.get("Content-type", "text/plain"),
            "status": r.get("Result-code"),
            "http": http.decode(),
            "payload": payload if payloads else None,
            "payload_bytes": len(payload),
            "payload_digest": _sha1(payload),
            # Equal payloads are told apart by both digests.
            "payload_key": hashlib.sha1(payload).digest() + hashlib.sha256(payload).digest(),
            "page_id": int(page) if page else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(RECORD)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = []
                for r in parse_arc(_unzipped(content.as_py())):
                    held.append(row(path, r))
                    if len(held) == 64:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


def _unzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the ARC files of a folder (columns: RECORD)."""
    return _files(spark, path).mapInArrow(_records(), RECORD)


def _warc_rows():
    """Task code: RECORD rows with the id and place of the record that is kept in, WARC records without their
    final CRLFs out. A record's id follows from its place, so that records of one page have ids of their own."""

    def record_id(*parts) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"

    def record(r: dict) -> bytes:
        d = r["date"].ljust(14, "0")
        date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
        if r["kind"] == "filedesc":
            block = f"software: {SOFTWARE}{CRLF}format: WARC File Format 1.0{CRLF}".encode() + r["payload"]
            head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(r["archive"], r["offset"], r["url"]))]
            head += [("WARC-Filename", r["archive"]), ("Content-Type", "application/warc-fields")]
        else:
            first = r["keep_id"] is None or r["keep_id"] == r["page_id"]
            block = r["http"].encode() + (r["payload"] if first else b"")
            head = [
                ("WARC-Type", "response" if first else "revisit"),
                ("WARC-Record-ID", record_id(r["archive"], r["offset"])),
                ("WARC-Target-URI", r["url"]),
                ("WARC-IP-Address", r["ip"]),
                ("Content-Type", "application/http; msgtype=response" if r["http"] else r["mime"]),
                ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                ("X-Payload-Length", str(r["payload_bytes"])),
            ]
            if r["page_id"] is not None:
                head.append(("X-Page-Id", str(r["page_id"])))
            if not first:
                head += [
                    ("WARC-Profile", PROFILE),
                    ("WARC-Refers-To", record_id(r["keep_archive"], r["keep_offset"])),
                    ("X-Refers-To-Page-Id", str(r["keep_id"])),
                ]
        head += [("WARC-Date", date), ("WARC-Block-Digest", f"sha1:{_sha1(block)}"), ("Content-Length", str(len(block)))]
        return ("WARC/1.0" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head) + CRLF).encode() + block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = [record(r) for r in batch.slice(i, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    return run


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """WARC files from ARC files. Of records with equal payloads the one of the largest page id becomes
    the response and the others revisits of it; where none has an id, all are responses."""
    # Records without an id are told apart, and spread, by where they are.
    place = F.coalesce("page_id", F.xxhash64("archive", "offset")).alias("_place")
    records = read_arc(spark, arc_path).select("*", place)
    hashed = F.xxhash64("payload_key")
    # A narrow pass: payloads stay in the tasks.
    narrow = _files(spark, arc_path).mapInArrow(_records(payloads=False), RECORD)
    keys = freeze(narrow.where("kind = 'record'").select("payload_key", "page_id", place, "archive", "offset"))
    kept = F.max(F.struct("page_id", "archive", "offset")).alias("keep")
    groups = freeze(
        keys.groupBy("payload_key")
        .agg(kept, F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(
            "payload_key", "n", F.col("keep.page_id").alias("keep_id"), F.col("keep.archive").alias("keep_archive"),
            F.col("keep.offset").alias("keep_offset"),
        )
    )
    # Records that cannot have an equal stay where they are; the rest meet their group by page.
    named = freeze(
        attach(
            maybe_among(keys.drop("archive", "offset").withColumn("_hash", hashed), "_hash", groups.select(F.xxhash64("payload_key").alias("h"))),
            groups,
            "payload_key",
            "n",
            "_place",
            "inner",
        )
        .where("keep_id IS NOT NULL AND NOT page_id <=> keep_id")
        .select(
            F.col("page_id").alias("_page"), F.col("_place").alias("_at"), F.col("payload_key").alias("_key"),
            "keep_id", "keep_archive", "keep_offset",
        )
        .distinct()
    )
    same = (
        (F.col("_place") == F.col("_at"))
        & F.col("page_id").eqNullSafe(F.col("_page"))
        & (F.col("payload_key") == F.col("_key"))
    )
    joined = records.join(named, same, "left").drop("_page", "_at", "_key", "_place")
    rows = joined.mapInArrow(_warc_rows(), "value binary")
    _write_text(rows, warc_path, CRLF + CRLF)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by Content-Length; header names are lower-cased."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        head = {}
        for line in lines[1:]:
            key, _, value = line.partition(":")
            head[key.strip().lower()] = value.strip()
        length = int(head["content-length"])
        start = end + 4
        if data[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield head, data[start : start + length]
        at = start + length + 4


PAGE = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "record_id string, url string, date string, payload binary"
)


def _pages():
    """Task code: WARC files in, PAGE rows of responses and revisits out. Digests are checked."""

    def row(head: dict[str, str], block: bytes) -> dict:
        payload = _split_http(block)[1]
        if f"sha1:{_sha1(block)}" != head["warc-block-digest"]:
            raise ValueError(f"block digest of {head['warc-record-id']} does not match")
        full = head["warc-type"] == "response"
        if full and f"sha1:{_sha1(payload)}" != head["warc-payload-digest"]:
            raise ValueError(f"payload digest of {head['warc-record-id']} does not match")
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
        return {
            "page_id": int(page) if page else None,
            "payload_bytes": len(payload) if full else int(head["x-payload-length"]),
            "payload_digest": head["warc-payload-digest"].partition(":")[2],
            "record_type": head["warc-type"],
            "refers_to": int(refers) if refers else None,
            "record_id": head["warc-record-id"],
            "url": head["warc-target-uri"],
            "date": head["warc-date"],
            "payload": payload,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(PAGE)
        for batch in batches:
            for content in batch.column(1):
                held = []
                for head, block in parse_warc(_unzipped(content.as_py())):
                    if head["warc-type"] in ("response", "revisit"):
                        held.append(row(head, block))
                    if len(held) == 64:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit of the WARC files of a folder (columns: PAGE)."""
    return _files(spark, path).mapInArrow(_pages(), PAGE)


def archive(pages: DataFrame) -> DataFrame:
    """Pages through ARC files and the converter into WARC files, and what is read back from those.

    A null html is an empty payload; a null url is written as ``urn:x-no-url``.
    Rows that repeat a page_id are records of their own, each with its own record id: with equal payloads
    both are responses of that page, and revisits refer to one of them. A null page_id stays null: its record is a
    revisit where its payload also comes with an id, else a response. An empty
    table gives an empty result; other columns are not looked at.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
