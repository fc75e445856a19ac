"""Legacy archive converter: ARC files to WARC files.

``write_arc`` packs records into ARC files, ``read_arc`` parses them by the version that each file declares: the header
line of version 1 has 5 fields, that of version 2 has 10, and the last of either is the length of the document, which is
read to the byte. ``convert`` synthesises what a WARC record needs and an ARC record lacks: a record id from the
archive's name and the record's offset, an ISO timestamp from the 14 digits, the type, and a SHA-256 digest of the
payload. ``write_warc`` and ``read_warc`` store and read the result. Files are gzip streams, written by Spark's text writer:
a row is a record, and what must stand behind a record is the line separator. Files are read as ``binaryFile``, so a
file must be under 2 GB; the writers make one per partition.

Record types are decided on a narrow table, without payloads: records are read once for their ids, digests and lengths,
only digests that several records share meet their first record, dealt over tasks where one page is a large part of all,
and what comes out is one row per revisit. The records then pass once more and take what their own id finds there: the
revisits are sent to all tasks up to BROADCAST_ROWS rows, beyond that records are joined by id, which no two share.
Reading back looks up revisits alone.

Of records with equal payloads of at least MIN_REVISIT bytes, the first by (id, record id) is the response and the
others are revisits that refer to it and carry no payload. A null payload is empty, a null URL becomes a URN of the
page, a null page id stays null and comes last in that order. Repeated rows are records of their own. An empty table
gives files with only their opening record. Very long payloads are handled a slice at a time and never cut. Extra columns
of ``pages`` are not archived, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagtrail.llm.texts import slices
from tagtrail.operators.joins import split_join
from tagtrail.session import scratch_path, staged

MIN_REVISIT = 100
#: So many revisits, about 40 MB, are sent to all tasks.
BROADCAST_ROWS = 200_000

# Field lists of the two ARC versions, and the WARC version and profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ARC_SCHEMA = (
    "archive string, offset bigint, url string, ip string, date string, content_type string, page_id bigint, http_head binary, payload binary, "
    "payload_bytes bigint, payload_digest string, record_id string"
)
_FLUSH = 4 << 20


def _batches(rows: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows that together hold about _FLUSH bytes; rows come with their size."""
    held, size = [], 0
    for row, more in rows:
        held.append(row)
        size += more
        if size >= _FLUSH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _text_file(df: DataFrame, path: str, separator: str) -> None:
    text = df.select(F.col("value").cast("string")).write.option("lineSep", separator)
    text.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


_VALUE = pa.schema([("value", pa.binary())])


def http_response(page_id: int | None, payload: bytes) -> bytes:
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    return "\r\n".join([*head, "", ""]).encode()


def arc_opening(name: str, version: int, date: str) -> bytes:
    """The version block, whose own header line declares the length of its two lines."""
    body = f"{version} 0 corpus\n{ARC_FIELDS[version]}\n"
    rest = [] if version == 1 else ["200", "-", "-", "0", name]
    return (" ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *rest, str(len(body))]) + "\n" + body).encode()


def arc_record(url: str, date: str, block: bytes, version: int, name: str, offset: int, payload: bytes) -> bytes:
    rest = [] if version == 1 else ["200", hashlib.md5(payload).hexdigest(), "-", str(offset), name]
    return " ".join([url, "0.0.0.0", date, "text/html", *rest, str(len(block))]).encode("utf-8", "surrogatepass") + b"\n" + block


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "20000101000000") -> str:
    """One ARC file per partition, of version 1 and 2 in turn."""
    source = pages.select(F.col(page_id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, version = f"pages-{part:06d}.arc", 1 + part % 2
        opening = arc_opening(name, version, date)

        def rows():
            at = len(opening) + 1
            yield {"value": opening}, len(opening)
            for batch in batches:
                for i, u, body in (r for s in slices(batch, "payload") for r in zip(*[c.to_pylist() for c in s.columns])):
                    body = body or b""
                    where = quote(u, safe=":/?#[]@!$&'()*+,;=%-._~") if u else f"urn:page:{i}"
                    value = arc_record(where, date, http_response(i, body) + body, version, name, at, body)
                    at += len(value) + 1
                    yield {"value": value}, len(value)

        return _batches(rows(), _VALUE)

    _text_file(source.mapInArrow(run, "value binary"), path, "\n")
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("content")


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[io.BufferedReader]:
    for batch in batches:
        for content in batch.column("content"):
            raw = content.as_buffer()
            data = pa.BufferReader(raw)
            gz = raw.slice(0, 2).to_pybytes() == b"\x1f\x8b"
            yield io.BufferedReader(gzip.GzipFile(fileobj=data) if gz else data, 1 << 16)


def arc_records(stream: io.BufferedReader) -> Iterator[dict]:
    """Records of one ARC file, by the header fields that its version block declares."""
    name, version, at = "", 0, 0
    while line := stream.readline():
        offset, at = at, at + len(line)
        header = line.strip(b"\r\n").decode("utf-8", "surrogatepass")
        if not header:
            continue
        if not version:  # the version block: both versions declare themselves in the first line of its body
            length = int(header.rsplit(" ", 1)[1])
            body = stream.read(length)
            version, name, at = int(body.split(None, 1)[0]), header.split(" ", 1)[0].removeprefix("filedesc://"), at + length
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} is not known")
            continue
        names = ARC_FIELDS[version].split(" ")
        # Fields have no blanks, but a careless URL may: what is too many belongs to the first field.
        fields = header.rsplit(" ", len(names) - 1)
        if len(fields) != len(names):
            raise ValueError(f"{name}: header line of {len(fields)} fields at {offset}")
        given = dict(zip(names, fields))
        length = int(given["Archive-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"{name}: record at {offset} ends after {len(block)} of {length} bytes")
        at += length
        yield {"archive": name, "offset": offset, "url": given["URL"], "ip": given["IP-address"], "date": given["Archive-date"], "content_type": given["Content-type"], "block": block}


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with its empty line, and body; a block that is no HTTP response is all body."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, mark, body = block.partition(b"\r\n\r\n")
    return head + mark, body


def page_of(head: bytes) -> int | None:
    for line in head.split(b"\r\n"):
        if line[:10].lower() == b"x-page-id:":
            return int(line[10:])
    return None


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all files, with ``payload_bytes`` and ``payload_digest``; without ``payloads`` that column is null."""
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("page_id", pa.int64()), ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for stream in _streams(batches):
                for record in arc_records(stream):
                    head, body = split_http(record.pop("block"))
                    own = {"page_id": page_of(head), "http_head": head, "payload": body if payloads else None, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}
                    yield record | own | {"record_id": record_id(record["archive"], record["offset"])}, len(body) if payloads else 500

        return _batches(rows(), schema)

    return _files(spark, path).mapInArrow(run, _ARC_SCHEMA)


def record_id(archive: str, offset: int) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"filedesc://{archive}#{offset}").urn


def _warc_date() -> Column:
    digits = lambda a, n: F.substring("date", a, n)
    return F.concat(digits(1, 4), F.lit("-"), digits(5, 2), F.lit("-"), digits(7, 2), F.lit("T"), digits(9, 2), F.lit(":"), digits(11, 2), F.lit(":"), digits(13, 2), F.lit("Z"))


def revisits(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(record_id, refers_to_record_id, refers_to_url, refers_to_warc_date) of the records whose payload an earlier one has."""
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id", "url", _warc_date().alias("warc_date"))
    narrow = staged(records.where(F.col("payload_bytes") >= min_revisit).select("payload_digest", "record_id", order.alias("own")), "digests")
    firsts = narrow.groupBy("payload_digest").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    repeated = split_join(narrow.select("payload_digest", "record_id"), staged(firsts, "firsts"), ["payload_digest"], "inner", ["record_id"])
    return repeated.where("record_id <> first.record_id").select("record_id", *[F.col(f"first.{c}").alias(f"refers_to_{c}") for c in ("record_id", "url", "warc_date")])


def convert(records: DataFrame, revisited: DataFrame) -> DataFrame:
    """ARC records with warc_date, record_type, and what a revisit refers to, by the rows of ``revisits``."""
    known = staged(revisited, "revisits")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    joined = records.join(known, "record_id", "left").withColumn("warc_date", _warc_date())
    return joined.withColumn("record_type", F.when(F.col("refers_to_record_id").isNotNull(), "revisit").otherwise("response"))


def warc_record(r: dict) -> bytes:
    revisit = r["record_type"] == "revisit"
    block = r["http_head"] + (b"" if revisit else r["payload"])
    fields = [
        ("WARC-Type", r["record_type"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["warc_date"]), ("WARC-Target-URI", r["url"]),
        ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{r['refers_to_record_id']}>"), ("WARC-Refers-To-Target-URI", r["refers_to_url"]), ("WARC-Refers-To-Date", r["refers_to_warc_date"])]
    http = r["http_head"].startswith(b"HTTP/")
    fields += [("Content-Type", "application/http;msgtype=response" if http else r["content_type"]), ("Content-Length", str(len(block)))]
    return "\r\n".join([WARC_VERSION, *(f"{k}: {v}" for k, v in fields), "", ""]).encode("utf-8", "surrogatepass") + block


def warc_opening(part: int) -> bytes:
    body = b"software: corpus archive converter\r\nformat: WARC File Format 1.1\r\n"
    head = [WARC_VERSION, "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo:{part}').urn}>", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body


def write_warc(records: DataFrame, path: str) -> str:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows():
            yield {"value": warc_opening(part)}, 200
            for batch in batches:
                for piece in slices(batch, "payload"):
                    for r in piece.to_pylist():
                        value = warc_record(r)
                        yield {"value": value}, len(value)

        return _batches(rows(), _VALUE)

    _text_file(records.mapInArrow(run, "value binary"), path, "\r\n\r\n")
    return path


def warc_records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record ends after {len(block)} of {length} bytes")
        yield fields, block


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, url, warc_date, page_id, payload, payload_bytes, digest, stated_digest, refers_to_id) of responses and revisits.

    ``payload_bytes`` and ``digest`` are of the payload that the record itself holds. Without ``payloads`` that column is null.
    """
    schema = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "url", "warc_date")] + [("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("stated_digest", pa.string()), ("refers_to_id", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for stream in _streams(batches):
                for f, block in warc_records(stream):
                    if f["warc-type"] in ("response", "revisit"):
                        head, body = split_http(block)
                        yield {
                            "record_id": f["warc-record-id"].strip("<>"), "record_type": f["warc-type"], "url": f.get("warc-target-uri"), "warc_date": f.get("warc-date"), "page_id": page_of(head),
                            "payload": body if payloads else None, "payload_bytes": len(body), "digest": hashlib.sha256(body).hexdigest(),
                            "stated_digest": f.get("warc-payload-digest", "").removeprefix("sha256:"), "refers_to_id": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
                        }, len(body) if payloads else 500

        return _batches(rows(), schema)

    kinds = "record_id string, record_type string, url string, warc_date string, page_id bigint, payload binary, payload_bytes bigint, digest string, stated_digest string, refers_to_id string"
    return _files(spark, path).mapInArrow(run, kinds)


def resolved(records: DataFrame) -> DataFrame:
    """Per record the length and digest of its full payload; a revisit's are those of the response it refers to."""
    own = staged(records.select("record_id", "record_type", "url", "page_id", "refers_to_id", "payload_bytes", "digest"), "records")
    is_revisit = F.col("record_type") == "revisit"
    responses = own.where(~is_revisit)
    full = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("digest").alias("full_digest"))
    found = split_join(own.where(is_revisit).drop("payload_bytes", "digest"), full, ["refers_to_id"], "left", ["record_id"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url"]
    found = found.withColumnsRenamed({"full_bytes": "payload_bytes", "full_digest": "payload_digest"}).select(*columns)
    return found.unionByName(responses.withColumnRenamed("digest", "payload_digest").withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns))


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pack pages to ARC files, convert these to WARC files, and read those back."""
    spark = pages.sparkSession
    arc = write_arc(pages, scratch_path(spark, "arc"), page_id, url, payload)
    told = revisits(read_arc(spark, arc, payloads=False))
    warc = write_warc(convert(read_arc(spark, arc), told), scratch_path(spark, "warc"))
    return resolved(read_warc(spark, warc, payloads=False))
