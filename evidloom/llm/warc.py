"""WARC archives: write pages as records, index them first, read selected records by coalesced byte ranges.

Records are gzip members of their own, so that one can be read from its offset and length alone. Equal payloads are
found by digest before anything is written; only digests are shuffled. A task writes its archive whole or not at all and
gives its index rows with it, so that an archive of a lost attempt is in no index.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidloom.llm.remote import opened, whole_file
from evidloom.llm.storage import shared_folder, stored
from evidloom.llm.workers import in_arrow, slices
from evidloom.shipping import ship_by_value

#: digests of repeated payloads that are broadcast; beyond it pages are joined with them by a shuffle
BROADCAST_DIGESTS = 1_000_000
#: bytes of an archive, gap that one read may span, and bytes that one read takes at most
ARCHIVE_BYTES, GAP, READ_BYTES = 64_000_000, 16_384, 4_000_000
DATE = "2024-01-01T00:00:00Z"
INDEX = StructType([StructField("file", StringType()), StructField("offset", LongType()), StructField("length", LongType()),
                    StructField("url", StringType()), StructField("digest", StringType()),
                    StructField("record_type", StringType()), StructField("page_id", LongType())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to) -> tuple[str, str, bytes]:
    """Type, digest and gzip member of one page; a revisit names the page it refers to and holds no payload."""
    digest, kind = base32_sha1(payload), "response" if refers_to is None else "revisit"
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {quote(url, safe=_SAFE)}\r\nWARC-Date: {DATE}\r\n"
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>\r\n"
            f"WARC-Payload-Digest: sha1:{digest}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n"
            f"X-Payload-Length: {len(payload)}\r\n"]
    if refers_to is not None:
        head.append(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                    f"X-Refers-To-Page: {refers_to}\r\n")
    body = payload if refers_to is None else b""
    head.append(f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n")
    return kind, digest, gzip.compress("".join(head).encode() + body + b"\r\n\r\n", 4, mtime=0)


_SAFE = "!#$%&'()*+,/:;=?@[]~"


def parse_record(member: bytes) -> tuple[dict, bytes]:
    """Header fields and body of one gzip member."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for every page (page_id, url, html) and return the stored index of all records.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is a response, the others
    revisit it; a null html is an empty payload, a null url an empty one. A null id is less than any other and gives a
    response of its own if it alone has its payload. Rows that repeat an id and payload are a response each.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    repeated = stored(rows.where(F.octet_length("html") >= min_bytes).groupBy("sha")
                      .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("sha", "top"), "repeated")
    small = repeated.count() <= BROADCAST_DIGESTS
    marked = rows.join(F.broadcast(repeated) if small else repeated, "sha", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))

    def run(batches):
        import pyarrow.compute  # noqa: F401
        held, index, size = [], [], 0

        def close():
            file = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
            whole_file(file, held)
            columns = [[file] * len(index), *([row[k] for row in index] for k in range(6))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], INDEX.fieldNames())

        arrow = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
                           ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64())])
        for batch in batches:
            for part in slices(batch, "html"):
                for page, url, html, refers in zip(*(part.column(k).to_pylist() for k in range(4))):
                    kind, digest, member = record(page, url, html.encode("utf-8"), refers)
                    index.append((size, len(member), url, digest, kind, page))
                    held.append(member)
                    size += len(member)
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        held, index, size = [], [], 0
        if index:
            yield close()

    return stored(in_arrow(marked, run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """The records of the index rows given: page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    Ranges of a file are sorted and read together where they lie close; a large archive is read by several tasks.
    """
    ranges = index.withColumn("block", F.floor(F.col("offset") / READ_BYTES))
    dealt = ranges.repartition("file", "block").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    schema = StructType([StructField("page_id", LongType()), StructField("payload_bytes", LongType()),
                         StructField("payload_digest", StringType()), StructField("record_type", StringType()),
                         StructField("refers_to", LongType()), StructField("payload", StringType())])
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        name, source = None, None
        for batch in batches:
            for group in _coalesced(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if group[0] != name:
                    name = group[0]
                    store, path = opened(name)
                    source = store.open_input_file(path)
                low, out = group[1][0][0], []
                data = source.read_at(group[1][-1][0] + group[1][-1][1] - low, low)
                for offset, length in group[1]:
                    fields, body = parse_record(data[offset - low:offset - low + length])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and base32_sha1(body) != digest:
                        raise ValueError(f"payload differs from its digest at {offset} of {name}")
                    refers = fields.get("X-Refers-To-Page")
                    out.append((int(fields["X-Page-Id"]) if fields["X-Page-Id"] else None, int(fields["X-Payload-Length"]),
                                digest, fields["WARC-Type"], int(refers) if refers else None, body.decode("utf-8")))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)],
                                                 schema.fieldNames())

    return in_arrow(dealt, run, schema)


def _coalesced(rows):
    """(file, [(offset, length), ...]) of neighbouring ranges, at most about READ_BYTES together."""
    file, held = None, []
    for name, offset, length in rows:
        if held and (name != file or offset - sum(held[-1]) > GAP or offset + length - held[0][0] > READ_BYTES):
            yield file, held
            held = []
        file = name
        held.append((offset, length))
    if held:
        yield file, held


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back by its index."""
    folder = shared_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder, min_bytes))


ship_by_value(__name__)
