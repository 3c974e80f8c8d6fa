"""Dictionary-compressed WARC archives.

One Zstandard dictionary is built from records of the table and stands in a skippable
frame at the head of every archive; each record is a frame of its own, compressed with it.
Spark's text writer puts the frames into files: the separator it writes after each row is an
empty skippable frame, which Zstandard readers pass over, so a file is a valid ``.warc.zst`` in any
store Spark can write to, and the files of lost or repeated tasks are never seen.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from salescope.llm.common import map_batches
from salescope.session import scratch_path

# Fixed values of the file formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "\x50\x2a\x4d\x18\x00\x00\x00\x00"
DATE = "1970-01-01T00:00:00Z"  # the table has no crawl time

SAMPLE_RECORDS, SAMPLE_RECORD_BYTES, DICTIONARY_BYTES = 512, 64 << 10, 110 << 10
READ_BYTES = 1 << 16


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def warc_record(page_id: int | None, url: str | None, payload: bytes, keeper: int | None) -> bytes:
    """A response record, or a revisit of page ``keeper`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if keeper is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{keeper}>")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of a record; the digest of a stored payload is recomputed and must agree."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} was changed")
    number = lambda urn: int(n) if (n := urn[len("<urn:page:"):-1]) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else number(fields["WARC-Refers-To"]),
        "payload": payload if response else None,
    }


def train_dictionary(pages: DataFrame) -> bytes:
    """Dictionary from about ``SAMPLE_RECORDS`` records of at most ``SAMPLE_RECORD_BYTES``; empty if they are too few.

    The records whose hash is lowest are taken. The sample is bounded by these parameters (some
    32 MB), the same for every table size, and decides only how well records compress.
    """
    share = min(1.0, SAMPLE_RECORDS / max(1, pages.count()))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    own = F.pmod(F.xxhash64("page_id", "url", size), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = pages.where(own & (size <= SAMPLE_RECORD_BYTES)).select("page_id", "url", "html").collect()
    records = [warc_record(r[0], r[1], (r[2] or "").encode("utf-8"), None) for r in rows]
    total = sum(map(len, records))
    if len(records) < 16 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), records).as_bytes()
    except zstandard.ZstdError:  # records that have nothing in common
        return b""


def _frames(dictionary: bytes, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True)
        begun = not dictionary
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                frames = []
                if not begun:
                    frames.append(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    begun = True
                for page, url, html, keeper in zip(*(c.to_pylist() for c in part.columns)):
                    frames.append(press.compress(warc_record(page, url, html, keeper)))
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    return run


def with_keepers(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html as bytes, keeper): for revisits the largest page_id of an equal payload, else null.

    Equal payloads are counted by SHA-256 with partial sums; only digests held more than
    once are joined, so a very frequent payload is a skewed join side that Spark splits.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("sha", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= min_bytes)
    shared = large.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("largest")).where("n > 1").drop("n")
    joined = rows.join(shared, "sha", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("largest").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("largest")).alias("keeper"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, level: int = 3) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) below ``path``, an archive for each partition.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is a response and the others are revisits that refer to it; rows sharing that largest
    page_id are all responses, as are rows with only null page_ids. A null html is an empty
    payload, a null URL leaves the field out, and white space in a URL is percent-encoded.
    Other columns are not read. An empty table gives archives without records.
    """
    dictionary = train_dictionary(pages)
    frames = map_batches(with_keepers(pages, min_bytes), _frames(dictionary, level), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def _records(content: bytes) -> Iterator[bytes]:
    """Records of an archive, decompressed one after another."""
    source = io.BytesIO(content)
    made = None
    pending = b""
    while True:
        if len(pending) < 8:
            pending += source.read(READ_BYTES)
            if not pending:
                return
        magic = struct.unpack_from("<I", pending)[0]
        if magic >> 4 == 0x184D2A5:  # skippable
            size = struct.unpack_from("<I", pending, 4)[0]
            while len(pending) < 8 + size:
                more = source.read(max(READ_BYTES, 8 + size - len(pending)))
                if not more:
                    raise ValueError("the archive ends within a frame")
                pending += more
            if magic == DICTIONARY_MAGIC:
                made = zstandard.ZstdCompressionDict(pending[8 : 8 + size])
            pending = pending[8 + size :]
            continue
        frame = zstandard.ZstdDecompressor(dict_data=made).decompressobj()
        out = [frame.decompress(pending)]
        while not frame.eof:
            more = source.read(READ_BYTES)
            if not more:
                raise ValueError("the archive ends within a frame")
            out.append(frame.decompress(more))
        pending = frame.unused_data
        yield b"".join(out)


_PARSED = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)


def _parsed(with_payload: bool):
    schema = _PARSED if with_payload else _PARSED.remove(_PARSED.get_field_index("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in _records(content.as_py()):
                    rows.append(parse_record(record))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """A row for every record of the archives below ``path``; stored payloads are checked against their digest.

    An archive is read by one task, as its dictionary stands at its head.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_batches(files, _parsed(with_payload), kind + (", payload binary" if with_payload else ""))


def archived(pages: DataFrame, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes, level)
    return read_archives(pages.sparkSession, path, with_payload=False)
