"""WARC archives compressed with Zstandard: writer, reader and payload deduplication.

An archive starts with a skippable frame that holds the compression dictionary; then every record
is one frame of its own. The reader loads the dictionary from that frame, decodes frame by frame
and checks the version line, the required headers, the block length, the end of the record and the
block and payload digests. It streams: one frame is in memory at a time.

Archives are written by the executors straight to the shared folder through Arrow's file systems
(local, HDFS and object stores), under a name that is unique to the task attempt, and the small
table of finished archives decides what is read; archives of lost attempts are never seen.

A record whose payload equals that of another record is a `revisit` of the record with the
smallest page_id, if the payload has at least `min_revisit` bytes. The smallest ids are found by a
sum per digest that is combined before the shuffle, and only digests that occur twice come back to
the pages, dealt over `SALTS` copies so that one digest of very many pages does not fill one task.

Edge cases: null html is an empty payload; null urls get no target header; a null page_id is kept
(such rows are read back with null and only refer to others, or to a null id if no row has one);
rows that repeat a page_id are each written, the repeats as responses of the same id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, fresh_path, materialise, scan

# The magic number of the dictionary's frame, and the first bytes of a zstd frame.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: Bytes that a decoder is given at a time.
STEP = 8192
VERSION = b"WARC/1.1"
SALTS = 16
DATE = "2024-01-01T00:00:00Z"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
MANIFEST = "path string, n_records long, n_bytes long"


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id, url, payload: bytes, refers_to=None, revisit: bool = False, digest: str | None = None) -> bytes:
    """One WARC record. A revisit's block keeps the HTTP header, which states the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest or sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {urn(refers_to)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """A row of RECORDS from one decoded frame; WarcError where it breaks the format."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not sep:
        raise WarcError(f"not a {VERSION.decode()} record: {raw[:40]!r}")
    headers = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.decode().lower()] = value.strip().decode()
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        raise WarcError(f"unexpected WARC-Type {kind}")
    for name in ("warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length} does not fit a record of {len(rest)} bytes")
    block = rest[:length]
    if headers["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise WarcError("block digest differs")
    http, sep, payload = block.partition(b"\r\n\r\n")
    stated = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]).get("Content-Length")
    if not sep or stated is None:
        raise WarcError("the HTTP header states no length")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(stated) or digest != sha1_base32(payload)):
        raise WarcError("payload length or digest differs")
    if kind == "revisit" and payload:
        raise WarcError("a revisit record with a payload")
    number = lambda x: int(v) if (v := x.removeprefix("<urn:page:").removesuffix(">")) else None
    refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
    return (number(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, refers, int(stated), digest, payload if kind == "response" else None)


class ArchiveWriter:
    """Frames behind a leading dictionary frame, to an open binary stream."""

    def __init__(self, stream, dictionary: bytes, level: int = 3):
        import zstandard

        self.stream, self.n_records = stream, 0
        stream.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.n_bytes = 8 + len(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)

    def write(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.stream.write(frame)
        self.n_records += 1
        self.n_bytes += len(frame)


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decoded frames of an archive, one record each. The dictionary may be a zstd frame itself.

    A frame's end is found by decoding, so it is fed in steps: what is read beyond an end is at most a step."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise WarcError("the archive ends in its first frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise WarcError("the archive does not start with a dictionary frame")
    dictionary = b""
    while len(dictionary) < size and (more := stream.read(size - len(dictionary))):
        dictionary += more
    if len(dictionary) < size:
        raise WarcError("the archive ends in its dictionary")
    if dictionary.startswith(ZSTD_MAGIC):
        dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data, at = memoryview(stream.read(chunk)), 0
    while len(data):
        one, out = decompressor.decompressobj(), io.BytesIO()
        while not one.eof:
            if at == len(data):
                data, at = memoryview(stream.read(chunk)), 0
                if not len(data):
                    raise WarcError("the archive ends within a frame")
            part = data[at : at + STEP]
            out.write(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        if at == len(data):
            data, at = memoryview(stream.read(chunk)), 0
        yield out.getvalue()


def train_dictionary(pages: DataFrame, sample_pages: int = 400, size: int = 16_384) -> bytes:
    """A zstd dictionary from at most sample_pages texts of up to 64 KB, those of the lowest hash; empty if they don't suffice.

    Only the dictionary rests on the sample; every page is archived whole."""
    import zstandard

    texts = pages.select(F.xxhash64("html").alias("h"), "html").where("length(html) > 0")
    chosen = texts.select("h").distinct().orderBy("h").limit(sample_pages)
    rows = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min(F.substring("html", 1, 65_536)).alias("html")).collect()
    texts = [r["html"].encode("utf-8", "replace") for r in sorted(rows, key=lambda r: r["h"])]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if len(texts) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def repeats(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """digest and first_id of every payload of at least min_revisit bytes that more than one row holds."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    groups = light.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return groups.where("copies > 1").select("digest", "first_id")


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, min_revisit: int = 0, roll_bytes: int = 64 << 20, broadcast_rows: int = 200_000) -> DataFrame:
    """Writes every page row; the table of archives (path, n_records, n_bytes).

    Which payloads repeat is settled first. Up to broadcast_rows of them (counted; some 12 MB) go
    to the writers as a broadcast, and the html is not shuffled; more are joined by digest and salt."""
    p = scan(pages, "page_id", "url", "html")
    spark = pages.sparkSession
    repeated = materialise(repeats(pages, min_revisit), "warc-repeats")
    known = spark.sparkContext.broadcast(None)
    if repeated.count() <= broadcast_rows:
        known = spark.sparkContext.broadcast({bytes.fromhex(d): i for d, i in repeated.toLocalIterator()})
        p = p.withColumn("first_id", F.lit(None).cast("long"))
    else:
        salted = repeated.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        keyed = p.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        p = keyed.join(salted, ["digest", "salt"], "left").select("page_id", "url", "html", "first_id")

    def write(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        done, now, path, stream = [], None, None, None
        for b in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    stream = where.open_output_stream(path, compression=None)
                    now = ArchiveWriter(stream, dictionary)
                payload = (html or "").encode("utf-8", "replace")
                sha = hashlib.sha1(payload).digest()
                if known.value is not None and len(payload) >= min_revisit:
                    first = known.value.get(sha, page_id)
                    repeat = sha in known.value and first != page_id
                else:
                    repeat = first is not None and first != page_id
                now.write(record_bytes(page_id, url, payload, first if repeat else None, repeat, base64.b32encode(sha).decode()))
                if now.n_bytes >= roll_bytes:
                    stream.close()
                    done.append((f"{folder}/{path.rpartition('/')[2]}", now.n_records, now.n_bytes))
                    now = None
        if now is not None:
            stream.close()
            done.append((f"{folder}/{path.rpartition('/')[2]}", now.n_records, now.n_bytes))
        yield arrow_batch(MANIFEST, done)

    return materialise(p.mapInArrow(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, batch_bytes: int = 16 << 20) -> DataFrame:
    """Rows of RECORDS from every archive in the manifest; each archive's record count is checked."""

    def read(batches):
        from pyarrow import fs

        for b in batches:
            for path, n_records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, at = fs.FileSystem.from_uri(path)
                rows, held, n = [], 0, 0
                with where.open_input_stream(at, compression=None) as stream:
                    for raw in read_archive(stream):
                        rows.append(parse_record(raw))
                        held, n = held + len(raw), n + 1
                        if held >= batch_bytes:
                            yield arrow_batch(RECORDS, rows)
                            rows, held = [], 0
                if n != n_records:
                    raise WarcError(f"{path} holds {n} records, not {n_records}")
                yield arrow_batch(RECORDS, rows)

    spread = max(1, min(10_000, manifest.count()))
    return manifest.select("path", "n_records").repartition(spread, "path").mapInArrow(read, RECORDS)


def op5_warc(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, by way of archives; nulls and ties as stated above."""
    from .common import table

    pages = table(spark, sf_dir, "pages")
    manifest = write_archives(pages, fresh_path(spark, "warc"), train_dictionary(pages))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT *, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS first_id FROM p),
bits AS (
  SELECT r, k, instr('0123456789abcdef', substr(x, k + 1, 1)) - 1 AS v
  FROM h, (SELECT unnest(range(40)) AS k)
), five AS (
  SELECT r, g, sum(CASE WHEN (v >> (3 - j)) & 1 = 1 THEN 1 << (4 - ((k * 4 + j) % 5)) ELSE 0 END) AS d
  FROM (SELECT r, k, v, unnest(range(4)) AS j FROM bits) t, LATERAL (SELECT (k * 4 + j) // 5 AS g) l
  GROUP BY r, g
), b32 AS (
  SELECT r, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(d AS BIGINT) + 1, 1), '' ORDER BY g) AS payload_digest
  FROM five GROUP BY r
)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h JOIN b32 USING (r)
"""
