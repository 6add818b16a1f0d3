"""WARC archives as seekable Zstandard bundles, and reading them back by record.

A bundle is a row of independent Zstandard frames, each with whole records of about
``FRAME_BYTES``, and ends in the seek table of the seekable format: a skippable frame
that holds the sizes of all others. Any Zstandard reader can read a whole bundle, and
a record is read by its frame's number and the offset within it, which the index
gives for each record identifier.

Payloads that occur more than once are stored once: the row with the largest id is a
``response``, the others are ``revisit`` records that refer to it. Who that is comes from
digests alone. The payloads then move once, put together by digest and id before they
do, so neither a payload that a third of the pages have nor a repeated row fills a task;
revisits are made from the digests and move none.

Executors write to the shared folder through pyarrow's file systems. A bundle is known
by the index only, which Spark commits, so what a lost executor left is never read. There are
as many tasks that write as the payloads' bytes and the cores ask for, not one for each
partition of the shuffles: each leaves a bundle of its own and files of the index.

* a null payload is empty; a null address is left out of its record
* null ids are the smallest; rows whose ids are null refer to a record without an id
* of repeated rows (equal id and payload) one is the response, the others refer to it;
  if their addresses differ, the response has the greatest of them
* spaces and control characters in an address are written in percent form
* an empty table gives an empty index and an empty result; other columns are ignored
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.llm.common import checkpointed, findable, shared_folder, slices

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
LEVEL = 3
# Fixed values of the seekable format: the skippable frame's number, the number that ends the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed values of WARC 1.1.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records get this date unless the caller knows when pages were fetched.
DATE = "1970-01-01T00:00:00Z"
#: Payload bytes that a task writes, about, if there are more than the cores need.
TASK_BYTES = 8 << 20
#: Copies of one row that are numbered in one step.
COPIES = 10_000
_INDEX = "record_id string, bundle string, frame int, offset bigint, length bigint"
_NAMES = uuid.UUID("6f1d0a2c-5b0e-5c55-9a53-0d2f6b7a1e11")


# -- bundles -------------------------------------------------------------------------


class BundleWriter:
    """Writes records to a binary file; ``add`` tells the frame and the offset within it."""

    def __init__(self, file, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self._file, self._most = file, frame_bytes
        self._packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._parts: list[bytes] = []
        self._size, self._table, self.written = 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self._parts and self._size + len(record) > self._most:
            self._end_frame()
        place = len(self._table), self._size
        self._parts.append(record)
        self._size += len(record)
        return place

    def _end_frame(self) -> None:
        packed = self._packer.compress(b"".join(self._parts))
        self._file.write(packed)
        self._table.append((len(packed), self._size))
        self.written += len(packed)
        self._parts, self._size = [], 0

    def close(self) -> None:
        if self._parts:
            self._end_frame()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self._table)
        footer = struct.pack("<IBI", len(self._table), 0, SEEKABLE)
        self._file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, file, size: int):
        self._file = file
        file.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the bundle")
        width = 12 if flags & 0x80 else 8
        file.seek(size - 9 - width * frames)
        table = file.read(width * frames)
        self._sizes = [struct.unpack_from("<II", table, k * width) for k in range(frames)]
        self._starts = [0]
        for packed, _ in self._sizes:
            self._starts.append(self._starts[-1] + packed)

    def __len__(self) -> int:
        return len(self._sizes)

    def frame(self, number: int) -> bytes:
        packed, size = self._sizes[number]
        self._file.seek(self._starts[number])
        return zstandard.ZstdDecompressor().decompress(self._file.read(packed), max_output_size=size)


# -- records -------------------------------------------------------------------------


def digest32(payload: bytes) -> str:
    """SHA-1 in base 32, as WARC tools write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: str, url: str | None, digest: str, number: int) -> str:
    name = "\0".join((page, "" if url is None else f"={url}", digest, str(number)))
    return f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>"


def _address(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else quote(c, safe="") for c in url)


def made(
    page: str, url: str | None, number: int, digest: str, length: int, payload: bytes | None,
    first: tuple[str, str | None] | None = None, date: str = DATE,
) -> tuple[str, bytes]:
    """Identifier and bytes of a record: a response with its payload or, given page and
    address of the ``first``, a revisit."""
    ident = record_id(page, url, digest, number)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        fields.append(("WARC-Target-URI", _address(url)))
    if page:
        fields.append(("X-Page", quote(page[1:])))
    if first is None:
        block += payload
    else:
        fields[0] = ("WARC-Type", "revisit")
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(*first, digest, 0))]
        if first[0]:
            fields.append(("X-Refers-To-Page", quote(first[0][1:])))
    fields += [
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = b"".join(f"{name}: {value}\r\n".encode() for name, value in fields)
    return ident, VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parsed(record: bytes) -> dict:
    """The named fields of a record, its ``payload`` (None in a revisit) and the payload's ``length``.

    Raises if a digest or a length does not agree with the bytes.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError("no WARC record at this offset")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n" or f"sha1:{digest32(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b": ", 1)[1])
    if fields["WARC-Type"] == "revisit":
        payload = None
    elif len(payload) != length or f"sha1:{digest32(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return {**fields, "payload": payload, "length": length}


# -- tables --------------------------------------------------------------------------


def _numbered(rows: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, with a ``number`` from 0; many copies are spread."""
    chunks = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    spread = chunks.repartition("same", "page", "url", "start")
    last = F.least(F.col("start") + COPIES, F.col("copies")) - 1
    return spread.withColumn("number", F.explode(F.sequence("start", last))).drop("start", "copies")


def writers(pages: DataFrame, payload: str = "html") -> int:
    """Tasks that write the bundles: two for each core, or more if the payloads have more bytes."""
    total = pages.agg(F.sum(F.octet_length(payload))).first()[0] or 0
    return max(2 * pages.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))


def records(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, tasks: int | None = None
) -> DataFrame:
    """What to write: page, url, number, same, bytes, payload, first, first_url.

    ``page`` is the id as text after a sign, or empty for a null id; ``number`` tells
    copies of a row apart; ``same`` is the payload's SHA-1 and SHA-256; ``payload`` is
    null in revisits; ``first`` and ``first_url`` name the response a revisit refers to and
    are null in responses. Payloads below ``least`` bytes are all responses. ``tasks``, if given,
    is the most partitions that each of these kinds of records has; no row moves for it.
    """

    def joined(rows: DataFrame) -> DataFrame:
        return rows.select(*out) if tasks is None else rows.select(*out).coalesce(tasks)

    rows = pages.select(
        F.col(id).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit("")).alias("page"),
        F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("same", F.concat(F.sha1("payload"), F.sha2("payload", 256)))
    rows = rows.withColumn("bytes", F.length("payload").cast("long"))
    out = ("page", "url", "number", "same", "bytes", "payload", "first", "first_url")
    none = F.lit(None).cast("string")
    large = rows.where(F.col("bytes") >= least)
    leaders = large.groupBy("same").agg(F.max(F.struct("id", "page", "url")).alias("lead")).select(
        "same", F.col("lead.page").alias("first"), F.col("lead.url").alias("first_url")
    )
    # one payload of each page before anything moves, and joined where it is then
    stored = large.groupBy("same", "page").agg(
        F.first("payload").alias("payload"), F.max("url").alias("url"), F.first("bytes").alias("bytes")
    )
    responses = stored.join(leaders.select("same", F.col("first").alias("page")), ["same", "page"], "left_semi")
    responses = responses.withColumns({"number": F.lit(0).cast("long"), "first": none, "first_url": none})
    counted = large.groupBy("same", "page", "url", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    is_response = (F.col("page") == F.col("first")) & F.col("url").eqNullSafe(F.col("first_url")) & (F.col("number") == 0)
    revisits = _numbered(counted.join(leaders, "same")).where(~is_response)
    result = joined(responses).union(joined(revisits.withColumn("payload", F.lit(None).cast("binary"))))
    if least > 0:
        small = rows.where(F.col("bytes") < least).groupBy("same", "page", "url", "bytes").agg(
            F.first("payload").alias("payload"), F.count(F.lit(1)).alias("copies")
        )
        result = result.union(joined(_numbered(small).withColumns({"first": none, "first_url": none})))
    return result


def _opened(folder: str):
    """The file system and path of a folder, for executors."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write(
    content: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
    level: int = LEVEL, date: str = DATE,
) -> DataFrame:
    """Writes :func:`records` to bundles in ``folder`` and returns their index, itself
    written: record_id, bundle, frame, offset (within the frame), length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        name = file = bundle = None
        for batch in batches:
            for start, stop in slices(batch.column(5)):
                found = []
                for page, url, number, same, size, payload, first, first_url in zip(
                    *(c.to_pylist() for c in batch.slice(start, stop - start).columns), strict=True
                ):
                    if bundle and bundle.written >= bundle_bytes:
                        bundle.close(), file.close()
                        bundle = None
                    if not bundle:
                        system.create_dir(path, recursive=True)
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        file = system.open_output_stream(f"{path}/{name}", compression=None)
                        bundle = BundleWriter(file, frame_bytes, level)
                    digest = base64.b32encode(bytes.fromhex(same[:40])).decode()
                    of = None if first is None else (first, first_url)
                    ident, record = made(page, url, number, digest, size, payload, of, date)
                    frame, offset = bundle.add(record)
                    found.append((ident, f"{folder}/{name}", frame, offset, len(record)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    names=["record_id", "bundle", "frame", "offset", "length"],
                )
        if bundle:
            bundle.close(), file.close()

    return checkpointed(content.select(
        "page", "url", "number", "same", "bytes", "payload", "first", "first_url"
    ).mapInArrow(run, _INDEX))


def read(index: DataFrame, id_type: str = "bigint") -> DataFrame:
    """The records of an index: record_id, page_id, url, record_type, payload (null in
    revisits), payload_bytes, payload_digest, refers_to (a page), refers_to_record.

    Any part of an index will do; a frame is unpacked once for records of it that follow
    one another. Damage raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, opened, at, content = None, None, None, b""
        types = [pa.string()] * 4 + [pa.binary(), pa.int64()] + [pa.string()] * 3
        for batch in batches:
            found, held = [], 0

            def out():
                columns = zip(*found, strict=True)
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=["record_id", "page", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "refers_to_record"],
                )

            for ident, name, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != bundle:
                    system, path = _opened(name)
                    bundle, at = name, None
                    opened = BundleReader(system.open_input_file(path), system.get_file_info(path).size)
                if frame != at:
                    at, content = frame, opened.frame(frame)
                got = parsed(content[offset:offset + length])
                if got["WARC-Record-ID"] != ident:
                    raise ValueError(f"the index leads to another record than {ident}")
                page, refers = (None if got.get(x) is None else unquote(got[x]) for x in ("X-Page", "X-Refers-To-Page"))
                found.append((
                    ident, page, got.get("WARC-Target-URI"), got["WARC-Type"], got["payload"], got["length"],
                    got["WARC-Payload-Digest"].removeprefix("sha1:"), refers, got.get("WARC-Refers-To"),
                ))
                held += length
                if held > 4 * FRAME_BYTES:
                    yield out()
                    found, held = [], 0
            if found:
                yield out()

    rows = index.select("record_id", "bundle", "frame", "offset", "length").mapInArrow(run, (
        "record_id string, page string, url string, record_type string, payload binary, payload_bytes bigint, "
        "payload_digest string, refers_to string, refers_to_record string"
    ))
    return rows.select(
        "record_id", F.col("page").cast(id_type).alias("page_id"), "url", "record_type", "payload", "payload_bytes",
        "payload_digest", F.col("refers_to").cast(id_type).alias("refers_to"), "refers_to_record",
    )


def archive(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the pages to bundles, in ``folder`` or a new one in the shared folder, and returns the index."""
    findable(pages.sparkSession)
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return write(records(pages, id, url, payload, least, writers(pages, payload)), folder)
