"""WARC (operator 11): web archives of zstandard frames with a dictionary in front.

A file starts with a skippable frame that holds the dictionary (a trained one,
here itself compressed, or none), then one independent frame for each record,
as the public convention for zstandard WARC files has it. The writer trains
the dictionary of a file on its first payloads, a documented bound that only
changes the size of files. The reader loads the dictionary, walks the block
headers of each frame to its end, decodes it whole, and checks it: the frame
complete, one record in it, version line, named fields, mandatory fields,
Content-Length equal to the block, the two line ends after it, and the block's
and payload's digests where they can be computed. It knows nothing of the
writer's tables, so archives of other tools that follow the convention read
alike.

Of records with equal payloads of `min_bytes` or more the one with the smallest
id is a response with the full payload; the others are revisits, which carry
the HTTP header and refer to it. Only digests that occur twice matter: these
are counted with map-side sums, broadcast if they are small, else joined on the
digest, where the digests with more rows than a task should take are broadcast
(their number is bounded by rows / that many) and their rows spread by id.
Pages move at most once, and never by a hot key.

Contract: a null payload is empty; a null URL leaves out the target field, one
with control characters has them percent-encoded in the archive. A null id is
larger than all others; where all ids of a payload are null, and for repeated
rows of the smallest id, all are responses. Payloads of any length are one
record, held whole. Empty tables give no files and no rows; other columns are
ignored. A file counts only through the manifest row of the attempt that
succeeded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm.text import partitions_for, shared_folder, slices, stored

#: Fixed values of the public formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Bytes of first payloads a file's dictionary is trained on, and the dictionary's size.
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of payloads to a file.
FILE_BYTES = 64 << 20
#: Bytes a reader fetches at once.
READ_BYTES = 1 << 20
#: Bytes of repeated digests that are broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows of one digest that a task may hold.
HOT_ROWS = 100_000
#: Bytes a digest, an id and their row take in a broadcast table, with room to spare.
DIGEST_ROW = 160

DATE = "1970-01-01T00:00:00Z"


class DamagedArchive(ValueError):
    """A file that is no valid archive; tells the offset of the frame."""


@dataclass
class Record:
    """One record: named fields (lower-case names), block, and where its frame lies."""

    version: str
    fields: dict[str, str]
    block: bytes
    offset: int = 0
    length: int = 0
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _crlf(lines: Iterable[str]) -> bytes:
    return "\r\n".join([*lines, "", ""]).encode()


def _safe(url: str) -> str:
    """A URL that fits in a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "none" else int(text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response, or a revisit whose block is the HTTP header alone."""
    block = _crlf(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"])
    if not revisit:
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _crlf(lines) + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes records as frames; the first `SAMPLE_BYTES` of them are held back to train the dictionary."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.level = stream, level
        self.held: list[bytes] | None = []
        self.held_bytes = self.records = self.bytes = 0
        self.packer: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.held is not None:
            self.held.append(record)
            self.held_bytes += len(record)
            if self.held_bytes >= SAMPLE_BYTES:
                self._start()
        else:
            self._write(self.packer.compress(record))

    def _write(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.bytes += len(raw)

    def _start(self) -> None:
        held, self.held = self.held, None
        dictionary = b""
        # Long records are cut into samples: a dictionary can't learn from what exceeds a match window anyway.
        samples = [r[at : at + 8192] for r in held for at in range(0, min(len(r), SAMPLE_BYTES), 8192)]
        if len(samples) >= 8:
            try:
                dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(self.held_bytes // 10, 256)), samples, steps=4, d=8, k=256, level=self.level).as_bytes()
            except zstandard.ZstdError:  # too little or too uniform to learn from
                dictionary = b""
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19, write_content_size=True).compress(dictionary)
            self._write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        learned = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if learned is not None:
            learned.precompute_compress(level=self.level)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=learned, write_checksum=True, write_content_size=True)
        for record in held:
            self._write(self.packer.compress(record))

    def close(self) -> None:
        if self.held:
            self._start()


class ArchiveReader:
    """Records of one archive, one frame at a time, through any stream with `read`."""

    def __init__(self, stream, read_bytes: int = READ_BYTES):
        self.stream, self.read_bytes = stream, read_bytes
        self.buffer, self.first, self.at = b"", 0, 0  # bytes held, their offset in the file, place in them
        self.ended = False
        self.decoder = zstandard.ZstdDecompressor(dict_data=self._dictionary())

    def _have(self, n: int) -> bool:
        """Hold n bytes from the current place on, if the file has them."""
        if len(self.buffer) - self.at < n and not self.ended:
            parts, held = [self.buffer[self.at :]], len(self.buffer) - self.at
            while held < n:
                more = self.stream.read(max(self.read_bytes, n - held))
                if not more:
                    self.ended = True
                    break
                parts.append(more)
                held += len(more)
            self.first += self.at
            self.buffer, self.at = b"".join(parts), 0
        return len(self.buffer) - self.at >= n

    def _fail(self, what: str) -> DamagedArchive:
        return DamagedArchive(f"{what} at byte {self.first + self.at}")

    def _magic(self) -> int:
        if not self._have(4):
            raise self._fail("the file ends inside a frame")
        return struct.unpack_from("<I", self.buffer, self.at)[0]

    def _skippable(self) -> bytes:
        if not self._have(8):
            raise self._fail("the file ends inside a skippable frame")
        size = struct.unpack_from("<I", self.buffer, self.at + 4)[0]
        if not self._have(8 + size):
            raise self._fail("the file ends inside a skippable frame")
        body = self.buffer[self.at + 8 : self.at + 8 + size]
        self.at += 8 + size
        return body

    def _dictionary(self) -> zstandard.ZstdCompressionDict | None:
        """The dictionary of the leading skippable frame, plain or compressed itself."""
        if not self._have(4) or self._magic() != DICTIONARY_MAGIC:
            return None
        body = self._skippable()
        try:
            if body[:4] == struct.pack("<I", FRAME_MAGIC):
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            return zstandard.ZstdCompressionDict(body) if body else None
        except zstandard.ZstdError as error:
            raise DamagedArchive(f"the dictionary is damaged: {error}") from error

    def _frame(self) -> bytes:
        """The bytes of the next frame, found by its block headers."""
        self._have(18)
        try:
            parameters = zstandard.get_frame_parameters(self.buffer[self.at : self.at + 18])
            size = zstandard.frame_header_size(self.buffer[self.at : self.at + 18])
        except zstandard.ZstdError as error:
            raise self._fail(f"no frame ({error})") from error
        last = False
        while not last:
            if not self._have(size + 3):
                raise self._fail("the file ends inside a frame")
            head = int.from_bytes(self.buffer[self.at + size : self.at + size + 3], "little")
            last, kind, length = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3:
                raise self._fail("a block of a reserved kind")
            size += 3 + (1 if kind == 1 else length)
        size += 4 * parameters.has_checksum
        if not self._have(size):
            raise self._fail("the file ends inside a frame")
        return self.buffer[self.at : self.at + size]

    def __iter__(self) -> Iterator[Record]:
        while self._have(1):
            if self._magic() in SKIPPABLE:
                self._skippable()
                continue
            frame = self._frame()
            try:
                raw = self.decoder.decompressobj().decompress(frame)
                record = parse_record(raw)
            except (zstandard.ZstdError, DamagedArchive) as error:
                raise self._fail(str(error)) from error
            record.offset, record.length = self.first + self.at, len(frame)
            self.at += len(frame)
            yield record


def _named_fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:  # a continued line
            out[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise DamagedArchive(f"no named field: {text[:80]!r}")
        if name in ("content-length", "warc-record-id", "warc-type", "warc-date") and name in out:
            raise DamagedArchive(f"{name} is given twice")
        out.setdefault(name, value.strip())
    return out


def _digest_holds(told: str, data: bytes) -> bool:
    """Whether a labelled digest is that of the data; unknown algorithms are not judged."""
    algorithm, _, value = told.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("sha256", "sha1", "md5", "sha512"):
        return True
    digest = hashlib.new(algorithm, data).digest()
    return value.strip().lower() == digest.hex() or value.strip().upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def parse_record(raw: bytes) -> Record:
    """One record with everything that can be checked checked."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    if not blank:
        raise DamagedArchive("the header has no end")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1"):
        raise DamagedArchive(f"no version line: {version[:40]!r}")
    fields = _named_fields(lines)
    if missing := [name for name in MANDATORY if not fields.get(name)]:
        raise DamagedArchive(f"without {', '.join(missing)}")
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise DamagedArchive(f"a length of {length!r}")
    size = int(length)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise DamagedArchive(f"a block of {size} bytes and the end told, {len(rest)} bytes found")
    record = Record(version.decode(), fields, rest[:size])
    if not _digest_holds(fields.get("warc-block-digest", ""), record.block):
        raise DamagedArchive("the block fails its digest")
    record.payload = record.block
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        header, blank, record.payload = record.block.partition(b"\r\n\r\n")
        if not blank:
            raise DamagedArchive("the HTTP header has no end")
        record.http = _named_fields(header.split(b"\r\n")[1:])
    if fields["warc-type"] != "revisit" and not _digest_holds(fields.get("warc-payload-digest", ""), record.payload):
        raise DamagedArchive("the payload fails its digest")
    return record


def _marked(pages: DataFrame, min_bytes: int, broadcast_bytes: int, hot_rows: int) -> DataFrame:
    """Add `first`, the smallest id of equal payloads, where the payload occurs twice."""
    spark = pages.sparkSession
    long_enough = F.octet_length("text") >= min_bytes
    rows = pages.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    groups = rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    twice = stored(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()), "warc-digests")
    key = F.when(long_enough, F.col("digest"))
    number = twice.count()
    if number * DIGEST_ROW <= broadcast_bytes:
        found = F.broadcast(twice.select(F.col("digest").alias("same"), "first"))
        return rows.join(found, key == F.col("same"), "left").drop("same")
    # At most all rows / hot_rows digests are hot, so the bound rises with the rows to keep that table small.
    total = twice.agg(F.sum("n")).first()[0]
    limit = max(hot_rows, total * DIGEST_ROW // broadcast_bytes)
    hot = twice.filter(F.col("n") > limit).select(F.col("digest").alias("same"), F.col("first").alias("hot_first"))
    rows = rows.join(F.broadcast(hot), key == F.col("same"), "left").drop("same")
    # Rows of hot digests, and those that match nothing, get keys of their own, which spread.
    apart = F.concat(F.lit("-"), F.col("digest"), F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("-"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("spot", F.when(long_enough & F.col("hot_first").isNull(), F.col("digest")).otherwise(apart))
    cold = twice.filter(F.col("n") <= limit).select(F.col("digest").alias("spot"), F.col("first").alias("cold_first"))
    return rows.join(cold, "spot", "left").withColumn("first", F.coalesce("hot_first", "cold_first")).drop("spot", "hot_first", "cold_first")


MANIFEST = "path string, records long, bytes long"


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 100, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    file_bytes: int = FILE_BYTES, broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Write a record for each page; return the manifest (path, records, bytes) of the files in effect.

    `folder` is a URI that every executor can write to.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, told, stream, writer, held = TaskContext.get().partitionId(), [], None, None, 0

        def end() -> None:
            writer.close()
            stream.close()
            told.append((path, writer.records, writer.bytes))

        for batch in batches:
            for few, data, offsets in slices([batch]):
                names = ("page_id", "url", "digest", "first")
                for k, (page_id, url, digest, first) in enumerate(zip(*(few.column(c).to_pylist() for c in names))):
                    if writer is None:
                        path = f"{root}/pages-{part:06d}-{uuid.uuid4().hex}.warc.zst"
                        stream = files.open_output_stream(path, compression=None)
                        writer, held = ArchiveWriter(stream), 0
                    payload = data[offsets[k] : offsets[k + 1]].tobytes()
                    writer.add(record_bytes(page_id, url, payload, digest, first, revisit=first is not None and first != page_id))
                    held += len(payload)
                    if held >= file_bytes:
                        end()
                        writer = None
        if writer is not None:
            end()
        yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*told)))) or {"path": [], "records": [], "bytes": []},
                                         pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    marked = _marked(rows, min_bytes, broadcast_bytes, hot_rows)
    # Only the attempt whose rows the manifest keeps counts, and the manifest is computed once.
    return stored(marked.select("page_id", "url", "text", "digest", "first").mapInArrow(run, MANIFEST), "warc-manifest")


RECORDS = (
    "path string, offset long, length long, record_type string, record_id string, target_uri string, warc_date string, "
    "payload_digest string, payload_bytes long, refers_to_id string, payload binary, error string"
)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False, errors: str = "raise") -> DataFrame:
    """Read every record of the files in a table with `path`, checked.

    One row for each record: where it lies, its type and ids, digest, size of
    the full payload (of revisits as their HTTP header tells it) and, if asked
    for, the payload. `errors="list"` ends a damaged file with a row that tells
    the error instead of failing the job.
    """
    if errors not in ("raise", "list"):
        raise ValueError(f"errors is raise or list, not {errors}")
    spark = manifest.sparkSession
    names = [part.split()[0] for part in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in RECORDS.split(", ")])

    def row_of(path: str, record: Record) -> tuple:
        get = record.fields.get
        told = record.http.get("content-length", "")
        size = int(told) if told.isdigit() else len(record.payload)
        if get("warc-type") == "response" and told.isdigit() and size != len(record.payload):
            raise DamagedArchive(f"a payload of {size} bytes told, {len(record.payload)} found at byte {record.offset}")
        return (path, record.offset, record.length, get("warc-type"), get("warc-record-id"), get("warc-target-uri"), get("warc-date"),
                get("warc-payload-digest"), size, get("warc-refers-to"), record.payload if with_payload else None, None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        held = 0

        def tell() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*rows))], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_stream(path, compression=None) as stream:
                    try:
                        for record in ArchiveReader(stream):
                            rows.append(row_of(path, record))
                            held += len(record.payload) if with_payload else 0
                            if len(rows) >= 1024 or held >= READ_BYTES:
                                yield tell()
                                rows, held = [], 0
                    except DamagedArchive as error:
                        if errors == "raise":
                            raise DamagedArchive(f"{path}: {error}") from error
                        rows.append((path, *[None] * 10, str(error)))
        if rows:
            yield tell()

    files = manifest.count()
    # One file to a task while there are few, several beyond.
    return manifest.select("path").repartition(max(1, min(files, partitions_for(spark, files, 16)))).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write all pages to archives in a new shared folder and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    records = read_archives(write_archives(pages, folder, min_bytes), folder)

    def page(column: str):
        name = F.regexp_extract(column, "^<urn:page:(.*)>$", 1)
        return F.when(name != "none", name).cast("long")

    return records.select(
        page("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type", page("refers_to_id").alias("refers_to"))
