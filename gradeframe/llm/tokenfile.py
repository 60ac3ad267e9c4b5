"""Token-ID / binary output (operator 7): seekable zstandard files of token ids.

A file is a row of independent zstandard frames of little-endian unsigned
32-bit ids, then a skippable frame with the document index, then the seek table
of the public seekable format: compressed size, decompressed size and checksum
(low 32 bits of XXH64) of each frame, the number of frames, a descriptor and a
magic number. A reader fetches the two tables from the end of the file and
decompresses only the frames that hold the documents it wants. Any zstandard
tool decompresses the whole file to the plain ids.

Documents are dealt out by ranges of doc_id and a hash of the text, so neither a
hot source or a run of copies nor rows without an id can fill one task, and each
task writes one file of the global order.

Contract: one document per row, also for null or empty texts (only the end id)
and for repeated rows; null ids come first; rows of one id are ordered by their
text's hash, then the text, so files do not change between attempts; an empty table gives one or no
file and no rows; other columns are ignored. A file becomes part of the set
only through the manifest row of the task attempt that succeeded.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm.text import SpanMemory, id_and_text, partitions_for, shared_folder, slices, stored, text_bytes, word_spans

#: Fixed values of the public zstandard formats.
INDEX_MAGIC = 0x184D2A5D  # a skippable frame, here the document index
TABLE_MAGIC = 0x184D2A5E  # the skippable frame that holds the seek table
FOOTER_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80  # descriptor: entries have checksums

#: Bytes of ids after which a frame ends (always at the end of a document).
FRAME_BYTES = 256 << 10
#: Distinct words whose ids a worker remembers (about 40 bytes each), the first it meets; others are encoded again in each slice.
REMEMBERED = 2_000_000
#: What separates words: spaces, tabs and line ends.
BETWEEN = np.ones(256, dtype=bool)
BETWEEN[[0x20, 0x09, 0x0A, 0x0D]] = False
#: Bytes of text to a file.
FILE_BYTES = 16 << 20

MANIFEST = "part int, path string, docs long, ids long"


class WordEncoder:
    """Ids of texts by the library, which sees each distinct word once while it is remembered.

    Cutting at spaces, tabs and line ends changes nothing for a vocabulary whose
    pre-tokenizer drops white space: no merge and no normalisation crosses it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = SpanMemory(self.ids_of, REMEMBERED)
        # A special token that can stand between words, where there is one.
        special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = next(((text, i) for i, text in special.items()), (None, -1))

    def ids_of(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words and their offsets, in one call of the library where a mark can tell them apart."""
        texts = [w.decode() for w in words]
        if self.mark is None or any(self.mark in t for t in texts):
            ids = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.concatenate(([0], np.cumsum([len(i) for i in ids])))
        (found,) = self.tokenizer.encode_batch_fast([self.mark.join(texts)], add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.uint32)
        marks = np.flatnonzero(ids == self.mark_id)
        # The k-th mark has k others before it, which are taken out.
        return np.delete(ids, marks), np.concatenate(([0], marks - np.arange(len(marks)), [len(ids) - len(marks)]))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, end to end, and n+1 offsets per text."""
        starts, ends, words = word_spans(data, offsets, BETWEEN)
        ids, cuts = self.memory.find(data, starts, ends)
        return ids, cuts[words]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


class SeekableWriter:
    """Writes documents' ids to a binary stream as independent frames and the two tables."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.frame_of: list[int] = []
        self.open: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.frame_of.append(len(self.entries))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            packed = self.packer.compress(raw)
            self.stream.write(packed)
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.held = [], 0

    def close(self) -> int:
        """Write the tables; return the number of ids in the file."""
        self.flush()
        known = np.array([i is not None for i in self.ids], dtype=np.uint8)
        index = zstandard.ZstdCompressor().compress(b"".join((
            struct.pack("<Q", len(self.ids)), known.tobytes(), np.array([i or 0 for i in self.ids], dtype="<i8").tobytes(),
            np.array(self.sizes, dtype="<u8").tobytes(), np.array(self.frame_of, dtype="<u4").tobytes(),
        )))
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        return sum(self.sizes) // 4


class SeekableReader:
    """Random access to the documents of one file, through any seekable stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", stream.read(9))
        if magic != FOOTER_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = 8 + 12 * frames + 9
        stream.seek(size - table)
        if struct.unpack("<II", stream.read(8)) != (TABLE_MAGIC, table - 8):
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(stream.read(12 * frames), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.raw, self.sums = entries.T
        self.at = np.concatenate(([0], np.cumsum(self.packed)))
        stream.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", stream.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("the document index is damaged")
        index = zstandard.ZstdDecompressor().decompress(stream.read(length))
        n = struct.unpack_from("<Q", index)[0]
        known = np.frombuffer(index, np.uint8, n, 8)
        ids = np.frombuffer(index, "<i8", n, 8 + n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.sizes = np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.frame_of = np.frombuffer(index, "<u4", n, 8 + 17 * n).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        frame_starts = np.concatenate(([0], np.cumsum(self.raw)))
        self.within = self.starts[:-1] - frame_starts[self.frame_of] if n else self.starts[:0]
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.stream.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.packed[k])), max_output_size=int(self.raw[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} fails its checksum")
            self._last = (k, raw)
        return self._last[1]

    def ids(self, place: int) -> np.ndarray:
        """Ids of the document at a place of the file; decompresses its frame only."""
        first, size = int(self.within[place]), int(self.sizes[place])
        return np.frombuffer(self.frame(int(self.frame_of[place])), "<u4", size // 4, first) if size else np.zeros(0, "<u4")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, id_column: str = "doc_id", text_column: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents' ids in ascending doc_id order; return the manifest (part, path, docs, ids), in effect.

    `folder` is a URI that every executor can write to.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        path = f"{root}/ids-{part:06d}-{uuid.uuid4().hex}.zst"
        encoder, end = word_encoder(vocabulary), struct.pack("<I", end_id)
        with files.open_output_stream(path, compression=None) as stream:
            writer = SeekableWriter(stream)
            for batch in batches:
                for few, data, offsets in slices([batch]):
                    ids, cuts = encoder.encode(data, offsets)
                    raw, cuts = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
                    for doc_id, a, b in zip(few.column("doc_id").to_pylist(), cuts, cuts[1:]):
                        writer.add(doc_id, raw[a:b] + end)
            total = writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [len(writer.ids)], "ids": [total]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    number = partitions_for(spark, text_bytes(rows), file_bytes)
    # Only the attempt whose row the manifest keeps counts, and the manifest is computed once.
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash")]
    dealt = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange(number, *order).sortWithinPartitions(*order, "text")
    return stored(dealt.drop("_hash").mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read every document of a manifest's files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    The manifest has a row per file, so its cumulative sums are taken on the driver.
    """
    spark = manifest.sparkSession
    shards, before = [], 0
    for row in sorted(manifest.select("part", "path", "ids").collect(), key=lambda r: r["part"]):
        shards.append((row["path"], before))
        before += row["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                with files.open_input_file(path) as stream:
                    reader = SeekableReader(stream, stream.size())
                    for first in range(0, len(reader.doc_ids), 1024):
                        places = range(first, min(first + 1024, len(reader.doc_ids)))
                        ids = [reader.ids(k) for k in places]
                        columns = [
                            pa.array([reader.doc_ids[k] for k in places], pa.int64()), pa.array([start + int(reader.starts[k]) // 4 for k in places], pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        ] + [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] * with_ids
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(shards, "path string, before long")
    return listed.repartition(len(shards)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write all documents to a new shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, vocabulary, end_id, folder), folder)
