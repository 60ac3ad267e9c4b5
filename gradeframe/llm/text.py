"""Whole texts as byte arrays: bounded slices of Arrow batches, words, and 64-bit hashes.

Texts stay UTF-8 bytes in one flat array with document offsets. Every separator
used here is ASCII, and no byte of a longer UTF-8 character is, so words can be
cut on bytes. Nothing is per-row Python.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.session import checkpoint_dir

#: Bytes of text a task holds as arrays at once; a longer single text is held whole.
SLICE_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

#: `[^\x20\x09-\x0D]+`: everything between ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing: digits, letters, non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One 64-bit value for each byte, for rolling hashes.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of data[start:end] for each span; equal bytes give equal hashes.

    `values` has a 64-bit value for each byte. A hash is a polynomial in an odd
    constant modulo 2^64, taken from prefix sums.
    """
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretches(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """First row and end of stretches of whole rows of up to `size` bytes, or of one longer row, by the rows' n+1 offsets."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end
        row = end


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of whole rows of up to `size` text bytes, with their bytes and offsets."""
    for batch in batches:
        data, offsets = flat_bytes(batch.column(column))
        for row, end in stretches(offsets, size):
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
    give_back()


@lru_cache(maxsize=1)
def _trimmer() -> Callable[[int], int] | None:
    """The C library's function that returns freed memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Return freed memory to the system: Spark keeps idle workers, and others work beside them."""
    pa.default_memory_pool().release_unused()
    trim = _trimmer()
    if trim is not None:
        trim(0)


def lean(work: Callable[..., pa.Table], *tables: pa.Table) -> pa.Table:
    """What `work` makes of the tables of a group, its own memory given back."""
    made = work(*tables)
    give_back()
    return made


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n+1 offsets into them per document."""
    inside = is_word[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags[offsets[i]:offsets[i+1]] for each i, empty runs included."""
    sums = np.zeros(len(flags) + 1, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


class SpanMemory:
    """Ragged unsigned 32-bit values of byte strings, found by 64-bit hashes.

    `learn` gives the values of distinct strings, end to end, and their n+1
    offsets. The first `limit` strings are remembered; others are learned again
    in each call. Remembered hashes lie in sorted runs of geometric sizes, so
    adding costs a logarithm of copies.
    """

    def __init__(self, learn: Callable[[Sequence[bytes]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.learn, self.limit, self.count = learn, limit, 0
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.values, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    def _hold(self, values: np.ndarray) -> None:
        """Put values behind the used ones, which stay only if `used` is moved."""
        if self.used + len(values) > len(self.values):
            grown = np.zeros(max(2 * len(self.values), self.used + len(values)), dtype=np.uint32)
            grown[: self.used] = self.values[: self.used]
            self.values = grown
        self.values[self.used : self.used + len(values)] = values

    def _add(self, run: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self.runs.append(run)
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            both = [np.concatenate(pair) for pair in zip(self.runs[-2], self.runs[-1])]
            order = np.argsort(both[0], kind="stable")
            self.runs[-2:] = [tuple(column[order] for column in both)]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of data[start:end] for each span, end to end, and n+1 offsets per span."""
        hashes, sample, place = np.unique(span_hashes(data, starts, ends, BYTE_VALUES), return_index=True, return_inverse=True)
        first, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        missing = np.ones(len(hashes), dtype=bool)
        for known, known_first, known_sizes in self.runs:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            first[hit], sizes[hit] = known_first[at[hit]], known_sizes[at[hit]]
            missing &= ~hit
        if missing.any():
            raw, spans = data.tobytes(), sample[missing]
            values, cuts = self.learn([raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist())])
            self._hold(values)
            first[missing], sizes[missing] = self.used + cuts[:-1], np.diff(cuts)
            if self.count + len(spans) <= self.limit:
                self.used += len(values)
                self.count += len(spans)
                self._add((hashes[missing], first[missing], sizes[missing]))
        first, sizes = first[place], sizes[place]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return self.values[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])], offsets


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column of data[offsets[i]:offsets[i+1]] in bytes."""
    width = data.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets * width, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id as a long and the text, whatever other columns there are."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, to choose numbers of blocks and partitions from."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions_for(spark: SparkSession, size: int, each: int = 16 << 20) -> int:
    """Partitions for so many bytes: the session's number, or more if they would be larger than `each`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one that the session names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, is columnar, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
