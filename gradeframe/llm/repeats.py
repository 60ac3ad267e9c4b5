"""Suffix-array dedup (operator 9): remove every byte of a long string that also starts earlier.

A window is a string of 100 bytes. Its anchor is the leftmost least hash of the
32-byte strings in it, so equal windows have equal anchors at equal offsets, and
neighbouring windows with one anchor form a run of at most 69 windows. Only
anchors that occur twice can belong to repeated windows.

Documents are dealt into blocks (one shuffle, read three times):

1. A block sends its distinct anchor hashes to hash buckets and learns which of
   them occur elsewhere or twice.
2. It sends the bytes of runs with such anchors, each distinct run once with its
   first place. A bucket builds the suffix array of its distinct runs by
   two-stage sorting: it sorts only the suffixes smaller than their successors,
   induces the rest by one scan over the first-byte buckets, and compares
   adjacent suffixes. Windows with 100 bytes in common are one group, whose
   first place keeps its bytes.
3. The block learns each run's first place and which of that place's windows
   also start earlier, and removes the bytes. A run that is not at its first
   place is removed whole.

Copies collapse to one run per block before they are shuffled, so a group of
copies is no hot key. An anchor with more distinct runs than `runs_limit`, added
up over the blocks, is not compared in one bucket: its distinct windows go by
their own 128-bit hashes to buckets of their own, with their first places, and
the bucket tells each block whether it holds the first place of all.

Nothing is kept by probability but the identity of 64-bit hashes of anchors and
runs together, and of those 128 bits; other equal windows are compared byte by
byte.

Contract: one row per document row; null texts are empty; matches never cross
documents; a null id is smaller than all others; rows with the same id are the
same document, so identical ones remove nothing of each other; texts of any
length are taken in overlapping pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gradeframe.llm.lm import bucket_bounds, packed_counts, unpacked_counts
from gradeframe.llm.text import BYTE_VALUES, binary_column, flat_bytes, lean, mix, ragged, run_sums, span_hashes, stretches, text_bytes

WINDOW = 100
ANCHOR = 32
#: Bytes that are looked at together: arrays of eight bytes for each byte have this length, not a block's.
PIECE_BYTES = 1 << 18
BLOCK_BYTES = 4 << 20
#: Distinct runs of one anchor that a bucket compares, of up to 168 bytes each.
RUNS_LIMIT = 1 << 14
#: Buckets of windows for each bucket of runs: a block has many more windows than runs.
WINDOW_BUCKETS = 4

#: Other values for each byte, for the second half of a window's hash.
_OTHER_VALUES = mix(BYTE_VALUES + np.uint64(1))
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_FIRST = np.iinfo(np.int64).min


def runs_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, and anchor hash of all runs, in order of start."""
    found = []
    begin = 0
    ends = np.repeat(offsets[1:], np.diff(offsets)) if len(data) < PIECE_BYTES * 2 else None
    while begin + window <= len(data):
        stop = min(begin + PIECE_BYTES, len(data) - window + 1)
        piece = data[begin : stop + window - 1]
        grams = len(piece) - anchor + 1
        at = np.arange(grams)
        hashes = span_hashes(piece, at, at + anchor, BYTE_VALUES)
        least = (hashes & ~_PLACE) | at.astype(np.uint64)
        width, wanted = 1, window - anchor + 1
        while width * 2 <= wanted:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[: stop - begin], least[wanted - width : wanted - width + stop - begin])
        anchors = (least & _PLACE).astype(np.int64)
        here = np.arange(begin, stop)
        end = ends[begin:stop] if ends is not None else offsets[np.searchsorted(offsets, here, side="right")]
        whole = here + window <= end
        change = np.ones(len(here), dtype=bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | ~whole[:-1]
        first = np.flatnonzero(change & whole)
        if len(first):
            breaks = np.flatnonzero(np.append(change | ~whole, True))
            size = breaks[np.searchsorted(breaks, first, side="right")] - first
            # Anchors are least hashes, so they lie low; mixed again they fill all buckets alike.
            found.append((first + begin, size, mix(hashes[anchors[first]])))
        begin = stop
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among these sorted ones."""
    if not len(wanted):
        return np.zeros(len(values), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


class Runs:
    """All runs of a block, and its distinct ones (by anchor and content) with their first places."""

    def __init__(self, table: pa.Table):
        # The same order in every phase: pieces of a block are cut at fixed places.
        self.table = table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.doc_ids = table["doc_id"].to_pylist()
        self.data, self.offsets = flat_bytes(table["text"])
        self.start, self.size, self.anchor = runs_of(self.data, self.offsets)

    def choose(self, chosen: np.ndarray) -> None:
        self.start, self.size, self.anchor = self.start[chosen], self.size[chosen], self.anchor[chosen]

    def places(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document id of each byte, and its place in the document."""
        doc = np.searchsorted(self.offsets, start, side="right") - 1
        ids = np.array([_FIRST if i is None else i for i in self.doc_ids], dtype=np.int64)
        return ids[doc], start - self.offsets[doc]

    def keep(self, repeated: np.ndarray) -> None:
        """Only the runs whose anchors are among these sorted hashes; name the distinct ones."""
        self.choose(_among(self.anchor, repeated))
        content = np.empty(len(self.start), dtype=np.uint64)
        for first in range(0, len(self.data), PIECE_BYTES):  # prefix sums of bounded pieces
            own = slice(*np.searchsorted(self.start, (first, first + PIECE_BYTES)))
            piece = self.data[first : first + PIECE_BYTES + 2 * WINDOW]
            content[own] = span_hashes(piece, self.start[own] - first, self.start[own] - first + self.size[own] + WINDOW - 1, BYTE_VALUES)
        self.doc_id, self.within = self.places(self.start)
        order = np.lexsort((self.within, self.doc_id, content, self.anchor))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (self.anchor[order][1:] != self.anchor[order][:-1]) | (content[order][1:] != content[order][:-1])
        self.firsts = order[fresh]
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(fresh) - 1
        self.content = content


class Windows:
    """All windows of the runs with these sorted anchors, taken away from the runs; the distinct ones with their first places."""

    def __init__(self, runs: Runs, anchors: np.ndarray):
        chosen = _among(runs.anchor, anchors)
        size = runs.size[chosen]
        self.start = np.repeat(runs.start[chosen], size) + ragged(size)
        runs.choose(~chosen)
        self.high, self.low = (np.empty(len(self.start), dtype=np.uint64) for _ in range(2))
        for first in range(0, len(runs.data) if len(self.start) else 0, PIECE_BYTES):
            own = slice(*np.searchsorted(self.start, (first, first + PIECE_BYTES)))
            piece, at = runs.data[first : first + PIECE_BYTES + WINDOW], self.start[own] - first
            self.high[own] = span_hashes(piece, at, at + WINDOW, BYTE_VALUES)
            self.low[own] = span_hashes(piece, at, at + WINDOW, _OTHER_VALUES)
        self.doc_id, self.within = runs.places(self.start)
        order, fresh = in_place_order(self.high, self.low, self.doc_id, self.within)
        self.firsts = order[fresh]
        self.number = np.empty(len(order), dtype=np.int64)
        self.number[order] = np.cumsum(fresh) - 1


def in_place_order(high: np.ndarray, low: np.ndarray, doc_id: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by both halves of a name and then by place, and where in it a name is new."""
    order = np.lexsort((within, doc_id, low, high))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    return order, fresh


def type_of(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is larger than its successor (the last one is)."""
    n = len(text)
    step = np.append(text[:-1] != text[1:], True)
    following = np.minimum.accumulate(np.where(step, np.arange(n), n)[::-1])[::-1]
    return text[following] > np.append(text[1:], 0)[following] if n else np.zeros(0, bool)


def _eights(text: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each place as a big-endian number."""
    padded = np.concatenate((text, np.zeros(depth + 8, dtype=np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        padded = (padded[: len(padded) - width] << np.uint64(8 * width)) | padded[width:]
    return padded


def two_stage_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by the first `depth` bytes: sort the smaller-than-successor suffixes, induce the rest."""
    n = len(text)
    larger = type_of(text)
    larger[n - 1 :] = True
    eights = _eights(text, depth)
    # Stage 1: sort directly, eight bytes at a time, only among suffixes that are still equal.
    order = np.flatnonzero(~larger)
    group = np.zeros(len(order), dtype=np.int64)
    live = np.arange(len(order))
    for shift in range(0, depth, 8):
        own, key = order[live], eights[order[live] + shift]
        by = np.lexsort((key, group[live]))
        order[live], key = own[by], key[by]
        fresh = np.ones(len(live), dtype=bool)
        fresh[1:] = (group[live][1:] != group[live][:-1]) | (key[1:] != key[:-1])
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        alone = fresh & np.append(fresh[1:], True)
        live = live[~alone]
        if not len(live):
            break
    # Stage 2: within a first-byte bucket the larger ones stand first; one scan from the left fills them.
    totals = np.bincount(text, minlength=256)
    ends = np.cumsum(totals)
    starts = ends - totals
    out = np.full(n, -1, dtype=np.int64)
    small = np.bincount(text[order], minlength=256)
    out[np.repeat(ends - small - np.concatenate(([0], np.cumsum(small)[:-1])), small) + np.arange(len(order))] = order
    filled = starts.copy()

    def induce(scanned: np.ndarray) -> None:
        before = scanned[scanned > 0] - 1
        before = before[larger[before]]
        before = before[np.argsort(text[before], kind="stable")]
        byte = text[before]
        each = np.bincount(byte, minlength=256)
        out[np.repeat(filled - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(len(before))] = before
        np.add(filled, each, out=filled)

    if n:
        out[filled[text[n - 1]]] = n - 1
        filled[text[n - 1]] += 1
    for byte in np.flatnonzero(totals):
        done = starts[byte]
        while done < filled[byte]:
            upto = filled[byte]
            induce(out[done:upto])
            done = upto
        induce(out[ends[byte] - small[byte] : ends[byte]])
    return out


def equal_neighbours(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether each place's string of `length` bytes equals that of the place before."""
    eights = _eights(text, length)
    same = np.ones(max(len(places) - 1, 0), dtype=bool)
    for shift in [*range(0, length - 7, 8), length - 8]:
        key = eights[places + shift]
        same &= key[1:] == key[:-1]
    return np.concatenate(([False], same))[: len(places)]


def first_places(anchors: np.ndarray, body: bytes, at: np.ndarray, sizes: np.ndarray, doc: np.ndarray, start: np.ndarray, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """For each distinct run, in order of its anchor, which of its windows also start earlier: two 64-bit masks per run.

    A run's bytes are body[at : at + size + WINDOW - 1]. Equal windows have equal
    anchors, so stretches of whole anchors are compared by themselves.
    """
    masks = np.zeros((len(anchors), 2), dtype=np.uint64)
    begins = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1])) if len(anchors) else np.zeros(0, np.int64)
    cuts = np.append(begins, len(anchors))
    length = sizes + WINDOW - 1
    for first, last in stretches(np.concatenate(([0], np.cumsum(length)))[cuts], piece_bytes):
        own = slice(cuts[first], cuts[last])
        contents = [body[a : a + n] for a, n in zip(at[own].tolist(), length[own].tolist())]
        masks[own] = later_windows(contents, sizes[own], doc[own], start[own])
    return masks


def later_windows(contents: list[bytes], sizes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The masks of some distinct runs, compared with each other."""
    text = np.frombuffer(b"\0".join(contents) + b"\0", dtype=np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contents])))[:-1]
    suffixes = two_stage_suffixes(text, WINDOW)
    run_at = np.full(len(text), -1, dtype=np.int64)
    within = ragged(sizes)
    run_at[np.repeat(begins, sizes) + within] = np.repeat(np.arange(len(contents)), sizes)
    places = suffixes[run_at[suffixes] >= 0]
    run = run_at[places]
    offset = places - begins[run]
    group = np.cumsum(~equal_neighbours(text, places, WINDOW)) if len(places) else np.zeros(0, np.int64)
    order = np.lexsort((start[run] + offset, doc[run], group))
    leads = np.ones(len(order), dtype=bool)
    leads[1:] = group[order][1:] != group[order][:-1]
    lead = order[np.maximum.accumulate(np.where(leads, np.arange(len(order)), 0))]
    # Windows of one document at one place (repeated rows) are the same window.
    later = (doc[run][order] != doc[run][lead]) | ((start[run] + offset)[order] != (start[run] + offset)[lead])
    masks = np.zeros((len(contents), 2), dtype=np.uint64)
    hit = order[later]
    np.bitwise_or.at(masks, (run[hit], offset[hit] // 64), np.uint64(1) << (offset[hit] % 64).astype(np.uint64))
    return masks


def mask_bits(masks: np.ndarray) -> np.ndarray:
    """The 128 bits of each run's two masks, lowest first, a byte each."""
    raw = np.ascontiguousarray(masks, dtype="<u8").view(np.uint8).reshape(len(masks), 16)
    return np.unpackbits(raw, axis=1, bitorder="little")


def spans_of(data: np.ndarray, start: np.ndarray, length: np.ndarray, piece_bytes: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans, end to end, and their n+1 offsets."""
    ends = np.concatenate(([0], np.cumsum(length)))
    body = np.empty(ends[-1], dtype=np.uint8)
    for a, b in stretches(ends, piece_bytes):
        body[ends[a] : ends[b]] = data[np.repeat(start[a:b], length[a:b]) + ragged(length[a:b])]
    return body, ends


def covered(size: int, start: np.ndarray, length: np.ndarray, masks: np.ndarray, whole: np.ndarray, window_starts: np.ndarray) -> np.ndarray:
    """Which of `size` bytes lie in whole runs (of `length` bytes), or in windows: those of the other runs' masks, and further ones."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, start[whole], 1)
    np.add.at(change, (start + length)[whole], -1)
    part = start[~whole]
    for a in range(0, len(part), 1 << 12):
        which, offset = np.nonzero(mask_bits(masks[a : a + (1 << 12)]))
        places = part[a : a + (1 << 12)][which] + offset
        np.add.at(change, places, 1)
        np.add.at(change, places + WINDOW, -1)
    np.add.at(change, window_starts, 1)
    np.add.at(change, window_starts + WINDOW, -1)
    return np.cumsum(change, out=change)[:-1] > 0


def _bytes(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _packed(rows: dict[str, np.ndarray], bounds: np.ndarray) -> dict[str, pa.Array]:
    some = np.flatnonzero(np.diff(bounds))
    cut = np.append(bounds[some], bounds[-1])
    return {"bucket": pa.array(some, pa.int32())} | {name: binary_column(np.ascontiguousarray(values), cut) for name, values in rows.items()}


def with_removed(docs: DataFrame, finish, schema: str | StructType, extra: list[str] | None = None, block_bytes: int = BLOCK_BYTES, runs_limit: int = RUNS_LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Find the bytes to remove and let `finish(table, data, offsets, removed)` make each block's rows of `schema`.

    `removed` is a boolean for each byte. `extra` names further columns that
    `finish` gets in its table.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), *[F.col(c).alias(f"_{c}") for c in extra or []])
    blocks = max(1, -(-text_bytes(rows) // block_bytes))
    # The text is part of the key: rows that share an id need not share a block.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask_anchors(table: pa.Table) -> pa.Table:
        runs = Runs(table)
        keys, counts = np.unique(runs.anchor, return_counts=True)
        runs.keep(keys[counts > 1])
        # At least 2 for an anchor that occurs twice, and at least its distinct runs.
        distinct = np.bincount(np.searchsorted(keys, runs.anchor[runs.firsts]), minlength=len(keys))
        bounds = bucket_bounds(keys, blocks)
        packed = _packed({"keys": keys}, bounds)
        packed["counts"] = packed_counts(np.maximum(np.minimum(counts, 2), distinct), np.append(bounds[packed["bucket"].to_numpy()], bounds[-1]))
        return pa.table(packed | {"block": pa.array(np.full(len(packed["bucket"]), table["block"][0].as_py()), pa.int32())}).select(["bucket", "block", "keys", "counts"])

    def tell_anchors(table: pa.Table) -> pa.Table:
        keys, inverse = np.unique(_bytes(table["keys"], np.uint64), return_inverse=True)
        total = np.bincount(inverse, weights=unpacked_counts(table["counts"]), minlength=len(keys))[inverse]
        cut = np.concatenate(([0], np.cumsum([len(k) // 8 for k in table["keys"].to_pylist()])))

        def chosen(which: np.ndarray) -> pa.Array:
            return binary_column(keys[inverse][which], np.concatenate(([0], np.cumsum(which)))[cut])

        return pa.table({"block": table["block"], "keys": chosen((total > 1) & (total <= runs_limit)), "many": chosen(total > runs_limit)})

    def ask_runs(mine: pa.Table, told: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return empty_runs
        runs = Runs(mine)
        block = mine["block"][0].as_py()
        many = np.sort(_bytes(told["many"], np.uint64))
        windows = Windows(runs, many)
        runs.keep(np.sort(_bytes(told["keys"], np.uint64)))
        own = runs.firsts
        bounds = bucket_bounds(runs.anchor[own], blocks)
        packed = _packed({"keys": runs.anchor[own], "names": runs.content[own], "sizes": runs.size[own].astype(np.uint8), "docs": runs.doc_id[own], "starts": runs.within[own]}, bounds)
        body, ends = spans_of(runs.data, runs.start[own], runs.size[own] + WINDOW - 1)
        some = packed["bucket"].to_numpy()
        packed["contents"] = binary_column(body, ends[np.append(bounds[some], bounds[-1])])
        packed["block"] = pa.array(np.full(len(some), block), pa.int32())
        asked = pa.table(packed).select(empty_runs.column_names)
        if not len(many):
            return asked
        own = windows.firsts
        packed = _packed({"keys": windows.high[own], "names": windows.low[own], "docs": windows.doc_id[own], "starts": windows.within[own]}, bucket_bounds(windows.high[own], blocks * WINDOW_BUCKETS))
        rows_ = len(packed["bucket"])
        # Buckets of windows stand behind those of runs; the first row has the anchors, for the block to know them again.
        packed["bucket"] = pa.array(packed["bucket"].to_numpy() + blocks, pa.int32())
        packed |= {"block": pa.array(np.full(rows_, block), pa.int32()), "sizes": pa.array([b""] * rows_, pa.binary()), "contents": pa.array([many.tobytes()] + [b""] * (rows_ - 1), pa.binary())}
        return pa.concat_tables([asked, pa.table(packed).select(empty_runs.column_names)])

    def tell_windows(table: pa.Table) -> pa.Table:
        """Whether each block's first place of a window is the first of all."""
        docs_, starts = _bytes(table["docs"], np.int64), _bytes(table["starts"], np.int64)
        order, fresh = in_place_order(_bytes(table["keys"], np.uint64), _bytes(table["names"], np.uint64), docs_, starts)
        lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        first = np.empty(len(order), dtype=np.uint8)
        first[order] = (docs_[order] == docs_[lead]) & (starts[order] == starts[lead])
        cut = np.concatenate(([0], np.cumsum([len(k) // 8 for k in table["keys"].to_pylist()])))
        none = pa.array([b""] * table.num_rows, pa.binary())
        return pa.table({"block": table["block"], "bucket": table["bucket"], "keys": table["contents"], "docs": none, "starts": none, "masks": binary_column(first, cut)})

    def tell_runs(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() >= blocks:
            return tell_windows(table)
        keys, names = _bytes(table["keys"], np.uint64), _bytes(table["names"], np.uint64)
        sizes = _bytes(table["sizes"], np.uint8).astype(np.int64)
        docs_, starts = _bytes(table["docs"], np.int64), _bytes(table["starts"], np.int64)
        length = sizes + WINDOW - 1
        at = np.concatenate(([0], np.cumsum(length)))
        body = b"".join(table["contents"].to_pylist())
        order = np.lexsort((starts, docs_, names, keys))
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (names[order][1:] != names[order][:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(fresh) - 1
        firsts = order[fresh]
        # An anchor with one content needs no comparison: its first place keeps its bytes.
        anchors = keys[firsts]
        several = np.zeros(len(firsts), dtype=bool)
        several[1:] |= anchors[1:] == anchors[:-1]
        several[:-1] |= anchors[1:] == anchors[:-1]
        masks = np.zeros((len(firsts), 2), dtype=np.uint64)
        some = firsts[several]
        if len(some):
            masks[several] = first_places(keys[some], body, at[some], sizes[some], docs_[some], starts[some])
        cut = np.concatenate(([0], np.cumsum([len(k) // 8 for k in table["keys"].to_pylist()])))
        return pa.table({
            "block": table["block"], "bucket": table["bucket"], "keys": table["keys"], "docs": binary_column(docs_[firsts][number], cut), "starts": binary_column(starts[firsts][number], cut),
            "masks": binary_column(np.ascontiguousarray(masks[number]).reshape(-1), 2 * cut),
        })

    def remove(mine: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by("bucket")
        of_runs = int(np.searchsorted(told["bucket"].to_numpy(), blocks))
        told, of_windows = told.slice(0, of_runs), told.slice(of_runs)
        runs = Runs(mine)
        windows = Windows(runs, np.sort(_bytes(of_windows["keys"], np.uint64)))
        runs.keep(np.unique(_bytes(told["keys"], np.uint64)))
        first, masks = np.zeros(0, dtype=bool), np.zeros((0, 2), dtype=np.uint64)
        if len(runs.start):
            first = (_bytes(told["docs"], np.int64)[runs.number] == runs.doc_id) & (_bytes(told["starts"], np.int64)[runs.number] == runs.within)
            masks = _bytes(told["masks"], np.uint64).reshape(-1, 2)[runs.number[first]]
        gone = windows.start
        if len(gone):
            lead = windows.firsts[windows.number]
            kept = _bytes(of_windows["masks"], np.uint8)[windows.number] == 1
            kept &= (windows.doc_id == windows.doc_id[lead]) & (windows.within == windows.within[lead])
            gone = gone[~kept]
        return finish(runs.table, runs.data, runs.offsets, covered(len(runs.data), runs.start, runs.size + WINDOW - 1, masks, ~first, gone))

    kinds = "bucket int, block int, keys binary, names binary, sizes binary, docs binary, starts binary, contents binary"
    empty_runs = pa.table({c.split()[0]: pa.array([], pa.int32() if c.endswith(" int") else pa.binary()) for c in kinds.split(", ")})
    anchors = dealt.groupBy("block").applyInArrow(lambda t: lean(ask_anchors, t), "bucket int, block int, keys binary, counts binary").groupBy("bucket").applyInArrow(lambda t: lean(tell_anchors, t), "block int, keys binary, many binary")
    runs = dealt.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(lambda t, u: lean(ask_runs, t, u), kinds)
    told = runs.groupBy("bucket").applyInArrow(lambda t: lean(tell_runs, t), "block int, bucket int, keys binary, docs binary, starts binary, masks binary")
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, u: lean(remove, t, u), schema)


def summaries(table: pa.Table, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
    """Per document: bytes, removed bytes, maximal removed runs, digest of what is left."""
    sums = np.concatenate(([0], np.cumsum(removed)))
    begins = removed.copy()
    begins[1:] &= ~removed[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = removed[first]
    spans = np.concatenate(([0], np.cumsum(begins)))
    digests = [hashlib.sha256(data[a:b][~removed[a:b]].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
    return pa.table({
        "doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64()),
        "n_spans": pa.array(spans[offsets[1:]] - spans[offsets[:-1]], pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
    })


def find_repeats(docs: DataFrame, **options) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256."""
    return with_removed(docs, summaries, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", **options)


def kept_characters(data: np.ndarray, offsets: np.ndarray, removed: np.ndarray, piece_bytes: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each byte's character has a byte that is not removed; per document its bytes and characters of that kind."""
    kept = np.empty(len(data), dtype=bool)
    sizes, lengths = (np.zeros(len(offsets) - 1, dtype=np.int64) for _ in range(2))
    for a, b in stretches(offsets, piece_bytes):
        own, bounds = slice(offsets[a], offsets[b]), offsets[a : b + 1] - offsets[a]
        lead = (data[own] & 0xC0) != 0x80
        lead[bounds[:-1][np.diff(bounds) > 0]] = True
        begins = np.flatnonzero(lead)
        if len(begins):
            stays = np.logical_or.reduceat(~removed[own], begins)
            kept[own] = np.repeat(stays, np.diff(np.append(begins, len(lead))))
        sizes[a:b] = run_sums(kept[own], bounds)
        lengths[a:b] = run_sums(kept[own] & lead, bounds)
    return kept, sizes, lengths


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", count_column: str = "n_chars", **options) -> DataFrame:
    """The documents with their repeated bytes taken out of the text, all columns kept.

    A character stays unless all of its bytes go, so texts remain UTF-8.
    `count_column`, if there is one, gets the new text's length.
    """
    names = list(docs.columns)
    others = [c for c in names if c != text_column]

    def cut(table: pa.Table, data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> pa.Table:
        kept, sizes, lengths = kept_characters(data, offsets, removed)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(ends, dtype=np.int64)), pa.py_buffer(data[kept]))
        columns = {}
        for name in names:
            if name == text_column:
                columns[name] = texts.cast(pa.string())
            elif name == count_column:
                columns[name] = pa.array(lengths, pa.int64())
            else:
                columns[name] = table[f"_{name}"]
        return pa.table(columns)

    schema = StructType([StructField(f.name, LongType() if f.name == count_column else StringType() if f.name == text_column else f.dataType) for f in docs.schema.fields])
    return with_removed(docs, cut, schema, others, id_column=id_column, text_column=text_column, **options).select([F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema.fields])
