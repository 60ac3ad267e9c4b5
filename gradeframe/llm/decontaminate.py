"""Benchmark decontamination (operator 2): suffix arrays of the training texts.

Each task takes its documents in shards of bounded size. A shard's words become
ranks in the benchmark's vocabulary, and its suffixes are sorted: a suffix array
over the places where a benchmark suffix can begin, which are those followed by
enough benchmark words. Every suffix of every benchmark item is then found by
binary search; the interval it spans holds all places where it occurs. Matches
one word apart join into the longest verbatim matches. Documents that match too
much are flagged or removed.

The benchmark is the query set and is broadcast only up to a checked size; a
larger one is taken in blocks, and a document's findings of all blocks are
merged. Documents are neither shuffled nor sampled in the first case.

Contract: one row per document row; null and empty texts have no words and are
clean; benchmark items with a null id or no word are passed over; an empty
benchmark matches nothing; repeated rows of either table change nothing but the
number of rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from gradeframe.llm.text import ALNUM, BYTE_VALUES, LOWER, id_and_text, ragged, slices, span_hashes, text_bytes, word_spans

WINDOW = 13
#: Bytes of benchmark text that are broadcast at once.
BROADCAST_BYTES = 32 << 20

VALUES = BYTE_VALUES[LOWER]
_MATCH = "array<struct<item_id: long, word_start: long, n_words: long>>"


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, offsets, ALNUM)
    return span_hashes(data, starts, ends, VALUES), first


class TestSuffixes:
    """Distinct suffixes of benchmark items, cut at the window's length, as sortable strings of ranks."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        raw = [(i, (t or "").encode()) for i, t in items if i is not None]
        data = np.frombuffer(b"".join(t for _, t in raw), dtype=np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for _, t in raw]))).astype(np.int64)
        words, first = hashed_words(data, offsets)
        counts = np.diff(first)
        self.vocabulary = np.unique(words)
        self.window = window
        ranks = np.searchsorted(self.vocabulary, words).astype(np.uint32) + 1
        length = np.minimum(counts, window)
        suffixes = np.where(counts > 0, counts - length + 1, 0)
        item = np.repeat(np.arange(len(raw)), suffixes)
        start = ragged(suffixes) + np.repeat(first[:-1], suffixes)
        size = length[item]
        padded = np.concatenate((ranks, np.zeros(window, dtype=np.uint32)))
        strings = padded[start[:, None] + np.arange(window)]
        strings[np.arange(window) >= size[:, None]] = 0
        keys = as_strings(strings)
        self.keys, inverse = np.unique(keys, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        # What ends a suffix's interval: the suffix continued with the largest rank there is.
        strings[np.arange(window) >= size[:, None]] = 0xFFFFFFFF
        self.ends = np.empty_like(self.keys)
        self.ends[inverse] = as_strings(strings)
        self.sizes = np.zeros(len(self.keys), dtype=np.int64)
        self.sizes[inverse] = size
        #: Items (and places in them) of each distinct suffix.
        self.bounds = np.searchsorted(inverse[order], np.arange(len(self.keys) + 1))
        self.items = np.array([i for i, _ in raw], dtype=np.int64)[item][order]
        self.places = (start - np.repeat(first[:-1], suffixes))[order]
        self.shortest = int(size.min()) if len(size) else window


def as_strings(ranks: np.ndarray) -> np.ndarray:
    """Rows of ranks as byte strings in the same order."""
    rows = np.ascontiguousarray(ranks.astype(">u4"))
    return rows.view(f"S{4 * ranks.shape[1]}").reshape(-1)


class Shard:
    """The suffix array of some documents over the places where a test suffix can begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tests: TestSuffixes):
        words, self.first = hashed_words(data, offsets)
        self.counts = np.diff(self.first)
        docs = len(self.counts)
        # A 0 ends each document, so no suffix runs into the next one.
        ranks = np.zeros(len(words) + docs + tests.window, dtype=np.uint32)
        self.doc_of = np.repeat(np.arange(docs), self.counts)
        if len(tests.vocabulary) and len(words):
            at = np.minimum(np.searchsorted(tests.vocabulary, words), len(tests.vocabulary) - 1)
            ranks[np.arange(len(words)) + self.doc_of] = np.where(tests.vocabulary[at] == words, at + 1, 0)
        gaps = np.flatnonzero(ranks == 0)
        ahead = gaps[np.searchsorted(gaps, np.arange(len(words) + docs))] - np.arange(len(words) + docs)
        places = np.flatnonzero(ahead >= tests.shortest)
        keys = as_strings(ranks[places[:, None] + np.arange(tests.window)])
        order = np.argsort(keys, kind="stable")
        self.suffixes, self.keys = places[order], keys[order]

    def find(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all occurrences: the document, the word's place in it, and the number of the test suffix."""
        if not len(self.keys) or not len(tests.keys):
            return (np.zeros(0, np.int64),) * 3
        low = np.searchsorted(self.keys, tests.keys, side="left")
        high = np.searchsorted(self.keys, tests.ends, side="right")
        hits = high - low
        place = self.suffixes[np.repeat(low, hits) + ragged(hits)]
        ends = self.first[1:] + np.arange(1, len(self.first))
        doc = np.searchsorted(ends, place, side="right")
        return doc, place - doc - self.first[doc], np.repeat(np.arange(len(tests.keys)), hits)


def longest_matches(doc: np.ndarray, place: np.ndarray, test: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """Join occurrences one word apart on both sides: document, item, first word, number of words."""
    each = tests.bounds[test + 1] - tests.bounds[test]
    at = np.repeat(tests.bounds[test], each) + ragged(each)
    doc, place, size = np.repeat(doc, each), np.repeat(place, each), np.repeat(tests.sizes[test], each)
    item, within = tests.items[at], tests.places[at]
    order = np.lexsort((place, place - within, item, doc))
    doc, place, size, item, shift = doc[order], place[order], size[order], item[order], (place - within)[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] > place[:-1] + 1)
    starts = np.flatnonzero(fresh)
    last = np.append(starts[1:], len(doc))[: len(starts)] - 1
    return doc[starts], item[starts], place[starts], (place + size)[last] - place[starts]


def shard_matches(data: np.ndarray, offsets: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, list[set[int]], tuple[np.ndarray, ...]]:
    """Per document: words, words hit, items found; and the longest matches of all."""
    shard = Shard(data, offsets, tests)
    doc, place, test = shard.find(tests)
    found = longest_matches(doc, place, test, tests)
    change = np.zeros(int(shard.first[-1]) + 1, dtype=np.int64)
    np.add.at(change, shard.first[doc] + place, 1)
    np.add.at(change, shard.first[doc] + place + tests.sizes[test], -1)
    hit = (np.cumsum(change)[:-1] > 0).astype(np.int64)
    items: list[set[int]] = [set() for _ in shard.counts]
    for d, i in zip(found[0].tolist(), found[1].tolist()):
        items[d].add(i)
    sums = np.concatenate(([0], np.cumsum(hit)))
    return shard.counts, sums[shard.first[1:]] - sums[shard.first[:-1]], items, found


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def too_much(n_hit: int, n_words: int, share: int = 20) -> bool:
    """Contaminated: at least a 20th of the words are hit."""
    return n_hit > 0 and share * n_hit >= n_words


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, limit: int) -> list[DataFrame]:
    items = benchmark.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL").distinct()
    number = max(1, -(-text_bytes(items) // limit))
    return [items] if number == 1 else [items.filter(F.pmod(F.xxhash64("doc_id"), F.lit(number)) == b) for b in range(number)]


def _matches_column(found: tuple[np.ndarray, ...], docs: int) -> pa.Array:
    bounds = np.searchsorted(found[0], np.arange(docs + 1)).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found[1:]], names=["item_id", "word_start", "n_words"])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the longest matches with their places."""
    return _judged(docs, _blocks(benchmark, item_column, item_text, broadcast_bytes), window, id_column, text_column).drop("mark")


def _judged(docs: DataFrame, blocks: list[DataFrame], window: int, id_column: str, text_column: str) -> DataFrame:
    """What find_contamination gives; of several blocks also `mark`, a hash of the row's text."""
    rows = id_and_text(docs, id_column, text_column)
    spark = docs.sparkSession
    parts = []
    for block in blocks:
        tests = spark.sparkContext.broadcast(TestSuffixes([(r["doc_id"], r["text"]) for r in block.toLocalIterator()], window))

        def run(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in slices(batches):
                counts, hits, items, found = shard_matches(data, offsets, tests.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([digest(i) for i in items]),
                     pa.array([too_much(h, n) for h, n in zip(hits.tolist(), counts.tolist())], pa.bool_()), _matches_column(found, len(counts))] + ([part.column("mark")] if "mark" in part.schema.names else []),
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "matches"] + ["mark"] * ("mark" in part.schema.names),
                )

        parts.append((run, len(parts)))
    schema = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches {_MATCH}"
    if len(parts) == 1:
        return rows.mapInArrow(parts[0][0], schema)
    marked = rows.withColumn("mark", F.xxhash64("text"))
    all_blocks = None
    for run, number in parts:
        one = marked.mapInArrow(run, schema + ", mark long").groupBy("doc_id", "mark", "n_words").agg(F.first("matches").alias("matches"), F.count(F.lit(1)).alias("times")).withColumn("part", F.lit(number))
        all_blocks = one if all_blocks is None else all_blocks.unionByName(one)
    merged = all_blocks.groupBy("doc_id", "mark", "n_words").agg(F.flatten(F.collect_list("matches")).alias("matches"), F.max("times").alias("times"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, mark, n, found, times in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "n_words", "matches", "times"))):
                hit = np.zeros(n, dtype=bool)
                for m in found:
                    hit[m["word_start"] : m["word_start"] + m["n_words"]] = True
                items = {m["item_id"] for m in found}
                row = {"doc_id": doc_id, "n_words": n, "n_hit": int(hit.sum()), "n_items": len(items), "items_sha256": digest(items), "contaminated": too_much(int(hit.sum()), n), "matches": found, "mark": mark}
                out += [row] * times
            yield pa.RecordBatch.from_pylist(out, batch_schema)

    batch_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("matches", pa.list_(pa.struct([("item_id", pa.int64()), ("word_start", pa.int64()), ("n_words", pa.int64())]))), ("mark", pa.int64())])
    return merged.select("doc_id", "mark", "n_words", "matches", "times").mapInArrow(again, schema + ", mark long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = _blocks(benchmark, "item_id", "text", broadcast_bytes)
    if len(blocks) > 1:
        # Each row goes by its own text: rows may share an id or have none.
        bad = _judged(docs, blocks, window, id_column, text_column).filter("contaminated").select(F.col("doc_id").alias("_bad"), F.col("mark").alias("_mark")).distinct()
        same = F.col(id_column).cast("long").eqNullSafe(F.col("_bad")) & F.xxhash64(F.col(text_column).cast("string")).eqNullSafe(F.col("_mark"))
        return docs.join(bad, same, "left_anti")
    tests = docs.sparkSession.sparkContext.broadcast(TestSuffixes([(r["doc_id"], r["text"]) for r in blocks[0].toLocalIterator()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, text_column):
            counts, hits, _, _ = shard_matches(data, offsets, tests.value)
            yield part.filter(pa.array([not too_much(h, n) for h, n in zip(hits.tolist(), counts.tolist())], pa.bool_()))

    return docs.mapInArrow(run, StructType(docs.schema.fields))
