"""Target-distribution importance resampling (operator 13): documents drawn by how much they look like a target.

Texts are bags of hashed word runs: each run of 1 to n consecutive words falls
into the bucket of its CRC-32. A bucket's gain is the log ratio of its share in
the target table to its share in the raw one, both smoothed by one; a document's
weight is the sum of its runs' gains, looked up as arrays. Its score adds a
Gumbel value made of its id, so the highest scores are a draw without
replacement in proportion to exp(weight).

The cutoff, the k-th best key (score, then doc_id), is found by weighted
median-of-medians selection. Each round reads the keys that remain once:
pieces of a partition tell how many keys lie before and at the current pivot,
and the median of either side. The driver picks the side that holds the cutoff
and takes the median of that side's medians, weighted by the sizes they stand
for, as next pivot: a quarter of what remains or more lies on either side of it
and goes next time. Keys that remain are written anew whenever they have shrunk
to a quarter, so all rounds together read a small multiple of the keys, and the
last few are looked at one by one. Then only the winners are sorted, by ranges.

The driver sees one row for each piece of `PIECE` keys, 40 bytes of counts
and medians: 50 MB for 10^11 documents.

Contract: null and empty texts have no runs and weight 0; texts of any length
are read whole. A null id is hashed as empty text and comes before all others.
Repeated rows count as often as they occur, in the counts and in the draw; rows
with equal score and id come in the order of fewer runs, then lower weight; rows
alike in all of that are the same in the result. Empty tables give no rows; an
empty target leaves the smoothing alone. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.text import ALNUM, LOWER, id_and_text, ragged, run_sums, slices, stored, word_spans

#: Runs up to this many bytes are hashed by table, longer ones one by one.
TABLED = 64
#: Keys that tell one median.
PIECE = 1 << 16
#: Keys that are few enough to be sorted on the driver.
FEW = 4096
#: Documents to a task that sorts winners.
SORTED_ROWS = 1 << 20

#: Reversed polynomial of CRC-32 (a fixed value of the public checksum).
POLYNOMIAL = 0xEDB88320


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What byte b, followed by j more bytes, adds to a CRC-32; and the CRC-32 of n zero bytes.

    A CRC is linear: the checksum of a run is that of as many zero bytes, with
    the parts of all its bytes xored in.
    """
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1).astype(np.uint32)
    parts = np.empty((TABLED, 256), dtype=np.uint32)
    parts[0] = one
    for j in range(1, TABLED):
        parts[j] = (parts[j - 1] >> 8) ^ one[parts[j - 1] & 0xFF]
    return parts, np.array([zlib.crc32(bytes(n)) for n in range(TABLED + 1)], dtype=np.uint32)


PARTS, ZEROS = _tables()


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each non-empty span."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    short = np.flatnonzero(lengths <= TABLED)
    if len(short):
        n = lengths[short]
        place = ragged(n)
        after = np.repeat(n, n) - 1 - place
        parts = PARTS[after, data[np.repeat(starts[short], n) + place]]
        first = np.cumsum(n) - n
        out[short] = np.bitwise_xor.reduceat(parts, first) ^ ZEROS[n]
    for k in np.flatnonzero(lengths > TABLED):
        out[k] = zlib.crc32(data[starts[k] : ends[k]])
    return out


def run_buckets(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `longest` words, the document of each, and words per document."""
    starts, ends, at = word_spans(data, offsets, ALNUM)
    data = LOWER[data]
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if longest > 1 and len(starts):
        # One space between words, so that every run is one span.
        lengths = ends - starts
        new = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        joined = np.full(int((lengths + 1).sum()), 0x20, dtype=np.uint8)
        joined[np.repeat(new, lengths) + ragged(lengths)] = data[np.repeat(starts, lengths) + ragged(lengths)]
        data, starts, ends = joined, new, new + lengths
    found, owners = [], []
    for n in range(1, longest + 1):
        first = np.arange(max(len(starts) - n + 1, 0))
        first = first[owner[first] == owner[first + n - 1]]
        found.append(span_crcs(data, starts[first], ends[first + n - 1]) % np.uint32(buckets))
        owners.append(owner[first])
    return np.concatenate(found), np.concatenate(owners), sizes


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many runs of all texts fall in each bucket; every task counts its own share first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for _, data, offsets in slices(batches):
            counts += np.bincount(run_buckets(data, offsets, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, in doubles."""
    k, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s_all + k)) / ((raw + 1.0) * (t_all + k))
    return np.array([math.floor(1000.0 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for few, data, offsets in slices(batches):
            found, owner, sizes = run_buckets(data, offsets, longest, len(gain))
            order = np.argsort(owner, kind="stable") if longest > 1 else slice(None)
            runs = np.bincount(owner, minlength=len(sizes))
            weight = run_sums(gain[found[order]], np.concatenate(([0], np.cumsum(runs))))
            yield pa.RecordBatch.from_arrays(
                [few.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, pa.int64()), pa.array(weight, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u made of the first 32 bits of sha256(`seed:doc_id`)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


@dataclass(frozen=True, order=True)
class Key:
    """Place in the draw: better scores first, then null ids, then smaller ids."""

    lost: int  # -score
    known: int
    doc_id: int


class _Keys:
    """Arrays of keys in one piece."""

    def __init__(self, batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        self.lost = -batch.column("score").to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def versus(self, key: Key) -> np.ndarray:
        """-1, 0 or 1 for keys before, at or after one."""
        out = np.zeros(len(self.lost), dtype=np.int8)
        for column, value in ((self.ids, key.doc_id), (self.known, key.known), (self.lost, key.lost)):
            out = np.where(column < value, -1, np.where(column > value, 1, out))
        return out

    def median(self, among: np.ndarray) -> list[int] | None:
        place = np.flatnonzero(among)
        if not len(place):
            return None
        order = place[np.lexsort((self.ids[place], self.known[place], self.lost[place]))]
        k = order[(len(order) - 1) // 2]
        return [int(self.lost[k]), int(self.known[k]), int(self.ids[k])]


PIECES = "before long, at long, after long, median_before array<long>, median_after array<long>"


def _survey(keys: DataFrame, pivot: Key | None) -> list:
    """Each piece's counts around the pivot and the medians of both sides; without a pivot all keys count as after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tell() -> pa.RecordBatch:
            piece = _Keys(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            side = np.ones(len(piece.lost), np.int8) if pivot is None else piece.versus(pivot)
            counts = [int((side == s).sum()) for s in (-1, 0, 1)]
            row = dict(zip(("before", "at", "after"), ([c] for c in counts)))
            row |= {"median_before": [piece.median(side < 0)], "median_after": [piece.median(side > 0)]}
            return pa.RecordBatch.from_pydict(row, schema)

        triple = pa.list_(pa.int64())
        schema = pa.schema([("before", pa.int64()), ("at", pa.int64()), ("after", pa.int64()), ("median_before", triple), ("median_after", triple)])
        rows = 0
        for batch in batches:
            for first in range(0, batch.num_rows, PIECE):
                part = batch.slice(first, PIECE)
                if rows + part.num_rows > PIECE:
                    yield tell()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield tell()

    return keys.select("doc_id", "score").mapInArrow(run, PIECES).collect()


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    medians.sort()
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys remain")


def _between(low: Key | None, high: Key | None) -> Column:
    """Keys after `low` and before `high`, both left out."""
    place = F.struct(-F.col("score"), F.col("doc_id").isNotNull().cast("int"), F.coalesce("doc_id", F.lit(0).cast("long")))

    def literal(k: Key) -> Column:
        return F.struct(F.lit(k.lost).cast("long"), F.lit(k.known), F.lit(k.doc_id).cast("long"))

    condition = F.lit(True)
    if low is not None:
        condition = condition & (place > literal(low))
    if high is not None:
        condition = condition & (place < literal(high))
    return condition


def select_cutoff(keys: DataFrame, k: int) -> tuple[Key | None, list[int]]:
    """The k-th key (from 1) of a stored table with doc_id and score, and how many keys remained in each round."""
    if k <= 0:
        return None, []
    low = high = pivot = None
    skipped = 0  # keys known to lie before what remains
    pieces = _survey(keys, None)
    remaining = written = sum(r["after"] for r in pieces)
    if k > remaining:
        raise ValueError(f"{k} of {remaining} keys wanted")
    medians = [(Key(*r["median_after"]), r["after"]) for r in pieces]
    sizes = [remaining]
    current = keys
    while remaining > FEW:
        pivot = _weighted_median(medians)
        pieces = _survey(current.filter(_between(low, high)), pivot)
        before, at = sum(r["before"] for r in pieces), sum(r["at"] for r in pieces)
        if skipped < k - before <= skipped + at:
            return pivot, sizes
        if k <= skipped + before:
            high, remaining = pivot, before
            medians = [(Key(*r["median_before"]), r["before"]) for r in pieces if r["before"]]
        else:
            low, remaining = pivot, remaining - before - at
            skipped += before + at
            medians = [(Key(*r["median_after"]), r["after"]) for r in pieces if r["after"]]
        sizes.append(remaining)
        if remaining * 4 <= written and remaining > FEW:
            current, written = stored(current.filter(_between(low, high)), "resample-keys"), remaining
    # A bounded number of keys is left.
    left = current.filter(_between(low, high)).select("doc_id", "score").collect()
    ordered = sorted(Key(-r["score"], int(r["doc_id"] is not None), r["doc_id"] or 0) for r in left)
    return ordered[k - skipped - 1], sizes


def ranked(winners: DataFrame, rows: int) -> DataFrame:
    """Add `rank`: 1, 2, 3... by score, id, runs and weight, sorted by ranges.

    Places count inside each range; the ranges' sizes, one number each, tell
    where they start. Rows alike in everything are spread by their position.
    """
    spark = winners.sparkSession
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED_ROWS))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "n_features", "weight", "position"]
    sorted_rows = winners.withColumn("position", F.monotonically_increasing_id()).repartitionByRange(number, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(seen + 1, seen + n + 1), pa.int64())],
                names=[*batch.schema.names, "part", "place"])
            seen += n

    columns = ["doc_id", "n_features", "weight", "score"]
    # Stored once: the ranges must be the same ones when their sizes are read.
    placed = stored(sorted_rows.select(*columns).mapInArrow(run, "doc_id long, n_features long, weight long, score long, part int, place long"), "resample-winners")
    starts, before = [], 0
    for row in placed.groupBy("part").agg(F.max("place").alias("n")).orderBy("part").collect():
        starts.append((row["part"], before))
        before += row["n"]
    offsets = spark.createDataFrame(starts, "part int, start long")
    return placed.join(F.broadcast(offsets), "part").select(*columns, (F.col("start") + F.col("place")).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, min_words: int = 20, seed: int = 0,
    id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
) -> DataFrame:
    """Draw floor(percent * N / 100) of the N documents with `min_words` words or more.

    Every document comes back with doc_id, n_features, weight, score and rank, the last null for those not drawn.
    """
    rows = id_and_text(docs, id_column, text_column)
    wanted = target.select(F.col(target_text).cast("string").alias("text"))
    gain = gains(bucket_counts(rows, longest, buckets), bucket_counts(wanted, longest, buckets))
    scored = stored(weighted(rows, gain, longest).withColumn("score", F.col("weight") + gumbel(seed)), "resample-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    cutoff, _ = select_cutoff(able, drawn)
    columns = ["doc_id", "n_features", "weight", "score"]
    if cutoff is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    win = (F.col("n_words") >= min_words) & ~_between(cutoff, None)
    # Rows that tie with the cutoff are all sorted; those beyond the number wanted are not drawn.
    top = ranked(scored.filter(win), drawn)
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.unionByName(scored.filter(~win).select(*columns, F.lit(None).cast("long").alias("rank")))
