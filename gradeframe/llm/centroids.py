"""Centroid clustering (operator 12): exact k-means on integers by equal-average equal-variance search.

Components become integers floor(scale * x). For a vector x of d components
with sum S(x) and deviation V(x) = |x - mean(x)|, the squared distance to a
centroid c is never below (S(x) - S(c))^2 / d + (V(x) - V(c))^2. Centroids lie
sorted by their sums (the component means times d). The search of a vector
starts at the centroid whose sum is nearest and goes outward, always to the
nearer side, and

* ends when the first term alone exceeds the best distance so far: all others
  are farther still (equal average),
* passes over a centroid for which both terms together exceed it (equal variance),
* otherwise takes the exact integer distance; ties go to the smaller number.

All vectors of a slice take their steps together on numpy arrays. The two bounds
are floats, loosened by more than their rounding error, so they never decide a
tie; every distance is an integer. A round adds up components and counts per
cluster inside each partition, so only k sums leave it and one of each
cluster and component reaches the driver: no cluster ever gathers in a task, however hot.

Contract: vectors with another number of components, null ones, or with a null
or non-finite component are left out. A null id is hashed as empty text and
kept. Repeated rows count as often as they occur; among rows of one id the
lower components start first. With fewer vectors than k there are as many
centroids as vectors; without any there are no rows. Ties as above. Other
columns are ignored. Components are limited to +-2^62 and distances and their
sums to the largest long; the choice of clusters is exact at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm.text import stored

#: Vectors a task holds as 64-bit integers at once.
SLICE_ROWS = 8192
#: Relative slack of the two float bounds.
SLACK = 1e-6
#: Largest component for which squared distances of up to 64 components fit in 64 bits.
NARROW = 1 << 26
LIMB = 1 << 32
LARGEST = (1 << 63) - 1

ASSIGNED = "vec_id long, cluster int, distance long"
SUMS = "cluster int, component int, high long, low long"


def integer_rows(ids: pa.Array, vectors: pa.Array, dims: int, scale: float) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * x) of the vectors that count; 64-bit, or Python integers if some are wide."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    fit = np.zeros(len(vectors), dtype=bool)
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit[:] = sizes == dims
    vectors, ids = vectors.filter(pa.array(fit)), ids.filter(pa.array(fit))
    values = vectors.flatten()
    # A null component reads as NaN.
    values = values.to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * scale)
    finite = np.isfinite(values).all(axis=1)
    scaled, ids = np.clip(scaled[finite], -float(1 << 62), float(1 << 62)), ids.filter(pa.array(finite))
    return ids, scaled.astype(np.int64)


class Search:
    """Nearest centroids of many vectors at once."""

    def __init__(self, centroids: list[list[int]]):
        self.dims = len(centroids[0])
        sums = [sum(c) for c in centroids]
        order = sorted(range(len(centroids)), key=lambda k: (sums[k], k))
        self.number = np.array(order, dtype=np.int64)
        self.widest = max((abs(v) for c in centroids for v in c), default=0)
        self.rows = np.array([centroids[k] for k in order], dtype=np.int64)
        self.sums = self.rows.astype(np.float64).sum(axis=1)
        self.deviations = self._deviations(self.rows)
        self.exact = 0  # distances taken in full, for measurements

    def _deviations(self, rows: np.ndarray) -> np.ndarray:
        wide = rows.astype(np.float64)
        return np.sqrt(np.square(wide - wide.mean(axis=1, keepdims=True)).sum(axis=1))

    def _distances(self, rows: np.ndarray, places: np.ndarray, narrow: bool) -> np.ndarray:
        self.exact += len(rows)
        if narrow:
            apart = rows - self.rows[places]
            return np.einsum("ij,ij->i", apart, apart)
        apart = rows.astype(object) - self.rows[places].astype(object)
        return (apart * apart).sum(axis=1)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid."""
        n, k = len(rows), len(self.number)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Python integers where squares would not fit.
        bound = max(self.widest, int(np.abs(rows).max()))
        narrow = bound < NARROW and self.dims <= 64 or bound * bound * 4 * self.dims < LARGEST
        wide = rows.astype(np.float64)
        sums, deviations = wide.sum(axis=1), self._deviations(rows)
        # Rounding of sums and deviations grows with the size of the components.
        loose = 1e-9 * (1.0 + np.abs(wide).max(axis=1) + float(self.widest)) * self.dims
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        best = np.full(n, -1, dtype=np.int64 if narrow else object)
        best_float = np.full(n, np.inf)
        number = np.full(n, k, dtype=np.int64)
        active = np.arange(n)
        while len(active):
            lo, hi, s = left[active], right[active], sums[active]
            below = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, np.inf)
            go_left = below <= above
            gap = np.maximum(np.minimum(below, above) - loose[active], 0.0)
            average = gap * gap / self.dims
            # The nearer side's first term rules out everything that is left.
            going = np.isfinite(gap) & (average <= best_float[active] * (1 + SLACK))
            active, go_left, average = active[going], go_left[going], average[going]
            if not len(active):
                break
            place = np.where(go_left, left[active], right[active])
            left[active] -= go_left
            right[active] += ~go_left
            spread = np.maximum(np.abs(deviations[active] - self.deviations[place]) - loose[active], 0.0)
            near = average + spread * spread <= best_float[active] * (1 + SLACK)
            chosen, place = active[near], place[near]
            if not len(chosen):
                continue
            found = self._distances(rows[chosen], place, narrow)
            known = number[chosen] < k
            better = ~known | (found < best[chosen]) | ((found == best[chosen]) & (self.number[place] < number[chosen]))
            better = better.astype(bool)
            taken = chosen[better]
            best[taken], number[taken] = found[better], self.number[place[better]]
            best_float[taken] = found[better].astype(np.float64)
        return number, best


def _slices(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(first, SLICE_ROWS)
            ids, rows = integer_rows(part.column(0), part.column(1), dims, scale)
            if len(ids):
                yield ids, rows


def _columns(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))


def starting_centroids(vectors: DataFrame, k: int, dims: int, scale: float, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `seed:id`, as integers, in that order.

    Each task keeps k rows at most, and the driver takes the k first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, list[int]]] = []
        for ids, rows in _slices(batches, dims, scale):
            names = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist()]
            order = sorted(range(len(names)), key=names.__getitem__)
            # Rows of one id tie, so all rows up to the k-th name stay for the comparison.
            last = names[order[min(k, len(order)) - 1]]
            held = sorted(held + [(names[j], rows[j].tolist()) for j in order if names[j] <= last])[:k]
        yield pa.RecordBatch.from_pydict(
            {"name": [h for h, _ in held], "vector": [v for _, v in held]}, pa.schema([("name", pa.string()), ("vector", pa.list_(pa.int64()))]))

    firsts = vectors.mapInArrow(run, "name string, vector array<long>").orderBy("name", "vector").limit(k)
    return [list(r["vector"]) for r in firsts.collect()]


def _new_centroids(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: float) -> list[list[int]]:
    """One round: assign, then replace every non-empty centroid by the floor of its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, k = Search(centroids), len(centroids)
        counts, totals = np.zeros(k, np.int64), np.zeros((k, dims), dtype=object)
        for _, rows in _slices(batches, dims, scale):
            number, _ = search.nearest(rows)
            order = np.argsort(number, kind="stable")
            present, first = np.unique(number[order], return_index=True)
            # Split in limbs, each of which adds up in 64 bits over a slice.
            high, low = np.floor_divide(rows, LIMB)[order], np.mod(rows, LIMB)[order]
            totals[present] += np.add.reduceat(high, first).astype(object) * LIMB + np.add.reduceat(low, first).astype(object)
            counts += np.bincount(number, minlength=k)
        some = np.flatnonzero(counts)
        # A row for each component, and one for the number of vectors.
        values = [v for c in some.tolist() for v in (*totals[c], int(counts[c]))]
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(some, dims + 1), "component": np.tile(np.arange(dims + 1), len(some)),
            "high": [v // LIMB for v in values], "low": [v % LIMB for v in values],
        }, pa.schema([("cluster", pa.int32()), ("component", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]))

    sums = np.zeros((len(centroids), dims + 1), dtype=object)
    for row in vectors.mapInArrow(run, SUMS).groupBy("cluster", "component").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
        sums[row["cluster"], row["component"]] = row["high"] * LIMB + row["low"]
    out = list(centroids)
    for c in np.flatnonzero(sums[:, dims]).tolist():
        out[c] = [v // sums[c, dims] for v in sums[c, :dims]]
    return out


def fit_centroids(
    vectors: DataFrame, k: int, rounds: int, dims: int, scale: float = 256.0, seed: int = 0,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> list[list[int]]:
    """The centroids after `rounds` rounds; at most k rows of dims integers."""
    rows = _columns(vectors, id_column, vector_column)
    centroids = starting_centroids(rows, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        moved = _new_centroids(rows, centroids, dims, scale)
        if moved == centroids:  # a fixed point: further rounds would change nothing
            break
        centroids = moved
    return centroids


def assign(
    vectors: DataFrame, centroids: list[list[int]], scale: float = 256.0,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """vec_id, cluster and squared distance of every vector that counts."""
    rows = _columns(vectors, id_column, vector_column)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], ASSIGNED)
    dims = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for ids, few in _slices(batches, dims, scale):
            number, distance = search.nearest(few)
            if distance.dtype == object:
                distance = np.minimum(distance, LARGEST)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(number, pa.int32()), pa.array(distance.tolist(), pa.int64())], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, ASSIGNED)


def cluster_vectors(
    vectors: DataFrame, k: int, rounds: int, dims: int, scale: float = 256.0, seed: int = 0,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """Cluster all vectors; per vector its cluster, distance, inertias and its centroid's checksum.

    The assignment is stored once, added up to one row of each cluster, and
    those k rows come back as literals.
    """
    centroids = fit_centroids(vectors, k, rounds, dims, scale, seed, id_column, vector_column)
    rows = stored(assign(vectors, centroids, scale, id_column, vector_column), "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(total.alias("s")).collect()}
    spark, everything = vectors.sparkSession, min(sum(sums.values()), LARGEST)
    per = spark.createDataFrame(
        [(c, min(s, LARGEST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(sums.items())],
        "cluster int, cluster_inertia long, centroid_sha256 string")
    # At most k rows.
    return rows.join(F.broadcast(per), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(everything).cast("long").alias("inertia"), "centroid_sha256")
