"""MinHash near-dedup (operator 3): an LSH forest over distinct shingle sets.

Documents with equal sets are one class, so copies cost one row. Each class has
a MinHash signature, cut into the paths of several trees. A tree is the classes
in the order of their paths: one sort by ranges of (tree, path, class), which no
hot path can unbalance. In a sorted run the neighbours with the longest common
prefixes are the candidates; the depth adapts to the region, since in a crowded
one only the two nearest count, which share longer prefixes.

Candidates pass a size bound and a sketch bound (five standard deviations below
the wanted similarity), then full sets decide. First each class is compared
with one promising partner, which joins most of a family; then all candidates
between different components. Regions with more members than the neighbour
window are finished exactly: members outside a region's largest component are
queries against all its members, in pairs of blocks of bounded size. Sketches
leave the members with a close partner, whose full sets meet in one task.

Contract: one row per document row; null and empty texts have an empty set, are
linked with nothing and kept; a null id takes part in links and is never smallest
while the component has another; texts of any length are read whole; repeated
rows, and rows of one id with equal sets, share a component, those with
different texts are judged by their own; other columns are ignored. A pair
at the limit shares at least `depth` path values in one of the trees with a
probability of 1 - (1 - s^depth)^trees; with more documents, raise both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm.text import BYTE_VALUES, LOWER, SPACED, binary_column, id_and_text, mix, partitions_for, ragged, slices, span_hashes, stored, word_spans
from gradeframe.operators.joins import lookup_join

VALUES = BYTE_VALUES[LOWER]
TREES, PATH = 16, 8
#: Neighbours on either side in a tree, and path values that a candidate must share.
REACH, DEPTH = 8, 3
#: Members of a region that meet in one task, by rows and by bytes of their sets.
BLOCK_ROWS, BLOCK_BYTES = 2048, 4 << 20

_FACTORS = mix(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(5001, 6025, dtype=np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their n+1 offsets."""
    starts, ends, first = word_spans(data, offsets, SPACED)
    hashes = span_hashes(data, starts, ends, VALUES)
    counts = np.diff(first)
    number = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), number)
    at = np.repeat(first[:-1], number) + ragged(number)
    size = np.minimum(counts, words)[owner]
    value = size.astype(np.uint64)
    for k in range(words):
        here = size > k
        value[here] = mix(value[here] * _STEP + hashes[at[here] + k])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1))


def _reduced(op, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return op.reduceat(values, offsets[:-1])


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit name of each nonempty set."""
    parts = np.stack([_reduced(np.add, mix(sets ^ salt), offsets) for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDE))], axis=1)
    raw = parts.astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def signatures(sets: np.ndarray, offsets: np.ndarray, number: int) -> np.ndarray:
    """MinHash values (32 bits, big-endian) of each nonempty set."""
    out = np.empty((len(offsets) - 1, number), dtype=">u4")
    for k in range(number):
        out[:, k] = _reduced(np.minimum, (sets ^ _SHIFTS[k]) * _FACTORS[k], offsets) >> np.uint64(32)
    return out


def _sketches(docs: DataFrame, words: int, number: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            sets, bounds = shingle_sets(data, offsets, words)
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            keys: list[bytes | None] = [None] * len(n)
            marks: list[bytes | None] = [None] * len(n)
            if len(full):
                own = np.append(bounds[full], bounds[-1])
                table = signatures(sets, own, number)
                for i, key, row in zip(full.tolist(), set_keys(sets, own), table):
                    keys[i], marks[i] = key, row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_name"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(marks, pa.binary())],
                names=["doc_id", "text_name", "n_shingles", "key", "sig"])

    return docs.withColumn("text_name", _text_name("text")).mapInArrow(run, "doc_id long, text_name binary, n_shingles long, key binary, sig binary")


def _text_name(column: str) -> "F.Column":
    """A 128-bit name of a text; null has its own."""
    return F.coalesce(F.unhex(F.md5(F.col(column).cast("string").cast("binary"))), F.lit(b""))


def _node(rep) -> "F.Column":
    """Names of classes that sort by their smallest document: 8 bytes of it, then the set's name."""
    return F.concat(F.unhex(F.lpad(F.hex(F.coalesce(rep, F.lit((1 << 63) - 1)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.col("key"))


def _doc_of(node: str) -> "F.Column":
    """The document in a class's name."""
    number = F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(number < F.lit("9223372036854775807").cast("decimal(20,0)"), number.cast("long"))


def _sigs(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=">u4").reshape(len(raw), -1)


def _common(paths: np.ndarray) -> np.ndarray:
    """Path values that each row shares with the row before it."""
    same = paths[1:] == paths[:-1]
    return np.where(same.all(axis=1), paths.shape[1], np.argmin(same, axis=1))


def _near(trees: np.ndarray, paths: np.ndarray, reach: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (before, after) within `reach` in a sorted run that share at least `depth` values."""
    if len(trees) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = np.where(trees[1:] == trees[:-1], _common(paths), 0)
    before, after = [], []
    least = shared
    # In a region with more members than `reach`, which is finished exactly later, the two nearest will do.
    region = np.concatenate(([0], np.cumsum(shared < depth)))
    crowded = (np.bincount(region) > reach)[region]
    for step in range(1, min(reach, len(trees) - 1) + 1):
        if step > 1:
            least = np.minimum(least[:-1], shared[step - 1 :])
        at = np.flatnonzero((least >= depth) & ((step <= 2) | ~crowded[step:]))
        before.append(at)
        after.append(at + step)
    return np.concatenate(before), np.concatenate(after)


_PAIRS = "a binary, b binary"


def _pair_rows(nodes: list[bytes], before: np.ndarray, after: np.ndarray) -> list[tuple[bytes, bytes]]:
    return list({(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in zip(before.tolist(), after.tolist())})


def forest_candidates(classes: DataFrame, number: int, reach: int, depth: int) -> DataFrame:
    """Pairs of classes that are near neighbours in some tree."""
    spark = classes.sparkSession
    paths = F.array(*[F.substring("sig", 1 + 4 * PATH * t, 4 * PATH) for t in range(number // PATH)])
    trees = classes.select("node", F.posexplode(paths).alias("tree", "path"))
    order = ["tree", "path", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[int, bytes, bytes]] = []
        heads: list[tuple[int, bytes, bytes]] = []
        for batch in batches:
            rows = list(zip(batch.column("tree").to_pylist(), batch.column("path").to_pylist(), batch.column("node").to_pylist()))
            heads += rows[: max(0, reach - len(heads))]
            every = held + rows
            before, after = _near(np.array([r[0] for r in every]), np.frombuffer(b"".join(r[1] for r in every), ">u4").reshape(len(every), -1), reach, depth)
            new = after >= len(held)
            found = _pair_rows([r[2] for r in every], before[new], after[new])
            held = every[-reach:]
            yield _edge_batch(found, [], 0)
        yield _edge_batch([], heads, part)
        yield _edge_batch([], held, part + 1)

    edge = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("seam", pa.int32()), ("tree", pa.int32()), ("path", pa.binary()), ("node", pa.binary())])

    def _edge_batch(pairs, rows, seam) -> pa.RecordBatch:
        none, n = [None] * len(pairs), len(rows)
        return pa.RecordBatch.from_pydict({
            "a": [p[0] for p in pairs] + [None] * n, "b": [p[1] for p in pairs] + [None] * n, "seam": none + [seam] * n,
            "tree": none + [r[0] for r in rows], "path": none + [r[1] for r in rows], "node": none + [r[2] for r in rows],
        }, edge)

    def seam(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["tree"].to_pylist(), table["path"].to_pylist(), table["node"].to_pylist()))
        before, after = _near(np.array([r[0] for r in rows]), np.frombuffer(b"".join(r[1] for r in rows), ">u4").reshape(len(rows), -1), reach, depth)
        found = _pair_rows([r[2] for r in rows], before, after)
        return pa.table({"a": pa.array([p[0] for p in found], pa.binary()), "b": pa.array([p[1] for p in found], pa.binary())})

    rows = classes.count() * number // PATH
    # A seam compares the ends of two tasks, so each task must hold many more rows than `reach`.
    parts = max(1, min(partitions_for(spark, rows * (4 * PATH + 32), 8 << 20), rows // (8 * reach)))
    ranged = trees.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = stored(ranged.mapInArrow(run, "a binary, b binary, seam int, tree int, path binary, node binary"), "forest")
    # Neighbours on both sides of a cut between two tasks.
    seams = made.filter("seam IS NOT NULL").groupBy("seam").applyInArrow(seam, _PAIRS)
    return made.filter("seam IS NULL").select("a", "b").union(seams).distinct()


def crowded_groups(classes: DataFrame, labels: DataFrame, number: int, reach: int, depth: int) -> DataFrame | None:
    """Regions that the neighbour window can't cover and that more than one component shares, or None.

    Rows are (name, node, root, main) for each member; those whose root is not
    main, the largest component, are to be compared with all. Regions of one
    main component, which in a family of near copies are much the same in all
    trees, become one group if that takes at most twice the comparisons.
    """
    paths = F.array(*[F.substring("sig", 1 + 4 * PATH * t, 4 * depth) for t in range(number // PATH)])
    member = classes.select("node", F.posexplode(paths).alias("tree", "path"))
    crowded = member.groupBy("tree", "path").count().filter(F.col("count") > reach)
    member = member.join(crowded, ["tree", "path"]).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    shares = member.groupBy("tree", "path", "count", "root").agg(F.count(F.lit(1)).alias("n"))
    open_regions = stored(shares.groupBy("tree", "path", "count").agg(F.max(F.struct("n", "root")).alias("most")).filter(F.col("most.n") < F.col("count")).select("tree", "path", "count", F.col("most.root").alias("main"), (F.col("count") - F.col("most.n")).alias("others")), "regions")
    if open_regions.isEmpty():
        return None
    rows = stored(member.select("tree", "path", "node", "root").join(open_regions.select("tree", "path", "main"), ["tree", "path"]), "members")
    product = lambda x, y: x.cast("double") * y
    apart = open_regions.groupBy("main").agg(F.sum(product(F.col("count"), F.col("others"))).alias("apart"))
    whole = rows.select("main", "node", "root").distinct().groupBy("main").agg(product(F.count(F.lit(1)), F.count_if(F.col("root") != F.col("main"))).alias("whole"))
    wide = stored(apart.join(whole, "main").filter("whole <= 2 * apart").select("main", F.lit(True).alias("wide")), "wide")
    own = F.concat(F.lit(b"r"), F.unhex(F.lpad(F.hex("tree"), 8, "0")), F.col("path"))
    named = lookup_join(rows, wide, ["main"], "left").withColumn("name", F.when(F.col("wide"), F.concat(F.lit(b"m"), F.col("main"))).otherwise(own))
    return stored(named.select("name", "node", "root", "main").distinct(), "groups")


def near_members(classes: DataFrame, groups: DataFrame, lowest: float, bound: float) -> DataFrame:
    """Members of groups whose sketch is close to one of another component, in pairs of blocks of bounded size.

    Rows are (name, mine, theirs, node, root, asked): in the pair of blocks
    (mine, theirs) of a group a row that is asked is to meet those that are not.
    As only members go on, not their pairs, no more rows come out than go in.
    """
    rows = groups.join(classes.select("node", "n", "sig"), "node")
    outside = F.col("root") != F.col("main")
    blocks = lambda count, items: F.ceil(F.greatest(count / BLOCK_ROWS, items * 8 / BLOCK_BYTES)).cast("int")
    every, others = blocks(F.count(F.lit(1)), F.sum("n")), blocks(F.count_if(outside), F.sum(F.when(outside, F.col("n"))))
    sizes = stored(rows.groupBy("name").agg(every.alias("all_blocks"), others.alias("asked_blocks")), "blocks")
    rows = lookup_join(rows, sizes, ["name"], "inner")
    # Both sides' block numbers are of one type: keys of different types would be dealt to different tasks and never meet.
    block = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["name", "mine", "theirs", "node", "root", "n", "sig"]
    members = rows.withColumn("mine", block("all_blocks")).withColumn("theirs", each("asked_blocks")).select(*columns)
    asked = rows.filter(outside).withColumn("theirs", block("asked_blocks")).withColumn("mine", each("all_blocks")).select(*columns)
    # Names of its own, as both sides come from one table.
    asked = asked.toDF(*[f"asked_{c}" for c in columns])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        near, found = np.zeros(left.num_rows, dtype=bool), np.zeros(right.num_rows, dtype=bool)
        if left.num_rows and right.num_rows:
            (mine, sizes), theirs = [(_sigs(t[s]).view("u4"), t[n].to_numpy()) for t, s, n in ((left, "sig", "n"), (right, "asked_sig", "asked_n"))]
            root, asked_root = _codes(left["root"], right["asked_root"])
            for k, (sig, n) in enumerate(zip(*theirs)):
                at = np.flatnonzero((np.minimum(sizes, n) >= bound * np.maximum(sizes, n)) & (root != asked_root[k]))
                at = at[np.count_nonzero(mine[at] == sig, axis=1) >= lowest * len(sig)]
                near[at] = True
                found[k] = len(at) > 0
        out = {}
        for c, kind in near_columns.items():
            values = [x for t, name, flags in ((left, c, near), (right, f"asked_{c}", found)) if flags.any() for x in t[name].filter(pa.array(flags)).chunks]
            out[c] = pa.chunked_array(values, kind)
        return pa.table({**out, "asked": pa.array(np.repeat([False, True], [near.sum(), found.sum()]))})

    near_columns = {"name": pa.binary(), "mine": pa.int32(), "theirs": pa.int32(), "node": pa.binary(), "root": pa.binary()}
    key = ["name", "mine", "theirs"]
    return members.groupBy(*key).cogroup(asked.groupBy(*[f"asked_{c}" for c in key])).applyInArrow(meet, "name binary, mine int, theirs int, node binary, root binary, asked boolean")


def _codes(*columns) -> list[np.ndarray]:
    """Numbers of the values of some columns, the same for equal values."""
    known: dict[bytes, int] = {}
    return [np.array([known.setdefault(x, len(known)) for x in c.to_pylist()], dtype=np.int64) for c in columns]


def crowded_links(near: DataFrame, sets: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Links (a, b) of components' roots by full sets, for what `near_members` found.

    A pair of blocks gives fewer links than it has components, as what it has
    linked counts as one.
    """

    def verify(table: pa.Table) -> pa.Table:
        asked, (label,), names = table["asked"].to_numpy(), _codes(table["root"]), table["root"].to_pylist()
        items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["items"]]
        sizes = np.array([len(x) for x in items])
        members = np.flatnonzero(~asked)
        members = members[np.argsort(sizes[members], kind="stable")]
        a, b = [], []
        if len(members) and asked.any():
            values, held = np.unique(np.concatenate([items[i] for i in members]), return_inverse=True)
            n = sizes[members]
            first = np.concatenate(([0], np.cumsum(n)))
            inside = np.zeros(len(values), dtype=np.int32)
            for k in np.flatnonzero(asked).tolist():
                # Only members of a size that can be similar enough, which lie side by side.
                low, high = np.searchsorted(n, -(-limit[0] * sizes[k] // limit[1])), np.searchsorted(n, limit[1] * sizes[k] // limit[0], side="right")
                if low == high or (label[members[low:high]] == label[k]).all():
                    continue
                at = np.minimum(np.searchsorted(values, items[k]), len(values) - 1)
                at = at[values[at] == items[k]]
                inside[at] = 1
                both = np.add.reduceat(inside[held[first[low] : first[high]]], first[low:high] - first[low])
                inside[at] = 0
                good = members[low:high][limit[1] * both >= limit[0] * (sizes[k] + n[low:high] - both)]
                linked, one = np.unique(label[good], return_index=True)
                for other, i in zip(linked.tolist(), good[one].tolist()):
                    if other != label[k]:
                        a.append(min(names[k], names[i]))
                        b.append(max(names[k], names[i]))
                        label[label == other] = label[k]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return near.join(sets, "node").groupBy("name", "mine", "theirs").applyInArrow(verify, _PAIRS).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components: node and root (the smallest node), for all nodes with an edge.

    Alternates two steps until nothing changes: link a node's larger neighbours
    to its smallest one, then its smaller ones and itself. Rounds grow with the
    logarithm of the longest path.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(lower.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after their components' roots were joined by further links; `more` labels the roots."""
    onto = more.select(F.col("node").alias("root"), F.col("root").alias("onto"))
    moved = lookup_join(labels, onto, ["root"], "left").select("node", F.coalesce("onto", "root").alias("root"))
    # Roots without an earlier link stood for themselves.
    return stored(moved.union(more.join(labels.select("node"), "node", "left_anti").select("node", "root")), "labels")


def _grouped(docs: DataFrame, words: int, limit: tuple[int, int], trees: int, reach: int, depth: int) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, the text's and the set's names, the component, and the name of its smallest class."""
    number = trees * PATH
    bound = limit[0] / limit[1]
    lowest = bound - 5 * np.sqrt(bound * (1 - bound) / number)
    marked = stored(_sketches(docs, words, number), "sketches")
    classes = stored(marked.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).select(_node(F.col("rep")).alias("node"), "rep", "key", "n", "sig"), "classes")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                likeness = (_sigs(batch.column("sig_a")) == _sigs(batch.column("sig_b"))).mean(axis=1)
                sizes = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                good = pa.array((likeness >= lowest) & (np.minimum(*sizes) >= bound * np.maximum(*sizes)))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(likeness)], names=["a", "b", "likeness"]).filter(good)

    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    pairs = forest_candidates(classes, number, reach, depth).join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(close, "a binary, b binary, likeness double")
    pairs = stored(pairs, "pairs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The full sets of some classes, from the text of their smallest document."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in slices(batches):
                sets, bounds = shingle_sets(data, offsets, words)
                full = np.flatnonzero(np.diff(bounds) > 0)
                if len(full):
                    own = np.append(bounds[full], bounds[-1])
                    yield pa.RecordBatch.from_arrays([pa.array(set_keys(sets, own), pa.binary()), binary_column(sets, own)], names=["key", "items"])

        wanted = nodes.join(classes.select("node", "rep", "key"), "node")
        texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        if nameless:  # a null id names no document, so all of them are looked through
            texts = texts.union(docs.filter("doc_id IS NULL"))
        found = texts.mapInArrow(run, "key binary, items binary")
        return stored(found.join(wanted.select("key", "node"), "key").groupBy("node").agg(F.first("items").alias("items")), "sets")

    def confirmed(asked: DataFrame, sets: DataFrame) -> DataFrame:
        names = asked.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(limit[1] * both >= limit[0] * (len(x) + len(y) - both))
                yield batch.select(names).filter(pa.array(good, pa.bool_()))

        sided = asked.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        return sided.select(*names, "x", "y").mapInArrow(run, asked.schema)

    def across(asked: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different components, with the components' roots."""
        for x in ("a", "b"):
            asked = asked.join(labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
        asked = asked.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
        return asked.filter("root_a != root_b")

    def joined(labels: DataFrame, asked: DataFrame, sets: DataFrame) -> DataFrame:
        """Labels after further pairs: only roots are nodes of this run, and a link of two components counts once."""
        links = stored(confirmed(across(asked, labels), sets).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "links")
        return labels if links.isEmpty() else _merged(labels, components(links))

    nameless = not classes.filter("rep IS NULL").isEmpty()
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # Of each class's candidates the smallest of those that look alike for certain, else the likeliest.
    one = pairs.groupBy("b").agg(F.min(F.when(F.col("likeness") > (1 + bound) / 2, F.col("a"))).alias("sure"), F.max_by("a", "likeness").alias("best")).select(F.coalesce("sure", "best").alias("a"), "b")
    labels = joined(components(stored(confirmed(one, sets), "links")), pairs.select("a", "b"), sets)
    groups = crowded_groups(classes, labels, number, reach, depth)
    if groups is not None:
        near = stored(near_members(classes, groups, lowest, bound), "near")
        if not near.isEmpty():
            links = stored(crowded_links(near, sets_of(near.select("node").distinct()), limit), "links")
            labels = labels if links.isEmpty() else _merged(labels, components(links))
    roots = classes.join(labels, "node", "left").select("key", F.coalesce(_doc_of("root"), F.col("rep")).alias("component"), F.coalesce("root", "node").alias("root"))
    return marked.select("doc_id", "text_name", "n_shingles", "key").join(roots, "key", "left")


def near_duplicates(docs: DataFrame, words: int = 5, limit: tuple[int, int] = (4, 5), trees: int = TREES, reach: int = REACH, depth: int = DEPTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    Two sets are linked if limit[1] * intersection >= limit[0] * union.
    """
    out = _grouped(id_and_text(docs, id_column, text_column), words, limit, trees, reach, depth)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, limit: tuple[int, int] = (4, 5), trees: int = TREES, reach: int = REACH, depth: int = DEPTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    It is a row of the group's smallest document and smallest class; of several
    such texts the one with the smallest name stays, of several rows of that
    text the one with the smallest hash over all columns. Texts without words
    stay, each (id, text) once.
    """
    found = _grouped(id_and_text(docs, id_column, text_column), words, limit, trees, reach, depth)
    main = found.filter(F.col("doc_id").eqNullSafe(F.col("component")) & (F.col("key") == F.substring("root", 9, 16)))
    chosen = main.groupBy("root").agg(F.min(F.struct("text_name", "doc_id")).alias("m")).select("m.doc_id", "m.text_name")
    kept = chosen.union(found.filter("key IS NULL").select("doc_id", "text_name").distinct())
    known, number = F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("long"))
    kept = kept.select(known.alias("_known"), number.alias("_id"), F.col("text_name").alias("_name"))
    # Repeated rows become one before the join, so no row of it meets many.
    own = F.col(id_column).cast("long")
    named = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), own.isNotNull().alias("_known"), F.coalesce(own, F.lit(0).cast("long")).alias("_id"),
        _text_name(text_column).alias("_name"), F.xxhash64(*docs.columns).alias("_hash"))
    single = named.groupBy("_known", "_id", "_name").agg(F.min_by("_row", "_hash").alias("_row"))
    return single.join(kept, ["_known", "_id", "_name"], "left_semi").select("_row.*")
