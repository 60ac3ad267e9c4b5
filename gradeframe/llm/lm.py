"""LM scoring (operator 1): a weighted backoff automaton over word n-grams.

The model is an n-gram language model with Dirichlet-smoothed back-off: an arc
of context h on word w has probability (c(hw) + m p(w | h')) / (c(h) + m), the
failure arc from h to its suffix h' costs log10(m / (c(h) + m)), and the root is
the add-one unigram model. So every seen n-gram is an arc, an unseen one falls
along failure arcs with just the weight left for it, and probabilities of all
words in any context sum to one.

The automaton of a whole corpus fits nowhere, but a block of documents only
needs the arcs that its own n-grams can take. So documents are dealt into
blocks; a block sends its distinct n-gram keys with its own training counts to
hash buckets; a bucket adds up what all blocks sent and returns the totals in
the order of the request. Words and word pairs are asked for first, and the
answer tells which of them no other block holds. Longer n-grams with such a pair
in them lie in this block only, so their own counts are the totals; the block
asks for the others. Then it builds its part of the automaton, states,
arcs and failure arcs, and scores its documents in one left-to-right traversal
that carries the state and adds up log-probabilities. Everything that moves is
pre-aggregated to distinct n-grams of a block, so frequent words are no hot
keys, and all counts grow with the corpus.

Contract: one row per document row; null and empty texts consist of the end
token; texts of any length are read whole, in strides that advance together; an empty table gives no rows; repeated rows each give a row; other
columns are ignored. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm.text import BYTE_VALUES, LOWER, SLICE_BYTES, SPACED, flat_bytes, mix, run_sums, slices, span_hashes, text_bytes, word_spans

VALUES = BYTE_VALUES[LOWER]
BEGIN, END = np.uint64(0x5BD1E995_00000100), np.uint64(0x5BD1E995_00000200)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: The lowest bits of a key tell the length of its n-gram.
_LEVEL = np.uint64(7)

#: Bytes of text in a block of documents; there are as many buckets as blocks.
BLOCK_BYTES = 6 << 20

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out_rows(id_column: str = "doc_id") -> Column:
    """Rows that the model does not learn from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 7 == 2, F.lit(False))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of all words, taken from bounded stretches of the block, so that tables of powers stay small."""
    out, first = np.empty(len(starts), dtype=np.uint64), 0
    while first < len(starts):
        begin = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + SLICE_BYTES, side="right")))
        out[first:last] = span_hashes(data[begin : ends[last - 1]], starts[first:last] - begin, ends[first:last] - begin, VALUES)
        first = last
    return out


class Block:
    """Tokens of some documents, each with its begin and end, and their n-gram keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        starts, ends, first = word_spans(data, offsets, SPACED)
        words = word_hashes(data, starts, ends)
        docs = len(offsets) - 1
        self.offsets = first + 2 * np.arange(docs + 1)
        tokens = np.empty(len(words) + 2 * docs, dtype=np.uint64)
        tokens[self.offsets[:-1]] = BEGIN
        tokens[self.offsets[1:] - 1] = END
        inner = np.ones(len(tokens), dtype=bool)
        inner[self.offsets[:-1]] = inner[self.offsets[1:] - 1] = False
        tokens[inner] = words
        self.begins = np.zeros(len(tokens), dtype=bool)
        self.begins[self.offsets[:-1]] = True
        #: Words since the document's begin, which is 0: an n-gram of more than that crosses it.
        self.depth = np.arange(len(tokens)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        level, self.keys = tokens, []
        for n in range(1, order + 1):
            if n > 1:
                level = mix(np.concatenate((np.zeros(1, np.uint64), level[:-1])) * _STEP + tokens)
            self.keys.append(level & ~_LEVEL | np.uint64(n))

    def whole(self, n: int) -> np.ndarray:
        """Places where an n-gram within the document ends."""
        return self.depth >= n - 1

    def distinct(self, least: int = 1, most: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct keys of some lengths (all) in order, and for each length the places of its n-grams among them."""
        valid = [self.keys[n - 1][self.whole(n)] for n in range(least, (most or len(self.keys)) + 1)]
        keys, inverse = np.unique(np.concatenate(valid), return_inverse=True)
        return keys, np.split(inverse, np.cumsum([len(v) for v in valid])[:-1])


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal ranges of the key space begins in sorted keys."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def packed_keys(keys: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Runs of sorted distinct keys: the first in full, then differences in as few bytes as the largest takes."""
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        steps = np.diff(keys[a:b])
        width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 1
        low = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        out.append(keys[a : a + 1].astype("<u8").tobytes() + bytes([width]) + low.tobytes())
    return pa.array(out, pa.binary())


def unpacked_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    runs = []
    for raw in column.to_pylist():
        width = raw[8]
        low = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
        steps = np.zeros((len(low) + 1, 8), dtype=np.uint8)
        steps[0] = np.frombuffer(raw, np.uint8, 8)
        steps[1:, :width] = low
        runs.append(np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64))
    return runs


def own_counts(block: Block, held_out: np.ndarray, size: int, places: list[np.ndarray], least: int = 1) -> np.ndarray:
    """How often each key occurs in the block's training documents."""
    train = np.repeat(~held_out, np.diff(block.offsets))
    counts = np.zeros(size, dtype=np.int64)
    for n, at in enumerate(places, least):
        counts += np.bincount(at[train[block.whole(n)]], minlength=size)
    return counts


def settled_longer(block: Block, alone: np.ndarray, pairs: np.ndarray, size: int, places: list[np.ndarray]) -> np.ndarray:
    """Which keys of n-grams from 3 words on have a word pair in them that no other block holds; `pairs` are the places of all pairs."""
    lone = np.zeros(len(block.depth), dtype=bool)
    lone[block.whole(2)] = alone[pairs]
    settled = np.zeros(size, dtype=bool)
    inside = lone
    for n, at in enumerate(places, 3):
        inside = inside.copy()
        inside[n - 2 :] |= lone[: len(lone) - n + 2]
        settled[at] = inside[block.whole(n)]
    return settled


def dealt_texts(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt into blocks by their hash, those of a batch and block as one compressed table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            block = batch.column("block").to_numpy()
            order = np.argsort(block, kind="stable")
            told, first = np.unique(block[order], return_index=True)
            packs, texts = [], batch.select(["doc_id", "text", "held_out"])
            for own in np.split(order, first[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, texts.schema) as out:
                    out.write_batch(texts.take(pa.array(own)))
                packs.append(press.compress(sink.getvalue()))
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array(told, pa.int32()), pa.array(packs, pa.binary())], names=["block", "pack"])

    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(pack, "block int, pack binary")


def unpacked_texts(column: pa.ChunkedArray) -> pa.Table:
    press = zstandard.ZstdDecompressor()
    return pa.concat_tables([pa.ipc.open_stream(press.decompress(raw)).read_all() for raw in column.to_pylist()])


def corpus_totals(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """Tokens of the training documents, and how many distinct ones there are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, size=4 << 20):
            block = Block(data, offsets, 1)
            keys, counts = np.unique(block.keys[0][~block.begins], return_counts=True)
            bounds = bucket_bounds(keys, buckets)
            some = np.flatnonzero(np.diff(bounds))
            cut = np.append(bounds[some], len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), packed_keys(keys, cut), pa.array(np.add.reduceat(counts, bounds[some]) if len(some) else [], pa.int64())], names=["bucket", "keys", "n"])

    def count(table: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([len(np.unique(np.concatenate(unpacked_keys(table["keys"]))))], pa.int64()), "n": pa.array([sum(table["n"].to_pylist())], pa.int64())})

    packed = docs.filter(~F.col("held_out")).select("text").mapInArrow(words, "bucket int, keys binary, n long")
    row = packed.groupBy("bucket").applyInArrow(count, "v long, n long").agg(F.sum("n"), F.sum("v")).first()
    return row[0] or 0, row[1] or 0


def packed_counts(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Counts of each run, one byte each; those of 255 and more stand in full before them."""
    small = np.minimum(values, 255).astype(np.uint8)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        large = values[a:b][small[a:b] == 255].astype("<u8")
        out.append(len(large).to_bytes(4, "little") + large.tobytes() + small[a:b].tobytes())
    return pa.array(out, pa.binary())


def unpacked_counts(column: pa.ChunkedArray) -> np.ndarray:
    parts = []
    for raw in column.to_pylist():
        large = int.from_bytes(raw[:4], "little")
        counts = np.frombuffer(raw, np.uint8, offset=4 + 8 * large).astype(np.int64)
        counts[counts == 255] = np.frombuffer(raw, "<u8", large, 4).astype(np.int64)
        parts.append(counts)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Automaton:
    """The part of the weighted backoff automaton that a block's own n-grams can reach.

    State 0 is the root; each seen n-gram shorter than the order is a state, the
    context it stands for. Arcs are sorted by (state, word) and carry a weight
    and the state they lead to: the longest suffix of context and word that is a
    state. A failure arc leads from a context to its longest proper suffix and
    costs the share left for words unseen there. At the root every word goes on,
    unknown ones with the add-one share. Seen n-grams are closed under prefixes
    and suffixes, so that both ends of every arc are states.
    """

    def __init__(self, block: Block, places: list[np.ndarray], totals: np.ndarray, n_train: int, vocabulary: int, pseudo: list[float]):
        order, tokens = len(places), len(block.depth)
        ends = [np.flatnonzero(block.whole(n)) for n in range(1, order + 1)]
        gram = np.full((order, tokens), -1, dtype=np.int64)
        for n, at in enumerate(places):
            gram[n, ends[n]] = at
        told = np.zeros(len(totals), dtype=bool)
        told[places[0]] = True
        words = np.flatnonzero(told)
        self.words = (np.cumsum(told) - 1)[gram[0]]
        self.width = max(1, len(words))
        weight, state = np.zeros(len(totals)), np.zeros(len(totals), dtype=np.int64)
        size = n_train + vocabulary + 1
        self.unknown = -np.log10(size)
        weight[words] = np.log10((totals[words] + 1) / size)
        self.root_weight = weight[words]
        failure, fall, arcs, states = [np.zeros(1, np.int64)], [np.zeros(1)], [], 1
        for n in range(1, order + 1):
            # Each seen n-gram once, and a place where it ends: its prefix and suffix end before it and there.
            place = np.full(len(totals), -1, dtype=np.int64)
            place[places[n - 1]] = ends[n - 1]
            grams = np.flatnonzero((place >= 0) & (totals > 0))
            last = place[grams]
            suffix = gram[n - 2, last] if n > 1 else None
            if n > 1:
                m, prefix = pseudo[n - 2], gram[n - 2, last - 1]
                weight[grams] = np.log10((totals[grams] + m * 10.0 ** weight[suffix]) / (totals[prefix] + m))
            if n < order:
                state[grams] = states + np.arange(len(grams))
                states += len(grams)
                m = pseudo[n - 1]
                failure.append(np.zeros(len(grams), np.int64) if n == 1 else state[suffix])
                fall.append(np.log10(m / (totals[grams] + m)))
            if n > 1:
                arcs.append((state[prefix] * self.width + self.words[last], weight[grams], state[grams if n < order else suffix]))
        self.failure, self.fall = np.concatenate(failure), np.concatenate(fall)
        self.root_target = state[words]
        self.root_known = totals[words] > 0
        codes = np.concatenate([a[0] for a in arcs])
        by = np.argsort(codes)
        # A last code that no lookup has, so that a search never leaves the table.
        self.codes = np.append(codes[by], np.iinfo(np.int64).max)
        self.weight = np.concatenate([a[1] for a in arcs])[by]
        self.target = np.concatenate([a[2] for a in arcs])[by]
        self.falls = 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word in each state: what it costs, and the states it leads to."""
        cost, state = np.zeros(len(state)), state.copy()
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == 0
            root, left = left[at_root], left[~at_root]
            cost[root] += np.where(self.root_known[word[root]], self.root_weight[word[root]], self.unknown)
            state[root] = self.root_target[word[root]]
            code = state[left] * self.width + word[left]
            arc = np.searchsorted(self.codes, code)
            taken = self.codes[arc] == code
            cost[left[taken]] += self.weight[arc[taken]]
            state[left[taken]] = self.target[arc[taken]]
            left = left[~taken]
            cost[left] += self.fall[state[left]]
            state[left] = self.failure[state[left]]
            self.falls += len(left)
        return cost, state


def automaton_scores(block: Block, automaton: Automaton, order: int, stride: int = 64) -> np.ndarray:
    """Log10 probability of each document: one traversal from left to right with a carried state.

    Documents are cut into strides that advance together, each by a word a step,
    so a very long document takes no more steps than a short one. A state
    depends on the last order - 1 words only: a stride inside a document first
    reads those from the root, at no cost, and so begins in the state that the
    document's own traversal has there.
    """
    docs = len(block.offsets) - 1
    length = np.diff(block.offsets) - 1
    stride = max(stride, order)
    pieces = -(-length // stride)
    doc = np.repeat(np.arange(docs), pieces)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = block.offsets[doc] + 1 + begin * stride
    size = np.minimum(stride, length[doc] - begin * stride)
    state = np.zeros(len(doc), dtype=np.int64)
    head = begin == 0
    state[head] = automaton.root_target[automaton.words[start[head] - 1]]
    inner = np.flatnonzero(~head)
    for back in range(order - 1, 0, -1):
        _, state[inner] = automaton.step(state[inner], automaton.words[start[inner] - back])
    automaton.falls = 0
    total = np.zeros(len(doc))
    by = np.argsort(-size, kind="stable")
    for k in range(stride):
        alive = by[: np.searchsorted(-size[by], -k, side="left")]
        cost, state[alive] = automaton.step(state[alive], automaton.words[start[alive] + k])
        total[alive] += cost
    return np.bincount(doc, weights=total, minlength=docs)


def unigram_scores(block: Block, places: list[np.ndarray], totals: np.ndarray, n_train: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: known tokens, and the score of the root's own model."""
    seen, told = totals[places[0]], ~block.begins
    base = np.where(told, np.log10((seen + 1) / (n_train + vocabulary + 1)), 0.0)
    return run_sums((seen > 0) & told, block.offsets), run_sums(base, block.offsets)


def score_documents(docs: DataFrame, held_out: Column | None = None, order: int = 2, pseudo: tuple[float, ...] = (500.0, 50.0, 10.0, 10.0), block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score every document under the model that the rows not held out train.

    `order` is the longest n-gram's length (2 to 5), `pseudo` the number m of
    pseudo-counts of each length from 2 on. Per document: held_out, n_tokens
    (words and end), n_known (seen in training), train_tokens, base_score (the
    unigram model) and score, both log10.
    """
    if not 2 <= order <= min(7, len(pseudo) + 1):
        raise ValueError("order must be at least 2, with pseudo-counts for each length")
    held_out = held_out_rows(id_column) if held_out is None else held_out
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), held_out.alias("held_out"))
    size = text_bytes(rows)
    blocks = max(1, -(-size // block_bytes))
    n_train, vocabulary = corpus_totals(rows, blocks)
    dealt = dealt_texts(rows, blocks)
    short = min(2, order)
    empty = pa.table({"bucket": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "counts": pa.array([], pa.binary())})

    def read(table: pa.Table) -> tuple[pa.Table, Block, np.ndarray]:
        mine = unpacked_texts(table["pack"])
        return mine, Block(*flat_bytes(mine["text"]), order), mine["held_out"].to_numpy()

    def request(table: pa.Table, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        bounds = bucket_bounds(keys, blocks)
        some = np.flatnonzero(np.diff(bounds))
        cut = np.append(bounds[some], len(keys))
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "block": pa.array(np.full(len(some), table["block"][0].as_py()), pa.int32()),
            "keys": packed_keys(keys, cut), "counts": packed_counts(counts, cut),
        })

    def ask_short(table: pa.Table) -> pa.Table:
        _, block, held = read(table)
        keys, places = block.distinct(1, short)
        return request(table, keys, own_counts(block, held, len(keys), places))

    def flags(got: pa.Table, size: int) -> np.ndarray:
        """Of each short key, whether no other block holds it."""
        runs = zip(got["alone"].to_pylist(), got["n"].to_pylist())
        return np.concatenate([np.unpackbits(np.frombuffer(raw, np.uint8), count=n) for raw, n in runs]).astype(bool) if size else np.zeros(0, bool)

    def ask_long(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        _, block, held = read(table)
        keys, places = block.distinct(1, short)
        alone, pairs = flags(got.sort_by("bucket"), len(keys)), places[1]
        keys, places = block.distinct(3)
        asked = ~settled_longer(block, alone, pairs, len(keys), places)
        return request(table, keys[asked], own_counts(block, held, len(keys), places, 3)[asked]) if asked.any() else empty

    def answers(table: pa.Table) -> pa.Table:
        runs, counts = unpacked_keys(table["keys"]), unpacked_counts(table["counts"])
        _, inverse = np.unique(np.concatenate(runs), return_inverse=True)
        totals = np.bincount(inverse, weights=counts).astype(np.int64)[inverse]
        alone = (np.bincount(inverse) == 1)[inverse]
        sizes = [len(k) for k in runs]
        cut = np.concatenate(([0], np.cumsum(sizes)))
        return pa.table({
            "block": table["block"], "bucket": table["bucket"], "totals": packed_counts(totals, cut),
            "alone": pa.array([np.packbits(alone[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), "n": pa.array(sizes, pa.int32()),
        })

    def scores(table: pa.Table, got: pa.Table) -> pa.Table:
        mine, block, held = read(table)
        got = got.sort_by([("long", "ascending"), ("bucket", "ascending")])
        pairs = int(np.searchsorted(got["long"].to_numpy(), 1))
        first, rest = got.slice(0, pairs), got.slice(pairs)
        keys, places = block.distinct()
        length = (keys & _LEVEL).astype(np.int64)
        totals = own_counts(block, held, len(keys), places)
        few = length <= short
        totals[few] = unpacked_counts(first["totals"])
        if order > 2:
            # Places among the short keys of all pairs, and among all keys of the longer ones.
            among = np.cumsum(few) - 1
            settled = settled_longer(block, flags(first, int(few.sum())), among[places[1]], len(keys), places[2:])
            totals[~few & ~settled] = unpacked_counts(rest["totals"])
        known, base = unigram_scores(block, places, totals, n_train, vocabulary)
        score = automaton_scores(block, Automaton(block, places, totals, n_train, vocabulary, list(pseudo)), order)
        return pa.table({
            "doc_id": mine["doc_id"], "held_out": mine["held_out"], "n_tokens": pa.array(np.diff(block.offsets) - 1, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(known), n_train), pa.int64()), "base_score": pa.array(base), "score": pa.array(score),
        })

    request_columns, answer_columns = "bucket int, block int, keys binary, counts binary", "block int, bucket int, totals binary, alone binary, n int"
    told = dealt.groupBy("block").applyInArrow(ask_short, request_columns).groupBy("bucket").applyInArrow(answers, answer_columns)
    every = told.withColumn("long", F.lit(0))
    if order > 2:
        longer = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask_long, request_columns)
        more = longer.groupBy("bucket").applyInArrow(answers, answer_columns)
        every = every.union(more.select("block", "bucket", "totals", F.lit(None).cast("binary").alias("alone"), "n", F.lit(1).alias("long")))
    return dealt.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(scores, RESULT)
