"""Token counts (operator 4): rank-synchronous merging of ragged symbol arrays.

A batch's distinct pre-tokens are held as one flat array of symbols. In each
round every pre-token applies its own lowest-rank pair at all its places at
once; pre-tokens without a mergeable pair leave. What is left are the symbols.

Contract: one row per document row; null and empty texts have 0 bytes and 0
tokens; texts of any length are taken whole; repeated rows each give a row;
other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gradeframe.llm.text import id_and_text

#: Splits text before the merges of byte-level vocabularies (published with them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens whose counts a worker remembers, the first it meets; others are merged again in each batch.
REMEMBERED = 400_000

_NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class MergeTable:
    """Pair ranks of a byte-level vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.byte_ids = np.array([self.vocab[c] for c in byte_letters()], dtype=np.int64)
        self.width = max(self.vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (a very large one if it can't merge) and the place of its rule."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE), at


def merged(table: MergeTable, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge all sequences to the end; return the symbols left, by sequence, and their numbers."""
    count, done_symbols, done_owner = lengths.copy(), [], []
    owner = np.repeat(np.arange(len(lengths)), lengths)
    while len(symbols):
        rank = np.full(len(symbols), _NONE)
        rule = np.zeros(len(symbols), dtype=np.int64)
        rank[:-1], rule[:-1] = table.find(symbols[:-1], symbols[1:])
        change = np.flatnonzero(owner[1:] != owner[:-1])
        rank[change] = _NONE
        starts = np.concatenate(([0], change + 1))
        best = np.minimum.reduceat(rank, starts)
        best_here = np.repeat(best, np.diff(np.append(starts, len(symbols))))
        chosen = (rank == best_here) & (rank != _NONE)
        # A pair of equal symbols can overlap itself: of a run of choices, take every second.
        places = np.arange(len(symbols))
        fresh = chosen & ~np.concatenate(([False], chosen[:-1]))
        run_start = np.maximum.accumulate(np.where(fresh, places, 0))
        chosen &= (places - run_start) % 2 == 0
        at = np.flatnonzero(chosen)
        symbols = symbols.copy()
        symbols[at] = table.made[rule[at]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        count -= np.bincount(owner[at], minlength=len(count))
        ended = best_here == _NONE
        done_symbols.append(symbols[ended])
        done_owner.append(owner[ended])
        keep &= ~ended
        symbols, owner = symbols[keep], owner[keep]
    if not done_symbols:
        return symbols, count
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    return symbols[np.argsort(owner, kind="stable")], count


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class TokenCounter:
    """Counts tokens of texts; remembers the counts of frequent pre-tokens."""

    def __init__(self, path: str):
        self.table = merge_table(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.table.special)) or r"(?!)")
        self.known: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        lengths = np.array([len(b) for b in raw], dtype=np.int64)
        symbols = self.table.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        self.known.update(zip(pieces, merged(self.table, symbols, lengths)[1].tolist()))

    def counts(self, texts: list[str | None], batch_bytes: int = 1 << 20) -> list[int]:
        found: list[int] = []
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (size == 0 or size + len(texts[last] or "") <= batch_bytes):
                size += len(texts[last] or "") + 1
                last += 1
            found += self._counts(texts[first:last])
            first = last
        return found

    def _counts(self, texts: list[str | None]) -> list[int]:
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if text else []
            extra.append(max(0, len(parts) - 1))
            split.append([piece for part in parts for piece in self.pattern.findall(part)])
        missing = list(set().union(*split).difference(self.known))
        if missing:
            self.learn(missing)
        found = [sum(map(self.known.__getitem__, pieces)) + more for pieces, more in zip(split, extra)]
        if len(self.known) > REMEMBERED:
            for piece in missing:
                del self.known[piece]
        return found


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: n_bytes (UTF-8), n_tokens, and over_limit (more tokens than `limit`).

    `vocabulary` is the path of a byte-level BPE file that every executor can
    read. Special strings inside texts count as one token, as the file says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
