"""URL filters (operator 6): a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into multiword Shift-And masks: one bit for each
pattern symbol, in as many 64-bit words as it takes. A step reads the next
symbol of every URL of a batch and moves all patterns at once.

A canonical URL is `.host`, one separator that no byte equals, then the path.

Contract: one row per page row; null URLs and those without `://` have an empty
host and path and match no host rule; repeated rows each give a row; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: The symbol between host and path; bytes are 0 to 255.
BETWEEN = 256
#: Automaton words (64 bits each) a batch may hold at once: URLs times words of masks.
HELD_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A glob over canonical URLs: `*` any run, `?` one byte, `|` the end of the host. Of fitting rules the longest wins, then the first."""

    glob: str
    verdict: str
    name: str
    length: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits a host and its subdomains, on paths that start with `path`."""
    return Rule(f"*.{host}|{path}*", verdict, host + path, len(host + path))


class ShiftAnd:
    """Masks of many globs, and the lock-step run over many URLs."""

    def __init__(self, globs: Sequence[str]):
        bits: list[tuple[set[int] | None, bool]] = []
        first, free, last = [], [], []
        empty = []
        for glob in globs:
            symbols: list[set[int] | None] = []
            loops: list[bool] = []
            leading = False
            for char in glob:
                if char == "*":
                    if symbols:
                        loops[-1] = True
                    else:
                        leading = True
                    continue
                for value in [None] if char == "?" else [BETWEEN] if char == "|" else char.encode():
                    symbols.append(value)
                    loops.append(False)
            empty.append(not symbols)
            first.append(len(bits))
            free.append(leading)
            bits += zip(symbols, loops)
            last.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.step = np.zeros((BETWEEN + 1, self.words), dtype=np.uint64)
        self.stay, self.starts, self.again = (np.zeros(self.words, dtype=np.uint64) for _ in range(3))
        for k, (symbol, loop) in enumerate(bits):
            bit = np.uint64(1) << np.uint64(k % 64)
            if symbol is None:
                self.step[:BETWEEN, k // 64] |= bit
            else:
                self.step[symbol, k // 64] |= bit
            if loop:
                self.stay[k // 64] |= bit
        for k, leading, none in zip(first, free, empty):
            if not none:
                bit = np.uint64(1) << np.uint64(k % 64)
                self.starts[k // 64] |= bit
                if leading:
                    self.again[k // 64] |= bit
        self.last, self.empty = last, empty

    def run(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Final states, a row of words for each text."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        state = np.zeros((len(lengths), self.words), dtype=np.uint64)
        begin, sizes = offsets[:-1][order], lengths[order]
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -k, side="left"))
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= ~self.starts
            moved |= self.starts if k == 0 else self.again
            moved &= self.step[symbols[begin[:live] + k]]
            state[:live] = moved | (now & self.stay)
        out = np.empty_like(state)
        out[order] = state
        return out

    def fits(self, state: np.ndarray, k: int) -> np.ndarray:
        if self.empty[k]:
            return np.ones(len(state), dtype=bool)
        place = self.last[k]
        return (state[:, place // 64] >> np.uint64(place % 64)) & np.uint64(1) == 1


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path, of one URL; both empty without `://`."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", rules_per_block: int = 2048, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Per page: host, path, the winning rule's name (or null) and its verdict, else `default`.

    Rules are the program's own settings, not a table. Many rules are taken in
    blocks, so that states stay small.
    """
    ranked = sorted(rules, key=lambda r: -r.length)
    blocks = [ranked[i : i + rules_per_block] for i in range(0, len(ranked), rules_per_block)]

    def judge(parts: list[tuple[str, str]], automata: list[ShiftAnd]) -> np.ndarray:
        raw = [(b"." + h.encode(), p.encode()) for h, p in parts]
        lengths = np.array([len(h) + 1 + len(p) for h, p in raw], dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        symbols = np.frombuffer(b"".join(h + b"\0" + p for h, p in raw), dtype=np.uint8).astype(np.int16)
        symbols[offsets[:-1] + np.array([len(h) for h, _ in raw], dtype=np.int64)] = BETWEEN
        winner = np.full(len(parts), -1)
        for b, automaton in enumerate(automata):
            state = automaton.run(symbols, offsets)
            for k in range(len(blocks[b])):
                winner[(winner < 0) & automaton.fits(state, k)] = b * rules_per_block + k
        return winner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [ShiftAnd([r.glob for r in block]) for block in blocks]
        rows = max(1, HELD_WORDS // max([a.words for a in automata], default=1) // 16)
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                parts = [host_and_path(u) for u in part.column("url").to_pylist()]
                winner = judge(parts, automata).tolist()
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()),
                     pa.array([ranked[w].name if w >= 0 else None for w in winner], pa.string()),
                     pa.array([ranked[w].verdict if w >= 0 else default for w in winner], pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    columns = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    kind = columns.schema["page_id"].dataType.simpleString()
    return columns.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
