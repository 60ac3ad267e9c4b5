"""SentencePiece encoding and decoding (operator 5): a streaming Viterbi search.

The model's pieces span a lattice over the characters. In a byte-pair model a
path is the encoding exactly if every two neighbouring pieces are what merging
their own characters gives, so an edge is open only behind a piece it agrees
with, and each boundary keeps one backpointer. Boundaries are kept in a window
of the longest piece's length; whenever the paths from all of them meet at one
boundary, the ids up to there are final and leave. Texts of any length take
bounded memory.

No piece of these models crosses from a letter to a blank, so texts are cut on
bytes from blank to blank and a worker remembers the ids of stretches by their
hashes. All new stretches of a slice that fit into one window are searched in
lockstep on flat arrays: one step takes the next boundary of every stretch.
Their paths meet at their ends, where the ids are final. Longer stretches are
streamed one by one. Where equal scores leave no agreeing path (runs of
blanks), the stretch is merged directly.

Contract: one row per document row; null and empty texts have no ids; texts of
any length are taken whole; repeated rows each give a row; other columns are
ignored. Decoding gives the text back, but for the blank sign U+2581, which
stands for a space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gradeframe.llm.text import SpanMemory, flat_bytes, id_and_text, mix, ragged, slices, stretches

BLANK = "▁"
#: Stretches (about 50 bytes each) and pairs that a worker remembers, the first it meets.
REMEMBERED = 2_000_000
REMEMBERED_PAIRS = 500_000
#: Bytes of text that are encoded and decoded together.
ENCODED_BYTES = 1 << 18
#: Letters of new stretches that are searched in lockstep: the lattice takes some hundred bytes a letter.
LOCKSTEP_LETTERS = 1 << 16
#: Slots for pairs of ids whose agreement is known; a pair replaces the one in its slot.
PAIR_SLOTS = 1 << 20


#: Odd multiplier of the rolling hash of letters.
ROLL = np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(count)]
        plain = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = model.unk_id()
        # A line end in no piece is a boundary as well.
        self.lines = not any("\n" in p for p in self.ids)
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("the model has pieces across blanks")
        self.prefixes = self._prefix_tables()

    def _prefix_tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the sorted hashes of all prefixes of pieces, with the piece's id or -1."""
        tables: list[dict[int, int]] = [{} for _ in range(self.longest)]
        for text, i in self.ids.items():
            rolled = 0
            for k, letter in enumerate(text):
                rolled = (rolled * int(ROLL) + ord(letter) + 1) % (1 << 64)
                tables[k].setdefault(rolled, -1)
            tables[len(text) - 1][rolled] = i
        sorted_keys = [sorted(t) for t in tables]
        return [(np.array(keys, dtype=np.uint64), np.array([t[k] for k in keys], dtype=np.int64)) for keys, t in zip(sorted_keys, tables)]

    def merged(self, symbols: list[str]) -> list[str]:
        """Merge the best-scored neighbours, the first of equals, to the end."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = self.score.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols


@lru_cache(maxsize=2)
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


class StreamingViterbi:
    """Encodes stretches; `commit` is the step that lets final pieces leave the window."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.agree: dict[tuple[str, str], bool] = {}
        self.memory = SpanMemory(self.learn, REMEMBERED)
        self.pair_keys, self.pair_fits = np.full(PAIR_SLOTS, -1, dtype=np.int64), np.zeros(PAIR_SLOTS, dtype=bool)

    def agrees(self, left: str, right: str) -> bool:
        found = self.agree.get((left, right))
        if found is None:
            found = self.pieces.merged(left + right) == [left, right]
            if len(self.agree) < REMEMBERED_PAIRS:
                self.agree[(left, right)] = found
        return found

    def search(self, text: str) -> list[str] | None:
        """Pieces of the agreeing path, or None if there is none."""
        ids, longest, agree = self.pieces.ids, self.pieces.longest, self.agree
        back: dict[int, tuple[int, str]] = {0: (0, "")}
        out: list[str] = []
        final = 0
        for end in range(1, len(text) + 1):
            for start in range(max(final, end - longest), end):
                before = back.get(start)
                if before is None:
                    continue
                piece = text[start:end]
                if piece not in ids and end - start > 1:
                    continue
                if start:
                    fits = agree.get((before[1], piece))
                    if not (self.agrees(before[1], piece) if fits is None else fits):
                        continue
                back[end] = (start, piece)
                break
            if end - final > 2 * longest:
                moved = self.commit(back, final, end, out)
                if moved is None:
                    return None
                final = moved
        if len(text) not in back:
            return None
        tail = []
        at = len(text)
        while at > final:
            start, piece = back[at]
            tail.append(piece)
            at = start
        return out + tail[::-1]

    def commit(self, back: dict[int, tuple[int, str]], final: int, end: int, out: list[str]) -> int | None:
        """Trace the paths of all boundaries that later pieces can start from; emit what they share."""
        live = {b for b in range(end - self.pieces.longest + 1, end + 1) if b in back}
        if not live:
            return None
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last][0])
        meet = live.pop()
        if meet > final:
            shared, at = [], meet
            while at > final:
                shared.append(back[at][1])
                at = back[at][0]
            out += shared[::-1]
            for b in [b for b in back if b < meet]:
                del back[b]
        return max(meet, final)

    def stretch(self, text: str) -> np.ndarray:
        """Ids of one stretch of any length."""
        found = self.search(text)
        ids: list[int] = []
        for piece in self.pieces.merged(text) if found is None else found:
            known = self.pieces.ids.get(piece)
            if known is not None:
                ids.append(known)
            else:
                ids += [self.pieces.byte_ids.get(b, self.pieces.unknown) for b in piece.encode()]
        return np.array(ids, dtype=np.uint32)

    def pairs_agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`agrees` for arrays of piece ids."""
        keys = left * len(self.pieces.text) + right
        slots = (mix(keys.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        fits, known = self.pair_fits[slots], self.pair_keys[slots] == keys
        if not known.all():
            new, sample, place = np.unique(keys[~known], return_index=True, return_inverse=True)
            text = self.pieces.text
            pairs = zip(left[~known][sample].tolist(), right[~known][sample].tolist())
            found = np.array([self.pieces.merged(text[a] + text[b]) == [text[a], text[b]] for a, b in pairs], dtype=bool)
            fits[~known] = found[place]
            at = slots[~known][sample]
            self.pair_keys[at] = new
            # Of several new pairs of one slot the last stays; its answer must be the one beside it.
            last = self.pair_keys[at] == new
            self.pair_fits[at[last]] = found[last]
        return fits

    def lockstep(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Search all stretches at once: ids end to end, ids per stretch, and which stretches have an agreeing path.

        `letters` holds the code points of all stretches, none longer than a window.
        """
        n, starts = len(sizes), np.cumsum(sizes) - sizes
        owner, place = np.repeat(np.arange(n), sizes), ragged(sizes)
        left_over = np.repeat(sizes, sizes) - place
        # Every place where a piece lies: rolled on letter by letter while some piece goes on.
        at, rolled = np.arange(len(letters)), np.zeros(len(letters), dtype=np.uint64)
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for length, (keys, ids) in enumerate(self.pieces.prefixes, 1):
            inside = left_over[at] >= length
            at, rolled = at[inside], rolled[inside]
            if not len(at):
                break
            rolled = rolled * ROLL + letters[at + length - 1].astype(np.uint64) + np.uint64(1)
            where = np.minimum(np.searchsorted(keys, rolled), len(keys) - 1)
            hit = keys[where] == rolled
            at, rolled, where = at[hit], rolled[hit], where[hit]
            whole = ids[where] >= 0
            found.append((at[whole], ids[where[whole]], length))
        first = np.concatenate([f[0] for f in found])
        piece = np.concatenate([f[1] for f in found])
        length = np.repeat([f[2] for f in found], [len(f[0]) for f in found])
        # One boundary more than letters in each stretch; boundary b of stretch s is b + starts[s] + s.
        end = place[first] + length
        order = np.argsort((end * n + owner[first]) * (self.pieces.longest + 1) - length, kind="stable")
        first, piece, length, end = first[order], piece[order], length[order], end[order]
        source = first + owner[first]
        target = source + length
        last_piece = np.full(len(letters) + n, -1, dtype=np.int64)
        back = np.zeros(len(letters) + n, dtype=np.int64)
        zero = starts + np.arange(n)
        reached = np.zeros(len(letters) + n, dtype=bool)
        reached[zero] = True
        cuts = np.searchsorted(end, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            # Pieces that end at this step's boundary, the longest first; each boundary takes the first that fits.
            open_ = np.arange(a, b)[reached[source[a:b]]]
            while len(open_):
                head = np.ones(len(open_), dtype=bool)
                head[1:] = target[open_[1:]] != target[open_[:-1]]
                tried = open_[head]
                before = last_piece[source[tried]]
                fits = before < 0
                if not fits.all():
                    fits[~fits] = self.pairs_agree(before[~fits], piece[tried[~fits]])
                taken = tried[fits]
                reached[target[taken]] = True
                last_piece[target[taken]], back[target[taken]] = piece[taken], source[taken]
                open_ = open_[~head]
                open_ = open_[~reached[target[open_]]]
        done = reached[zero + sizes]
        # Follow the backpointers of all stretches from their ends.
        live = np.flatnonzero(done)
        now, steps = (zero + sizes)[live], []
        while len(live):
            steps.append((live, last_piece[now]))
            now = back[now]
            going = now > zero[live]
            live, now = live[going], now[going]
        if not steps:
            return np.zeros(0, dtype=np.uint32), np.zeros(n, dtype=np.int64), done
        whose = np.concatenate([x[0] for x in steps])
        rank = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
        out = np.concatenate([x[1] for x in steps])[np.lexsort((-rank, whose))]
        return out.astype(np.uint32), np.bincount(whose, minlength=n), done

    def learn(self, raw: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct stretches, end to end, and their offsets."""
        texts = [r.decode().replace(" ", BLANK) for r in raw]
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        window = 2 * self.pieces.longest
        short = np.flatnonzero(sizes <= window)
        found = []
        for a, b in stretches(np.concatenate(([0], np.cumsum(sizes[short]))), LOCKSTEP_LETTERS):
            few = "".join([texts[k] for k in short[a:b].tolist()])
            found.append(self.lockstep(np.frombuffer(few.encode("utf-32-le"), dtype="<u4"), sizes[short[a:b]]))
        ids, numbers, done = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate((np.uint32, np.int64, bool)))
        rest = np.concatenate((np.flatnonzero(sizes > window), short[~done]))
        single = [self.stretch(texts[k]) for k in rest.tolist()]
        whose = np.concatenate((np.repeat(short, numbers), np.repeat(rest, [len(i) for i in single]).astype(np.int64)))
        values = np.concatenate((ids, *single))[np.argsort(whose, kind="stable")]
        return values, np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(texts)))))

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, cuts = self.encode_arrays(*spaced(pa.array(texts, pa.large_string())))
        return [part.astype("<u4").tobytes() for part in np.split(ids, cuts[1:-1])] if texts else []

    def encode_arrays(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and n+1 offsets per text; each text starts with a space, as `spaced` makes it."""
        blank = data == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        if self.pieces.lines:
            line = data == 0x0A
            begins |= line
            begins[1:] |= line[:-1]
        starts = np.flatnonzero(begins)
        ids, cuts = self.memory.find(data, starts, np.append(starts[1:], len(data))) if len(starts) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        return ids, cuts[np.searchsorted(starts, offsets)]


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts with a space before each that isn't empty; the blank sign becomes a space."""
    texts = [" " + t.replace(BLANK, " ") if t else "" for t in column.to_pylist()]
    return flat_bytes(pa.array(texts, pa.large_string()))


@lru_cache(maxsize=2)
def load_search(path: str) -> StreamingViterbi:
    """One search for all tasks of a worker."""
    return StreamingViterbi(load_pieces(path))


class Decoder:
    """Turns ids back into text."""

    def __init__(self, pieces: Pieces):
        self.raw = [bytes([pieces.byte_of[i]]) if i in pieces.byte_of else p.replace(BLANK, " ").encode() if p in pieces.ids else b"" for i, p in enumerate(pieces.text)]

        self.flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.sizes = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts, their first space included, and n+1 offsets per text."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.repeat(self.first[ids], sizes) + ragged(sizes)], ends[offsets]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def gives_back(data: np.ndarray, offsets: np.ndarray, decoded: np.ndarray, decoded_offsets: np.ndarray) -> np.ndarray:
    """Whether each decoded text equals the text."""
    sizes = np.diff(offsets)
    same = sizes == np.diff(decoded_offsets)
    kept = np.where(same, sizes, 0)
    differ = data[np.repeat(offsets[:-1], kept) + ragged(kept)] != decoded[np.repeat(decoded_offsets[:-1], kept) + ragged(kept)]
    same[np.repeat(np.arange(len(sizes)), kept)[differ]] = False
    return same


def encode_documents(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: n_pieces, ids_crc32, round_trip (decoding gives the text back), and ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = load_search(model)
        decoder = Decoder(search.pieces)
        for part, _, _ in slices(batches, size=ENCODED_BYTES):
            data, offsets = spaced(part.column("text"))
            ids, cuts = search.encode_arrays(data, offsets)
            raw, at = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
            each = [raw[a:b] for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(cuts), pa.int64()), pa.array([zlib.crc32(i) for i in each], pa.int64()),
                 pa.array(gives_back(data, offsets, *decoder.decode_all(ids, cuts)), pa.bool_()), pa.array(each, pa.binary())],
                names=["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"],
            )

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids binary")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """Texts of encoded documents: doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load_pieces(model))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decoder.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
