"""The numbered operators against plain versions, on edge cases and on whole small tables."""

import io
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from gradeframe.llm import classifier, decontaminate, lm, neardup, pieces, quality, repeats, text, tokenfile, tokens, urls
from gradeframe.llm.queries import ORACLES, QUERIES, URL_RULES
from gradeframe.llm.text import flat_bytes

PROSE = "the quick brown fox jumps over the lazy dog and then it runs far away from the old farm house near the river bank".split()


def random_text(rnd, n):
    return " ".join(rnd.choice(PROSE) + str(rnd.randrange(40)) for _ in range(n))


def edge_rows():
    """Nulls, empty and blank texts, one word, long texts, ties, copies, near copies, passages, odd characters."""
    rnd = random.Random(4)
    base = random_text(rnd, 90)
    near = base.split()
    near[40] = "changed"
    passage = random_text(rnd, 60)
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "two words"), (5, base), (6, base), (7, " ".join(near)),
        (8, random_text(rnd, 3000)), (9, "x" * 30000), (10, "ab " * 5000), (11, "Ünïcode 漢字 😀 ́x▁y " * 30),
        (12, random_text(rnd, 30) + " " + passage + " " + random_text(rnd, 20)), (13, passage + " " + random_text(rnd, 40)),
        (14, "<|endoftext|> a <|endoftext|><|startoftext|> b"), (15, "line one is here\n" * 30), (16, base.upper()), (-5, base + " more"),
        (17, "\x00nul\x00 bytes\x0b\x0c\r\n"), (18, "# * $ % & | < > " * 20), (19, "THE the The tHe"),
    ]
    return rows + [(100 + i, random_text(rnd, rnd.randrange(5, 200))) for i in range(40)]


ROWS = edge_rows()


@pytest.fixture(scope="module")
def documents(docs_of):
    return docs_of(ROWS).cache()


@pytest.fixture(scope="module")
def whole(spark, sf):
    """The whole small table as (doc_id, text) rows."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for d in want:
        assert got[d][:4] == want[d][:4], d
        assert got[d][4:] == pytest.approx(want[d][4:], rel=1e-9), d


LM = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def test_op1_scores_edges_in_one_and_many_blocks(documents):
    want = brute.lm_scores(ROWS)
    close(by_id(lm.score_documents(documents), *LM), want)
    close(by_id(lm.score_documents(documents, block_bytes=20_000), *LM), want)


def test_op1_longer_n_grams_with_a_pair_of_one_block_are_not_asked_for(documents):
    data, offsets = flat_bytes(pa.array(["a b c d e", "c d"]))
    block = lm.Block(data, offsets, 4)
    short, places = block.distinct(1, 2)
    spots = np.flatnonzero(block.whole(2))
    alone = np.zeros(len(short), dtype=bool)
    alone[places[1][spots == 2]] = True  # only "a b" is in this block alone
    keys, longer = block.distinct(3)
    settled = lm.settled_longer(block, alone, places[1], len(keys), longer)
    held = {int(e): bool(settled[k]) for n, at in enumerate(longer, 3) for e, k in zip(n * 100 + np.flatnonzero(block.whole(n)), at)}
    # Three words end at 2 (begin a b), 3 (a b c), 4, 5, 6, 9 and 10; four at 3 to 6 and 10.
    assert held == {302: True, 303: True, 304: False, 305: False, 306: False, 309: False, 310: False, 403: True, 404: True, 405: False, 406: False, 410: False}


def test_op1_order_3_scores_are_the_same_in_one_and_many_blocks(documents):
    whole = by_id(lm.score_documents(documents, order=3), *LM)
    close(by_id(lm.score_documents(documents, order=3, block_bytes=5_000), *LM), whole)
    close(by_id(lm.score_documents(documents, order=4, block_bytes=5_000), *LM), by_id(lm.score_documents(documents, order=4), *LM))


def test_op1_probabilities_of_a_context_sum_to_one(docs_of):
    """All known words, the end and one unknown word after "a b", the texts' common beginning taken away."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "b a b", "c c a b", "a"])]
    asked = [(1000 + k, f"a b {w}") for k, w in enumerate(["a", "b", "c", "never"])] + [(2000, "a b"), (2001, "a")]
    for order in (2, 3):
        scored = lm.score_documents(docs_of(rows + asked), held_out=F.col("doc_id") >= 1000, order=order)
        got = {d: v[0] for d, v in by_id(scored, "score").items()}
        said = lambda text: brute_order(rows, text.split(), order)
        for d, text in asked:
            assert got[d] == pytest.approx(sum(map(math.log10, said(text))), rel=1e-12)
        after = [10 ** got[1000 + k] / math.prod(said(f"a b {w}")[:2]) / said(f"a b {w}")[3] for k, w in enumerate(["a", "b", "c", "never"])]
        end = 10 ** got[2000] / math.prod(said("a b")[:2])
        assert sum(after) + end == pytest.approx(1.0, abs=1e-12)


def brute_order(rows, words, order, pseudo=(500.0, 50.0)):
    """Probability of each word and the end, counted one by one."""
    seen = Counter()
    for _, text in rows:
        line = ["<s>", *text.split(), "</s>"]
        seen.update(tuple(line[i : i + n]) for n in range(1, order + 1) for i in range(len(line) - n + 1))
    told = {g[0]: c for g, c in seen.items() if len(g) == 1 and g[0] != "<s>"}
    line, out = ["<s>", *words, "</s>"], []
    for i in range(1, len(line)):
        p = (told.get(line[i], 0) + 1) / (sum(told.values()) + len(told) + 1)
        for n in range(1, order):
            context = tuple(line[max(0, i - n) : i])
            if i >= n and seen[context]:
                p = (seen[(*context, line[i])] + pseudo[n - 1] * p) / (seen[context] + pseudo[n - 1])
        out.append(p)
    return out


def lm_block(texts, order):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return lm.Block(data, np.concatenate(([0], np.cumsum([len(r) for r in raw]))), order)


def lm_automaton(texts, trained, order):
    block = lm_block(texts, order)
    keys, places = block.distinct()
    learns = np.repeat(np.arange(len(texts)) < trained, np.diff(block.offsets))
    totals = sum(np.bincount(at[learns[block.whole(n)]], minlength=len(keys)) for n, at in enumerate(places, 1))
    return block, lm.Automaton(block, places, totals, 100, 10, [500.0, 50.0, 10.0])


def test_op1_traversal_takes_arcs_and_failure_arcs():
    """A training text takes arcs only; an unknown word falls through every context before it."""
    block, automaton = lm_automaton(["a b c d", "a b x c"], 1, 3)
    assert len(automaton.failure) == 1 + 6 + 5 and (automaton.failure[1:7] == 0).all() and (automaton.failure[7:] > 0).all()
    lm.automaton_scores(block, automaton, 3)
    # "a b" -> "b" -> root on x; c and the end: c from the root; after "c" the end is unseen: one fall.
    assert automaton.falls == 3
    block, automaton = lm_automaton(["a b c d"], 1, 3)
    lm.automaton_scores(block, automaton, 3)
    assert automaton.falls == 0


def test_op1_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64, endpoint=False))
    keys = np.concatenate((keys, [np.uint64((1 << 64) - 1)]))
    cut = np.array([0, 1, 3, 400, 401, len(keys)])
    got = lm.unpacked_keys(lm.packed_keys(keys, cut))
    assert [len(g) for g in got] == list(np.diff(cut)) and (np.concatenate(got) == keys).all()


@pytest.mark.parametrize("order", [2, 3, 4])
def test_op1_strides_carry_the_state(order):
    rnd = random.Random(order)
    texts = [random_text(rnd, n) for n in (0, 1, 2, 700, 64, 65, 129)] + ["", "a b"]
    block, automaton = lm_automaton(texts, 4, order)
    whole = lm.automaton_scores(block, automaton, order, stride=10_000)
    falls = automaton.falls
    for stride in (order, 7, 64):
        assert lm.automaton_scores(block, automaton, order, stride) == pytest.approx(whole, rel=1e-12)
        assert automaton.falls == falls


def test_op1_higher_order_beats_the_base_on_held_out_text(spark, sf):
    got = lm.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), order=3).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_op1_query_backs_off_through_two_contexts(spark, sf):
    """The query's scores against trigrams counted one by one."""
    rows = {r["doc_id"]: ["<s>", *brute.SPACED.findall(brute.lower(r["text"])), "</s>"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = Counter()
    for doc_id, words in rows.items():
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            seen.update(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    told = {g[0]: c for g, c in seen.items() if len(g) == 1 and g[0] != "<s>"}
    size = sum(told.values()) + len(told) + 1

    def likelihood(before, word):
        p = (told.get(word, 0) + 1) / size
        for m, n in ((500.0, 1), (50.0, 2)):
            context = tuple(before[-n:])
            if len(before) >= n and seen[context]:
                p = (seen[(*context, word)] + m * p) / (seen[context] + m)
        return p

    got = by_id(QUERIES["op1_lm_scores"](spark, sf), "score")
    for doc_id, words in rows.items():
        want = sum(math.log10(likelihood(words[:i], words[i])) for i in range(1, len(words)))
        assert got[doc_id] == pytest.approx((want,), rel=1e-9)


DECON = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_op2_finds_all_windows(spark, documents):
    items = [(1, " ".join(ROWS[8][1].split()[100:160])), (2, "two words"), (3, None), (4, "--"), (5, "completely other words " * 10), (10, ROWS[12][1]), (10, ROWS[12][1]), (None, "word"), (7, "The Word")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(ROWS, [i for i in items if i[0] is not None])
    assert by_id(decontaminate.find_contamination(documents, table), *DECON) == want
    blocks = decontaminate.find_contamination(documents, table, broadcast_bytes=300)
    assert by_id(blocks, *DECON) == want
    kept = {r["doc_id"] for r in decontaminate.remove_contaminated(documents, table).collect()}
    assert kept == {d for d, v in want.items() if not v[4]}
    assert {r["doc_id"] for r in decontaminate.remove_contaminated(documents, table, broadcast_bytes=300).collect()} == kept
    assert decontaminate.remove_contaminated(documents, table).columns == documents.columns


def test_op2_removes_rows_by_their_own_text(spark, docs_of):
    """Null and repeated ids: blocks of the benchmark remove the same rows as the whole."""
    bad = " ".join(ROWS[8][1].split()[100:160])
    items = spark.createDataFrame([(1, bad), (2, " ".join(ROWS[12][1].split()[:40])), (3, "completely other words " * 10)], "item_id long, text string")
    rows = [(None, bad), (None, "a clean text"), (None, None), (7, bad), (7, "another clean text"), (7, bad), (7, None), (8, "a clean text"), (8, "a clean text"), (9, bad)]
    docs = docs_of(rows)
    want = sorted((str(r) for r in rows if r[1] != bad))
    for size in (1 << 20, 300):
        kept = decontaminate.remove_contaminated(docs, items, broadcast_bytes=size)
        assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == want
        assert kept.columns == docs.columns
        assert decontaminate.find_contamination(docs, items, broadcast_bytes=size).count() == len(rows)


def test_op2_gives_longest_matches_with_places(spark, docs_of):
    text = " ".join(f"w{i}" for i in range(50))
    docs = docs_of([(1, "start here " + text + " end")])
    item = spark.createDataFrame([(9, "other " + " ".join(f"w{i}" for i in range(5, 40)))], "item_id long, text string")
    (row,) = decontaminate.find_contamination(docs, item).collect()
    assert [tuple(m) for m in row["matches"]] == [(9, 7, 35)]


@pytest.mark.parametrize("words,limit", [(3, (85, 100)), (5, (4, 5))])
def test_op3_components(documents, words, limit):
    got = by_id(neardup.near_duplicates(documents, words=words, limit=limit), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(ROWS, words, *limit)


def test_op3_crowded_regions_and_chains(docs_of):
    """Many near copies of one text, more than a neighbour window holds, some only linked through others."""
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rnd.randrange(1, 9)):
            own[rnd.randrange(len(own))] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = by_id(neardup.near_duplicates(docs_of(rows), words=3, limit=(85, 100), reach=2), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(rows, 3, 85, 100)


def test_op3_keep_one_keeps_columns_and_one_of_repeated_rows(docs_of):
    docs = docs_of([(1, "same text of some words"), (1, "same text of some words"), (2, "same text of some words"), (3, None), (None, "quite another text of words")])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (True, 0)]


def test_op4_counts_as_the_library(documents, whole):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {d: (len((t or "").encode()), n, n > 512) for d, t in ROWS for n in [len(library.encode(t or "", add_special_tokens=False).ids)]}
    assert by_id(tokens.count_tokens(documents, path), "n_bytes", "n_tokens", "over_limit") == want
    counter = tokens.TokenCounter(path)
    texts = [t for _, t in whole]
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_op4_forgets_beyond_its_limit(monkeypatch, whole):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for _, t in whole[:40]]
    want = tokens.TokenCounter(path).counts(texts)
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    small = tokens.TokenCounter(path)
    assert small.counts(texts, batch_bytes=2000) == want and len(small.known) <= 10


def test_op5_ids_as_the_library_and_back(documents, whole):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = pieces.encode_documents(documents, path)
    got = by_id(encoded, "ids", "n_pieces", "ids_crc32", "round_trip")
    for d, t in ROWS:
        ids = np.array(library.encode(t, num_threads=1) if t else [], dtype="<u4").tobytes()
        assert got[d] == (ids, len(ids) // 4, zlib.crc32(ids), True), d
    back = by_id(pieces.decode_documents(encoded, path), "text")
    assert back == {d: ((t or "").replace("▁", " "),) for d, t in ROWS}
    search = pieces.StreamingViterbi(pieces.load_pieces(path))
    texts = [t for _, t in whole]
    assert [np.frombuffer(x, "<u4").tolist() for x in search.encode(texts)] == library.encode(texts, num_threads=1)


def test_op6_rules_and_globs(spark):
    made = ["http://Example.com/en/x?q", "https://www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/b", "http://a.net/x/es/", "http://net/fr/", "http://x.com", "x.com/en/", None, "", "ftp://a.b.net/es", "http://e.net#/es/", "http://é.com/ü", "://x.com/a", "http://a.net/" + "p" * 5000, "http://net/es/://com/"]
    pages = spark.createDataFrame([(i, u, 7) for i, u in enumerate(made)] + [(0, made[0], 7)], "page_id long, url string, rule long")
    got = sorted((tuple(r) for r in urls.filter_urls(pages, URL_RULES).collect()), key=lambda r: (r[0], r[1]))
    assert len(got) == len(made) + 1
    best = {(r[0]): r[1:] for r in got}
    for i, u in enumerate(made):
        host, path = urls.host_and_path(u)
        fit = [(n, v) for h, p, n, v in (("com", "/", "com/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("net", "/es/", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        name, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "allow")
        assert best[i] == (host, path, name, verdict), u
    globs = [urls.Rule("*b?d*|/*.zip", "block", "zip", 5), urls.Rule("*", "allow", "all", 0), *[urls.Rule(f"*.host{k}.org|*", "block", f"h{k}", 9) for k in range(200)]]
    more = spark.createDataFrame([(1, "http://a.bad.org/x/y.zip"), (2, "http://a.bad.org/x.zip/y"), (3, "http://host150.org"), (4, "http://c/")], "page_id long, url string")
    for block in (7, 2048):
        assert {r["page_id"]: r["rule"] for r in urls.filter_urls(more, globs, rules_per_block=block).collect()} == {1: "zip", 2: "all", 3: "h150", 4: "all"}


def test_op7_round_trip_in_order(documents, docs_of):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = by_id(tokenfile.round_trip(documents, path, 2), "start", "n_tokens", "ids_crc32")
    start = 0
    for d, t in sorted(ROWS, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes())), d
        start += len(ids)
    again = tokenfile.round_trip(docs_of([(None, "b"), (4, "a"), (4, "a")]), path, 2).collect()
    assert [(r["doc_id"], r["start"]) for r in sorted(again, key=lambda r: r["start"])] == [(None, 0), (4, 2), (4, 4)]


def test_op7_reader_reads_single_frames_and_refuses_damage(monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_BYTES", 500)
    stream = io.BytesIO()
    writer = tokenfile.SeekableWriter(stream)
    made = [np.arange(i % 90, dtype="<u4") for i in range(200)]
    for i, ids in enumerate(made):
        writer.add(i, ids.tobytes())
    assert writer.close() == sum(map(len, made))
    raw = stream.getvalue()
    reader = tokenfile.SeekableReader(io.BytesIO(raw), len(raw))
    assert len(reader.packed) > 10
    assert all((reader.ids(k) == made[k]).all() for k in (199, 0, 57, 58, 3))
    broken = bytearray(raw)
    broken[int(reader.at[3]) + 12] ^= 0xFF
    with pytest.raises(Exception):
        other = tokenfile.SeekableReader(io.BytesIO(bytes(broken)), len(raw))
        [other.ids(k) for k in range(200)]
    with pytest.raises(ValueError):
        tokenfile.SeekableReader(io.BytesIO(raw[:-1]), len(raw) - 1)


def test_op8_counts_and_verdicts(documents, whole, spark, sf):
    got = by_id(quality.apply_rules(documents), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for d, t in ROWS:
        want = brute.rule_counts(t)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[d][:6] == (*want, failed), d
        assert not (failed and got[d][6])
    judged = QUERIES["op8_quality_rules"](spark, sf)
    assert by_id(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == {d: brute.rule_counts(t) for d, t in whole}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    shares = {r["quality"]: r["share"] for r in judged.filter("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.9 and shares[0] < 0.5


def test_op8_plan_is_native(documents):
    plan = quality.apply_rules(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


SPANS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_op9_bytes(documents):
    want = brute.repeats(ROWS)
    assert by_id(repeats.find_repeats(documents), *SPANS) == want
    assert by_id(repeats.find_repeats(documents, block_bytes=10_000), *SPANS) == want


def test_op9_rows_of_one_id_and_pieces(docs_of, monkeypatch):
    text = " ".join(f"{i * 7919 % 10007}" for i in range(100))
    got = sorted(tuple(r) for r in repeats.find_repeats(docs_of([(1, text), (1, text), (2, text), (None, "short")])).collect() if r["doc_id"])
    assert [(r[0], r[2]) for r in got] == [(1, 0), (1, 0), (2, len(text))]
    data = np.frombuffer((text * 3).encode(), dtype=np.uint8)
    offsets = np.array([0, 150, len(data)])
    whole = repeats.runs_of(data, offsets)
    monkeypatch.setattr(repeats, "PIECE_BYTES", 130)
    parts = repeats.runs_of(data, offsets)
    windows = lambda runs: {(s + k, h) for s, n, h in zip(*map(lambda x: x.tolist(), runs)) for k in range(n)}
    assert windows(whole) == windows(parts)


def test_op9_many_contexts_of_one_anchor(docs_of):
    """A short phrase with other surroundings each time, beside copies: its windows are compared in many buckets."""
    rnd = random.Random(6)
    phrase = "this very common phrase of some sixty bytes stands in all texts "
    line = random_text(rnd, 12)
    texts = [random_text(rnd, 20) + phrase + random_text(rnd, 20) for _ in range(60)]
    rows = [*ROWS, *((1000 + i, t) for i, t in enumerate(texts)), *((2000 + i, "x " + t) for i, t in enumerate(texts[:20])), *((3000 + i, line + phrase + line) for i in range(5))]
    docs = docs_of(rows)
    want = brute.repeats(rows)
    for limit in (1, 8):
        assert by_id(repeats.find_repeats(docs, block_bytes=10_000, runs_limit=limit), *SPANS) == want
    again = [(1, texts[0]), (1, texts[0]), (None, texts[1]), (5, texts[1]), (2, texts[0]), (1, texts[2])]
    spans = lambda **options: sorted(map(str, repeats.find_repeats(docs_of(again), **options).collect()))
    assert spans(block_bytes=2000, runs_limit=1) == spans()


def test_op9_cut_keeps_characters_and_columns(documents):
    kept = repeats.without_repeats(documents)
    assert kept.columns == documents.columns
    gone = brute.removed(ROWS)
    assert by_id(kept, "text", "source", "n_tokens") == {d: (brute.cut(t, gone[d]), None, 1) for d, t in ROWS}


@pytest.mark.parametrize("alphabet", [b"ab", b"a", bytes(range(256)), b"ab\0"])
def test_op9_two_stage_sorting(alphabet):
    rnd = random.Random(2)
    for n in (1, 2, 60, 700):
        raw = bytes(rnd.choice(alphabet) for _ in range(n))
        found = repeats.two_stage_suffixes(np.frombuffer(raw, np.uint8), 100).tolist()
        assert sorted(found) == list(range(n))
        keys = [raw[i : i + 100].ljust(100, b"\0") for i in found]
        assert keys == sorted(keys)


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op10_quality_classifier"](spark, sf)
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert scored.filter("predicted <> CAST(score >= 0.3 AS INT)").isEmpty()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    right = scored.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.95


def test_op10_edges(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = classifier.fit(documents, none)
    assert {r["score"] for r in classifier.score_documents(documents, model).collect()} == {0.5}
    labels = spark.createDataFrame([(d, int(i % 2), 0) for i, (d, _) in enumerate(ROWS)] + [(5, 1, 0), (6, None, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    scored = classifier.score_documents(documents, classifier.fit(documents, labels)).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["doc_id"]: r["held_out"] for r in scored} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in ROWS}
    assert classifier.keep_good(documents, model).columns == documents.columns


def test_empty_tables(spark, docs_of):
    empty = docs_of([]).limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    byte, word, piece = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    made = [
        lm.score_documents(empty), decontaminate.find_contamination(empty, items), neardup.near_duplicates(empty), tokens.count_tokens(empty, byte), pieces.encode_documents(empty, piece),
        urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES), tokenfile.round_trip(empty, word, 2), quality.apply_rules(empty), repeats.find_repeats(empty),
        classifier.score_documents(empty, classifier.fit(empty, labels)), repeats.without_repeats(empty), neardup.keep_one(empty),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_empty_benchmark_matches_nothing(spark, documents):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(documents, items).filter("n_hit > 0 OR contaminated").isEmpty()


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_op3_null_ids_take_part_in_links(docs_of):
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
    near = base[:50] + ["changed"] + base[51:]
    other = [f"v{rnd.randrange(10**6)}" for _ in range(100)]
    docs = docs_of([(1, " ".join(base)), (None, " ".join(near)), (None, " ".join(other)), (None, " ".join(other[:-1])), (5, None), (2, "a b c d"), (2, " ".join(near))])
    got = sorted(((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, words=5, limit=(4, 5)).collect()), key=repr)
    assert got == sorted([(1, 1, True), (0, 1, False), (0, None, True), (0, None, True), (5, 5, True), (2, 2, True), (2, 1, False)], key=repr)
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(docs).collect())
    # Of the two nameless near copies one stays; of id 2 only the text that copies nothing.
    assert [k for k, _ in kept] == [0, 1, 2, 5] and kept[0][1] in (" ".join(other), " ".join(other[:-1])) and kept[2][1] == "a b c d"


def test_op3_short_ranges_keep_neighbours(docs_of, spark):
    """More tasks than rows to fill them: near copies must meet all the same."""
    rnd = random.Random(13)
    rows = []
    for i in range(12):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-1]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = by_id(neardup.near_duplicates(docs_of(rows), words=3, limit=(85, 100)), "n_shingles", "component_id", "kept")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute.near_duplicates(rows, 3, 85, 100)


def test_op8_verdicts_as_plain_distances(spark, sf):
    """Distances and `kept` against plain histograms of the whole small table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    text_of = {r["doc_id"]: (r["lang"] or "", r["text"] or "") for r in docs}

    def shares(text):
        words = brute.SPACED.findall(text)
        classes = [sum(k(c) for c in text) for k in (lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9")]
        classes += [len(text) - sum(map(len, words)), sum(c in ".,;:!?" for c in text), sum(c in "#*$%&|<>" for c in text)]
        classes.append(len(text) - sum(classes))
        counts = Counter(w.lower() if w == w.capitalize() else w for w in words)
        commons = [sum(n for w, n in Counter(words).items() if w in (c, c.capitalize())) for c in quality.COMMON_WORDS]
        assert counts
        commons.append(len(words) - sum(commons))
        return [x / len(text) for x in classes], [x / len(words) for x in commons]

    def distance(p, q):
        part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
        return math.sqrt(max(0.0, sum(part(x, (x + y) / 2) + part(y, (x + y) / 2) for x, y in zip(p, q)) / 2))

    own = {d: shares(t) for d, (_, t) in text_of.items() if brute.SPACED.search(t)}
    by_lang = {}
    for d, (lang, t) in text_of.items():
        if len(brute.SPACED.findall(t)) >= 100:
            by_lang.setdefault(lang, []).append(own[d])
    refs = {lang: [np.mean([o[k] for o in some], axis=0).tolist() for k in (0, 1)] for lang, some in by_lang.items()}
    judged = 0
    for r in quality.apply_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        lang, text = text_of[r["doc_id"]]
        if lang not in refs or r["doc_id"] not in own:
            continue
        (classes, commons), (ref_classes, ref_words) = own[r["doc_id"]], refs[lang]
        c, w = distance(classes, ref_classes), distance(commons, ref_words)
        s = distance([classes[5], 1 - classes[5]], [ref_classes[5], 1 - ref_classes[5]])
        assert (r["class_distance"], r["word_distance"], r["symbol_distance"]) == (pytest.approx(c, abs=1e-6), pytest.approx(w, abs=1e-6), pytest.approx(s, abs=1e-6))
        slack = 0.8 / math.sqrt(r["word_chars"])
        far = r["word_chars"] >= 300 and (c > 0.2 + slack or (s > 0.13 + slack / 4 and classes[5] > ref_classes[5])) or r["n_words"] >= 100 and w > 0.6
        assert r["kept"] == (not r["base_failed"] and not far), r["doc_id"]
        judged += 1
    assert judged > 100


def test_op1_words_of_a_large_block_need_power_tables_of_a_slice_only():
    data = np.frombuffer(b"ab cde f " * 300_000, dtype=np.uint8)
    starts, ends, _ = text.word_spans(data, np.array([0, len(data)]), text.SPACED)
    before = len(text._power_tables(0)[0])
    got = lm.word_hashes(data, starts, ends)
    assert len(text._power_tables(0)[0]) <= max(before, text.SLICE_BYTES + 1)
    assert (got == text.span_hashes(data, starts, ends, lm.VALUES)).all()


def test_op9_mask_bits_are_a_byte_each():
    masks = np.array([[1, 0], [1 << 63, 1], [0, 5 << 61]], dtype=np.uint64)
    bits = repeats.mask_bits(masks)
    assert bits.shape == (3, 128) and bits.nbytes == 3 * 128 and repeats.mask_bits(masks[:0]).shape == (0, 128)
    assert [tuple(x) for x in np.argwhere(bits)] == [(0, 0), (1, 63), (1, 64), (2, 125), (2, 127)]


def _peak(work):
    """What `work` returns, and the most bytes that it held at once."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_op9_runs_are_compared_by_stretches_of_whole_anchors():
    rng = np.random.default_rng(5)
    family = [rng.integers(97, 123, 140, dtype=np.uint8).tobytes() for _ in range(6000)]
    body = b"".join(f[k : k + 134] for f in family for k in range(3))
    n = 3 * len(family)
    anchors, sizes, at = np.repeat(np.arange(len(family), dtype=np.uint64), 3), np.full(n, 35), np.arange(n) * 134
    doc, start = rng.permutation(n), np.tile(np.arange(3), len(family))
    whole, most = _peak(lambda: repeats.first_places(anchors, body, at, sizes, doc, start, 1 << 30))
    parts, least = _peak(lambda: repeats.first_places(anchors, body, at, sizes, doc, start))
    assert (whole == parts).all() and whole.any(axis=1).sum() > n // 2
    assert least < most / 3 and least < 24 * len(body)
    assert repeats.first_places(anchors[:0], b"", at[:0], sizes[:0], doc[:0], start[:0]).shape == (0, 2)


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 18])
def test_op9_characters_stay_unless_all_their_bytes_go(piece):
    rng = np.random.default_rng(6)
    texts = ["", "aé", "日本語 x", "", "🙂🙂", "plain", ""]
    data, offsets = flat_bytes(pa.array(texts))
    for _ in range(50):
        removed = rng.random(len(data)) < 0.6
        kept, sizes, lengths = repeats.kept_characters(data, offsets, removed, piece)
        for text_, a, b, n, letters in zip(texts, offsets, offsets[1:], sizes, lengths):
            cuts = np.cumsum([0] + [len(c.encode()) for c in text_])
            want = "".join(c for c, i, j in zip(text_, cuts, cuts[1:]) if not removed[a + i : a + j].all())
            assert data[a:b][kept[a:b]].tobytes().decode() == want and (n, letters) == (len(want.encode()), len(want))


def test_op9_covered_bytes_of_whole_runs_masks_and_windows():
    rng = np.random.default_rng(7)
    start, size = np.sort(rng.choice(60_000, 9000, replace=False)), rng.integers(1, 70, 9000)
    bits = (rng.random((9000, 128)) < 0.01) & (np.arange(128) < size[:, None])
    whole, windows = rng.random(9000) < 0.05, rng.choice(60_000, 5)
    masks = np.packbits(bits[~whole], axis=1, bitorder="little").view(np.uint64)
    want = np.zeros(61_000, dtype=bool)
    for s, n, w, row in zip(start, size, whole, bits):
        for a, b in [(s, s + n + 99)] if w else [(s + k, s + k + 100) for k in np.flatnonzero(row)]:
            want[a:b] = True
    for s in windows:
        want[s : s + 100] = True
    assert (repeats.covered(61_000, start, size + 99, masks, whole, windows) == want).all()
    body, ends = repeats.spans_of(np.arange(61_000).astype(np.uint8), start, size, 1 << 10)
    assert (ends == np.concatenate(([0], np.cumsum(size)))).all() and all((body[a:b] == (np.arange(b - a) + s).astype(np.uint8)).all() for a, b, s in zip(ends, ends[1:], start))


def test_op5_new_stretches_are_searched_in_bounded_lots():
    search = pieces.StreamingViterbi(pieces.load_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    rng = np.random.default_rng(8)
    words = list({" " + "".join(rng.choice(list("etaoinshr"), rng.integers(2, 12))) for _ in range(60_000)})
    letters = sum(map(len, words))
    raw = [w.encode() for w in words]
    search.learn(raw)  # pairs are remembered
    (ids, cuts), peak = _peak(lambda: search.learn(raw))
    assert peak < 120 * letters
    for k in range(0, len(words), 997):
        one, _ = search.learn([raw[k]])
        assert ids[cuts[k] : cuts[k + 1]].tolist() == one.tolist()


def test_op3_crowded_regions_dealt_to_many_tasks(docs_of, spark):
    """Near copies, neither by their neighbours in the trees but by one of many members, are found however many tasks there are."""
    rnd = random.Random(17)
    word = lambda: f"w{rnd.randrange(10**6)}"
    rows = []
    for i in range(4):
        base = [word() for _ in range(200)]
        rows.append((1000 * i, " ".join(base)))
        for j in range(1, 40):
            own = list(base)
            for at in rnd.sample(range(200), 2 if j < 20 else 5):
                own[at] = word()
            rows.append((1000 * i + j, " ".join(own)))
    want = brute.near_duplicates(rows, 3, 85, 100)
    assert len({c for _, c, _ in want.values()}) < 30
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = by_id(neardup.near_duplicates(docs_of(rows), words=3, limit=(85, 100), reach=2), "n_shingles", "component_id", "kept")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
