"""The pipeline against plain versions of its stages, each on its own input."""

import public_tokenizers

import brute
import corpus_pipeline
from gradeframe.llm import classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_the_whole_small_table(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}"))
        docs = seen[name][1]
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before, after = seen["quality"]
    model = classifier.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in classifier.score_documents(before, model).filter("predicted = 1").collect()}
    assert after.columns == COLUMNS and {d for d, _ in rows(after)} == good
    before, after = seen["near_dedup"]
    assert after.columns == COLUMNS and {d for d, _ in rows(after)} == {d for d, v in brute.near_duplicates(rows(before), 5, 4, 5).items() if v[2]}
    before, after = seen["repeats"]
    gone = brute.removed(rows(before))
    assert after.columns == COLUMNS and dict(rows(after)) == {d: brute.cut(t, gone[d]) for d, t in rows(before)}
    assert after.filter("n_chars <> length(text)").isEmpty()
    before, after = seen["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert after.columns == COLUMNS and {d for d, _ in rows(after)} == {d for d, v in brute.contamination(rows(before), items).items() if not v[4]}
    before, after = seen["pieces"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["n_pieces"] for r in after.collect()} == {d: len(library.encode(t, num_threads=1)) if t else 0 for d, t in rows(before)}
    assert after.filter("NOT round_trip").isEmpty()


def test_edges_pass_through(spark, sf, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "some words " * 20), (3, "some words " * 20), (None, "other words of a text " * 9), (4, "x" * 9000)])
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
    assert docs.columns[:2] == ["doc_id", "n_pieces"]
    empty = docs_of([]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, sf), f"test-{name}")
    assert empty.count() == 0
