"""The corpus pipeline: five stages over `documents`, each applied to what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run`
writes as Parquet to the shared folder and rereads as the next stage's `docs`.
All stages but the last return the columns of `documents`:

1. quality: the quadratic discriminant is fitted on the labelled documents and
   those it rejects go. Nothing else goes for a missing label.
2. near_dedup: of each group of near duplicates (five words, similarity of 0.8
   or more) the smallest doc_id stays.
3. repeats: bytes of 100-byte strings that also start earlier are cut out of the
   texts; n_chars follows. A document may become empty, but stays.
4. decontaminate: documents of which a 20th or more lies in 13-word passages of
   `benchmark` go.
5. pieces: the rest is encoded; per document its ids, how many, their checksum,
   and whether decoding gives the text back.

Null and empty texts are judged as texts without words, repeated rows of one
document end as one, an empty table passes through, and extra columns are kept
up to stage 4. A null doc_id sorts first; such rows only leave by their text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm import classifier, decontaminate, neardup, pieces, repeats
from gradeframe.llm.queries import reachable, table
from gradeframe.llm.text import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, words=5, limit=(4, 5))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("repeats", cut_repeats),
    ("decontaminate", clean_of_benchmark),
    ("pieces", encode),
]

#: Model fitting, near-duplicate components and byte-pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table."""
    reachable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_ORACLES: dict[str, str] = {}
