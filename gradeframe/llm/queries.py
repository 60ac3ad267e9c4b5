"""The registered queries of the numbered operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradeframe.llm import centroids, classifier, decontaminate, lm, neardup, pieces, quality, repeats, resample, tokenfile, tokens, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster whose executors don't have that folder gets the package by
    `--py-files`, as any other.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), order=3)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, limit=(85, 100))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_pieces", "ids_crc32", "round_trip")


URL_RULES = [
    urls.host_rule("com", "/", "allow"), urls.host_rule("example.com", "/en/", "block"), urls.host_rule("www.example.com", "/en/", "allow"),
    urls.host_rule("net", "/es/", "block"), urls.host_rule("net", "/fr/", "block"),
]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op6_url_filter"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(CASE WHEN contains(rest, '/') THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS r(rule_host, rule_path, rule_verdict)),
fit AS (
  SELECT p.page_id, p.host, p.path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM parts p LEFT JOIN rules ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fit WHERE n = 1
"""


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score_documents(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op11_warc"] = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM firsts
"""


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256.0, seed=2)


def _centroid_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """The rounds one after the other, on integers as they are."""
    steps = [f"""vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY name, v) - 1 AS cluster, v AS c FROM (
    SELECT sha256('{seed}:' || vec_id) AS name, v FROM vectors ORDER BY name, v LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, v, near.cluster AS cluster, near.distance AS distance FROM (
    SELECT vec_id, v, min(struct_pack(distance := CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), cluster := cluster)) AS near
    FROM vectors, c{r} GROUP BY vec_id, v))""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster AS cluster, coalesce(moved.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
      SELECT cluster, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) AS places(j) GROUP BY cluster, j) GROUP BY cluster) AS moved
  ON c{r}.cluster = moved.cluster)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a{rounds}.cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY a{rounds}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.cluster = c{rounds}.cluster
"""


ORACLES["op12_centroids"] = _centroid_sql(40, 5, 64, 256, 2)


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, longest=1, buckets=10_000, min_words=20, seed=2024)


ORACLES["op13_importance_resampling"] = r"""
WITH crc_table AS (
  SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS bytes(b)),
doc_words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents),
item_words AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM doc_words UNION SELECT w FROM item_words)),
buckets AS (
  SELECT w, xor(list_reduce([4294967295] || list_transform(range(1, len(h) + 1, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
                            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 10000 AS bucket FROM words, crc_table),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM item_words JOIN buckets USING (w) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000)
         / ((CAST(s AS DOUBLE) + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM doc_words JOIN buckets USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM places) THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)
"""
