"""Registered queries of the text operators, each over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm import (
    alignment, conversation, decontaminate, fingerprints, langid, near_dedup, packing, piece_bpe, quality, secret_scan, token_files, viterbi, warc,
)
from gradeframe.llm.shared import held_out
from gradeframe.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _sql_secrets() -> str:
    """The spans of every rule from the matches and the pieces between them, whole texts."""
    rules = ", ".join(
        f"({n}, '{r.kind}', '{r.regex.replace(chr(39), chr(39) * 2)}', {r.least}, {r.group})" for n, r in enumerate(secret_scan.RULES)
    )
    counts = ", ".join(f"count(*) FILTER (no = {n}) AS n_{r.kind}" for n, r in enumerate(secret_scan.BASE_RULES))
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    base = len(secret_scan.BASE_RULES)
    return f"""
WITH rules(no, kind, re, least, grp) AS (VALUES {rules}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, no, kind, least, string_split_regex(t, re) AS p, regexp_extract_all(t, re, 0) AS f,
         CASE grp WHEN 2 THEN regexp_extract_all(t, re, 2) ELSE regexp_extract_all(t, re, 0) END AS g
  FROM d, rules WHERE no <> 2 AND regexp_matches(t, re)
  UNION ALL
  SELECT doc_id, no, kind, least, string_split_regex(t, '[0-9a-f]{{24,}}'), regexp_extract_all(t, '[0-9a-f]{{24,}}', 0), regexp_extract_all(t, '[0-9a-f]{{24,}}', 0)
  FROM d, rules WHERE no = 2 AND regexp_matches(t, '[0-9a-f]{{24,}}')),
e AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (
  SELECT doc_id, no, kind, length(f[i]) AS n, length(g[i]) >= least AS ok,
         list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS a FROM e),
h AS (
  SELECT doc_id, {counts},
         string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, no) AS spans,
         string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, no) FILTER (no < {base}) AS base
  FROM s WHERE ok GROUP BY doc_id)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN h USING (doc_id)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranking = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, ranking).withColumn("held_out", held_out(F.col("doc_id")))


@_query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


ORACLES["op3_secret_scan"] = _sql_secrets()


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = warc.write(warc.record_types(pages), warc.train_dictionary(pages))
    return warc.read(files, with_payload=False).drop("url")


@_query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


@_query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents")).drop("digest")


@_query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs)).withColumn("held_out", held_out(F.col("doc_id")))


@_query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@_query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return token_files.read(files).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation.damaged(table(spark, sf_dir, "conversations"))
    return conversation.with_digest(rows, conversation.report(rows))


@_query
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_text=True)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
