"""Queries of the corpus operators over the standard tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, fingerprints, mixing, packing, quality, simhash, token_counts, toxicity, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"), min_bytes=0)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    takes = mixing.mix(table(spark, sf_dir, "documents")).takes
    return takes.select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train_model(docs, table(spark, sf_dir, "labels")))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)), ",")
    return views.withColumn("spans", spans)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edits(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), simhash.EXACT).select("doc_id", "fingerprint", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_warc, op2_mix, op3_exact_dedup, op4_token_counts, op5_packing, op6_toxicity, op7_quality, op8_chat,
              op9_fingerprints, op10_simhash, pipeline)
}

_BASE32 = """
array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(16 * CAST(substr(bits, CAST(5 * j + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * j + 2 AS INT), 1) AS INT)
  + 4 * CAST(substr(bits, CAST(5 * j + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * j + 4 AS INT), 1) AS INT)
  + CAST(substr(bits, CAST(5 * j + 5 AS INT), 1) AS INT) AS INT), 1)), '')"""

ORACLE_SQL = {
    "op1_warc": f"""
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, html, array_to_string(list_transform(range(1, 41), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
    [CAST(instr('0123456789abcdef', substr(hex, CAST(i AS INT), 1)) AS INT)]), '') AS bits,
    max(page_id) OVER (PARTITION BY html) AS winner
  FROM hashed
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to
FROM bits""",
    "op3_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
    "op8_chat": r"""
WITH lines AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(nullif(role, ''), 'unknown') AS speaker, coalesce(text, '') AS raw,
    regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS text,
    regexp_replace(replace(replace(replace(coalesce(nullif(role, ''), 'unknown'), '\', '\\'), chr(10), '\n'), chr(13), '\r'),
      '<(\\*)\|', '<\1\\|', 'g') AS name,
    CAST(floor(turn / 512.0) AS BIGINT) AS part, 1 AS place, row_number() OVER () AS rid
  FROM conversations
), scenes AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, raw, rid) AS nth FROM lines WHERE speaker = 'system'
), said AS (
  SELECT conv_id, turn, speaker, raw, text, name, part, place, rid FROM lines
  UNION ALL
  SELECT s.conv_id, s.turn, s.speaker, s.raw, s.text, s.name, p.part, 0, s.rid
  FROM scenes s JOIN (SELECT DISTINCT conv_id, part FROM lines) p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.part <> p.part
  WHERE s.nth = 1
), people AS (
  SELECT DISTINCT conv_id, part, speaker AS assistant FROM lines WHERE speaker <> 'system'
), shown AS (
  SELECT s.conv_id, p.assistant, s.part, s.turn, s.speaker, s.raw, s.place, s.rid, s.speaker = p.assistant AS own,
    CASE WHEN s.speaker = p.assistant THEN '<|im_start|>assistant' || chr(10)
      WHEN s.speaker = 'system' THEN '<|im_start|>system' || chr(10)
      ELSE '<|im_start|>user name=' || s.name || chr(10) END AS head,
    s.text || '<|im_end|>' AS body
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.part = p.part
), placed AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, assistant, part ORDER BY place, turn, speaker, raw, rid
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM shown
)
SELECT conv_id, assistant, part, count(*) AS n_messages, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_assistant,
  string_agg(head || body || chr(10), '' ORDER BY place, turn, speaker, raw, rid) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(start AS BIGINT) || '-' || CAST(start + length(body) AS BIGINT) END, ','
    ORDER BY place, turn, speaker, raw, rid), '') AS spans
FROM placed GROUP BY conv_id, assistant, part""",
}
