"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import scratch_path
from . import alignment, chat, crf, decontam, language, line_dedup, mixing, pii, quality_rules, secrets, simhash, warc, whitening
from .common import held_out, materialize, table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.personal_data(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, sf_dir, "pages"), path)
    found = warc.read_archive(spark, path).where(F.col("record_type").isin("response", "revisit"))
    whole = F.col("record_type") == "response"  # what a response says of its payload is computed again from what was read
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = crf.score(docs, crf.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs), digest_only=True)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.derived_calls(table(spark, sf_dir, "conversations"))
    tools = spark.createDataFrame(chat.TOOLS, "name string, param string, type string, required boolean")
    return chat.link_tool_calls(calls, results, tools).select("conv_id", "call_id", "level", "status", "message")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_rules.score(docs, model, row=F.struct("doc_id"))
    return scored.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.secrets(table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = materialize(alignment.linked(table(spark, sf_dir, "documents"), row=F.struct("doc_id")), "links")
    found = alignment.figures(linked, alignment.pair_counts(linked))
    return found.select("row.doc_id", *found.columns[1:])


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.whole_numbers(table(spark, sf_dir, "embeddings"), row=F.struct("vec_id"))
    found = whitening.whiten(x, whitening.fit(x))
    return found.select("row.vec_id", *found.columns[1:])


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs), row=F.struct("doc_id"))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_simhash, op3_warc, op4_line_crf, op5_line_dedup, op6_tool_calls, op7_decontamination, op8_quality_rules, op9_secrets, op10_mixing, op11_token_alignment, op12_whitening, op13_language_id)}


OP3_SQL = """
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
digests AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM bodies),
firsts AS (SELECT payload_digest, min(page_id) AS first_page FROM digests WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_page <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_page <> d.page_id THEN f.first_page END AS refers_to
FROM digests d LEFT JOIN firsts f ON d.payload_digest = f.payload_digest
"""
OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
flagged AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NULL OR k.doc_id = f.first_doc AS keep
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT keep) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keep), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

OP6_SQL = r"""
WITH RECURSIVE asked AS (
  SELECT DISTINCT conv_id, turn, 'call_' || conv_id || '_' || turn AS call_id, 'call_' || conv_id || '_' || (turn - 2) AS after,
         CASE (conv_id + turn) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'note' ELSE 'other' END AS name,
         regexp_extract(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS word, length(coalesce(text, '')) AS n
  FROM conversations WHERE role = 'assistant'),
answers AS (SELECT 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS result FROM conversations WHERE role = 'user'),
chain AS (
  SELECT call_id, 0 AS level FROM asked WHERE after NOT IN (SELECT call_id FROM asked)
  UNION ALL SELECT a.call_id, c.level + 1 FROM chain c JOIN asked a ON a.after = c.call_id),
judged AS (
  SELECT a.*, c.level, r.result,
         CASE WHEN name = 'other' THEN 'unknown_tool' WHEN n % 7 = 3 AND name <> 'note' THEN 'bad_arguments' WHEN r.call_id IS NULL THEN 'missing_result' ELSE 'ok' END AS status
  FROM asked a JOIN chain c ON a.call_id = c.call_id LEFT JOIN answers r ON a.call_id = r.call_id)
SELECT conv_id, call_id, cast(level AS bigint) AS level, status,
       '{"arguments":{"limit":' || CASE WHEN n % 7 = 3 THEN '"' || n || '"' ELSE CAST(n AS VARCHAR) END || ',"query":' || CAST(to_json(word) AS VARCHAR)
       || '},"call_id":"' || call_id || '","level":' || level || ',"name":"' || name || '"'
       || CASE WHEN result IS NULL THEN '' ELSE ',"result":' || CAST(to_json(result) AS VARCHAR) END || ',"status":"' || status || '"}' AS message
FROM judged
"""
OP7_SQL = r"""
WITH split_docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
split_items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
sized AS (SELECT item, w, least(len(w), 10) AS n FROM split_items WHERE len(w) > 0),
test AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM test),
train AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split_docs, lengths)),
hits AS (SELECT t.doc_id, t.n, t.i, b.item FROM train t JOIN test b ON t.n = b.n AND t.win = b.win),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(s.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, coalesce(s.n_hit, 0) > 0 AS contaminated
FROM split_docs d LEFT JOIN spots s ON d.doc_id = s.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_tool_calls": OP6_SQL, "op7_decontamination": OP7_SQL}
