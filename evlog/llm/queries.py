"""The operators' queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, linededup, lm, packing, simhash, substring, toolcalls, topk, warc
from .common import Work


#: The tokenizer's file; by default that of the public tokenizers beside Python's packages.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Work(spark, "op1").path
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).selectExpr("key AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    events = toolcalls.marked_events(messages).unionByName(toolcalls.turn_events(messages))
    return toolcalls.link(events, toolcalls.TURN_SCHEMAS).select("conv_id", "turn", "call_id", "name", "level", "status", "result_turn", "n_results", "valid", "json")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(_table(spark, sf_dir, "documents"))
    found = decontaminate.phrase_matches(index, _table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontaminate.hit_words())
    ids = F.concat_ws(",", F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.dedup_substrings(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP1_SQL = """
WITH digests AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS keeper FROM digests
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM ranked
"""

OP2_SQL = """
WITH calls AS (
  SELECT * FROM conversations WHERE role IN ('user', 'system') AND text IS NOT NULL
), results AS (
  SELECT * FROM conversations WHERE role = 'assistant' AND text IS NOT NULL
), firsts AS (
  SELECT conv_id FROM calls WHERE turn = 0
)
SELECT c.conv_id, c.turn, c.conv_id || ':' || c.turn AS call_id, CASE c.role WHEN 'user' THEN 'reply' ELSE 'instruct' END AS name,
  CAST(CASE WHEN c.turn > 0 AND f.conv_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS level,
  CASE WHEN r.conv_id IS NULL THEN 'unanswered' ELSE 'answered' END AS status, r.turn AS result_turn,
  CAST(CASE WHEN r.conv_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
  length(c.text) >= 1 AND (c.turn = 0 OR f.conv_id IS NOT NULL) AS valid,
  '{"arguments":{"text":' || CAST(to_json(c.text) AS VARCHAR) || '},"id":"' || c.conv_id || ':' || c.turn || '","name":"'
    || CASE c.role WHEN 'user' THEN 'reply' ELSE 'instruct' END || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
FROM calls c LEFT JOIN results r ON c.conv_id = r.conv_id AND r.turn = c.turn + 1 LEFT JOIN firsts f ON c.conv_id = f.conv_id
"""

OP3_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT dw.*, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM item_windows) s)
), hits AS (
  SELECT d.doc_id, d.i, d.n, w.item_id FROM doc_windows d JOIN item_windows w ON d.n = w.n AND d.win = w.win
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

OP7_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM docs)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM ranked WHERE nth > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM docs
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.place) AS text, count(*) AS n
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.place = g.place WHERE g.place IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.line, k.place, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP10_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """By name, for those that SQL can express."""
    return {name: globals()[f"{name.split('_')[0].upper()}_SQL"] for name in queries() if f"{name.split('_')[0].upper()}_SQL" in globals()}
