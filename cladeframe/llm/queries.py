"""The queries opN_<name> and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, editcount, huffman, langid, lexical, orderminhash, pii, quality, resample, simhash, urlrules
from .common import stash

#: Vocabulary file of the queries; operators take any path.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# Action, host and path of the rules of op8.
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.line_quality(table(spark, sf_dir, "documents"))
    return judged.withColumn("cleaned_sha256", F.sha2(F.coalesce("cleaned", F.lit("")), 256)).drop("cleaned")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = huffman.write_tokens(table(spark, sf_dir, "documents"), BYTE_BPE)
    return huffman.read_tokens(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = editcount.sample_edits(F.col("text"))
    return editcount.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, edits)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_chats(stash(chat.format_chats(turns), "chats"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_docs(table(spark, sf_dir, "documents"), BYTE_BPE)
    return bpe.decode_ids(encoded, BYTE_BPE).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"), PIECES)


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_line_quality": op2_line_quality,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_chat": op5_chat,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_url_rules": op8_url_rules,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
    "op11_simhash": op11_simhash,
    "op12_resampling": op12_resampling,
    "op13_ranked_search": op13_ranked_search,
}

_QUOTED = {k: getattr(quality, k).replace("'", "''") for k in ("NAVIGATION", "BOILERPLATE", "NOISE", "SHOUT", "TERMINAL", "PUNCTUATION")}
OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (
  SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT g.k + j) AS n FROM g JOIN r USING (doc_id, g), range(0, 3) q(j) GROUP BY doc_id),
l AS (
  SELECT doc_id, j, x, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(0, len(string_split(t, chr(10))))) AS j FROM d)),
f AS (
  SELECT *, n > 0 AND (regexp_matches(x, '{_QUOTED["NAVIGATION"]}') OR regexp_matches(x, '{_QUOTED["BOILERPLATE"]}')
    OR (length(x) - length(regexp_replace(x, '{_QUOTED["NOISE"]}', '', 'g'))) * 100 > length(x) * 10
    OR len(regexp_extract_all(x, '{_QUOTED["SHOUT"]}')) * 100 > n * 30
    OR (n < 4 AND NOT regexp_matches(x, '{_QUOTED["TERMINAL"]}'))
    OR (n >= 30 AND NOT regexp_matches(x, '{_QUOTED["PUNCTUATION"]}'))) AS bad FROM l),
b AS (
  SELECT doc_id, count(*) FILTER (WHERE bad) AS n_bad, sum(n) FILTER (WHERE bad) AS lost,
    coalesce(string_agg(x, chr(10) ORDER BY j) FILTER (WHERE NOT bad), '') AS cleaned FROM f GROUP BY doc_id),
o AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(w) < 50 OR coalesce(c.n, 0) * 100 > len(w) * 50 AS base_failed, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(coalesce(n_bad, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(lost, 0) AS BIGINT) AS lost_words, sha256(cleaned) AS cleaned_sha256
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN b USING (doc_id))
SELECT *, NOT base_failed AND lost_words * 100 <= n_words * 50 AS kept FROM o
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
p AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.k, p.n, g.item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY doc_id),
m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

OP12_SQL = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
w AS (
  SELECT doc_id, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT doc_id, 's' AS side, text FROM documents UNION ALL SELECT NULL, 't', text FROM benchmark)),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM w)),
b AS (
  SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
    lambda a, y: xor(a >> 8, tab[1 + (xor(a, y) & 255)])), 4294967295) % 10000 AS bucket
  FROM h, crc),
n AS (
  SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t
  FROM w JOIN b USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE)
    / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
f AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM w JOIN b USING (w) JOIN g USING (bucket) WHERE side = 's' GROUP BY doc_id),
z AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN f USING (doc_id)),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS k FROM z WHERE n_features >= 20)
SELECT z.*, CAST(CASE WHEN r <= k THEN r END AS BIGINT) AS rank FROM z LEFT JOIN r USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
c AS (SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY doc_id, t),
q AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_all) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY t),
s AS (
  SELECT item_id, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM i JOIN p USING (t) JOIN q USING (t), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

SQL: dict[str, str] = {
    "op2_line_quality": OP2_SQL,
    "op5_chat": OP5_SQL,
    "op9_decontamination": OP9_SQL,
    "op12_resampling": OP12_SQL,
    "op13_ranked_search": OP13_SQL,
}
