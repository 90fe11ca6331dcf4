"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecquill.llm import decontamination, minhash, packing, quality_model, quality_rules, sharding, substring_dedup, token_counts, toxicity, warc
from vecquill.llm.shared import read

VOCABULARY = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), with_text=False)
    return kept.select("__row.doc_id", "n_words", "n_removed", "kept_sha256")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_with_trees(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_quality(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_warc, op3_substring_dedup, op4_quality, op5_token_counts, op6_packing, op7_sharding, op8_decontamination, op9_quality_rules, op10_minhash)}


#: Base 32 of a SHA-1 in eight groups of five hexadecimal digits, four characters each.
_DIGEST = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5)) AS INTEGER) // [32768, 1024, 32, 1][i % 4 + 1] % 32 + 1, 1)), '')"""

OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(NULL AS VARCHAR) AS error, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(0, len(w) - 12)) AS s, unnest(list_transform(range(0, len(w) - 12), lambda i: md5(array_to_string(w[i + 1 : i + 13], ' ')))) AS g FROM w WHERE len(w) >= 13),
f AS (SELECT g, min(doc_id) AS first FROM x GROUP BY g),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM x JOIN f USING (g), range(0, 13) t(o) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM w)
SELECT d.doc_id, count(word) AS n_words, count(gone.p) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
GROUP BY d.doc_id"""


#: Every window that starts at a shingle it shares with an item; the index may lose none at a similarity of 0.8.
OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i AS MATERIALIZED (SELECT item_id, len(w) AS n, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m, unnest(list_transform(range(0, len(w) - least(len(w), 5) + 1), lambda j: array_to_string(w[j + 1 : j + least(len(w), 5)], ' '))) AS g FROM x WHERE len(w) > 0),
c AS MATERIALIZED (SELECT item_id, n, k, m, g, count(*) AS times FROM i GROUP BY ALL),
s AS MATERIALIZED (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS at, len(w) - k + 1 AS total, unnest(list_transform(range(0, len(w) - k + 1), lambda j: array_to_string(w[j + 1 : j + k], ' '))) AS g FROM w, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
h AS MATERIALIZED (SELECT s.doc_id, c.item_id, c.n, c.m, s.at, s.total, c.g, c.times FROM s JOIN c USING (k, g)),
t AS (SELECT a.doc_id, a.item_id, a.n, a.m, a.at AS start, a.total, b.g, least(count(*), any_value(b.times)) AS shared FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.at >= a.at AND b.at < a.at + a.m GROUP BY a.doc_id, a.item_id, a.n, a.m, a.at, a.total, b.g),
j AS (SELECT doc_id, item_id, n, start, sum(shared) AS shared, least(m, any_value(total) - start) + m - sum(shared) AS whole FROM t GROUP BY doc_id, item_id, n, m, start)
SELECT doc_id, item_id, arg_min(start, (-shared / whole, start, n)) AS start, arg_min(n, (-shared / whole, start, n)) AS n_words, round(max(shared / whole), 9) AS similarity
FROM j WHERE 100 * shared >= 80 * whole GROUP BY doc_id, item_id"""

#: All pairs that share a shingle, and the components of those that are links.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT DISTINCT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""


#: CRC-32 by its table, the jump by its recurrence in 128-bit integers; slots by the top eight bits of a product of the key.
OP7_SQL = """
WITH RECURSIVE t AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
c AS MATERIALIZED (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, t),
j AS (SELECT doc_id, n, CAST(doc_id AS HUGEINT) AS key, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (24), (25)) v(n)
  UNION ALL SELECT doc_id, n, key, b, CAST(floor((b + 1) * (2147483648.0::DOUBLE / CAST(key // 8589934592 + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT doc_id, n, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key, j AS b FROM j WHERE j < n)),
s AS (SELECT doc_id, max(b) FILTER (WHERE n = 24 AND j >= 24) AS shard, max(b) FILTER (WHERE n = 25 AND j >= 25) AS grown FROM j GROUP BY doc_id)
SELECT c.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY (CAST(c.doc_id AS HUGEINT) * 11400714819323198485 % 18446744073709551616) // 72057594037927936, c.doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM c JOIN s USING (doc_id)"""


#: The statistics, the votes, and sixty steps of expectation and maximisation over the counted vote patterns.
OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i : i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g), range(0, 5) r(o) WHERE times > 1 GROUP BY doc_id),
s AS MATERIALIZED (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) AS alpha, length(regexp_replace(t, '[^!?]', '', 'g')) AS bangs, length(regexp_replace(t, '[^.!?]', '', 'g')) AS stops, length(t) AS chars, len(lines) AS lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(list_distinct(w)) AS different, coalesce(h.n, 0) AS n_repeat_words FROM d LEFT JOIN h USING (doc_id)),
n AS (SELECT *, greatest(n_words, 1) AS w1, greatest(chars, 1) AS c1, greatest(lines, 1) AS l1 FROM s),
v AS MATERIALIZED (SELECT *, [
  CASE WHEN n_repeat_words / w1 > 0.12 THEN 0 WHEN n_repeat_words / w1 <= 0.05 THEN 1 ELSE -1 END, CASE WHEN n_symbols / w1 > 0.10 THEN 0 WHEN n_symbols / w1 <= 0.02 THEN 1 ELSE -1 END,
  CASE WHEN upper / greatest(alpha, 1) > 0.40 THEN 0 WHEN upper / greatest(alpha, 1) <= 0.15 THEN 1 ELSE -1 END, CASE WHEN word_chars / w1 < 2.0 OR word_chars / w1 > 14.0 THEN 0 WHEN word_chars / w1 >= 3.0 AND word_chars / w1 <= 9.0 THEN 1 ELSE -1 END,
  CASE WHEN bangs / w1 > 0.25 THEN 0 WHEN bangs / w1 <= 0.05 THEN 1 ELSE -1 END, CASE WHEN n_dup_lines / l1 > 0.35 THEN 0 WHEN n_dup_lines / l1 <= 0.10 THEN 1 ELSE -1 END,
  CASE WHEN different / w1 < 0.20 AND n_words < 2000 THEN 0 WHEN different / w1 >= 0.35 OR n_words > 400 THEN 1 ELSE -1 END, CASE WHEN stops = 0 AND n_words > 30 THEN 0 WHEN stops / w1 >= 0.02 THEN 1 ELSE -1 END,
  CASE WHEN n_symbols / c1 > 0.04 THEN 0 WHEN n_symbols / c1 <= 0.005 THEN 1 ELSE -1 END, CASE WHEN alpha / c1 < 0.66 THEN 0 WHEN alpha / c1 >= 0.74 THEN 1 ELSE -1 END] AS v FROM n),
p AS MATERIALIZED (SELECT list(v ORDER BY v) AS v, list(n ORDER BY v) AS n FROM (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY v)),
e AS (SELECT 0 AS step, v, n, list_transform(v, lambda x: greatest(0.02, least(0.98, (len(list_filter(x, lambda y: y = 1)) + 1) / (len(list_filter(x, lambda y: y = 1)) + 3 * len(list_filter(x, lambda y: y = 0)) + 2)))) AS q FROM p
  UNION ALL SELECT step + 1, v, n, list_transform(v, lambda x: 1 / (1 + exp(-greatest(-50.0, least(50.0, ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 11), lambda r: CASE x[r] WHEN 1 THEN ln(a1[r] / (1 - a0[r])) WHEN 0 THEN ln((1 - a1[r]) / a0[r]) ELSE 0.0 END))))))) AS q
  FROM (SELECT step, v, n, (list_sum(list_transform(range(1, len(n) + 1), lambda i: n[i] * q[i])) + 8) / (list_sum(n) + 10) AS prior,
    list_transform(range(1, 11), lambda r: greatest(0.6, least(0.999, (list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN v[i][r] = 1 THEN n[i] * q[i] ELSE 0.0 END)) + 9) / (list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN v[i][r] >= 0 THEN n[i] * q[i] ELSE 0.0 END)) + 10)))) AS a1,
    list_transform(range(1, 11), lambda r: greatest(0.15, least(0.999, (list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN v[i][r] = 0 THEN n[i] * (1 - q[i]) ELSE 0.0 END)) + 6) / (list_sum(list_transform(range(1, len(n) + 1), lambda i: CASE WHEN v[i][r] >= 0 THEN n[i] * (1 - q[i]) ELSE 0.0 END)) + 10)))) AS a0 FROM e WHERE step < 60)),
k AS (SELECT unnest(v) AS v, unnest(q) AS q FROM e WHERE step = 60)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND q >= 0.5 AS kept
FROM v JOIN k USING (v)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op7_sharding": OP7_SQL, "op8_decontamination": OP8_SQL, "op9_quality_rules": OP9_SQL, "op10_minhash": OP10_SQL}
