"""The queries of the numbered operators, each over its whole table, and their SQL where SQL can express them.

No SQL: op1 (the order within a source comes from Spark's hash), op2 (tokenizer), op3, op5 and op8 (trained models), op6
(permutation fill), op9 (CRC and samples' features). Their tests hold them against brute force, round trips or held-out
accuracy. The SQL of op7 and op10 compares all shingles and all strings, plainly; it's for tables of a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media, minhash_dedup, mixing, quality_fm, quality_rules, secrets_scan, sentencepiece_codec, sharding, suffix_dedup, toxicity
from .common import held_out, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    positions = F.col("takes.position")
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at(positions, F.lit(1)).alias("position"), positions.alias("positions"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digest(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("first_rule")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    return quality_fm.score(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))
    return sharding.assign(docs).select("doc_id", "slot", "shard", "n_bytes")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_scan.scan(docs, secrets_scan.fit(docs), ["doc_id"])


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_sentencepiece, op3_toxicity, op4_quality_rules, op5_quality_classifier, op6_sharding, op7_near_duplicates, op8_secret_scans, op9_media, op10_suffix_dedup)
}

_WORD = r"[^\x20\x09-\x0D]+"
ORACLE = {
    "op4_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, string_split(t, chr(10)) AS ls FROM d),
f AS (SELECT r, doc_id, len(ws) AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x))) AS upper_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS plain_words,
    len(ls) AS n_lines FROM w),
l AS (SELECT r, unnest(ls) AS line FROM w),
dup AS (SELECT r, sum(n - 1)::BIGINT AS n FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY 1, 2) GROUP BY r),
x AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, [word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS g FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g[5] IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM h, range(5) AS s(k) WHERE n > 1 GROUP BY r),
a AS (SELECT f.*, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM f LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 5 * n_symbols > n_words
        OR 2 * n_dup_lines > n_lines OR 10 * upper_words > 7 * n_words OR 10 * plain_words < 6 * n_words) AS kept
FROM b""",
    "op7_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT shared.a, shared.b FROM shared JOIN n AS x ON x.r = shared.a JOIN n AS y ON y.r = shared.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
t AS (SELECT r, r AS q FROM d UNION SELECT t.r, e.b FROM t JOIN e ON t.q = e.a),
m AS (SELECT t.r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.q GROUP BY t.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id IS NOT DISTINCT FROM m.component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op10_suffix_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800),
k AS (SELECT w.r, w.i, md5(substr(d.h, 2 * w.i + 1, 800)) AS k FROM w JOIN d USING (r)),
x AS (SELECT r, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 OR lag(i) OVER (PARTITION BY r ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM x),
u AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
s AS (SELECT r, run, min(i) AS lo, max(i) + 400 AS hi FROM u GROUP BY r, run),
p AS (SELECT r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY r ORDER BY lo) AS from_byte FROM s),
c AS (SELECT p.r, sum(p.hi - p.lo) AS n_removed, count(*) AS n_spans, max(p.hi) AS tail, string_agg(substr(d.h, 2 * from_byte + 1, 2 * (lo - from_byte)), '' ORDER BY lo) AS head FROM p JOIN d USING (r) GROUP BY p.r),
v AS (SELECT row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
q AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(list_transform(range(1, len(ws) - 49), lambda i: md5(array_to_string(ws[i:i + 50], ' ')))) AS g FROM v WHERE len(ws) >= 51)),
y AS (SELECT DISTINCT r FROM q WHERE g IN (SELECT g FROM q GROUP BY g HAVING count(*) > 1))
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(CASE WHEN c.r IS NULL THEN unhex(h) ELSE unhex(head || substr(h, 2 * tail + 1)) END) AS kept_sha256, y.r IS NOT NULL AS repeats_passage
FROM d LEFT JOIN c USING (r) LEFT JOIN y USING (r)""",
}
