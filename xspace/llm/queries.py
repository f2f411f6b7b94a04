"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import language, lm, pieces, prefix_bpe, rules
from .common import learnable, table
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .jaccard_join import jaccard_groups
from .packing import pack
from .pii import pseudonymise
from .quality import quality_rules
from .resampling import resample
from .substring_dedup import substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


# A key for tests and benchmarks; production jobs pass their own secret.
PII_KEY = "example key"


@query
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, PII_KEY, counts=True)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLES["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(ws[i : i + 12], ' ') AS key
  FROM w, unnest(generate_series(1, len(ws)::BIGINT - 12)) AS u(i)
), first AS (SELECT key, min(doc_id) AS a FROM windows GROUP BY key),
hit AS (SELECT DISTINCT doc_id, start + o AS pos FROM windows JOIN first USING (key),
        unnest(generate_series(0, 12)) AS u(o) WHERE doc_id > a),
gone AS (SELECT doc_id, list(pos) AS cut FROM hit GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
         array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(cut, i), false)), ' ') AS text
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(text) AS kept_sha256 FROM kept
"""


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


ORACLES["op5_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS k
  FROM w, unnest(generate_series(1, greatest(1, len(ws)::BIGINT - 4))) AS u(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, model)
    decoded = pieces.decode(encoded, model)
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        "piece_ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score_words(docs, lm.train_words(docs))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         min(doc_id) OVER (PARTITION BY t) AS first
  FROM texts
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask,
         count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM words LEFT JOIN marks USING (doc_id) GROUP BY ALL
), f AS (SELECT i, chr(65 + i::INT) AS letter FROM range(5) AS r(i)),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o, a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, o[step] AS filter, (1 << o[step]::INT) AS bit,
         list_sum([0] || list_transform(o[1 : step - 1], lambda x: 1 << x::INT))::INT AS before
  FROM orders, range(1, 6) AS s(step)
), counted AS (
  SELECT part, filter_order, step, filter,
         coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""


@query
def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = prefix_bpe.encode(docs, ranks, pattern).drop("text")
    return prefix_bpe.digests(prefix_bpe.decode(encoded, ranks, pattern))


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op13_importance_resampling"] = r"""
WITH bits AS (
  SELECT i, list_reduce([i] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
  FROM range(256) AS r(i)
), crc_table AS (SELECT list(c ORDER BY i) AS crc FROM bits),
texts AS (
  SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), words AS (
  SELECT kind, doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM texts
), word AS (SELECT DISTINCT unnest(ws) AS w FROM words),
hashed AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(encode(w)) + 1),
              lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT),
            lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295) AS code
  FROM word, crc_table
), uses AS (
  SELECT kind, code % 10000 AS bucket, count(*) AS n
  FROM (SELECT kind, unnest(ws) AS w FROM words) JOIN hashed USING (w) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (kind = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 1), 0)::BIGINT AS t FROM uses
), gain AS (
  SELECT bucket, floor(1000 * ln((b + 1)::DOUBLE * (any_value(s) + 10000) / ((a + 1)::DOUBLE * (any_value(t) + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::BIGINT AS a, coalesce(sum(n) FILTER (kind = 1), 0)::BIGINT AS b
        FROM uses GROUP BY bucket), totals GROUP BY bucket, a, b
), numbered AS (SELECT row_number() OVER () AS r, doc_id, ws FROM words WHERE kind = 0),
means AS (
  SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM (SELECT r, unnest(ws) AS w FROM numbered) JOIN hashed USING (w) JOIN gain ON bucket = code % 10000 GROUP BY r
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296)))::BIGINT AS score
  FROM numbered LEFT JOIN means USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM placed
"""
