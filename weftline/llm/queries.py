"""The subpackage's queries over the tables of a folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, katz, lang_id, line_dedup, near_dup, quality_knn, quality_rules, secrets, token_output
from ._session import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(documents(spark, sf_dir))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), BYTE_BPE).drop("ids")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(documents(spark, sf_dir), WORD_BPE)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return line_dedup.apply_bitmaps(documents(spark, sf_dir), then=lambda out: out.select("doc_id", "n_lines", "n_dropped", digest))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_benchmark_decontamination,
        op3_minhash_near_dedup,
        op4_quality_classifier,
        op5_secret_scan,
        op6_quality_rules,
        op7_bpe,
        op8_token_output,
        op9_line_dedup,
        op10_lm_scoring,
    )
}

#: SQL's scans of secrets, written from the contract and the kinds' definitions: pattern, value group, shortest match or value.
_SCANS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 1),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "blob": (r"[A-Za-z0-9+/]+", 0, 20),
    "user": (r"""(?i:user|username|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 0, 1),
    "endpoint": (r"""(?i:(?:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[a-z0-9_.@:/-]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9_.-]+)""", 0, 1),
}


def _scan_sql(scan: str) -> str:
    pattern, value, least = _SCANS[scan]
    quoted = "'" + pattern.replace("'", "''") + "'"
    return (
        f"SELECT doc_id, '{scan}' AS scan, hit, val, stop FROM (SELECT doc_id, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM ("
        f"SELECT doc_id, unnest(range(1, len(hits) + 1)) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS val FROM ("
        f"SELECT doc_id, regexp_extract_all(t, {quoted}) AS hits, regexp_extract_all(t, {quoted}, {value}) AS vals, string_split_regex(t, {quoted}) AS gaps FROM d))) WHERE length(val) >= {least}"
    )


_FOUND = " UNION ALL ".join(map(_scan_sql, _SCANS))


def _beside(kinds: str) -> str:
    """Whether another span of the kinds lies beside the span a, not over it, at most 160 code points off."""
    gap = "CASE WHEN b.stop <= a.start THEN a.start - b.stop WHEN b.start >= a.stop THEN b.start - a.stop END"
    return f"EXISTS (SELECT 1 FROM q b WHERE b.doc_id = a.doc_id AND b.kind IN ({kinds}) AND {gap} <= 160)"


_BASE = "'assign', 'access', 'hex'"

_WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE: dict[str, str] = {
    "op2_benchmark_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bs AS (SELECT DISTINCT item_id, list_slice(w, i, i + 4) AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
ds AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, k AS n_shared, k / n AS containment
FROM hit JOIN n USING (item_id) WHERE 100 * k >= 80 * n
""",
    "op3_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k2 FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k2 >= 85 * (a.n + b.n - k2)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT e.y, r.low FROM r JOIN e ON r.doc_id = e.x),
c AS (SELECT doc_id, min(low) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
""",
    "op5_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
q AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT doc_id, CASE WHEN scan = 'assign' AND length(val) < 12 THEN 'weak'
    WHEN scan = 'blob' THEN CASE WHEN regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]') THEN 'weak' END ELSE scan END AS kind, stop - length(hit) AS start, stop FROM f) WHERE kind IS NOT NULL),
m AS (SELECT *, {_beside("'assign', 'hex', 'weak'")} AS by_secret, {_beside("'access', 'user'")} AS by_name, {_beside("'endpoint'")} AS by_place,
    EXISTS (SELECT 1 FROM q b WHERE b.doc_id = a.doc_id AND b.kind IN ({_BASE}) AND b.start < a.stop AND b.stop > a.start) AS covered FROM q a),
k AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s, list_position(['assign', 'access', 'hex', 'weak', 'user', 'endpoint'], kind) AS rank FROM m
  WHERE kind IN ({_BASE}) OR (NOT covered AND CASE kind WHEN 'weak' THEN by_name OR by_place WHEN 'user' THEN by_secret ELSE by_secret AND by_name END)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
  string_agg(s, ',' ORDER BY start, rank, stop) FILTER (rank <= 3) AS base, string_agg(s, ',' ORDER BY start, rank, stop) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
""",
    "op9_line_dedup": """
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], E' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id < k.last AS dropped FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
}
