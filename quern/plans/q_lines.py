"""Registered queries over lines, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import lines as L
from quern.sources import adapters as A

_LINES = "CASE WHEN length(text) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') END"
_EXPLODED = f"""el AS (SELECT path, language, size_bytes, unnest(ls) AS line, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no
  FROM (SELECT path, language, size_bytes, {_LINES} AS ls FROM files))"""


def line_metrics(spark, d):
    return L.line_metrics(A.files(spark, d))


def file_kind(spark, d):
    f = A.files(spark, d)
    return f.select("path", T.file_kind(F.col("path")).alias("kind"), T.language_of(F.col("path")).alias("inferred"), T.is_ignored(F.col("path")).alias("ignored"))


def token_estimate(spark, d):
    f = A.files(spark, d)
    return f.select("path", *[T.token_estimate(F.col("text"), p).alias(f"tokens_{p}") for p in T.TOKEN_PRESETS])


def security_smells(spark, d):
    # Prose has no language of its own rules; SQL glue and deserialisation apply to all.
    return L.security_smells(A.files(spark, d))


def sensitive_data(spark, d):
    return L.sensitive_data(A.files(spark, d))


def generated_lineage(spark, d):
    return L.generated_lineage(A.files(spark, d)).where("generated")


def file_snapshot(spark, d):
    """Source read: size, content hash, sample length, match key length of the first line."""
    f = A.files(spark, d)
    return f.select(
        "path",
        "size_bytes",
        F.sha2("text", 256).alias("sha256"),
        F.length("sample").cast("long").alias("sample_chars"),
        (F.col("size_bytes") > T.MAX_FILE_BYTES).alias("oversize"),
        T.symbol_tail(F.regexp_replace("path", "/", "::")).alias("tail"),
    )


_EST = """greatest(1, CAST(ceil(round(w / {0} + (p + c) * 0.55 + o / {1} + p * {2} + n * {3}, 6)) AS BIGINT))"""

QUERIES = {
    "line_metrics": line_metrics,
    "file_kind": file_kind,
    "token_estimate": token_estimate,
    "security_smells": security_smells,
    "sensitive_data": sensitive_data,
    "generated_lineage": generated_lineage,
    "file_snapshot": file_snapshot,
}

ORACLES = {
    "line_metrics": f"""WITH {A.FILES}, l AS (SELECT path, {_LINES} AS ls FROM files)
SELECT path, CAST(len(ls) AS BIGINT) AS total_lines,
  CAST(len(list_filter(ls, lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS non_empty_lines, CAST(0 AS BIGINT) AS import_count,
  CAST(coalesce(list_max(list_transform(ls, lambda x: length(x))), 0) AS BIGINT) AS max_line_length,
  CASE WHEN len(ls) > 0 THEN CAST(list_position(list_transform(ls, lambda x: length(x)), list_max(list_transform(ls, lambda x: length(x)))) AS BIGINT) END AS max_line,
  CAST(NULL AS BIGINT) AS import_first, CAST(NULL AS BIGINT) AS import_last FROM l""",
    "file_kind": f"""WITH {A.FILES} SELECT path, 'default' AS kind, 'text' AS inferred, false AS ignored FROM files""",
    "token_estimate": f"""WITH {A.FILES}, c AS (SELECT path, length(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g')) AS w,
  length(regexp_replace(text, '[^!-/:-@\\[-^`{{-~]', '', 'g')) AS p, length(regexp_replace(text, '[^\\x00-\\x08\\x0E-\\x1F\\x7F]', '', 'g')) AS c,
  length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS o, length(text) - length(replace(text, chr(10), '')) AS n FROM files)
SELECT path, {', '.join(_EST.format(*v) + f' AS tokens_{k}' for k, v in T.TOKEN_PRESETS.items())} FROM c""",
    "security_smells": f"""WITH {A.FILES}, {_EXPLODED}, s AS (
  SELECT path, line_no, 'raw_sql' AS kind, 'medium' AS confidence FROM el
  WHERE regexp_matches(lower(line), 'select |insert into|update |delete from') AND regexp_matches(line, 'format!\\(|f"|f''|\\$\\{{|%s| \\+ ')
  UNION ALL SELECT path, line_no, 'unsafe_deserialize', 'high' FROM el
  WHERE contains(line, 'pickle.load(') OR contains(line, 'pickle.loads(') OR (contains(line, 'yaml.load(') AND NOT contains(line, 'safe_load')))
SELECT path, kind, confidence, count(*) AS match_count, min(line_no) AS first_line FROM s GROUP BY ALL""",
    "sensitive_data": f"""WITH {A.FILES}, {_EXPLODED}, v AS (SELECT path, line_no, line,
    regexp_replace(regexp_replace(trim(string_split_regex(line, '[=:]')[2]), '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS value
  FROM el WHERE size_bytes <= 262144 AND regexp_matches(lower(line), 'password|secret|token|api_key|apikey'))
SELECT path, line_no, 'credential_assignment' AS kind, 'medium' AS confidence, 'medium' AS urgency,
  substr(value, 1, 4) || '…' || right(value, 4) AS excerpt FROM v
WHERE strlen(value) >= 12 AND NOT regexp_matches(lower(value || ' ' || line), 'placeholder|example|sample|dummy|fake|test')
  AND NOT regexp_matches(value, '\\*\\*\\*\\*|xxxx|<redacted>|REDACTED')""",
    "generated_lineage": f"""WITH {A.FILES}, g AS (SELECT path, lower(substr(text, 1, 2048)) AS head FROM files), m AS (
  SELECT path, head, regexp_matches(head, '@generated|do not edit|code generated|auto-generated|autogenerated') AS mark,
    regexp_matches('/' || lower(path), '/generated/|/gen/|\\.generated\\.|_generated\\.|\\.pb\\.|\\.min\\.js|/vendor/') AS named FROM g)
SELECT path, true AS generated, CASE WHEN mark THEN 'content_marker' ELSE 'path_marker' END AS reason,
  nullif(regexp_extract(head, '(?:generated (?:from|by)|source:)\\s+(\\S+)', 1), '') AS source_hint FROM m WHERE mark OR named""",
    "file_snapshot": f"""WITH {A.FILES} SELECT path, size_bytes, sha256(text) AS sha256, length(sample) AS sample_chars,
  size_bytes > 1048576 AS oversize, string_split(path, '/')[-1] AS tail FROM files""",
}
