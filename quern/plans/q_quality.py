"""Registered quality queries, and their oracles.

Documents are files, their sources directories; events are a commit log in which users
are paths, event types authors and hours commits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import lines as L
from quern.operators import quality as Q
from quern.sources import adapters as A

_COUNTS = ("size_bytes", "non_empty_lines", "non_empty_lines_default", "max_line_length", "ref_count", "max_todo_count_per_file")


def _metrics(spark, d):
    f = A.files(spark, d)
    m = L.line_metrics(f).select("path", "non_empty_lines", F.col("non_empty_lines").alias("non_empty_lines_default"), "max_line_length")
    own = f.select("path", "size_bytes", F.size(T.token_list(F.col("text"))).alias("ref_count"), F.regexp_count("text", F.lit("[!|]")).alias("max_todo_count_per_file"))
    return Q.long_metrics(m.join(own, "path"), *_COUNTS)


def _violations(spark, d):
    return Q.evaluate(_metrics(spark, d))


def _risks(spark, d):
    return Q.risk_scores(_metrics(spark, d), _violations(spark, d))


def rule_violations(spark, d):
    return _violations(spark, d)


def quality_summary(spark, d):
    v = _violations(spark, d)
    files = A.files(spark, d).select("path").join(v.groupBy("path").agg(F.count("*").alias("n")), "path", "left")
    return files.agg(F.count("*").alias("files"), F.count("n").alias("violating_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


def top_rules(spark, d):
    g = _violations(spark, d).groupBy("rule_id").agg(F.countDistinct("path").alias("files"), F.count("*").alias("violations"))
    return g.orderBy(F.desc("violations"), "rule_id").limit(5)


def top_metrics(spark, d):
    return _metrics(spark, d).groupBy("metric_id").agg(F.countDistinct("path").alias("files"), F.max("value").alias("max_value"))


def severity_breakdown(spark, d):
    return _violations(spark, d).groupBy("severity", "category").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


def _scopes(spark):
    rows = [(0, "^src1/", "max_line_length", 400), (1, r"^src1/.*\.de$", "max_line_length", 900), (2, r"\.fr$", "max_ref_count_per_file", 500)]
    return spark.createDataFrame(rows, "scope_idx int, pattern string, rule_id string, threshold long")


def policy_overlay(spark, d):
    return Q.evaluate_with_policy(_metrics(spark, d), Q.thresholds(spark), _scopes(spark))


def risk_score(spark, d):
    return _risks(spark, d).select("path", "violation_count", "severity", F.round("size", 6).alias("size"), F.round("score", 6).alias("score"))


def hotspots_dir(spark, d):
    out = Q.hotspots(_risks(spark, d), _violations(spark, d), T.parent(F.col("path")))
    return out.select("bucket_id", F.round("hotspot_score", 6).alias("hotspot_score"), "active", "hot_files", "worst")


def violations_query(spark, d):
    out = Q.violation_query(_violations(spark, d), _risks(spark, d), prefix="src", limit=25)
    return out.select("path", "violations", "rules", "worst_excess", F.round("score", 6).alias("score"))


def _log(spark, d):
    e = A.table(spark, d, "events")
    return e.select(F.col("user_id").alias("path"), F.date_trunc("hour", "ts").alias("commit"), F.col("event_type").alias("author"), F.floor("value").cast("long").alias("churn"))


def git_risk(spark, d):
    return Q.git_risk(_log(spark, d))


def test_risk(spark, d):
    """Odd documents of a source as tests of the even ones with the same number of tens."""
    f = A.table(spark, d, "documents").select("doc_id", "source", "lang")
    files = f.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.concat_ws("/", "lang", "source").alias("dir"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.floor(F.col("doc_id") / 40).cast("string"), F.lit("_test"))).otherwise(F.floor(F.col("doc_id") / 40).cast("string")).alias("stem"),
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise("default").alias("kind"),
    )
    return Q.nearby_tests(files, 2)


def signal_memory(spark, d):
    v = _violations(spark, d)
    key = F.sha2(F.concat_ws("|", "path", "rule_id"), 256)
    memory = v.where(F.col("actual") % 5 == 0).select(key.alias("signal_key"), F.lit("ignored").alias("decision"), F.lit(1).alias("at"))
    later = v.where(F.col("actual") % 10 == 0).select(key.alias("signal_key"), F.lit("useful").alias("decision"), F.lit(2).alias("at"))
    return Q.with_signals(v, memory.unionByName(later)).groupBy("decision", "rule_id").agg(F.count("*").alias("n"))


def snapshot_diff(spark, d):
    """Violations by directory and rule of even against odd documents."""
    v = _violations(spark, d).withColumn("even", F.regexp_extract("path", r"(\d+)\.", 1).cast("long") % 2 == 0)
    v = v.withColumn("dir", T.parent(F.col("path")))
    return Q.multiset_diff(v.where("even"), v.where("not even"), "dir", "rule_id")


def hotspot_delta(spark, d):
    r, v = _risks(spark, d), _violations(spark, d)
    even = F.regexp_extract("path", r"(\d+)\.", 1).cast("long") % 2 == 0
    hot = lambda c: Q.hotspots(r.where(c), v.where(c), T.parent(F.col("path")))
    out = Q.hotspot_delta(hot(even), hot(~even))
    return out.select("bucket_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("delta", 6).alias("delta"), "state")


def corpus_totals(spark, d):
    m = L.line_metrics(A.files(spark, d))
    return m.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.coalesce("non_empty_lines", F.lit(0))), F.lit(0)).alias("non_empty_lines"), F.max("max_line_length").alias("max_line_length"))


_LS = "CASE WHEN length(text) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') END"
_M = f"""base AS (SELECT path, size_bytes, len(list_filter(ls, lambda x: regexp_matches(x, '\\S'))) AS ne, list_max(list_transform(ls, lambda x: length(x))) AS ml,
  len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 2)) AS rc, length(text) - length(regexp_replace(text, '[!|]', '', 'g')) AS td
  FROM (SELECT *, {_LS} AS ls FROM files)),
m AS (SELECT path, unnest(['size_bytes', 'non_empty_lines', 'non_empty_lines_default', 'max_line_length', 'ref_count', 'max_todo_count_per_file']) AS metric_id,
  unnest([size_bytes, ne, ne, ml, rc, td]) AS value FROM base)"""
_R = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{m}', {t}, '{s}', '{c}')" for r, m, t, s, c in Q.RULES) + ") x(rule_id, metric_id, threshold, severity, category))"
_V = f"{A.FILES}, {_M}, {_R}, v AS (SELECT path, rule_id, value AS actual, CAST(threshold AS BIGINT) AS threshold, severity, category FROM m JOIN rules USING (metric_id) WHERE value > threshold)"
_RISK = f"""{_V}, vs AS (SELECT path, CAST(count(*) AS DOUBLE) AS violation_count, sum(CASE severity WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 WHEN 'high' THEN 4.0 ELSE 8.0 END)::DOUBLE AS severity, count(*) AS active FROM v GROUP BY path),
risk AS (SELECT b.path, coalesce(violation_count, 0.0) AS violation_count, coalesce(severity, 0.0) AS severity, ne / 100.0::DOUBLE AS size, coalesce(active, 0) AS active,
  coalesce(violation_count, 0.0) + coalesce(severity, 0.0) + ne / 100.0::DOUBLE AS score FROM base b LEFT JOIN vs USING (path))"""


def _hot(where: str) -> str:
    return f"""SELECT bucket_id, sum(CASE WHEN r <= 5 THEN score END) + count(*) FILTER (active > 0) AS hotspot_score, CAST(sum(active) AS BIGINT) AS active,
  count(*) FILTER (active > 0) AS hot_files, arg_max(path, (score, path)) AS worst FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS bucket_id,
  row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY score DESC, path) AS r FROM risk WHERE {where}) GROUP BY bucket_id"""


_EVEN = "CAST(regexp_extract(path, '(\\d+)\\.', 1) AS BIGINT) % 2"
QUERIES = {f.__name__: f for f in (
    rule_violations, quality_summary, top_rules, top_metrics, severity_breakdown, policy_overlay, risk_score, hotspots_dir, violations_query,
    git_risk, test_risk, signal_memory, snapshot_diff, hotspot_delta, corpus_totals,
)}

ORACLES = {
    "rule_violations": f"WITH {_V} SELECT * FROM v",
    "quality_summary": f"WITH {_V} SELECT (SELECT count(*) FROM files) AS files, count(DISTINCT path) AS violating_files, count(*) AS violations FROM v",
    "top_rules": f"WITH {_V} SELECT rule_id, count(DISTINCT path) AS files, count(*) AS violations FROM v GROUP BY rule_id ORDER BY violations DESC, rule_id LIMIT 5",
    "top_metrics": f"WITH {A.FILES}, {_M} SELECT metric_id, count(DISTINCT path) AS files, max(value) AS max_value FROM m GROUP BY metric_id",
    "severity_breakdown": f"WITH {_V} SELECT severity, category, count(*) AS n, count(DISTINCT path) AS files FROM v GROUP BY severity, category",
    "policy_overlay": f"""WITH {A.FILES}, {_M}, {_R}, j AS (SELECT path, rule_id, value AS actual, severity, category, CASE
    WHEN rule_id = 'max_line_length' AND regexp_matches(path, '^src1/.*\\.de$') THEN 900 WHEN rule_id = 'max_line_length' AND starts_with(path, 'src1/') THEN 400
    WHEN rule_id = 'max_ref_count_per_file' AND path LIKE '%.fr' THEN 500 ELSE threshold END::BIGINT AS threshold FROM m JOIN rules USING (metric_id)) SELECT * FROM j WHERE actual > threshold""",
    "risk_score": f"WITH {_RISK} SELECT path, violation_count, severity, round(size, 6) AS size, round(score, 6) AS score FROM risk",
    "hotspots_dir": f"WITH {_RISK} SELECT bucket_id, round(hotspot_score, 6) AS hotspot_score, active, hot_files, worst FROM ({_hot('true')})",
    "violations_query": f"""WITH {_RISK}, h AS (SELECT path, count(*) AS violations, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules, max(actual - threshold) AS worst_excess FROM v GROUP BY path)
SELECT path, violations, rules, worst_excess, round(score, 6) AS score FROM h JOIN risk USING (path) ORDER BY risk.score DESC, path LIMIT 25""",
    "git_risk": """WITH log AS (SELECT user_id AS path, date_trunc('hour', ts) AS c, event_type AS a, CAST(floor(value) AS BIGINT) AS churn FROM events),
t AS (SELECT path, max(n) AS most FROM (SELECT path, a, count(*) AS n FROM log GROUP BY path, a) GROUP BY path),
p AS (SELECT DISTINCT path, c FROM log), n AS (SELECT x.path, count(DISTINCT y.path) AS k FROM p x JOIN p y ON x.c = y.c AND x.path <> y.path GROUP BY x.path),
b AS (SELECT path, count(DISTINCT c) AS commits, count(DISTINCT a) AS authors, sum(churn)::BIGINT AS churn FROM log GROUP BY path)
SELECT path, commits AS git_recent_commit_count, authors AS git_recent_author_count, churn AS git_recent_churn_lines, coalesce(k, 0) AS git_cochange_neighbor_count,
  CASE WHEN commits >= 3 THEN most * 10000 // commits ELSE 0 END AS git_primary_author_share_bps FROM b JOIN t USING (path) LEFT JOIN n USING (path)""",
    "test_risk": """WITH f AS (SELECT source || '/' || doc_id AS path, lang, source, doc_id // 40 AS k, doc_id % 3 = 0 AS tst FROM documents)
SELECT a.path, count(b.path) AS nearby_tests FROM f a LEFT JOIN f b ON b.tst AND a.k = b.k AND 4 - 2 * ((a.lang = b.lang)::INT + (a.source = b.source)::INT) <= 2 WHERE NOT a.tst GROUP BY a.path""",
    "signal_memory": f"""WITH {_V} SELECT CASE WHEN actual % 10 = 0 THEN 'useful' WHEN actual % 5 = 0 THEN 'ignored' ELSE 'new' END AS decision, rule_id, count(*) AS n FROM v GROUP BY ALL""",
    "snapshot_diff": f"""WITH {_V}, d AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, rule_id, sum(CASE WHEN {_EVEN} = 0 THEN -1 ELSE 1 END)::BIGINT AS d FROM v GROUP BY ALL)
SELECT dir, rule_id, greatest(d, 0) AS new, greatest(-d, 0) AS resolved FROM d WHERE d <> 0""",
    "hotspot_delta": f"""WITH {_RISK}, b AS ({_hot(_EVEN + ' = 0')}), c AS ({_hot(_EVEN + ' = 1')})
SELECT coalesce(b.bucket_id, c.bucket_id) AS bucket_id, round(b.hotspot_score, 6) AS before, round(c.hotspot_score, 6) AS after,
  round(coalesce(c.hotspot_score, 0) - coalesce(b.hotspot_score, 0), 6) AS delta,
  CASE WHEN b.bucket_id IS NULL THEN 'new' WHEN c.bucket_id IS NULL THEN 'gone' WHEN c.hotspot_score > b.hotspot_score THEN 'regressed' ELSE 'kept' END AS state
FROM b FULL JOIN c ON b.bucket_id = c.bucket_id""",
    "corpus_totals": f"WITH {A.FILES}, {_M} SELECT count(*) AS files, CAST(sum(ne) AS BIGINT) AS non_empty_lines, max(ml) AS max_line_length FROM base",
}
