"""Registered queries over the code that documents play: facts, rules, snapshots and gates, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import facts as X
from quern.operators import graph as G
from quern.operators import quality as Q
from quern.operators import snapshot as S
from quern.plans import q_routes as R
from quern.plans.shared import once
from quern.sources import adapters as A
from quern.sources.sinks import materialize

#: The layers of the tree: (zone, pattern), and the directions that are allowed or forbidden between them.
ZONES = (("surface", r"^ui/|^app/api/"), ("logic", r"^app/services/|^app/validators/"), ("data", r"^app/crud/|^app/models/|^app/query/"))
ALLOWED = (("surface", "logic"), ("logic", "data"))
FORBIDDEN = (("data", "surface"),)
NEAR = 3
SUPPRESSED = (("security_smell_raw_sql", "^app/services/"), ("orphan_module", "^app/plain/"))
#: Rules of the tree: those of the engine, with limits that its small files reach.
LIMITS = {"max_non_empty_lines_default": 12, "max_line_length": 60, "max_import_count": 2, "max_symbol_count_per_file": 40, "max_ref_count_per_file": 60, "max_graph_edge_out_count": 30, "high_git_churn": 4, "max_size_bytes": 900, "max_module_dep_count_per_file": 6, "high_change_coupling": 20}


def _rules(spark):
    return spark.createDataFrame([(r, m, LIMITS.get(r, t), s, c) for r, m, t, s, c in Q.RULES], "rule_id string, metric_id string, threshold long, severity string, category string")


def _zones(files):
    zone = F.lit(None).cast("string")
    for name, pattern in ZONES:
        zone = F.when(F.rlike("path", F.lit(pattern)), name).otherwise(zone)
    return files.select("path", zone.alias("zone")).where("zone is not null")


def _log(spark, d, files):
    """Events as commits to the file whose document has the user's number."""
    e = A.table(spark, d, "events").join(files.select("doc_id", "path"), F.col("user_id") == F.col("doc_id"))
    return e.select("path", F.date_trunc("hour", "ts").alias("commit"), F.col("event_type").alias("author"), F.floor("value").cast("long").alias("churn"))


def _facts(spark, d):
    """``(code files, metrics)`` with every fact of the tree; clones are in :mod:`quern.plans.q_clones`."""
    return once(spark, d, "facts", lambda: _make_facts(spark, d))


def _make_facts(spark, d):
    tree, refs, symbols, deps = R._tree(spark, d)
    code = materialize(A.app_code(tree).drop("sample"))
    edges = R._direct(spark, d)
    direct = edges.where(F.col("kind").isin(*G.DIRECT_KINDS)).select("src", "dst").distinct()
    fans = materialize(G.fan_in_out(edges))
    pairs = lambda rows: spark.createDataFrame(list(rows), "src_zone string, dst_zone string")
    layers = G.layering(direct, _zones(code), pairs(ALLOWED), pairs(FORBIDDEN))
    mutual = direct.join(direct.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    cycles = mutual.select(F.col("src").alias("path")).distinct()  # two files that refer to each other
    exports = materialize(X.exported_lines(code))
    metrics = X.union(
        X.line_facts(code), X.index_facts(symbols, refs, deps), X.structure_facts(code, fans, direct, cycles), X.layer_facts(layers),
        X.history_facts(_log(spark, d, code)), X.smell_facts(code), X.dead_code_facts(exports, fans, symbols),
    )
    metrics = materialize(metrics)
    return code, materialize(metrics.unionByName(X.test_facts(code, exports, metrics, NEAR)))


def rule_facts(spark, d):
    return _facts(spark, d)[1]


def _found(spark, d):
    code, metrics = _facts(spark, d)
    return code, metrics, once(spark, d, "violations", lambda: materialize(Q.evaluate(metrics, _rules(spark))))


def fact_violations(spark, d):
    return _found(spark, d)[2]


def suppressed_violations(spark, d):
    s = spark.createDataFrame(list(SUPPRESSED), "rule_id string, pattern string")
    out = Q.suppress(_found(spark, d)[2], s)
    return out.groupBy("rule_id").agg(F.count_if(~F.col("suppressed")).alias("active"), F.count_if("suppressed").alias("suppressed"))


def quality_snapshot(spark, d):
    code, metrics, found = _found(spark, d)
    s = spark.createDataFrame(list(SUPPRESSED), "rule_id string, pattern string")
    out = S.snapshot(code, metrics, Q.suppress(found, s), _zones(code))
    return out.select("section", "key", "rank", "item", F.round("value", 4).alias("value"))


def _halves(found):
    """Violations of the files of even documents as a baseline, with limits as they were; those of two thirds as the candidate."""
    n = F.regexp_extract("path", r"part(\d+)", 1).cast("long")
    return found.where(n % 2 == 0), found.where(n % 3 != 0)


def quality_gate(spark, d):
    return S.gate(*_halves(_found(spark, d)[2]))


def gate_of_equals(spark, d):
    found = _found(spark, d)[2]
    return S.gate(found, found)


def directory_delta(spark, d):
    code, metrics, found = _found(spark, d)
    old, new = _halves(found)
    n = F.regexp_extract("path", r"part(\d+)", 1).cast("long")
    of = lambda c, v: S.buckets(S.file_rows(code.where(c), metrics.where(c), v)).where("aggregation = 'directory'")
    named = lambda v: v.withColumn("bucket_id", S.T.parent(F.col("path")))
    out = S.bucket_delta(of(n % 2 == 0, old), of(n % 3 != 0, new), named(old), named(new), "bucket_id")
    return out.withColumn("hotspot_delta", F.round("hotspot_delta", 4))


_EXPORT = """CASE language WHEN 'python' THEN starts_with(ltrim(t), 'def ') AND NOT starts_with(ltrim(t), 'def _') WHEN 'rust' THEN starts_with(ltrim(t), 'pub fn ') OR starts_with(ltrim(t), 'pub struct ')
  ELSE starts_with(ltrim(t), 'export function ') OR starts_with(ltrim(t), 'export class ') END"""
_KIND = "CASE WHEN contains(path, '/tests/') OR contains(path, '_test.') THEN 'test' ELSE 'default' END"
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{m}', {LIMITS.get(r, t)}, '{s}', '{c}')" for r, m, t, s, c in Q.RULES) + ") x(rule_id, metric_id, threshold, severity, category))"
_ZONE = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{z}'" for z, p in reversed(ZONES)) + " END"
_FACTS = f"""{A.APP}, {A.APP_CODE}, {R._EDGES}, di AS MATERIALIZED (SELECT DISTINCT src, dst FROM ed WHERE kind <> 'shared_dep'),
fan AS MATERIALIZED (SELECT path, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS path, 0 AS i, 1 AS o FROM di UNION ALL SELECT dst, 1, 0 FROM di) GROUP BY path),
bf AS (SELECT path, coalesce(strlen(rtrim(string_agg(t, chr(10) ORDER BY i), '')), 0) AS size_bytes, count(*) FILTER (regexp_matches(t, '\\S')) AS ne, max(length(t)) AS ml,
  count(*) FILTER (CASE language WHEN 'text' THEN false WHEN 'python' THEN regexp_matches(t, '^\\s*(import|from) ') WHEN 'rust' THEN regexp_matches(t, '^\\s*(pub )?use ') ELSE regexp_matches(t, '^\\s*(import |export .* from )') END) AS imp FROM code GROUP BY path),
lf AS (SELECT path, coalesce(size_bytes, 0) AS size_bytes, coalesce(ne, 0) AS ne, coalesce(ml, 0) AS ml, coalesce(imp, 0) AS imp, {_KIND} AS kind FROM files LEFT JOIN bf USING (path)),
ly AS (SELECT src AS path, count(*) FILTER (v = 'f') AS f, count(*) FILTER (v = 'o') AS o, count(*) FILTER (v = 'u') AS u FROM (
  SELECT src, CASE WHEN a IS NULL OR b IS NULL THEN 'u' WHEN a = b THEN 's' WHEN a = 'data' AND b = 'surface' THEN 'f' WHEN (a, b) IN (('surface', 'logic'), ('logic', 'data')) THEN 'a' ELSE 'o' END AS v
  FROM (SELECT src, {_ZONE.format("src")} AS a, {_ZONE.format("dst")} AS b FROM di)) GROUP BY src),
log AS (SELECT path, date_trunc('hour', ts) AS c, event_type AS a, CAST(floor(value) AS BIGINT) AS churn FROM events JOIN files ON user_id = doc_id),
lp AS (SELECT DISTINCT path, c FROM log),
gr AS (SELECT path, count(DISTINCT c) AS commits, count(DISTINCT a) AS authors, CAST(sum(churn) AS BIGINT) AS churn FROM log GROUP BY path),
gm AS (SELECT path, max(n) AS most FROM (SELECT path, a, count(*) AS n FROM log GROUP BY path, a) GROUP BY path),
gn AS (SELECT x.path, count(DISTINCT y.path) AS k FROM lp x JOIN lp y ON x.c = y.c AND x.path <> y.path GROUP BY x.path),
ex AS MATERIALIZED (SELECT path, count(*) AS exported FROM code WHERE language <> 'text' AND NOT contains(path, '/tests/') AND {_EXPORT} GROUP BY path),
sy AS (SELECT path, count(*) AS n FROM symbols GROUP BY path),
m1 AS MATERIALIZED (
  SELECT path, 'size_bytes' AS metric_id, size_bytes AS value FROM lf UNION ALL SELECT path, 'non_empty_lines', ne FROM lf UNION ALL SELECT path, 'non_empty_lines_' || kind, ne FROM lf
  UNION ALL SELECT path, 'max_line_length', ml FROM lf UNION ALL SELECT path, 'import_count', imp FROM lf
  UNION ALL SELECT path, 'symbol_count', n FROM sy UNION ALL SELECT path, 'ref_count', count(*) FROM refs GROUP BY path UNION ALL SELECT path, 'module_dep_count', count(*) FROM deps GROUP BY path
  UNION ALL SELECT path, 'fan_in_count', fan_in FROM fan UNION ALL SELECT path, 'fan_out_count', fan_out FROM fan UNION ALL SELECT path, 'graph_edge_out_count', fan_out FROM fan WHERE fan_out > 0
  UNION ALL SELECT DISTINCT a.src, 'module_cycle_member', 1 FROM di a JOIN di b ON a.src = b.dst AND a.dst = b.src
  UNION ALL SELECT path, 'hub_module', fan_in + fan_out FROM fan WHERE fan_in > 20 AND fan_out > 20 UNION ALL SELECT path, 'orphan_module', 1 FROM files WHERE path NOT IN (SELECT path FROM fan)
  UNION ALL SELECT path, 'layering_forbidden_edge_count', f FROM ly UNION ALL SELECT path, 'layering_out_of_direction_edge_count', o FROM ly UNION ALL SELECT path, 'layering_unmatched_edge_count', u FROM ly
  UNION ALL SELECT path, 'layering_cross_edge_count', f + o + u FROM ly WHERE f + o > 0
  UNION ALL SELECT path, 'git_recent_commit_count', commits FROM gr UNION ALL SELECT path, 'git_recent_author_count', authors FROM gr UNION ALL SELECT path, 'git_recent_churn_lines', churn FROM gr
  UNION ALL SELECT path, 'git_cochange_neighbor_count', coalesce(k, 0) FROM gr LEFT JOIN gn USING (path)
  UNION ALL SELECT path, 'git_primary_author_share_bps', CASE WHEN commits >= 3 THEN most * 10000 // commits ELSE 0 END FROM gr JOIN gm USING (path)
  UNION ALL SELECT path, 'security_smell_' || kind, count(*) FROM (SELECT path, unnest(list_filter([
    CASE WHEN contains(t, 'select ') THEN 'raw_sql' END, CASE WHEN contains(t, 'yaml.load(') THEN 'unsafe_deserialize' END,
    CASE WHEN contains(t, 'shell=True') OR contains(t, 'Command::new(') OR contains(t, 'execSync(') THEN 'shell_exec' END,
    CASE WHEN contains(t, 'open(path_') OR contains(t, 'fs::read(path_') OR contains(t, 'readFile(path_') THEN 'path_traversal' END], lambda x: x IS NOT NULL)) AS kind
    FROM code WHERE language <> 'text' AND NOT contains(path, '/tests/')) GROUP BY path, kind
  UNION ALL SELECT path, 'dead_code_exported_symbol_count', exported FROM ex
  UNION ALL SELECT path, 'dead_code_candidate', 1 FROM ex LEFT JOIN fan USING (path) LEFT JOIN sy USING (path) WHERE coalesce(fan_in, 0) = 0 AND coalesce(fan_out, 0) <= 1 AND coalesce(n, 0) <= 24),
src AS (SELECT path, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS dir, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) AS stem FROM lf WHERE kind = 'default'),
tst AS (SELECT path AS test, string_split(regexp_replace(path, '/[^/]*$', ''), '/') AS tdir, regexp_replace(regexp_extract(path, '([^/]*)\\.[^./]*$', 1), '_test$', '') AS stem FROM lf WHERE kind = 'test'),
nt AS (SELECT path, count(*) AS tests, count(*) FILTER (contains(test, 'integration')) AS integration FROM src JOIN tst USING (stem)
  WHERE len(dir) + len(tdir) - 2 * len(list_filter(range(1, least(len(dir), len(tdir)) + 1), lambda i: dir[1:i] = tdir[1:i])) <= {NEAR} GROUP BY path),
hp AS (SELECT path, sum(CASE WHEN metric_id = 'non_empty_lines' AND value >= 300 THEN 2 WHEN metric_id IN ('fan_in_count', 'fan_out_count') AND value >= 20 THEN 4 ELSE 0 END) AS points FROM m1 GROUP BY path),
tf AS (SELECT src.path, coalesce(tests, 0) AS tests, coalesce(integration, 0) AS integration, coalesce(exported, 0) AS exported, coalesce(points, 0) AS points FROM src LEFT JOIN nt USING (path) LEFT JOIN ex USING (path) LEFT JOIN hp USING (path)),
metrics AS MATERIALIZED (SELECT path, metric_id, CAST(value AS BIGINT) AS value FROM m1 UNION ALL SELECT path, 'test_nearby_test_file_count', tests FROM tf WHERE tests > 0
  UNION ALL SELECT path, 'test_nearby_integration_test_file_count', integration FROM tf WHERE integration > 0
  UNION ALL SELECT path, 'public_surface_without_tests', 1 FROM tf WHERE exported > 0 AND tests = 0 UNION ALL SELECT path, 'hotspot_without_test_evidence', 1 FROM tf WHERE points >= 6 AND tests = 0
  UNION ALL SELECT path, 'integration_entry_without_tests', 1 FROM tf WHERE contains(path, '/api/') AND integration = 0), {_RULES},
found AS MATERIALIZED (SELECT path, rule_id, value AS actual, CAST(threshold AS BIGINT) AS threshold, severity, category FROM metrics JOIN rules USING (metric_id) WHERE value > threshold)"""
_HIDE = " OR ".join(f"(rule_id = '{r}' AND regexp_matches(path, '{p}'))" for r, p in SUPPRESSED)


def _rows(name: str, found: str, where: str = "true") -> str:
    """File rows of a snapshot, from violations ``found`` with a column ``hidden``."""
    mx = lambda *ms: "greatest(" + ", ".join(ms) + ")"
    v = lambda m, by=1: f"greatest(coalesce(max(value) FILTER (metric_id = '{m}'), 0), 0) / {float(by)}::DOUBLE"
    return f"""{name}_r AS (SELECT path, {v("fan_in_count")} + {v("fan_out_count")} + {v("non_empty_lines", 100)}
    + 1.35::DOUBLE * {mx(v("layering_forbidden_edge_count"), v("layering_out_of_direction_edge_count"), v("layering_unmatched_edge_count"))}
    + 1.15::DOUBLE * {mx(v("git_recent_commit_count", 6), v("git_recent_churn_lines", 200), v("git_primary_author_share_bps", 5000), v("git_cochange_neighbor_count", 5))} AS base FROM metrics WHERE {where} GROUP BY path),
{name}_v AS (SELECT path, count(*) FILTER (NOT hidden) AS active, count(*) FILTER (hidden) AS suppressed, coalesce(max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) FILTER (NOT hidden), 0) AS prominence,
  count(*) FILTER (NOT hidden AND rule_id IN ({", ".join(f"'{x}'" for x in S.SIGNAL_RULES)})) AS signals,
  coalesce(sum(1.0::DOUBLE + CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 4 ELSE 8 END) FILTER (NOT hidden AND NOT starts_with(rule_id, 'security_smell_')), 0)
  + 1.25::DOUBLE * coalesce(max(CASE rule_id WHEN 'hotspot_without_test_evidence' THEN 2.0::DOUBLE WHEN 'public_surface_without_tests' THEN 1.5::DOUBLE WHEN 'integration_entry_without_tests' THEN 1.0::DOUBLE ELSE 0 END) FILTER (NOT hidden), 0) AS points FROM {found} GROUP BY path),
{name} AS MATERIALIZED (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, coalesce({_ZONE.format("path")}, 'unmatched') AS module, base + coalesce(points, 0) AS risk, coalesce(active, 0) AS active,
  coalesce(suppressed, 0) AS suppressed, coalesce(prominence, 0) AS prominence, coalesce(signals, 0) AS signals FROM {name}_r LEFT JOIN {name}_v USING (path)),
{name}_b AS MATERIALIZED (SELECT aggregation, bucket_id, sum(risk) FILTER (place <= 5) + CASE aggregation WHEN 'file' THEN 0 ELSE count(*) FILTER (active > 0) + sum(signals) END AS hotspot_score, CAST(sum(active) AS BIGINT) AS active
  FROM (SELECT *, row_number() OVER (PARTITION BY aggregation, bucket_id ORDER BY risk DESC, path) AS place FROM (
    SELECT 'file' AS aggregation, path AS bucket_id, * FROM {name} UNION ALL SELECT 'directory', dir, * FROM {name} UNION ALL SELECT 'module', module, * FROM {name})) GROUP BY aggregation, bucket_id)"""


_PART = "CAST(regexp_extract(path, 'part(\\d+)', 1) AS BIGINT)"
_RANKS = " UNION ALL ".join(
    f"SELECT '{k}' AS ranking, path, {c} AS value, prominence, sz FROM fr" for k, c in (("violation_count", "active"), ("size_bytes", "sz"), ("non_empty_lines", "ne"), *((f"metric_{m}", m) for m in S.RANKED_METRICS))
)

QUERIES = {f.__name__: f for f in (rule_facts, fact_violations, suppressed_violations, quality_snapshot, quality_gate, gate_of_equals, directory_delta)}

ORACLES = {
    "rule_facts": f"WITH {_FACTS} SELECT * FROM metrics",
    "fact_violations": f"WITH {_FACTS} SELECT * FROM found",
    "suppressed_violations": f"WITH {_FACTS} SELECT rule_id, count(*) FILTER (NOT ({_HIDE})) AS active, count(*) FILTER ({_HIDE}) AS suppressed FROM found GROUP BY rule_id",
    "quality_snapshot": f"""WITH {_FACTS}, seen AS (SELECT *, {_HIDE} AS hidden FROM found), {_rows("fs", "seen")},
fr AS (SELECT fs.*, size_bytes AS sz, ne, nullif(fan_out, 0) AS graph_edge_out_count, NULL::BIGINT AS max_cognitive_complexity, NULL::BIGINT AS duplicate_density_bps FROM fs JOIN lf USING (path) LEFT JOIN fan USING (path))
SELECT 'totals' AS section, '' AS key, 0 AS rank, item, value::DOUBLE AS value FROM (SELECT unnest(['evaluated_files', 'violating_files', 'total_violations', 'suppressed_violations', 'total_non_empty_lines', 'total_size_bytes']) AS item,
  unnest([count(*), count(*) FILTER (active > 0), sum(active), sum(suppressed), sum(ne), sum(sz)]) AS value FROM fr)
UNION ALL SELECT 'top_rules', '', r::INTEGER, rule_id, n FROM (SELECT rule_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, rule_id) AS r FROM seen WHERE NOT hidden GROUP BY rule_id) WHERE r <= 5
UNION ALL SELECT 'top_metrics', '', r::INTEGER, metric_id, n FROM (SELECT metric_id, max(value) AS n, row_number() OVER (ORDER BY max(value) DESC, metric_id) AS r FROM metrics GROUP BY metric_id) WHERE r <= 5
UNION ALL SELECT 'top_files', ranking, r::INTEGER, path, value FROM (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY value DESC NULLS LAST, prominence DESC, sz DESC, path) AS r FROM ({_RANKS})) WHERE r <= 10
UNION ALL SELECT 'top_buckets', aggregation, r::INTEGER, bucket_id, round(hotspot_score, 4) FROM (SELECT *, row_number() OVER (PARTITION BY aggregation ORDER BY hotspot_score DESC, active DESC, bucket_id) AS r FROM fs_b) WHERE r <= 5""",
    "quality_gate": f"""WITH {_FACTS}, dd AS (SELECT path, rule_id, actual, threshold, sum(({_PART} % 3 <> 0)::INT - ({_PART} % 2 = 0)::INT) AS d FROM found GROUP BY ALL)
SELECT n AS new_violations, r AS resolved_violations, n - r AS violations_delta, CASE WHEN n > 0 THEN 'regression' ELSE 'ok' END AS gate_status, CASE WHEN n > 0 THEN 'new_violations=' || n ELSE '' END AS reasons
FROM (SELECT coalesce(sum(greatest(d, 0)), 0)::BIGINT AS n, coalesce(sum(greatest(-d, 0)), 0)::BIGINT AS r FROM dd)""",
    "gate_of_equals": "SELECT 0::BIGINT AS new_violations, 0::BIGINT AS resolved_violations, 0::BIGINT AS violations_delta, 'ok' AS gate_status, '' AS reasons",
    "directory_delta": f"""WITH {_FACTS}, o AS (SELECT *, false AS hidden FROM found WHERE {_PART} % 2 = 0), n AS (SELECT *, false AS hidden FROM found WHERE {_PART} % 3 <> 0), {_rows("od", "o", f"{_PART} % 2 = 0")}, {_rows("nd", "n", f"{_PART} % 3 <> 0")},
dd AS (SELECT regexp_replace(path, '/[^/]*$', '') AS bucket_id, rule_id, sum(({_PART} % 3 <> 0)::INT - ({_PART} % 2 = 0)::INT) AS d FROM found GROUP BY ALL),
dg AS (SELECT bucket_id, sum(greatest(d, 0))::BIGINT AS new, sum(greatest(-d, 0))::BIGINT AS resolved, coalesce(string_agg(rule_id, ',' ORDER BY rule_id) FILTER (d > 0), '') AS regressed_rules FROM dd GROUP BY bucket_id)
SELECT bucket_id, coalesce(new, 0) AS new, coalesce(resolved, 0) AS resolved, round(coalesce(c.hotspot_score, 0) - coalesce(b.hotspot_score, 0), 4) AS hotspot_delta,
  b.bucket_id IS NULL AND (coalesce(c.active, 0) > 0 OR c.hotspot_score > 0) AS new_hotspot, coalesce(regressed_rules, '') AS regressed_rules
FROM (SELECT * FROM od_b WHERE aggregation = 'directory') b FULL JOIN (SELECT * FROM nd_b WHERE aggregation = 'directory') c USING (bucket_id) LEFT JOIN dg USING (bucket_id)""",
}
