"""Registered investigation and extraction queries, and their oracles.

Pages and documents play source files: their urls and paths carry roles, license and
quantity lines play constraints.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import extract as X
from quern.operators import investigation as I
from quern.sources import adapters as A
from quern.sources import globs

SEED = "the license page of mail token"
#: License notices as the constraints of prose.
PROSE = (
    ("*", "licensed under", "", "license_constraint", "notice", "strong", 0.9),
    ("*", "released under", "", "license_constraint", "notice", "strong", 0.85),
    ("*", "license", "", "license_hint", "mention", "weak", 0.6),
    ("*", "token =", "", "secret_hint", "assignment", "weak", 0.55),
)


def _pages(spark, d):
    p = A.table(spark, d, "pages")
    return p.select(F.regexp_replace("url", r"^[a-z]+://", "").alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"), F.octet_length("html").cast("long").alias("size_bytes"), F.substring("html", 1, T.SAMPLE_CHARS).alias("sample"))


def constraint_lines(spark, d):
    return I.constraint_evidence(A.files(spark, d), PROSE)


def route_roles(spark, d):
    """Roles of the pages' paths, with every fifth one put under a folder that plays a role."""
    p = A.table(spark, d, "pages")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("x/tests/", "x/migrations/", "x/services/", "x/api/", "ui/", "x/models/", "x/plain/")]), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(folder, F.col("page_id").cast("string"))
    return p.select("page_id", I.route_segment(path).alias("segment"), I.source_kind(path).alias("kind"))


def token_overlap(spark, d):
    f = A.table(spark, d, "benchmark").select("item_id", F.round(I.overlap(F.col("text"), F.lit(SEED + " and thereof")), 6).alias("overlap"))
    return f


def concept_cluster(spark, d):
    f = A.files(spark, d)
    out = I.concept_cluster(f, I.constraint_evidence(f, PROSE), SEED, 25)
    return out.select("path", "strong", "weak", "tests", F.round("confidence", 6).alias("confidence"))


def divergence_axes(spark, d):
    o = A.table(spark, d, "orders")
    one = o.withColumn("constant", F.lit("x")).withColumn("nothing", F.lit(None).cast("string"))
    return I.divergence(one, "o_orderstatus", "o_orderpriority", "constant", "nothing")


def common_constraints(spark, d):
    """Suppliers' nations that serve every market segment."""
    li, o = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    c, s = A.table(spark, d, "customer"), A.table(spark, d, "supplier")
    r = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return I.common_values(r, "s_nationkey", "c_mktsegment")


def contract_trace(spark, d):
    p = A.table(spark, d, "pages")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("x/tests/", "x/migrations/", "x/services/", "x/api/", "ui/", "x/models/", "x/plain/")]), (F.col("page_id") % 7 + 1).cast("int"))
    return I.contract_trace(p.select(F.concat(folder, F.lpad(F.col("page_id").cast("string"), 6, "0")).alias("path"), (F.length("html") * 1.0).alias("score")))


def scope_preview(spark, d):
    f = A.files(spark, d).select("path")
    out = globs.scope_preview(f, include=["src{1,2,3}/**"], exclude=["src2/*.{de,fr}", "src3/1*"])
    return out.select("bucket", "n")


def source_extraction(spark, d):
    """Symbols, references and metrics of documents taken as Python, which prose hardly is."""
    f = A.files(spark, d).select("path", F.lit("python").alias("language"), "text")
    facts = X.source_facts(f)
    return facts.select("path", F.size("symbols").alias("symbols"), F.size("refs").alias("refs"), F.size("deps").alias("deps"), F.col("metrics")["branch_count"].alias("branches"))


_LS = "CASE WHEN length(text) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') END"
_CON = f"""ln AS (SELECT path, unnest(ls) AS line, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no FROM (SELECT path, {_LS} AS ls FROM files)),
nm AS (SELECT path, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM ln),
con AS (SELECT DISTINCT path, line_no, CASE WHEN contains(lower(norm), 'licensed under') OR contains(lower(norm), 'released under') THEN 'license_constraint' WHEN contains(lower(norm), 'license') THEN 'license_hint' ELSE 'secret_hint' END AS kind,
  CASE WHEN contains(lower(norm), 'licensed under') OR contains(lower(norm), 'released under') THEN 'notice' WHEN contains(lower(norm), 'license') THEN 'mention' ELSE 'assignment' END AS source,
  CASE WHEN contains(lower(norm), 'licensed under') OR contains(lower(norm), 'released under') THEN 'strong' ELSE 'weak' END AS strength,
  CASE WHEN contains(lower(norm), 'licensed under') THEN 0.9 WHEN contains(lower(norm), 'released under') THEN 0.85 WHEN contains(lower(norm), 'license') THEN 0.6 ELSE 0.55 END::DOUBLE AS confidence, substr(norm, 1, 160) AS excerpt
  FROM nm WHERE regexp_matches(lower(norm), 'license|released under|token ='))"""
_FOLD = "['x/tests/', 'x/migrations/', 'x/services/', 'x/api/', 'ui/', 'x/models/', 'x/plain/'][page_id % 7 + 1]"
_KIND = "['test', 'migration', 'service', 'endpoint', 'ui', 'model', 'unknown'][page_id % 7 + 1]"
_W = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) >= 3))"
_OV = "CASE WHEN greatest(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / greatest(len({a}), len({b})) ELSE 0 END"


def _ov(x: str, y: str) -> str:
    return _OV.format(a=_W.format(x), b=_W.format(y))


QUERIES = {f.__name__: f for f in (
    constraint_lines, route_roles, token_overlap, concept_cluster, divergence_axes, common_constraints, contract_trace, scope_preview, source_extraction,
)}

ORACLES = {
    "constraint_lines": f"WITH {A.FILES}, {_CON} SELECT * FROM con",
    "route_roles": f"SELECT page_id, ['test', 'migration', 'service', 'endpoint', 'ui', 'unknown', 'unknown'][page_id % 7 + 1] AS segment, {_KIND} AS kind FROM pages",
    "token_overlap": f"SELECT item_id, round({_ov('text', repr(SEED + ' and thereof'))}, 6) AS overlap FROM benchmark",
    "concept_cluster": f"""WITH {A.FILES}, {_CON}, e AS (SELECT path, count(*) FILTER (strength = 'strong') AS strong, count(*) FILTER (strength = 'weak') AS weak FROM con GROUP BY path),
s AS (SELECT f.path, coalesce(strong, 0) AS strong, coalesce(weak, 0) AS weak, {_ov(repr(SEED), 'f.path')} AS lex, {_ov(repr(SEED), 'f.sample')} AS sym FROM files f LEFT JOIN e USING (path)),
c AS (SELECT *, 0 AS tests, greatest(0, least(1, lex * 0.2::DOUBLE + sym * 0.15::DOUBLE + least(1.0, least(1.0, strong * 0.5::DOUBLE) + CASE WHEN strong > 0 THEN least(0.4::DOUBLE, weak * 0.08::DOUBLE) ELSE least(0.2::DOUBLE, weak * 0.04::DOUBLE) END) * 0.25::DOUBLE
  - CASE WHEN strong + weak > 0 THEN 0 ELSE 0.1::DOUBLE END - 0.05::DOUBLE)) AS confidence FROM s)
SELECT path, strong, weak, tests::BIGINT AS tests, round(confidence, 6)::DOUBLE AS confidence FROM c ORDER BY c.confidence DESC, strong DESC, lex DESC, path LIMIT 25""",
    "divergence_axes": """WITH v AS (SELECT 'o_orderstatus' AS axis, count(DISTINCT o_orderstatus) AS n_values FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
  UNION ALL SELECT 'constant', 1 UNION ALL SELECT 'nothing', 0)
SELECT axis, n_values, CASE WHEN n_values = 0 THEN 'missing' WHEN n_values = 1 THEN 'consensus' ELSE 'divergence' END AS state,
  CASE WHEN n_values <= 1 THEN 'none' WHEN n_values = 2 THEN 'low' WHEN n_values <= 4 THEN 'medium' ELSE 'high' END AS severity FROM v""",
    "common_constraints": """SELECT s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY s_nationkey HAVING count(DISTINCT c_mktsegment) = (SELECT count(DISTINCT c_mktsegment) FROM customer JOIN orders ON o_custkey = c_custkey)""",
    "contract_trace": f"""WITH c AS (SELECT {_FOLD} || lpad(page_id::VARCHAR, 6, '0') AS path, {_KIND} AS role, length(html)::DOUBLE AS score FROM pages),
b AS (SELECT role, path, score FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY score DESC, path) AS r FROM c) WHERE r = 1),
o AS (SELECT unnest(['ui', 'api_client', 'endpoint', 'service', 'crud', 'query', 'model', 'migration', 'test']) AS role, unnest(range(9))::INTEGER AS step)
SELECT step, o.role, path, score, path IS NULL AS broken FROM o LEFT JOIN b ON o.role = b.role""",
    "scope_preview": f"""WITH {A.FILES} SELECT CASE WHEN regexp_matches(path, '^src[123]/') AND NOT regexp_matches(path, '^src2/[^/]*\\.(de|fr)$') AND NOT regexp_matches(path, '^src3/1') THEN 'included' ELSE 'excluded_by_scope' END AS bucket,
  count(*) AS n FROM files GROUP BY 1""",
}
