"""Registered queries of intents and supplements, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import intent as N
from quern.sources import adapters as A
from quern.sources.sinks import materialize

#: (question, mode of the agent)
QUESTIONS = (
    ("backend service tests", None), ("tests nearby", None), ("api endpoint routes of the server", None), ("ui hooks and pages", None), ("mod runtime config mixin hooks", None), ("database migrations schema", None),
    ("main entrypoints architecture overview", None), ("auth boundary tests nearby backend frontend", None), ("batch deadline validator service of grades", None), ("mystery", None), ("anything", "entrypoint_map"),
    ("anything else", "test_map"), ("all of it", "review_prep"), ("contracts of it", "api_contract_map"), ("what runs", "runtime_surface"), ("what to move", "refactor_surface"),
)
#: Folders put before the tree's own, so that more roles occur.
MORE = ("", "mods/a/", "migrations/", "docs/", "server/config/", "web/hooks/", ".ai/", "app/mixin/", "batch/", "pages/api/", "tests/")
LIMIT = 6


def _queries(spark):
    return spark.createDataFrame(list(QUESTIONS), "query string, mode string")


def _files(spark, d):
    f = A.app_files(spark, d)
    prefix = F.element_at(F.array(*[F.lit(x) for x in MORE]), (F.col("doc_id") % len(MORE) + 1).cast("int"))
    return f.select("doc_id", F.concat(prefix, "path").alias("path"), "language", F.substring("text", 1, 120).alias("preview"))


def intent_resolution(spark, d):
    """Modes and flags of questions: the stated ones, and the first words of every benchmark text."""
    b = A.table(spark, d, "benchmark").select(F.substring_index("text", " ", 6).alias("query"), F.lit(None).cast("string").alias("mode")).distinct()
    out = N.resolve(_queries(spark).unionByName(b))
    return out.select("query", "agent_mode", "mode_source", F.coalesce("explicit_domain", F.lit("")).alias("explicit_domain"), *N.FLAGS, "code_first", "token_count", F.bit_count("coverage").alias("coverage"), F.bit_count("workload").alias("workload"))


def intent_score(spark, d):
    """Every file as a hit of one of the questions, by its number."""
    q = spark.createDataFrame([(k, *x) for k, x in enumerate(QUESTIONS)], "k int, query string, mode string")
    hits = _files(spark, d).join(F.broadcast(q.select("k", "query")), F.floor(F.col("doc_id") / 7) % len(QUESTIONS) == F.col("k")).drop("k")
    out = N.score_hits(hits, N.resolve(q))
    return out.select("query", "path", "intent_score")


def _ranked(spark, d):
    """Hits of every question: the files whose number leaves its place, by number."""
    q = spark.createDataFrame([(k, x[0]) for k, x in enumerate(QUESTIONS)], "k int, query string")
    rows = _files(spark, d).join(F.broadcast(q), (F.col("doc_id") % 211 == F.col("k") * 3) & (F.col("doc_id") < 211 * LIMIT))
    return rows.select("query", "path", (F.floor(F.col("doc_id") / 211) + 1).cast("int").alias("rank"))


def supplemental_hits(spark, d):
    f = materialize(_files(spark, d))
    return N.supplements(_ranked(spark, d), f, N.resolve(_queries(spark)), LIMIT)


_Q = ", ".join(f"({k}, '{q}', {'NULL' if m is None else repr(m)})" for k, (q, m) in enumerate(QUESTIONS))
_ALIAS = ", ".join(f"('{g}', '{a}')" for g, aliases in N.GROUPS.items() for a in aliases.split())


def _masks(name: str, source: str) -> str:
    """``name(id, h)``: the groups of each ``source(id, raw)``."""
    return f"""{name} AS MATERIALIZED (SELECT s.id, coalesce(list(DISTINCT g) FILTER (g IS NOT NULL), []) AS h FROM (SELECT id, raw, regexp_split_to_array(raw, '[^a-z0-9]+') AS toks FROM ({source})) s
  LEFT JOIN alias ON list_contains(toks, a) OR (length(a) >= 4 AND contains(raw, a)) GROUP BY s.id)"""


def _any(h: str, *groups: str) -> str:
    return "(" + " OR ".join(f"list_contains({h}, '{g}')" for g in groups) + ")"


def _lst(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _mode(pick, otherwise: str) -> str:
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {pick(r)}" for m, r in N.MODES.items()) + f" ELSE {otherwise} END"


_SVC, _API = _any("h", "service", "domain", "orchestration", "rule"), _any("h", "api", "endpoint", "router")
_RUN, _DB = _any("h", "module", "mixin", "config", "runtime"), _any("h", "migration", "schema", "sql", "db")
_OWN = {
    "prefers_backend": f"({_any('h', 'backend', 'batch')} OR {_API} OR {_SVC})", "prefers_frontend": f"({_any('h', 'frontend', 'page', 'component')} OR ({_any('h', 'hook')} AND NOT {_RUN}))", "prefers_database": _DB,
    "wants_api_surface": _API, "wants_service_layer": f"({_SVC} OR {_any('h', 'batch', 'validator', 'deadline', 'visibility')})", "wants_hook": _any("h", "hook"), "wants_page": _any("h", "page"), "wants_component": _any("h", "component"),
    "wants_mod_runtime": _RUN, "wants_migration": _any("h", "migration"), "wants_architecture": _any("h", "architecture"), "wants_entrypoints": _any("h", "entrypoint"), "wants_auth_boundary": _any("h", "auth"), "wants_tests": _any("h", "test"),
}
_INFERRED = f"""CASE WHEN {_OWN["wants_tests"]} THEN 'test_map' WHEN {_RUN} THEN 'runtime_surface' WHEN {_API} THEN 'api_contract_map' WHEN {_OWN["wants_entrypoints"]} THEN 'entrypoint_map'
  WHEN {_OWN["wants_architecture"]} AND ({_OWN["prefers_backend"]} OR {_OWN["prefers_frontend"]}) THEN 'refactor_surface' WHEN {_OWN["prefers_backend"]} AND {_OWN["prefers_frontend"]} THEN 'review_prep' END"""


def _intents(source: str) -> str:
    flags = ", ".join(f"{_mode(lambda r, k=k: str(k in r[0].split()).lower(), v)} AS {k}" for k, v in _OWN.items())
    return f"""alias AS (SELECT * FROM (VALUES {_ALIAS}) x(g, a)), qs AS MATERIALIZED ({source}), {_masks("qm", "SELECT query AS id, lower(query) || ' ' AS raw FROM qs")},
qi AS MATERIALIZED (SELECT query, mode, coalesce(mode, {_INFERRED}, 'entrypoint_map') AS agent_mode, CASE WHEN mode IS NOT NULL THEN 'explicit' WHEN {_INFERRED} IS NOT NULL THEN 'inferred' ELSE 'default' END AS mode_source,
  {_mode(lambda r: "NULL" if r[1] is None else repr(r[1]), f"CASE WHEN {_DB} THEN 'database' WHEN {_any('h', 'backend')} THEN 'backend' WHEN {_any('h', 'frontend')} THEN 'frontend' END")} AS explicit_domain, {flags}, {_any("h", *N.WORKLOAD)} AS busy,
  {_mode(lambda r: str(r[2]), "len(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: w <> '')))")}::INTEGER AS token_count,
  {_mode(lambda r: _lst(r[3].split()), f"list_intersect(h, {_lst(N.COVERAGE)})")} AS cov, {_mode(lambda r: "CAST([] AS VARCHAR[])" if not r[4] else _lst(r[4].split()), f"list_intersect(h, {_lst(N.WORKLOAD)})")} AS wrk FROM qs JOIN qm ON id = query),
qf AS MATERIALIZED (SELECT *, mode IS NOT NULL OR prefers_backend OR prefers_frontend OR prefers_database OR wants_architecture OR wants_entrypoints OR wants_auth_boundary OR wants_tests OR wants_mod_runtime OR busy AS code_first FROM qi)"""


_FILES = f"""{A.APP}, hf AS MATERIALIZED (SELECT doc_id, {_lst(MORE)}[doc_id % {len(MORE)} + 1] || path AS path, language, substr(text, 1, 120) AS preview FROM files)"""
_TEST = """regexp_matches(lower(path), '^tests/|/tests?/|_tests/|[.]test[.](ts|tsx|js|jsx|py|rs)$|_tests?[.]rs$|_spec[.]tsx?$')"""
_STEM = "regexp_replace(regexp_replace(lower(path), '^.*/', ''), '(.)[.][^.]*$', '\\1')"


def _scored(hits: str) -> str:
    """``sc``: ``hits(query, path, language, preview)`` with their score."""
    f = lambda g: _any("p", *g.split())
    low = "lower(path)"
    return f"""{_masks("pm", f"SELECT DISTINCT path AS id, lower(path) || ' ' AS raw FROM ({hits})")}, {_masks("hm", f"SELECT DISTINCT path AS id, lower(path) || ' ' || lower(preview) AS raw FROM ({hits})")},
r1 AS (SELECT x.*, pm.h AS p, hm.h AS hh, {_STEM} AS stem FROM (SELECT DISTINCT path, language FROM ({hits})) x JOIN pm ON pm.id = path JOIN hm ON hm.id = path),
r2 AS (SELECT *, {f("hook")} OR (language IN ('javascript', 'typescript') AND starts_with(stem, 'use')) AS hook, {f("page")} OR stem = 'page' AS page, {f("component")} AS component, {f("mixin")} OR contains({low}, '/mixin/') OR starts_with(stem, 'mixin') AS mixin,
  {f("config")} OR contains({low}, '/config/') AS config, {f("module")} OR contains({low}, '/module/') OR starts_with(stem, 'module') AS modl, {f("runtime")} AS runt, (starts_with({low}, 'mods/') OR contains({low}, '/mods/')) AND (ends_with(stem, 'mod') OR ends_with(stem, 'client')) AS entr,
  {f("migration")} AS migr, {f("schema sql")} OR ends_with({low}, '.sql') AS sche, {f("service domain orchestration rule")} OR contains({low}, '/services/') AS svc, {f("batch")} AS bat, {f("validator")} OR contains(stem, 'validator') AS val, {f("endpoint router api")} AS api FROM r1),
r3 AS (SELECT *, svc OR bat OR val AS work, {f("frontend")} OR hook OR page OR component AS front FROM r2),
r4 AS MATERIALIZED (SELECT *, CASE WHEN migr OR sche OR {f("store")} THEN 'database' WHEN front AND language IN ('javascript', 'typescript') THEN 'frontend' WHEN {f("backend")} OR work OR (api AND language IN ('python', 'rust')) THEN 'backend'
  WHEN starts_with({low}, 'docs/') OR contains({low}, '/docs/') OR ends_with({low}, '.txt') THEN 'docs' WHEN front THEN 'frontend' ELSE 'other' END AS dom, starts_with({low}, '.ai/') AS support, {_TEST} AS tst FROM r3),
r5 AS (SELECT *, CASE WHEN dom <> 'backend' THEN 'other' WHEN work THEN 'work' WHEN api THEN 'api' ELSE 'other' END AS layer, modl OR mixin OR config OR entr AS founded FROM r4),
j AS (SELECT z.query, z.path, q.* EXCLUDE (query), r5.* EXCLUDE (path, language), len(cov) AS nc, len(wrk) AS nw, len(list_intersect(hh, cov)) AS met, len(list_intersect(hh, wrk)) AS mw FROM (SELECT DISTINCT query, path FROM ({hits})) z JOIN qf q USING (query) JOIN r5 USING (path)),
pl AS (SELECT *, wants_tests AND nc = 1 AND NOT (prefers_backend OR prefers_frontend OR prefers_database OR wants_architecture OR wants_entrypoints OR wants_auth_boundary OR wants_service_layer OR wants_api_surface OR wants_mod_runtime) AS plain FROM j),
sc AS MATERIALIZED (SELECT query, path, round(CASE WHEN nc = 0 THEN 0 ELSE greatest(-0.22::DOUBLE, least(0.4::DOUBLE, (0.0::DOUBLE
  + CASE explicit_domain WHEN 'backend' THEN CASE dom WHEN 'backend' THEN 0.06 WHEN 'frontend' THEN -0.06 WHEN 'database' THEN -0.07 ELSE 0 END WHEN 'frontend' THEN CASE dom WHEN 'frontend' THEN 0.07 WHEN 'backend' THEN -0.08 WHEN 'database' THEN -0.055 ELSE 0 END
      WHEN 'database' THEN CASE dom WHEN 'database' THEN 0.054 WHEN 'backend' THEN -0.03 WHEN 'frontend' THEN -0.03 ELSE 0 END ELSE 0 END
  + CASE WHEN prefers_backend THEN CASE WHEN dom = 'backend' THEN 0.02 WHEN dom = 'frontend' AND explicit_domain IS DISTINCT FROM 'frontend' THEN -0.016 ELSE 0 END
      + CASE WHEN wants_service_layer AND wants_api_surface THEN CASE layer WHEN 'work' THEN 0.07 WHEN 'api' THEN 0.04 ELSE 0 END WHEN wants_service_layer THEN CASE layer WHEN 'work' THEN 0.095 WHEN 'api' THEN -0.09 ELSE 0 END
          WHEN wants_api_surface THEN CASE layer WHEN 'api' THEN 0.085 WHEN 'work' THEN -0.028 ELSE 0 END ELSE 0 END ELSE 0 END
  + CASE WHEN prefers_frontend THEN CASE WHEN dom = 'frontend' THEN 0.024 + CASE WHEN hook OR page OR component THEN 0.032 ELSE 0 END WHEN dom = 'backend' THEN -0.024 - CASE WHEN layer = 'api' THEN 0.08 ELSE 0 END ELSE 0 END ELSE 0 END
  + CASE WHEN wants_mod_runtime THEN CASE WHEN entr THEN 0.085 ELSE 0 END + CASE WHEN modl THEN 0.065 ELSE 0 END + CASE WHEN mixin THEN 0.07 ELSE 0 END + CASE WHEN config THEN 0.048 ELSE 0 END
      + CASE WHEN runt THEN CASE WHEN founded THEN 0.03 ELSE 0.01 - CASE WHEN token_count >= 6 THEN 0.016 ELSE 0 END - CASE WHEN wants_entrypoints THEN 0.01 ELSE 0 END END ELSE 0 END
      + CASE WHEN wants_hook AND mixin THEN 0.04 WHEN wants_hook AND hook THEN 0.012 ELSE 0 END + CASE WHEN founded AND nc >= 3 THEN 0.018 ELSE 0 END ELSE 0 END
  + CASE WHEN dom <> 'database' THEN 0 WHEN prefers_database THEN 0.018 WHEN code_first AND (prefers_backend OR prefers_frontend) THEN -0.1 WHEN code_first THEN -0.04 ELSE 0 END
  + CASE WHEN code_first AND support THEN -0.1 - CASE WHEN prefers_backend OR prefers_frontend THEN 0.04 ELSE 0 END ELSE 0 END
  + CASE WHEN wants_hook AND hook THEN 0.024 ELSE 0 END + CASE WHEN wants_page AND page THEN 0.024 ELSE 0 END + CASE WHEN wants_component AND component THEN 0.02 ELSE 0 END + CASE WHEN wants_migration AND migr THEN 0.018 ELSE 0 END
  + CASE WHEN sche AND prefers_database THEN 0.012 ELSE 0 END + CASE WHEN wants_entrypoints AND layer = 'api' THEN 0.06 ELSE 0 END + CASE WHEN wants_entrypoints AND entr THEN 0.07 ELSE 0 END + CASE WHEN wants_auth_boundary AND dom = 'backend' THEN 0.02 ELSE 0 END
  + CASE WHEN wants_tests AND tst THEN 0.034 + CASE WHEN plain THEN 0.09 ELSE 0 END + CASE WHEN wants_auth_boundary THEN 0.03 ELSE 0 END WHEN plain THEN -0.05 ELSE 0 END
  + CASE WHEN met > 1 THEN least((met - 1) * 0.03, 0.09) ELSE 0 END + CASE WHEN met >= 3 THEN 0.02 ELSE 0 END + CASE WHEN met = nc THEN CASE WHEN met = 2 THEN 0.06 WHEN met > 2 THEN 0.16 ELSE 0 END ELSE 0 END
  + CASE WHEN mw > 0 THEN least(mw * 0.018, 0.072) ELSE 0 END + CASE WHEN mw = nw AND mw >= 2 THEN 0.08 ELSE 0 END)::DOUBLE)) END, 6)::DOUBLE AS intent_score FROM pl)"""


_SVC_PATH = "regexp_matches(lower(path), '/(domain|services|orchestration|modules)/|_service[.](py|rs)$')"
_TST_PATH = "(" + _TEST + " OR contains(lower(path), 'test_'))"
_NEED = ", ".join(f"('{role}', '{w}')" for role, ws in N.NEEDLES.items() for w in ws)

QUERIES = {f.__name__: f for f in (intent_resolution, intent_score, supplemental_hits)}

ORACLES = {
    "intent_resolution": f"""WITH {_intents(f"SELECT query, mode FROM (VALUES {_Q}) v(k, query, mode) UNION ALL SELECT DISTINCT array_to_string(string_split(text, ' ')[1:6], ' '), NULL FROM benchmark")}
SELECT query, agent_mode, mode_source, coalesce(explicit_domain, '') AS explicit_domain, {", ".join(N.FLAGS)}, code_first, token_count, len(cov)::INTEGER AS coverage, len(wrk)::INTEGER AS workload FROM qf""",
    "intent_score": f"""WITH {_FILES}, {_intents(f"SELECT query, mode, k FROM (VALUES {_Q}) v(k, query, mode)")}, zz AS MATERIALIZED (SELECT query, path, language, preview FROM hf JOIN qs ON doc_id // 7 % {len(QUESTIONS)} = k), {_scored("SELECT * FROM zz")} SELECT * FROM sc""",
    "supplemental_hits": f"""WITH {_FILES}, {_intents(f"SELECT query, mode, k FROM (VALUES {_Q}) v(k, query, mode)")}, rkd AS (SELECT query, path, doc_id // 211 + 1 AS rank FROM hf JOIN qs ON doc_id % 211 = k * 3 AND doc_id < 211 * {LIMIT}),
tp AS (SELECT query, bool_or({_TST_PATH}) AS ht, bool_or({_SVC_PATH}) AS hs FROM rkd WHERE rank <= {min(LIMIT, N.WINDOW)} GROUP BY query),
lk AS (SELECT query, unnest(list_filter([CASE WHEN wants_tests AND NOT coalesce(ht, false) THEN 'test' END, CASE WHEN wants_service_layer AND NOT coalesce(hs, false) THEN 'service' END], lambda x: x IS NOT NULL)) AS role FROM qf LEFT JOIN tp USING (query)),
nm AS MATERIALIZED (SELECT role, path, language, preview FROM (SELECT *, row_number() OVER (PARTITION BY role, needle ORDER BY path) AS r FROM hf JOIN (VALUES {_NEED}) n(role, needle) ON contains(lower(path), needle)) WHERE r <= {8 * LIMIT} AND CASE role WHEN 'test' THEN {_TST_PATH} ELSE {_SVC_PATH} END),
fb AS (SELECT role, path, language, preview FROM (SELECT role, hf.*, row_number() OVER (PARTITION BY role ORDER BY path) AS r FROM hf, (VALUES ('test'), ('service')) n(role) WHERE CASE role WHEN 'test' THEN {_TST_PATH} ELSE {_SVC_PATH} END AND role NOT IN (SELECT role FROM nm)) WHERE r <= {min(LIMIT, N.FALLBACK)}),
sh AS MATERIALIZED (SELECT DISTINCT query, path, language, preview FROM (SELECT * FROM nm UNION SELECT * FROM fb) JOIN lk USING (role)), {_scored("SELECT * FROM sh")}
SELECT query, path, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS r FROM (SELECT query, path, round(0.3 + intent_score
  + least(0.2, 0.05 * len(list_filter(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 2)), lambda t: contains(lower(path), t)))), 6)::DOUBLE AS score FROM sc)) WHERE r <= {min(LIMIT, N.WINDOW)}""",
}
