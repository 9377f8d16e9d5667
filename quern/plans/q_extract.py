"""Registered extraction queries over the code that documents play, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunks as C
from quern.operators import extract as E
from quern.operators import source_text as B
from quern.plans.q_clones import _code
from quern.plans.shared import once
from quern.sources import adapters as A
from quern.sources.sinks import materialize


def _extracted(spark, d):
    return once(spark, d, "extracted", lambda: materialize(E.source_facts(_code(spark, d))))


def code_symbols(spark, d):
    return E.symbols_of(_extracted(spark, d))


def code_refs(spark, d):
    return E.refs_of(_extracted(spark, d)).groupBy("path", "symbol").agg(F.count("*").alias("n"), F.min("line").alias("first"))


def code_deps(spark, d):
    return E.deps_of(_extracted(spark, d)).groupBy("language", "dep").agg(F.count("*").alias("files"))


def _anchors(spark, d):
    """The least name of every file, and the third line or none of files without names."""
    code = _code(spark, d)
    named = E.symbols_of(_extracted(spark, d)).groupBy("path").agg(F.min(F.struct("name", "line")).alias("s")).select("path", F.col("s.name").alias("symbol"), F.col("s.line").alias("line"))
    rest = code.join(named, "path", "left_anti").select("path", F.lit(None).cast("string").alias("symbol"), F.when(F.length("path") % 2 == 0, 3).alias("line"))
    return named.unionByName(rest)


def symbol_bodies(spark, d):
    code = _code(spark, d)
    out = B.symbol_bodies(_anchors(spark, d), code, C.chunks(code))
    return out.select("path", F.coalesce("symbol", F.lit("")).alias("symbol"), "how", "start_line", "end_line", "signature", "truncated")


def body_ways(spark, d):
    """How bodies were found, by language and whether a name was there."""
    b = symbol_bodies(spark, d).join(_code(spark, d).select("path", "language"), "path")
    return b.groupBy("language", (F.col("symbol") != "").alias("named"), "how").agg(F.count("*").alias("n"))


_DECL = r"'^(?:pub |export )?(def|class|fn|struct|function) (\w+)'"
_NAME = f"regexp_extract(t, {_DECL}, 2)"
_NOT = "[" + ", ".join(f"'{w}'" for w in sorted(E._NOT_CALLS)) + "]"
_STRIPPED = r"""SELECT path, language, i, t, regexp_replace(t, '"[^"]*"|`[^`]*`|''[^'']*''|' || CASE language WHEN 'python' THEN '#.*$' ELSE '//.*$' END, ' ', 'g') AS u FROM code
  WHERE language <> 'text' AND NOT regexp_matches(t, CASE language WHEN 'rust' THEN '^use ' ELSE '^import ' END)"""
_SYMS = rf"""SELECT path, language, {_NAME} AS name, regexp_extract(t, {_DECL}, 1) AS kind, CAST(i AS INTEGER) AS line, CAST(length(regexp_extract(t, '^(?:pub |export )?(?:def|class|fn|struct|function) ')) + 1 AS INTEGER) AS "column"
FROM code WHERE language <> 'text' AND {_NAME} <> '' AND NOT list_contains({_NOT}, {_NAME})"""

QUERIES = {f.__name__: f for f in (code_symbols, code_refs, code_deps, symbol_bodies, body_ways)}

ORACLES = {
    "code_symbols": f"WITH {A.APP}, {A.APP_CODE} {_SYMS}",
    "code_refs": rf"""WITH {A.APP}, {A.APP_CODE}, ca AS (SELECT path, i, {_NAME} AS own, unnest(regexp_extract_all(u, '([A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)*)\s*!?\(', 1)) AS symbol FROM ({_STRIPPED}))
SELECT path, symbol, count(*) AS n, CAST(min(i) AS INTEGER) AS first FROM ca WHERE symbol <> own AND NOT list_contains({_NOT}, symbol) GROUP BY path, symbol""",
    "code_deps": rf"""WITH {A.APP}, {A.APP_CODE} SELECT language, dep, count(DISTINCT path) AS files FROM (SELECT path, language, CASE language WHEN 'python' THEN regexp_extract(t, '^import ([\w.]+)', 1) WHEN 'rust' THEN regexp_extract(t, '^use ([\w:]+)', 1)
  ELSE regexp_extract(t, '^import .* from ''([^'']+)''', 1) END AS dep FROM code WHERE language <> 'text') WHERE dep <> '' GROUP BY language, dep""",
    "body_ways": f"""WITH {A.APP}, {A.APP_CODE}, sy AS ({_SYMS}), na AS (SELECT DISTINCT path FROM sy), de AS (SELECT path FROM code WHERE i <= 3 AND regexp_matches(t, CASE language WHEN 'python' THEN '^(def|class) ' WHEN 'rust' THEN '^pub (fn|struct) ' WHEN 'text' THEN '^$^' ELSE '^ *(export )?(function|class|const) ' END)),
tx AS (SELECT path, count(*) FILTER (regexp_matches(t, '\\S')) AS full_lines FROM code GROUP BY path)
SELECT language, named, how, count(*) AS n FROM (SELECT f.path, language, na.path IS NOT NULL AS named, CASE WHEN na.path IS NOT NULL OR (length(f.path) % 2 = 0 AND f.path IN (SELECT path FROM de)) THEN 'exact_symbol_span' WHEN length(f.path) % 2 = 1 THEN 'chunk_excerpt_anchor'
  ELSE 'nearest_indexed_lines' END AS how, full_lines FROM files f LEFT JOIN na USING (path) LEFT JOIN tx USING (path)) WHERE coalesce(full_lines, 0) > 0 GROUP BY ALL""",
}
