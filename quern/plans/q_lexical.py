"""Registered lexical queries, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import lexical as L
from quern.sources import adapters as A

QUERY = "open license terms"
TERMS = L.query_tokens(QUERY)
LIKE = "mit license"
K = 20


def _post(spark, d):
    return L.postings(A.files(spark, d))


def bm25_topk(spark, d):
    hits = L.bm25(_post(spark, d), TERMS)
    rows = hits.select("path", "matched", F.round("bm25", 6).alias("bm25"), F.round(L.base_score(F.col("bm25")), 6).alias("base_score"))
    return L.top(rows, "bm25", K)


def fts_and_or_fill(spark, d):
    hits = L.full_text(_post(spark, d), QUERY, K)
    return hits.select("path", F.round("bm25", 6).alias("bm25"), "phase", "rank")


def like_search(spark, d):
    hits = L.like_search(A.files(spark, d), LIKE, K)
    return hits.select("path", F.round("score", 6).alias("score"))


def path_boost(spark, d):
    f = A.files(spark, d).select("path")
    return f.select("path", F.round(L.path_boost(F.col("path"), ["src1", "en", "src3", "12"]), 6).alias("boost"))


def graph_boost(spark, d):
    f = A.files(spark, d)
    none = f.select("path", F.lit("").alias("dep")).where("false")
    out = L.graph_boost(f, A.symbols(spark, d), A.refs(spark, d), none, TERMS)
    return out.select("path", F.round("boost", 6).alias("boost"))


def term_postings(spark, d):
    """Posting statistics of every term of the corpus."""
    return _post(spark, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


_POST = """post AS (SELECT path, term, count(*) AS tf, any_value(doc_len) AS doc_len FROM (
  SELECT path, unnest(w) AS term, len(w) AS doc_len FROM (SELECT path,
    list_filter(regexp_split_to_array(lower(path || ' ' || text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2) AS w FROM files)) GROUP BY path, term)"""
_Q = "q AS (SELECT unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS q)"
_BM = """hits AS (SELECT path, any_value(doc_len) AS doc_len, q, sum(tf) AS f FROM post JOIN q ON starts_with(term, q) GROUP BY path, q),
sizes AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM (SELECT path, any_value(doc_len) AS n FROM post GROUP BY path)),
dfs AS (SELECT q, count(*) AS df FROM hits GROUP BY q),
bm AS (SELECT path, count(*) AS matched, sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS bm25
  FROM hits JOIN dfs USING (q), sizes GROUP BY path)"""

QUERIES = {
    "bm25_topk": bm25_topk,
    "fts_and_or_fill": fts_and_or_fill,
    "like_search": like_search,
    "path_boost": path_boost,
    "graph_boost": graph_boost,
    "term_postings": term_postings,
}

ORACLES = {
    "bm25_topk": f"""WITH {A.FILES}, {_POST}, {_Q}, {_BM} SELECT path, matched, round(bm25, 6) AS bm25, round(bm25 / (1 + bm25), 6) AS base_score
FROM bm ORDER BY round(bm25, 6) DESC, path LIMIT {K}""",
    "fts_and_or_fill": f"""WITH {A.FILES}, {_POST}, {_Q}, {_BM}, r AS (SELECT path, round(bm25, 6) AS bm25,
  CAST(CASE WHEN matched = {len(TERMS)} THEN 0 ELSE 1 END AS INTEGER) AS phase,
  CAST(row_number() OVER (ORDER BY CASE WHEN matched = {len(TERMS)} THEN 0 ELSE 1 END, bm.bm25 DESC, path) AS INTEGER) AS rank FROM bm)
SELECT * FROM r WHERE rank <= {K}""",
    "like_search": f"""WITH {A.FILES}, k AS (SELECT path, lower(strip_accents(path)) AS pk,
  regexp_replace(replace(replace(replace(lower(strip_accents(sample)), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), '\\p{{M}}', '', 'g') AS sk FROM files),
s AS (SELECT path, pk, sk, (length(pk) - length(replace(pk, '{LIKE}', ''))) / {len(LIKE)} AS ph, (length(sk) - length(replace(sk, '{LIKE}', ''))) / {len(LIKE)} AS sh
  FROM k WHERE contains(pk, '{LIKE}') OR contains(sk, '{LIKE}'))
SELECT path, round(least(2.0, 0.25 + least(CAST(ph AS INTEGER), 5) * 0.14 + least(CAST(sh AS INTEGER), 8) * 0.07
  + CASE WHEN contains(pk, '{LIKE}') THEN 0.2 / instr(pk, '{LIKE}') ELSE 0 END + CASE WHEN contains(sk, '{LIKE}') THEN 0.12 / instr(sk, '{LIKE}') ELSE 0 END), 6) AS score
FROM s ORDER BY score DESC, path LIMIT {K}""",
    "path_boost": f"""WITH {A.FILES}, p AS (SELECT path, string_split(path, '/') AS seg, string_split(path, '/')[-1] AS name FROM files),
t AS (SELECT unnest(['src1', 'en', 'src3', '12']) AS t)
SELECT path, round(least(1.2, sum(CASE WHEN regexp_replace(name, '\\.[^.]*$', '') = t THEN 0.85 WHEN name = t THEN 0.75
  WHEN list_contains(seg, t) THEN 0.32 WHEN contains(name, t) THEN 0.18 ELSE 0 END)), 6) AS boost FROM p, t GROUP BY path""",
    "graph_boost": f"""WITH {A.FILES}, {A.REFS}, {A.SYMBOLS}, {_Q}, parts AS (
  SELECT path, q, 0.12 + 0.08 * least(count(*), 3) AS b FROM symbols JOIN q ON contains(lower(name), q) GROUP BY path, q
  UNION ALL SELECT path, q, 0.08 + 0.05 * least(count(*), 3) FROM refs JOIN q ON contains(symbol, q) GROUP BY path, q
  UNION ALL SELECT path, q, 0.07 FROM files JOIN q ON contains(lower(path), q))
SELECT path, round(least(1.5, sum(b)) * 0.75, 6) AS boost FROM parts GROUP BY path""",
    "term_postings": f"""WITH {A.FILES}, {_POST} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM post GROUP BY term""",
}
