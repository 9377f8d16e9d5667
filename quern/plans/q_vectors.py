"""Registered vector and chunk queries, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import chunks as C
from quern.operators import vectors as V
from quern.sources import adapters as A

DIM, K = 64, 10
QUERY, TERMS = "mit license", ["license", "mit"]


def _emb(spark, d):
    return V.checked(A.table(spark, d, "embeddings"), DIM)


def _queries(spark, d):
    return _emb(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def vector_topk(spark, d):
    out = V.exact_topk(_emb(spark, d), _queries(spark, d), K)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def ann_bucket_keys(spark, d):
    return V.bucket_keys(_emb(spark, d), DIM)


def _probe(spark, d, n):
    keys = V.bucket_keys(_emb(spark, d), DIM)
    q = keys.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return V.ann_probe(keys, q, n)


def ann_probe(spark, d):
    return _probe(spark, d, 1)


def ann_or_exact(spark, d):
    """Probe first; queries whose candidates fall short are answered by the exact scan."""
    found = _probe(spark, d, K).join(_emb(spark, d), "vec_id").join(_queries(spark, d).withColumnRenamed("embedding", "q"), "query_id")
    scored = found.select("query_id", "vec_id", F.greatest(F.lit(0.0), V.dot(F.col("embedding"), F.col("q"))).alias("score"), F.lit("ann").alias("source"))
    exact = V.exact_topk(_emb(spark, d), _queries(spark, d), K)
    exact = exact.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "vec_id", "score", F.lit("exact").alias("source"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = scored.unionByName(exact).withColumn("rank", rank).where(F.col("rank") <= K)
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "source", "rank")


def mean_vector(spark, d):
    out = V.mean_vector(_emb(spark, d), "label", "embedding")
    return out.select("label", F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def hash_embedding(spark, d):
    out = V.hash_embedding(A.files(spark, d).select("path", "text"))
    return out.select("path", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def chunks(spark, d):
    return C.chunks(A.files(spark, d)).drop("excerpt")


def best_chunk(spark, d):
    c = C.chunks(A.files(spark, d))
    out = C.best_chunk(c.withColumn("score", C.lexical_signal(F.col("excerpt"), QUERY, TERMS)))
    return out.select("path", "chunk_idx", "start_line", "end_line", F.round("score", 6).alias("score"))


def nearest_chunk(spark, d):
    f = A.files(spark, d)
    points = f.select("path", F.explode(F.array(F.lit(1), F.lit(7), F.lit(10_000))).alias("line"))
    return C.nearest_chunk(C.chunks(f).drop("excerpt", "chunk_hash"), points)


_KEY = "lower(lpad(printf('%x', {}), 4, '0'))"


def _key_sql(own: list[int]) -> str:
    bits = " + ".join(f"CASE WHEN embedding[{s + 1}] >= 0 THEN {1 << k} ELSE 0 END" for k, s in enumerate(own))
    return _KEY.format(f"CAST({bits} AS INTEGER)")


_KEYS = "keys AS (" + " UNION ALL ".join(
    f"SELECT vec_id, CAST({f} AS INTEGER) AS family, {_key_sql(own)} AS key FROM embeddings" for f, own in enumerate(V.slots(DIM))
) + ")"
_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_EXACT = f"""exact AS (SELECT a.vec_id AS query_id, b.vec_id, greatest(0.0, {_DOT}) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"""
_PROBED = """probed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bucket_hits DESC, vec_id) AS rank, count(*) OVER (PARTITION BY query_id) AS found
  FROM (SELECT q.vec_id AS query_id, k.vec_id, count(*) AS bucket_hits FROM keys k JOIN keys q USING (family, key) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2))"""
_LS = "CASE WHEN length(text) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(regexp_replace(text, '\\n\\z', ''), '\\r?\\n') END"
#: Greedy packing by recursion over lines.
_CHUNKS = f"""ln AS (SELECT path, {_LS} AS ls FROM files),
flat AS (SELECT path, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS k, unnest(list_transform(ls, lambda x: length(x) + 1)) AS need FROM ln),
walk AS (SELECT path, k, need AS used, 0 AS chunk_idx FROM flat WHERE k = 1
  UNION ALL SELECT f.path, f.k, CASE WHEN w.used + f.need > 1200 THEN f.need ELSE w.used + f.need END, CASE WHEN w.used + f.need > 1200 THEN w.chunk_idx + 1 ELSE w.chunk_idx END
  FROM walk w JOIN flat f ON f.path = w.path AND f.k = w.k + 1),
ch AS (SELECT path, CAST(chunk_idx AS INTEGER) AS chunk_idx, min(k) AS start_line, max(k) AS end_line FROM walk GROUP BY path, chunk_idx
  UNION ALL SELECT path, 0, 1, 1 FROM ln WHERE len(ls) = 0),
body AS (SELECT path, chunk_idx, start_line, end_line, array_to_string(ls[start_line:end_line], chr(10)) AS excerpt,
  coalesce(CASE WHEN start_line > 1 THEN ls[start_line - 1] END, '') AS before, coalesce(ls[end_line + 1], '') AS after FROM ch JOIN ln USING (path))"""

QUERIES = {
    "vector_topk": vector_topk,
    "ann_bucket_keys": ann_bucket_keys,
    "ann_probe": ann_probe,
    "ann_or_exact": ann_or_exact,
    "mean_vector": mean_vector,
    "hash_embedding": hash_embedding,
    "chunks": chunks,
    "best_chunk": best_chunk,
    "nearest_chunk": nearest_chunk,
}

ORACLES = {
    "vector_topk": f"""WITH {_EXACT} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM exact) WHERE rank <= {K}""",
    "ann_bucket_keys": f"WITH {_KEYS} SELECT * FROM keys",
    "ann_probe": f"""WITH {_KEYS}, {_PROBED} SELECT query_id, vec_id, bucket_hits, CAST(rank AS INTEGER) AS rank FROM probed WHERE found >= 6 AND rank <= 64""",
    "ann_or_exact": f"""WITH {_KEYS}, {_PROBED}, {_EXACT}, c AS (
  SELECT query_id, vec_id, 'ann' AS source FROM probed WHERE found >= 10 AND rank <= 120),
s AS (SELECT e.query_id, e.vec_id, e.score, coalesce(c.source, 'exact') AS source FROM exact e LEFT JOIN c USING (query_id, vec_id)
  WHERE c.source IS NOT NULL OR e.query_id NOT IN (SELECT query_id FROM c))
SELECT query_id, vec_id, round(score, 6) AS score, source, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}""",
    "mean_vector": """WITH e AS (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY label, pos)
SELECT label, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
    "chunks": f"""WITH RECURSIVE {A.FILES}, {_CHUNKS} SELECT path, chunk_idx, start_line, end_line,
  sha256(before || chr(10) || excerpt || chr(10) || after) AS chunk_hash FROM body""",
    "best_chunk": f"""WITH RECURSIVE {A.FILES}, {_CHUNKS}, s AS (SELECT *, least(1.0, (CAST(contains(lower(excerpt), 'license') AS INTEGER) + CAST(contains(lower(excerpt), 'mit') AS INTEGER)) / 2.0 * 0.72
  + CASE WHEN contains(lower(excerpt), '{QUERY}') THEN 0.25 ELSE 0 END + CASE WHEN starts_with(lower(excerpt), '{QUERY}') THEN 0.1 ELSE 0 END) AS score FROM body)
SELECT path, chunk_idx, start_line, end_line, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_idx) AS r FROM s) WHERE r = 1""",
    "nearest_chunk": f"""WITH RECURSIVE {A.FILES}, {_CHUNKS}, p AS (SELECT path, CAST(unnest([1, 7, 10000]) AS INTEGER) AS line FROM files)
SELECT path, line, chunk_idx, start_line, end_line FROM (SELECT p.path, p.line, chunk_idx, start_line, end_line, row_number() OVER (PARTITION BY p.path, p.line
  ORDER BY CASE WHEN start_line <= line AND line <= end_line THEN 0 ELSE abs(start_line - line) END, chunk_idx) AS r FROM p JOIN ch USING (path)) WHERE r = 1""",
}
