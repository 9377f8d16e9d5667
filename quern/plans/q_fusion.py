"""Registered fusion and evaluation queries, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunks as C
from quern.operators import evaluation as E
from quern.operators import fusion as X
from quern.operators import lexical as L
from quern.operators import vectors as V
from quern.plans import q_routes as R
from quern.plans import search as S
from quern.plans.q_lexical import _BM, _POST, _Q, TERMS
from quern.sources import adapters as A

K, POOL = 20, 60


def _lexical(spark, d):
    hits = L.bm25(L.postings(A.files(spark, d)), TERMS)
    return L.top(hits.select("path", F.round("bm25", 6).alias("score")), "score", POOL)


def _sizes(spark, d):
    return A.files(spark, d).select("path", (F.length("text") * 1.0).alias("score")).orderBy(F.desc("score"), "path").limit(POOL)


def rrf_fusion(spark, d):
    """Two pools: BM25 hits and the longest documents."""
    out = X.fuse({"lexical": _lexical(spark, d), "graph": _sizes(spark, d)}, X.weights("balanced"), K)
    return X.explain(out).select("path", F.round("score", 6).alias("score"), F.round("rrf", 6).alias("rrf"), "rank_before", "rank_after", "source")


def anchor_retention(spark, d):
    """German documents as anchors among the longest ones."""
    f = A.files(spark, d).select("path", F.length("text").cast("double").alias("score"), (F.col("language") == "de").alias("anchor"))
    top = f.orderBy(F.desc("score"), "path").limit(POOL)
    return X.retain_anchors(top, 25)


def budget_pack(spark, d):
    """Every source's documents, the shortest first, into 12 000 characters and 3 000 tokens."""
    f = A.files(spark, d)
    hits = f.select(T.parent(F.col("path")).alias("source"), "path", F.length("text").alias("chars"), T.token_estimate(F.col("text")).alias("tokens"))
    return X.pack_budget(hits, 12_000, 3_000, F.col("tokens") % 7, F.col("path"), group="source")


def role_prior(spark, d):
    f = A.files(spark, d).select("path", "language")
    return f.select("path", *[F.round(X.role_prior(F.col("path"), F.col("language"), m), 6).alias(m) for m in X.ROLE_PRIORS])


def confidence(spark, d):
    e = A.table(spark, d, "events")
    z = lambda n: (F.col("event_id") % n) / n
    c = X.confidence(z(11), z(7), F.lit(1.0), z(5), z(3), z(13), F.col("event_id") % 17 == 0, F.col("event_id") % 4 == 0)
    return e.select("event_id", F.round(c, 6).alias("confidence"))


def hybrid_search(spark, d):
    return S.hybrid_search(spark, d, "open license terms", K)


def index_tables(spark, d):
    """The index that the searches below read: built where it is not yet, and counted."""
    from quern.sources.sinks import table_counts

    i = S.documents_index(spark, d)
    counts = table_counts({"files": i.files, "postings": i.postings, "symbols": i.symbols, "refs": i.refs, "deps": i.deps, "vectors": i.vectors})
    # An edge leaves one file; those of shared dependencies are counted by degree, as no table holds them.
    return counts.unionByName(i.degrees.agg(F.coalesce(F.sum("out_count"), F.lit(0)).alias("n_rows")).select(F.lit("edges").alias("table_name"), "n_rows"))


def indexed_search(spark, d):
    """A question that asks for services and tests, over the written tables of an index."""
    return S.indexed_search(spark, d, "service tests for license terms", K)


def agent_search(spark, d):
    """The same tables searched as an agent that maps interfaces."""
    return S.indexed_search(spark, d, "open license terms", K, "api_contract_map")


def recall_mrr_ndcg(spark, d):
    """Vector search judged by labels: the ten nearest of every fiftieth vector."""
    emb = A.table(spark, d, "embeddings")
    q = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("q_label"))
    hits = V.exact_topk(emb, q.select("query_id", "embedding"), 10).select("query_id", F.col("vec_id").alias("doc"), "rank")
    qrels = q.select("query_id", "q_label").join(emb, F.col("label") == F.col("q_label"))
    qrels = qrels.select("query_id", F.col("vec_id").alias("doc"), (1 + F.col("vec_id") % 2).cast("double").alias("relevance"))
    out = E.retrieval_metrics(hits, qrels, 10)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def latency_percentiles(spark, d):
    e = A.table(spark, d, "events")
    p = E.percentile_rows(e, "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return p.join(E.median(e, "event_type", "value"), "event_type").select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "median")])


def gate_eval(spark, d):
    """Purchases against views as a baseline and a candidate run."""
    e = A.table(spark, d, "events")

    def run(kind):
        own = e.where(F.col("event_type") == kind)
        return own.agg(
            F.avg(F.col("user_id") % 10 / 10).alias("recall"), F.avg(F.col("user_id") % 7 / 7).alias("mrr"), F.avg(F.col("user_id") % 3 / 3).alias("ndcg"),
            F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.avg("value").alias("tokens"),
        )

    out = E.gates(run("purchase"), run("view"))
    return out.select("category", "metric", *[F.round(c, 5).alias(c) for c in ("baseline", "candidate", "bound")], "pass")


def rollout_bucket(spark, d):
    f = A.files(spark, d).select("path")
    return f.select("path", E.rollout_bucket(F.col("path")).alias("bucket"), E.rolled_out(F.col("path"), 25).alias("in_phase"))


def chunk_lexical(spark, d):
    c = C.chunks(A.files(spark, d))
    out = C.best_chunk(c.withColumn("score", C.lexical_signal(F.col("excerpt"), "open license terms", TERMS)))
    return out.groupBy(F.round("score", 6).alias("score")).agg(F.count("*").alias("files"))


_TOP = f"""lex AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS r FROM (SELECT path, round(bm25, 6) AS score FROM bm ORDER BY score DESC, path LIMIT {POOL})),
gra AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS r FROM (SELECT path, length(text)::DOUBLE AS score FROM files ORDER BY score DESC, path LIMIT {POOL}))"""
_CL = "greatest({1}, least({2}, {0}))"

QUERIES = {f.__name__: f for f in (
    rrf_fusion, anchor_retention, budget_pack, role_prior, confidence, hybrid_search, index_tables, indexed_search, agent_search, recall_mrr_ndcg, latency_percentiles, gate_eval, rollout_bucket, chunk_lexical,
)}

ORACLES = {
    "index_tables": rf"""WITH {A.APP}, {R._EDGES} SELECT 'files' AS table_name, count(*) AS n_rows FROM files UNION ALL SELECT 'vectors', count(*) FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols
UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'deps', count(*) FROM deps UNION ALL SELECT 'edges', count(*) FROM ed
UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT path, unnest(list_filter(regexp_split_to_array(lower(path || ' ' || text), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2)) AS term FROM files)""",
    "rrf_fusion": f"""WITH {A.FILES}, {_POST}, {_Q}, {_BM}, {_TOP}, f AS (SELECT coalesce(l.path, g.path) AS path, l.r AS lr, g.r AS gr,
  coalesce(0.40 / (60.0 + l.r), 0) + coalesce(0.14 / (60.0 + g.r), 0) AS rrf, coalesce(l.score, 0) AS ls FROM lex l FULL JOIN gra g ON l.path = g.path),
s AS (SELECT *, rrf + 0.012 * ls AS score FROM f), t AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS k FROM s)
SELECT path, round(score, 6)::DOUBLE AS score, round(rrf, 6)::DOUBLE AS rrf, coalesce(lr, gr)::INTEGER AS rank_before, k::INTEGER AS rank_after, CASE WHEN lr IS NOT NULL THEN 'lexical' ELSE 'graph' END AS source FROM t WHERE k <= {K}""",
    "anchor_retention": f"""WITH {A.FILES}, t AS (SELECT path, length(text)::DOUBLE AS score, language = 'de' AS anchor FROM files ORDER BY score DESC, path LIMIT {POOL}),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path)::INTEGER AS rank FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY rank) AS k FROM r WHERE rank > 25 AND anchor), w AS (SELECT *, row_number() OVER (ORDER BY rank DESC) AS k FROM r WHERE rank <= 25 AND NOT anchor),
n AS (SELECT least((SELECT count(*) FROM o), (SELECT count(*) FROM w)) AS n)
SELECT path, score, anchor, rank FROM r WHERE rank <= 25 AND path NOT IN (SELECT path FROM w, n WHERE k <= n) UNION ALL SELECT path, score, anchor, rank FROM o, n WHERE k <= n""",
    "recall_mrr_ndcg": """WITH q AS (SELECT vec_id AS query_id, embedding AS e, label FROM embeddings WHERE vec_id % 50 = 0),
x AS (SELECT query_id, vec_id AS doc, row_number() OVER (PARTITION BY query_id ORDER BY greatest(0.0, list_dot_product(e::DOUBLE[], embedding::DOUBLE[])) DESC, vec_id) AS rank FROM q, embeddings),
h AS (SELECT * FROM x WHERE rank <= 10), j AS (SELECT query_id, vec_id AS doc, (1 + vec_id % 2)::DOUBLE AS rel FROM q JOIN embeddings b USING (label)),
i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN r <= 10 THEN (pow(2, rel) - 1) / log2(r + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc) AS r FROM j) GROUP BY query_id),
f AS (SELECT query_id, count(*) AS hit, min(rank) AS first, sum((pow(2, rel) - 1) / log2(rank + 1)) AS dcg FROM h JOIN j USING (query_id, doc) GROUP BY query_id)
SELECT query_id, round(coalesce(hit, 0) / n, 6) AS recall, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM i LEFT JOIN f USING (query_id)""",
    "role_prior": f"WITH {A.FILES} SELECT path, 0.0::DOUBLE AS code, 0.0::DOUBLE AS design, 0.0::DOUBLE AS bugfix FROM files",
    "confidence": f"""WITH z AS (SELECT event_id, (event_id % 11) / 11 AS m, (event_id % 7) / 7 AS s, (event_id % 5) / 5 AS dr, (event_id % 3) / 3 AS pr, (event_id % 13) / 13 AS pl FROM events),
c AS (SELECT *, (0.45::DOUBLE * m / (m + 0.30::DOUBLE) + 0.35::DOUBLE * {_CL.format('0.35::DOUBLE + 0.65::DOUBLE * s', '0.0', '1.0')} + 0.20::DOUBLE * (1 - dr)) * {_CL.format('1.0::DOUBLE - 0.55::DOUBLE * pr - 0.75::DOUBLE * pl', '0.25::DOUBLE', '1.0')} AS v FROM z)
SELECT event_id, round({_CL.format("v * CASE WHEN event_id % 17 = 0 THEN 0.55::DOUBLE ELSE 1 END * CASE WHEN event_id % 4 = 0 THEN greatest(0.45::DOUBLE, least(0.85::DOUBLE, 0.85::DOUBLE - 0.25::DOUBLE * dr)) ELSE 1 END", '0.0', '1.0')}, 6)::DOUBLE AS confidence FROM c""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(value) FILTER (r = floor((n - 1) * 0.5 + 0.5)), 6) AS p50, round(max(value) FILTER (r = floor((n - 1) * 0.95::DOUBLE + 0.5)), 6) AS p95, round(median(value), 6) AS median FROM r GROUP BY event_type""",
    "gate_eval": """WITH m AS (SELECT event_type AS k, avg(user_id % 10 / 10) AS recall, avg(user_id % 7 / 7) AS mrr, avg(user_id % 3 / 3) AS ndcg, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, avg(value) AS tokens FROM events GROUP BY 1),
b AS (SELECT * FROM m WHERE k = 'purchase'), c AS (SELECT * FROM m WHERE k = 'view'), g AS (
  SELECT 'quality' AS category, 'recall' AS metric, b.recall AS bl, c.recall AS cd, b.recall * 0.98::DOUBLE AS bd, c.recall >= b.recall * 0.98::DOUBLE AS pass FROM b, c
  UNION ALL SELECT 'quality', 'mrr', b.mrr, c.mrr, b.mrr * 0.98::DOUBLE, c.mrr >= b.mrr * 0.98::DOUBLE FROM b, c
  UNION ALL SELECT 'quality', 'ndcg', b.ndcg, c.ndcg, b.ndcg * 0.98::DOUBLE, c.ndcg >= b.ndcg * 0.98::DOUBLE FROM b, c
  UNION ALL SELECT 'latency', 'p50', b.p50, c.p50, b.p50 * 1.2::DOUBLE, c.p50 <= b.p50 * 1.2::DOUBLE FROM b, c
  UNION ALL SELECT 'latency', 'p95', b.p95, c.p95, least(b.p95 * 1.12::DOUBLE, b.p95 + 30), c.p95 <= least(b.p95 * 1.12::DOUBLE, b.p95 + 30) FROM b, c
  UNION ALL SELECT 'token_cost', 'tokens', b.tokens, c.tokens, b.tokens * 1.05::DOUBLE, c.tokens <= b.tokens * 1.05::DOUBLE AND (c.tokens <= b.tokens OR c.recall > b.recall OR c.mrr > b.mrr OR c.ndcg > b.ndcg) FROM b, c)
SELECT category, metric, round(bl, 5) AS baseline, round(cd, 5) AS candidate, round(bd, 5) AS bound, pass FROM g""",
    "rollout_bucket": f"""WITH {A.FILES}, b AS (SELECT path, CAST('0x' || substr(sha256(path), 1, 8) AS BIGINT) % 100 AS bucket FROM files) SELECT path, bucket, bucket < 25 AS in_phase FROM b""",
}
