"""Registered clone and maintenance queries, and their oracles.

Two states of the corpus: the old one lacks every seventh document and has other text
in every fifth.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import aggregates as G1
from quern.operators import clones as K
from quern.operators import graph as G
from quern.operators import incremental as I
from quern.operators import json_values as J
from quern.plans.shared import once
from quern.sources import adapters as A
from quern.sources.sinks import materialize
from quern.sources.sinks import table_counts as count_tables


def _tokens(spark, d):
    return A.files(spark, d).select("path", T.token_list(F.col("text")).alias("words"))


def shingle_index(spark, d):
    s = K.shingle_index(_tokens(spark, d))
    return s.groupBy("path").agg(F.count("*").alias("windows"), F.min("start").alias("first"), F.max("n").alias("largest"))


def _runs(spark, d):
    return once(spark, d, "prose runs", lambda: materialize(K.exact_runs(_tokens(spark, d))))


def exact_clones(spark, d):
    return _runs(spark, d)


def nested_collapse(spark, d):
    r = _runs(spark, d)
    c = r.select(F.concat_ws("|", "f1", "f2", F.col("diagonal").cast("string"), F.col("start1").cast("string")).alias("class_id"), F.col("n_tokens").alias("tokens"), "f1", "start1")
    c = c.select("class_id", "tokens", F.col("f1").alias("path"), F.col("start1").alias("start"), (F.col("start1") + F.col("tokens") - 1).alias("end"))
    return K.nested_collapse(c)


def clone_file_facts(spark, d):
    t = _tokens(spark, d)
    return K.file_facts(_runs(spark, d), t.select("path", F.size("words").alias("n")))


def clone_classes(spark, d):
    t = _tokens(spark, d)
    c = K.clone_classes(_runs(spark, d), t)
    return c.groupBy("class_id").agg(F.max("tokens").alias("tokens"), F.count("*").alias("places"), F.countDistinct("path").alias("files"), F.min("path").alias("first")).drop("class_id")


def near_miss_clones(spark, d):
    return K.near_misses(_tokens(spark, d))


def _states(spark, d):
    f = A.table(spark, d, "documents")
    now = f.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    old = now.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.col("sha256")).alias("sha256"), (F.col("doc_id") % 11 != 0).alias("complete"))
    return now, old


def changed_since(spark, d):
    now, old = _states(spark, d)
    return I.changed(now, old).select("path", "status")


def prune_deleted(spark, d):
    """Files of the state that the present lacks: every fourth is gone, prefix 9 failed to read."""
    now, old = _states(spark, d)
    present = now.where("doc_id % 4 <> 0")
    failed = now.where("doc_id % 8 = 0")
    return I.pruned(old, present, failed, ["9"])


def _graph_states(spark, d):
    refs = A.refs(spark, d).where(F.length("symbol") >= A.SYMBOL_CHARS)
    symbols = A.symbols(spark, d)
    even = F.regexp_extract("path", r"(\d+)\.", 1).cast("long") % 10 == 3
    old_symbols = symbols.where(~even)
    return refs, symbols, old_symbols, symbols.where(even).select("path").distinct()


def delta_edges(spark, d):
    """Every tenth document gains its names: the delta must equal a full rebuild."""
    refs, symbols, old_symbols, dirty = _graph_states(spark, d)
    return I.delta_edges(G.edges_ref_exact(refs, old_symbols), refs, symbols, old_symbols, dirty)


def fingerprint(spark, d):
    return I.fingerprint(A.table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")


def privacy_hash(spark, d):
    f = A.files(spark, d).select("path", F.struct("path", "language").alias("hit"), F.array(F.struct("path")).alias("more"))
    return I.project_private(f, "hash").select("path", F.col("hit.path").alias("hit_path"), "hit.language", F.col("more")[0]["path"].alias("more_path"))


def privacy_mask(spark, d):
    return I.project_private(A.files(spark, d).select("path", "language"), "mask").groupBy("path", "language").agg(F.count("*").alias("n"))


def table_counts(spark, d):
    return count_tables({n: A.table(spark, d, n) for n in ("documents", "events", "lineitem", "orders", "embeddings")})


def top_languages(spark, d):
    return G1.top_languages(A.files(spark, d), 10)


def top_symbols(spark, d):
    s = A.refs(spark, d).select("path", F.col("symbol").alias("name"))
    return G1.top_symbols(s, 20)


def embedding_cache(spark, d):
    """Chunks as orders, cached vectors by key: hits, misses and broken entries."""
    e = A.table(spark, d, "embeddings")
    chunks = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_hash"))
    cache = e.select(F.col("vec_id").alias("chunk_hash"), F.when(F.col("vec_id") % 2 == 0, "m1").otherwise("m0").alias("model"), F.when(F.col("vec_id") % 8 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")).alias("vector"))
    return I.cached_vectors(chunks, cache, "m1", 64).groupBy("cache_state").agg(F.count("*").alias("n"))


def upsert_orders(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    from quern.sources.sinks import upsert

    new = o.where("o_orderkey % 9 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 10_000_000).otherwise(0)).alias("o_orderkey"), F.lit("U").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"))
    return upsert(o, new, "o_orderkey")


_TOK = """tk AS (SELECT path, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2) AS w FROM files),
sh AS (SELECT path, CAST(unnest(range(len(w) - 7)) AS INTEGER) AS start, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(w[i + 1:i + 8], ' '))) AS h FROM tk WHERE len(w) >= 8),
ix AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM sh) WHERE n BETWEEN 2 AND 12)"""
_RUNS = f"""{_TOK}, sx AS (SELECT path, CAST(unnest(range(len(w) - 31)) AS INTEGER) AS start, unnest(list_transform(range(len(w) - 31), lambda i: array_to_string(w[i + 1:i + 32], ' '))) AS h FROM tk WHERE len(w) >= 32),
ie AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM sx) WHERE n BETWEEN 2 AND 12),
hit AS (SELECT DISTINCT a.path AS f1, b.path AS f2, b.start - a.start AS diagonal, a.start AS s1 FROM ie a JOIN ie b ON a.h = b.h AND a.path < b.path),
wd AS (SELECT path, CAST(unnest(range(len(w))) AS INTEGER) AS pos, unnest(w) AS t FROM tk),
eq AS (SELECT f1, f2, diagonal, a.pos AS pos FROM (SELECT DISTINCT f1, f2, diagonal FROM hit) d JOIN wd a ON a.path = f1 JOIN wd b ON b.path = f2 AND b.pos = a.pos + diagonal AND b.t = a.t),
run AS (SELECT f1, f2, diagonal, min(pos) AS start1, count(*) AS n_tokens FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY f1, f2, diagonal ORDER BY pos) AS island FROM eq) i LEFT JOIN (SELECT f1, f2, diagonal, s1 AS pos, 1 AS seed FROM hit) USING (f1, f2, diagonal, pos)
  GROUP BY f1, f2, diagonal, island HAVING count(seed) > 0)"""


def artifact_states(spark, d):
    """Order lines as stored artifacts of their order, some of them lost, changed, added or never recorded."""
    li = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    cols = ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    stored = I.fingerprint(li.where("path % 13 <> 0 or path % 11 = 0"), "path", *cols)
    more = li.where("path % 7 = 0 and path % 11 <> 0").withColumn("l_linenumber", F.col("l_linenumber") + 100)
    now = li.where("path % 11 <> 0").withColumn("l_returnflag", F.when((F.col("path") % 5 == 0) & (F.col("path") % 7 != 0), "changed").otherwise(F.col("l_returnflag")))
    return I.verify_artifacts(stored, I.fingerprint(now.unionByName(more), "path", *cols)).groupBy("state").agg(F.count("*").alias("n"))


def json_members(spark, d):
    """Members of the events' properties, by key."""
    m = J.members(A.table(spark, d, "events"), "props", "event_type")
    return m.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def privacy_json(spark, d):
    """Search results of nested shape as JSON, masked and hashed by the names of their keys."""
    f = A.files(spark, d)
    hit = F.struct(
        "path", F.substring("sample", 1, 40).alias("excerpt"), F.col("size_bytes").alias("score"), F.struct(F.array("path", F.lit("a/")).alias("related_tests"), "language").alias("more")
    )
    name = F.substring_index("path", "/", -1)
    r = f.select(F.col("path").alias("file"), F.to_json(F.struct(F.concat("language", F.lit(" files")).alias("query"), F.array(hit).alias("hits"), F.concat(F.lit("no "), name).alias("error"))).alias("json"))
    return J.sanitized(r, "json", "mask").unionByName(J.sanitized(r, "json", "hash"))


def encoded_paths(spark, d):
    f = A.files(spark, d)
    return f.select("path", T.percent_encode(F.concat("path", F.lit(" &"), "language")).alias("encoded"))


QUERIES = {f.__name__: f for f in (
    shingle_index, exact_clones, nested_collapse, clone_file_facts, clone_classes, near_miss_clones, changed_since, prune_deleted, delta_edges, fingerprint, privacy_hash,
    privacy_mask, artifact_states, json_members, privacy_json, encoded_paths, table_counts, top_languages, top_symbols, embedding_cache, upsert_orders,
)}

ORACLES = {
    "shingle_index": f"WITH {A.FILES}, {_TOK} SELECT path, count(*) AS windows, min(start) AS first, max(n) AS largest FROM ix GROUP BY path",
    "exact_clones": f"WITH {A.FILES}, {_RUNS} SELECT * FROM run",
    "clone_classes": f"""WITH {A.FILES}, {_RUNS}, p AS (SELECT f1 AS path, start1 AS start, n_tokens FROM run UNION SELECT f2, start1 + diagonal, n_tokens FROM run),
c AS (SELECT array_to_string(w[start + 1:start + n_tokens], ' ') AS body, n_tokens, path FROM p JOIN tk USING (path))
SELECT max(n_tokens) AS tokens, count(*) AS places, count(DISTINCT path) AS files, min(path) AS first FROM c GROUP BY body""",
    "nested_collapse": f"""WITH {A.FILES}, {_RUNS}, c AS (SELECT f1 || '|' || f2 || '|' || diagonal || '|' || start1 AS class_id, n_tokens AS tokens, f1 AS path, start1 AS start, start1 + n_tokens - 1 AS "end" FROM run)
SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE a.path = b.path AND b.start <= a.start AND a."end" <= b."end" AND (b.tokens > a.tokens OR (b.tokens = a.tokens AND b.class_id < a.class_id)))""",
    "clone_file_facts": f"""WITH {A.FILES}, {_RUNS}, bo AS (SELECT f1 AS path, f2 AS peer, start1 AS start, n_tokens FROM run UNION ALL SELECT f2, f1, start1 + diagonal, n_tokens FROM run),
o AS (SELECT path, start, start + n_tokens - 1 AS e, CASE WHEN start > max(start + n_tokens - 1) OVER (PARTITION BY path ORDER BY start, start + n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS op, n_tokens FROM bo),
g AS (SELECT path, start, e, sum(op) OVER (PARTITION BY path ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS g FROM o),
s AS (SELECT path, count(*) AS blocks, sum(e - b + 1)::BIGINT AS duplicate_tokens FROM (SELECT path, g, min(start) AS b, max(e) AS e FROM g GROUP BY path, g) GROUP BY path),
p AS (SELECT path, count(DISTINCT peer) AS peers, max(n_tokens) AS max_tokens FROM bo GROUP BY path)
SELECT path, blocks, duplicate_tokens, peers, max_tokens, duplicate_tokens * 10000 // len(w) AS density_bps FROM s JOIN p USING (path) JOIN tk USING (path)""",
    "changed_since": """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'incomplete' END AS status
FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0""",
    "prune_deleted": """SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 4 = 0 AND doc_id % 8 <> 0 AND NOT starts_with(CAST(doc_id AS VARCHAR), '9')""",
    "delta_edges": f"""WITH {A.FILES}, {A.REFS}, {A.SYMBOLS} SELECT r.path AS src, s.path AS dst, 'ref_exact' AS kind, count(*) AS raw_count, CAST(count(*) AS DOUBLE) AS weight
  FROM refs r JOIN symbols s ON r.symbol = s.name WHERE r.path <> s.path AND length(r.symbol) >= {A.SYMBOL_CHARS} GROUP BY 1, 2""",
    "fingerprint": """SELECT l_orderkey, count(*) AS n_rows, sha256(array_to_string(list_sort(list(sha256(l_partkey || chr(31) || l_suppkey || chr(31) || l_linenumber || chr(31) || l_returnflag))), '')) AS fingerprint FROM lineitem GROUP BY l_orderkey""",
    "artifact_states": """WITH k AS (SELECT DISTINCT l_orderkey AS o FROM lineitem) SELECT CASE WHEN o % 11 = 0 THEN 'missing' WHEN o % 13 = 0 THEN 'unrecorded' WHEN o % 7 = 0 THEN 'count_differs' WHEN o % 5 = 0 THEN 'content_differs' ELSE 'ok' END AS state, count(*) AS n
FROM k GROUP BY 1""",
    "json_members": """SELECT event_type, key, count(*) AS n, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, key) AS value) GROUP BY event_type, key""",
    "privacy_json": f"""WITH {A.FILES}, r AS (SELECT path, language, regexp_replace(path, '.*/', '') AS name, substr(sample, 1, 40) AS head, size_bytes FROM files)
SELECT m.path AS file, json AS json FROM r m, LATERAL (SELECT '{{"query":"<redacted-query>","hits":[{{"path":"<masked:' || name || '>","excerpt":"<redacted-content>","score":' || size_bytes || ',"more":{{"related_tests":["<masked:' || name || '>","<masked:***>"],"language":"' || language || '"}}}}],"error":"operation failed (privacy_mode=mask); details redacted"}}' AS json)
UNION ALL SELECT m.path, json FROM r m, LATERAL (SELECT '{{"query":"<query-hash:' || substr(sha256(language || ' files'), 1, 12) || '>","hits":[{{"path":"<hash:' || substr(sha256(path), 1, 12) || '>","excerpt":"<content-hash:' || substr(sha256(head), 1, 12) || '>","score":' || size_bytes || ',"more":{{"related_tests":["<hash:' || substr(sha256(path), 1, 12) || '>","<hash:' || substr(sha256('a/'), 1, 12)
  || '>"],"language":"' || language || '"}}}}],"error":"operation failed (privacy_mode=hash); fingerprint=' || substr(sha256('no ' || name), 1, 12) || '"}}' AS json)""",
    "encoded_paths": f"""WITH {A.FILES} SELECT path, replace(replace(replace(replace(path || ' &' || language, '%', '%25'), ' ', '%20'), '&', '%26'), 'é', '%C3%A9') AS encoded FROM files""",
    "privacy_hash": f"""WITH {A.FILES}, h AS (SELECT 'h:' || substr(sha256(path), 1, 16) AS p, language FROM files) SELECT p AS path, p AS hit_path, language, p AS more_path FROM h""",
    "privacy_mask": f"WITH {A.FILES} SELECT '***.' || language AS path, language, count(*) AS n FROM files GROUP BY ALL",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("documents", "events", "lineitem", "orders", "embeddings")),
    "top_languages": f"WITH {A.FILES} SELECT language, count(*) AS files FROM files GROUP BY language ORDER BY files DESC, language LIMIT 10",
    "top_symbols": f"WITH {A.FILES}, {A.REFS} SELECT symbol AS name, count(*) AS n, count(DISTINCT path) AS files FROM refs WHERE length(symbol) >= 3 GROUP BY symbol ORDER BY n DESC, name LIMIT 20",
    "embedding_cache": """SELECT CASE WHEN vec_id IS NULL OR vec_id % 2 = 1 THEN 'miss' WHEN vec_id % 8 = 0 THEN 'corrupt' ELSE 'hit' END AS cache_state, count(*) AS n
FROM orders LEFT JOIN embeddings ON o_orderkey = vec_id GROUP BY 1""",
    "upsert_orders": """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderkey % 9 = 0 AND o_orderkey % 2 = 1)
UNION ALL SELECT o_orderkey + CASE WHEN o_orderkey % 2 = 0 THEN 10000000 ELSE 0 END, 'U', 1.0 FROM orders WHERE o_orderkey % 9 = 0""",
}
