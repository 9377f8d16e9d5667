"""SQL of the training-data queries that SQL can express, for DuckDB."""

from __future__ import annotations

#: Units are code points here, so ``length`` and ``substr`` do.
OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), h AS (
  SELECT doc_id, t, length(t) AS n,
    CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS one, greatest(h1 % (n + 1), h2 % (n + 1)) AS two,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substr(t, 1, one) AS prefix, substr(t, one + 1, two - one) AS middle, substr(t, two + 1) AS suffix FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN one END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN two - one END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""

#: CRC-32 by its table, a node as the list of its turns' digests, and a node's subtree by the path of its smallest member.
OP12 = """
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), crc(c, s, k, v) AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, s, k + 1, xor(v >> 8, t[(xor(v, ascii(s[k + 1])) & 255) + 1]) FROM crc, tab WHERE k < length(s)
), ids AS MATERIALIZED (
  SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = length(s)
), turns AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS rank, key, chars FROM (
    SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, rank) AS pos, key, chars FROM (
    SELECT ids.c, 0 AS part, rank, key, chars FROM ids JOIN turns ON turns.c = ids.c - ids.c % 100 WHERE rank <= h
    UNION ALL SELECT ids.c, 1, rank, key, chars FROM ids JOIN turns ON turns.c = ids.c WHERE rank > h)
), paths AS MATERIALIZED (
  SELECT c, pos AS depth, list(key) OVER (PARTITION BY c ORDER BY pos) AS node, chars, pos = count(*) OVER (PARTITION BY c) AS ends FROM rebuilt
  UNION ALL SELECT c, 0, [], 0, c NOT IN (SELECT c FROM rebuilt) FROM ids
), nodes AS MATERIALIZED (
  SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, min(chars) AS chars, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM paths GROUP BY node, depth
), kids AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), own AS MATERIALIZED (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)
), sums AS (
  SELECT paths.node, sum(CASE WHEN own.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((own.n_convs - 1) * own.chars) AS saved_tokens
  FROM own JOIN paths ON paths.c = own.conv_id AND paths.depth <= own.depth GROUP BY paths.node
)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(own.ends) AS ends_sha256
FROM own JOIN sums USING (node) LEFT JOIN nodes up ON own.depth > 0 AND up.node = own.node[1:own.depth - 1]
"""

#: Sets of shingles joined pairwise, links by the rule itself, components by closure.
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id
"""

SQL = {"op8_ngram_join": OP8, "op11_fill_in_middle": OP11, "op12_prefix_trie": OP12}
