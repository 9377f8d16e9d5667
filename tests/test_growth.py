"""Steps whose work must not grow with the square of a group."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def test_neighbour_counts(spark):
    from quern.operators.neighbours import neighbour_counts

    rng = random.Random(5)
    rows = [(f"p{rng.randrange(300)}", rng.choice([rng.randrange(400), rng.randrange(6)])) for _ in range(1500)] + [("alone", 1000), ("p1", None), (None, 1)]
    near: dict[str, set] = {}
    for a, g in rows:
        near.setdefault(a, set()).update(b for b, h in rows if g is not None and h == g and b is not None)
    want = {a: len(s - {a}) for a, s in near.items() if a is not None and s - {a}}
    df = spark.createDataFrame(rows + rows[:50], "path string, commit int")
    for block in (20, 1000):  # many blocks, and one
        assert {r.path: r.neighbours for r in neighbour_counts(df, "path", "commit", block).collect()} == want


def test_git_risk_of_a_wide_commit(spark):
    """60 000 paths in each of two commits: 7 billion pairs of paths, which no join may form."""
    from quern.operators import quality as Q

    log = spark.range(60_000).select(F.col("id").alias("path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("commit"), F.lit("a").alias("author"), F.lit(1).alias("churn"))
    out = Q.git_risk(log).groupBy("git_cochange_neighbor_count").count().collect()
    assert [(r[0], r[1]) for r in out] == [(59_999, 60_000)]


def test_shared_dep_by_totals_and_at_nodes(spark):
    """What is counted or formed at a few files equals the edges of all pairs."""
    from quern.operators import graph as G

    rng = random.Random(7)
    deps = spark.createDataFrame(list({(f"f{rng.randrange(80)}", f"d{min(rng.randrange(60), rng.randrange(60))}") for _ in range(400)}), "path string, dep string").cache()
    direct = spark.createDataFrame([(f"f{i}", f"f{(i * 7) % 80}", "ref_exact", 1, 1.0) for i in range(1, 80) if i * 7 % 80 != i], "src string, dst string, kind string, raw_count long, weight double")
    edges = G.edges_shared_dep(deps)
    want = edges.groupBy("src", "kind").agg(F.count("*").alias("edges"), F.sum("raw_count").alias("raw_count"), F.round(F.sum("weight"), 6).alias("weight"))
    got = G.shared_dep_totals(deps).withColumn("weight", F.round("weight", 6))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seeds = spark.createDataFrame([("f1", 2.0), ("f2", 1.0), ("f3", 0.5)], "path string, score double")
    everything = direct.unionByName(edges)
    rows = lambda df: sorted((r.path, round(r.graph_score, 9), r.seed, r.hops, tuple(r.kinds)) for r in df.collect())
    assert rows(G.two_hop(direct, seeds, deps, G.degrees(everything))) == rows(G.two_hop(everything, seeds))


def test_facts_form_no_pairs_of_a_dependency(spark):
    """The facts of rules and the index ask for no table of shared dependencies."""
    from quern.operators import graph as G
    from quern.plans import q_code, q_fusion, q_routes

    def never(deps):
        raise AssertionError("pairs of files formed")

    was, G.edges_shared_dep = G.edges_shared_dep, never
    try:
        d = "/root/testdata/sf0.001/."
        for query in (q_code.rule_facts, q_fusion.index_tables, q_fusion.indexed_search, q_routes.ambiguous_edges):
            assert query(spark, d).count() > 0
    finally:
        G.edges_shared_dep = was


def test_neighbour_counts_marked_and_sorted(spark, monkeypatch):
    """Both ways of counting two blocks agree."""
    import numpy as np
    import pyarrow as pa

    from quern.operators import neighbours as N

    rng = np.random.default_rng(3)
    rows = [(rng.choice(300, rng.integers(2, 60), False).tolist(), rng.choice(500, rng.integers(2, 60), False).tolist()) for _ in range(200)]
    for j in (0, 1):
        t = pa.table({"i": [0] * 200, "j": [j] * 200, "left": [sorted(a) for a, _ in rows], "right": [sorted(a if j == 0 else b) for a, b in rows]})
        sets: dict = {}
        for a, b in zip(t["left"].to_pylist(), t["right"].to_pylist()):
            for x in a:
                sets.setdefault((0, x), set()).update((j, y) for y in b if (j, y) != (0, x))
                if j:
                    for y in b:
                        sets.setdefault((j, y), set()).add((0, x))
        want = sorted((*k, len(v)) for k, v in sets.items() if v)
        for sparse in (0, N.SPARSE):
            monkeypatch.setattr(N, "SPARSE", sparse)
            assert sorted(map(tuple, (r.values() for r in N._count(t).to_pylist()))) == want
        monkeypatch.undo()


def test_digests_are_sha256_of_sorted_items(spark):
    """Whole digests, also of a key whose rows span several Arrow batches."""
    import hashlib

    from quern.operators import incremental as I

    rows = spark.range(25_000).select(F.when(F.col("id") < 24_000, 1).otherwise(F.col("id") % 7 + 2).alias("k"), F.col("id").cast("string").alias("x"))
    want: dict = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append(hashlib.sha256(r.x.encode()).hexdigest())
    got = {r.k: (r.n_rows, r.fingerprint) for r in I.fingerprint(rows, "k", "x").collect()}
    assert got == {k: (len(v), hashlib.sha256("".join(sorted(v)).encode()).hexdigest()) for k, v in want.items()}


def test_token_estimate_counts_each_text_once(spark):
    """Presets share the passes over a text, and the counts are those of the plain classes."""
    import math
    import re

    from quern.functions import text as T

    texts = ["", "a", "_", "a_b c!", "\t\n\r\x0b\x0c x", "\x00\x08\x0e\x1f\x7f", "[\\]^_`{|}~", "é ñ\u0085漢字　𝒳!\n\n", "x" * 50 + "\n" + "#" * 9, None] + ["".join(map(chr, range(a, a + 16))) for a in range(0, 0x180, 16)]

    def plain(t, preset):
        if t is None:
            return 1
        n = lambda klass: len(re.sub(f"[^{klass}]", "", t))
        a, o, p, f = T.TOKEN_PRESETS[preset]
        punct = n(r"!-/:-@\[-^`{-~")
        other = len(re.sub(r"[\x00-\x7F" + OTHER + "]", "", t))
        total = n("A-Za-z0-9_") / a + (punct + n(r"\x00-\x08\x0E-\x1F\x7F")) * T.SYMBOL_WEIGHT + other / o + punct * p + n(r"\n") * f
        return 0 if not t else max(1, math.ceil(round(total, 6)))

    import inspect

    OTHER = re.search(r'ASCII\}\+", r"\[(.*?)\]\+"', inspect.getsource(T.token_estimate)).group(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", *[T.token_estimate(F.col("text"), p).alias(p) for p in T.TOKEN_PRESETS])
    for r in df.collect():
        assert tuple(r)[1:] == tuple(plain(texts[r.i], p) for p in T.TOKEN_PRESETS), repr(texts[r.i])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan  # a branch would keep presets from sharing their passes


def test_code_lines_cut_words_once(spark):
    """The words of a line are cut once, not for each variable of each template."""
    from quern.sources import adapters

    code = adapters.app_code(spark.createDataFrame([("python", "Ab cd ef\nx" + "y" * 47)], "language string, text string"))
    assert code._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
    assert code.first().text == "    # ab cd ef\nimport x" + "y" * 47 + ".x"


def test_vectors_by_tiles(spark, monkeypatch):
    """Tiles of scores give the same first ones as all scores at once, equal scores among them."""
    from quern.operators import vectors as V

    monkeypatch.setattr(V, "TILE_QUERIES", 3)
    monkeypatch.setattr(V, "TILE_VECTORS", 7)
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-1, 2)) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in V.exact_topk(df, df.where("vec_id % 9 = 0").withColumnRenamed("vec_id", "query_id"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, 90, 9):
        best = sorted((-max(0.0, sum(a * b for a, b in zip(rows[q][1], v))), i) for i, v in rows)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_seeds_meet_names_by_key(spark):
    """Seeds and names are joined on parts of names; every name that holds a seed is found, whatever its length."""
    from quern.operators import navigation as N

    seeds = ["license", "licensee-of-all", "e", "Él", "", "zz", " Of "]
    names = ["License", "licensee-of-all-things", "élan", "e", "zebra", "of", "proof"]
    symbols = spark.createDataFrame([(f"p{i}", n) for i, n in enumerate(names)], "path string, name string")
    out = N.lookup_symbols(spark.createDataFrame([(s,) for s in seeds], "seed string"), symbols, 100)
    want = {(s, f"p{i}", n, n == s.strip()) for s in seeds for i, n in enumerate(names) if s.strip().lower() in n.lower()}
    assert {tuple(r) for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_alike_lines_of_a_block_meet_without_its_lead(spark, monkeypatch):
    """All alike lines under one equal block are linked, whether or not the block's lead is one of them."""
    from quern.llm import line_dedup as L

    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdefghij ") for _ in range(40)).strip() for _ in range(8)]
    texts = [b + tail for b in bases for tail in ("", "x", "xyz")]
    monkeypatch.setattr(L, "PART_ROWS", 5)
    monkeypatch.setattr(L._links_within, "__defaults__", (5,))
    real = L.unit_blocks
    monkeypatch.setattr(L, "unit_blocks", lambda lines: real(lines).withColumn("blocks", F.array(*[F.lit(7).cast("long")] * L.BLOCKS)))
    lines = L.normalized_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    own = {r.unit: r.norm for r in lines.collect()}
    groups = {}
    for r in L.link_units(lines).collect():
        groups.setdefault(r.component_id, set()).add(own[r.id])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(b + t for t in ("", "x", "xyz")) for b in bases)


def test_sketches_keep_every_alike_pair(spark):
    """What the sketches of two lines rule out is never alike by edit distances, and unlike lines are mostly ruled out."""
    from quern.llm import line_dedup as L

    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinsrhldcumpgyz0.é") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts = []
    for size in (1, 3, 8, 14, 15, 16, 17, 24, 39, 41, 60, 400):
        for _ in range(3):
            own = [rng.choice(words) for _ in range(size)]
            texts.append(" ".join(own))
            for share in (0.03, 0.1, 0.16):
                chars = list(texts[-1])
                for _ in range(max(1, int(share * len(chars)))):
                    k = rng.randrange(len(chars))
                    chars[k : k + 1] = rng.choice(["", "x", chars[k] + "e"])
                texts.append("".join(chars))
                texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in own))
    lines = L.normalized_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    units = lines.select("unit").distinct()
    sketches = L.line_sketches(lines, units).cache()
    full = L.line_texts(lines, units).join(sketches.select("unit", *L.SKETCH), "unit").cache()
    side = lambda x: full.select(*[F.col(c).alias(f"{c}_{x}") for c in full.columns])
    both = side("a").join(side("b"), F.col("unit_a") < F.col("unit_b")).select(L._alike(0.85).alias("alike"), L._may_be_alike(0.85).alias("may"))
    n = {(r.alike, r.may): r["count"] for r in both.groupBy("alike", "may").count().collect()}
    assert n.get((True, False), 0) == 0 and n[True, True] > 50
    assert n[False, False] > 10 * n[False, True]
    # The join keeps the alike pairs too, whatever texts it lacks, in parts of a large key.
    pairs = L._links_within(sketches.withColumn("key", F.lit(1)).withColumn("comp", F.col("unit")), 0.85, 20)
    alike = side("a").join(side("b"), (F.col("unit_a") < F.col("unit_b")) & L._alike(0.85)).select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"))
    got = {tuple(r) for r in pairs.collect()}
    assert {tuple(r) for r in alike.collect()} <= got and len(got) < 2 * n[True, True]
