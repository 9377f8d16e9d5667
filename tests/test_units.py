"""Literal cases of single operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunks, clones, evaluation, extract, fusion, graph, incremental, lexical, lines, quality, vectors
from quern.sources import globs, readers


def one(spark, col):
    return spark.range(1).select(col.alias("x")).head()[0]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 100)], "k string, v double")
    r = df.groupBy("k").agg(evaluation.percentile_nearest(F.col("v"), 0.5).alias("p50"), evaluation.percentile_nearest(F.col("v"), 0.95).alias("p95")).head()
    assert (r.p50, r.p95) == (3.0, 100.0)
    r = evaluation.percentile_rows(df, "k", "v", {"p50": 0.5, "p95": 0.95}).head()
    assert (r.p50, r.p95) == (3.0, 100.0)
    assert evaluation.median(df, "k", "v").head().median == 2.5


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, doc string, rank int")
    qrels = spark.createDataFrame([("q", "b", 1.0), ("q", "x", 1.0)], "query_id string, doc string, relevance double")
    r = evaluation.retrieval_metrics(hits, qrels, 2).head()
    assert r.recall == 0.5 and r.mrr == 0.5 and 0 < r.ndcg < 1


def test_text_functions(spark):
    assert T.escape_like("100%_done\\ok") == "100\\%\\_done\\\\ok"
    assert one(spark, T.symbol_tail(F.lit("a::b.c::d"))) == "d"
    assert one(spark, T.symbol_tail(F.lit("a.b"))) == "b"
    assert one(spark, T.match_key(F.lit("Éclair Straße œuvre"))) == "eclair strasse oeuvre"
    assert one(spark, T.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert one(spark, T.lines(F.lit(""))) == []
    assert one(spark, T.language_of(F.lit("src/app.MJS"))) == "javascript"
    assert one(spark, T.language_of(F.lit("Makefile"))) == "text"
    assert one(spark, T.is_ignored(F.lit("myenv/x.py")))
    assert one(spark, T.file_kind(F.lit("a/tests/x.py"))) == "test"
    assert one(spark, T.token_estimate(F.lit(""))) == 0
    assert one(spark, T.token_estimate(F.lit("hello world"))) == 3
    assert "needle" in one(spark, T.excerpt(F.lit("x" * 300 + " needle " + "y" * 300), F.lit("needle")))


@pytest.mark.parametrize(
    "pattern, path, want",
    [
        ("src", "src/a.rs", True), ("src", "srcs/a.rs", False), ("**/*.rs", "a/b/c.rs", True), ("**/*.rs", "c.rs", True), ("*.rs", "a/c.rs", False),
        ("a/{b,c{d,e}}.py", "a/ce.py", True), ("a/?.py", "a/x.py", True), ("a/[!x].py", "a/x.py", False), ("@(a|b).c", "b.c", True), ("+(ab).c", "abab.c", True),
        ("!(a|b).c", "a.c", False), ("!(a|b).c", "d.c", True), ("docs/**", "docs/x/y.md", True),
    ],
)
def test_globs(spark, pattern, path, want):
    assert one(spark, globs.scope(F.lit(path), include=[pattern])) is want


def test_gitignore(spark):
    rules = ["*.log", "!keep.log", "/build/", "doc/**/x"]
    ask = lambda p: one(spark, globs.gitignore(F.lit(p), rules))
    assert ask("a/b.log") and not ask("a/keep.log") and ask("build/x") and not ask("src/build.rs")
    with pytest.raises(ValueError):
        globs.expand_braces("{a,b}" * 13)


def test_query_profile():
    assert lexical.query_profile("a::b") == "precise"
    assert lexical.query_profile("why does it crash here now") == "bugfix"
    assert lexical.query_profile("where are the many small parts of this") == "exploratory"
    assert lexical.query_profile("three plain words") == "balanced"
    assert lexical.query_tokens("The the a Foo_bar") == ["foo_bar", "the"]


def test_chunks(spark):
    text = "\n".join(["x" * 500] * 3 + ["y" * 3000, "z"])
    rows = chunks.chunks(spark.createDataFrame([("p", text), ("e", "")], "path string, text string")).orderBy("path", "chunk_idx").collect()
    assert [(r.path, r.start_line, r.end_line) for r in rows] == [("e", 1, 1), ("p", 1, 2), ("p", 3, 3), ("p", 4, 4), ("p", 5, 5)]


def test_pack_budget(spark):
    rows = [("a", 50, 5), ("b", 60, 5), ("c", 40, 5)]
    out = fusion.pack_budget(spark.createDataFrame(rows, "path string, chars long, tokens long"), 100, 100, F.col("path"))
    assert {r.path: r.taken for r in out.collect()} == {"a": True, "b": False, "c": True}


def test_diversify():
    hits = [("1", "service", "a"), ("2", "service", "a"), ("3", "test", "a"), ("4", "api", "b")]
    # Wave 1 takes 1 (service of a) and 4 (api of b); root a is full for 2 and 3 there. The
    # next wave takes 2, whose role and root are new to it, and 3 of another role.
    assert fusion.diversify(hits) == ["1", "4", "2", "3"]


def test_risk_score_of_published_bucket():
    plain = 11 + 31 + 6 + 12 + 10.97 + 5 + 2.34
    assert round(plain + 5.6 * quality.WEIGHTS["complexity"] + 9 * quality.WEIGHTS["duplication"], 2) == 95.66


def test_multiset_diff(spark):
    f = lambda v: spark.createDataFrame([(x,) for x in v], "k string")
    out = {r.k: (r.new, r.resolved) for r in quality.multiset_diff(f("aab"), f("abbc"), "k").collect()}
    assert out == {"a": (0, 1), "b": (1, 0), "c": (1, 0)}


def test_cycles_and_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    assert {(r.path, r.cycle_id) for r in graph.cycle_members(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5)}
    w = e.select("src", "dst", F.lit("ref_exact").alias("kind"), F.lit(1.0).alias("weight"))
    p = graph.shortest_paths(w, spark.createDataFrame([(1,)], "start long"), 3)
    assert {(r.node, r.cost, r.hops) for r in p.collect()} == {(1, 0.0, 0), (2, 1.0, 1), (3, 2.0, 2), (4, 3.0, 3)}


def test_extraction():
    py = "import os\nfrom a.b import c\n\nclass K:\n    def f(self, x):\n        if x:\n            return g(x)  # h(1)\n        return os.path.join(x)\n"
    g = extract.extract_graph(py, "python")
    assert [(n, k) for n, k, *_ in g["symbols"]] == [("K", "class"), ("f", "def")]
    assert [r[0] for r in g["refs"]] == ["g", "os.path.join"] and g["deps"] == ["a.b", "os"]
    assert [r[0] for r in extract.extract_graph(py, "python", fidelity=True)["refs"]] == ["g", "h", "os.path.join"]
    m = extract.complexity(py, "python")
    assert m["max_cyclomatic_complexity"] == 2 and m["max_parameters_per_function"] == 2 and m["early_return_count"] == 1
    rs = "use std::fmt;\n/* fn no() {} */\npub fn run(a: u8) -> u8 {\n    if a > 1 { help(a) } else { 0 }\n}\n"
    g = extract.extract_graph(rs, "rust")
    assert [s[0] for s in g["symbols"]] == ["run"] and g["refs"][0][0] == "help" and g["deps"] == ["std::fmt"]
    assert extract.symbol_body(rs, "rust", 3)[:2] == (3, 5) and extract.symbol_body(py, "python", 5)[:2] == (5, 8)
    js = "import x from 'm';\nexport const f = (a) => g(a);\nclass C { }\n"
    g = extract.extract_graph(js, "typescript")
    assert [s[0] for s in g["symbols"]] == ["f", "C"] and g["deps"] == ["m"]
    assert extract.extract_graph("fn x() {}", "text")["symbols"] == []


def test_code_tokens():
    out = [t for t, _ in clones.normalize_code("let x = 'a; // no\n#[derive(A)] fn f() { y += 1.5; s == \"t\" }")]
    assert out[:4] == ["let", "$id", "=", "$lifetime"] and "$attr" in out and "+=" in out and "$num" in out and "$lit" in out


def test_security_smells(spark):
    text = "import subprocess\nsubprocess.run(c, shell=True)\nq = f\"select * from {t}\"\npickle.loads(b)\nopen(user_input)\n"
    df = spark.createDataFrame([("a/x.py", "python", text), ("a/x.md", "markdown", text)], "path string, language string, text string")
    out = {(r.kind, r.first_line) for r in lines.security_smells(df).collect()}
    assert out == {("shell_exec", 2), ("raw_sql", 3), ("unsafe_deserialize", 4), ("path_traversal", 5)}


def test_sensitive_data(spark):
    key = "AKIA" + "A1" * 8
    text = f"k {key}\nghp_{'a' * 20}\nsk-{'b' * 24}\n-----BEGIN PRIVATE KEY-----\n-----BEGIN RSA PRIVATE KEY-----\npassword = 'longenoughvalue'\ntoken = example_value_here\n"
    df = spark.createDataFrame([("p", text, len(text))], "path string, text string, size_bytes long")
    out = [(r.line_no, r.kind) for r in lines.sensitive_data(df).orderBy("line_no").collect()]
    assert out == [(1, "aws_access_key"), (2, "github_pat"), (3, "openai_api_key"), (4, "private_key"), (6, "credential_assignment")]


def test_vectors(spark):
    v = vectors.embed("hello world hello")
    assert abs((v * v).sum() - 1) < 1e-9 and not vectors.embed("").any()
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vectors.checked(df, 2).collect()] == [1]
    with pytest.raises(Exception, match="invalid vector"):
        vectors.checked(df, 2, fail_closed=True).collect()


def test_incremental(spark):
    state = spark.createDataFrame([("a", "1", True), ("b", "1", False), ("c", "1", True)], "path string, sha256 string, complete boolean")
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "path string, sha256 string")
    assert {(r.path, r.status) for r in incremental.changed(now, state).collect()} == {("b", "incomplete"), ("c", "changed"), ("d", "new")}
    assert incremental.compatible({"format": 1, "dim": 64}, {"format": 1, "dim": 192}) == ["dim"]
    with pytest.raises(ValueError):
        incremental.select_run(now, state, 1, now)
    hidden = incremental.project_private(spark.createDataFrame([("a/b.py", [("x.rs",)])], "path string, hits array<struct<path:string>>"), "mask").head()
    assert hidden.path == "***.py" and hidden.hits[0].path == "***.rs"


def test_readers(spark):
    text = '{"queries": [{"id": "1", "query": "a", "qrels": ["x", {"path": "y", "relevance": 2}]}, {"query": "b", "relevant_paths": ["z"]}]}'
    q, r = readers.benchmark_set(spark, text)
    assert q.count() == 2 and {tuple(x) for x in r.collect()} == {("1", "x", 1.0), ("1", "y", 2.0), ("1", "z", 1.0)}
    with pytest.raises(ValueError):
        readers.quality_policy('{"version": 3}')
    log = "\x1eabc\tme@x\n1\t2\ta.py\n-\t-\tb.bin\n"
    assert readers.parse_git_log(log) == [("a.py", "abc", "me@x", 3), ("b.bin", "abc", "me@x", 0)]


def test_index_of_a_tree(spark, tmp_path):
    from quern.plans import index

    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def helper(x):\n    return x\n")
    (tmp_path / "src/b.py").write_text("from a import helper\n\ndef run():\n    return helper(1)\n")
    (tmp_path / "src/c.bin").write_bytes(b"\x00\x01")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/d.py").write_text("x = 1\n")
    i = index.build(spark, str(tmp_path))
    assert sorted(r.path for r in i.files.collect()) == ["src/a.py", "src/b.py"]
    assert [(r.src, r.dst, r.kind) for r in i.edges.collect()] == [("src/b.py", "src/a.py", "ref_exact")]
    assert i.buckets.count() == 8


def test_refresh_stream(spark, tmp_path):
    from quern.streaming.refresh import refresh_stream

    seen = []
    src = str(tmp_path / "in")

    def go():
        q = refresh_stream(spark, src, "path string, text string", str(tmp_path / "state"), str(tmp_path / "ck"), lambda df: seen.append(sorted((r.path, r.status) for r in df.collect())))
        q.awaitTermination(60)

    spark.createDataFrame([("a", "1"), ("b", "1")], "path string, text string").coalesce(1).write.mode("append").parquet(src)
    go()
    spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "path string, text string").coalesce(1).write.mode("append").parquet(src)
    go()
    assert seen == [[("a", "new"), ("b", "new")], [("b", "changed"), ("c", "new")]]


def test_search_finds_files_by_graph_and_vectors(spark):
    from quern.operators import graph
    from quern.operators import vectors as V
    from quern.plans import search

    rows = [("src/a.py", "parse tokens with the lexer_helper and go"), ("src/b.py", "def of the lexer_helper in another place"), ("docs/c.md", "tokenise parsing tokenisers of parsed tokenss"), ("src/d.py", "nothing at all alike 0 1 2")]
    files = spark.createDataFrame([(p, p.rsplit(".", 1)[1], len(t), t) for p, t in rows], "path string, language string, size_bytes long, text string")
    refs = spark.createDataFrame([("src/a.py", "lexer_helper", 3)], "path string, symbol string, pos int")
    names = spark.createDataFrame([("src/b.py", "lexer_helper")], "path string, name string")
    vectors = V.hash_embedding(files.select("path", "text")).select("path", "vector")
    out = {r.path: r for r in search.search(files, "parse tokens", 4, edges=graph.edges_ref_exact(refs, names), vectors=vectors).collect()}
    assert out["src/a.py"].source == "mixed" and out["src/a.py"].rank == 1
    assert out["src/b.py"].graph_rank == 1 and out["src/b.py"].lexical_rank is None
    assert out["docs/c.md"].file_rank is not None
    plain = {r.path for r in search.search(files, "parse tokens", 4).collect()}
    assert "src/b.py" not in plain and "src/a.py" in plain
