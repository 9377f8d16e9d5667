"""Walks past what cannot be read, JSON of unknown shape, privacy by keys, stored digests, intents."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import extract, source_text
from quern.operators import incremental as M
from quern.operators import intent as N
from quern.operators import json_values as J
from quern.sources import tree


@pytest.fixture
def root(tmp_path):
    for rel, text in (("a.py", b"x = 1\n"), ("src/one.rs", b"fn a() {}\n"), ("src/deep/er/two.rs", b"fn b() {}\n"), ("src/bin.dat", b"a\0b"), ("target/x.rs", b"no"), ("big/big.txt", b"y" * (T.MAX_FILE_BYTES + 1)), ("lib/k.py", b"\xff\xfe caf\xc3\xa9")):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(text)
    os.symlink("loop", tmp_path / "lib" / "loop")
    return tmp_path


def test_walk(spark, root):
    files, errors = tree.walk_tree(spark, str(root))
    got = {r.path: r for r in files.collect()}
    assert set(got) == {"a.py", "src/one.rs", "src/deep/er/two.rs", "big/big.txt", "lib/k.py"}
    assert got["big/big.txt"].oversize and got["big/big.txt"].text is None and got["big/big.txt"].size_bytes == T.MAX_FILE_BYTES + 1
    assert got["a.py"].text == "x = 1\n" and got["a.py"].language == "python" and not got["a.py"].oversize
    assert "café" in got["lib/k.py"].text
    assert [(r.path, r.prefix) for r in errors.collect()] == [("lib/loop", None)]
    same = tree.scan_tree(spark, str(root)).select("path", "sha256")
    assert sorted(map(tuple, same.collect())) == sorted((r.path, r.sha256) for r in got.values() if not r.oversize)


def test_rows_of_an_unreadable_folder_stay(spark, root):
    files, errors = tree.walk_tree(spark, str(root), folders=["src", "gone/below"])
    assert [(r.path, r.prefix) for r in errors.collect()] == [("gone/below", "gone/below/")]
    state = spark.createDataFrame([("src/one.rs",), ("src/old.rs",), ("gone/below/kept.rs",), ("gone/other.rs",)], "path string")
    failed = errors.where("prefix is null")
    got = M.pruned(state, files, failed, errors)
    assert {r.path for r in got.collect()} == {"src/old.rs", "gone/other.rs"}
    assert {r.path for r in M.pruned(state, files, failed, ["gone/"]).collect()} == {"src/old.rs"}


def test_privacy_of_values():
    value = {"query": "find me", "hits": [{"path": "src\\a/b.rs", "score": 1, "paths": ["x/y.py"], "changed_paths": ["x/y.py", 3, None], "excerpt": "secret", "language": "rust"}], "error": "bad /x/y", "symbol": ["a", {"path": "/"}]}
    masked = J.sanitize_value("mask", value)
    assert masked == {
        "query": "<redacted-query>", "error": "operation failed (privacy_mode=mask); details redacted", "symbol": ["<redacted-content>", {"path": "<masked:***>"}],
        "hits": [{"path": "<masked:b.rs>", "score": 1, "paths": ["x/y.py"], "changed_paths": ["<masked:y.py>", 3, None], "excerpt": "<redacted-content>", "language": "rust"}],
    }
    hashed = J.sanitize_value("hash", value)
    assert hashed["query"].startswith("<query-hash:") and hashed["hits"][0]["path"].startswith("<hash:") and len(hashed["hits"][0]["path"]) == 19
    assert J.sanitize_value("hash", value) == hashed


def test_privacy_of_a_column(spark):
    rows = [(1, json.dumps({"path": "a/b", "n": 1})), (2, None), (3, "no json"), (4, "[]"), (5, '"text"')]
    df = spark.createDataFrame(rows, "id int, j string")
    assert {r.id: r.j for r in J.sanitized(df, "j", "mask").collect()} == {1: '{"path":"<masked:b>","n":1}', 2: None, 3: None, 4: "[]", 5: '"text"'}
    assert J.sanitized(df, "j", "off") is df
    with pytest.raises(ValueError):
        J.sanitized(df, "j", "veil")


def test_leaves(spark):
    rows = [(1, '{"a": {"b": [1, {"c": "x"}], "d": true}, "e": null}'), (2, "7"), (3, "{"), (4, None), (5, "{}")]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {(r.id, r.json_path, r.value) for r in J.leaves(df.where("id < 3"), "j", 4, "id").collect()}
    assert got == {(1, "$.a.b.0", "1"), (1, "$.a.b.1.c", '"x"'), (1, "$.a.d", "true"), (1, "$.e", "null"), (2, "$", "7")}
    assert J.members(df.where("id > 2"), "j", "id").where("key is not null").count() == 0
    picked = df.select("id", J.extract(F.col("j"), "$.a.b[1].c").alias("x")).collect()
    assert {r.id: r.x for r in picked} == {1: "x", 2: None, 3: None, 4: None, 5: None}


def test_encoded_paths(spark):
    cases = [("a b/c.rs", "a%20b/c.rs"), ("x*+~%.py", "x%2A%2B%7E%25.py"), ("café_-", "caf%C3%A9_-")]
    df = spark.createDataFrame(cases, "p string, w string")
    assert all(r.g == r.w for r in df.select(T.percent_encode(F.col("p")).alias("g"), "w").collect())


def test_artifact_states(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", None)], "path string, x int")
    stored = M.fingerprint(rows, "path", "x")
    assert {r.state for r in M.verify_artifacts(stored, M.fingerprint(rows.repartition(5), "path", "x")).collect()} == {"ok"}
    now = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 1), ("d", 1)], "path string, x int")
    got = {r.path: (r.state, r.complete) for r in M.verify_artifacts(stored, M.fingerprint(now, "path", "x")).collect()}
    assert got == {"a": ("content_differs", False), "b": ("count_differs", False), "c": ("missing", False), "d": ("unrecorded", False)}


def test_modes_of_agents(spark):
    modes = [(f"q {m}", m) for m in N.MODES] + [("auth boundary tests nearby backend frontend", None), ("mystery", None)]
    got = {r.query: r for r in N.resolve(spark.createDataFrame(modes, "query string, mode string")).collect()}
    e, t, r, c, s, f = (got[f"q {m}"] for m in N.MODES)
    assert e.prefers_backend and e.wants_api_surface and e.wants_service_layer and e.wants_entrypoints and not e.wants_tests and not e.wants_mod_runtime
    assert t.wants_tests and t.prefers_backend and t.wants_service_layer and not t.wants_api_surface and not t.wants_mod_runtime
    assert all(r[k] for k in N.FLAGS if k not in ("wants_hook", "wants_page", "wants_component"))
    assert c.prefers_backend and c.wants_api_surface and c.wants_service_layer and c.wants_entrypoints and not c.wants_tests
    assert s.prefers_backend and s.prefers_frontend and s.wants_hook and s.wants_mod_runtime and not s.wants_tests
    assert f.prefers_backend and f.prefers_frontend and f.wants_service_layer and f.wants_architecture and f.wants_tests and f.wants_mod_runtime and not f.wants_api_surface
    assert e.mode_source == "explicit"
    auth, plain = got["auth boundary tests nearby backend frontend"], got["mystery"]
    assert (auth.agent_mode, auth.mode_source) == ("test_map", "inferred") and (plain.agent_mode, plain.mode_source) == ("entrypoint_map", "default")


def test_chunk_seed_limit():
    assert [N.chunk_seed_limit(n, 0.2) for n in (30, 40, 120)] == [32, 40, 120]


# --- source text ---------------------------------------------------------------------------
RUST = '''use a::b; // use c::d;
/* fn gone() { /* nested { */ still gone() } */
pub fn open(url: &str) -> bool {
    let x = "http://host/{"; let c = '{'; let life: &'static str = r#"raw " { fn no() "#;
    call(x, '"') // done(
}
pub struct Pair { a: u8 }
'''
SCRIPT = '''import { a } from 'pkg'; // import b from 'no'
const s = "import c from 'not'"; const u = `multi
 ${x} function hidden() { ` + f(1);
export function shown(a, b) {
  return "}" + g('{'); /* h(
  h( */ }
class Box { run() { return 1 } }
'''
PY = '''import os  # import sys
def top(a, b):
    """Text with def inside(): and # marks
def not_me():
    """
    return call("# no comment(", '//') // other(1)  # gone(2)

class Box:
    @wrap
    def inner(
        self, x=")",
    ):
        return x
'''
JAVA = '''import java.util.List;
class App {
    String u = "http://x/{";
    /* void gone() { */
    int run(int a) { return helper(a, "}"); }
}
'''


def test_blanks_keep_places():
    for text, lang in ((RUST, "rust"), (SCRIPT, "javascript"), (PY, "python"), (JAVA, "java"), ("", "rust"), ("'", "python"), ('"abc', "java"), ("/* open", "rust"), ("`a\nb", "javascript"), ('r"x', "rust")):
        blank = source_text.blank_code(text, lang)
        assert len(blank) == len(text) and [k for k, c in enumerate(blank) if c == "\n"] == [k for k, c in enumerate(text) if c == "\n"]
        assert all(b == c or b == " " for b, c in zip(blank, text))


def names(text, language):
    g = extract.extract_graph(text, language)
    return [s[0] for s in g["symbols"]], [r[0] for r in g["refs"]], g["deps"]


def test_strings_and_comments_mislead_nothing():
    assert names(RUST, "rust") == (["open", "Pair"], ["call"], ["a::b"])
    symbols, refs, deps = names(SCRIPT, "typescript")
    assert "hidden" not in symbols and {"shown", "Box"} <= set(symbols) and refs[:2] == ["f", "g"] and "h" not in refs and deps == ["pkg"]
    assert names(PY, "python") == (["top", "Box", "inner"], ["call", "other"], ["os"])
    symbols, refs, deps = names(JAVA, "java")
    assert symbols == ["App", "run"] and refs == ["helper"] and deps == ["java.util.List"]


def test_spans_of_declarations():
    at = lambda text, lang, line: source_text.exact_span(source_text.blank_code(text, lang).split("\n"), lang, line)
    assert at(RUST, "rust", 4) == (3, 6) and at(RUST, "rust", 7) == (7, 7)
    assert at(SCRIPT, "javascript", 5) == (4, 6)
    assert at(PY, "python", 6) == (2, 7) and at(PY, "python", 11) == (9, 14)
    assert at("x = 1\n", "python", 1) is None and at(JAVA, "java", 2) is None


def test_bodies_fall_back(spark):
    schema = "path string, language string, text string"
    files = spark.createDataFrame([("a.rs", "rust", RUST), ("b.sql", "sql", "\n".join(f"line {k}" for k in range(1, 30))), ("c.py", "python", "x = 1\n" * 30), ("d.md", "markdown", ""), ("e.rs", "rust", "fn long() {\n" + "y" * 5000 + "\n}")], schema)
    chunks = spark.createDataFrame([("b.sql", 0, 1, 5, "one"), ("c.py", 0, 1, 4, "first"), ("c.py", 1, 5, 9, "second")], "path string, chunk_idx int, start_line int, end_line int, excerpt string")
    asked = spark.createDataFrame([("a.rs", "open", 4), ("b.sql", None, 10), ("c.py", None, None), ("d.md", None, 1), ("e.rs", "long", 1), ("gone.rs", "x", 1)], "path string, symbol string, line int")
    got = {r.path: r for r in source_text.symbol_bodies(asked, files, chunks).collect()}
    assert set(got) == {"a.rs", "b.sql", "c.py", "e.rs"}
    assert (got["a.rs"].how, got["a.rs"].start_line, got["a.rs"].end_line) == ("exact_symbol_span", 3, 6) and got["a.rs"].signature.startswith("pub fn open")
    assert (got["b.sql"].how, got["b.sql"].start_line, got["b.sql"].end_line) == ("nearest_indexed_lines", 8, 16)
    assert (got["c.py"].how, got["c.py"].body) == ("chunk_excerpt_anchor", "first")
    assert got["e.rs"].truncated and len(got["e.rs"].body) == 2000


def test_bodies_beyond_blank_lines():
    """Blank lines around an anchor, or a blank head, hide no text that a file has (as the SQL of body_ways counts)."""
    from quern.operators.source_text import body_of

    far = "\n" * 12 + "    a = b\n" + "\n" * 12
    assert body_of(far, "python", 3, (1, 25, far)) == ("nearest_indexed_lines", 11, 21, "a = b", "\n\n    a = b", False)
    assert body_of(far, "python", None, (1, 11, "\n" * 10)) == ("chunk_excerpt_anchor", 13, 24, "a = b", "    a = b", False)
    assert body_of("\n \n", "python", 3, None) is None and body_of("\n \n", "python", None, (1, 2, " ")) is None
