"""Routes, quality snapshots and duplication: small cases and plain re-computations."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import benchmarks, contracts
from quern.operators import clones as K
from quern.operators import duplication as D
from quern.operators import facts as X
from quern.operators import investigation as I
from quern.operators import navigation as N
from quern.operators import quality as Q
from quern.operators import snapshot as S


def files_of(spark, *paths, language="python"):
    return spark.createDataFrame([(p, language) for p in paths], "path string, language string")


EMPTY_REFS, EMPTY_SYMBOLS, EMPTY_DEPS = "path string, symbol string, pos int", "path string, name string", "path string, dep string"
EDGES = "src string, dst string, kind string, raw_count long, weight double"


# --- routes ------------------------------------------------------------------------------
def test_collapse_merges_neighbours(spark):
    rows = [("service", "src/services/a.rs", 0.4), ("service", "src/validators/b.rs", 0.9), ("query", "src/queries/c.sql", 0.5), ("service", "d", 0.1)]
    df = spark.createDataFrame([(rows,)], f"s array<{N.SEGMENT}>")
    got = df.select(N.collapse(F.col("s")).alias("c")).head().c
    assert [(x.kind, x.path, x.score) for x in got] == [("service", "src/services/a.rs", 0.9), ("query", "src/queries/c.sql", 0.5), ("service", "d", 0.1)]


def test_route_of_a_lone_service_has_gaps(spark):
    """A service with a model and a test of its name beside it, and no edge anywhere."""
    f = files_of(spark, "app/services/lab_service.py", "app/models/lab.py", "app/tests/test_lab_service.py")
    refs, symbols, deps = (spark.createDataFrame([], s) for s in (EMPTY_REFS, EMPTY_SYMBOLS, EMPTY_DEPS))
    seeds = spark.createDataFrame([("app/services/lab_service.py", "path")], "seed string, seed_kind string")
    hits = spark.createDataFrame([], "seed string, path string, score double")
    found = N.collect_candidates(seeds, f, symbols, hits, 5)
    targets = N.route_targets(N.prioritized_starts(found, 5), f, refs, symbols, deps)
    routes, gaps = N.route_trace(found, targets, spark.createDataFrame([], EDGES), 5)
    best = routes.collect()
    assert len(best) == 1 and best[0].segments[0].kind == "service" and best[0].hops == 0
    assert {(g.from_kind, g.to_kind, g.reason) for g in gaps.collect()} == {("service", "unknown", "call_path_unresolved:model"), ("service", "test", "call_path_unresolved:test")}
    assert N.capability(seeds, found, routes, gaps).head().status == "partial"


def test_routes_rank_and_dedupe(spark):
    f = files_of(spark, "app/api/origin.py", "app/crud/origin.py", "app/crud/other.py", "app/services/origin.py", "migrations/001_origin.sql")
    edges = [("app/api/origin.py", "app/crud/origin.py", "ref_exact", 3, 3.0), ("app/api/origin.py", "app/services/origin.py", "ref_exact", 1, 1.0), ("app/services/origin.py", "app/crud/other.py", "ref_exact", 1, 1.0), ("app/api/origin.py", "migrations/001_origin.sql", "shared_dep", 1, 0.35)]
    targets = [("app/api/origin.py", t) for t in ("app/crud/origin.py", "app/crud/other.py", "migrations/001_origin.sql", "app/services/origin.py")]
    seeds = spark.createDataFrame([("app/api/origin.py", "path")], "seed string, seed_kind string")
    found = N.collect_candidates(seeds, f, spark.createDataFrame([], EMPTY_SYMBOLS), spark.createDataFrame([], "seed string, path string, score double"), 5)
    routes, gaps = N.route_trace(found, spark.createDataFrame(targets, "start string, target string"), spark.createDataFrame(edges, EDGES), 5)
    got = [(r.rank, r.kinds, r.nodes) for r in routes.orderBy("rank").collect()]
    assert got[0] == (1, "endpoint>service>crud", ["app/api/origin.py", "app/services/origin.py", "app/crud/other.py"])
    assert [g[1] for g in got[1:]] == ["endpoint>crud", "endpoint>service"] and gaps.count() == 0
    assert N.capability(seeds, found, routes, gaps).head().status == "supported"


def test_candidates_of_every_kind(spark):
    f = files_of(spark, "a/one.py", "a/two.py")
    symbols = spark.createDataFrame([("a/one.py", "resolve"), ("a/two.py", "resolve_all"), ("a/two.py", "other")], EMPTY_SYMBOLS)
    hits = spark.createDataFrame([("resolve one", "a/one.py", 0.4), ("resolve one", "a/two.py", 0.9)], "seed string, path string, score double")
    seeds = spark.createDataFrame([(" a/one.py ", "path"), ("a/two.py:0", "path_line"), ("resolve", "symbol"), ("resolve one", "query"), ("gone.txt", "path")], "seed string, seed_kind string")
    got = {(r.seed_kind, r.path, r.symbol, r.line, r.match_kind, r.score, r.supported) for r in N.collect_candidates(seeds, f, symbols, hits, 1).collect()}
    assert got == {
        ("path", "a/one.py", None, None, "path_anchor", 1.0, True), ("path", "gone.txt", None, None, "path_anchor", 1.0, False), ("path_line", "a/two.py", None, 1, "path_anchor", 1.0, True),
        ("symbol", "a/one.py", "resolve", None, "exact_symbol", 1.0, True), ("query", "a/one.py", None, None, "query_search", 0.4, True), ("query", "a/two.py", None, None, "query_search", 0.9, True),
    }
    bad = spark.createDataFrame([("a/two.py", "path_line")], "seed string, seed_kind string")
    with pytest.raises(Exception, match="path:line"):
        N.collect_candidates(bad, f, symbols, hits, 1).collect()


def test_best_paths_against_all_walks(spark):
    rng = random.Random(5)
    nodes = "abcdefgh"
    edges = {(a, b, rng.choice(["ref_exact", "shared_dep", "other"])): rng.choice([0.25, 0.5, 1.0, 2.0]) for a in nodes for b in nodes if a != b and rng.random() < 0.3}
    cost = {}
    for (a, b, kind), w in edges.items():
        c = round((1 / max(w, 0.05) + {"ref_exact": 0.0, "shared_dep": 1.25}.get(kind, 0.75)) * 1e6)
        cost[a, b] = min(cost.get((a, b), (10**12, 0)), (c, -round(w * 1e6)))
    best = {}
    for hops in range(1, 7):
        for walk in itertools.product(nodes, repeat=hops + 1):
            steps = [cost.get(p) for p in zip(walk, walk[1:])]
            if None not in steps and walk[0] != walk[-1]:
                key = (sum(s[0] for s in steps), hops, sum(s[1] for s in steps), list(walk))
                if key < best.get((walk[0], walk[-1]), (10**15,)):
                    best[walk[0], walk[-1]] = key
        if hops == 4:
            break  # 8**5 walks are enough here
    df = spark.createDataFrame([(a, b, k, 1, w) for (a, b, k), w in edges.items()], EDGES)
    pairs = spark.createDataFrame(list(itertools.product(nodes, nodes)), "start string, target string")
    got = {(r.start, r.target): (round(r.cost * 1e6), r.hops, -round(r.weight * 1e6), r.nodes) for r in N.best_paths(df, pairs, 4).collect()}
    assert got == best


# --- quality -----------------------------------------------------------------------------
def test_gate(spark):
    schema = "path string, rule_id string, actual long, threshold long, severity string, category string"
    old = spark.createDataFrame([("a", "r", 5, 1, "low", "c"), ("b", "r", 5, 1, "low", "c")], schema)
    new = spark.createDataFrame([("a", "r", 6, 1, "low", "c"), ("b", "r", 5, 1, "low", "c")], schema)
    row = S.gate(old, new).head()
    assert (row.new_violations, row.resolved_violations, row.gate_status, row.reasons) == (1, 1, "regression", "new_violations=1")
    with pytest.raises(RuntimeError):
        S.require_ok(S.gate(old, new))
    S.require_ok(S.gate(new, new))
    assert S.gate(old, old, status="stale").head().reasons == "post_refresh_status=stale"
    gone = S.gate(old, new.limit(0)).head()
    assert (gone.gate_status, gone.resolved_violations) == ("ok", 2)


def test_snapshot_of_a_file(spark):
    files = spark.createDataFrame([("src/lib.rs", "rust", "pub const LINE: &str = \"v\";\n" * 320)], "path string, language string, text string")
    metrics = X.line_facts(files)
    rows = {(r.section, r.key, r.item): r.value for r in S.snapshot(files, metrics, Q.evaluate(metrics)).collect()}
    assert rows["totals", "", "violating_files"] == 1 and rows["totals", "", "total_non_empty_lines"] == 320
    assert rows["top_rules", "", "max_non_empty_lines_default"] == 1
    assert ("top_buckets", "directory", "src") in rows and ("top_files", "violation_count", "src/lib.rs") in rows
    empty = S.snapshot(files.limit(0), metrics.limit(0), Q.evaluate(metrics).limit(0))
    assert {r.item: r.value for r in empty.where("section = 'totals'").collect()}["evaluated_files"] == 0


def test_structure_and_dead_code_facts(spark):
    files = files_of(spark, "a.rs", "b.rs", "c.rs")
    fans = spark.createDataFrame([("a.rs", 21, 22), ("b.rs", 0, 1)], "path string, fan_in long, fan_out long")
    edges = spark.createDataFrame([("b.rs", "a.rs")], "src string, dst string")
    got = {(r.path, r.metric_id): r.value for r in X.structure_facts(files, fans, edges, spark.createDataFrame([("a.rs",)], "path string")).collect()}
    assert got["a.rs", "hub_module"] == 43 and got["c.rs", "orphan_module"] == 1 and got["a.rs", "module_cycle_member"] == 1 and ("b.rs", "hub_module") not in got
    exports = spark.createDataFrame([("a.rs", 1), ("b.rs", 2), ("c.rs", 3)], "path string, exported long")
    dead = X.dead_code_facts(exports, fans, spark.createDataFrame([], EMPTY_SYMBOLS)).where("metric_id = 'dead_code_candidate'")
    assert {r.path for r in dead.collect()} == {"b.rs", "c.rs"}


# --- duplication -------------------------------------------------------------------------
ALPHA = "export function {}(input: number): number {{\n  let total = input\n" + "".join(f"  total {{}} {n}\n" for n in range(1, 13)) + "  return total\n}}"


def test_match_step():
    left = [t for t, _ in K.normalize_code(ALPHA.format("alpha", *["+="] * 12))]
    right = [t for t, _ in K.normalize_code(ALPHA.format("beta", *["-=" if n in (3, 7, 11) else "+=" for n in range(1, 13)]))]
    i, j, common, edits, hits, ended = D.match_step(left, right, False, False, 0, 0, 8)
    assert ended and common >= 32 and edits == 3 and 100 * common // max(i, j) < 100 and len(hits) == common
    assert D.match_step(left, left, False, False, 0, 0, 32)[3] == 0  # no edit: not a near clone


def whole_match(x, y, anchor):
    return D.match_step(x, y, False, False, 0, 0, anchor)


def test_match_in_stretches_is_the_whole_match():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(6) for _ in range(120)]
        y = list(x)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(y))
            y[at : at + rng.randrange(3)] = [rng.randrange(6) for _ in range(rng.randrange(3))]
        i = j = common = edits = 0
        hits, ended, size = [], False, 30
        while not ended:
            a, b, common, edits, new, ended = D.match_step(x[i : i + size], y[j : j + size], i + size < len(x), j + size < len(y), common, edits, 8)
            hits += [i + h for h in new]
            i, j = i + a, j + b
        assert (i, j, common, edits, hits) == whole_match(x, y, 8)[:5]


def brute(files, window, floor=32):
    """Exact and near matches of token lists by trying every pair of places."""
    spots = {}
    for path, toks in files.items():
        for at in range(len(toks) - window + 1):
            spots.setdefault(tuple(toks[at : at + window]), []).append((path, at))
    out = set()
    for places in spots.values():
        if not 2 <= len(places) <= 12:
            continue
        for (f1, s1), (f2, s2) in itertools.combinations(sorted(places), 2):
            x, y = files[f1], files[f2]
            a, b = s1, s2
            while a and b and x[a - 1] == y[b - 1]:
                a, b = a - 1, b - 1
            if window == 32:
                n = next((k for k in range(min(len(x) - a, len(y) - b)) if x[a + k] != y[b + k]), min(len(x) - a, len(y) - b))
                ends, common, ok = (a + n, b + n), n, True
            else:
                i, j, common, edits, _, _ = whole_match(x[a:], y[b:], 8)
                ends, ok = (a + i, b + j), edits > 0 and 85 <= 100 * common // max(i, j) < 100
            apart = f1 != f2 or not (a < ends[1] and b < ends[0])
            if ok and common >= floor and apart:
                out.add((f1, a, ends[0], f2, b, ends[1], common))
    return out


@pytest.fixture(scope="module")
def token_files():
    rng = random.Random(9)
    base = [str(rng.randrange(40)) for _ in range(400)]
    files = {f"f{k}.py": [str(rng.randrange(40)) for _ in range(150)] for k in range(6)}
    files["f1.py"][20:20] = base[:70]
    files["f2.py"][40:40] = base[:70]
    files["f3.py"] = base[100:200] + files["f3.py"] + base[100:200]  # twice in one file
    near = base[200:400]
    files["f4.py"] += near
    files["f5.py"] = [t if k % 23 else "edit" for k, t in enumerate(near)] + files["f5.py"]
    return files


@pytest.fixture(scope="module")
def token_frame(spark, token_files):
    rows = [(p, "python", t, list(range(1, len(t) + 1))) for p, t in token_files.items()]
    df = spark.createDataFrame(rows, "path string, language string, values array<string>, lines array<int>")
    return df.withColumn("hashes", F.transform("values", lambda v: F.xxhash64(v)))


def test_exact_matches_against_every_pair(token_files, token_frame):
    got = {tuple(r)[:7] for r in D.exact_matches(token_frame).collect()}
    assert got == brute(token_files, 32)
    assert any(r[0] == r[3] == "f3.py" for r in got)


def test_near_matches_against_every_pair(token_files, token_frame):
    for stretch in (20, 256):
        got = {tuple(r[c] for c in ("f1", "a1", "e1", "f2", "a2", "e2", "common")) for r in D.near_matches(token_frame, stretch=stretch).collect()}
        assert got == brute(token_files, 8) and any(r[0] == "f4.py" for r in got)


def test_growth_in_short_stretches(token_files, token_frame):
    runs = D.seed_runs(token_frame, 32)
    a, b = ({tuple(r) for r in D.grown(runs, token_frame, stretch=s).collect()} for s in (3, 256))
    assert a == b


def test_classes_of_one_file_and_nested_ones(spark, token_frame):
    classes, members = D.clone_classes(token_frame, D.exact_matches(token_frame), D.near_matches(token_frame))
    kept = D.collapse_nested(classes, members).collect()
    assert any(c.same_file and c.tokens == 100 for c in kept) and any(c.similarity < 100 for c in kept)
    spans = {}
    for m in members.collect():
        s, e = spans.setdefault(m.class_id, {}).get(m.path, (m.start_line, m.end_line))
        spans[m.class_id][m.path] = (min(s, m.start_line), max(e, m.end_line))
    keep, order = [], sorted(classes.collect(), key=lambda c: (-c.tokens, -c.similarity, c.class_id))
    for c in order:  # one after another, against those kept
        inside = lambda o: spans[o].keys() == spans[c.class_id].keys() and all(spans[o][p][0] <= s and e <= spans[o][p][1] for p, (s, e) in spans[c.class_id].items())  # noqa: E731, B023
        if not any(o.language == c.language and o.same_file == c.same_file and inside(o.class_id) for o in keep):
            keep.append(c)
    assert {c.class_id for c in keep} == {c.class_id for c in kept}


PY_MODEL = "$attr dataclass class $id : $id : $id $id : $id $id : $id $id = $lit $id : $id $id = $lit".split()
JAVA_VIEW = "$attr $attr configurationproperties public class $id { private $id $id ; private $id $id ; private $id $id ; }".split()
JSX = "< $id classname = $lit > < $id variant = $lit > { children } </ $id > </ $id >".split()


@pytest.mark.parametrize("language,signature,flags,reason", [
    ("python", PY_MODEL, (True, False, False), "python_model_boilerplate"), ("java", JAVA_VIEW, (False, True, True), "java_annotation_wrapper"), ("tsx", JSX, (False, True, False), "jsx_wrapper_shell"),
    ("rust", "$attr pub struct $id < $lifetime > { $id : $id , }".split(), (False, False, False), "rust_macro_shell"), ("rust", "if $id { return $id ; } else { for $id in $id { } }".split(), (True, True, True), None),
    ("python", "$id = $id + $id return $id".split(), (False, False, False), None), ("typescript", "{ $id : $id , }".split(), (True, False, False), "model_or_schema_boilerplate"), ("python", [], (True, True, True), None),
])
def test_roles(spark, language, signature, flags, reason):
    df = spark.createDataFrame([(language, signature, *flags)], "l string, s array<string>, m boolean, w boolean, j boolean")
    got = df.select(D.signal_role(*[F.col(c) for c in "lsmwj"]).alias("r")).head().r
    assert (got.role, got.reason) == ("boilerplate" if reason else "primary", reason)


def test_corpus_classes(spark):
    cases = [
        ("src/world/SurfaceRules.test.ts", "typescript", "test"), ("crates/server/src/main_tests/tools_call.rs", "rust", "test"), ("crates/core/src/tests_quality/precision.rs", "rust", "test"),
        ("db/migrations/001_init.sql", "sql", "config"), ("frontend/src/generated/client.gen.ts", "typescript", "generated"), ("config/app/settings.toml", "toml", "resource"),
        ("api/routes/chapter_routes.py", "python", "production"), ("backend/alembic/versions/065_x.py", "python", "production"), ("a/old/x.py", "python", "backup"), ("target/x.rs", "rust", "artifact_cache"),
    ]
    df = spark.createDataFrame(cases, "p string, l string, want string")
    assert [r.got for r in df.select(D.corpus_class(F.col("p"), F.col("l")).alias("got"), "want").collect()] == [c[2] for c in cases]


def test_suppressions(spark):
    members = spark.createDataFrame([("1", "a/x.py"), ("1", "b/x.py"), ("2", "a/x.py"), ("2", "c/y.py"), ("3", "a/x.py"), ("3", "a/z.py"), ("4", "c/1"), ("4", "c/2")], "class_id string, path string")
    classes = members.select("class_id").distinct()
    rules = spark.createDataFrame([("r1", None, "^a/", "^b/", None), ("r2", None, "^a/", "^a/", None), ("r3", "4", None, None, None), ("r0", "4", None, None, "^d/"), ("r4", None, "^a/", "^c/", "^d/")], "suppression_id string, class_id string, left string, right string, scope string")
    assert dict(tuple(r) for r in D.suppress(classes, members, rules).select("class_id", "suppressed_by").collect()) == {"1": "r1", "2": None, "3": "r2", "4": "r3"}


def test_roles_of_paths(spark):
    cases = [("src/domain/origin_model.rs", "unknown", "model"), ("web/ui/use_origin.ts", "ui", "ui"), ("src/client/origin_client.ts", "api_client", "api_client"), ("src/routes/origin.rs", "endpoint", "endpoint"), ("src/queries/origin_query.sql", "query", "query")]
    df = spark.createDataFrame(cases, "p string, a string, b string")
    assert [tuple(r) for r in df.select(I.route_segment(F.col("p")), I.source_kind(F.col("p"))).collect()] == [c[1:] for c in cases]


# --- ladders and benchmarks ---------------------------------------------------------------
def signals(spark, constraints, tests=(), kinds=(("crud", "crud"), ("query", "query"))):
    """Signals of one seed with two variants, each an entry and one more segment."""
    variants = spark.createDataFrame([("s", "query", 1, "a.py", 0.5), ("s", "query", 2, "b.py", 0.5)], "seed string, seed_kind string, variant int, path string, confidence double")
    rows = [("s", "query", v, 0, p, "unknown", "unknown", 0.5) for v, p in ((1, "a.py"), (2, "b.py"))] + [("s", "query", v, 1, f"next{v}.py", *k, 0.5) for v, k in ((1, kinds[0]), (2, kinds[1]))]
    segments = spark.createDataFrame(rows, "seed string, seed_kind string, variant int, pos int, path string, kind string, source_kind string, score double")
    c = spark.createDataFrame(list(constraints), "path string, kind string, source string, strength string, text string")
    t = spark.createDataFrame(list(tests), "path string, test string")
    out = contracts.divergence_signals(variants, contracts.axis_values(variants, segments, c, t))
    return {r.axis: (r.state, r.severity, r.evidence_strength, r.reason) for r in out.collect()}, contracts.divergence_summary(out).head()


def test_divergence_ladder(spark):
    strong = lambda p, x: (p, "model_constraint", "model_declaration", "strong", x)
    got, whole = signals(spark, [strong("a.py", "unique x"), strong("b.py", "unique y")])
    assert got["constraint_evidence"] == ("divergence", "high_risk", "hard", "conflicting_hard_constraints")
    assert got["db_entities_and_queries"][3] == "db_query_without_test_backing" and got["entrypoints"][3] == "entrypoint_only" and got["test_coverage"] == ("missing", None, None, None)
    assert (whole.overall_severity, whole.manual_review) == ("high_risk", False)
    both = [strong("a.py", "unique x"), strong("b.py", "unique x")]
    tests = [("a.py", "t/a"), ("b.py", "t/b")]
    got, whole = signals(spark, both, tests, (("service", "service"), ("service", "service")))
    assert got["constraint_evidence"][0] == "consensus" and got["downstream_symbols"][1:] == ("likely_expected", "corroborated_proxy", "shared_backing_downstream_variation")
    assert got["test_coverage"][1:] == ("likely_expected", "proxy_only", "test_only") and not whole.manual_review
    guards = [("a.py", "runtime_guard", "runtime_guard_code", "weak", "if x"), ("b.py", "runtime_guard", "runtime_guard_code", "weak", "if y")]
    got, whole = signals(spark, guards, (), (("service", "service"), ("service", "service")))
    assert {got[a][3] for a in ("guards_and_validators", "predicate_signatures", "constraint_evidence")} == {"multi_axis_proxy_corroboration"} and whole.overall_severity == "suspicious"
    got, whole = signals(spark, [], (), (("service", "service"), ("service", "service")))
    assert got["downstream_symbols"][3] == "single_axis_proxy_only" and (whole.overall_severity, whole.manual_review) == ("likely_expected", True)


def test_affinity_and_roles(spark):
    cases = [("a/b/c.py", "a/b/d.py", 1.0), ("a/b/c.py", "a/x/d.py", 0.5), ("a/b/c.py", "x/b/d.py", 0.0), (None, "a/b.py", 0.0), ("a.py", "b.py", 0.0), ("A\\b\\c.py", "a/b/d/e.py", 1.0)]
    df = spark.createDataFrame(cases, "s string, p string, w double")
    assert all(r.g == r.w for r in df.select(contracts.path_affinity(F.col("s"), F.col("p")).alias("g"), "w").collect())
    roles = [("service", "service", "a/adapter.py", "adapter"), ("service", "validator", "x", "validator"), ("api_client", "", "x", "generated_client"), ("ui", "", "x", "consumer"), ("unknown", "", "my_adapter", "adapter"), ("unknown", "", "x", "unknown"), ("migration", "", "x", "schema_or_model")]
    df = spark.createDataFrame(roles, "k string, s string, p string, w string")
    assert all(r.g == r.w for r in df.select(contracts.contract_role(F.col("k"), F.col("s"), F.col("p")).alias("g"), "w").collect())


def test_contract_breaks(spark):
    seeds = spark.createDataFrame([("1", "query"), ("2", "query"), ("3", "query")], "seed string, seed_kind string")
    chain = [("1", "query", 8, "consumer", "ui/x", 1.0, False), ("2", "query", 4, "service", "s/x", 1.0, False), ("2", "query", 9, "test", "t/x", 1.0, False), ("2", "query", 7, "generated_client", "g/x", 1.0, True)]
    df = spark.createDataFrame(chain, "seed string, seed_kind string, step int, role string, path string, rank_score double, orphaned boolean")
    got = {(r.seed, r.reason, r.last_path) for r in contracts.contract_breaks(seeds, df).collect()}
    assert got == {
        ("1", "chain_ended_before_backend_contract_root", "ui/x"), ("1", "related_tests_not_found", "ui/x"), ("2", "schema_or_model_backing_not_found", "t/x"),
        ("2", "generated_target_without_source_of_truth", "g/x"), ("3", "related_tests_not_found", None),
    }


def test_bounds_and_costs(spark):
    m = spark.createDataFrame([("t", "recall", 0.8), ("t", "p95", 12.0)], "tool string, metric string, value double")
    b = spark.createDataFrame([("t", "recall", ">=", 0.8), ("t", "p95", "<=", 11.0), ("t", "gone", "<=", 1.0)], "tool string, metric string, comparator string, bound double")
    assert {r.metric: r.passed for r in benchmarks.threshold_gate(m, b).collect()} == {"recall": True, "p95": False, "gone": False}
    side = lambda tokens, recall: spark.createDataFrame([("t", "tokens", tokens), ("t", "recall", recall), ("t", "mrr", 0.5), ("t", "ndcg", 0.5)], "tool string, metric string, value double")
    ok = lambda a, b: benchmarks.cost_gate(a, b).head().passed
    assert ok(side(10.0, 0.5), side(9.0, 0.1)) and not ok(side(10.0, 0.5), side(11.0, 0.5)) and ok(side(10.0, 0.5), side(11.0, 0.6))
    runs = spark.createDataFrame([(k, "t", "p95", float(v)) for k, v in enumerate((5, 1, 9, 3))], "run int, tool string, metric string, value double")
    assert benchmarks.median_of_runs(runs).head().value == 4.0


def test_case_counts(spark):
    cases = spark.createDataFrame([("c1", "t"), ("c2", "t")], "case_id string, tool string")
    expected = spark.createDataFrame([("c1", "entry", "a", None), ("c1", "entry", "b", None), ("c1", "segment", "a", "service")], "case_id string, what string, key string, kind string")
    returned = spark.createDataFrame([("c1", "entry", 2, "a", None), ("c1", "entry", 4, "b", None), ("c1", "segment", 1, "a", "crud"), ("c2", "signal", 1, "z", None)], "case_id string, what string, rank int, key string, kind string")
    counts = benchmarks.case_counts(cases, expected, returned)
    got = {(r.case_id, r.what): tuple(r)[3:] for r in counts.collect()}
    assert got == {("c1", "entry"): (2, 2, 2, 2, 1, False, True), ("c1", "segment"): (1, 1, 1, 0, 1, True, True), ("c2", "signal"): (0, 1, 0, 0, 0, False, False)}
    rates = {r.metric: r.value for r in benchmarks.tool_metrics(counts).collect()}
    assert rates["entry_recall_at_3"] == 0.5 and rates["entry_success_at_1"] == 0.0 and rates["entry_success_at_3"] == 1.0 and rates["segment_type_precision"] == 0.0 and rates["signal_false_rate"] == 1.0
