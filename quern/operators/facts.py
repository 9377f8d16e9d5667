"""Facts of files as metrics for the rules: structure, layers, history, smells, tests, dead code, clones.

Every function returns rows ``(path, metric_id, value)``; a fact that does not hold gives
no row. :func:`quern.operators.quality.evaluate` turns them into violations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import lines as L
from quern.operators import quality as Q

# --- fixed values: when a file is a hot spot, small enough to be dead, an entry point ----
FAN_LIMIT = 20
HOT_POINTS = (("non_empty_lines", 300, 2), ("fan_in_count", 20, 4), ("fan_out_count", 20, 4), ("max_cyclomatic_complexity", 12, 4), ("max_cognitive_complexity", 18, 4), ("duplicate_density_bps", 1_500, 2))
HOT_SCORE = 6
DEAD_SYMBOLS, DEAD_FAN_OUT = 24, 1
DEAD_LANGUAGES = ("rust", "python", "javascript", "jsx", "mjs", "cjs", "typescript", "tsx")
DEAD_PATHS = ("/tests/", "/examples/", "/benches/", "/target/", "/generated/")
DEAD_ENDS = ("/main.rs", "/lib.rs", "/mod.rs", "/build.rs")
REGISTRY = ("inventory::submit!", "linkme::distributed_slice", "#[no_mangle]", "proc_macro", "register_plugin", "register_handler", "plugin_registry")
EXPORTS = {
    "rust": ("pub fn ", "pub(crate) fn ", "pub struct ", "pub enum ", "pub trait ", "pub const ", "pub static "),
    "script": ("export function ", "export const ", "export class ", "export default "),
}
ENTRY_PATH = r"(^|/)(api|routes|router|handlers|controllers)/|(^|/)(main|app|server)\.[^/]*$"
INTEGRATION_PATH = r"/integration/|/e2e/|integration"
NEAR = 1


def _flag(df: DataFrame, name: str, value: Column | int = 1) -> DataFrame:
    return df.select("path", F.lit(name).alias("metric_id"), (value if isinstance(value, Column) else F.lit(value)).cast("long").alias("value"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def line_facts(files: DataFrame) -> DataFrame:
    """Size, lines by file kind, longest line and imports."""
    m = L.line_metrics(files).select("path", "non_empty_lines", "max_line_length", "import_count")
    m = m.join(files.select("path", F.octet_length("text").alias("size_bytes"), T.file_kind(F.col("path")).alias("kind")), "path")
    for kind in ("default", "test", "config"):
        m = m.withColumn(f"non_empty_lines_{kind}", F.when(F.col("kind") == kind, F.col("non_empty_lines")))
    return Q.long_metrics(m, "size_bytes", "non_empty_lines", "non_empty_lines_default", "non_empty_lines_test", "non_empty_lines_config", "max_line_length", "import_count")


def index_facts(symbols: DataFrame, refs: DataFrame, deps: DataFrame) -> DataFrame:
    """Names defined, references made and modules depended on, counted by file."""
    n = lambda df, k: _flag(df.groupBy("path").agg(F.count("*").alias("n")), k, F.col("n"))
    return union(n(symbols, "symbol_count"), n(refs, "ref_count"), n(deps, "module_dep_count"))


def structure_facts(files: DataFrame, fans: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """Fan-in and fan-out of ``fans``, edges out, members of ``cycles``, hubs and orphans.

    A hub has both fans above the limit, and counts their sum; an orphan has no edge at all.
    """
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n"))
    hub = fans.where((F.col("fan_in") > FAN_LIMIT) & (F.col("fan_out") > FAN_LIMIT))
    alone = files.select("path").join(fans.where("fan_in + fan_out > 0").select("path"), "path", "left_anti")
    return union(
        Q.long_metrics(fans.select("path", F.col("fan_in").alias("fan_in_count"), F.col("fan_out").alias("fan_out_count")), "fan_in_count", "fan_out_count"),
        _flag(out, "graph_edge_out_count", F.col("n")),
        _flag(cycles, "module_cycle_member"),
        _flag(hub, "hub_module", F.col("fan_in") + F.col("fan_out")),
        _flag(alone, "orphan_module"),
    )


def layer_facts(verdicts: DataFrame) -> DataFrame:
    """Edges by verdict of :func:`quern.operators.graph.layering`, counted at their source.

    ``layering_cross_edge_count`` is what a cross-layer violation counts: all three kinds,
    where there is a forbidden one or one out of direction.
    """
    count = lambda *v: F.count_if(F.col("verdict").isin(*v))
    g = verdicts.groupBy(F.col("src").alias("path")).agg(
        count("forbidden").alias("layering_forbidden_edge_count"),
        count("out_of_direction").alias("layering_out_of_direction_edge_count"),
        count("unmatched").alias("layering_unmatched_edge_count"),
        count("forbidden", "out_of_direction", "unmatched").alias("all"),
    )
    crossed = F.when(F.col("layering_forbidden_edge_count") + F.col("layering_out_of_direction_edge_count") > 0, F.col("all"))
    g = g.withColumn("layering_cross_edge_count", crossed)
    return Q.long_metrics(g, "layering_forbidden_edge_count", "layering_out_of_direction_edge_count", "layering_unmatched_edge_count", "layering_cross_edge_count")


def history_facts(log: DataFrame) -> DataFrame:
    g = Q.git_risk(log)
    return Q.long_metrics(g, *[c for c in g.columns if c != "path"])


def smell_facts(files: DataFrame) -> DataFrame:
    s = L.security_smells(files).groupBy("path", "kind").agg(F.sum("match_count").alias("n"))
    return s.select("path", F.concat(F.lit("security_smell_"), "kind").alias("metric_id"), F.col("n").cast("long").alias("value"))


def exported_lines(files: DataFrame) -> DataFrame:
    """``(path, exported)``: lines that export a name, of files that may hold dead code."""
    body = lambda x: F.ltrim(x)
    starts = lambda x, words: T.any_of([F.startswith(x, F.lit(w)) for w in words])
    is_export = lambda x: (
        F.when(F.col("language") == "rust", starts(x, EXPORTS["rust"]))
        .when(F.col("language") == "python", F.startswith(x, F.lit("def ")) & ~F.startswith(x, F.lit("def _")))
        .otherwise(starts(x, EXPORTS["script"]))
    )
    low = F.lower("path")
    scanned = F.col("language").isin(*DEAD_LANGUAGES) & ~T.contains_any(low, DEAD_PATHS) & ~T.any_of([F.endswith(low, F.lit(e)) for e in DEAD_ENDS])
    f = files.where(scanned & ~T.contains_any(F.col("text"), REGISTRY))
    n = F.size(F.filter(T.lines(F.col("text")), lambda x: is_export(body(x)))).cast("long")
    return f.select("path", n.alias("exported")).where("exported > 0")


def dead_code_facts(exports: DataFrame, fans: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exporting files that nothing refers to, that refer to one file at most and define few names."""
    n = symbols.groupBy("path").agg(F.count("*").alias("n"))
    j = exports.join(fans, "path", "left").join(n, "path", "left").na.fill(0, ["fan_in", "fan_out", "n"])
    dead = j.where((F.col("fan_in") == 0) & (F.col("fan_out") <= DEAD_FAN_OUT) & (F.col("n") <= DEAD_SYMBOLS))
    return union(_flag(dead, "dead_code_candidate"), _flag(exports, "dead_code_exported_symbol_count", F.col("exported")))


def test_facts(files: DataFrame, exports: DataFrame, metrics: DataFrame, near: int = NEAR) -> DataFrame:
    """Public surfaces, hot spots and entry points without tests nearby.

    A test is near if its name is the file's without a test's ending and its directory is
    at most ``near`` steps away. Hot spots add points for size, fans, complexity and
    duplication from ``metrics``.
    """
    known = files.select("path", T.parent(F.col("path")).alias("dir"), F.lower(T.stem(F.col("path"))).alias("stem"), T.file_kind(F.col("path")).alias("kind"))
    src = known.where("kind <> 'test'").select("path", F.split(F.lower("dir"), "/").alias("a"), F.regexp_replace("stem", Q.TEST_SUFFIX, "").alias("k"))
    tst = known.where("kind = 'test'").select(F.col("path").alias("test"), F.split(F.lower("dir"), "/").alias("b"), F.regexp_replace("stem", Q.TEST_SUFFIX, "").alias("k"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_other = F.array_position(same, False)
    common = F.when(first_other == 0, F.least(F.size("a"), F.size("b"))).otherwise(first_other - 1)
    hit = src.join(tst, "k").where(F.size("a") + F.size("b") - 2 * common <= near)
    hit = hit.groupBy("path").agg(F.count("*").alias("tests"), F.count_if(F.rlike(F.lower("test"), F.lit(INTEGRATION_PATH))).alias("integration"))
    points = reduce(lambda a, b: a + b, [F.max(F.when((F.col("metric_id") == m) & (F.col("value") >= at), p).otherwise(0)) for m, at, p in HOT_POINTS])
    hot = metrics.where(F.col("metric_id").isin(*[m for m, _, _ in HOT_POINTS])).groupBy("path").agg(points.alias("points"))
    j = src.select("path").join(hit, "path", "left").join(exports, "path", "left").join(hot, "path", "left").na.fill(0, ["tests", "integration", "exported", "points"])
    return union(
        _flag(j.where("tests > 0"), "test_nearby_test_file_count", F.col("tests")),
        _flag(j.where("integration > 0"), "test_nearby_integration_test_file_count", F.col("integration")),
        _flag(j.where("exported > 0 and tests = 0"), "public_surface_without_tests"),
        _flag(j.where((F.col("points") >= HOT_SCORE) & (F.col("tests") == 0)), "hotspot_without_test_evidence"),
        _flag(j.where(F.rlike(F.lower("path"), F.lit(ENTRY_PATH)) & (F.col("integration") == 0)), "integration_entry_without_tests"),
    )


def clone_facts(facts: DataFrame) -> DataFrame:
    """Blocks, density and peers of cloned files, from :func:`quern.operators.clones.file_facts`."""
    named = facts.select("path", F.col("blocks").alias("duplicate_block_count"), F.col("density_bps").alias("duplicate_density_bps"), F.col("peers").alias("duplicate_peer_count"))
    return Q.long_metrics(named, "duplicate_block_count", "duplicate_density_bps", "duplicate_peer_count")
