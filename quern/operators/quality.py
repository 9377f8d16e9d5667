"""Quality engine: metrics, rules, policy overlay, risk, hotspots, change history.

Metrics live in one long table ``(path, metric_id, value)`` and rules in a table of
thresholds, so evaluating all rules is one join; what comes after is aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.neighbours import neighbour_counts

# --- fixed values: rules with their metric, default threshold, severity and category ----
RULES = (
    ("max_size_bytes", "size_bytes", 262_144, "medium", "maintainability"),
    ("max_non_empty_lines_default", "non_empty_lines_default", 300, "medium", "maintainability"),
    ("max_non_empty_lines_test", "non_empty_lines_test", 500, "medium", "maintainability"),
    ("max_non_empty_lines_config", "non_empty_lines_config", 100, "medium", "maintainability"),
    ("max_import_count", "import_count", 20, "medium", "maintainability"),
    ("max_line_length", "max_line_length", 140, "low", "style"),
    ("max_symbol_count_per_file", "symbol_count", 80, "medium", "maintainability"),
    ("max_ref_count_per_file", "ref_count", 200, "medium", "maintainability"),
    ("max_module_dep_count_per_file", "module_dep_count", 40, "medium", "maintainability"),
    ("max_graph_edge_out_count", "graph_edge_out_count", 60, "medium", "maintainability"),
    ("max_function_lines", "max_function_lines", 80, "medium", "maintainability"),
    ("max_nesting_depth", "max_nesting_depth", 4, "medium", "maintainability"),
    ("max_parameters_per_function", "max_parameters_per_function", 6, "medium", "maintainability"),
    ("max_export_count_per_file", "max_export_count_per_file", 24, "medium", "maintainability"),
    ("max_class_member_count", "max_class_member_count", 20, "medium", "maintainability"),
    ("max_todo_count_per_file", "max_todo_count_per_file", 8, "low", "style"),
    ("max_fan_in_per_file", "fan_in_count", 20, "high", "risk"),
    ("max_fan_out_per_file", "fan_out_count", 20, "high", "risk"),
    ("max_cyclomatic_complexity", "max_cyclomatic_complexity", 12, "high", "maintainability"),
    ("max_cognitive_complexity", "max_cognitive_complexity", 18, "high", "maintainability"),
    ("max_duplicate_block_count", "duplicate_block_count", 3, "high", "maintainability"),
    ("max_duplicate_density_bps", "duplicate_density_bps", 1_500, "high", "maintainability"),
    ("high_git_churn", "git_recent_commit_count", 12, "high", "risk"),
    ("high_git_churn", "git_recent_churn_lines", 400, "high", "risk"),
    ("ownership_concentration", "git_primary_author_share_bps", 7_500, "high", "risk"),
    ("high_change_coupling", "git_cochange_neighbor_count", 10, "high", "risk"),
    ("module_cycle_member", "module_cycle_member", 0, "high", "architecture"),
    ("orphan_module", "orphan_module", 0, "high", "architecture"),
    ("hub_module", "hub_module", 40, "high", "risk"),
    ("cross_layer_dependency", "layering_cross_edge_count", 0, "high", "architecture"),
    ("layering_unmatched_zone_dependency", "layering_unmatched_edge_count", 0, "high", "architecture"),
    ("dead_code_unused_export_candidate", "dead_code_candidate", 0, "high", "maintainability"),
    ("security_smell_shell_exec", "security_smell_shell_exec", 0, "high", "risk"),
    ("security_smell_path_traversal", "security_smell_path_traversal", 0, "high", "risk"),
    ("security_smell_raw_sql", "security_smell_raw_sql", 0, "high", "risk"),
    ("security_smell_unsafe_deserialize", "security_smell_unsafe_deserialize", 0, "high", "risk"),
    ("public_surface_without_tests", "public_surface_without_tests", 0, "high", "risk"),
    ("hotspot_without_test_evidence", "hotspot_without_test_evidence", 0, "high", "risk"),
    ("integration_entry_without_tests", "integration_entry_without_tests", 0, "high", "risk"),
)
SEVERITY_WEIGHT = {"low": 1.0, "medium": 2.0, "high": 4.0, "critical": 8.0}
WEIGHTS = {"complexity": 1.25, "layering": 1.35, "git_risk": 1.15, "test_risk": 1.25, "duplication": 1.15}
MIN_COMMITS = 3
TOP_FILES = 5


def thresholds(spark: SparkSession) -> DataFrame:
    """The default rules as a table; as many rows as there are rules."""
    return spark.createDataFrame(list(RULES), "rule_id string, metric_id string, threshold long, severity string, category string")


def long_metrics(wide: DataFrame, *columns: str, key: str = "path") -> DataFrame:
    """``(path, metric_id, value)`` from columns of counts; nulls give no row."""
    rows = F.array(*[F.struct(F.lit(c).alias("metric_id"), F.col(c).cast("long").alias("value")) for c in columns])
    return wide.select(key, F.explode(rows).alias("m")).select(key, "m.*").where("value is not null")


def evaluate(metrics: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Violations: metrics strictly above their threshold, a row for each rule and metric."""
    rules = thresholds(metrics.sparkSession) if rules is None else rules
    joined = metrics.join(F.broadcast(rules), "metric_id").where(F.col("value") > F.col("threshold"))
    return joined.select("path", "rule_id", F.col("value").alias("actual"), "threshold", "severity", "category")


def overlay(rules: DataFrame, scopes: DataFrame, paths: DataFrame) -> DataFrame:
    """Rules of every path: base values, overridden by matching scopes, the last one winning.

    ``scopes(scope_idx, pattern, rule_id, threshold)``: patterns are regular expressions.
    """
    hit = paths.join(F.broadcast(scopes), F.rlike("path", F.col("pattern")))
    last = hit.groupBy("path", "rule_id").agg(F.max_by("threshold", "scope_idx").alias("own"))
    base = paths.select("path").crossJoin(F.broadcast(rules))  # a row for each rule: a table of fixed size
    out = base.join(last, ["path", "rule_id"], "left")
    return out.select("path", "rule_id", "metric_id", F.coalesce("own", "threshold").alias("threshold"), "severity", "category")


def evaluate_with_policy(metrics: DataFrame, rules: DataFrame, scopes: DataFrame) -> DataFrame:
    """:func:`evaluate` under an overlay; only rows over some threshold meet the scopes."""
    joined = metrics.join(F.broadcast(rules), "metric_id")
    hit = joined.join(F.broadcast(scopes.withColumnRenamed("threshold", "own")), ["rule_id"], "left")
    applies = F.rlike("path", F.coalesce("pattern", F.lit("$^")))
    own = F.max_by(F.when(applies, F.col("own")), F.when(applies, F.col("scope_idx")))
    keys = ["path", "rule_id", "metric_id", "value", "threshold", "severity", "category"]
    out = hit.groupBy(*keys).agg(own.alias("own")).withColumn("limit", F.coalesce("own", "threshold"))
    return out.where("value > limit").select("path", "rule_id", F.col("value").alias("actual"), F.col("limit").alias("threshold"), "severity", "category")


def suppress(violations: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Violations with ``suppressed``: a suppression names a rule and a pattern of paths."""
    s = F.broadcast(suppressions.select("rule_id", "pattern").distinct())
    out = violations.join(s, "rule_id", "left").withColumn("hit", F.coalesce(F.rlike("path", F.col("pattern")), F.lit(False)))
    keys = violations.columns
    return out.groupBy(*keys).agg(F.max("hit").alias("suppressed"))


def _m(name: str) -> Column:
    return F.greatest(F.coalesce(F.max(F.when(F.col("metric_id") == name, F.col("value"))), F.lit(0)), F.lit(0)).cast("double")


def risk_scores(metrics: DataFrame, violations: DataFrame) -> DataFrame:
    """``(path, violation_count, severity, ..., score)``: twelve weighted components.

    Security smells do not count as violations here.
    """
    wide = metrics.groupBy("path").agg(
        _m("fan_in_count").alias("fan_in"),
        _m("fan_out_count").alias("fan_out"),
        (_m("non_empty_lines") / 100).alias("size"),
        _m("max_nesting_depth").alias("nesting"),
        (_m("max_function_lines") / 50).alias("function_length"),
        F.greatest(_m("max_cyclomatic_complexity") / 6, _m("max_cognitive_complexity") / 10).alias("complexity"),
        F.greatest(_m("layering_forbidden_edge_count"), _m("layering_out_of_direction_edge_count"), _m("layering_unmatched_edge_count")).alias("layering"),
        F.greatest(
            _m("git_recent_commit_count") / 6, _m("git_recent_churn_lines") / 200, _m("git_primary_author_share_bps") / 5000, _m("git_cochange_neighbor_count") / 5
        ).alias("git_risk"),
        F.greatest(_m("duplicate_density_bps") / 1000, _m("duplicate_block_count") / 2 + _m("duplicate_peer_count") / 2).alias("duplication"),
    )
    weight = F.lit(0.0)
    for name, w in SEVERITY_WEIGHT.items():
        weight = F.when(F.col("severity") == name, w).otherwise(weight)
    counted = ~F.startswith("rule_id", F.lit("security_smell_"))
    test = (
        F.when(F.col("rule_id") == "hotspot_without_test_evidence", 2.0)
        .when(F.col("rule_id") == "public_surface_without_tests", 1.5)
        .when(F.col("rule_id") == "integration_entry_without_tests", 1.0)
        .otherwise(0.0)
    )
    v = violations.groupBy("path").agg(
        F.count_if(counted).cast("double").alias("violation_count"),
        F.sum(F.when(counted, weight).otherwise(0.0)).alias("severity"),
        F.max(test).alias("test_risk"),
        F.count("*").alias("active_violations"),
    )
    out = wide.join(v, "path", "left").na.fill(0.0, ["violation_count", "severity", "test_risk"]).na.fill(0, ["active_violations"])
    plain = ("violation_count", "severity", "fan_in", "fan_out", "size", "nesting", "function_length")
    score = sum((F.col(c) for c in plain), F.lit(0.0)) + sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("score", score)


def hotspots(risks: DataFrame, violations: DataFrame, bucket: Column) -> DataFrame:
    """``(bucket_id, hotspot_score, active, hot_files)``: the five riskiest files of a bucket.

    Plus one for each file with violations and each structural signal.
    """
    rows = risks.withColumn("bucket_id", bucket)
    rank = F.row_number().over(Window.partitionBy("bucket_id").orderBy(F.desc("score"), "path"))
    top = rows.withColumn("r", rank).groupBy("bucket_id").agg(
        F.sum(F.when(F.col("r") <= TOP_FILES, F.col("score"))).alias("top"),
        F.count_if(F.col("active_violations") > 0).alias("hot_files"),
        F.sum("active_violations").alias("active"),
        F.max_by("path", F.struct("score", "path")).alias("worst"),
    )
    signals = violations.where(F.col("rule_id").isin("module_cycle_member", "hub_module", "cross_layer_dependency"))
    bonus = signals.withColumn("bucket_id", bucket).groupBy("bucket_id").agg(F.count("*").alias("bonus"))
    out = top.join(bonus, "bucket_id", "left").na.fill(0, ["bonus"])
    return out.select("bucket_id", (F.col("top") + F.col("hot_files") + F.col("bonus")).alias("hotspot_score"), "active", "hot_files", "worst")


def git_risk(log: DataFrame) -> DataFrame:
    """Change-history facts of every path from ``log(path, commit, author, churn)``.

    Co-change neighbours are the other paths of a path's commits, each counted once, by
    pairs of blocks of paths (:func:`quern.operators.neighbours.neighbour_counts`).
    """
    by = log.groupBy("path").agg(
        F.countDistinct("commit").alias("git_recent_commit_count"),
        F.countDistinct("author").alias("git_recent_author_count"),
        F.sum("churn").alias("git_recent_churn_lines"),
    )
    touches = log.groupBy("path", "author").agg(F.count("*").alias("n")).groupBy("path").agg(F.max("n").alias("most"))
    near = neighbour_counts(log, "path", "commit").withColumnRenamed("neighbours", "git_cochange_neighbor_count")
    commits = F.col("git_recent_commit_count")
    share = F.when(commits >= MIN_COMMITS, F.floor(F.col("most") * 10_000 / commits)).otherwise(0).cast("long")
    out = by.join(touches, "path").join(near, "path", "left").na.fill(0, ["git_cochange_neighbor_count"])
    return out.withColumn("git_primary_author_share_bps", share).drop("most")


TEST_SUFFIX = r"(_tests?|\.tests?|\.spec|_spec|-test)$"


def nearby_tests(files: DataFrame, max_distance: int = 1) -> DataFrame:
    """``(path, nearby_tests)``: tests of the same stem at most ``max_distance`` directories away.

    ``files(path, dir, stem, kind)``. The join is on the stem; distance is what both
    directories have beyond their common start.
    """
    src = files.where("kind <> 'test'").select("path", "dir", F.regexp_replace("stem", TEST_SUFFIX, "").alias("k"))
    tst = files.where("kind = 'test'").select(F.col("dir").alias("tdir"), F.regexp_replace("stem", TEST_SUFFIX, "").alias("k"))
    a, b = F.split("dir", "/"), F.split("tdir", "/")
    common = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    distance = F.size(a) + F.size(b) - 2 * common
    hit = src.join(tst, "k").where(distance <= max_distance).groupBy("path").agg(F.count("*").alias("nearby_tests"))
    return src.select("path").join(hit, "path", "left").na.fill(0, ["nearby_tests"])


def violation_query(violations: DataFrame, risks: DataFrame, prefix: str | None = None, rules: list[str] | None = None, sort: str = "score", limit: int = 50) -> DataFrame:
    """Files with their violations as arrays: filtered, sorted, limited."""
    v = violations if rules is None else violations.where(F.col("rule_id").isin(*rules))
    v = v if prefix is None else v.where(F.startswith("path", F.lit(prefix)))
    hit = v.groupBy("path").agg(
        F.count("*").alias("violations"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.max(F.col("actual") - F.col("threshold")).alias("worst_excess")
    )
    key = {"score": F.desc("score"), "violations": F.desc("violations"), "excess": F.desc("worst_excess"), "path": F.asc("path")}[sort]
    return hit.join(risks.select("path", "score"), "path").orderBy(key, "path").limit(limit)


def latest_signals(memory: DataFrame) -> DataFrame:
    """The last decision of every signal key in ``memory(signal_key, decision, at)``."""
    return memory.groupBy("signal_key").agg(F.max_by("decision", "at").alias("decision"))


def with_signals(violations: DataFrame, memory: DataFrame) -> DataFrame:
    """Violations with the decision remembered for their key, ``new`` where there is none."""
    key = F.sha2(F.concat_ws("|", "path", "rule_id"), 256)
    out = violations.withColumn("signal_key", key).join(latest_signals(memory), "signal_key", "left")
    return out.withColumn("decision", F.coalesce("decision", F.lit("new")))


def multiset_diff(baseline: DataFrame, candidate: DataFrame, *keys: str) -> DataFrame:
    """``(keys, new, resolved)``: how many more of a key one side has than the other."""
    rows = candidate.select(*keys, F.lit(1).alias("n")).unionByName(baseline.select(*keys, F.lit(-1).alias("n")))
    d = rows.groupBy(*keys).agg(F.sum("n").alias("d")).where("d <> 0")
    return d.select(*keys, F.greatest("d", F.lit(0)).alias("new"), F.greatest(-F.col("d"), F.lit(0)).alias("resolved"))


def hotspot_delta(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """``(bucket_id, before, after, delta, state)`` of hotspots, vanished ones included."""
    b = baseline.select("bucket_id", F.col("hotspot_score").alias("before"))
    c = candidate.select("bucket_id", F.col("hotspot_score").alias("after"))
    both = b.join(c, "bucket_id", "full")
    state = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("after") > F.col("before"), "regressed").otherwise("kept")
    return both.select("bucket_id", "before", "after", (F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))).alias("delta"), state.alias("state"))
