"""Quality snapshots: totals, rankings and buckets from one table of files, deltas and the gate.

A snapshot is made in one pass over the metrics and one over the violations: both come
down to a row for each file, which is written once; rankings and buckets are stacks of
that row, so six orders or three kinds of bucket are one shuffle, not one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import quality as Q
from quern.sources.sinks import materialize

# --- fixed values: how many paths and buckets a snapshot names, and what it ranks by ----
TOP_PATHS, TOP_BUCKETS, TOP_FILES, TOP_RULES = 10, 5, 5, 5
RANKED_METRICS = ("graph_edge_out_count", "max_cognitive_complexity", "duplicate_density_bps")
SIGNAL_RULES = ("module_cycle_member", "hub_module", "cross_layer_dependency", "layering_unmatched_zone_dependency")
UNMATCHED = "unmatched"
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def file_rows(files: DataFrame, metrics: DataFrame, violations: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """A row for each of ``files(path)``: size, lines, ranked metrics, violations, risk, directory and zone.

    ``violations`` may have a column ``suppressed``: such ones are counted apart. ``zones(path, zone)``
    has one zone a file at most; files in none get ``unmatched``, and without zones the module is the directory.
    """
    if "suppressed" not in violations.columns:
        violations = violations.withColumn("suppressed", F.lit(False))
    active = violations.where("not suppressed").drop("suppressed")
    pick = lambda m: F.max(F.when(F.col("metric_id") == m, F.col("value")))
    m = metrics.groupBy("path").agg(pick("size_bytes").alias("size_bytes"), pick("non_empty_lines").alias("non_empty_lines"), *[pick(x).alias(x) for x in RANKED_METRICS])
    rank = F.lit(0)
    for name, r in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, r).otherwise(rank)
    v = violations.groupBy("path").agg(
        F.count_if(~F.col("suppressed")).alias("active"), F.count_if(F.col("suppressed")).alias("suppressed"),
        F.coalesce(F.max(F.when(~F.col("suppressed"), rank)), F.lit(0)).alias("prominence"),
        F.count_if(~F.col("suppressed") & F.col("rule_id").isin(*SIGNAL_RULES)).alias("signals"),
    )
    risk = Q.risk_scores(metrics, active).select("path", F.col("score").alias("risk"))
    out = files.select("path").join(m, "path", "left").join(v, "path", "left").join(risk, "path", "left")
    out = out.na.fill(0, ["size_bytes", "active", "suppressed", "prominence", "signals"]).na.fill(0.0, ["risk"]).withColumn("dir", T.parent(F.col("path")))
    out = out.withColumn("dir", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")))
    if zones is None:
        return out.withColumn("module", F.col("dir"))
    return out.join(zones.select("path", "zone"), "path", "left").withColumn("module", F.coalesce("zone", F.lit(UNMATCHED))).drop("zone")


def rankings(rows: DataFrame, limit: int = TOP_PATHS) -> DataFrame:
    """``(ranking, rank, path, value)``: the first ``limit`` files of each of the six orders.

    Files without the metric come last; ties go by the gravest violation, size and path.
    Every task keeps ``limit`` rows of each order before the shuffle.
    """
    low = F.lit(-(1 << 63)).cast("long")
    orders = [("violation_count", F.col("active")), ("size_bytes", F.col("size_bytes")), ("non_empty_lines", F.col("non_empty_lines"))]
    orders += [(f"metric_{m}", F.col(m)) for m in RANKED_METRICS]
    stack = F.array(*[F.struct(F.lit(k).alias("ranking"), F.coalesce(c, low).cast("long").alias("key"), c.cast("long").alias("value")) for k, c in orders])
    by = Window.partitionBy("ranking").orderBy(F.desc("key"), F.desc("prominence"), F.desc("size_bytes"), "path")
    out = rows.select("path", "prominence", "size_bytes", F.explode(stack).alias("o")).select("path", "prominence", "size_bytes", "o.*")
    out = out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return out.select("ranking", "rank", "path", "value")


def buckets(rows: DataFrame) -> DataFrame:
    """``(aggregation, bucket_id, hotspot_score, active, suppressed, hot_files, files, top_files)`` for files, directories and modules.

    The score of a file is its risk; of the others the sum of their five riskiest files,
    one for each file with violations, and one for each structural signal.
    """
    stack = F.array(*[F.struct(F.lit(k).alias("aggregation"), F.col(c).alias("bucket_id")) for k, c in (("file", "path"), ("directory", "dir"), ("module", "module"))])
    e = rows.select("path", "risk", "active", "suppressed", "signals", F.explode(stack).alias("b")).select("path", "risk", "active", "suppressed", "signals", "b.*")
    keys = ["aggregation", "bucket_id"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("risk"), "path"))
    best = e.select(*keys, "path", "risk").withColumn("place", place).where(F.col("place") <= TOP_FILES)  # at most five rows a bucket and task are sorted
    best = best.groupBy(*keys).agg(F.sum("risk").alias("top"), F.array_sort(F.collect_list(F.struct("place", "path"))).alias("best"))
    total = e.groupBy(*keys).agg(
        F.sum("active").alias("active"), F.sum("suppressed").alias("suppressed"), F.count_if(F.col("active") > 0).alias("hot_files"), F.sum("signals").alias("signals"), F.count("*").alias("files")
    )
    out = total.join(best, keys)
    score = F.when(F.col("aggregation") == "file", F.col("top")).otherwise(F.col("top") + F.col("hot_files") + F.col("signals"))
    return out.select(*keys, score.alias("hotspot_score"), "active", "suppressed", "hot_files", "files", F.transform("best", lambda x: x["path"]).alias("top_files"))


def top_buckets(bucket_rows: DataFrame, limit: int = TOP_BUCKETS) -> DataFrame:
    by = Window.partitionBy("aggregation").orderBy(F.desc("hotspot_score"), F.desc("active"), "bucket_id")
    return bucket_rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def snapshot(files: DataFrame, metrics: DataFrame, violations: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """``(section, key, rank, item, value)``: the whole snapshot in one table.

    Sections: ``totals`` (counts of files, violations, lines and bytes), ``top_rules``,
    ``top_metrics``, six ``top_files`` rankings and three kinds of ``top_buckets``.
    """
    rows = materialize(file_rows(files, metrics, violations, zones))
    value = lambda c: c.cast("double").alias("value")
    total = rows.agg(
        F.count("*").alias("evaluated_files"), F.count_if(F.col("active") > 0).alias("violating_files"), F.coalesce(F.sum("active"), F.lit(0)).alias("total_violations"),
        F.coalesce(F.sum("suppressed"), F.lit(0)).alias("suppressed_violations"), F.coalesce(F.sum("non_empty_lines"), F.lit(0)).alias("total_non_empty_lines"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("item"), value(F.col(c))) for c in total.columns])
    out = [total.select(F.explode(pairs).alias("p")).select(F.lit("totals").alias("section"), F.lit("").alias("key"), F.lit(0).alias("rank"), "p.item", "p.value")]
    active = violations.where("not suppressed") if "suppressed" in violations.columns else violations
    for section, df, key, measure in (("top_rules", active, "rule_id", F.count("*")), ("top_metrics", metrics, "metric_id", F.max("value"))):
        g = df.groupBy(key).agg(measure.alias("n"))  # as many rows as there are rules or metrics
        rank = F.row_number().over(Window.orderBy(F.desc("n"), key))
        out.append(g.withColumn("rank", rank).where(F.col("rank") <= TOP_RULES).select(F.lit(section).alias("section"), F.lit("").alias("key"), "rank", F.col(key).alias("item"), value(F.col("n"))))
    ranked = rankings(rows)
    out.append(ranked.select(F.lit("top_files").alias("section"), F.col("ranking").alias("key"), "rank", F.col("path").alias("item"), value(F.col("value"))))
    hot = top_buckets(buckets(rows))
    out.append(hot.select(F.lit("top_buckets").alias("section"), F.col("aggregation").alias("key"), "rank", F.col("bucket_id").alias("item"), value(F.col("hotspot_score"))))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def bucket_delta(before: DataFrame, after: DataFrame, old_violations: DataFrame, new_violations: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, new, resolved, hotspot_delta, new_hotspot, regressed_rules)`` of the buckets of two snapshots.

    The violations bring the bucket ``keys`` and ``rule_id``; what a rule has more of is new and
    makes it a regressed one. Buckets that are gone resolve all they had.
    """
    d = Q.multiset_diff(old_violations, new_violations, *keys, "rule_id")
    rules = F.array_join(F.array_sort(F.collect_set(F.when(F.col("new") > 0, F.col("rule_id")))), ",")  # as many as there are rules
    d = d.groupBy(*keys).agg(F.sum("new").alias("new"), F.sum("resolved").alias("resolved"), rules.alias("regressed_rules"))
    b = before.select(*keys, F.col("hotspot_score").alias("b"))
    c = after.select(*keys, F.col("hotspot_score").alias("c"), "active")
    out = b.join(c, list(keys), "full").join(d, list(keys), "left").na.fill(0, ["new", "resolved", "active"]).na.fill("", ["regressed_rules"])
    change = F.coalesce("c", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    fresh = F.col("b").isNull() & ((F.col("active") > 0) | (F.col("c") > 0))
    return out.select(*keys, "new", "resolved", change.alias("hotspot_delta"), fresh.alias("new_hotspot"), "regressed_rules")


def gate(before: DataFrame, after: DataFrame, status: str = "ready") -> DataFrame:
    """``(new_violations, resolved_violations, violations_delta, gate_status, reasons)``: one row.

    Violations are compared as multisets of (path, rule, actual, threshold). The gate is
    ``regression`` if any is new or the later snapshot was not ready, else ``ok``.
    """
    d = Q.multiset_diff(before, after, "path", "rule_id", "actual", "threshold")
    g = d.agg(F.coalesce(F.sum("new"), F.lit(0)).alias("new_violations"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved_violations"))
    stale = F.when(F.lit(status) != "ready", F.lit(f"post_refresh_status={status}"))
    more = F.when(F.col("new_violations") > 0, F.concat(F.lit("new_violations="), F.col("new_violations").cast("string")))
    reasons = F.concat_ws(";", stale, more)
    return g.select(
        "new_violations", "resolved_violations", (F.col("new_violations") - F.col("resolved_violations")).alias("violations_delta"), F.when(reasons == "", "ok").otherwise("regression").alias("gate_status"), reasons.alias("reasons")
    )


def require_ok(gate_row: DataFrame) -> None:
    """Raise where the gate says regression, for jobs that must stop then."""
    row = gate_row.head()
    if row.gate_status != "ok":
        raise RuntimeError(f"quality gate: {row.reasons}")


