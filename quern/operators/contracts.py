"""Variants of a concept compared: where they diverge and how gravely, and the chain of a contract with its breaks.

Variants are routes: a table of entries, a table of their segments. Constraints and tests
come by path. Everything is for all seeds together; a seed has few variants of few segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: axes, severities, roles in their order and rank ----------------------
AXES = ("entrypoints", "guards_and_validators", "predicate_signatures", "downstream_symbols", "db_entities_and_queries", "constraint_evidence", "test_coverage")
MATERIAL = ("guards_and_validators", "predicate_signatures", "db_entities_and_queries", "constraint_evidence")
SEVERITIES = ("informational", "likely_expected", "suspicious", "high_risk")
ROLES = ("schema_or_model", "migration", "endpoint", "service", "validator", "adapter", "generated_client", "consumer", "test", "unknown")
ROLE_RANK = {"schema_or_model": 1.0, "migration": 0.96, "endpoint": 0.94, "service": 0.9, "validator": 0.84, "adapter": 0.7, "generated_client": 0.35, "consumer": 0.52, "test": 0.2, "unknown": 0.1}
BACKEND = ("service", "validator", "adapter")
LOW_AFFINITY = 0.30


def variants_of(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(variants, segments)`` of the routes of :func:`quern.operators.navigation.route_trace`.

    ``variants(seed, seed_kind, variant, path, confidence)``; ``segments(seed, seed_kind,
    variant, pos, path, kind, source_kind, score)``, the entry at position 0.
    """
    from quern.operators.investigation import source_kind

    keys = ("seed", "seed_kind", F.col("rank").alias("variant"))
    v = routes.select(*keys, F.get("nodes", F.lit(0)).alias("path"), "confidence")
    s = routes.select(*keys, F.posexplode("segments").alias("pos", "s")).select("seed", "seed_kind", "variant", "pos", "s.path", "s.kind", source_kind(F.col("s.path")).alias("source_kind"), "s.score")
    return v, s


def axis_values(variants: DataFrame, segments: DataFrame, constraints: DataFrame, tests: DataFrame) -> DataFrame:
    """``(seed, seed_kind, variant, axis, value)``: what each variant has along each axis.

    ``constraints(path, kind, source, strength, text)`` and ``tests(path, test)`` belong to
    the files of a variant's route. A last axis, ``strong``, has the strong constraints.
    """
    keys = ("seed", "seed_kind", "variant")
    row = lambda df, axis, value: df.select(*keys, F.lit(axis).alias("axis"), value.alias("value"))
    own = segments.select(*keys, "path").distinct()
    c = own.join(constraints, "path")
    guard = (F.col("kind") == "runtime_guard") | (F.col("source") == "runtime_guard_code")
    parts = (
        row(variants, "entrypoints", F.col("path")),
        row(segments.where("source_kind = 'validator'"), "guards_and_validators", F.concat(F.lit("validator:"), "path")),
        row(c.where(guard), "guards_and_validators", F.concat(F.lit("guard:"), "source", F.lit(":"), "path")),
        row(c.where(guard | F.contains(F.lower("path"), F.lit("validator"))), "predicate_signatures", F.col("text")),
        row(segments.where("pos > 0"), "downstream_symbols", F.col("path")),
        row(segments.where("kind in ('crud', 'query')"), "db_entities_and_queries", F.concat("source_kind", F.lit("|"), "path")),
        row(c, "constraint_evidence", F.col("text")),
        row(c.where("strength = 'strong'"), "strong", F.col("text")),
        row(own.join(tests, "path"), "test_coverage", F.col("test")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("value", F.trim("value")).where("value <> ''").distinct()


def divergence_signals(variants: DataFrame, values: DataFrame) -> DataFrame:
    """``(seed, seed_kind, axis, state, n_values, severity, evidence_strength, reason)`` of every axis.

    An axis is ``missing`` without values, ``consensus`` where all variants that have any have the
    same, else ``divergence``, and then graded by an ordered ladder: conflicting strong
    constraints, data access without tests, entry points, tests, downstream files over shared
    constraints, material axes by whether others or a lack of tests bear them out, the rest.
    """
    keys = ["seed", "seed_kind"]
    n = variants.groupBy(*keys).agg(F.count("*").alias("n_variants"))
    sets = values.groupBy(*keys, "variant", "axis").agg(F.array_join(F.array_sort(F.collect_set("value")), " | ").alias("all"))  # the few values of a variant
    axes = n.select(*keys, "n_variants", F.explode(F.array(*[F.lit(a) for a in AXES])).alias("axis"))
    g = sets.groupBy(*keys, "axis").agg(F.countDistinct("all").alias("n_values"), F.count("*").alias("having"))
    strong = values.where("axis = 'strong'")
    shared = strong.groupBy(*keys, "value").agg(F.countDistinct("variant").alias("k")).join(n, keys).where("k = n_variants").groupBy(*keys).agg(F.lit(True).alias("shared"))
    some = strong.groupBy(*keys).agg(F.lit(True).alias("strong"))
    tested = sets.where("axis = 'test_coverage'").groupBy(*keys).agg(F.count("*").alias("tested"))
    a = axes.join(g, [*keys, "axis"], "left").join(shared, keys, "left").join(some, keys, "left").join(tested, keys, "left").na.fill(False, ["shared", "strong"]).na.fill(0, ["n_values", "tested"])
    state = F.when(F.col("n_values") == 0, "missing").when(F.col("n_values") == 1, "consensus").otherwise("divergence")
    a = a.withColumn("state", state).withColumn("gap", F.col("tested") < F.col("n_variants"))
    material = F.col("axis").isin(*MATERIAL)
    a = a.withColumn("proxies", F.count_if(material & (F.col("state") == "divergence")).over(Window.partitionBy(*keys)))  # seven rows a seed
    is_axis = lambda x: F.col("axis") == x
    grade = lambda severity, strength, reason: F.struct(F.lit(severity).alias("severity"), F.lit(strength).alias("evidence_strength"), F.lit(reason).alias("reason"))
    ladder = (
        F.when(F.col("state") != "divergence", F.lit(None).cast("struct<severity:string,evidence_strength:string,reason:string>"))
        .when(is_axis("constraint_evidence") & F.col("strong") & ~F.col("shared"), grade("high_risk", "hard", "conflicting_hard_constraints"))
        .when(is_axis("db_entities_and_queries") & F.col("gap"), grade("high_risk", "corroborated_proxy", "db_query_without_test_backing"))
        .when(is_axis("entrypoints"), grade("informational", "proxy_only", "entrypoint_only"))
        .when(is_axis("test_coverage"), grade("likely_expected", "proxy_only", "test_only"))
        .when(is_axis("downstream_symbols") & F.col("shared") & ~F.col("gap"), grade("likely_expected", "corroborated_proxy", "shared_backing_downstream_variation"))
        .when(material & (F.col("proxies") >= 2), grade("suspicious", "corroborated_proxy", "multi_axis_proxy_corroboration"))
        .when(material & ~F.col("shared") & F.col("gap"), grade("suspicious", "corroborated_proxy", "single_axis_proxy_plus_test_gap"))
        .otherwise(grade("likely_expected", "proxy_only", "single_axis_proxy_only"))
    )
    return a.withColumn("g", ladder).select(*keys, "axis", "state", "n_values", "g.severity", "g.evidence_strength", "g.reason")


def divergence_summary(signals: DataFrame) -> DataFrame:
    """``(seed, seed_kind, divergence_axes, overall_severity, manual_review)``: the gravest signal of each seed.

    Review by hand is asked for where signals beyond information rest on proxies alone.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    real = F.col("severity").isNotNull() & (F.col("severity") != "informational")
    g = signals.groupBy("seed", "seed_kind").agg(
        F.count("severity").alias("divergence_axes"), F.max(rank).alias("top"), F.count_if(real).alias("real"), F.count_if(real & (F.col("evidence_strength") == "proxy_only")).alias("proxy")
    )
    name = F.coalesce(F.get(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("top") - 1).cast("int")), F.lit("informational"))
    return g.select("seed", "seed_kind", "divergence_axes", name.alias("overall_severity"), ((F.col("real") > 0) & (F.col("real") == F.col("proxy"))).alias("manual_review"))


# --- contracts ---------------------------------------------------------------------------
def contract_role(kind: Column, source: Column, path: Column) -> Column:
    """The role that a segment plays in a contract."""
    low = F.lower(path)
    has = lambda w: F.contains(low, F.lit(w))
    service = F.when((source == "validator") | has("validator"), "validator").when(has("adapter"), "adapter").otherwise("service")
    return (
        F.when(kind.isin("migration", "query", "crud"), "schema_or_model").when(kind == "endpoint", "endpoint").when(kind == "service", service).when(kind == "api_client", "generated_client")
        .when(kind == "ui", "consumer").when(kind == "test", "test").when(has("adapter"), "adapter").otherwise("unknown")
    )


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), lambda x: x != "")


def path_affinity(seed: Column, path: Column) -> Column:
    """The share of folders that two paths begin with in common, of the shorter one's; 0 without a seed."""
    a, b = _parts(seed), _parts(path)
    most = F.least(F.size(a), F.size(b)) - 1
    same = F.zip_with(F.slice(a, 1, F.greatest(most, F.lit(0))), F.slice(b, 1, F.greatest(most, F.lit(0))), lambda x, y: x == y)
    other = F.array_position(same, False)
    shared = F.when(other == 0, F.size(same)).otherwise(other - 1)
    return F.coalesce(F.when(shared > 0, shared / F.greatest(most, F.lit(1))), F.lit(0.0))


def _rank(role: Column) -> Column:
    out = F.lit(0.0)
    for name, r in ROLE_RANK.items():
        out = F.when(role == name, r).otherwise(out)
    return out


def contract_chain(variants: DataFrame, segments: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """``(seed, seed_kind, step, role, path, rank_score, orphaned)``: the best file of each role, in order.

    Files count as entries of their variant and as segments; those in the seed's own context go
    before others; tests and unknown files far from the seed are none. ``generated(path,
    source_hint)``: such entries are generated clients, ``orphaned`` without a hint.
    """
    keys = ["seed", "seed_kind"]
    first = segments.where("pos = 0").select(*keys, "variant", "kind", "source_kind")
    entry = variants.join(first, [*keys, "variant"]).withColumn("gain", F.col("confidence") * 0.2)
    if generated is not None:
        entry = entry.join(generated.select("path", "source_hint", F.lit(True).alias("made")), "path", "left")
    else:
        entry = entry.withColumns({"source_hint": F.lit(None).cast("string"), "made": F.lit(None).cast("boolean")})
    role = contract_role(F.col("kind"), F.col("source_kind"), F.col("path"))
    entry = entry.select(*keys, "path", "gain", F.when(F.col("made"), "generated_client").otherwise(role).alias("role"), (F.coalesce("made", F.lit(False)) & F.col("source_hint").isNull()).alias("orphaned"))
    seg = segments.select(*keys, "path", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))) * 0.15).alias("gain"), role.alias("role"), F.lit(False).alias("orphaned"))
    links = entry.unionByName(seg)
    seed = F.when(F.col("seed_kind") == "path", F.col("seed"))
    links = links.withColumn("near", path_affinity(seed, F.col("path")))
    links = links.where(~F.col("role").isin("test", "unknown") | (F.col("near") >= LOW_AFFINITY))
    root = lambda x: F.slice(_parts(x), 1, 4)
    context = F.coalesce(root(seed) == root(F.col("path")), F.lit(True))
    score = F.round(_rank(F.col("role")) + F.col("gain") + F.col("near") * 0.35, 6)
    links = links.withColumns({"context": context.cast("int"), "rank_score": score})
    best = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(F.desc("context"), F.desc("rank_score"), "path", "orphaned"))
    links = links.withColumn("k", best).where("k = 1")
    step = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int")
    return links.select(*keys, step.alias("step"), "role", "path", "rank_score", "orphaned")


def contract_breaks(seeds: DataFrame, chain: DataFrame) -> DataFrame:
    """``(seed, seed_kind, expected_role, reason, last_path)``: what the chain of each seed lacks."""
    keys = ["seed", "seed_kind"]
    has = lambda *r: F.coalesce(F.bool_or(F.col("role").isin(*r)), F.lit(False))
    g = seeds.select(*keys).distinct().join(chain, keys, "left").groupBy(*keys).agg(
        has("schema_or_model", "migration").alias("schema"), has("endpoint").alias("endpoint"), has(*BACKEND).alias("service"), has("generated_client", "consumer").alias("client"), has("test").alias("test"),
        F.max_by("path", "step").alias("last_path"), F.min(F.when(F.col("orphaned"), F.col("path"))).alias("orphan"),
    )
    row = lambda when, role, reason, path: F.when(when, F.struct(F.lit(role).alias("expected_role"), F.lit(reason).alias("reason"), F.col(path).alias("last_path")))
    rows = F.array(
        row(F.col("client") & ~F.col("service") & ~F.col("endpoint"), "service", "chain_ended_before_backend_contract_root", "last_path"),
        row((F.col("endpoint") | F.col("service")) & ~F.col("schema"), "schema_or_model", "schema_or_model_backing_not_found", "last_path"),
        row(~F.col("test"), "test", "related_tests_not_found", "last_path"),
        row(F.col("orphan").isNotNull(), "schema_or_model", "generated_target_without_source_of_truth", "orphan"),
    )
    return g.select(*keys, F.explode(F.array_compact(rows)).alias("b")).select(*keys, "b.*")
