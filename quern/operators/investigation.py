"""Investigation: route roles, constraint evidence, clusters, divergence, contract traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import lines as L

# --- fixed values: what a path or a line stands for, in the order of the rules ----------
TEST_PATH = r"/tests?/|(_test|test)\.(rs|py)$|(^|/)test_[^/]*$"
MIGRATION_PATH = r"(^|/)(alembic|migrations|versions)/"
SEGMENTS = (
    ("test", TEST_PATH), ("migration", MIGRATION_PATH), ("service", "validator"), ("crud", "crud"), ("query", r"query|\.sql$"), ("service", "service"),
    ("api_client", r"/lib/api/|^lib/api/|^frontend/src/lib/api/"), ("endpoint", "endpoint|controller|/api/|/routes/"), ("api_client", "client"),
    ("ui", "hook|/frontend/|^frontend/|/ui/|^ui/"),
)
SOURCE_KINDS = (
    ("test", TEST_PATH), ("migration", MIGRATION_PATH), ("validator", "validator"), ("crud", "crud"), ("query", r"query|\.sql$"), ("model", "model|schema"),
    ("service", "service"), ("api_client", r"/lib/api/|^lib/api/|^frontend/src/lib/api/"), ("endpoint", "endpoint|controller|/api/|/routes/"), ("api_client", "client"),
    ("ui", "hook|/frontend/|^frontend/|/ui/|^ui/"), ("constraint_source", "constraint|index"),
)
#: (languages, pattern, extra pattern on the path, kind, source, strength, confidence)
CONSTRAINTS = (
    ("python", r"op\.create_index\(.*unique|unique.*op\.create_index\(", "", "index_constraint", "index_declaration", "strong", 0.95),
    ("python", r"op\.create_index\(", "", "index_constraint", "index_declaration", "strong", 0.90),
    ("python", r"^(?!.*drop_index\().*index\(", r"/models/|" + MIGRATION_PATH, "index_constraint", "index_declaration", "strong", 0.88),
    ("python", r"op\.create_unique_constraint|op\.create_foreign_key|op\.create_check_constraint|foreignkeyconstraint|checkconstraint", MIGRATION_PATH, "migration_constraint", "migration_declaration", "strong", 0.92),
    ("python", r"op\.create_unique_constraint|op\.create_foreign_key|op\.create_check_constraint|foreignkeyconstraint|checkconstraint", "", "model_constraint", "model_declaration", "strong", 0.92),
    ("python", r"uniqueconstraint|foreignkey\(| references ", "", "model_constraint", "model_declaration", "strong", 0.90),
    ("typescript,javascript", r"createindex\(", "", "index_constraint", "index_declaration", "strong", 0.90),
    ("typescript,javascript", r"unique: true|@unique", "", "model_constraint", "model_declaration", "strong", 0.86),
    ("typescript,javascript", r"references:|foreignkey", "", "model_constraint", "model_declaration", "strong", 0.84),
    ("rust", r"table!|joinable!|allow_tables_to_appear_in_same_query!", "", "ddl_like_hint", "schema_hint", "weak", 0.60),
    ("rust", r"query!\(|query_as!\(", "", "runtime_guard", "runtime_guard_code", "weak", 0.55),
    ("sql", r"unique index", "", "index_constraint", "index_declaration", "strong", 0.95),
    ("sql", r"create index", "", "index_constraint", "index_declaration", "strong", 0.88),
    ("sql", r"add constraint|foreign key| references | check ", MIGRATION_PATH, "migration_constraint", "migration_declaration", "strong", 0.90),
    ("sql", r"add constraint|foreign key| references | check ", "", "model_constraint", "schema_hint", "strong", 0.90),
    ("prisma", r"@@index", "", "index_constraint", "index_declaration", "strong", 0.90),
    ("prisma", r"@@unique|@unique|@id|@relation", "", "model_constraint", "model_declaration", "strong", 0.90),
)
SEMANTIC_SHARE = 0.10
WEIGHTS = {"lexical": 0.20, "route": 0.20, "symbol": 0.15, "constraint": 0.25, "test": 0.20}


def _first(path: Column, rules: tuple, otherwise: str) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(F.rlike(low, F.lit(pattern)), name).otherwise(out)
    return out


def route_segment(path: Column) -> Column:
    return _first(path, SEGMENTS, "unknown")


def source_kind(path: Column) -> Column:
    return _first(path, SOURCE_KINDS, "unknown")


def constraint_evidence(files: DataFrame, rules: tuple = CONSTRAINTS) -> DataFrame:
    """``(path, line_no, kind, source, strength, confidence, excerpt)``: the first rule that fits a line.

    Repeated (path, line, kind, text) count once. Rules are one ordered chain, so lines
    are read once.
    """
    rows = L.exploded_lines(files, "language").withColumn("norm", F.trim(F.regexp_replace("line", r"\s+", " ")))
    low, path = F.lower("norm"), F.lower("path")
    hit = F.lit(None).cast("struct<kind:string,source:string,strength:string,confidence:double>")
    for languages, pattern, where, kind, source, strength, confidence in reversed(rules):
        fits = F.rlike(low, F.lit(pattern))
        if languages != "*":
            fits = fits & F.col("language").isin(*languages.split(","))
        if where:
            fits = fits & F.rlike(path, F.lit(where))
        row = F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source"), F.lit(strength).alias("strength"), F.lit(confidence).alias("confidence"))
        hit = F.when(fits, row).otherwise(hit)
    rows = rows.where(F.length("norm") > 0).withColumn("hit", hit).where("hit is not null")
    return rows.select("path", "line_no", "hit.*", F.substring("norm", 1, 160).alias("excerpt")).distinct()


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set, of letters and digits in runs of three or more."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))
    x, y = words(a), words(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, F.size(F.array_intersect(x, y)) / most).otherwise(0.0)


def cluster_score(lexical: Column, semantic: Column, route: Column, symbol: Column, strong: Column, weak: Column, tests: Column, resolved: Column) -> Column:
    """Confidence of a variant from its signals, from 0 to 1."""
    clamp = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    weak_part = F.when(strong > 0, clamp(weak * 0.08, 0.0, 0.4)).otherwise(clamp(weak * 0.04, 0.0, 0.2))
    constraint = clamp(clamp(strong * 0.5, 0.0, 1.0) + weak_part, 0.0, 1.0)
    test = F.when(tests > 0, clamp(0.5 + tests * 0.2, 0.0, 1.0)).otherwise(0.0)
    w = WEIGHTS
    base = lexical * w["lexical"] + route * w["route"] + symbol * w["symbol"] + constraint * w["constraint"] + test * w["test"]
    penalty = F.when(resolved, 0.0).otherwise(0.10) + F.when(strong + weak > 0, 0.0).otherwise(0.10) + F.when(tests > 0, 0.0).otherwise(0.05)
    return clamp(base + semantic * SEMANTIC_SHARE - penalty, 0.0, 1.0)


def concept_cluster(files: DataFrame, evidence: DataFrame, seed: str, limit: int) -> DataFrame:
    """Variants of a concept: files scored by overlap, constraints and tests; the best ``limit``.

    A variant's tests are the test files of its directory.
    """
    f = files.select("path", source_kind(F.col("path")).alias("source_kind"), T.parent(F.col("path")).alias("dir"), overlap(F.lit(seed), F.col("path")).alias("lexical"), overlap(F.lit(seed), F.col("sample")).alias("symbol"))
    e = evidence.groupBy("path").agg(F.count_if(F.col("strength") == "strong").alias("strong"), F.count_if(F.col("strength") == "weak").alias("weak"))
    t = f.where("source_kind = 'test'").groupBy("dir").agg(F.count("*").alias("tests"))
    j = f.join(e, "path", "left").join(t, "dir", "left").na.fill(0, ["strong", "weak", "tests"])
    route = F.when(F.col("source_kind") == "unknown", 0.0).otherwise(0.5)
    score = cluster_score(F.col("lexical"), F.lit(0.0), route, F.col("symbol"), F.col("strong"), F.col("weak"), F.col("tests"), F.lit(True))
    return j.withColumn("confidence", score).orderBy(F.desc("confidence"), F.desc("strong"), F.desc("lexical"), "path").limit(limit)


def divergence(variants: DataFrame, *axes: str) -> DataFrame:
    """``(axis, n_values, state, severity)``: whether variants agree along each axis.

    No value: missing; one: consensus; several: divergence. Severity rises with the
    number of values.
    """
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])
    g = variants.select(F.explode(rows).alias("x")).select("x.*").groupBy("axis").agg(F.countDistinct("value").alias("n_values"))
    state = F.when(F.col("n_values") == 0, "missing").when(F.col("n_values") == 1, "consensus").otherwise("divergence")
    severity = F.when(F.col("n_values") <= 1, "none").when(F.col("n_values") == 2, "low").when(F.col("n_values") <= 4, "medium").otherwise("high")
    return g.select("axis", "n_values", state.alias("state"), severity.alias("severity"))


def common_values(rows: DataFrame, key: str, variant: str) -> DataFrame:
    """Values of ``key`` that every variant has."""
    n = rows.agg(F.countDistinct(variant).alias("n"))
    g = rows.groupBy(key).agg(F.countDistinct(variant).alias("k"))
    return g.join(F.broadcast(n), F.col("k") == F.col("n")).select(key)  # n is one row


ROLE_ORDER = ("ui", "api_client", "endpoint", "service", "crud", "query", "model", "migration", "test")


def contract_trace(candidates: DataFrame) -> DataFrame:
    """``(step, role, path, score, broken)``: the best file of each role, in the order of a call.

    ``candidates(path, score)``. A step is broken when no file plays its role.
    """
    rows = candidates.withColumn("role", source_kind(F.col("path")))
    rank = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), "path"))
    best = rows.withColumn("r", rank).where("r = 1").select("role", "path", "score")
    roles = candidates.sparkSession.createDataFrame([(k, r) for k, r in enumerate(ROLE_ORDER)], "step int, role string")
    return roles.join(best, "role", "left").select("step", "role", "path", "score", F.col("path").isNull().alias("broken"))
