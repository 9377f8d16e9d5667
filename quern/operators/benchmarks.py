"""Benchmarks of investigations: what cases expect against what came back, rates by tool, absolute bounds.

``expected(case_id, what, key, kind)`` and ``returned(case_id, what, rank, key, kind)`` are long
tables, so every measure is a join and a count over all cases together. ``what`` names
entry, anchor, segment, constraint, source or signal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: ranks that count -----------------------------------------------------
TOP = 3


def case_counts(cases: DataFrame, expected: DataFrame, returned: DataFrame) -> DataFrame:
    """``(case_id, tool, what, n_expected, n_returned, matched, typed, recovered, at_1, at_3)`` of every case and kind of thing.

    ``matched``: returned things that were expected; ``typed``: those of the expected kind
    too; ``recovered``: expected things among the first three ranks; ``at_1`` and ``at_3``: whether one
    is among the first one or three.
    """
    e = expected.select("case_id", "what", "key", F.col("kind").alias("e_kind")).distinct()
    r = returned.select("case_id", "what", "key", "kind", "rank")
    wanted = e.groupBy("case_id", "what").agg(F.countDistinct("key").alias("n_expected"))
    got = r.groupBy("case_id", "what").agg(F.count("*").alias("n_returned"))
    hit = r.join(e, ["case_id", "what", "key"])
    met = hit.groupBy("case_id", "what", "key", "rank").agg(F.bool_or(F.col("kind").eqNullSafe(F.col("e_kind"))).alias("typed"))
    met = met.groupBy("case_id", "what").agg(
        F.count("*").alias("matched"), F.count_if("typed").alias("typed"), F.countDistinct(F.when(F.col("rank") <= TOP, F.col("key"))).alias("recovered"), F.min("rank").alias("first")
    )
    out = wanted.join(got, ["case_id", "what"], "full").join(met, ["case_id", "what"], "left").na.fill(0, ["n_expected", "n_returned", "matched", "typed", "recovered"])
    first = F.coalesce("first", F.lit(1 << 30))
    return cases.select("case_id", "tool").join(out, "case_id").select(
        "case_id", "tool", "what", "n_expected", "n_returned", "matched", "typed", "recovered", (first <= 1).alias("at_1"), (first <= TOP).alias("at_3")
    )


def tool_metrics(counts: DataFrame) -> DataFrame:
    """``(tool, metric, value)``: precision of what came back, recall of what was expected, and success at ranks, by tool and thing.

    A rate without anything to count has no row.
    """
    asked = F.col("n_expected") > 0
    g = counts.groupBy("tool", "what").agg(
        F.sum("matched").alias("m"), F.sum("typed").alias("t"), F.sum("n_returned").alias("r"), F.sum("recovered").alias("c"), F.sum("n_expected").alias("e"),
        F.count_if(asked).alias("n"), F.count_if(asked & F.col("at_1")).alias("s1"), F.count_if(asked & F.col("at_3")).alias("s3"), F.sum(F.when(~asked, F.col("n_returned")).otherwise(0)).alias("false"),
    )
    rate = lambda name, a, b: F.when(F.col(b) > 0, F.struct(F.concat("what", F.lit(f"_{name}")).alias("metric"), (F.col(a) / F.col(b)).alias("value")))
    rows = F.array(rate("precision", "m", "r"), rate("type_precision", "t", "m"), rate("recall_at_3", "c", "e"), rate("success_at_1", "s1", "n"), rate("success_at_3", "s3", "n"), rate("false_rate", "false", "r"))
    return g.select("tool", F.explode(F.array_compact(rows)).alias("x")).select("tool", "x.*")


def run_metrics(cases: DataFrame) -> DataFrame:
    """``(tool, metric, value)`` from ``cases(case_id, tool, passed, status, latency_ms)``: pass rate, unsupported rate, latencies."""
    from quern.operators.evaluation import percentile_rows

    g = cases.groupBy("tool").agg(F.avg(F.col("passed").cast("double")).alias("case_pass_rate"), F.avg((F.col("status") == "unsupported").cast("double")).alias("unsupported_case_rate"))
    p = percentile_rows(cases, "tool", "latency_ms", {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95})
    wide = g.join(p, "tool", "left")
    names = ("case_pass_rate", "unsupported_case_rate", "latency_p50_ms", "latency_p95_ms")
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select("tool", F.explode(rows).alias("x")).select("tool", "x.*").where("value is not null")


def median_of_runs(runs: DataFrame) -> DataFrame:
    """``(tool, metric, value)``: the median over ``runs(run, tool, metric, value)``, the mean of the middle two of an even number."""
    return runs.groupBy("tool", "metric").agg(F.percentile("value", 0.5).alias("value"))


def threshold_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``(tool, metric, comparator, actual, bound, passed)``: absolute bounds on metrics.

    ``thresholds(tool, metric, comparator, bound)`` come from a table; ``>=`` and ``<=`` include the bound. A bound whose metric
    is missing fails: what was not measured is not passed.
    """
    t = F.broadcast(thresholds)  # a file of bounds
    j = t.join(metrics.withColumnRenamed("value", "actual"), ["tool", "metric"], "left")
    ok = F.when(F.col("comparator") == ">=", F.col("actual") >= F.col("bound")).when(F.col("comparator") == "<=", F.col("actual") <= F.col("bound")).otherwise(F.col("actual") == F.col("bound"))
    return j.select("tool", "metric", "comparator", "actual", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


def cost_gate(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """``(tool, passed)``: tokens may grow only where recall, MRR or nDCG grow; both sides ``(tool, metric, value)``."""
    pick = lambda df, p: df.groupBy("tool").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(p + m) for m in ("tokens", "recall", "mrr", "ndcg")])
    j = pick(baseline, "b_").join(pick(candidate, "c_"), "tool")
    better = (F.col("c_recall") > F.col("b_recall")) | (F.col("c_mrr") > F.col("b_mrr")) | (F.col("c_ndcg") > F.col("b_ndcg"))
    return j.select("tool", F.coalesce((F.col("c_tokens") <= F.col("b_tokens")) | better, F.lit(False)).alias("passed"))
