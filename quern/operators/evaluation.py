"""Retrieval metrics, percentiles, gates, rollout buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: how much worse a candidate may be ------------------------------------
QUALITY_DROP, P50_GROWTH, P95_GROWTH, P95_MS, TOKEN_GROWTH = 0.02, 0.20, 0.12, 30.0, 0.05


def canonical_path(path: Column) -> Column:
    """Forward slashes, no leading ``./``, no doubled slashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/"), r"^(\./)+", "")


def retrieval_metrics(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """``(query_id, recall, mrr, ndcg)``: of the first ``k`` hits of every judged query.

    ``hits(query_id, doc, rank)``, ``qrels(query_id, doc, relevance)``. A document is
    credited once, at its best rank; the ideal ranking takes all judgements.
    """
    best = hits.where(F.col("rank") <= k).groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))
    found = best.join(qrels, ["query_id", "doc"]).groupBy("query_id").agg(
        F.count("*").alias("hit"),
        F.min("rank").alias("first"),
        F.sum((F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "doc"))
    gain = F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("r") + 1.0))
    ideal = qrels.withColumn("r", order).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(gain).alias("idcg"))
    out = ideal.join(found, "query_id", "left")
    return out.select(
        "query_id",
        (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.col("dcg") / F.nullif("idcg", F.lit(0.0)), F.lit(0.0)).alias("ndcg"),
    )


def percentile_nearest(values: Column, p: float) -> Column:
    """Element at ``round((n - 1) * p)`` of the sorted values, halves rounded up; an aggregate.

    For series of bounded size, such as the latencies of a run.
    """
    arr = F.array_sort(F.collect_list(values))
    return F.get(arr, F.floor((F.size(arr) - 1) * F.lit(p) + 0.5).cast("int"))


def percentile_rows(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """The same by ranks instead of arrays, for groups of any size: no group is collected."""
    by = Window.partitionBy(group)
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).alias("v"))
    rows = rows.withColumns({"r": F.row_number().over(by.orderBy("v")) - 1, "n": F.count("*").over(by)})
    at = {name: F.max(F.when(F.col("r") == F.floor((F.col("n") - 1) * F.lit(p) + 0.5), F.col("v"))).alias(name) for name, p in points.items()}
    return rows.groupBy(group).agg(*at.values())


def median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Median of a group; the mean of the two middle values for even counts."""
    return df.groupBy(group).agg(F.percentile(value, 0.5).alias("median"))


def gates(base: DataFrame, cand: DataFrame) -> DataFrame:
    """``(category, metric, baseline, candidate, bound, pass)`` from one row of metrics each side.

    Both have recall, mrr, ndcg, p50, p95, tokens. Growing token costs pass only with
    better quality.
    """
    both = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns]).crossJoin(F.broadcast(cand))  # one row each
    rows = [(c, "quality", F.col(f"b_{c}") * (1 - QUALITY_DROP), True) for c in ("recall", "mrr", "ndcg")]
    rows.append(("p50", "latency", F.col("b_p50") * (1 + P50_GROWTH), False))
    rows.append(("p95", "latency", F.least(F.col("b_p95") * (1 + P95_GROWTH), F.col("b_p95") + P95_MS), False))
    rows.append(("tokens", "token_cost", F.col("b_tokens") * (1 + TOKEN_GROWTH), False))
    uplift = (F.col("recall") > F.col("b_recall")) | (F.col("mrr") > F.col("b_mrr")) | (F.col("ndcg") > F.col("b_ndcg"))

    def row(metric: str, category: str, bound: Column, least: bool) -> Column:
        ok = F.col(metric) >= bound if least else F.col(metric) <= bound
        if category == "token_cost":
            ok = ok & ((F.col(metric) <= F.col(f"b_{metric}")) | uplift)
        return F.struct(
            F.lit(category).alias("category"), F.lit(metric).alias("metric"), F.col(f"b_{metric}").alias("baseline"), F.col(metric).alias("candidate"), bound.alias("bound"), ok.alias("pass")
        )

    return both.select(F.explode(F.array(*[row(*r) for r in rows])).alias("g")).select("g.*")


def metric_diff(base: Column, cand: Column, higher_is_better: bool) -> Column:
    """Struct of the absolute and relative change and its direction."""
    d = cand - base
    better = d > 0 if higher_is_better else d < 0
    direction = F.when(d == 0, "same").when(better, "improved").otherwise("regressed")
    return F.struct(d.alias("abs"), F.when(base != 0, d / base * 100).alias("pct"), direction.alias("direction"))


def rollout_bucket(key: Column) -> Column:
    """0 to 99, from the first 8 hex digits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100


def rolled_out(key: Column, percent: int) -> Column:
    return rollout_bucket(key) < percent


def pass_streak(runs: DataFrame) -> DataFrame:
    """``(series, streak)``: passing runs since the last failure; ``runs(series, at, ok)``."""
    last_bad = runs.groupBy("series").agg(F.max(F.when(~F.col("ok"), F.col("at"))).alias("bad"))
    return runs.join(last_bad, "series").groupBy("series").agg(F.count_if(F.col("ok") & (F.col("bad").isNull() | (F.col("at") > F.col("bad")))).alias("streak"))
