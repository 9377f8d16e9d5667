"""JSON and git readers: benchmark sets, policies, thresholds, change logs."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession

POLICY_VERSION = 4


def benchmark_set(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """``queries(query_id, stratum, query)`` and ``qrels(query_id, doc, relevance)``.

    Takes an object with ``queries`` or a bare array; judgements as strings or objects,
    under ``qrels`` or ``relevant_paths``.
    """
    data = json.loads(text)
    rows = data["queries"] if isinstance(data, dict) else data
    queries, qrels = [], []
    for k, q in enumerate(rows):
        qid = str(q.get("id") or k)
        queries.append((qid, q.get("stratum") or "default", q["query"]))
        for r in q.get("qrels") or q.get("relevant_paths") or []:
            qrels.append((qid, r, 1.0) if isinstance(r, str) else (qid, r["path"], float(r.get("relevance", 1.0))))
    return (
        spark.createDataFrame(queries, "query_id string, stratum string, query string"),
        spark.createDataFrame(qrels, "query_id string, doc string, relevance double"),
    )


def quality_policy(text: str) -> dict:
    """A policy of the supported version; unknown keys and bad thresholds are errors."""
    data = json.loads(text)
    if data.get("version") != POLICY_VERSION:
        raise ValueError(f"policy version {data.get('version')!r}, expected {POLICY_VERSION}")
    unknown = set(data) - {"version", "thresholds", "scopes", "suppressions", "zones", "metadata", "git", "tests"}
    if unknown:
        raise ValueError(f"unknown policy keys: {sorted(unknown)}")
    for rule, value in (data.get("thresholds") or {}).items():
        if not isinstance(value, int) or value < 0:
            raise ValueError(f"threshold of {rule!r} must be a natural number")
    return data


def gate_thresholds(text: str) -> tuple[dict[str, float], dict[str, float]]:
    """Lower and upper bounds of metrics."""
    data = json.loads(text)
    return {k: float(v) for k, v in data.get("min", {}).items()}, {k: float(v) for k, v in data.get("max", {}).items()}


def git_log(spark: SparkSession, root: str, days: int = 90) -> DataFrame:
    """``(path, commit, author, churn)`` of the last ``days`` days, from ``git log --numstat``."""
    mark = "\x1e"
    out = subprocess.run(
        ["git", "-C", root, "log", f"--since={days} days ago", "--numstat", f"--format={mark}%H\t%ae"], capture_output=True, text=True, check=True
    ).stdout
    return spark.createDataFrame(parse_git_log(out, mark), "path string, commit string, author string, churn long")


def parse_git_log(text: str, mark: str = "\x1e") -> list[tuple[str, str, str, int]]:
    rows, commit, author = [], "", ""
    for line in text.split("\n"):
        if line.startswith(mark):
            commit, _, author = line[len(mark) :].partition("\t")
        elif line.count("\t") >= 2:
            added, deleted, path = line.split("\t", 2)
            rows.append((path, commit, author, sum(int(x) for x in (added, deleted) if x.isdigit())))
    return rows


def git_changed(spark: SparkSession, root: str, since: str) -> DataFrame:
    """``(status, path)`` changed between the merge base with ``since`` and the work tree, untracked files too."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout
    base = run("merge-base", since, "HEAD").strip()
    rows = [tuple(x.split("\t")[:1] + x.split("\t")[-1:]) for x in run("diff", "--name-status", base).splitlines() if x]
    rows += [("A", x) for x in run("ls-files", "--others", "--exclude-standard").splitlines() if x]
    return spark.createDataFrame(rows, "status string, path string")
