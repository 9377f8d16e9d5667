"""Cheapest ways in tasks that hold the graph: against joins, and without a table of shared dependencies."""

from __future__ import annotations

import random

import pytest

from quern.operators import graph as G
from quern.operators import navigation as N
from quern.operators import ways as W

EDGES = "src string, dst string, kind string, raw_count long, weight double"


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    names = [f"n{k:02}" for k in range(60)] + ["é", "Z", "lone"]
    rows = set()
    for _ in range(120):  # few counts, so that many ways tie
        a, b, n = rng.choice(names[:-1]), rng.choice(names[:-1]), rng.choice((1, 1, 2))
        rows.add((a, b, "ref_exact", n, float(n)) if rng.random() < 0.7 else (a, b, "ref_tail_unique", n, n * G.TAIL_WEIGHT))
    deps = {(x, f"d{rng.randrange(14)}") for x in names[30:-1] for _ in range(rng.randrange(3))}
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(150)} | {("n00", "lone"), ("n01", "n01")}
    return spark.createDataFrame(sorted(rows), EDGES), spark.createDataFrame(sorted(deps), "path string, dep string"), spark.createDataFrame(sorted(pairs), "start string, target string")


@pytest.mark.parametrize("hops", [1, 3, 6])
def test_ways_in_tasks_are_those_of_joins(spark, graph, monkeypatch, hops):
    edges, deps, pairs = graph
    monkeypatch.setattr(W, "_CHUNK", 40)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    held = rows(N.best_paths(edges, pairs, hops, deps))
    monkeypatch.setattr(W, "EDGES_HELD", 0)
    assert held == rows(N.best_paths(edges, pairs, hops, deps)) and held
    assert hops < 6 or any(r[5] > 4 for r in held)


def test_routes_form_no_table_of_shared_dependencies(spark, graph, monkeypatch):
    edges, deps, pairs = graph
    whole = edges.unionByName(G.edges_shared_dep(deps))
    starts = pairs.select("start").distinct().selectExpr("start as seed", "'path' as seed_kind", "start as path", "cast(null as string) symbol", "1.0D as score")
    want = [sorted(map(str, df.collect())) for df in N.route_trace(starts, pairs.where("start <> target"), whole, 3)]

    def no_table(deps):
        raise AssertionError("all pairs of files that share a dependency were formed")

    monkeypatch.setattr(G, "edges_shared_dep", no_table)
    got = [sorted(map(str, df.collect())) for df in N.route_trace(starts, pairs.where("start <> target"), edges, 3, deps=deps)]
    assert got == want and got[0]


def test_references_meet_each_symbol_once(spark):
    refs = spark.createDataFrame([("a", "m::word"), ("a", "word"), ("b", "sword"), ("b", "sword"), ("c", "other")], "path string, symbol string")
    names = spark.createDataFrame([("word",)], "name string")
    assert [tuple(r) for r in N.references_to(names, refs, 5).orderBy("path").collect()] == [("word", "a", 2, 3), ("word", "b", 2, 1)]
