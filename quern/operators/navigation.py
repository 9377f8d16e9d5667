"""Routes through the file graph: candidates for seeds, targets, cheapest paths, ranked routes.

Everything is set-based: tables of seeds, starts and targets go through each step
together, so a thousand seeds cost the same number of joins as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import graph as G
from quern.operators import investigation as I
from quern.operators import ways as W
from quern.sources.sinks import materialize

# --- fixed values: scores, limits and the order in which candidates and starts count ----
EXACT_SCORE, PARTIAL_SCORE = 1.0, 0.8
SOURCE_RANK = {"symbol_lookup": 0, "search_candidate": 1}
MAX_HOPS = 6
#: Characters of a seed by which it meets the names that may hold it.
KEY_CHARS = 8
TARGETS_PER_START = 8
ALTERNATES = 2
START_PRIORITY = {"endpoint": 6, "ui": 5, "service": 4, "crud": 3, "api_client": 3, "query": 2, "test": 1, "migration": 1}
UNKNOWN_PRIORITY = {"validator": 4, "model": 2}
SUPPORTED = ("rust", "python", "typescript", "javascript", "sql", "prisma")
ADJACENT_KINDS = ("crud", "query", "test", "migration")
#: Costs are whole millionths, so that sums do not depend on their order.
COST_SCALE = 1_000_000


def _ranked(df: DataFrame, keys: tuple, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` rows of each key; Spark keeps that many a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place", rank).where(F.col("place") <= limit)


# --- candidates --------------------------------------------------------------------------
CANDIDATE = "seed string, seed_kind string, path string, language string, symbol string, line int, source_kind string, match_kind string, score double"


def lookup_symbols(seeds: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
    """``(seed, path, name, exact)``: for every seed the names equal to or holding it.

    Exact ones first, then short ones. A name meets the seeds that begin like some part of
    it: both are joined on the first ``KEY_CHARS`` characters of the seed, so that names and seeds are
    not compared all with all. An empty seed is in every name.
    """
    want = seeds.select("seed", F.lower(F.trim("seed")).alias("low")).distinct()
    want = want.withColumn("size", F.least(F.length("low"), F.lit(KEY_CHARS))).withColumn("key", F.substring("low", 1, KEY_CHARS))
    sizes = F.array(*[F.lit(r[0]) for r in want.select("size").distinct().orderBy("size").collect()])  # KEY_CHARS + 1 at most
    names = symbols.select("name").distinct().withColumn("lowered", F.lower("name"))
    parts = F.flatten(F.transform(sizes.cast("array<int>"), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("lowered") - n + 1)), lambda i: F.substr("lowered", i, n))))
    parts = names.select("name", "lowered", F.explode(F.array_distinct(parts)).alias("key"))
    hit = parts.join(want, "key").where(F.contains("lowered", F.col("low"))).select("name", "seed").distinct()
    hit = symbols.select("path", "name").distinct().join(hit, "name")
    hit = hit.withColumn("exact", F.col("name") == F.trim("seed"))
    return _ranked(hit, ("seed",), limit, F.desc("exact"), F.length("name"), F.col("name"), F.col("path")).select("seed", "path", "name", "exact")


def collect_candidates(seeds: DataFrame, files: DataFrame, symbols: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Candidates of ``seeds(seed, seed_kind)``, in the columns of ``CANDIDATE`` and ``supported``.

    ``path``: the path itself; ``path_line``: path and line of ``path:line``, a malformed
    one being an error; ``symbol``: names that hold it; ``query``: the best three times
    ``limit`` search ``hits(seed, path, score)`` and names, ranked by their overlap
    with the query, three times ``limit`` of them kept. Each (path, symbol, line) once a seed.
    """
    seeds = seeds.select(F.col("seed"), F.col("seed_kind"))
    none = F.lit(None).cast("string")

    def row(df: DataFrame, path: Column, symbol: Column, line: Column, source: str, match: Column, score: Column) -> DataFrame:
        return df.select(
            "seed", "seed_kind", path.alias("path"), symbol.alias("symbol"), line.cast("int").alias("line"), F.lit(source).alias("source_kind"), match.alias("match_kind"), score.cast("double").alias("score")
        )

    anchors = seeds.where("seed_kind = 'path'")
    lined = seeds.where("seed_kind = 'path_line'")
    number = F.regexp_extract("seed", r"^\s*.*:(\d+)\s*$", 1)
    number = F.when(number != "", number.cast("int")).otherwise(F.raise_error(F.concat(F.lit("not of the form path:line: "), F.col("seed"))).cast("int"))
    rows = row(anchors, F.trim("seed"), none, F.lit(None), "path_anchor", F.lit("path_anchor"), F.lit(1.0))
    rows = rows.unionByName(row(lined, F.regexp_extract("seed", r"^\s*(.*):\d+\s*$", 1), none, F.greatest(number, F.lit(1)), "path_anchor", F.lit("path_anchor"), F.lit(1.0)))

    named = lookup_symbols(seeds.where("seed_kind in ('symbol', 'query')"), symbols, limit).join(F.broadcast(seeds.where("seed_kind in ('symbol', 'query')")), "seed")
    match = F.when(F.col("exact"), "exact_symbol").otherwise("partial_symbol")
    found = row(named, F.col("path"), F.col("name"), F.lit(None), "symbol_lookup", match, F.when(F.col("exact"), EXACT_SCORE).otherwise(PARTIAL_SCORE))
    best = _ranked(hits, ("seed",), 3 * limit, F.desc("score"), F.col("path")).join(F.broadcast(seeds.where("seed_kind = 'query'")), "seed")
    searched = row(best, F.col("path"), none, F.lit(None), "search_candidate", F.lit("query_search"), F.col("score"))

    asked = found.where("seed_kind = 'query'").unionByName(searched)
    own = I.overlap(F.col("seed"), F.concat_ws(" ", "path", F.coalesce("symbol", F.lit("")), "source_kind"))
    rank = F.when(F.col("source_kind") == "symbol_lookup", SOURCE_RANK["symbol_lookup"]).otherwise(SOURCE_RANK["search_candidate"])
    asked = _ranked(asked.withColumn("own", own), ("seed",), 3 * limit, F.desc("own"), F.desc("score"), rank, F.col("path"), F.col("symbol")).drop("own", "place")
    rows = rows.unionByName(found.where("seed_kind = 'symbol'")).unionByName(asked)
    rows = rows.dropDuplicates(["seed", "seed_kind", "path", "symbol", "line"])
    rows = rows.join(files.select("path", "language"), "path", "left")
    return rows.withColumn("supported", F.coalesce(F.col("language").isin(*SUPPORTED), F.lit(False)))


def start_priority(path: Column) -> Column:
    kind, source = I.route_segment(path), I.source_kind(path)
    out = F.lit(0)
    for name, p in UNKNOWN_PRIORITY.items():
        out = F.when((kind == "unknown") & (source == name), p).otherwise(out)
    for name, p in START_PRIORITY.items():
        out = F.when(kind == name, p).otherwise(out)
    return out


def prioritized_starts(candidates: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` candidates of each seed: by role and score, those of queries by score and role."""
    asked = F.col("seed_kind") == "query"
    p, s = start_priority(F.col("path")).cast("double"), F.col("score")
    order = (F.when(asked, s).otherwise(p).desc(), F.when(asked, p).otherwise(s).desc(), F.col("path"), F.col("symbol"))
    return _ranked(candidates, ("seed", "seed_kind"), limit, *order).withColumnRenamed("place", "start_rank")


# --- targets -----------------------------------------------------------------------------
def related_to(anchors: DataFrame, refs: DataFrame, symbols: DataFrame, deps: DataFrame, limit: int) -> DataFrame:
    """``(anchor, path, score, dep_overlap, ref_overlap, symbol_overlap)``: the files nearest to each anchor.

    Three joins for all ``anchors(anchor)``: what an anchor depends on, refers to and
    defines meets the same of all other files.
    """
    anchors = anchors.select("anchor").distinct()
    mine = lambda df, c: df.join(anchors, df["path"] == anchors["anchor"]).select("anchor", F.col(c).alias("name")).distinct()
    theirs = lambda df, c: df.select("path", F.col(c).alias("name")).distinct()
    tail = lambda df: df.select("path", T.symbol_tail(F.col("symbol")).alias("name"))
    hints = mine(tail(refs), "name").unionByName(mine(deps.select("path", T.symbol_tail(F.col("dep")).alias("name")), "name")).distinct()
    parts = (
        ("dep_overlap", mine(deps, "dep"), theirs(deps, "dep")),
        ("ref_overlap", hints, theirs(symbols, "name")),
        ("ref_overlap", mine(symbols, "name"), theirs(tail(refs), "name")),
        ("symbol_overlap", mine(symbols, "name"), theirs(symbols, "name")),
    )
    rows = None
    for kind, a, b in parts:
        n = a.join(b, "name").where("path <> anchor").groupBy("anchor", "path").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        rows = n if rows is None else rows.unionByName(n)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    wide = rows.groupBy("anchor", "path").agg(*[pick(k) for k in ("dep_overlap", "ref_overlap", "symbol_overlap")])
    score = F.col("dep_overlap") * G.RELATED_DEP + F.col("ref_overlap") * G.RELATED_REF + F.col("symbol_overlap") * G.RELATED_SYMBOL
    wide = wide.withColumn("score", F.round(score, 6))
    return _ranked(wide, ("anchor",), limit, F.desc("score"), F.desc("ref_overlap"), F.desc("dep_overlap"), F.desc("symbol_overlap"), F.col("path")).drop("place")


def references_to(names: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """``(name, path, refs, rank)``: the files that refer to each name; 3 as such, 2 by tail, 1 within."""
    want = F.broadcast(names.select("name").distinct())  # as many rows as there are names asked for
    s, n = F.col("symbol"), F.col("name")
    rank = F.when(s == n, 3).when(F.endswith(s, F.concat(F.lit("::"), T.symbol_tail(n))), 2).otherwise(1)
    # Each symbol meets the names once, however often files refer to it.
    fits = refs.select("symbol").distinct().join(want, F.contains(s, n) | F.endswith(s, F.concat(F.lit("::"), T.symbol_tail(n)))).withColumn("rank", rank)
    hit = refs.join(materialize(fits), "symbol")
    hit = hit.groupBy("name", "path").agg(F.count("*").alias("refs"), F.max("rank").alias("rank"))
    return _ranked(hit, ("name",), limit, F.desc("rank"), F.desc("refs"), F.col("path")).drop("place")


def adjacent_to(starts: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """``(start, path)``: data access, tests, migrations and models whose path holds a word of the start's name."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.substring_index(F.substring_index("start", "/", -1), ".", 1)), "_"), lambda w: F.length(w) >= 3))
    want = F.broadcast(starts.select("start").distinct().withColumn("words", words))  # the starts of stated seeds
    fits = I.route_segment(F.col("path")).isin(*ADJACENT_KINDS) | (I.source_kind(F.col("path")) == "model")
    near = files.where(F.col("language").isin(*SUPPORTED)).select("path").where(fits)
    hit = near.join(want, F.exists("words", lambda w: F.contains(F.lower("path"), w))).where("path <> start")
    return _ranked(hit, ("start",), limit, F.col("path")).select("start", "path")


def route_targets(starts: DataFrame, files: DataFrame, refs: DataFrame, symbols: DataFrame, deps: DataFrame, limit: int = TARGETS_PER_START) -> DataFrame:
    """``(start, target)`` of ``starts(path, symbol)``: related, referring and adjacent files with a known role."""
    own = materialize(starts.select(F.col("path").alias("start"), "symbol").distinct())
    related = related_to(own.select(F.col("start").alias("anchor")), refs, symbols, deps, limit).select(F.col("anchor").alias("start"), "path")
    referred = references_to(own.where("symbol is not null").select(F.col("symbol").alias("name")), refs, limit)
    referred = own.join(referred, F.col("symbol") == F.col("name")).select("start", "path")
    rows = related.unionByName(referred).unionByName(adjacent_to(own, files, limit)).where("path <> start").distinct()
    meant = (I.route_segment(F.col("path")) != "unknown") | I.source_kind(F.col("path")).isin("validator", "model")
    return rows.where(meant).select("start", F.col("path").alias("target"))


# --- paths -------------------------------------------------------------------------------
def _start_level(roots: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return roots.select("root", F.col("root").alias("node"), zero.alias("cost"), zero.alias("gain"), F.array("root").alias("nodes"))


def _next_level(levels: list[DataFrame], steps: DataFrame, bounds: DataFrame, back: bool = False) -> DataFrame:
    """What the last of ``levels`` reaches in one more of ``steps(a, b, step, load)``, one way for each root and end.

    Ends that an earlier level reached as cheaply are left out, for more steps at no less
    cost are never part of a best way; so is what costs its root's ``bounds(root, bound)``
    already. ``nodes`` are in the order of the way, so those of steps taken back end at the root.
    """
    on = levels[-1].join(steps, F.col("node") == F.col("a"))
    nodes = F.concat(*((F.array("b"), "nodes") if back else ("nodes", F.array("b"))))
    on = on.select("root", F.col("b").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), (F.col("gain") - F.col("load")).alias("gain"), nodes.alias("nodes"))
    on = on.join(bounds, "root").where("cost < bound").drop("bound")
    best = on.groupBy("root", "node").agg(F.min(F.struct("cost", "gain", "nodes")).alias("best")).select("root", "node", "best.*")
    seen = levels[0].select("root", "node", "cost")
    for level in levels[1:]:
        seen = seen.unionByName(level.select("root", "node", "cost"))
    seen = seen.groupBy("root", "node").agg(F.min("cost").alias("known"))
    return materialize(best.join(seen, ["root", "node"], "left").where("known is null or cost < known").drop("known"))


#: More than any way costs.
_FAR = 1 << 62


def shared_step(n: int) -> int:
    """The cost of a step to a file that shares ``n`` dependencies, as :func:`quern.operators.graph.step_cost` has it."""
    return round((1 / max(n * G.DEP_WEIGHT, 0.05) + G.KIND_PENALTY["shared_dep"]) * COST_SCALE)


def shared_load(n: int) -> int:
    return round(n * G.DEP_WEIGHT * COST_SCALE)


def best_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS, deps: DataFrame | None = None) -> DataFrame:
    """``(start, target, nodes, cost, weight, hops)``: the cheapest way of each pair, if it has one.

    Files that share some of ``deps(path, dep)``, distinct, have edges too that ``edges`` has not. A graph
    whose counted size allows it is held by the tasks (:mod:`quern.operators.ways`); a larger one is joined.
    """
    cost = F.round(G.step_cost(F.col("kind"), F.col("weight")) * COST_SCALE).cast("long")
    load = F.round(F.col("weight") * COST_SCALE).cast("long")
    cheapest = lambda e: e.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct(cost.alias("step"), (-load).alias("back"))).alias("s")).select("src", "dst", "s.step", (-F.col("s.back")).alias("load"))
    steps = materialize(cheapest(edges))
    asked = pairs.select("start", "target").where("start <> target").distinct()
    if W.fits(steps, deps):
        best = W.ways(steps, asked, max_hops, deps, (shared_step, shared_load))
    else:
        whole = steps if deps is None else materialize(cheapest(edges.unionByName(G.edges_shared_dep(deps))))
        best = joined_paths(whole, asked, max_hops)
    return best.select("start", "target", "w.nodes", (F.col("w.cost") / COST_SCALE).alias("cost"), (-F.col("w.gain") / COST_SCALE).alias("weight"), "w.hops")


def joined_paths(steps: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """``(start, target, w)`` of ``pairs`` by joins with ``steps(src, dst, step, load)``, for a graph of any size.

    Ways go half from the start and half back from
    the target and meet in the middle, so a graph of degree d costs d to half the hops on
    each side. Every level keeps one way for each root and node: the least cost, then the most
    weight, then the least list of nodes; that order is kept by both halves, so the
    best whole is made of best halves. Among hops the least cost wins, then the fewest; so
    what a pair has already bounds all that comes after, for its start, its target and itself,
    and a pair one of whose ends reaches nothing new asks for no more steps of the other.
    """
    way = "struct<cost:bigint,hops:int,gain:bigint,nodes:" + f"array<{pairs.schema['start'].dataType.simpleString()}>>"
    known = materialize(pairs.select("start", "target", F.lit(None).cast(way).alias("w"), F.lit(True).alias("alive")))
    sides = {
        "start": ([_start_level(known.select(F.col("start").alias("root")).distinct())], steps.select(F.col("src").alias("a"), F.col("dst").alias("b"), "step", "load")),
        "target": ([_start_level(known.select(F.col("target").alias("root")).distinct())], steps.select(F.col("dst").alias("a"), F.col("src").alias("b"), "step", "load")),
    }
    bound = F.when(F.col("alive"), F.coalesce(F.col("w.cost"), F.lit(_FAR))).otherwise(F.lit(-1))
    for hops in range(1, max_hops + 1):
        side = "start" if hops % 2 else "target"
        levels, moves = sides[side]
        levels.append(_next_level(levels, moves, known.groupBy(F.col(side).alias("root")).agg(F.max(bound).alias("bound")), side == "target"))
        # Who reaches nothing new on this side has no longer way either.
        reached = levels[-1].select(F.col("root").alias(side), F.lit(True).alias("reached")).distinct()
        known = known.join(reached, side, "left").select("start", "target", "w", (F.col("alive") & F.col("reached").isNotNull()).alias("alive"))
        one = sides["start"][0][(hops + 1) // 2].select(F.col("root").alias("start"), "node", F.col("cost").alias("c1"), F.col("gain").alias("g1"), F.col("nodes").alias("n1"))
        two = sides["target"][0][hops // 2].select(F.col("root").alias("target"), "node", F.col("cost").alias("c2"), F.col("gain").alias("g2"), F.col("nodes").alias("n2"))
        met = one.join(known.select("start", "target", bound.alias("bound")), "start").where("c1 < bound").join(two, ["target", "node"]).where("c1 + c2 < bound")
        nodes = F.concat("n1", F.slice("n2", 2, max_hops))
        new = F.struct((F.col("c1") + F.col("c2")).alias("cost"), F.lit(hops).alias("hops"), (F.col("g1") + F.col("g2")).alias("gain"), nodes.alias("nodes"))
        met = met.groupBy("start", "target").agg(F.min(new).alias("new"))
        known = materialize(known.join(met, ["start", "target"], "left").select("start", "target", F.coalesce("new", "w").alias("w"), "alive"))
    return known.where("w is not null").select("start", "target", "w")


def path_steps(paths: DataFrame, edges: DataFrame, deps: DataFrame | None = None) -> DataFrame:
    """``paths`` with ``steps``: an array of (path, kind, raw_count, weight) for the edges of each way, the cheapest of parallel ones.

    Edges of shared ``deps`` are made for the steps of the ways alone.
    """
    cost = G.step_cost(F.col("kind"), F.col("weight"))
    ends = materialize(paths.select(F.posexplode(F.slice("nodes", 1, F.size("nodes") - 1)).alias("k", "src"), "nodes").select("src", F.get("nodes", F.col("k") + 1).alias("dst")).distinct())
    edges = edges.join(ends, ["src", "dst"], "left_semi")
    edges = edges if deps is None else edges.unionByName(G.shared_dep_between(deps, ends))
    best = edges.groupBy("src", "dst").agg(F.min(F.struct(F.round(cost * COST_SCALE).cast("long").alias("c"), (-F.col("weight")).alias("w"), "kind", "raw_count")).alias("e"))
    hop = paths.select("start", "target", F.posexplode(F.slice("nodes", 1, F.size("nodes") - 1)).alias("k", "src"), "nodes").withColumn("dst", F.get("nodes", F.col("k") + 1))
    hop = hop.join(best, ["src", "dst"]).select("start", "target", F.struct("k", F.col("dst").alias("path"), "e.kind", "e.raw_count", (-F.col("e.w")).alias("weight")).alias("step"))
    steps = hop.groupBy("start", "target").agg(F.array_sort(F.collect_list("step")).alias("steps"))  # max_hops steps at most
    return paths.join(steps, ["start", "target"])


# --- routes ------------------------------------------------------------------------------
def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


SEGMENT = "struct<kind:string,path:string,score:double>"


def collapse(segments: Column) -> Column:
    """Neighbours of one kind become one segment: the first one's path, the best score."""

    def step(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        merged = F.struct(last["kind"].alias("kind"), last["path"].alias("path"), F.greatest(last["score"], s["score"]).alias("score"))
        same = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["kind"] == s["kind"])
        return F.when(same, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(segments, F.array().cast(f"array<{SEGMENT}>"), step)


def route_trace(candidates: DataFrame, targets: DataFrame, edges: DataFrame, limit: int, max_hops: int = MAX_HOPS, deps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ranked routes of every seed, and the gaps: ``(routes, gaps)``.

    Starts are the first ``limit`` candidates of a seed by role; ``targets(start, target)``.
    A route is the cheapest path from a start to a target with neighbours of one role
    collapsed; routes of one role alone do not count, and a start without any other is a
    route by itself. Routes rank by relevance (score of the start; of queries mostly the
    overlap with a file on the way), confidence, length, weight and roles; of equal role
    sequences the first stays, and of those the best and two alternates. ``gaps`` are the
    (seed, from_kind, to_kind, reason, path) of pairs without a path. Shared ``deps`` are edges too.
    """
    starts = materialize(prioritized_starts(candidates, limit).withColumnRenamed("path", "start"))
    pairs = materialize(starts.select("start").distinct().join(targets, "start"))
    ways = materialize(path_steps(materialize(best_paths(edges, pairs, max_hops, deps)), edges, deps))
    kind = I.route_segment
    segment = lambda path, score: F.struct(kind(path).alias("kind"), path.alias("path"), score.cast("double").alias("score"))
    on = starts.join(ways, "start")
    rest = F.transform("steps", lambda s: segment(s["path"], _clamp(s["weight"] / F.greatest(s["raw_count"], F.lit(1)), 0.2, 1.0)))
    on = on.withColumn("segments", collapse(F.concat(F.array(segment(F.col("start"), F.col("score"))), rest))).where(F.size("segments") > 1)
    total = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["score"])
    on = on.select("seed", "seed_kind", "start", "symbol", "score", "segments", "nodes", "hops", "weight", _clamp(total / F.size("segments"), 0.1, 1.0).alias("confidence"))
    on = materialize(on)
    alone = starts.join(on.select("seed", "seed_kind", "start", "symbol").distinct(), [starts[c].eqNullSafe(on[c]) for c in ("seed", "seed_kind", "start", "symbol")], "left_anti")
    alone = alone.select(
        "seed", "seed_kind", "start", "symbol", "score", F.array(segment(F.col("start"), _clamp(F.col("score"), 0.2, 1.0))).alias("segments"), F.array("start").alias("nodes"),
        F.lit(0).alias("hops"), F.lit(0.0).alias("weight"), _clamp(F.col("score") * 0.75, 0.1, 1.0).alias("confidence"),
    )
    rows = on.unionByName(alone)
    near = I.overlap(F.col("seed"), F.concat_ws(" ", "start", F.coalesce("symbol", F.lit(""))))
    most = F.aggregate("segments", near, lambda a, s: F.greatest(a, I.overlap(F.col("seed"), F.concat_ws(" ", s["path"], I.source_kind(s["path"])))))
    own = _clamp(F.col("score"), 0.0, 1.0)
    relevance = F.when(F.col("seed_kind") == "query", _clamp(most * 0.7 + own * 0.3, 0.0, 1.0)).otherwise(own)
    kinds = F.array_join(F.transform("segments", lambda s: s["kind"]), ">")
    rows = rows.withColumn("relevance", F.round(relevance, 6)).withColumn("confidence", F.round("confidence", 6)).withColumn("kinds", kinds)
    order = (F.desc("relevance"), F.desc("confidence"), F.desc(F.size("segments")), F.desc("weight"), F.col("kinds"), F.col("nodes"))
    rows = _ranked(rows, ("seed", "seed_kind", "kinds"), 1, *order).drop("place")
    rows = _ranked(rows, ("seed", "seed_kind"), 1 + ALTERNATES, *order).withColumnRenamed("place", "rank")
    rows = rows.withColumn("collapsed_hops", F.size("nodes") - F.size("segments"))
    routes = rows.select("seed", "seed_kind", "rank", "kinds", "segments", "nodes", "hops", "weight", "collapsed_hops", "confidence", "relevance")
    lost = pairs.join(ways.select("start", "target"), ["start", "target"], "left_anti").join(starts.select("seed", "seed_kind", "start").distinct(), "start")
    gaps = lost.select(
        "seed", "seed_kind", kind(F.col("start")).alias("from_kind"), kind(F.col("target")).alias("to_kind"), F.concat(F.lit("call_path_unresolved:"), I.source_kind(F.col("target"))).alias("reason"), F.col("start").alias("path")
    ).distinct()
    return routes, gaps


def capability(seeds: DataFrame, candidates: DataFrame, routes: DataFrame, gaps: DataFrame) -> DataFrame:
    """``(seed, seed_kind, status)``: supported, partial where gaps or unsupported files are met, or unsupported."""
    flag = lambda df, name: df.groupBy("seed", "seed_kind").agg(F.lit(True).alias(name))
    out = seeds.select("seed", "seed_kind").join(flag(routes, "routed"), ["seed", "seed_kind"], "left").join(flag(gaps, "gap"), ["seed", "seed_kind"], "left")
    out = out.join(flag(candidates.where("not supported"), "odd"), ["seed", "seed_kind"], "left").na.fill(False, ["routed", "gap", "odd"])
    status = F.when(~F.col("routed") & F.col("odd"), "unsupported").when(~F.col("routed") | F.col("gap") | F.col("odd"), "partial").otherwise("supported")
    return out.select("seed", "seed_kind", status.alias("status"))
