"""Graph operators: edges from references, expansion, paths, cycles, navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.neighbours import neighbour_counts
from quern.sources.sinks import materialize

# --- fixed values: weights, decays and limits -------------------------------------------
EXACT_WEIGHT, TAIL_WEIGHT, DEP_WEIGHT = 1.0, 0.72, 0.35
SEED_LIMIT, FRONTIER_LIMIT, POOL_LIMIT = 12, 24, 64
SECOND_HOP_DECAY = 0.55
HUB_MIN, HUB_MAX = 0.25, 1.0
DIRECT_KINDS = ("ref_exact", "ref_tail_unique")
ENTRY_STEMS = ("main", "lib", "mod", "index", "__init__")
RELATED_DEP, RELATED_REF, RELATED_SYMBOL = 0.45, 1.2, 0.35


def _edges(rows: DataFrame, kind: str, weight: float) -> DataFrame:
    n = rows.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("raw_count"))
    return n.select("src", "dst", F.lit(kind).alias("kind"), "raw_count", (F.col("raw_count") * weight).alias("weight"))


def edges_ref_exact(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """An edge to each file that defines the very name a file refers to."""
    names = symbols.select(F.col("name").alias("symbol"), F.col("path").alias("dst")).distinct()
    return _edges(refs.join(names, "symbol").select(F.col("path").alias("src"), "dst"), "ref_exact", EXACT_WEIGHT)


def edges_ref_tail(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References without an exact match, by their tail, if exactly one file defines it."""
    names = symbols.select("name", "path").distinct()
    rest = refs.join(names.select(F.col("name").alias("symbol")), "symbol", "left_anti")
    rest = rest.withColumn("tail", T.symbol_tail(F.col("symbol"))).where(F.col("tail") != F.col("symbol"))
    single = names.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("dst")).where("n = 1")
    rows = rest.join(single.select(F.col("name").alias("tail"), "dst"), "tail")
    return _edges(rows.select(F.col("path").alias("src"), "dst"), "ref_tail_unique", TAIL_WEIGHT)


def edges_shared_dep(deps: DataFrame) -> DataFrame:
    """An edge each way between files that share a dependency.

    Pairs grow with the square of a dependency's files; adaptive execution splits the
    large ones, and the pairs are combined before they are shuffled.
    """
    a, b = deps.select("dep", F.col("path").alias("src")), deps.select("dep", F.col("path").alias("dst"))
    return _edges(a.join(b, "dep").select("src", "dst"), "shared_dep", DEP_WEIGHT)


def shared_dep_between(deps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of :func:`edges_shared_dep` of ``pairs(src, dst)`` alone; both are distinct."""
    mine = pairs.join(deps.select(F.col("path").alias("src"), "dep"), "src")
    return _edges(mine.join(deps.select(F.col("path").alias("dst"), "dep"), ["dst", "dep"]).select("src", "dst"), "shared_dep", DEP_WEIGHT)


def shared_dep_totals(deps: DataFrame) -> DataFrame:
    """``(src, kind, edges, raw_count, weight)``: what :func:`edges_shared_dep` has at each file, without its rows.

    ``deps`` are distinct. Edges are neighbours by pairs of blocks; their counts add up to the
    other files of a file's dependencies.
    """
    others = deps.groupBy("dep").agg((F.count("*") - 1).alias("others"))
    raw = deps.join(others, "dep").groupBy("path").agg(F.sum("others").alias("raw_count"))
    n = neighbour_counts(deps, "path", "dep").join(raw, "path")
    return n.select(F.col("path").alias("src"), F.lit("shared_dep").alias("kind"), F.col("neighbours").alias("edges"), "raw_count", (F.col("raw_count") * DEP_WEIGHT).alias("weight"))


def shared_dep_at(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of :func:`incident` that shared dependencies give at a few ``nodes(path)``."""
    mine = deps.join(F.broadcast(nodes.select("path").distinct()), "path")
    pairs = mine.join(deps.select("dep", F.col("path").alias("other")), "dep").where("path <> other").groupBy("path", "other").agg(F.count("*").alias("n"))
    kinds = F.explode(F.array(F.lit("shared_dep:out"), F.lit("shared_dep:in"))).alias("kind")
    return pairs.select("path", "other", kinds, (F.col("n") * DEP_WEIGHT).alias("weight"))


def incident(edges: DataFrame) -> DataFrame:
    """Both directions: ``(path, other, kind, weight)``, the kind marked by direction."""
    out = edges.select(F.col("src").alias("path"), F.col("dst").alias("other"), F.concat("kind", F.lit(":out")).alias("kind"), "weight")
    back = edges.select(F.col("dst").alias("path"), F.col("src").alias("other"), F.concat("kind", F.lit(":in")).alias("kind"), "weight")
    return out.unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    """``(path, out_count, in_count)``: edges that leave and reach every file."""
    ends = edges.select(F.col("src").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return ends.groupBy("path").agg(F.sum("o").alias("out_count"), F.sum("i").alias("in_count"))


def edge_fingerprint(edges: DataFrame) -> DataFrame:
    """``(path, fingerprint)``: digest of the edges at a file in a fixed order; a hub's edges are streamed, not gathered."""
    from quern.operators.incremental import sorted_digest

    line = F.concat_ws("|", "src", "dst", "kind", F.col("raw_count").cast("string"))
    rows = edges.select(F.explode(F.array("src", "dst")).alias("path"), line.alias("e"))
    return sorted_digest(rows, "path", "e", "\n").select("path", "fingerprint")


def fan_in_out(edges: DataFrame) -> DataFrame:
    """``(path, fan_in, fan_out)``: distinct neighbours over direct references."""
    e = edges.where(F.col("kind").isin(*DIRECT_KINDS)).select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("fan_out"))
    into = e.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("fan_in"))
    return into.join(out, "path", "full").na.fill(0, ["fan_in", "fan_out"]).select("path", "fan_in", "fan_out")


def orphans(files: DataFrame, fans: DataFrame) -> DataFrame:
    """Files without neighbours whose name is no usual entry point."""
    known = fans.where((F.col("fan_in") > 0) | (F.col("fan_out") > 0)).select("path")
    return files.select("path").where(~T.stem(F.col("path")).isin(*ENTRY_STEMS)).join(known, "path", "left_anti")


def two_hop(edges: DataFrame, seeds: DataFrame, deps: DataFrame | None = None, degree: DataFrame | None = None) -> DataFrame:
    """``(path, graph_score, seed, hops, kinds)``: files near the seeds, at two steps most.

    ``seeds(path, score)`` are few. The first step spreads a seed's strength over its
    edges; the strongest arrivals go on with a decay and never straight back; hubs are
    damped. Three joins replace a query for every node. With ``deps``, files that share one have
    edges too, formed at the seeds and the frontier alone; ``degree`` then counts them all.
    """
    near = incident(edges)
    at = lambda nodes: near if deps is None else near.unionByName(shared_dep_at(deps, nodes))
    merged = lambda df, *keep: df.groupBy("path", "other", *keep).agg(F.sum("weight").alias("weight"), F.max("weight").alias("best"), F.collect_set("kind").alias("kinds"))
    top = seeds.orderBy(F.desc("score"), "path").limit(SEED_LIMIT)
    best = F.greatest(F.max("score").over(Window.partitionBy()), F.lit(0.001))  # over at most SEED_LIMIT rows
    strength = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.greatest(F.col("score"), F.lit(0.0)) / best))
    top = F.broadcast(top.select(F.col("path").alias("seed"), strength.alias("strength")))
    first = at(top.select(F.col("seed").alias("path")))
    # Only the edges at the seeds, then those at the frontier, are merged and moved.
    one = merged(first.join(top, F.col("path") == F.col("seed")), "seed", "strength").where("other <> path")
    one = one.select(F.col("other").alias("node"), "seed", F.lit(1).alias("hops"), (F.col("strength") * F.col("weight")).alias("c"), (F.col("strength") * F.col("best")).alias("p"), "kinds")
    front = one.orderBy(F.desc("p"), "node", "seed").limit(FRONTIER_LIMIT)
    front = F.broadcast((front if deps is None else materialize(front)).select(F.col("node").alias("path"), "seed", "p", F.col("kinds").alias("own")))
    two = merged(at(front).join(front, "path"), "seed", "p", "own").where("other <> path and other <> seed")
    two = two.select(F.col("other").alias("node"), "seed", F.lit(2).alias("hops"), (F.col("p") * F.col("weight") * SECOND_HOP_DECAY).alias("c"), F.lit(0.0).alias("p"), F.array_union("own", "kinds").alias("kinds"))
    rows = one.unionByName(two).where("c > 0")
    by_seed = rows.groupBy("node", "seed").agg(F.sum("c").alias("c"), F.min("hops").alias("hops"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    total = by_seed.groupBy(F.col("node").alias("path")).agg(
        F.sum("c").alias("raw"),
        F.max_by("seed", F.struct("c", "seed")).alias("seed"),
        F.min("hops").alias("hops"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"),
    )
    d = degrees(edges) if degree is None else degree
    damp = F.greatest(F.lit(HUB_MIN), F.least(F.lit(HUB_MAX), 1 / F.sqrt(1 + F.col("out_count") + F.col("in_count"))))
    out = total.join(d, "path").select("path", (F.col("raw") * damp).alias("graph_score"), "seed", "hops", "kinds")
    return out.orderBy(F.desc("graph_score"), "path").limit(POOL_LIMIT)


# --- fixed values: extra cost of a step by the kind of its edge -------------------------
KIND_PENALTY = {"ref_exact": 0.0, "ref_tail_unique": 0.35, "shared_dep": 1.25}
OTHER_PENALTY = 0.75


def step_cost(kind: Column, weight: Column) -> Column:
    penalty = F.lit(OTHER_PENALTY)
    for k, p in KIND_PENALTY.items():
        penalty = F.when(kind == k, p).otherwise(penalty)
    return 1 / F.greatest(weight, F.lit(0.05)) + penalty


def shortest_paths(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """``(start, node, cost, hops)``: cheapest way from every start in at most ``max_hops`` steps.

    Each step is one join with the edges and one minimum, for all starts together. Only
    nodes that the step before improved go on, so settled ones do no more work.
    """
    from quern.sources.sinks import materialize

    steps = edges.select("src", "dst", step_cost(F.col("kind"), F.col("weight")).alias("step"))
    steps = steps.groupBy("src", "dst").agg(F.min("step").alias("step"))
    best = starts.select("start", F.col("start").alias("node"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops"))
    level = best
    for k in range(1, max_hops + 1):
        level = level.join(steps, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.lit(k).alias("hops"))
        level = level.groupBy("start", "node").agg(F.min("cost").alias("cost"), F.min("hops").alias("hops"))
        known = best.select("start", "node", F.col("cost").alias("known"))
        level = materialize(level.join(known, ["start", "node"], "left").where("known is null or cost < known").drop("known"))
        better = level.select("start", "node")
        best = materialize(best.join(better, ["start", "node"], "left_anti").unionByName(level))
    return best


def _spread(labels: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """``labels(node, label)`` after every node has taken the least label that reaches it."""
    from quern.sources.sinks import materialize

    now = materialize(labels)
    fresh = now
    for _ in range(max_rounds):
        sent = fresh.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("new"))
        step = materialize(now.join(sent, "node", "left").select("node", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        now, fresh = step.select("node", "label"), step.where("moved").select("node", "label")
        if fresh.isEmpty():
            break
    return now


def cycle_members(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(path, cycle_id)``: files that reach themselves, by strongly connected component.

    Each round trims files outside any cycle, colours every file with the least one that
    reaches it, and goes back from there within its colour: what is met reaches the root
    of the colour and is reached by it, so it is the component of the root. Components
    leave, and the rest goes on. Only edges and labels are held, never the closure.
    """
    from quern.sources.sinks import materialize

    loops = edges.where("src = dst").select(F.col("src").alias("path"), F.col("src").alias("cycle_id")).distinct()
    e = materialize(edges.where("src <> dst").select("src", "dst").distinct())
    found = None
    for _ in range(max_rounds):
        count = e.count()
        while count:
            heads, tails = e.select(F.col("src").alias("dst")).distinct(), e.select(F.col("dst").alias("src")).distinct()
            e = materialize(e.join(heads, "dst", "left_semi").join(tails, "src", "left_semi").select("src", "dst"))
            count, before = e.count(), count
            if count == before:
                break
        if not count:
            break
        nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = materialize(_spread(nodes.select("node", F.col("node").alias("label")), e, max_rounds))
        own = e.join(colour.select(F.col("node").alias("src"), F.col("label").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("c2")), "dst")
        own = own.where("c1 = c2")
        back = materialize(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # 0 at the root of a colour, 1 elsewhere: what gets 0 on the way back is the component.
        start = colour.select("node", "label", F.when(F.col("node") == F.col("label"), 0).otherwise(1).alias("mark"))
        met = _spread(start.select("node", F.col("mark").alias("label")), back, max_rounds).where("label = 0").select("node")
        part = materialize(colour.join(met, "node").select(F.col("node").alias("path"), F.col("label").alias("cycle_id")))
        found = part if found is None else found.unionByName(part)
        gone = part.select("path")
        e = materialize(e.join(gone.withColumnRenamed("path", "src"), "src", "left_anti").join(gone.withColumnRenamed("path", "dst"), "dst", "left_anti").select("src", "dst"))
    if found is None:
        return loops
    found = found.join(found.groupBy("cycle_id").agg(F.count("*").alias("k")).where("k > 1").select("cycle_id"), "cycle_id").select("path", "cycle_id")
    return found.unionByName(loops.join(found.select("path"), "path", "left_anti"))


def layering(edges: DataFrame, zones: DataFrame, allowed: DataFrame, forbidden: DataFrame) -> DataFrame:
    """``(src, dst, src_zone, dst_zone, verdict)`` of every edge.

    ``zones(path, zone)``; ``allowed`` and ``forbidden`` list (src_zone, dst_zone). An edge
    is same, forbidden, allowed, out_of_direction, or unmatched when an end has no zone.
    """
    z1 = zones.select(F.col("path").alias("src"), F.col("zone").alias("src_zone"))
    z2 = zones.select(F.col("path").alias("dst"), F.col("zone").alias("dst_zone"))
    e = edges.select("src", "dst").join(z1, "src", "left").join(z2, "dst", "left")
    e = e.join(F.broadcast(allowed.select("src_zone", "dst_zone", F.lit(True).alias("ok"))), ["src_zone", "dst_zone"], "left")
    e = e.join(F.broadcast(forbidden.select("src_zone", "dst_zone", F.lit(True).alias("bad"))), ["src_zone", "dst_zone"], "left")
    verdict = (
        F.when(F.col("src_zone").isNull() | F.col("dst_zone").isNull(), "unmatched")
        .when(F.col("src_zone") == F.col("dst_zone"), "same")
        .when(F.col("bad"), "forbidden")
        .when(F.col("ok"), "allowed")
        .otherwise("out_of_direction")
    )
    return e.select("src", "dst", "src_zone", "dst_zone", verdict.alias("verdict"))


def multi_zone(zones: DataFrame) -> DataFrame:
    """Files that fall into several zones, which a policy must not allow."""
    return zones.groupBy("path").agg(F.countDistinct("zone").alias("n_zones")).where("n_zones > 1")


def symbol_lookup(symbols: DataFrame, name: str, limit: int) -> DataFrame:
    """Names equal to or holding ``name``, exact ones first, then short ones."""
    rows = symbols.where(F.contains(F.lower("name"), F.lit(name.lower()))).distinct()
    exact = (F.col("name") == name).cast("int")
    return rows.withColumn("exact", exact).orderBy(F.desc("exact"), F.length("name"), "name", "path").limit(limit)


def symbol_references(refs: DataFrame, name: str, limit: int) -> DataFrame:
    """``(path, refs, rank, pos)``: files that refer to ``name``; 3 exact, 2 by tail, 1 within."""
    s = F.col("symbol")
    rank = F.when(s == name, 3).when(F.endswith(s, F.lit("::" + name)), 2).otherwise(1)
    rows = refs.where(F.contains(s, F.lit(name))).withColumn("rank", rank)
    found = rows.groupBy("path").agg(F.count("*").alias("refs"), F.max("rank").alias("rank"), F.min_by("pos", F.struct(-F.col("rank"), "pos")).alias("pos"))
    return found.orderBy(F.desc("rank"), F.desc("refs"), "pos", "path").limit(limit)


def edge_evidence(edges: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``(src, dst, symbol, pos)``: the first reference that makes each exact edge."""
    names = symbols.select(F.col("name").alias("symbol"), F.col("path").alias("dst")).distinct()
    rows = refs.select(F.col("path").alias("src"), "symbol", "pos").join(names, "symbol")
    rows = rows.join(edges.where("kind = 'ref_exact'").select("src", "dst"), ["src", "dst"])
    return rows.groupBy("src", "dst").agg(F.min(F.struct("pos", "symbol")).alias("e")).select("src", "dst", "e.symbol", "e.pos")


def related_files(anchor: str, refs: DataFrame, symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """``(path, score, dep_overlap, ref_out, ref_in, symbol_overlap)`` of files near ``anchor``."""
    own = lambda df: df.where(F.col("path") == anchor)
    others = lambda df: df.where(F.col("path") != anchor)
    dep = others(deps).join(own(deps).select("dep").distinct(), "dep").groupBy("path").agg(F.countDistinct("dep").alias("n"))
    out = others(symbols).join(own(refs).select(F.col("symbol").alias("name")).distinct(), "name").groupBy("path").agg(F.countDistinct("name").alias("n"))
    into = others(refs).join(own(symbols).select(F.col("name").alias("symbol")).distinct(), "symbol").groupBy("path").agg(F.countDistinct("symbol").alias("n"))
    sym = others(symbols).join(own(symbols).select("name").distinct(), "name").groupBy("path").agg(F.countDistinct("name").alias("n"))
    parts = [df.select("path", F.lit(k).alias("k"), "n") for k, df in (("dep_overlap", dep), ("ref_out", out), ("ref_in", into), ("symbol_overlap", sym))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(k)
    wide = rows.groupBy("path").agg(*[pick(k) for k in ("dep_overlap", "ref_out", "ref_in", "symbol_overlap")])
    score = F.col("dep_overlap") * RELATED_DEP + (F.col("ref_out") + F.col("ref_in")) * RELATED_REF + F.col("symbol_overlap") * RELATED_SYMBOL
    return wide.withColumn("score", score)


def resolve_endpoint(files: DataFrame, symbols: DataFrame, name: str) -> str:
    """A path as it is, else the only file that defines the name; anything else is an error."""
    if files.where(F.col("path") == name).limit(1).count():
        return name
    found = [r[0] for r in symbols.where(F.col("name") == name).select("path").distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{name!r} is {'ambiguous' if found else 'unknown'}")
    return found[0]
