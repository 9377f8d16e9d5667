"""Cheapest ways of pairs of nodes in tasks that hold the graph: for graphs whose counted size allows that.

A task goes from a start and back from its targets in arrays, so no table of what a start
reaches is ever written. Files that share a dependency are neighbours too: a task makes
them from the table of dependencies, and none is stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.sinks import materialize

#: Edges, and pairs of rows of one dependency, that a task holds at most: some 450 MB.
EDGES_HELD, PAIRS_HELD = 6_000_000, 24_000_000
#: Steps that are taken back from a target at most; the others go on from the start.
BACK = 2
_FAR = np.int64(1) << 60
#: Edges, or pairs of rows of one dependency, that are looked at at once, and parts in which the edges come to the driver.
_CHUNK, SLICES = 500_000, 8


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of ranges one after another."""
    if not len(count):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) - np.repeat(ends - count - first, count)


def _rows_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the rows of each of ``n`` keys begin, of keys in order."""
    return np.searchsorted(keys, np.arange(n + 1))


class Graph:
    """Edges from and to each node, and neighbours by shared dependencies; those of a node in order of their step."""

    def __init__(self, n: int, src, dst, step, load, files, deps, shared_step, shared_load):
        self.n, self.width = n, int(step.max(initial=0)) + 1
        if len(files):
            most = int(np.bincount(files).max())  # no two files share more
            steps, self.loads = (np.array([f(i) for i in range(most + 1)], np.int64) for f in (shared_step, shared_load))
            self.width = max(self.width, int(steps.max()) + 1)
        self.out, self.into = [self._side(src, dst, step, load)], [self._side(dst, src, step, load)]
        if len(files):
            both = self._shared(files, deps, steps)  # the same both ways round
            self.out.append(both)
            self.into.append(both)

    def _side(self, node, other, step, load) -> tuple:
        key = node.astype(np.int64) * self.width + step
        order = np.argsort(key)
        key = key[order]
        return np.searchsorted(key, np.arange(self.n + 1) * self.width), key, other[order].astype(np.int32), load[order]

    def _shared(self, files, deps, steps) -> tuple:
        """The side of the other files of each file's dependencies, with the number they share for load."""
        order = np.argsort(files, kind="stable")
        of_file, file_rows = deps[order], _rows_of(files[order], self.n)
        order = np.argsort(deps, kind="stable")
        of_dep, dep_rows = files[order].astype(np.int64), _rows_of(deps[order], int(deps.max()) + 1)
        many = np.diff(dep_rows)
        work = np.r_[0, np.cumsum(many[of_file])][file_rows]  # pairs up to each file
        # Room for all pairs, of which only what is filled takes memory.
        key, other, k = np.empty(work[-1], np.int64), np.empty(work[-1], np.int32), np.empty(work[-1], np.min_scalar_type(len(steps)))
        at = size = 0
        while at < self.n:
            end = max(at + 1, int(np.searchsorted(work, work[at] + _CHUNK, "right")) - 1)
            mine = of_file[file_rows[at] : file_rows[end]]
            one = np.repeat(np.repeat(np.arange(at, end), np.diff(file_rows[at : end + 1])), many[mine])
            pair, number = np.unique(one * self.n + of_dep[_ranges(dep_rows[mine], many[mine])], return_counts=True)
            apart = pair // self.n != pair % self.n
            pair, number = pair[apart], number[apart]
            keys = pair // self.n * self.width + steps[number]
            order, end_size = np.argsort(keys), size + len(keys)
            key[size:end_size], other[size:end_size], k[size:end_size] = keys[order], (pair % self.n)[order], number[order]
            at, size = end, end_size
        key, other, k = key[:size], other[:size], k[:size]
        return np.searchsorted(key, np.arange(self.n + 1) * self.width), key, other, k

    def _last(self, side: tuple, nodes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Where the edges of each node end whose step is less than its ``room``."""
        return np.searchsorted(side[1], nodes * self.width + np.clip(room, 0, self.width))

    def edges(self, sides: list, nodes: np.ndarray, cost: np.ndarray, room: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place in ``nodes``, other end, cost with the step, load) of the edges whose step is less than ``room`` and whose cost is less than the ``limit`` of their end."""
        found = []
        for side in sides:
            rows, key, ends, load = side
            first = rows[nodes]
            count = self._last(side, nodes, room) - first
            total = np.cumsum(count)
            cuts = [0, *(np.searchsorted(total, np.arange(_CHUNK, total[-1], _CHUNK)) if len(total) else ()), len(nodes)]
            for a, b in zip(cuts, cuts[1:]):  # so many edges at once
                u = np.repeat(np.arange(a, b), count[a:b])
                at = np.arange(len(u)) + (first - total + count)[u] + (total[a - 1] if a else 0)
                node, c = ends[at], key[at] + (cost - nodes * self.width)[u]
                ok = np.flatnonzero(c < limit[node])
                w = load[at[ok]]
                found.append((u[ok], node[ok].astype(np.int64), c[ok], self.loads[w] if side is not sides[0] else w.astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def many(self, sides: list, nodes: np.ndarray, room: np.ndarray) -> int:
        return int(sum((self._last(side, nodes, room) - side[0][nodes]).sum() for side in sides))


class _Level:
    """What so many steps reach, each node once: cost, gain, order among the lists of nodes, and the node before."""

    def __init__(self, nodes, cost, gain, rank, via):
        self.nodes, self.cost, self.gain, self.rank, self.via = nodes, cost, gain, rank, via

    def at(self, node: int) -> int:
        return int(np.searchsorted(self.nodes, node))


def _best(node, cost, gain, rank, via, scratch) -> tuple[np.ndarray, ...]:
    """The least (cost, gain, rank) of each node; ``scratch`` is far everywhere before and after."""
    np.minimum.at(scratch, node, cost)
    keep = np.flatnonzero(cost == scratch[node])
    scratch[node] = _FAR
    keep = keep[np.lexsort((rank[keep], gain[keep], node[keep]))]
    keep = keep[np.r_[True, node[keep][1:] != node[keep][:-1]]] if len(keep) else keep
    return node[keep], cost[keep], gain[keep], via[keep]


def ways_of(g: Graph, start: int, targets: np.ndarray, max_hops: int) -> list[tuple | None]:
    """``(cost, hops, gain, nodes)`` for each target: least cost, then fewest hops, most weight, least list of nodes.

    Ways of h hops are made of levels from the start and levels back from the targets that meet at
    one node. A level keeps one way a node, and drops nodes that fewer hops reach as cheaply, and
    those from which no target can be reached cheaper than it was with fewer hops.
    """
    back = min(BACK, max_hops // 2)
    scratch, seen = np.full(g.n, _FAR), np.full(g.n, _FAR)
    zero = np.zeros(1, np.int64)
    level = lambda node: _Level(np.array([node], np.int64), zero, zero, zero, zero - 1)
    ahead, behind = [level(start)], [[level(t)] for t in targets]
    no_limit = np.full(g.n, _FAR)
    seen[start] = 0
    found: list[tuple | None] = [None] * len(targets)
    cost_of = lambda k: found[k][0] if found[k] else _FAR

    def onward(last: bool) -> None:
        """One more level from the start."""
        now, backs = ahead[-1], [b[-1] for b in behind]
        # From a node on, at least what the cheapest node of a target's furthest level costs is still to come.
        rest = max((cost_of(k) - b.cost.min() for k, b in enumerate(backs) if len(b.nodes)), default=np.int64(-1))
        use = np.flatnonzero(now.cost < rest)
        nodes, limit, pull = now.nodes[use], np.minimum(seen, rest), False
        if last:  # only nodes from which a target's furthest level goes on
            slack = np.full(g.n, np.int64(-1))
            for k, b in enumerate(backs):
                slack[b.nodes] = np.maximum(slack[b.nodes], cost_of(k) - b.cost)
            limit = np.minimum(limit, slack)
            least = now.cost.min(initial=_FAR)
            wanted = np.flatnonzero(limit > least)
            pull = g.many(g.into, wanted, limit[wanted] - least) < g.many(g.out, nodes, rest - now.cost[use])
        if pull:
            place = np.full(g.n, -1)
            place[nodes] = use
            at, other, cost, load = g.edges(g.into, wanted, np.zeros(len(wanted), np.int64), limit[wanted] - least, np.where(place < 0, -1, _FAR))
            u, node = place[other], wanted[at]
            cost = cost + now.cost[u]
            ok = np.flatnonzero(cost < limit[node])
            u, node, cost, load = u[ok], node[ok], cost[ok], load[ok]
        else:
            at, node, cost, load = g.edges(g.out, nodes, now.cost[use], rest - now.cost[use], limit)
            u = use[at]
        node, cost, gain, u = _best(node, cost, now.gain[u] - load, now.rank[u], u, scratch)
        rank = np.empty(len(node), np.int64)
        rank[np.lexsort((node, now.rank[u]))] = np.arange(len(node))
        seen[node] = cost
        ahead.append(_Level(node, cost, gain, rank, now.nodes[u]))

    def backward(k: int, i: int) -> None:
        """One more level back from a target, to meet what ``i`` steps or more reach; lists of nodes begin with the node, so its number is their order."""
        now = behind[k][-1]
        most = cost_of(k) - ahead[i].cost.min(initial=_FAR)
        at, node, cost, load = g.edges(g.into, now.nodes, now.cost, most - now.cost, no_limit)
        node, cost, gain, at = _best(node, cost, now.gain[at] - load, now.nodes[at], at, scratch)
        for old in behind[k]:
            if not len(old.nodes) or not len(node):
                continue
            place = np.minimum(np.searchsorted(old.nodes, node), len(old.nodes) - 1)
            keep = (old.nodes[place] != node) | (cost < old.cost[place])
            node, cost, gain, at = node[keep], cost[keep], gain[keep], at[keep]
        behind[k].append(_Level(node, cost, gain, node, now.nodes[at]))

    def list_of(k: int, i: int, j: int, node: int) -> list[int]:
        out = [node]
        for one in reversed(ahead[1 : i + 1]):
            out.insert(0, int(one.via[one.at(out[0])]))
        for one in reversed(behind[k][1 : j + 1]):
            out.append(int(one.via[one.at(out[-1])]))
        return out

    for hops in range(1, max_hops + 1):
        j = min(back, hops // 2)
        i = hops - j
        if len(ahead) <= i:
            onward(i == max_hops - back and back > 0)
        one = ahead[i]
        for k in range(len(targets)):
            if len(behind[k]) <= j:
                backward(k, i)
            two = behind[k][j]
            small, large = (one, two) if len(one.nodes) < len(two.nodes) else (two, one)
            if not len(small.nodes):
                continue
            place = np.minimum(np.searchsorted(large.nodes, small.nodes), len(large.nodes) - 1)
            met = np.flatnonzero(large.nodes[place] == small.nodes)
            a, b = (met, place[met]) if small is one else (place[met], met)
            cost = one.cost[a] + two.cost[b]
            ok = np.flatnonzero(cost < cost_of(k))
            if len(ok):
                a, b, cost = a[ok], b[ok], cost[ok]
                gain = one.gain[a] + two.gain[b]
                best = np.lexsort((one.rank[a], gain, cost))[0]
                found[k] = (int(cost[best]), hops, int(gain[best]), list_of(k, i, j, int(one.nodes[a[best]])))
    return found


_GRAPHS: dict[str, Graph] = {}


def fits(steps: DataFrame, deps: DataFrame | None) -> bool:
    """Whether a task can hold the graph, by its counted rows."""
    if steps.count() > EDGES_HELD:
        return False
    pairs = 0 if deps is None else deps.groupBy("dep").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).head()[0]
    return (pairs or 0) <= PAIRS_HELD


def ways(steps: DataFrame, pairs: DataFrame, max_hops: int, deps: DataFrame | None = None, shared=None) -> DataFrame:
    """``(start, target, w struct<cost, hops, gain, nodes>)`` of ``pairs``, over ``steps(src, dst, step, load)`` that :func:`fits` lets pass.

    With ``deps(path, dep)``, distinct, files that share some have an edge each way; ``shared`` are two functions
    that give its step and its load by their number.
    """
    spark = steps.sparkSession
    kind = pairs.schema["start"].dataType
    ends = [steps.select("src"), steps.select("dst"), pairs.select("start"), pairs.select("target")] + ([deps.select("path")] if deps is not None else [])
    nodes = ends[0].toDF("node")
    for e in ends[1:]:
        nodes = nodes.unionByName(e.toDF("node"))
    values = nodes.distinct().orderBy("node").toArrow().column(0).combine_chunks()  # in the order of nodes
    ids = spark.createDataFrame(pa.table({"node": values, "id": pa.array(np.arange(len(values)), pa.int32())}))
    number = lambda df, c: df.join(F.broadcast(ids.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))), c).drop(c)
    held = materialize(number(number(steps, "src"), "dst").select("src_id", "dst_id", "step", "load"))
    numpy = lambda t, c: t.column(c).to_numpy()
    counts = held.agg(F.count("*"), F.max("step"), F.max("load")).head()
    width = lambda most: np.int32 if (most or 0) < 1 << 31 else np.int64
    edges = [np.empty(counts[0], t) for t in (np.int32, np.int32, width(counts[1]), width(counts[2]))]
    done = 0
    for k in range(SLICES):  # a part at a time, so that the driver holds the edges once
        part = held.where(F.pmod("src_id", F.lit(SLICES)) == k).toArrow()
        for column, name in zip(edges, part.column_names):
            column[done : done + part.num_rows] = numpy(part, name)
        done += part.num_rows
        del part
    files = names = np.zeros(0, np.int32)
    if deps is not None:
        t = number(deps, "path").select("path_id", F.xxhash64("dep").alias("dep")).toArrow()
        files, names = numpy(t, "path_id"), np.unique(numpy(t, "dep"), return_inverse=True)[1].astype(np.int32)
    sent, key = spark.sparkContext.broadcast(((len(values), *edges, files, names), values)), uuid.uuid4().hex
    del edges
    schema = f"start {kind.simpleString()}, target {kind.simpleString()}, w struct<cost:bigint,hops:int,gain:bigint,nodes:array<{kind.simpleString()}>>"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(values.type)]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, names = sent.value
            if key not in _GRAPHS:  # once a worker
                _GRAPHS.clear()
                _GRAPHS[key] = Graph(*arrays, *(shared or (None, None)))
            for start, targets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(t, w) for t, w in zip(targets, ways_of(_GRAPHS[key], start, np.array(targets, np.int64), max_hops)) if w]
                lists = [w[3] for _, w in found]
                flat = names.take(pa.array([x for one in lists for x in one], pa.int64()))
                offsets = pa.array(np.cumsum([0] + [len(x) for x in lists]), pa.int32())
                parts = [pa.array([w[i] for _, w in found], t) for i, t in enumerate(types[:3])] + [pa.ListArray.from_arrays(offsets, flat)]
                w = pa.StructArray.from_arrays(parts, names=["cost", "hops", "gain", "nodes"])
                yield pa.RecordBatch.from_arrays([names.take(pa.array([start] * len(found), pa.int64())), names.take(pa.array([t for t, _ in found], pa.int64())), w], names=["start", "target", "w"])

    asked = number(number(pairs, "start"), "target").groupBy("start_id").agg(F.collect_list("target_id").alias("targets"))  # the targets of one start
    tasks = spark.sparkContext.defaultParallelism
    return asked.repartition(tasks, F.rand(7)).mapInArrow(go, schema)
