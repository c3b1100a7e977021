"""Bounded traversal: each hop is one join of the frontier with the edges.

Every loop cuts its lineage by a checkpoint a hop, stops on an empty frontier, and breaks ties by
(direction, relation, neighbour, edge id), so results don't depend on the order of rows. Frontiers
and visited ids are counted and broadcast while they are small: a hop then filters the tables that
edges come from by the frontier, and neither shuffles nor stores the edges.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..schema import ACTIONABLE, IMPACT_RELATIONS, InvalidRequest, LimitExceeded, NotFound, direction, relations

MAX_IMPACT_DEPTH, MAX_IMPACT = 10, 1000
#: Ids up to this number are broadcast (some 10 MB).
SMALL = 100_000
#: Edges up to this number are searched by one task (some 500 MB); more of them hop by hop.
ONE_TASK = 2_000_000
#: Bytes of an edge as Catalyst estimates tables; edges that seem to be over ``ONE_TASK`` aren't counted.
EDGE = 128
#: Levels after which what has been visited is written as one table.
MERGE = 12


def steps(edges: DataFrame, way: str) -> DataFrame:
    """(at, next, dir, id, type, confidence): the edges as steps in the direction wanted."""
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("next"), F.lit(0).alias("dir"), "id", "type", "confidence")
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("next"), F.lit(1).alias("dir"), "id", "type", "confidence")
    return {"out": out, "in": back, "both": out.unionByName(back)}[way]


def _allowed(edges: DataFrame, names: frozenset[str]) -> DataFrame:
    return edges.where(F.col("type").isin(sorted(names))) if names else edges


class _Moves:
    """Steps (at, next, ...) whose ``next`` is in ``gate`` (ids), if that is given.

    From a small frontier they are read anew in each hop: a broadcast semi-join goes down to the
    scans, below aggregates, and only what it leaves meets the gate. Steps from a large one that are
    dear to compute are kept for all hops (what is lost is computed again).
    """

    def __init__(self, moves: DataFrame, gate: DataFrame | None = None):
        self.moves, self.gate, self.kept = moves, gate, None

    def join(self, ids: DataFrame, n: int, column: str = "at") -> DataFrame:
        """The steps whose ``column`` is among the ``n`` rows of ``ids``, which have that column."""
        if n > SMALL:
            if self.kept is None:
                self.kept = _kept(self.moves if self.gate is None else self.moves.join(self.gate.select(F.col("id").alias("next")), "next", "left_semi"))
            return self.kept.join(ids, column, "left_semi")
        out = self.moves.join(F.broadcast(ids), column, "left_semi")
        if self.gate is None:
            return out
        out = cut(out)
        m = out.count()
        own = self.gate.select(F.col("id").alias("next")).join(_small(out.select("next").distinct(), m), "next", "left_semi")
        return out.join(_small(own, m), "next", "left_semi")

    def done(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()


def _kept(moves: DataFrame) -> DataFrame:
    plan = moves._jdf.queryExecution().optimizedPlan().toString()
    return moves.persist(StorageLevel.MEMORY_AND_DISK) if any(x in plan for x in ("Aggregate", "Join", "Window", "Generate")) else moves


def _small(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= SMALL else ids


class _Seen:
    """Visited ids, a few tables at most."""

    def __init__(self, start: DataFrame, n: int):
        self.parts, self.n = [start], n

    def add(self, ids: DataFrame, n: int) -> None:
        self.parts.append(ids)
        self.n += n
        if len(self.parts) > MERGE:
            self.parts = [cut(_union(self.parts))]

    def ids(self) -> DataFrame:
        return _small(_union(self.parts), self.n)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bfs(edges: DataFrame, start: DataFrame, max_depth: int, way: str = "out", types=None, gate: DataFrame | None = None, limit: int | None = 100_000) -> DataFrame:
    """(id, depth, edge_id, edge_type, parent, confidence): every node but the start, at its least depth.

    ``start`` has one column ``id``. With ``gate`` (ids), other nodes are neither found nor passed
    through. The edge is the first by (direction, relation, parent, edge id) among those that
    discover the node. More than ``limit`` nodes raise LimitExceeded. Ends of edges that are no
    nodes are found like any other; join the nodes to drop them.
    """
    if max_depth < 1:
        raise InvalidRequest("max depth must be at least 1")
    moves = steps(_allowed(edges, relations(types)), direction(way)).where("at <> next")
    moves = _Moves(moves, gate)
    frontier = start.select("id").distinct()
    n = frontier.count()
    seen, levels = _Seen(frontier, n), []
    for depth in range(1, max_depth + 1):
        found = cut(
            moves.join(frontier.select(F.col("id").alias("at")), n)
            .join(seen.ids().withColumnRenamed("id", "next"), "next", "left_anti")
            .groupBy("next")
            .agg(F.min(F.struct("dir", "type", "at", "id", "confidence")).alias("e"))
            .select(F.col("next").alias("id"), F.lit(depth).alias("depth"), F.col("e.id").alias("edge_id"), F.col("e.type").alias("edge_type"), F.col("e.at").alias("parent"), F.col("e.confidence").alias("confidence"))
        )
        n = found.count()
        if not n:
            break
        levels.append(found)
        frontier = found.select("id")
        seen.add(frontier, n)
        if limit is not None and seen.n > limit:
            raise LimitExceeded(f"more than {limit} nodes within {depth} hops")
    moves.done()
    if not levels:
        return edges.sparkSession.createDataFrame([], "id string, depth int, edge_id string, edge_type string, parent string, confidence double")
    return _union(levels)


PATH = "step int, edge_id string, edge_type string, source string, target string"


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None, one_task: int = ONE_TASK) -> DataFrame:
    """(step, edge_id, edge_type, source, target) along a path of fewest edges, outgoing only.

    Among shortest paths each node's edge is the first by (relation, parent, id). No path, or a
    path from a node to itself, raises NotFound. Edges that are counted to be at most ``one_task``
    are searched by one task, whatever the length of the path. More of them are searched hop by hop
    from both ends at once, always from the one with the smaller frontier.
    """
    if source == target:
        raise NotFound("no path from a node to itself")
    spark = edges.sparkSession
    moves = _Moves(steps(edges, "out").where("at <> next"))
    try:
        if _few(moves.moves, one_task):
            out = moves.moves.select("at", "next", "type", "id").coalesce(1).mapInPandas(_path_in_one_task(source, target, max_hops), PATH)
            out = spark.createDataFrame(out.collect(), PATH)  # as long as the path
            if out.isEmpty():
                raise NotFound(f"no path from {source} to {target}")
            return out
        return spark.createDataFrame(_path_from_both_ends(moves, source, target, max_hops), PATH)
    finally:
        moves.done()


def _few(moves: DataFrame, most: int) -> bool:
    """Whether there are at most so many, counted where they may be: tables far too large for it aren't computed for a count."""
    size = float(str(moves._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unknown = size >= 1 << 60  # Spark's default for what it can't tell
    return (unknown or size <= EDGE * most) and moves.count() <= most


def _path_in_one_task(source: str, target: str, max_hops: int | None):
    def run(batches):
        edges = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["at", "next", "type", "id"])], ignore_index=True)
        edges = edges.sort_values(["type", "at", "id"], ignore_index=True)  # an edge's place is its rank among ties
        code, names = pd.factorize(pd.concat([edges["at"], edges["next"]]))
        ends = {n: k for k, n in enumerate(names) if n in (source, target)} if len(names) else {}
        if len(ends) < 2:
            return
        a, b = code[: len(edges)], code[len(edges) :]
        order = np.argsort(a, kind="stable")
        begin = np.searchsorted(a[order], np.arange(len(names) + 1))
        via = np.full(len(names), -1)
        via[ends[source]] = len(edges)
        frontier, hops, goal = np.array([ends[source]]), 0, ends[target]
        while len(frontier) and via[goal] < 0 and (max_hops is None or hops < max_hops):
            n = begin[frontier + 1] - begin[frontier]
            e = order[np.repeat(begin[frontier] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            e = np.sort(e[via[b[e]] < 0])
            frontier, first = np.unique(b[e], return_index=True)
            via[frontier] = e[first]
            hops += 1
        if via[goal] < 0:
            return
        path, at = [], goal
        while at != ends[source]:
            path.append(via[at])
            at = a[via[at]]
        p = edges.iloc[path[::-1]]
        yield pd.DataFrame({"step": np.arange(1, len(p) + 1, dtype=np.int32), "edge_id": p["id"].to_numpy(), "edge_type": p["type"].to_numpy(), "source": p["at"].to_numpy(), "target": p["next"].to_numpy()})

    return run


def _path_from_both_ends(moves: _Moves, source: str, target: str, max_hops: int | None) -> list[tuple]:
    """Levels of ids from either end until they meet; then the edges, forwards over the nodes on some shortest path."""
    spark = moves.moves.sparkSession
    ways = []
    for end, at, nxt in ((source, "at", "next"), (target, "next", "at")):
        start = spark.createDataFrame([(end,)], "id string")
        ways.append({"levels": [start], "sizes": [1], "seen": _Seen(start, 1), "at": at, "next": nxt})
    while True:
        hops = len(ways[0]["levels"]) + len(ways[1]["levels"]) - 2
        if max_hops is not None and hops >= max_hops:
            raise NotFound(f"no path from {source} to {target} within {max_hops} hops")
        way, other = sorted(ways, key=lambda w: w["sizes"][-1])
        steps_on = moves.join(way["levels"][-1].withColumnRenamed("id", way["at"]), way["sizes"][-1], way["at"])
        found = cut(steps_on.select(F.col(way["next"]).alias("id")).distinct().join(way["seen"].ids(), "id", "left_anti"))
        n = found.count()
        if not n:
            raise NotFound(f"no path from {source} to {target}")
        way["levels"].append(found)
        way["sizes"].append(n)
        way["seen"].add(found, n)
        if not found.join(_small(other["levels"][-1], other["sizes"][-1]), "id", "left_semi").isEmpty():
            break
    front, back = (w["levels"] for w in ways)
    # layer k of the shortest paths: reached in k steps from the source and in the rest from the target
    layers = [*front[:-1], cut(front[-1].join(back[-1], "id", "left_semi")), *back[-2::-1]]
    for k in range(len(front) - 2, 0, -1):
        ahead = moves.join(layers[k + 1].withColumnRenamed("id", "next"), ways[0]["sizes"][k + 1], "next")
        layers[k] = cut(ahead.select(F.col("at").alias("id")).distinct().join(front[k], "id", "left_semi"))
    # forwards, each node of a layer by its first edge from the layer before; then back from the target
    best, sizes = [], [*ways[0]["sizes"], *ways[1]["sizes"][-2::-1]]
    reached = layers[0]
    for k in range(1, len(layers)):
        step = moves.join(reached.withColumnRenamed("id", "at"), sizes[k - 1]).join(_small(layers[k].withColumnRenamed("id", "next"), sizes[k]), "next", "left_semi")
        best.append(cut(step.groupBy("next").agg(F.min(F.struct("type", "at", "id")).alias("e")).select(F.col("next").alias("id"), "e")))
        reached = best[-1].select("id")
    path, at = [], target
    for k in range(len(best), 0, -1):
        e = best[k - 1].where(F.col("id") == at).first()["e"]
        path.append((k, e["id"], e["type"], e["at"], at))
        at = e["at"]
    return path[::-1]


def label_gate(nodes: DataFrame, origin_is_file: bool = False) -> DataFrame:
    """Ids of nodes that impact may report: actionable symbols, and files where the origin is one."""
    ok: Column = F.col("label").isin(sorted(ACTIONABLE))
    return nodes.where(ok | (F.col("label") == "File") if origin_is_file else ok).select("id")


def impact(nodes: DataFrame, edges: DataFrame, origin: str, max_depth: int = 3, limit: int = 100, types=None) -> DataFrame:
    """(ord, id, depth, edge_type, via, confidence): dependants of a node, nearest first.

    Reverse search over impact relations. Within a hop dependants follow the order of the node they
    were reached from, then falling confidence, relation, id. No level need keep more than ``limit``
    nodes, as later ones could not be reported: so a frontier is at most that long and is broadcast.
    """
    if not 1 <= max_depth <= MAX_IMPACT_DEPTH or not 1 <= limit <= MAX_IMPACT:
        raise InvalidRequest("depth must be 1 to 10, limit 1 to 1000")
    start = nodes.where(F.col("id") == origin).select("id", "label").first()
    if start is None:
        raise NotFound(origin)
    spark = nodes.sparkSession
    moves = _Moves(steps(_allowed(edges, relations(types, IMPACT_RELATIONS)), "in"), label_gate(nodes, start["label"] == "File"))
    found, frontier = [], [(0, origin)]
    seen = [(origin,)]
    for depth in range(1, max_depth + 1):
        room = limit - len(found)
        if not frontier or room <= 0:
            break
        ahead = F.broadcast(spark.createDataFrame(frontier, "parent_ord long, at string"))
        level = (
            moves.join(ahead.select("at"), len(frontier)).join(ahead, "at").join(F.broadcast(spark.createDataFrame(seen, "next string")), "next", "left_anti")
            .groupBy("next").agg(F.min(F.struct("parent_ord", (-F.col("confidence")).alias("minus"), "type", "at")).alias("e"))
            .orderBy("e.parent_ord", "e.minus", "e.type", "next").limit(room).collect()
        )
        frontier = []
        for r in level:
            found.append((len(found) + 1, r["next"], depth, r["e"]["type"], r["e"]["at"], -r["e"]["minus"]))
            frontier.append((len(found), r["next"]))
        seen += [(r["next"],) for r in level]
    moves.done()
    return spark.createDataFrame(found, "ord long, id string, depth int, edge_type string, via string, confidence double")


def impact_many(nodes: DataFrame, edges: DataFrame, origins: DataFrame, max_depth: int = 3, types=None) -> DataFrame:
    """(cause, id, depth, confidence, via): impact of many origins at once, without a limit.

    ``origins`` has a column ``id``. One join a hop carries all causes; ``confidence`` and ``via``
    are of the first edge by (confidence falling, relation, parent).
    """
    moves = _Moves(steps(_allowed(edges, relations(types, IMPACT_RELATIONS)), "in"), label_gate(nodes))
    frontier = origins.select(F.col("id").alias("cause"), "id").distinct()
    n = frontier.count()
    seen, levels = frontier, []
    for depth in range(1, max_depth + 1):
        found = cut(
            moves.join(frontier.select(F.col("id").alias("at")).distinct(), n).join(frontier.withColumnRenamed("id", "at"), "at").join(seen.withColumnRenamed("id", "next"), ["cause", "next"], "left_anti")
            .groupBy("cause", "next").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "type", "at")).alias("e"))
            .select("cause", F.col("next").alias("id"), F.lit(depth).alias("depth"), (-F.col("e.minus")).alias("confidence"), F.col("e.at").alias("via"))
        )
        n = found.count()
        if not n:
            break
        levels.append(found)
        frontier = found.select("cause", "id")
        seen = seen.unionByName(frontier)
    moves.done()
    if not levels:
        return nodes.sparkSession.createDataFrame([], "cause string, id string, depth int, confidence double, via string")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def aggregate_impact(found: DataFrame, origins: DataFrame) -> DataFrame:
    """(id, depth, confidence, via, causes): per node least depth, then greatest confidence; sorted causes.

    Nodes that are origins themselves are left out.
    """
    return (
        found.join(origins.select("id").distinct(), "id", "left_anti")
        .groupBy("id").agg(F.min(F.struct("depth", (-F.col("confidence")).alias("minus"), "via", "cause")).alias("e"), F.array_sort(F.collect_set("cause")).alias("causes"))
        .select("id", F.col("e.depth").alias("depth"), (-F.col("e.minus")).alias("confidence"), F.col("e.via").alias("via"), "causes")
    )


def closure(pairs: DataFrame) -> DataFrame:
    """(a, b): the transitive closure of a relation (a, b)."""
    return least_depths(pairs).select("a", "b")


def least_depths(pairs: DataFrame) -> DataFrame:
    """(a, b, depth): every pair of the transitive closure of (a, b), with the least number of steps.

    A round joins the pairs at the greatest depth so far with all known ones: what is further away
    is met by that split only, or by few where paths are equally long. So path lengths double, and
    the loop ends when no pair is at that depth, whatever their length.
    """
    known = cut(pairs.select("a", "b").distinct().withColumn("depth", F.lit(1)))
    parts, far = [known], 1
    while True:
        known = _union(parts)
        head = known.where(F.col("depth") == far).select("a", F.col("b").alias("m"))
        if head.isEmpty():
            return known
        met = head.join(known.select(F.col("a").alias("m"), "b", "depth"), "m").groupBy("a", "b").agg((F.min("depth") + far).alias("depth"))
        parts.append(cut(met.join(known.select("a", "b"), ["a", "b"], "left_anti")))
        far *= 2
