"""Graph navigation as joins: one hop with bag semantics, bounded breadth-first loops.

Loop state is small (ids by level) and checkpointed every hop, so plans don't grow
and a lost executor costs one hop at most.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, Nodes
from .state import settled


def hops(g: Graph, relations: list[str] | None, direction: str, ids: list[str] | None = None) -> DataFrame:
    """Live edges as (near, far, edge); an edge appears in each direction asked for. ids: those of these near ends alone."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"bad direction: {direction}")
    if g.adjacency is not None:
        return g.adjacency.edges(direction, relations, ids)
    e = g.live_edges
    if relations:
        e = e.where(F.col("type_id").isin(list(relations)))
    out = e.select(F.col("source").alias("near"), F.col("target").alias("far"), F.col("id").alias("edge"))
    back = e.select(F.col("target").alias("near"), F.col("source").alias("far"), F.col("id").alias("edge"))
    chosen = {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back)}[direction]()
    return chosen if ids is None else chosen.where(F.col("near").isin(ids))


def traverse(g: Graph, seeds: Nodes, relation: str, direction: str = "out") -> Nodes:
    """Live far ends of one hop; a node appears once for each seed and edge that lead to it."""
    far = seeds.df.select(F.col("id").alias("near")).join(hops(g, [relation], direction), "near").select(F.col("far").alias("id"))
    return Nodes(far.join(g.live, "id"))


#: A frontier of at most so many ids is sent to the edges; a larger one is joined by shuffle. One of at most FEW is named in
#: the filter of the edges' scan.
SMALL_FRONTIER, FEW = 100_000, 500


@dataclass(frozen=True)
class Level:
    """One level of a search: its ids computed once, ready for joins, how many they are, and their names if few."""

    ids: DataFrame
    n: int
    few: list[str] | None

    @classmethod
    def of(cls, ids: DataFrame) -> Level:
        ids = settled(ids)
        few = [r["id"] for r in ids.limit(FEW + 1).collect()]
        n = len(few) if len(few) <= FEW else ids.count()
        return cls(F.broadcast(ids) if n <= SMALL_FRONTIER else ids, n, few if n <= FEW else None)

    def edges(self, g: Graph, relations: list[str] | None, direction: str) -> DataFrame:
        """Edges (near, far) out of the level's nodes."""
        if self.few is not None:
            return hops(g, relations, direction, self.few).select("near", "far")
        return hops(g, relations, direction).select("near", "far").join(self.ids.withColumnRenamed("id", "near"), "near", "left_semi")


def next_level(g: Graph, levels: list[Level], relations: list[str] | None, direction: str, walked: list[DataFrame] | None = None) -> Level:
    """The nodes one hop on that no level holds. The frontier meets the edges before anything is made distinct; levels are
    kept apart, so none is written twice. walked gets the edges (near, far) out of the last level."""
    step = levels[-1].edges(g, relations, direction)
    if walked is not None:
        step = settled(step.distinct())
        walked.append(step)
    new = step.select(F.col("far").alias("id")).distinct()
    for seen in levels:
        new = new.join(seen.ids, "id", "left_anti")
    return Level.of(new)


def search(g: Graph, start: DataFrame, relations: list[str] | None, max_hops: int, direction: str) -> list[DataFrame]:
    """The breadth-first levels (id), the start first."""
    levels = [Level.of(start.select("id").distinct())]
    while len(levels) <= max_hops:
        new = next_level(g, levels, relations, direction)
        if not new.n:
            break
        levels.append(new)
    return [x.ids for x in levels]


def expand(g: Graph, seeds: Nodes, relations: list[str] | None = None, max_hops: int = 2, direction: str = "out") -> Nodes:
    """Live nodes within max_hops, without the seeds; deprecated and missing nodes are walked through."""
    found = search(g, seeds.df, relations, max_hops, direction)[1:]
    if not found:
        return Nodes(g.live.limit(0))
    return Nodes(g.live.join(reduce(DataFrame.union, found), "id", "left_semi"))


def path_find(g: Graph, source: str, target: str, relations: list[str] | None = None, max_hops: int = 6, mode: str = "shortest") -> DataFrame:
    """Paths along out-edges, as rows (path). source = target gives [[source]].

    mode "shortest": all simple shortest paths, the documented contract: levels from both ends until they meet, then
    paths out of the nodes where they do, along the edges walked, so no path is begun that doesn't arrive.
    mode "last_hop": as the reference's search behaves, with the smallest id where it takes whichever
    parent it found first: one path for each live edge into the target from a node of the level before
    it, and of the levels after that as long as each finds the target again.
    """
    spark = g.nodes.sparkSession
    if mode not in ("shortest", "last_hop"):
        raise ValueError(f"bad mode: {mode}")
    if source == target:
        return spark.createDataFrame([([source],)], "path array<string>")
    start = spark.createDataFrame([(source,)], "id string")
    if mode == "last_hop":
        return last_hops(g, start, target, relations, max_hops)
    # From both ends, on the side with fewer nodes to open, until a level of one meets the last one of the other.
    sides = {"out": [Level.of(start)], "in": [Level.of(spark.createDataFrame([(target,)], "id string"))]}
    walked: dict[str, list[DataFrame]] = {"out": [], "in": []}
    while True:
        way = min(sides, key=lambda w: sides[w][-1].n)
        new = next_level(g, sides[way], relations, way, walked[way]) if len(walked["out"]) + len(walked["in"]) < max_hops else None
        if new is None or not new.n:
            return spark.createDataFrame([], "path array<string>")
        sides[way].append(new)
        met = settled(sides["out"][-1].ids.join(sides["in"][-1].ids, "id", "left_semi"))
        if not met.isEmpty():
            break
    paths = met.select(F.array("id").alias("path"))
    for edges in reversed(walked["out"]):
        paths = settled(paths.join(edges, F.element_at("path", 1) == F.col("far")).select(F.concat(F.array("near"), "path").alias("path")))
    for edges in reversed(walked["in"]):  # near is the end that is nearer the target
        paths = settled(paths.join(edges, F.element_at("path", -1) == F.col("far")).select(F.concat("path", F.array("near")).alias("path")))
    return paths


def last_hops(g: Graph, start: DataFrame, target: str, relations: list[str] | None, max_hops: int) -> DataFrame:
    near = hops(g, relations, "out").select("near", "far")
    seen = frontier = settled(start.select("id", F.array("id").alias("path")))
    out, since = [], None
    for depth in range(1, max_hops + 1):
        step = frontier.join(near, F.col("id") == F.col("near"))
        hits = settled(step.where(F.col("far") == target).select(F.concat("path", F.array("far")).alias("path")))
        if not hits.isEmpty():
            out.append(hits)
            since = depth
        elif since is not None:
            break
        new = step.where(F.col("far") != target).join(seen.select(F.col("id").alias("far")), "far", "left_anti")
        frontier = settled(new.groupBy("far").agg(F.min_by("path", "id").alias("parent")).select(F.col("far").alias("id"), F.concat("parent", F.array("far")).alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return reduce(DataFrame.union, out) if out else g.nodes.sparkSession.createDataFrame([], "path array<string>")


def subgraph(g: Graph, root: str, depth: int = 2, relations: list[str] | None = None) -> tuple[Nodes, DataFrame]:
    """Nodes reached within depth out-hops, the root and deprecated ones included, and every live
    out-edge of the nodes that lie before the last depth."""
    levels = search(g, g.nodes.sparkSession.createDataFrame([(root,)], "id string"), relations, depth, "out")
    inner = reduce(DataFrame.union, levels[:depth]) if depth else levels[0].limit(0)
    edges = g.live_edges if not relations else g.live_edges.where(F.col("type_id").isin(list(relations)))
    return Nodes(g.nodes.join(reduce(DataFrame.union, levels), "id", "left_semi")), edges.join(inner.withColumnRenamed("id", "source"), "source", "left_semi")


def edges_of(g: Graph, node_id: str, end: str = "source", relation: str | None = None) -> DataFrame:
    """Live edges whose `source` or `target` is the node."""
    e = g.live_edges.where(F.col(end) == node_id)
    return e if relation is None else e.where(F.col("type_id") == relation)
