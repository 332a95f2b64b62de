"""Closures over edges of many graphs at once.

A graph is packed into one row and closed by a kernel (``plans.kernels``) for all its roots
together: no shuffle for each step.  Graphs with more edges than ``MOST_EDGES``, or more
states (roots times nodes) than ``MOST_STATES``, go level by level through joins, with each
level in a table of the shared folder.  Both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import kernels
from weftgraph.plans.ordered import ranks_within
from weftgraph.plans.scratch import Scratch

KEY = ["graph_id", "root"]
#: A packed graph's edges and states at most: some megabytes of lists, some hundred of arrays.
MOST_EDGES, MOST_STATES = 200_000, 50_000_000
_STATES = "graph_id long, root long, node_id long, type long, depth long"


def packed(df: DataFrame, out: str, *columns: str) -> DataFrame:
    """One row for each graph with the list ``out`` of its rows."""
    return df.groupBy("graph_id").agg(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in columns])).alias(out))


def _empty(out: str, *columns: str):
    kind = ", ".join(f"{c}: bigint" for c in columns)
    return F.lit(None).cast(f"array<struct<{kind}>>").alias(out)


def large_graphs(edges: DataFrame, starts: DataFrame, most_edges: int, most_states: int) -> DataFrame:
    """``graph_id`` of the graphs not to pack; ``starts`` (graph_id, root) are counted for the states."""
    wide = edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
    many = starts.groupBy("graph_id").agg(F.count("*").alias("starts"))
    both = wide.join(many, "graph_id")
    return both.where((F.col("edges") > most_edges) | (2 * F.col("edges") * F.col("starts") > most_states)).select("graph_id")


def _without(df: DataFrame, large: DataFrame | None) -> DataFrame:
    return df if large is None else df.join(large, "graph_id", "left_anti")


def _split(edges: DataFrame, starts: DataFrame, most_edges: int, most_states: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Edges and starts as tables, and the large graphs, if there are any."""
    edges = scratch.keep(edges.select("graph_id", "source", "target"), "edges")
    starts = scratch.keep(starts.select(*KEY, "node_id"), "starts")
    large = scratch.keep(large_graphs(edges, starts, most_edges, most_states), "large")
    return edges, starts, None if large.isEmpty() else large


def closure(edges: DataFrame, starts: DataFrame, blocked: DataFrame | None = None, nodes: DataFrame | None = None, most_edges: int = MOST_EDGES, most_states: int = MOST_STATES) -> DataFrame:
    """``graph_id, root, node_id, type, depth`` of all that ``starts`` (graph_id, root, node_id) reach.

    ``edges`` has graph_id, source, target; ``blocked`` (graph_id, root, node_id) names
    nodes that no edge may enter for a root.  Depth is the least number of edges.  With
    ``nodes`` (graph_id, node_id, type) all nodes of a root's graph are there, with a null
    depth where not reached; without them types are null.
    """
    edges, starts, large = _split(edges, starts, most_edges, most_states, Scratch(edges.sparkSession))
    rows = packed(_without(starts, large), "ss", "root", "node_id").join(packed(edges, "es", "source", "target") if large is None else packed(_without(edges, large), "es", "source", "target"), "graph_id", "left")
    rows = rows.withColumn("bs", _empty("bs", "root", "node_id")) if blocked is None else rows.join(packed(_without(blocked, large), "bs", "root", "node_id"), "graph_id", "left")
    rows = rows.withColumn("ns", _empty("ns", "node_id", "type")) if nodes is None else rows.join(packed(_without(nodes, large), "ns", "node_id", "type"), "graph_id", "left")
    small = rows.select("graph_id", "es", "ss", "bs", "ns").mapInArrow(kernels.closure_kernel(nodes is not None), _STATES)
    if large is None:
        return small
    far = frontier_closure(edges.join(large, "graph_id", "left_semi"), starts.join(large, "graph_id", "left_semi"), blocked)
    return small.unionByName(_with_nodes(far, starts.join(large, "graph_id", "left_semi"), nodes))


def _with_nodes(found: DataFrame, starts: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is None:
        return found.select(*KEY, "node_id", F.lit(None).cast("long").alias("type"), "depth")
    every = starts.select(*KEY).distinct().join(nodes.select("graph_id", "node_id", F.col("type").cast("long").alias("type")), "graph_id")
    return every.join(found.select(*KEY, "node_id", "depth"), [*KEY, "node_id"], "left").select(*KEY, "node_id", "type", "depth")


def frontier_closure(edges: DataFrame, starts: DataFrame, blocked: DataFrame | None = None, most_rounds: int = 100_000) -> DataFrame:
    """The closure level by level; for graphs too large for one row."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.select("graph_id", "source", "target").distinct(), "edges")
    seen = scratch.keep(starts.select(*KEY, "node_id").distinct().withColumn("depth", F.lit(0).cast("long")), "level-0")
    front = seen
    for depth in range(1, most_rounds):
        met = front.withColumnRenamed("node_id", "source").join(edges, ["graph_id", "source"]).select(*KEY, F.col("target").alias("node_id")).distinct()
        new = met.join(seen.select(*KEY, "node_id"), [*KEY, "node_id"], "left_anti")
        if blocked is not None:
            new = new.join(blocked.select(*KEY, "node_id"), [*KEY, "node_id"], "left_anti")
        front = scratch.keep(new.withColumn("depth", F.lit(depth).cast("long")), f"level-{depth}")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 8 == 0:
            seen = scratch.keep(seen, f"seen-{depth}")
    raise RuntimeError(f"a closure is not complete after {most_rounds} levels")


def all_predecessors(edges: DataFrame, starts: DataFrame, nodes: DataFrame, most_edges: int = MOST_EDGES, most_states: int = MOST_STATES) -> DataFrame:
    """``graph_id, root, node_id, type, depth``: each of ``nodes``, with depth 0 if it is in the set, else null.

    The set is the least one with ``starts`` and each node all of whose predecessors are in it.
    """
    edges, starts, large = _split(edges, starts, most_edges, most_states, Scratch(edges.sparkSession))
    rows = packed(_without(starts, large), "ss", "root", "node_id").join(packed(_without(edges, large), "es", "source", "target"), "graph_id", "left").join(packed(_without(nodes, large), "ns", "node_id", "type"), "graph_id", "left")
    small = rows.select("graph_id", "es", "ss", "ns").mapInArrow(kernels.predecessors_kernel, _STATES)
    if large is None:
        return small
    some = starts.join(large, "graph_id", "left_semi")
    found = counted_predecessors(edges.join(large, "graph_id", "left_semi"), some).withColumn("depth", F.lit(0).cast("long"))
    return small.unionByName(_with_nodes(found, some, nodes))


def counted_predecessors(edges: DataFrame, starts: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """The same level by level: a node joins when as many predecessors as it has are in the set."""
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.select("graph_id", "source", "target").distinct(), "edges")
    needed = scratch.keep(edges.groupBy("graph_id", F.col("target").alias("node_id")).agg(F.count("*").alias("needed")), "needed")
    seen = front = scratch.keep(starts.select(*KEY, "node_id").distinct(), "level-0")
    counts = None
    for level in range(1, most_rounds):
        met = front.withColumnRenamed("node_id", "source").join(edges, ["graph_id", "source"]).groupBy(*KEY, F.col("target").alias("node_id")).agg(F.count("*").alias("have"))
        if counts is not None:
            met = met.unionByName(counts).groupBy(*KEY, "node_id").agg(F.sum("have").alias("have"))
        counts = scratch.keep(met, f"counts-{level}")
        if level > 1:
            scratch.drop(f"counts-{level - 1}")
        full = counts.join(needed, ["graph_id", "node_id"]).where("have = needed").select(*KEY, "node_id")
        front = scratch.keep(full.join(seen, [*KEY, "node_id"], "left_anti"), f"level-{level}")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if level % 8 == 0:
            seen = scratch.keep(seen, f"seen-{level}")
    raise RuntimeError(f"a set is not complete after {most_rounds} levels")


def queue_levels(edges: DataFrame, roots: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """``graph_id, root, node_id, depth`` of the entries of a queue from each root, one for each node and depth, from 1.

    ``edges`` (graph_id, flow, edge_id, source, target) are followed by flow and then id.  A
    level's entries have places, ranked by the place of what handed them on and by the edge; an
    entry hands on what no entry before it is.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges, "edges")
    level = scratch.keep(roots.select(*KEY, F.col("root").alias("node_id"), F.lit(1).cast("long").alias("place")), "level-1")
    before, seen = None, level.select(*KEY, "node_id")  # what levels before this one hold, and this one too
    every = level.select(*KEY, "node_id", F.lit(1).cast("long").alias("depth"))
    for depth in range(2, most_rounds):
        handed = level.withColumnRenamed("node_id", "source").join(edges, ["graph_id", "source"]).select(*KEY, F.col("target").alias("node_id"), F.struct("place", "flow", "edge_id").alias("by"))
        if before is not None:
            handed = handed.join(before, [*KEY, "node_id"], "left_anti")
        handed = handed.join(level.withColumnRenamed("place", "own"), [*KEY, "node_id"], "left").where(F.col("own").isNull() | (F.col("own") > F.col("by.place")))
        handed = handed.groupBy(*KEY, "node_id").agg(F.min("by").alias("by"))
        level = scratch.keep(ranks_within(handed, KEY, [F.col("by").asc()], scratch, f"ranked-{depth}", "place").drop("by"), f"level-{depth}")
        scratch.drop(f"ranked-{depth}")
        if level.isEmpty():
            return every
        before, seen = seen, seen.unionByName(level.select(*KEY, "node_id"))
        every = every.unionByName(level.select(*KEY, "node_id", F.lit(depth).cast("long").alias("depth")))
        if depth % 8 == 0:
            before, seen, every = (scratch.keep(df, f"{name}-{depth}") for name, df in (("before", before), ("seen", seen), ("every", every)))
    raise RuntimeError(f"a queue is not empty after {most_rounds} levels")


def queue_order(edges: DataFrame, starts: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """``graph_id, node_id, place``, from 0, in the order of a queue from each start in turn.

    ``edges`` has graph_id, edge_id, source, target, ``starts`` graph_id, edge_id, node_id, in the
    order of ``edge_id``.  A node belongs to the first start that reaches it; then all walks go
    level by level, each level ranked by the place of the parent and the edge.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.select("graph_id", "edge_id", "source", "target"), "edges")
    owned = front = scratch.keep(starts.groupBy("graph_id", "node_id").agg(F.min("edge_id").alias("owner")), "owned-0")
    for turn in range(1, most_rounds):
        met = front.withColumnRenamed("node_id", "source").join(edges, ["graph_id", "source"]).groupBy("graph_id", F.col("target").alias("node_id")).agg(F.min("owner").alias("owner"))
        known = owned.withColumnRenamed("owner", "own")
        front = scratch.keep(met.join(known, ["graph_id", "node_id"], "left").where(F.col("own").isNull() | (F.col("own") > F.col("owner"))).drop("own"), f"front-{turn}")
        if front.isEmpty():
            break
        owned = scratch.keep(owned.unionByName(front).groupBy("graph_id", "node_id").agg(F.min("owner").alias("owner")), f"owned-{turn}")
        if turn > 1:
            scratch.drop(f"owned-{turn - 1}")
    else:
        raise RuntimeError(f"a queue is not empty after {most_rounds} levels")
    ends = owned.withColumnRenamed("owner", "own")
    inner = edges.join(ends.withColumnRenamed("node_id", "source"), ["graph_id", "source"]).join(owned.withColumnRenamed("node_id", "target"), ["graph_id", "target"]).where("own = owner")
    inner = scratch.keep(inner.select("graph_id", "owner", "edge_id", "source", "target"), "inner")
    first = starts.groupBy("graph_id", "node_id").agg(F.min("edge_id").alias("edge_id")).join(owned, ["graph_id", "node_id"]).where("owner = edge_id")
    level = scratch.keep(first.select("graph_id", "owner", "node_id", F.lit(0).cast("long").alias("depth"), F.lit(1).cast("long").alias("rank")), "walk-0")
    every = level
    for depth in range(1, most_rounds):
        met = level.select("graph_id", "owner", F.col("node_id").alias("source"), "rank").join(inner, ["graph_id", "owner", "source"])
        met = met.groupBy("graph_id", "owner", F.col("target").alias("node_id")).agg(F.min(F.struct("rank", "edge_id")).alias("by"))
        new = met.join(every.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti")
        ranked = ranks_within(new, ["graph_id", "owner"], [F.col("by").asc()], scratch, f"ranked-{depth}", "rank")
        level = scratch.keep(ranked.select("graph_id", "owner", "node_id", F.lit(depth).cast("long").alias("depth"), "rank"), f"walk-{depth}")
        scratch.drop(f"ranked-{depth}")
        if level.isEmpty():
            break
        every = every.unionByName(level)
        if depth % 8 == 0:
            every = scratch.keep(every, f"every-{depth}")
    else:
        raise RuntimeError(f"a queue is not empty after {most_rounds} levels")
    placed = ranks_within(every, ["graph_id"], [F.col(c).asc() for c in ("owner", "depth", "rank")], scratch, "placed", "place")
    return placed.select("graph_id", "node_id", (F.col("place") - 1).alias("place"))
