"""Data-flow analyses over ``nodes`` and ``edges`` of many graphs.

Each labels every node of a graph for each root: ``graph_id, root, node_id, is_root,
value``; ``instances`` has the step and active-node counts.  ``run`` dispatches by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.fixpoint import KEY, MOST_EDGES, MOST_STATES, all_predecessors, closure, large_graphs, packed, queue_levels
from weftgraph.plans.kernels import adjacency_kernel, dominators_kernel, liveness_kernel, sampled_closure_kernel, sampled_liveness_kernel, steps_kernel
from weftgraph.plans.scratch import Scratch
from weftgraph.schema import COMMUTATIVE, CONTROL, DATA, INSTRUCTION, VARIABLE


def flow(edges: DataFrame, code: int, reverse: bool = False) -> DataFrame:
    """``graph_id, source, target, position, edge_id`` of one flow."""
    ends = ("target", "source") if reverse else ("source", "target")
    return edges.where(F.col("flow") == code).select("graph_id", F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"), "position", "edge_id")


def eligible(nodes: DataFrame, kind: int) -> DataFrame:
    """Nodes of a type, without the graph's root node."""
    return nodes.where((F.col("type") == kind) & (F.col("node_id") > 0)).select("graph_id", "node_id")


def portable_hash(seed: int) -> Column:
    """A spread of nodes that SQL engines compute alike; ids are reduced first, as they may be any long."""
    return (F.col("node_id") % 10007 * 7919 + F.col("graph_id") % 10007 * 104729 + seed) % 10007


def sample_roots(candidates: DataFrame, most: int = 10, seed: int = 0) -> DataFrame:
    """``graph_id, root``: a tenth of the candidates, rounded up, ``most`` at most, in a seeded order."""
    order = Window.partitionBy("graph_id").orderBy(portable_hash(seed), "node_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("graph_id")))
    return ranked.where(F.col("rank") <= F.least(F.ceil(F.col("n") / 10), F.lit(most))).select("graph_id", F.col("node_id").alias("root"))


def labelled(nodes: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each root and node of its graph; ``found`` (graph_id, root, node_id) has value 1."""
    every = roots.join(nodes.select("graph_id", "node_id"), "graph_id")
    hit = found.select(*KEY, "node_id").withColumn("value", F.lit(1).cast("long"))
    return every.join(hit, [*KEY, "node_id"], "left").select(*KEY, "node_id", (F.col("node_id") == F.col("root")).cast("long").alias("is_root"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def counted(found: DataFrame, steps: Column) -> DataFrame:
    """``graph_id, root, step_count, active_node_count``."""
    return found.groupBy(*KEY).agg(steps.cast("long").alias("step_count"), F.sum("value").cast("long").alias("active_node_count"))


def _starts(roots: DataFrame) -> DataFrame:
    return roots.select("graph_id", "root", F.col("root").alias("node_id"))


def _labels(found: DataFrame) -> DataFrame:
    return found.select(*KEY, "node_id", (F.col("node_id") == F.col("root")).cast("long").alias("is_root"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def reached(nodes: DataFrame, edges: DataFrame, roots: DataFrame, every: bool = False) -> DataFrame:
    """Forward control closure with depths; the root's is 1.  ``every`` adds the nodes not reached, with value 0."""
    found = closure(flow(edges, CONTROL), _starts(roots), nodes=nodes if every else None)
    return found.withColumn("depth", F.col("depth") + 1).withColumn("value", F.col("depth").isNotNull().cast("long"))


def reachability(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return _labels(reached(nodes, edges, roots, True))


def reachability_instances(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return counted(reached(nodes, edges, roots), F.max("depth"))


def depended(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes with their depths, from 0, in the backward data closure; ``value`` is 1 for instructions in it."""
    found = closure(flow(edges, DATA, reverse=True), _starts(roots), nodes=nodes)
    return found.withColumn("value", (F.col("depth").isNotNull() & (F.col("type") == INSTRUCTION)).cast("long"))


def datadep(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return _labels(depended(nodes, edges, roots))


def datadep_instances(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return counted(depended(nodes, edges, roots).where("depth is not null"), F.max("depth"))


def dominated(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All nodes; value 1 for the least set with the root and each instruction whose control predecessors, at least one, are all in it."""
    return all_predecessors(flow(edges, CONTROL), _starts(roots), nodes).withColumn("value", F.col("depth").isNotNull().cast("long"))


def dominance(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return _labels(dominated(nodes, edges, roots))


def dominance_instances(nodes: DataFrame, edges: DataFrame, roots: DataFrame, most_updates: int = 1000) -> DataFrame:
    """The step count is the number of set updates of ascending sweeps over full dominator sets.

    ``status`` is ``not_converged`` beyond ``most_updates``.
    """
    nodes = nodes if "function" in nodes.columns else nodes.withColumn("function", F.lit(0).cast("long"))
    kinds = packed(nodes.withColumn("function", F.coalesce("function", F.lit(0))), "ns", "node_id", "type", "function")
    rows = packed(roots.select("graph_id", "root").distinct(), "ss", "root").join(kinds, "graph_id").join(packed(flow(edges, CONTROL), "es", "source", "target"), "graph_id", "left")
    return rows.select("graph_id", "ns", "es", "ss").mapInArrow(dominators_kernel(most_updates), "graph_id long, root long, step_count long, active_node_count long, status string")


def exits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Instructions without a control successor, besides the root node."""
    return eligible(nodes, INSTRUCTION).join(flow(edges, CONTROL).select("graph_id", F.col("source").alias("node_id")), ["graph_id", "node_id"], "left_anti")


def _live_rows(nodes: DataFrame, edges: DataFrame, *columns: str) -> DataFrame:
    """A row for each graph with its nodes and its control and data edges."""
    walked = edges.where(F.col("flow").isin(CONTROL, DATA))
    return packed(nodes, "ns", "node_id", "type").join(packed(walked, "es", *columns), "graph_id").select("graph_id", "ns", "es")


def _live(nodes: DataFrame, edges: DataFrame, outs: bool, most_edges: int = MOST_EDGES, most_states: int = MOST_STATES, fits: bool = False) -> DataFrame:
    """Live variables of all graphs: packed ones by one kernel, large ones by joins."""
    one = lambda nodes, edges: _live_rows(nodes, edges, "flow", "source", "target").mapInArrow(liveness_kernel(outs), "graph_id long, node_id long, variable long")
    if fits:
        return one(nodes, edges)
    scratch = Scratch(edges.sparkSession)
    edges = scratch.keep(edges.where(F.col("flow").isin(CONTROL, DATA)).select("graph_id", "flow", "position", "source", "target", "edge_id"), "edges")
    large = scratch.keep(large_graphs(edges, edges.where(F.col("flow") == DATA), most_edges, most_states), "large")
    if large.isEmpty():
        return one(nodes, edges)
    few, many = (lambda df, how=how: df.join(large, "graph_id", how) for how in ("left_anti", "left_semi"))
    needed = live_in_by_joins(many(nodes), many(edges))
    return one(few(nodes), few(edges)).unionByName(_before(many(edges), needed) if outs else needed)


def live_in_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``live_in`` for graphs too large for one row: one closure for each value, back from its uses over control, past no definition."""
    control = flow(edges, CONTROL, reverse=True)
    final = exits(nodes, edges).select("graph_id", F.lit(0).cast("long").alias("root"), "node_id")
    ending = closure(control, final).select("graph_id", "node_id")
    instructions = nodes.where(F.col("type") == INSTRUCTION).select("graph_id", "node_id")
    data = flow(edges, DATA)
    uses = data.select("graph_id", F.col("source").alias("root"), F.col("target").alias("node_id")).distinct().join(ending, ["graph_id", "node_id"], "left_semi")
    defs = data.select("graph_id", F.col("target").alias("root"), F.col("source").alias("node_id")).distinct().join(instructions, ["graph_id", "node_id"], "left_semi")
    return closure(control, uses, defs).select("graph_id", "node_id", F.col("root").alias("variable"))


def _before(edges: DataFrame, needed: DataFrame) -> DataFrame:
    control = flow(edges, CONTROL).select("graph_id", "source", F.col("target").alias("node_id"))
    return control.join(needed, ["graph_id", "node_id"]).select("graph_id", F.col("source").alias("node_id"), "variable").distinct()


def live_in(nodes: DataFrame, edges: DataFrame, fits: bool = False) -> DataFrame:
    """``graph_id, node_id, variable``: values that an instruction, which reaches an exit, needs; ``fits`` says that each graph may be one row."""
    return _live(nodes, edges, False, fits=fits)


def live_out(nodes: DataFrame, edges: DataFrame, fits: bool = False) -> DataFrame:
    """``graph_id, node_id, variable``: what some control successor needs; ``fits`` as in ``live_in``."""
    return _live(nodes, edges, True, fits=fits)


def sampled_liveness(nodes: DataFrame, edges: DataFrame, most: int = 10, seed: int = 0, fits: bool = False) -> DataFrame:
    """``liveness`` for sampled roots; where each graph ``fits`` in a row, one kernel samples and labels."""
    if fits:
        rows = _live_rows(nodes, edges, "flow", "edge_id", "source", "target")
        return rows.mapInArrow(sampled_liveness_kernel(True, most, seed), "graph_id long, root long, node_id long, is_root long, value long")
    out = Scratch(nodes.sparkSession).keep(live_out(nodes, edges), "out")
    return liveness(nodes, edges, sample_roots(liveness_roots(nodes, edges, out), most, seed), out)


def sampled_liveness_instances(nodes: DataFrame, edges: DataFrame, most: int = 10, seed: int = 0, fits: bool = False) -> DataFrame:
    """``liveness_instances`` for sampled roots, likewise."""
    if fits:
        rows = _live_rows(nodes, edges, "flow", "edge_id", "source", "target")
        return rows.mapInArrow(sampled_liveness_kernel(False, most, seed), "graph_id long, root long, step_count long, active_node_count long")
    out = Scratch(nodes.sparkSession).keep(live_out(nodes, edges), "out")
    return liveness_instances(nodes, edges, sample_roots(liveness_roots(nodes, edges, out), most, seed), out)


def sampled_closures(nodes: DataFrame, edges: DataFrame, kind: int, most: int = 10, seed: int = 0) -> DataFrame:
    """``graph_id, root, label_count, reached, instructions, depth`` for roots sampled from a kind of nodes, in one kernel.

    ``edges`` are those to follow, from source to target; each graph fits in a row.  ``label_count`` counts
    the graph's nodes, ``depth`` is the greatest number of edges to one.
    """
    rows = packed(nodes, "ns", "node_id", "type").join(packed(edges, "es", "source", "target"), "graph_id", "left").select("graph_id", "ns", "es")
    return rows.mapInArrow(sampled_closure_kernel(kind, most, seed), "graph_id long, root long, label_count long, reached long, instructions long, depth long")


def sampled_datadep_instances(nodes: DataFrame, edges: DataFrame, most: int = 10, seed: int = 0, fits: bool = False) -> DataFrame:
    """``datadep_instances`` for sampled roots; in one kernel where each graph ``fits`` in a row."""
    if not fits:
        return datadep_instances(nodes, edges, sample_roots(eligible(nodes, VARIABLE), most, seed))
    found = sampled_closures(nodes, flow(edges, DATA, reverse=True), VARIABLE, most, seed)
    return found.select(*KEY, F.col("depth").alias("step_count"), F.col("instructions").alias("active_node_count"))


def liveness_roots(nodes: DataFrame, edges: DataFrame, out: DataFrame | None = None) -> DataFrame:
    """Nodes with a live-out value; ``out`` is the result of ``live_out``, if there is one already."""
    out = live_out(nodes, edges) if out is None else out
    return out.select("graph_id", "node_id").distinct()


def liveness(nodes: DataFrame, edges: DataFrame, roots: DataFrame, out: DataFrame | None = None) -> DataFrame:
    out = live_out(nodes, edges) if out is None else out
    found = roots.join(out.withColumnRenamed("node_id", "root"), KEY).withColumnRenamed("variable", "node_id")
    return labelled(nodes, roots, found)


def liveness_instances(nodes: DataFrame, edges: DataFrame, roots: DataFrame, out: DataFrame | None = None, most_edges: int = MOST_EDGES, most_states: int = MOST_STATES) -> DataFrame:
    """The step count follows a queue over control and then data successors that may hold a node twice."""
    scratch = Scratch(edges.sparkSession)
    roots = scratch.keep(roots.select(*KEY).distinct(), "roots")
    out = live_out(nodes, edges) if out is None else out
    lives = scratch.keep(roots.join(out.withColumnRenamed("node_id", "root"), KEY).select(*KEY, F.col("variable").alias("node")).distinct(), "lives")
    walked = scratch.keep(edges.where(F.col("flow").isin(CONTROL, DATA)).select("graph_id", "flow", "edge_id", "source", "target"), "walked")
    large = scratch.keep(large_graphs(walked, roots, most_edges, most_states), "large")
    none = large.isEmpty()
    few = lambda df: df if none else df.join(large, "graph_id", "left_anti")
    rows = packed(few(roots), "ss", "root").join(packed(few(lives), "ls", "root", "node"), "graph_id", "left").join(packed(few(walked), "es", "flow", "edge_id", "source", "target"), "graph_id", "left")
    found = rows.select("graph_id", "es", "ss", "ls").mapInArrow(steps_kernel, "graph_id long, root long, step_count long, active_node_count long")
    if none:
        return found
    many = lambda df: df.join(large, "graph_id", "left_semi")
    levels = queue_levels(many(walked), many(roots)).join(many(lives).withColumnRenamed("node", "node_id"), [*KEY, "node_id"]).groupBy(*KEY).agg(F.max("depth").alias("step_count"))
    active = many(lives).groupBy(*KEY).agg(F.count("*").alias("active_node_count"))
    deep = many(roots).join(levels, KEY, "left").join(active, KEY, "left")
    return found.unionByName(deep.select(*KEY, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("step_count", "active_node_count")]))


def expressions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, node_id, text, operands``: operands by id where they may change places, else by position."""
    operands = flow(edges, DATA).select("graph_id", F.col("target").alias("node_id"), "position", F.col("source").alias("operand"))
    named = operands.join(nodes.where((F.col("type") == INSTRUCTION) & (F.col("node_id") > 0)).select("graph_id", "node_id", "text"), ["graph_id", "node_id"])
    free = F.col("text").isin(COMMUTATIVE)
    keyed = named.groupBy("graph_id", "node_id", "text").agg(F.sort_array(F.collect_list(F.struct(F.when(free, 0).otherwise(F.col("position")).alias("p"), "operand"))).alias("rows"))
    return keyed.select("graph_id", "node_id", "text", F.transform("rows", lambda r: r["operand"]).alias("operands"))


def expression_sets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, text, operands, members, size`` of the sets of two or more."""
    grouped = expressions(nodes, edges).groupBy("graph_id", "text", "operands").agg(F.sort_array(F.collect_list("node_id")).alias("members"))
    return grouped.withColumn("size", F.size("members").cast("long")).where("size > 1")


def expression_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, node_id, number, size`` of each member of a set of two or more; the number is its least member."""
    keyed = expressions(nodes, edges)
    sets = keyed.groupBy("graph_id", "text", "operands").agg(F.min("node_id").alias("number"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(sets, ["graph_id", "text", "operands"]).select("graph_id", "node_id", "number", "size")


def subexpression_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return expression_numbers(nodes, edges).select("graph_id", "node_id")


def subexpressions(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """A node is labelled if its expression has the number of the root's."""
    numbers = Scratch(edges.sparkSession).keep(expression_numbers(nodes, edges).select("graph_id", "node_id", "number"), "numbers")
    asked = roots.join(numbers.select("graph_id", F.col("node_id").alias("root"), F.col("number").alias("wanted")), KEY, "left")
    every = nodes.select("graph_id", "node_id").join(numbers, ["graph_id", "node_id"], "left")
    same = F.coalesce(F.col("number") == F.col("wanted"), F.lit(False)).cast("long")
    return asked.join(every, "graph_id").select(*KEY, "node_id", (F.col("node_id") == F.col("root")).cast("long").alias("is_root"), same.alias("value"))


def subexpressions_instances(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    numbers = expression_numbers(nodes, edges).select("graph_id", F.col("node_id").alias("root"), "size")
    return roots.join(numbers, KEY).select(*KEY, F.lit(2).cast("long").alias("step_count"), F.col("size").alias("active_node_count"))


#: Name: (labels, instances, eligible roots).
ANALYSES: dict[str, tuple[Callable, Callable, Callable]] = {
    "reachability": (reachability, reachability_instances, lambda nodes, edges: eligible(nodes, INSTRUCTION)),
    "dominance": (dominance, dominance_instances, lambda nodes, edges: eligible(nodes, INSTRUCTION)),
    "liveness": (liveness, liveness_instances, liveness_roots),
    "datadep": (datadep, datadep_instances, lambda nodes, edges: eligible(nodes, VARIABLE)),
    "subexpressions": (subexpressions, subexpressions_instances, subexpression_roots),
}


def run(name: str, nodes: DataFrame, edges: DataFrame, most: int = 10, seed: int = 0, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Labels and instances of an analysis by name, for sampled roots.

    A graph without a node that may be a root has no rows, or with ``strict`` is an error.
    """
    if name not in ANALYSES:
        raise ValueError(f"unknown analysis: {name}")
    labels, instances, candidates = ANALYSES[name]
    scratch = Scratch(nodes.sparkSession)
    nodes, edges = scratch.keep(nodes, "nodes"), scratch.keep(edges, "edges")  # each is read many times
    known = {"out": scratch.keep(live_out(nodes, edges), "out")} if name == "liveness" else {}
    roots = scratch.keep(sample_roots(candidates(nodes, edges, **known), most, seed), "roots")
    if strict and (without := nodes.select("graph_id").distinct().join(roots, "graph_id", "left_anti").first()):
        raise ValueError(f"graph {without.graph_id} has no node that may be a root of {name}")
    return labels(nodes, edges, roots, **known), instances(nodes, edges, roots, **known)


class Analysis:
    """An analysis to derive from; ``register`` makes it known to ``run`` by its name."""

    name = ""

    def candidates(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """``graph_id, node_id`` of the nodes that may be roots."""
        raise NotImplementedError

    def labels(self, nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
        """``graph_id, root, node_id, is_root, value``."""
        raise NotImplementedError

    def instances(self, nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
        """``graph_id, root, step_count, active_node_count``."""
        raise NotImplementedError

    def run(self, nodes: DataFrame, edges: DataFrame, most: int = 10, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        roots = Scratch(nodes.sparkSession).keep(sample_roots(self.candidates(nodes, edges), most, seed), "roots")
        return self.labels(nodes, edges, roots), self.instances(nodes, edges, roots)


def register(analysis: Analysis) -> Analysis:
    if not analysis.name or analysis.name in ANALYSES:
        raise ValueError(f"no name, or one that is taken: {analysis.name!r}")
    ANALYSES[analysis.name] = (analysis.labels, analysis.instances, analysis.candidates)
    return analysis


def adjacency_text(edges: DataFrame) -> DataFrame:
    """``graph_id, text``: control and data adjacencies both ways, a line ``    node: [a, b]`` for each node that has any."""
    rows = packed(edges.where(F.col("flow").isin(CONTROL, DATA)), "es", "flow", "edge_id", "source", "target")
    return rows.mapInArrow(adjacency_kernel, edges.select("graph_id").schema.add("text", "string"))


def expression_sets_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, text``: the number of expression sets, and a line for each, by least member."""
    sets = expression_sets(nodes, edges).groupBy("graph_id").agg(F.sort_array(F.collect_list("members")).alias("sets"))
    shown = lambda m, i: F.concat(F.lit("Expression set "), i.cast("string"), F.lit(": {"), F.array_join(F.transform(m, lambda x: x.cast("string")), ", "), F.lit("}\n"))
    return sets.select("graph_id", F.concat(F.lit("#. expression sets: "), F.size("sets").cast("string"), F.lit("\n"), F.array_join(F.transform("sets", shown), "")).alias("text"))
