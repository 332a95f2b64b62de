"""Graphs made by hand: rows are added one after the other, with checks, or many at once from tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import validation
from weftgraph.schema import CALL, CONSTANT, CONTROL, DATA, EDGES, FLOWS, FUNCTIONS, INSTRUCTION, MODULES, NODE_TYPES, NODES, ROOT_TEXT, TYPE, TYPE_FLOW, VARIABLE, GraphCreationError

#: Types of ends that each flow may join.
ENDS = {
    CONTROL: {(INSTRUCTION, INSTRUCTION)},
    CALL: {(INSTRUCTION, INSTRUCTION)},
    DATA: {(a, b) for a in (INSTRUCTION, VARIABLE, CONSTANT) for b in (INSTRUCTION, VARIABLE, CONSTANT)} - {(INSTRUCTION, INSTRUCTION)},
    TYPE_FLOW: {(TYPE, VARIABLE), (TYPE, CONSTANT), (TYPE, TYPE)},
}


class GraphBuilder:
    """One graph, for which each addition returns the new row's number; ``build`` makes tables of it.

    There is a root from the start.  An edge whose ends are missing or of types that its flow
    can't join is an error at once.
    """

    def __init__(self, graph_id: int = 0):
        self.graph_id = graph_id
        self.clear()

    def clear(self) -> None:
        """Back to the root alone."""
        self.nodes: list[tuple] = []
        self.edges: list[tuple] = []
        self.functions: list[tuple] = []
        self.modules: list[tuple] = []
        self._node(INSTRUCTION, ROOT_TEXT, None, None, None)

    def _node(self, kind: int, text: str, function: int | None, block: int | None, features: dict | None) -> int:
        if function is not None and not 0 <= function < len(self.functions):
            raise GraphCreationError(f"there is no function {function}")
        self.nodes.append((self.graph_id, len(self.nodes), kind, text, function or 0, block or 0, features))
        return len(self.nodes) - 1

    def module(self, name: str, features: dict | None = None) -> int:
        self.modules.append((self.graph_id, len(self.modules), name, features))
        return len(self.modules) - 1

    def function(self, name: str, module: int, features: dict | None = None) -> int:
        if not 0 <= module < len(self.modules):
            raise GraphCreationError(f"there is no module {module}")
        self.functions.append((self.graph_id, len(self.functions), name, module, features))
        return len(self.functions) - 1

    def instruction(self, text: str, function: int, block: int = 0, features: dict | None = None) -> int:
        return self._node(INSTRUCTION, text, function, block, features)

    def variable(self, text: str, function: int, features: dict | None = None) -> int:
        return self._node(VARIABLE, text, function, None, features)

    def constant(self, text: str, features: dict | None = None) -> int:
        return self._node(CONSTANT, text, None, None, features)

    def type(self, text: str, features: dict | None = None) -> int:
        return self._node(TYPE, text, None, None, features)

    def edge(self, flow: int, source: int, target: int, position: int = 0, features: dict | None = None) -> int:
        for end in (source, target):
            if not 0 <= end < len(self.nodes):
                raise GraphCreationError(f"there is no node {end}")
        kinds = (self.nodes[source][2], self.nodes[target][2])
        if kinds not in ENDS[flow]:
            raise GraphCreationError(f"a {FLOWS[flow]} edge can't join {NODE_TYPES[kinds[0]]} and {NODE_TYPES[kinds[1]]}")
        if flow == CALL and position:
            raise GraphCreationError("a CALL edge has position 0")
        self.edges.append((self.graph_id, len(self.edges), flow, position, source, target, features))
        return len(self.edges) - 1

    def control(self, source: int, target: int, position: int = 0) -> int:
        return self.edge(CONTROL, source, target, position)

    def data(self, source: int, target: int, position: int = 0) -> int:
        return self.edge(DATA, source, target, position)

    def call(self, source: int, target: int) -> int:
        return self.edge(CALL, source, target)

    def type_of(self, source: int, target: int, position: int = 0) -> int:
        return self.edge(TYPE_FLOW, source, target, position)

    def check(self) -> None:
        """The rules of strict graphs: no module without functions, no function without nodes, no node without edges."""
        homes = {n[4] for n in self.nodes[1:] if n[2] in (INSTRUCTION, VARIABLE)}
        for i, m in enumerate(self.modules):
            if i not in {f[3] for f in self.functions}:
                raise GraphCreationError(f"module without functions: {m[2]}")
        for i, f in enumerate(self.functions):
            if i not in homes:
                raise GraphCreationError(f"function without nodes: {f[2]}")
        touched = {x for e in self.edges for x in e[4:6]}
        for n in self.nodes:
            if n[1] not in touched:
                raise GraphCreationError(f"node without edges: {n[1]} {n[3]}")

    def build(self, spark: SparkSession, strict: bool = False) -> dict[str, DataFrame]:
        if strict:
            self.check()
        parts = {"nodes": (self.nodes, NODES), "edges": (self.edges, EDGES), "functions": (self.functions, FUNCTIONS), "modules": (self.modules, MODULES)}
        return {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in parts.items()}


def assemble_nodes(parts: Iterable[DataFrame]) -> DataFrame:
    """Nodes of many graphs from tables of ``graph_id, key, type, text``: numbered by type and key, a root before each graph.

    Returns ``graph_id, node_id, type, text, key``.
    """
    rows = None
    for part in parts:
        part = part.select("graph_id", F.col("key").cast("string").alias("key"), F.col("type").cast("long").alias("type"), "text")
        rows = part if rows is None else rows.unionByName(part)
    roots = rows.select("graph_id").distinct().select("graph_id", F.lit(None).cast("string").alias("key"), F.lit(INSTRUCTION).cast("long").alias("type"), F.lit(ROOT_TEXT).alias("text"))
    order = Window.partitionBy("graph_id").orderBy("type", F.col("key").asc_nulls_first())
    both = rows.unionByName(roots)
    return both.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("node_id"), "type", "text", "key")


def assemble_edges(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of ``graph_id, flow, position, source_key, target_key`` (null: the root) between assembled nodes, and those that break a rule."""
    ends = nodes.select("graph_id", "node_id", F.coalesce("key", F.lit("")).alias("key"))
    joined = links.withColumn("source_key", F.coalesce("source_key", F.lit(""))).withColumn("target_key", F.coalesce("target_key", F.lit("")))
    for side in ("source", "target"):
        joined = joined.join(ends.select("graph_id", F.col("node_id").alias(side), F.col("key").alias(f"{side}_key")), ["graph_id", f"{side}_key"], "left")
    order = Window.partitionBy("graph_id").orderBy("flow", "source", "target", "position")
    edges = joined.select("graph_id", (F.row_number().over(order) - 1).cast("long").alias("edge_id"), F.col("flow").cast("long").alias("flow"), F.col("position").cast("long").alias("position"), "source", "target")
    return edges, validation.edge_violations(nodes, edges)
