"""Construction rules of program graphs, as queries for what breaks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import CALL, CONSTANT, CONTROL, DATA, INSTRUCTION, TYPE, TYPE_FLOW, VARIABLE, GraphCreationError


def _allowed() -> Column:
    s, t = F.col("source_type"), F.col("target_type")
    values = (VARIABLE, CONSTANT)
    return (
        F.when(F.col("flow") == CONTROL, (s == INSTRUCTION) & (t == INSTRUCTION))
        .when(F.col("flow") == DATA, (s.isin(*values) & (t == INSTRUCTION)) | ((s == INSTRUCTION) & t.isin(*values)) | (s.isin(*values) & t.isin(*values)))
        .when(F.col("flow") == CALL, (s == INSTRUCTION) & (t == INSTRUCTION) & (F.col("position") == 0))
        .when(F.col("flow") == TYPE_FLOW, (s == TYPE) & t.isin(*values, TYPE))
    )


def edge_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are missing or of types that their flow can't join."""
    kinds = nodes.select("graph_id", "node_id", "type")
    typed = edges.join(kinds.toDF("graph_id", "source", "source_type"), ["graph_id", "source"], "left").join(kinds.toDF("graph_id", "target", "target_type"), ["graph_id", "target"], "left")
    return typed.where(~F.coalesce(_allowed(), F.lit(False))).select("graph_id", "edge_id", "flow", "source", "target", "source_type", "target_type")


def unconnected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, the root among them, that no edge touches."""
    ends = edges.select("graph_id", F.explode(F.array("source", "target")).alias("node_id"))
    return nodes.join(ends, ["graph_id", "node_id"], "left_anti").select("graph_id", "node_id", "type")


def empty_functions(functions: DataFrame, nodes: DataFrame) -> DataFrame:
    used = nodes.where("node_id > 0").select("graph_id", F.col("function").alias("function_id"))
    return functions.join(used, ["graph_id", "function_id"], "left_anti").select("graph_id", "function_id")


def empty_modules(modules: DataFrame, functions: DataFrame) -> DataFrame:
    return modules.join(functions, ["graph_id", "module_id"], "left_anti").select("graph_id", "module_id")


def check_strict(nodes: DataFrame, edges: DataFrame, functions: DataFrame, modules: DataFrame) -> None:
    """Raise for the first broken rule: modules, then functions, then nodes."""
    for what, broken in (("empty module", empty_modules(modules, functions)), ("empty function", empty_functions(functions, nodes)), ("unconnected node", unconnected_nodes(nodes, edges)), ("wrong edge", edge_violations(nodes, edges))):
        if found := broken.first():
            raise GraphCreationError(f"{what}: {found.asDict()}")
