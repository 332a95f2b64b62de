"""Graphs for in-memory libraries, which are imported only when asked for; and embedding tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import transforms
from weftgraph.schema import FLOWS


def to_dicts(nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None, modules: DataFrame | None = None, graphs: DataFrame | None = None) -> Iterator[tuple[int, dict]]:
    """(graph_id, node-link dict) of each graph, read partition by partition."""
    for row in transforms.node_link_json(nodes, edges, functions, modules, graphs).toLocalIterator():
        yield row.graph_id, json.loads(row.json)


def to_networkx(nodes: DataFrame, edges: DataFrame) -> Iterator[tuple[int, Any]]:
    """A directed multigraph of each graph; parallel edges have keys of their own."""
    import networkx

    for graph_id, found in to_dicts(nodes, edges):
        graph = networkx.MultiDiGraph()
        graph.add_nodes_from((n.pop("id"), n) for n in found["nodes"])
        for e in found["links"]:
            graph.add_edge(e["source"], e["target"], flow=e["flow"], position=e["position"])
        yield graph_id, graph


def coordinates(edges: DataFrame) -> DataFrame:
    """``graph_id, flow, sources, targets, positions``: arrays of the edges of each flow, in edge order."""
    rows = edges.groupBy("graph_id", "flow").agg(F.sort_array(F.collect_list(F.struct("edge_id", "source", "target", "position"))).alias("r"))
    fields = [F.col("r")[name].alias(f"{name}s") for name in ("source", "target", "position")]
    return rows.select("graph_id", "flow", *fields)


def to_dgl(nodes: DataFrame, edges: DataFrame) -> Iterator[tuple[int, Any]]:
    """A heterogeneous graph of each graph, with an edge type for each flow."""
    import dgl

    sizes = nodes.groupBy("graph_id").count()
    flows = coordinates(edges).groupBy("graph_id").agg(F.collect_list(F.struct("flow", "sources", "targets")).alias("r"))
    for row in sizes.join(flows, "graph_id", "left").toLocalIterator():
        data = {("node", FLOWS[x.flow].lower(), "node"): (x.sources, x.targets) for x in row.r or ()}
        yield row.graph_id, dgl.heterograph(data, num_nodes_dict={"node": row["count"]})


def inline_structs(texts: DataFrame, structs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the names of a module's structs in its instruction texts by their bodies.

    ``structs`` has graph_id, name and body; longer names go first.
    """
    entries = structs.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(F.length("name").alias("n"), "name", "body")), asc=False).alias("entries"))
    joined = texts.join(entries, "graph_id", "left")
    inlined = F.aggregate("entries", F.col(text), lambda t, e: F.replace(t, e["name"], e["body"]))
    return joined.withColumn(text, F.coalesce(inlined, F.col(text))).drop("entries")


def embed(encoded: DataFrame, embeddings: DataFrame, selector: bool = False) -> DataFrame:
    """Add ``embedding`` of each ``token_id``; with ``selector`` also the one-hot of other nodes and the root (``is_root``)."""
    found = encoded.join(embeddings.select(F.col("id").cast("long").alias("token_id"), "embedding"), "token_id", "left")
    if not selector:
        return found
    root = F.coalesce(F.col("is_root").cast("int"), F.lit(0)) if "is_root" in encoded.columns else F.lit(0)
    return found.withColumn("selector", F.array((1 - root).cast("double"), root.cast("double")))
