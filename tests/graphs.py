"""Small graphs written as text: ``c:0>1`` is a control edge, ``d:1>5@2`` a data edge at position 2, ``k:`` a call, ``t:`` a type edge."""

FLOWS = {"c": 0, "d": 1, "k": 2, "t": 3}


def build(spark, kinds, edges, texts=(), graph_id=1):
    """``kinds`` has a letter for each node after the root: I, V, C or T."""
    nodes = [(graph_id, 0, 0, "[external]")]
    nodes += [(graph_id, i, "IVCT".index(k), texts[i - 1] if texts else f"n{i}") for i, k in enumerate(kinds, 1)]
    rows = []
    for i, e in enumerate(edges.split()):
        flow, ends = e.split(":")
        ends, _, position = ends.partition("@")
        source, target = ends.split(">")
        rows.append((graph_id, i, FLOWS[flow], int(position or 0), int(source), int(target)))
    return (
        spark.createDataFrame(nodes, "graph_id long, node_id long, type long, text string"),
        spark.createDataFrame(rows, "graph_id long, edge_id long, flow long, position long, source long, target long"),
    )


def roots(spark, *ids, graph_id=1):
    return spark.createDataFrame([(graph_id, i) for i in ids], "graph_id long, root long")


def labels(df):
    out = {}
    for r in df.where("value = 1").collect():
        out.setdefault(r.root, set()).add(r.node_id)
    return out


def counts(df):
    return {r.root: (r.active_node_count, r.step_count) for r in df.collect()}
