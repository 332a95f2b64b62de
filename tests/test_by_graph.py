"""Graphs stay where their lines were shuffled to, and kernels take bounded parts of a batch."""

import re

import pyarrow as pa
import pytest

import __spark_entry__
from weftgraph import catalog_programs
from weftgraph.operators import analysis, transforms
from weftgraph.plans import kernels
from weftgraph.sources.orders import all_fit, order_graphs

SMALL = "/root/testdata/sf0.001"


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(params=[False, True], ids=["orders", "wide"])
def graphs(spark, request):
    return order_graphs(spark, SMALL, wide=request.param)


def test_lines_are_shuffled_once(spark):
    """by graph, and nothing made of them again."""
    for df in order_graphs(spark, SMALL) + order_graphs(spark, SMALL, wide=True):
        assert [re.sub(r"#\d+L?", "", e) for e in exchanges(df)] == ["graph_id"]


def test_adjacency_texts_shuffle_no_edges(spark):
    """F17."""
    nodes, edges = order_graphs(spark, SMALL)
    assert len(exchanges(analysis.adjacency_text(edges))) == 1


def test_adjacency_texts_of_edges_in_any_order(spark):
    """by edge id where rows come otherwise, ids of any size."""
    edges = [(1, 9, 0, 5, 7), (1, 2, 0, 5, 6), (1, 3, 1, -(2**62), 2**62), (1, 4, 2, 0, 5), (2, 0, 1, 3, 4)]
    for these in (edges, edges[::-1]):
        df = spark.createDataFrame(these, "graph_id long, edge_id long, flow long, source long, target long").coalesce(1)
        found = {r.graph_id: r.text for r in analysis.adjacency_text(df).collect()}
        big = f"data:\n    {-(2**62)}: [{2**62}]\nreverse_data:\n    {2**62}: [{-(2**62)}]\n"
        assert found[1] == "control:\n    5: [6, 7]\nreverse_control:\n    6: [5]\n    7: [5]\n" + big
        assert found[2] == "data:\n    3: [4]\nreverse_data:\n    4: [3]\n"


@pytest.mark.parametrize("name", ["sampled_liveness_instances", "sampled_liveness", "sampled_datadep_instances"])
def test_one_kernel_samples_and_analyses(graphs, name):
    """the rows of the steps one by one."""
    one = getattr(analysis, name)
    found = rows(one(*graphs, fits=True))
    assert found and found == rows(one(*graphs))
    assert found != rows(one(*graphs, seed=5, fits=True)) and rows(one(*graphs, seed=5, fits=True)) == rows(one(*graphs, seed=5))


def test_label_sizes_by_one_kernel(graphs):
    """F19."""
    assert rows(catalog_programs.label_sizes_of(*graphs, True)) == rows(catalog_programs.label_sizes_of(*graphs, False))


def test_graphs_of_more_lines_do_not_fit(spark):
    """F18 to F25: a graph too long for a row goes the other way."""
    assert all_fit(spark, SMALL) and all_fit(spark, SMALL, wide=True)
    assert not all_fit(spark, SMALL, most_lines=2)


def test_only_used_values_have_states(monkeypatch):
    """a chain of 50 definitions of which one is used."""
    seen, close = [], kernels.close
    monkeypatch.setattr(kernels, "close", lambda arcs, roots, *rest: seen.append(roots.states) or close(arcs, roots, *rest))
    n = 50
    ns = [{"node_id": i, "type": 0} for i in range(n + 1)] + [{"node_id": n + i, "type": 1} for i in range(1, n + 1)]
    es = [{"flow": 0, "source": i, "target": i + 1} for i in range(1, n)] + [{"flow": 1, "source": i, "target": n + i} for i in range(1, n + 1)] + [{"flow": 1, "source": n + 1, "target": n}]
    batch = pa.RecordBatch.from_pylist([{"graph_id": 1, "ns": ns, "es": es}])
    found = pa.Table.from_batches(kernels.liveness_kernel(True)(iter([batch]))).to_pylist()
    assert {r["node_id"] for r in found} == set(range(1, n)) and {r["variable"] for r in found} == {n + 1}
    assert max(seen) <= 2 * n + 1


def test_sequences_take_bounded_parts(monkeypatch):
    """what a worker holds does not follow the size of a batch."""
    monkeypatch.setattr(kernels, "MOST_ENTRIES", 40)
    cs = [{"edge_id": i, "source": i, "target": i + 1} for i in range(1, 10)]
    batch = pa.RecordBatch.from_pylist([{"graph_id": g, "cs": cs, "ks": [{"edge_id": 99, "target": 1}]} for g in range(20)])
    out = list(kernels.sequence_kernel(100)(iter([batch])))
    assert max(b.num_rows for b in out) <= 3
    assert pa.Table.from_batches(out).to_pylist() == [{"graph_id": g, "node_ids": list(range(1, 11))} for g in range(20)]


def test_dot_texts_shuffle_no_lines(spark):
    """a cluster's lines are found within their graph."""
    df = __spark_entry__.queries()["dot_clusters"](spark, SMALL)
    assert {re.sub(r"#\d+L?", "", e) for e in exchanges(df)} == {"graph_id"}


def test_dot_clusters_without_nodes_or_names(spark):
    """a function without nodes, nodes without a function's row, a graph with functions only."""
    nodes = spark.createDataFrame([(1, 0, 0, "[external]", 0), (1, 1, 0, 'a"b\\', 7)], "graph_id long, node_id long, type long, text string, function long")
    edges = spark.createDataFrame([(1, 0, 2, 0, 0, 1)], "graph_id long, edge_id long, flow long, position long, source long, target long")
    functions = spark.createDataFrame([(1, 3, "f"), (2, 0, "g")], "graph_id long, function_id long, name string")
    found = {r.graph_id: r.dot for r in transforms.dot_text(nodes, edges, functions=functions).collect()}
    heads = [line.strip() for line in found[1].split("\n") if "subgraph" in line or "label=" in line and "[" not in line]
    assert heads == ["subgraph external {", "subgraph cluster3 {", 'label="f";', "subgraph cluster7 {", 'label="";']
    assert 'n1 [label="a\\"b\\\\"' in found[1] and "subgraph cluster0" in found[2] and "n0 -> n1" in found[1]
