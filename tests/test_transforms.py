import json

import pytest
from graphs import build

from weftgraph.operators import statistics, transforms, validation
from weftgraph.schema import GraphCreationError


def test_cdfg(spark):
    n, e = build(spark, "VCIIIII", "c:0>3 c:3>4 c:3>5 c:3>6 c:3>7 d:2>6 d:3>1 d:6>1 d:1>5 d:1>7")
    assert {r.node_id: r.new_id for r in transforms.cdfg_map(n).collect()} == {0: 0, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5}
    found = transforms.cdfg_edges(n, e).collect()
    assert len(found) == 9 and {(r.source, r.target) for r in found if r.flow == 1} == {(1, 3), (1, 5), (4, 3), (4, 5)}
    assert transforms.cdfg_nodes(n).count() == 6


@pytest.mark.parametrize(("kinds", "edges", "expected"), [("I", "k:0>1", [1]), ("II", "k:0>1 c:1>2 c:2>1", [1, 2])])
def test_sequence(spark, kinds, edges, expected):
    _, e = build(spark, kinds, edges)
    assert transforms.instruction_sequence(e).first().node_ids == expected


def test_sequence_stops(spark):
    _, e = build(spark, "III", "k:0>1 c:1>2 c:2>3")
    assert transforms.instruction_sequence(e, most_nodes=2).first().node_ids == [1, 2]


def test_node_link_json(spark):
    n, e = build(spark, "I", "c:0>1")
    found = json.loads(transforms.node_link_json(n, e).first().json)
    assert found["directed"] and found["multigraph"] and len(found["nodes"]) == 2
    assert found["links"] == [{"flow": 0, "position": 0, "source": 0, "target": 1, "key": 0}]
    assert json.loads(transforms.node_link_json(n, e.limit(0)).first().json)["links"] == []


def test_dot(spark):
    n, e = build(spark, "IV", "c:0>1@2 d:1>2", ["x" * 40, 'a"b'])
    text = transforms.dot_text(n, e).first().dot
    assert text.startswith("digraph main {") and "x" * 29 + "..." in text and 'a\\"b' in text and "taillabel=2" in text
    assert "xxx" not in transforms.dot_text(n, e, "none").first().dot


def test_graph_tuple(spark):
    a, ea = build(spark, "I", "c:0>1", graph_id=1)
    b, eb = build(spark, "II", "c:0>1 c:1>2", graph_id=2)
    n, e = a.union(b), ea.union(eb)
    assert sorted((r.graph_id, r.node_size, r.edge_size, r.node_offset) for r in transforms.tuple_offsets(n, e).collect()) == [(1, 2, 1, 0), (2, 3, 2, 2)]
    assert sorted((r.source, r.target) for r in transforms.tuple_adjacency(n, e).collect()) == [(0, 1), (2, 3), (3, 4)]


def test_batches_keep_order(spark):
    parts = [build(spark, "I" * k, " ".join(f"c:{i}>{i + 1}@{i}" for i in range(k)), graph_id=g) for g, k in ((1, 1), (2, 2), (3, 9), (4, 1), (5, 1))]
    n, e = parts[0]
    for a, b in parts[1:]:
        n, e = n.union(a), e.union(b)
    assert sorted((r.graph_id, r.batch, r.node_offset) for r in transforms.tuple_batches(n, e, 6).collect()) == [(1, 0, 0), (2, 0, 2), (3, 1, 0), (4, 2, 0), (5, 2, 2)]
    got = {r.batch: r for r in transforms.tuple_arrays(n, e, 6).collect()}
    assert (got[0].sources, got[0].targets, got[0].positions) == ([0, 2, 3], [1, 3, 4], [0, 0, 1]) and got[1].sources == list(range(9))


def test_vocabulary_ids(spark):
    n, _ = build(spark, "IIVCT", "", ["add", "odd", "v", "c", "t"])
    vocabulary = spark.createDataFrame([("!UNK", 0), ("!IDENTIFIER", 1), ("!IMMEDIATE", 2), ("add", 3)], "text string, id int")
    assert [r.token_id for r in transforms.encode_vocabulary(n, vocabulary).orderBy("node_id").collect()] == [3, 0, 1, 2, 2]


def test_ids_without_a_word_for_the_unknown(spark):
    n, _ = build(spark, "IIV", "", ["add", "odd", "v"])
    vocabulary = spark.createDataFrame([("add", 3)], "text string, id int")
    found, _ = transforms.annotate_inst2vec(n, vocabulary)
    ids = [r.features["inst2vec_embedding"].ints for r in found.orderBy("node_id").collect()]
    assert ids == [[None], [3], [None], [None]]
    assert [r.token_id for r in transforms.encode_vocabulary(n, vocabulary).orderBy("node_id").collect()] == [3, None, None]


def test_violations(spark):
    n, e = build(spark, "IVCT", "c:0>1 c:1>2 d:2>1 d:4>1 k:0>1@1 t:4>2 t:2>3 c:1>9")
    assert {r.edge_id for r in validation.edge_violations(n, e).collect()} == {1, 3, 4, 6, 7}
    assert {r.node_id for r in validation.unconnected_nodes(n, e.where("flow = 0")).collect()} == {3, 4}


def test_strict_order(spark):
    n, e = build(spark, "I", "c:0>1")
    n = n.selectExpr("*", "0L as function")
    functions = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "graph_id long, function_id long, module_id long")
    modules = spark.createDataFrame([(1, 0), (1, 5)], "graph_id long, module_id long")
    with pytest.raises(GraphCreationError, match="module"):
        validation.check_strict(n, e, functions, modules)
    with pytest.raises(GraphCreationError, match="function"):
        validation.check_strict(n, e, functions, modules.where("module_id = 0"))
    validation.check_strict(n, e, functions.where("function_id = 0"), modules.where("module_id = 0"))


def test_vocabulary_keeps_ties(spark):
    df = spark.createDataFrame([(x,) for x in "aabbcd"], "text string")
    assert [(r.text, r["count"], r.cumulative_frequency) for r in statistics.vocabulary(df).orderBy("cumulative_frequency").collect()] == [("a", 2, 0.333333), ("b", 2, 0.666667), ("c", 1, 0.833333), ("d", 1, 1.0)]


def test_stratified_split(spark):
    df = spark.createDataFrame([(s, s % 2) for s in range(20) for _ in range(3)], "source long, label long")
    rows = statistics.stratified_split(df, "source", "label").collect()
    assert len(rows) == 20
    for label in (0, 1):
        assert sorted(r.split for r in rows if r.label == label) == sorted(["train"] * 6 + ["val"] * 2 + ["test"] * 2)
