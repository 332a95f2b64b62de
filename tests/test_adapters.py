import pytest
from graphs import build

from weftgraph.operators import adapters


def test_dicts_and_coordinates(spark):
    n, e = build(spark, "IV", "c:0>1 d:2>1@1 c:1>0@2")
    (graph_id, found), = adapters.to_dicts(n, e)
    assert graph_id == 1 and len(found["nodes"]) == 3
    got = {r.flow: (r.sources, r.targets, r.positions) for r in adapters.coordinates(e).collect()}
    assert got == {0: ([0, 1], [1, 0], [0, 2]), 1: ([2], [1], [1])}


@pytest.mark.parametrize("convert", [adapters.to_networkx, adapters.to_dgl])
def test_libraries_are_asked_for_late(spark, convert):
    n, e = build(spark, "I", "c:0>1")
    try:
        assert len(list(convert(n, e))) == 1
    except ModuleNotFoundError as missing:
        assert missing.name in ("networkx", "dgl")


def test_structs_and_embeddings(spark):
    texts = spark.createDataFrame([(1, "load %s, %s.a"), (2, "x")], "graph_id long, text string")
    structs = spark.createDataFrame([(1, "%s", "{ i32 }"), (1, "%s.a", "{ i8 }")], "graph_id long, name string, body string")
    assert {r.graph_id: r.text for r in adapters.inline_structs(texts, structs).collect()} == {1: "load { i32 }, { i8 }", 2: "x"}
    encoded = spark.createDataFrame([(1, 0, 7)], "graph_id long, node_id long, token_id long")
    table = spark.createDataFrame([(7, [0.5])], "id int, embedding array<double>")
    row = adapters.embed(encoded, table, selector=True).first()
    assert row.embedding == [0.5] and row.selector == [1, 0]
