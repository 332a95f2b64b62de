"""Messages of many graphs at once are those of one after the other."""

import gzip
import random
import re

import pyarrow as pa
import pytest
from test_files import TEXT

import __spark_entry__
from weftgraph.schema import GraphTransformError
from weftgraph.sources import files, wire, wire_batches
from weftgraph.sources.orders import order_graphs, order_rows

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["bytes_edges", "bytes_nodes", "text_format_nodes"])
def test_lines_are_sorted_once_and_no_graph_is_collected(spark, name):
    """F1, F2, F3."""
    plan = __spark_entry__.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    assert "Join" not in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("wide", [False, True])
def test_order_rows_are_those_of_the_tables(spark, wide):
    """the same graphs, and the same messages."""
    found, (nodes, edges) = order_rows(spark, SMALL, wide), order_graphs(spark, SMALL, wide)
    for part, table in (("nodes", nodes), ("edges", edges.drop("edge_id"))):
        assert rows(found.selectExpr("graph_id", f"inline({part})").where(f"{table.columns[1]} IS NOT NULL")) == rows(table)
    for encoding in ("pb", "pbtxt.gz"):
        one, other = (dict(x.collect()) for x in (files.clustered_to_bytes(found, encoding, True), files.to_bytes(nodes, edges, encoding, as_list=True)))
        assert one == other


def packed(n, seed=0):
    """Graphs with gaps between ids, repeated ids, negative and large numbers, texts of any kind."""
    pick = random.Random(seed)
    texts = ["", "add", "x" * 200, 'a"b\\\n', "é\t\x7f", "  }\n", "val"]
    out = []
    for g in range(n):
        ids = sorted(pick.sample(range(-3, 40) if g % 3 else [*range(9), 2**40], 8) + [5])
        number = lambda: pick.choice([None, 0, 1, 127, 128, 5000, -1, 2**62])
        nodes = [{"node_id": i, "type": pick.choice([None, 0, 1, 2, 3]), "text": pick.choice([*texts, None]), "function": number(), "block": number()} for i in ids]
        edges = [{"edge_id": i, "flow": pick.choice([None, 0, 1, 2, 3]), "position": number(), "source": pick.choice(ids), "target": pick.choice(ids)} for i in range(pick.choice([0, 1, 30]))]
        out.append({"graph_id": g, "nodes": nodes, "edges": edges or None, "functions": None, "modules": None, "features": None})
    return out


def batch_of(graphs):
    whole = {"functions": pa.list_(pa.struct({"name": pa.string()})), "modules": pa.list_(pa.struct({"name": pa.string()})), "features": pa.list_(pa.struct({"key": pa.string()}))}
    lists = {name: pa.array([g[name] for g in graphs], whole.get(name)) for name in graphs[0]}
    return pa.RecordBatch.from_pydict(lists)


@pytest.mark.parametrize("as_list", [False, True])
@pytest.mark.parametrize("encoding", ["pb", "pb.gz", "pbtxt"])
def test_messages_at_once(encoding, as_list):
    """F1, F3."""
    graphs = packed(60)
    found = wire_batches.encoded(wire_batches.packed_rows(batch_of(graphs).slice(3)), encoding, as_list)
    messages = [files.message_of(g) for g in graphs[3:]]
    wanted = [wire.dumps("ProgramGraphList", {"graph": [m]}, "pb") if as_list else wire.dumps("ProgramGraph", m, "pb") for m in messages] if encoding == "pb.gz" else [wire.dumps("ProgramGraphList", {"graph": [m]}, encoding) if as_list else wire.dumps("ProgramGraph", m, encoding) for m in messages]
    assert [gzip.decompress(x) for x in found] == wanted if encoding == "pb.gz" else found == wanted


def test_what_is_not_plain_is_left_to_the_encoder_of_one(spark):
    """features, an end that is not there, a kind without a name."""
    graph = packed(1)[0]
    for change in ({"features": [{"key": "k"}]}, {"edges": [{"flow": 0, "source": 99, "target": 5}]}, {"nodes": []}):
        assert wire_batches.encoded(wire_batches.packed_rows(batch_of([{**graph, **change}])), "pb", False) is None
    odd = {**graph, "edges": [{"flow": 7, "source": 5, "target": 5}]}
    assert wire_batches.encoded(wire_batches.packed_rows(batch_of([odd])), "pbtxt", False) is None
    lost = spark.createDataFrame([(1, [(0, 0, "a"), None], []), (1, None, [(0, 0, 0, 4)])], "graph_id long, nodes array<struct<node_id: long, type: long, text: string>>, edges array<struct<flow: long, position: long, source: long, target: long>>")
    with pytest.raises(Exception, match="there is no target 4") as e:
        files.clustered_to_bytes(lost.coalesce(1)).collect()
    assert GraphTransformError.__name__ in str(e.value)


@pytest.mark.parametrize("most", [1, 800, 10**6])
def test_graphs_across_batches(monkeypatch, most):
    """a null id is a graph of its own; batches may be empty and end anywhere."""
    monkeypatch.setattr(wire_batches, "MOST_HELD", most)
    ids = [None] * 3 + [0] * 40 + [1] + [2**40] * 90 + [-(2**62)] * 5
    whole = pa.RecordBatch.from_pydict({"graph_id": pa.array(ids, pa.int64()), "n": pa.array(range(len(ids)))})
    parts = [whole.slice(i, 7) for i in range(0, len(ids), 7)]
    found = [(batch.slice(a, b - a).column("graph_id").to_pylist(), batch.column("n")[int(a)].as_py()) for batch, begins in wire_batches.whole_graphs(iter([whole.slice(0, 0), *parts])) for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True)]
    assert found == [([None] * 3, 0), ([0] * 40, 3), ([1], 43), ([2**40] * 90, 44), ([-(2**62)] * 5, 134)]


def test_rows_of_messages_of_all_kinds(spark):
    """rows are those of graphs read one by one, and none where a message can't be read."""
    graph = wire.from_text("ProgramGraph", TEXT)
    graphs = [files.message_of(g) for g in packed(40)]
    plain = [wire.dumps("ProgramGraphList", {"graph": [g]}) for g in graphs]
    many = wire.dumps("ProgramGraphList", {"context": {"feature": []}, "graph": [graph, {}, graphs[0], graph]})
    unknown = b"\x7a\x01x\x90\x01\x05" + wire.dumps("ProgramGraph", graph)
    unknown = wire.encode("ProgramGraphList", {"graph": [{}]}) + b"\x12" + wire._varint(len(unknown)) + unknown
    odd = [b"", b"\x12", b"\x12\x02\x0a\x09", b"\x12\x02\x08\x01", many, unknown, plain[0] + plain[1], many[:-1], plain[2] + b"\x12\x03\x12\x01\xff"]
    data = [gzip.compress(x) for x in plain + odd] + [None, b"", b"no gzip", gzip.compress(plain[0]) + gzip.compress(plain[1])]
    table = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(data) if x != b""], "graph_id long, data binary").coalesce(1)
    for part in ("nodes", "edges", "functions", "modules"):
        one = files.unpack(files.from_bytes(table).withColumn("graph_id", files.F.col("path").cast("long")), part)
        assert rows(files.rows_from(table, part)) == rows(one)
        assert one.schema.simpleString() == files.rows_from(table, part).schema.simpleString()
    single = spark.createDataFrame([(7, bytearray(wire.dumps("ProgramGraph", graph, "json")))], "graph_id long, data binary")
    assert [r.text for r in files.rows_from(single, "nodes", encoding="json", message="ProgramGraph").collect()] == ["[external]", "add", "x\né"]


def test_rows_of_texts_of_all_kinds(spark):
    """what is not written as ``to_text`` does is read as a whole."""
    graphs = [files.message_of(g) for g in packed(40)]
    written = [wire.to_text("ProgramGraphList", {"graph": [g]}) for g in graphs] + [wire.to_text("ProgramGraphList", {"graph": graphs[:3]}), wire.to_text("ProgramGraphList", {"graph": [wire.from_text("ProgramGraph", TEXT)] * 2})]
    row = '  node {\n    text: "a"\n  }\n'
    odd = ["", "graph {\n}\n", "graph {" + TEXT + "}", "graph {\n" + row, "graph {\n" + row + "}\n}\n", "graph {\n" + row + "# }\n  }\n}\n", "graph {\n" + row + "  # \n" + row + "}\n", "graph {\n  node {\n    # \"\n  }\n" + row + "}\n"]
    odd += ['graph {\n  node {\n    text: "a" # "\n  }\n}\n', "graph {\n" + row + "}\ngraph {\n}\n", "graph {\n  node {\n    type: NONE\n  }\n" + row + "}\n", "graph {\n  node {\n    no: 1\n  }\n}\n", "graph {\n  node {\n    text: \"é\"\n  }\n" + row + "}\n"]
    table = spark.createDataFrame([*enumerate(written + odd)], "graph_id long, text string").coalesce(1)
    for part in ("nodes", "edges", "functions"):
        one = files.unpack(files.from_string(table).withColumn("graph_id", files.F.col("path").cast("long")), part)
        found = rows(files.rows_from(table, part, data="text", encoding="pbtxt"))
        assert found and found == rows(one)
    assert not files.rows_from(table.selectExpr("graph_id", "CAST(NULL AS STRING) AS text"), "nodes", data="text", encoding="pbtxt").count()


def test_rows_are_read_once_and_forgotten(monkeypatch):
    """a block that repeats is read once, until there are too many."""
    monkeypatch.setattr(wire_batches, "MOST_KNOWN", 10)
    reader = wire_batches.Reader("nodes", pa.schema({"type": pa.int64(), "text": pa.string()}), "ProgramGraphList", "pb", files.rows_of)
    for k in range(3):
        data = [wire.dumps("ProgramGraphList", {"graph": [{"node": [{"text": f"{k} {i % 12}"} for i in range(50)]}]})] * 30
        of, place, found = reader.read(data)
        assert len(reader.known) == 12 and found.column("text").to_pylist() == [f"{k} {i % 12}" for i in range(50)] * 30
        assert place.tolist() == [*range(50)] * 30 and of.tolist() == [i for i in range(30) for _ in range(50)]
