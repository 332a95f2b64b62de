import functools

import pyarrow as pa
import pytest
from graphs import build
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import statistics
from weftgraph.sources import files, wire

TEXT = """
# a graph
node { type: INSTRUCTION text: "[external]" }
node { text: "add" function: 0 }
node {
  type: VARIABLE
  text: "x\\n\\303\\251"
  features { feature { key: "dtype" value: { bytes_list { value: "int32" value: "b" } } } feature { key: "f" value { float_list { value: [3.5, 1.25] } } } }
}
edge { flow: DATA source: 2 target: 1 position: 3 }
edge { flow: CALL target: 1 }
function { name: "Add" module: 0 features { feature { key: "t" value { int64_list { value: -7 } } } } }
module { name: "main" }
"""


def test_text_format():
    graph = wire.from_text("ProgramGraph", TEXT)
    assert [n["text"] for n in graph["node"]] == ["[external]", "add", "x\né"]
    assert graph["edge"][0] == {"flow": 1, "position": 3, "source": 2, "target": 1, "features": None}
    assert wire.from_text("ProgramGraph", wire.to_text("ProgramGraph", graph)) == graph
    with pytest.raises(ValueError):
        wire.from_text("ProgramGraph", "nothing: 1")
    with pytest.raises(ValueError):
        wire.from_text("ProgramGraph", "node {")


@pytest.mark.parametrize("encoding", ["pb", "pb.gz", "pbtxt", "pbtxt.gz", "json", "json.gz"])
def test_round_trips(encoding):
    graph = wire.from_text("ProgramGraph", TEXT)
    assert wire.loads("ProgramGraph", wire.dumps("ProgramGraph", graph, encoding), encoding) == graph
    whole = {"context": None, "graph": [graph, graph]}
    assert wire.loads("ProgramGraphList", wire.dumps("ProgramGraphList", whole, encoding), encoding) == whole


def test_bytes_are_protobuf():
    assert wire.encode("Edge", {"flow": 1, "position": 300, "source": 0, "target": -1}) == b"\x08\x01\x10\xac\x02\x20" + b"\xff" * 9 + b"\x01"
    assert wire.decode("Edge", b"\x08\x01\x7a\x01x\x10\x05")["position"] == 5  # an unknown field is skipped
    with pytest.raises(ValueError):
        wire.decode("Node", b"\x12\x09x")
    with pytest.raises(TypeError):
        wire.dumps("Edge", {}, "xml")


def test_files(spark, tmp_path):
    graph = wire.from_text("ProgramGraph", TEXT)
    (tmp_path / "a.ProgramGraph.pb").write_bytes(wire.dumps("ProgramGraph", graph))
    (tmp_path / "b.ProgramGraph.pbtxt.gz").write_bytes(wire.dumps("ProgramGraph", graph, "pbtxt.gz"))
    (tmp_path / "c.ProgramGraphList.pb").write_bytes(wire.dumps("ProgramGraphList", {"graph": [graph, {"node": [{"text": "only"}]}, graph]}))
    (tmp_path / "d.ProgramGraph.pb").write_bytes(b"\x0a\xff")
    found = files.read_graphs(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[-1][0], r.idx, r.error is None) for r in found) == [("a", 0, True), ("b", 0, True), ("c", 0, True), ("c", 1, True), ("c", 2, True), ("d", 0, False)]
    picked = files.read_graphs(spark, str(tmp_path), "c.*", [2, 1])
    assert [(r.idx, len(r.nodes)) for r in picked.collect()] == [(2, 3), (1, 1)]
    assert files.read_graphs(spark, str(tmp_path), "c.*", []).count() == 0
    first = next(r for r in found if r.path.endswith("a.ProgramGraph.pb"))
    assert first.nodes[2].features["dtype"].bytes == [bytearray(b"int32"), bytearray(b"b")] and first.functions[0].features["t"].ints == [-7]


def test_written_bytes(spark):
    n, e = build(spark, "IV", "c:0>1 d:2>1@1")
    for encoding in ("pb", "pb.gz", "json"):
        data = files.to_bytes(n, e, encoding).first().data
        graph = wire.loads("ProgramGraph", bytes(data), encoding)
        assert [x["text"] for x in graph["node"]] == ["[external]", "n1", "n2"] and graph["edge"][1]["position"] == 1
    with pytest.raises(TypeError):
        files.to_bytes(n, e, "txt.bz2")


def test_saved_graphs_take_the_place_of_others(spark, tmp_path):
    place = str(tmp_path / "graphs")
    first = [build(spark, "I", "c:0>1", graph_id=g) for g in range(1, 9)]
    second = [build(spark, "IV", "c:0>1 d:2>1", graph_id=g) for g in (1, 2)]
    whole = lambda parts: (functools.reduce(DataFrame.union, (n for n, _ in parts)), functools.reduce(DataFrame.union, (e for _, e in parts)))
    assert files.save_graphs(place, *whole(first)) == 8 and files.load_graphs(spark, place).count() == 8
    assert files.save_graphs(place, *whole(second)) == 2
    assert [len(r.nodes) for r in files.load_graphs(spark, place).collect()] == [3, 3]
    with pytest.raises(FileExistsError):
        files.save_graphs(place, *whole(second), exist_ok=False)
    assert files.load_graphs(spark, place).count() == 2 and [x.name for x in tmp_path.iterdir()] == ["graphs"]


def test_files_of_other_attempts_are_not_published(tmp_path):
    staging, place = tmp_path / "s", tmp_path / "p"
    for folder, names in ((staging, ("part-0-7", "part-0-9")), (place, ("old",))):
        folder.mkdir()
        for name in names:
            (folder / name).write_bytes(b"x")
    files._publish(str(staging), str(place), {"part-0-9"})
    assert [x.name for x in place.iterdir()] == ["part-0-9"] and not staging.exists()


def test_stems(spark):
    graphs = spark.createDataFrame([(p,) for p in ("g/a.1.ProgramGraph.pb", "g/a.2.ProgramGraph.pb", "x/b.ProgramGraphList.pb.gz", "x/.pb")], "path string")
    irs = spark.createDataFrame([("i/a.1.ll", "one"), ("i/a.2.Ir.pb", "two"), ("i/b.ll", "b"), ("i/a.ll", "none")], "path string, text string")
    assert {r.path: r.ir for r in files.joined_by_stem(graphs, irs).collect()} == {"g/a.1.ProgramGraph.pb": "one", "g/a.2.ProgramGraph.pb": "two", "x/b.ProgramGraphList.pb.gz": "b", "x/.pb": None}


def test_files_are_dealt_by_size(spark, tmp_path):
    sizes = [40_000, 39_000, 20_000] + [3_000] * 60 + [int(900 / (i + 1)) for i in range(700)]
    for i, n in enumerate(sizes):
        (tmp_path / f"f{i:04d}.bin").write_bytes(b"x" * n)
    listing = files.list_files(spark, str(tmp_path))
    for largest in (64, 2):
        files.LARGEST = largest
        loads = {r.task: r.bytes for r in files.dealt(listing, 6).groupBy("task").agg(F.sum("length").alias("bytes")).collect()}
        assert sum(loads.values()) == sum(sizes) and max(loads.values()) <= 1.3 * sum(sizes) / 6
    found = files.read_balanced(listing, 6).select(F.octet_length("content").alias("n"), F.spark_partition_id().alias("p"))
    assert sorted(r.n for r in found.collect()) == sorted(sizes) and found.select("p").distinct().count() == 6
    some = [r.path for r in files.list_files(spark, str(tmp_path), "*.bin", 5, 3).collect()]
    assert len(some) == 5 and some == [r.path for r in files.list_files(spark, str(tmp_path), "*.bin", 5, 3).collect()]
    assert [r.path[-9:] for r in files.list_files(spark, str(tmp_path), limit=1).collect()] == ["f0000.bin"]


def test_ordered_sink(spark, tmp_path):
    texts = ["a\tb", "line\nend", "back\\slash", "\\t", "  spaces ", '"quoted"', "\r"]
    rows = [(x, i % 3) for i, x in enumerate(texts)] + [(f"t{i}", i) for i in range(500)]
    table = spark.createDataFrame(rows, "text string, count long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are one part
    try:
        statistics.write_vocabulary(table, str(tmp_path / "v"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "v").glob("part-*"))
    assert len(parts) > 1
    lines = [line for p in parts for line in p.read_text().split("\n")[1:] if line]
    assert [int(line.split("\t")[1]) for line in lines] == sorted((c for _, c in rows), reverse=True) and all(line.count("\t") == 1 for line in lines)
    assert sorted(map(tuple, statistics.read_tsv(spark, str(tmp_path / "v"), "text string, count long").collect())) == sorted(rows)


def test_lists_of_structs_field_by_field_and_rows_encoded_once():
    rows = [[{"node_id": 0, "type": None, "text": "a"}, {"node_id": 1, "type": 2, "text": None}], None, [], [{"node_id": 2, "type": 0, "text": "b"}]]
    column = pa.array(rows)
    assert files._rows(column) == rows and files._rows(column.slice(1)) == rows[1:]
    graph = {"node": [{"type": 0, "text": "again"}] * 5, "edge": [{"flow": 1, "source": 0, "target": 3}] * 5}
    wire._row_encoded.cache_clear()
    data = wire.encode("ProgramGraph", graph)
    assert wire._row_encoded.cache_info().misses == 2
    found = wire.decode("ProgramGraph", data)
    found["node"][0]["text"] = "changed"
    assert [n["text"] for n in found["node"]] == ["changed"] + ["again"] * 4
    assert wire.decode("ProgramGraph", data)["node"][0]["text"] == "again"
