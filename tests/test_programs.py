import hashlib
import io
import json
import sys
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

import weftgraph
from weftgraph.__main__ import main
from weftgraph.functions import features, text
from weftgraph.operators import analysis, builder, query, statistics, transforms
from weftgraph.schema import CONTROL, DATA, GraphCreationError, GraphTransformError, UnsupportedCompiler
from weftgraph.sources import compilers, files, hlo, ir, wire
from weftgraph.sources.llvm_text import build_graph, text_components

MODULE = """
source_filename = "loop.c"
%struct.pair = type { i32, i64 }
define i32 @sum(i32 %n, %struct.pair* %p) !prof !1 {
start:
  %c = icmp slt i32 %n, 2
  br i1 %c, label %stop, label %more, !prof !2

more:
  %m = sub nsw i32 %n, 7
  br label %stop

stop:
  %r = phi i32 [ %n, %start ], [ %m, %more ]
  ret i32 %r
}
!llvm.module.flags = !{!0}
!0 = !{i32 1, !"ProfileSummary", !3}
!1 = !{!"function_entry_count", i64 10}
!2 = !{!"branch_weights", i32 3, i32 7}
!3 = !{!4}
!4 = !{!"TotalCount", i64 100}
"""


def two(spark):
    """A graph with features at every level."""
    b = weftgraph.GraphBuilder(5)
    m = b.module("m", {"size": {"bytes": None, "floats": None, "ints": [1, 2]}})
    f = b.function("f", m, {"time": {"bytes": None, "floats": [0.5], "ints": None}})
    i, j, v, c, t = b.instruction("add", f, 1), b.instruction("ret", f), b.variable("x", f, {"name": {"bytes": [bytearray(b"\xc3\xa9\"")], "floats": None, "ints": None}}), b.constant("4"), b.type("i32")
    b.call(0, i), b.control(i, j, 1), b.data(i, v), b.data(v, j), b.data(c, i, 1), b.type_of(t, v), b.type_of(t, c)
    b.edge(CONTROL, j, i, 0, {"weight": {"bytes": None, "floats": None, "ints": [9]}})
    return b, b.build(spark, strict=True)


def test_builder_checks(spark):
    b, tables = two(spark)
    assert {k: t.count() for k, t in tables.items()} == {"nodes": 6, "edges": 8, "functions": 1, "modules": 1}
    for wrong in (lambda: b.control(1, 3), lambda: b.data(1, 2), lambda: b.call(0, 99), lambda: b.type_of(1, 3), lambda: b.instruction("x", 7), lambda: b.function("g", 3), lambda: b.edge(2, 0, 1, 4)):
        with pytest.raises(GraphCreationError):
            wrong()
    b.constant("unused")
    with pytest.raises(GraphCreationError, match="node without edges"):
        b.build(spark, strict=True)
    b.function("empty", 0)
    with pytest.raises(GraphCreationError, match="function without nodes"):
        b.check()
    b.clear()
    assert len(b.nodes) == 1 and not b.edges


def test_assembled_tables(spark):
    ops = spark.createDataFrame([(1, "a", 0, "add"), (1, "b", 0, "ret")], "graph_id long, key string, type int, text string")
    values = spark.createDataFrame([(1, "x", 1, "var")], ops.schema)
    nodes = builder.assemble_nodes([ops, values])
    assert [(r.node_id, r.text) for r in nodes.orderBy("node_id").collect()] == [(0, "[external]"), (1, "add"), (2, "ret"), (3, "var")]
    links = spark.createDataFrame([(1, 0, 0, "a", "b"), (1, 1, 0, "a", "x"), (1, 2, 0, None, "a"), (1, 0, 0, "x", "b")], "graph_id long, flow int, position int, source_key string, target_key string")
    edges, wrong = builder.assemble_edges(nodes, links)
    assert edges.count() == 4 and [(r.source, r.target) for r in wrong.collect()] == [(3, 2)]


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("compression", ["gz", None])
def test_whole_graphs_come_back(spark, tmp_path, compression):
    _, t = two(spark)
    own = spark.createDataFrame([(5, {"label": {"bytes": None, "floats": None, "ints": [7]}})], f"graph_id long, features map<string, {weftgraph.schema.FEATURE}>")
    assert files.save_graphs(str(tmp_path / "out"), t["nodes"], t["edges"], t["functions"], t["modules"], own, compression) == 1
    packed = files.load_graphs(spark, str(tmp_path / "out"), None, compression).withColumn("graph_id", F.lit(5).cast("long"))
    for part in t:
        assert rows(files.unpack(packed, part)) == rows(t[part])
    assert packed.first().features["label"].ints == [7]
    again = files.from_string(files.to_string(t["nodes"], t["edges"], t["functions"], t["modules"], own)).withColumn("graph_id", F.col("path").cast("long"))
    for part in t:
        assert rows(files.unpack(again, part)) == rows(t[part])
    with pytest.raises(TypeError):
        files.save_graphs(str(tmp_path / "no"), t["nodes"], t["edges"], compression="txt")
    with pytest.raises(TypeError):
        files.load_graphs(spark, str(tmp_path / "out"), compression="txt")


def test_lists_and_names_of_files(spark, tmp_path):
    graph = {"node": [{"type": 0, "text": "[external]"}]}
    blob = spark.createDataFrame([(3, bytearray(wire.dumps("ProgramGraphList", {"graph": [graph] * 4}, "pb.gz")))], "graph_id long, data binary")
    assert [r.idx for r in files.from_bytes(blob, idx_list=[0, 2]).collect()] == [0, 2]
    assert files.from_bytes(blob, idx_list=[9]).first().error
    both = files.concatenated(files.from_bytes(blob), files.from_bytes(blob, idx_list=[1]))
    assert sorted(r.idx for r in both.collect()) == [0, 1, 2, 3, 5]
    for name in ("ShoppingList.pb", "b.ProgramGraph.pb", "c.ProgramGraph.pb"):
        (tmp_path / name).write_bytes(wire.dumps("ProgramGraph", graph))
    found = files.read_graphs(spark, str(tmp_path)).collect()
    assert len(found) == 3 and all(r.error is None and len(r.nodes) == 1 for r in found)
    assert files.read_graphs(spark, str(tmp_path), limit=2).count() == 2 == files.read_graphs(spark, str(tmp_path), limit=2, seed=4).count()
    data = spark.createDataFrame([("x", bytearray(b"1"))], "graph_id string, data binary")
    assert files.write_files(data, str(tmp_path / "o"), ".bin") == 1 and (tmp_path / "o" / "x.bin").read_bytes() == b"1"
    with pytest.raises(Exception, match="FileExistsError|x.bin"):
        files.write_files(data, str(tmp_path / "o"), ".bin", exist_ok=False)


def test_edges_without_nodes_are_no_graph():
    with pytest.raises(GraphTransformError):
        files.message_of({"graph_id": 1, "nodes": [{"node_id": 0, "text": "a"}], "edges": [{"source": 0, "target": 4}], "functions": None, "modules": None, "features": None})


def test_hlo_wire_format(spark):
    shape = {"element_type": 11, "dimensions": [2, 3]}
    instruction = lambda i, name, op, operands=(), **more: {"id": i, "name": name, "opcode": op, "shape": shape, "operand_ids": list(operands), **more}
    module = {"name": "m", "entry_computation_id": 4, "computations": [{"id": 4, "name": "main", "instructions": [instruction(1, "p", "parameter"), instruction(2, "c", "constant", literal={"shape": {"element_type": 4, "dimensions": []}}), instruction(3, "a", "add", [1, 2], literal={"shape": shape})]}]}
    good = bytearray(wire.dumps("HloProto", {"hlo_module": module}))
    df = spark.createDataFrame([(1, good), (2, bytearray(b"")), (3, bytearray(b"\x0a\xff")), (4, None)], "ir_id long, data binary")
    found = {r.graph_id: r for r in hlo.from_hlo_proto(df).collect()}
    assert "Failed to locate entry computation" in found[2].error and found[3].error and found[4].error
    assert [n.text for n in found[1].nodes] == ["[external]", "<entry>", "<param>", "F32 2x3", "c", "F32 2x3", "add", "F32 2x3", "S32"]
    assert [f.name for f in found[1].functions] == ["main"] and found[1].error is None


def test_profiles_and_text_parts(spark):
    graph = build_graph(MODULE)
    assert [n["features"] for n in graph["nodes"] if n["features"]] == [{"llvm_profile_total_weight": 10, "llvm_profile_true_weight": 3, "llvm_profile_false_weight": 7}]
    assert graph["functions"][0]["features"] == {"llvm_profile_entry_count": 10} and graph["modules"][0]["features"] == {"llvm_profile_total_count": 100}
    packed = ir.from_llvm_ir(spark.createDataFrame([(1, MODULE)], "ir_id long, text string"))
    assert ir.unpack(packed, "functions").first().features["llvm_profile_entry_count"].ints == [10]
    assert text_components("%5 = load %s*, %s** %4", "%s*") == {"text": "%5 = load %s*, %s** %4", "lhs": "struct* %5", "rhs": "load %s*, %s** %4", "lhs_identifier": "%5", "lhs_type": "struct*", "opcode_name": "load"}
    assert text_components("ret void")["lhs"] == ""


def test_dot_and_node_link_of_whole_graphs(spark):
    _, t = two(spark)
    dot = transforms.dot_text(t["nodes"], t["edges"], functions=t["functions"]).first().dot
    inside = dot[dot.index("subgraph cluster0") :].split("  }")[0]
    assert 'label="f"' in inside and all(f" n{i} " in inside for i in (1, 2, 3)) and " n4 " not in inside and "taillabel=1" in dot
    named = transforms.dot_text(t["nodes"], t["edges"], "feature", "name", t["functions"]).first().dot
    assert 'é\\"' in named and '"add"' not in named
    with pytest.raises(ValueError):
        transforms.dot_lines(t["nodes"], t["edges"], "colour")
    own = spark.createDataFrame([(5, {"k": {"bytes": None, "floats": None, "ints": []}})], f"graph_id long, features map<string, {weftgraph.schema.FEATURE}>")
    found = json.loads(transforms.node_link_json(t["nodes"], t["edges"], t["functions"], t["modules"], own).first().json)
    assert found["graph"] == {"function": [{"name": "f", "module": 0, "features": {"time": [0.5]}}], "module": [{"name": "m", "features": {"size": [1, 2]}}], "features": {"k": []}}
    assert found["nodes"][3]["features"] == {"name": ['é"']} and found["links"][7]["features"] == {"weight": [9]} and found["links"][1]["position"] == 1
    parts = transforms.cdfg(t["nodes"], t["edges"], t["functions"])
    kept = parts["edges"].where("features IS NOT NULL").collect()
    assert len(kept) == 1 and kept[0].features["weight"].ints == [9] and parts["functions"].count() == 1


def test_inst2vec(spark):
    packed = ir.from_llvm_ir(spark.createDataFrame([(1, MODULE)], "ir_id long, text string"))
    words = spark.createDataFrame([("!UNK", 0), ("!IDENTIFIER", 1), ("!IMMEDIATE", 2), ("<%ID> = sub nsw i32 <%ID>, <INT>", 3)], "text string, id int")
    done, graphs = transforms.annotate_inst2vec(ir.unpack(packed, "nodes"), words)
    found = {r.full_text: r.features for r in done.collect()}
    assert found["%m = sub nsw i32 %n, 7"]["inst2vec_embedding"].ints == [3] and found["i32 %n"]["inst2vec_embedding"].ints == [1] and found["i32 7"]["inst2vec_embedding"].ints == [2]
    branch = next(v for k, v in found.items() if k and k.startswith("br i1"))
    assert branch["inst2vec_preprocessed"].bytes == [b"br i1 <%ID>, label <LABEL>, label <LABEL>"] and branch["llvm_profile_total_weight"].ints == [10]
    assert graphs.first().features["inst2vec_annotated"].ints == [1]
    tables = statistics.frequency_tables(done)
    assert set(tables) == {"text", "instruction", "inst2vec_preprocessed", "inst2vec"} and tables["inst2vec"].where("text = 3").first()["count"] == 1


def test_sinks_of_tables(spark, tmp_path):
    table = spark.createDataFrame([("a b", 2, "train"), ("c", 1, "val")], "text string, n int, split string")
    statistics.write_tsv(table, str(tmp_path / "t"))
    assert "text\tn\tsplit" in "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    statistics.write_csv(table, str(tmp_path / "c"))
    statistics.write_splits(table, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").glob("split=*")) == ["split=train", "split=val"]


def test_compilers_that_fail(spark):
    df = spark.createDataFrame([(1, ["-x", "nothing.c"])], "ir_id long, args array<string>")
    assert compilers.from_clang(df, compiler="no-such-compiler").first().error
    with pytest.raises(UnsupportedCompiler):
        compilers.from_clang(df, version="3")
    echoed = compilers.run_messages(spark.createDataFrame([(1, bytearray(b"ab"))], "graph_id long, data binary"), ["cat"]).first()
    assert bytes(echoed.data) == b"ab" and echoed.error is None
    assert compilers.run_messages(spark.createDataFrame([(1, bytearray(b"ab"))], "graph_id long, data binary"), ["sleep", "5"], timeout=0.1).first().error.startswith("no result")


def test_ir_by_suffix(spark, tmp_path):
    (tmp_path / "a.ll").write_text("x")
    (tmp_path / "b.Ir.pb").write_bytes(wire.dumps("Ir", {"text": "y"}))
    (tmp_path / "c.IrList.pb").write_bytes(wire.dumps("IrList", {"ir": [{"text": "p"}, {"text": "q"}]}))
    (tmp_path / "d.Ir.pb").write_bytes(b"\x0a\xff")
    assert sorted((r.text or "", r.idx, r.error is None) for r in ir.read_any(spark, str(tmp_path)).collect()) == [("", 0, False), ("p", 0, True), ("q", 1, True), ("x", 0, True), ("y", 0, True)]
    assert [r.text for r in ir.read_any(spark, str(tmp_path), "c.*", 1).collect()] == ["q"]
    lists = spark.createDataFrame([(1, ["u", "v"])], "ir_id long, irs array<string>")
    assert [(r.idx, r.text) for r in ir.unpack_lists(lists).collect()] == [(0, "u"), (1, "v")]


def test_messages_tables_and_strict_roots(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(wire.dumps("NodeIndexList", {"node": [4, 5]}))), ("b", bytearray(b"\x0a\xff"))], "path string, content binary")
    found = {r.path: r for r in query.messages(df, "NodeIndexList").collect()}
    assert json.loads(found["a"].json) == {"node": [4, 5]} and found["b"].error
    with pytest.raises(ValueError):
        query.messages(df, "Nothing")
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert compilers.csv_scan(spark, str(tmp_path / "t.csv"), hashlib.sha256(b"a,b\n1,x\n").hexdigest()).first().b == "x"
    with pytest.raises(ValueError, match="sha256"):
        compilers.csv_scan(spark, str(tmp_path / "t.csv"), "0" * 64)
    with pytest.raises(GraphCreationError, match="^3:1: error: expected instruction opcode"):
        build_graph("define void @f() {\n  ret void\n  123\n}")
    _, t = two(spark)
    with pytest.raises(ValueError, match="no node that may be a root"):
        analysis.run("subexpressions", t["nodes"], t["edges"], strict=True)


def test_own_analysis(spark):
    class Ends(analysis.Analysis):
        name = "ends"

        def candidates(self, nodes, edges):
            return analysis.eligible(nodes, 0)

        def labels(self, nodes, edges, roots):
            return analysis.labelled(nodes, roots, roots.withColumn("node_id", F.col("root")))

        def instances(self, nodes, edges, roots):
            return roots.selectExpr("*", "0L AS step_count", "1L AS active_node_count")

    _, t = two(spark)
    analysis.register(Ends())
    try:
        assert analysis.run("ends", t["nodes"], t["edges"])[0].where("value = 1").count() == 1
        with pytest.raises(ValueError):
            analysis.register(Ends())
    finally:
        del analysis.ANALYSES["ends"]
    assert analysis.expression_sets_text(t["nodes"], t["edges"]).count() == 0
    assert "data:\n    1: [3]\n" in analysis.adjacency_text(t["edges"]).first().text


def test_messages():
    value = wire.loads("Repo", wire.dumps("Repo", {"url": "u" * 50}))
    assert wire.check_set("Repo", value, "url") and "..." in wire.pretty_json("Repo", value, 10)
    for wrong in (lambda: wire.check_set("Repo", value, "sha1"), lambda: wire.check_rule("Repo", value, "url", lambda x: len(x) < 9)):
        with pytest.raises(wire.MissingField):
            wrong()
    assert wire.is_readable("Repo", b"") and not wire.is_readable("Repo", b"\x0a\xff")


def test_scales_and_deltas(spark):
    df = spark.range(1).select(
        text.decimal_scale(F.lit(576012), "bps").alias("d"),
        text.binary_scale(F.lit(576012)).alias("b"),
        text.decimal_scale(F.lit(0.0), "x").alias("z"),
        text.time_delta(F.lit(86400_000_000 + 61_500_000)).alias("t"),
        text.time_delta(F.lit(0)).alias("none"),
        text.unix_timestamp_text(F.lit(1384686507.72), "Europe/Dublin").alias("u"),
        text.plural_word(F.lit(2), "box").alias("p"),
        text.sha1(F.lit("abc")).alias("s"),
    )
    r = df.first()
    assert (r.d.value, r.d.unit, r.b.value, r.b.unit, r.z.value, r.z.unit) == (576.012, "kbps", 562.51171875, "KiB", 0, "x")
    assert (r.t, r.none, r.u, r.p) == ("1d 1m 1.5s", "0s", "2013-11-17 11:08:27.720000 Europe/Dublin", "boxes") and r.s.startswith("a9993e36")
    assert features is not None


def test_command_line(spark, tmp_path, capsysbinary, monkeypatch):
    (tmp_path / "a.ll").write_text(MODULE)
    assert main(["analyze", str(tmp_path), "reachability", "--out", str(tmp_path / "labels")]) == 0
    assert spark.read.parquet(str(tmp_path / "labels")).where("value = 1").count() > 0
    assert main(["llvm2graph", str(tmp_path), "--stdout_fmt", "pb"]) == 0
    data = capsysbinary.readouterr().out
    assert wire.loads("ProgramGraph", data)["function"][0]["name"] == "sum"

    class Input:
        buffer = io.BytesIO(data)

    monkeypatch.setattr(sys, "stdin", Input)
    assert main(["graph2json", "-", "--stdin_fmt", "pb", "--pretty_print"]) == 0
    assert json.loads(capsysbinary.readouterr().out)["graph"]["module"][0]["name"] == "loop.c"
    for tool in ("graph2dot", "graph2seq", "graph2cdfg"):
        assert main([tool, str(tmp_path)]) == 0 and capsysbinary.readouterr().out
    (tmp_path / "v.tsv").write_text("!UNK\t0\n!IDENTIFIER\t1\n!IMMEDIATE\t2\n")
    assert main(["inst2vec", str(tmp_path), "--vocabulary", str(tmp_path / "v.tsv")]) == 0 and b"inst2vec_embedding" in capsysbinary.readouterr().out
    assert main(["pbq", str(tmp_path), "node.text"]) == 0 and main(["pbq", str(tmp_path), "nothing"]) == 4
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.ll").write_text("foo bar")
    assert main(["llvm2graph", str(tmp_path / "bad")]) == 2
    assert DATA == 1
