import pytest

from weftgraph.operators import analysis, transforms
from weftgraph.schema import GraphCreationError, UnsupportedCompiler
from weftgraph.sources import ir, llvm_text
from weftgraph.sources.llvm_text import build_graph, read_instruction, read_type

# This module and the texts expected of it are a known example of the format.
ADD = """
source_filename = "foo.c"
target triple = "x86_64-apple-macosx10.15.0"

define i32 @A(i32, i32) #0 {
  %3 = alloca i32, align 4
  %4 = alloca i32, align 4
  store i32 %0, i32* %3, align 4
  store i32 %1, i32* %4, align 4
  %5 = load i32, i32* %3, align 4
  %6 = load i32, i32* %4, align 4
  %7 = add nsw i32 %5, %6
  ret i32 %7
}
"""
# An own module: types, loops, a switch, recursion, a declaration.
FIB = """
%struct.node = type { i32, %struct.node* }
declare i32 @puts(i8*)
@.str = private constant [3 x i8] c"a\\0A\\00"
define i32 @fib(i32 %n, %struct.node* %list) {
entry:
  %cmp = icmp slt i32 %n, 2
  br i1 %cmp, label %done, label %more

more:                                             ; preds = %entry
  %sub = sub nsw i32 %n, 1
  %next = getelementptr inbounds %struct.node, %struct.node* %list, i32 0, i32 1
  %l = load %struct.node*, %struct.node** %next, align 8
  %call = call i32 @fib(i32 %sub, %struct.node* %l)
  %p = call i32 @puts(i8* getelementptr inbounds ([3 x i8], [3 x i8]* @.str, i64 0, i64 0))
  switch i32 %call, label %done [
    i32 1, label %more
    i32 7, label %done
  ]

done:
  %r = phi i32 [ %n, %entry ], [ %call, %more ], [ 3, %more ]
  ret i32 %r

dead:
  ret i32 0
}
"""


def test_texts_of_a_simple_function():
    graph = build_graph(ADD)
    assert [n["text"] for n in graph["nodes"]] == "[external] alloca alloca store var * i32 store var load var load var add var var ret var var var val".split()
    assert [n["type"] for n in graph["nodes"]] == [0, 0, 0, 0, 1, 3, 3, 0, 1, 0, 1, 0, 1, 0, 1, 1, 0, 1, 1, 1, 2]
    full = [n["full_text"] for n in graph["nodes"]]
    assert full[1:8] == ["%3 = alloca i32, align 4", "%4 = alloca i32, align 4", "store i32 %0, i32* %3, align 4", "i32* %3", "i32*", "i32", "store i32 %1, i32* %4, align 4"]
    assert full[14:] == ["i32 %5", "i32 %6", "ret i32 %7", "i32 %7", "i32 %0", "i32 %1", "i32 1"]
    assert graph["modules"] == [{"module_id": 0, "name": "foo.c", "features": None}]


def test_control_and_calls():
    graph = build_graph(FIB)
    text = {n["node_id"]: n["full_text"] for n in graph["nodes"]}
    control = {(text[e["source"]].split()[0], text[e["target"]].split(" = ")[0], e["position"]) for e in graph["edges"] if e["flow"] == 0}
    assert {("br", "%r", 0), ("br", "%sub", 1), ("switch", "%r", 0), ("switch", "%sub", 1), ("switch", "%r", 2)} <= control
    calls = [(e["source"], e["target"]) for e in graph["edges"] if e["flow"] == 2]
    puts = next(n["node_id"] for n in graph["nodes"] if n["text"] == "; undefined function")
    site = next(i for i, t in text.items() if t and t.startswith("%p ="))
    assert (0, puts) in calls and (site, puts) in calls and (puts, site) in calls
    assert [n["text"] for n in graph["nodes"] if n["type"] == 3].count("struct") == 1
    assert {v for v in text.values() if v and v.startswith("i32 ") and "%" not in v} >= {"i32 0", "i32 1", "i32 2", "i32 3", "i32 7"}


def test_options():
    assert {n["type"] for n in build_graph(ADD, instructions_only=True)["nodes"]} == {0}
    assert len([e for e in build_graph(FIB, ignore_call_returns=True)["edges"] if e["flow"] == 2]) == 4
    with pytest.raises(GraphCreationError):
        build_graph(FIB + "\ndefine void @x() {\n  ret void\n\ndead:\n  unreachable\n}\n", strict=True)
    build_graph(ADD, strict=True)


@pytest.mark.parametrize(
    ("line", "operands"),
    [
        ("store volatile float 1.0, float* %p, align 4", [("float", "1.0"), ("float*", "%p")]),
        ("%a = sext i32 %x to i64", [("i32", "%x")]),
        ("%a = call i32 (i8*, ...) @printf(i8* %f, i32 %x)", [("i8*", "%f"), ("i32", "%x"), None]),
        ("%a = select i1 %c, i32 %x, i32 4", [("i1", "%c"), ("i32", "%x"), ("i32", "4")]),
        ("%a = insertvalue { i8*, i32 } undef, i8* %x, 0", [("{ i8*, i32 }", "undef"), ("i8*", "%x")]),
        ("%a = fmul fast <4 x float> %x, %y", [("<4 x float>", "%x"), ("<4 x float>", "%y")]),
        ("ret void", []),
    ],
)
def test_operands(line, operands):
    assert read_instruction(line).operands == operands


def test_types():
    assert read_type("i32 (i8*, ...)* %f") == ("i32 (i8*, ...)*", "%f")
    assert read_type("[4 x %struct.a]* @x") == ("[4 x %struct.a]*", "@x")


@pytest.mark.parametrize(("text", "why"), [("foo bar", "expected top-level entity"), ("define i32 @a() {\n", "end of file"), ("define void @a() {\n br label %x\n}", "undefined value")])
def test_errors(text, why):
    with pytest.raises(GraphCreationError, match=why):
        build_graph(text)


def test_tables(spark, tmp_path):
    (tmp_path / "a.ll").write_text(ADD)
    irs = spark.createDataFrame([(1, ADD), (2, FIB), (3, "foo bar"), (4, None)], "ir_id long, text string")
    packed = ir.from_llvm_ir(irs).cache()
    assert {r.graph_id: r.error is None for r in packed.collect()} == {1: True, 2: True, 3: False, 4: True}
    nodes, edges = ir.unpack(packed, "nodes"), ir.unpack(packed, "edges")
    assert nodes.where("graph_id = 1").count() == 21
    assert analysis.expression_sets(nodes, edges).count() >= 0
    assert transforms.cdfg_nodes(nodes).where("graph_id = 1").count() == 9
    assert ir.read_ir(spark, str(tmp_path)).first().text == ADD
    with pytest.raises(UnsupportedCompiler):
        ir.from_llvm_ir(irs, version="4")


def test_repeated_lines_are_read_once_and_parts_left_out(spark):
    llvm_text._instruction.cache_clear()
    for _ in range(3):
        build_graph(FIB)
    found = llvm_text._instruction.cache_info()
    assert found.misses == found.currsize and found.hits >= 2 * found.misses
    irs = spark.createDataFrame([(1, ADD), (2, "no module")], "ir_id long, text string")
    rows = {r.graph_id: r for r in ir.from_llvm_ir(irs, parts=("nodes",)).collect()}
    assert rows[1].edges is None and rows[1].functions is None and rows[2].nodes is None and rows[2].error
    assert [(n.node_id, n.type, n.text) for n in rows[1].nodes] == [(n["node_id"], n["type"], n["text"]) for n in build_graph(ADD)["nodes"]]
