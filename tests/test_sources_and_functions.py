import pytest
from pyspark.sql import functions as F
from test_llvm import ADD

from weftgraph.functions import features, text
from weftgraph.operators import query
from weftgraph.schema import UnsupportedCompiler
from weftgraph.sources import compilers, hlo, ir
from weftgraph.streaming.analyse import analyse_stream


def instruction(i, name, opcode, operands=(), **more):
    return {"id": i, "name": name, "opcode": opcode, "shape": {"type": "F32", "dimensions": [2, 3]}, "operand_ids": list(operands), "control_predecessor_ids": [], "called_computation_ids": [], "literal": None, **more}


def test_hlo(spark):
    inner = {"id": 2, "name": "inner", "instructions": [instruction(10, "p", "parameter"), instruction(11, "n", "negate", [10])]}
    main = {"id": 1, "name": "main", "instructions": [instruction(1, "x", "parameter"), instruction(2, "c.1", "constant", literal="5"), instruction(3, "s", "add", [1, 2]), instruction(4, "m", "map", [3], called_computation_ids=[2], control_predecessor_ids=[1])]}
    good = {"name": "mod", "entry_computation_id": 1, "computations": [main, inner]}
    df = spark.createDataFrame([(1, good), (2, {"name": "none", "entry_computation_id": 1, "computations": []})], f"ir_id long, module {hlo.MODULE}")
    packed = hlo.from_hlo(df).cache()
    assert [r.error for r in packed.where("graph_id = 2").collect()] == ["Failed to locate entry computation"]
    nodes, edges = ir.unpack(packed, "nodes").collect(), ir.unpack(packed, "edges").collect()
    texts = [n.text for n in nodes]
    assert texts == ["[external]", "<entry>", "<param>", "F32 2x3", "c.1", "F32 2x3", "add", "F32 2x3", "map", "F32 2x3", "<entry>", "<param>", "F32 2x3", "negate", "F32 2x3", "5"]
    assert {(e.source, e.target) for e in edges if e.flow == 2} == {(0, 1), (8, 0), (8, 10), (13, 8)}
    assert (3, 6, 0) in {(e.source, e.target, e.position) for e in edges if e.flow == 1} and (15, 4, 0) in {(e.source, e.target, e.position) for e in edges if e.flow == 1}


def test_compilers(spark):
    df = spark.createDataFrame([(1, "text"), (2, None)], "ir_id long, text string")
    assert {r.ir_id: r.text for r in compilers.compile_sources(df, ["cat"]).collect()} == {1: "text", 2: ""}
    assert all(r.error for r in compilers.compile_sources(df, ["no-such-compiler"]).collect())
    assert "no result" in compilers.compile_sources(df.limit(1), ["sleep", "9"], timeout=0.2).first().error
    assert all(r.error for r in compilers.from_cpp(df, compiler="no-such-compiler").collect())
    with pytest.raises(UnsupportedCompiler):
        compilers.from_cpp(df, version="3")
    with pytest.raises(UnsupportedCompiler):
        compilers.from_cpp(df, language="ada")
    assert compilers.configurations(df).count() == 16
    assert df.limit(1).select(compilers.preprocess_source(F.lit("void main(){}\nmain (x)"), "//h\n").alias("t")).first().t == "//h\nint main (){}\nint main(x)"


def test_functions(spark):
    df = spark.createDataFrame([(1234, "a10b2", ["x", "y", "z"])], "n long, t string, w array<string>")
    got = df.select(
        text.commas(F.col("n")), text.plural(F.lit(1), "cat"), text.plural(F.lit(2000), "cat"), text.word_series(F.col("w")), text.with_article(F.lit("Apple")),
        text.decimal_prefix(F.lit(2500), "B"), text.binary_prefix(F.lit(1536)), text.duration(F.lit(93784)), text.ordinal(F.lit(112)), text.ordinal(F.lit(23)),
        text.natural_key(F.lit("a9")) < text.natural_key(F.col("t")), text.truncate(F.lit("x" * 40), 8), text.stem(F.lit("/a/b.c.ProgramGraph.pb")), text.pretty_fraction(F.lit(1), F.lit(4)), text.unix_millis(F.lit(1970), F.lit(1), F.lit(2)),
    ).first()
    assert list(got) == ["1,234", "1 cat", "2,000 cats", "x, y and z", "an Apple", "2.5 kB", "1.5 KiB", "1d 2h 3m 4s", "112th", "23rd", True, "xxxxx...", "b.c", "1 of 4 (25.0%)", 86400000]


def test_features(spark):
    base = features.add(F.lit(None), "a", features.integer(F.lit(1)))
    again = features.put(features.add(base, "a", features.integer(F.lit(2))), "b", features.text(F.lit("hi")))
    changed = features.put(again, "a", features.floats(F.array(F.lit(1.5))))
    got = spark.range(1).select(features.as_text(again["a"]), features.as_text(again["b"]), features.as_text(changed["a"]), features.as_text(features.integers(F.sequence(F.lit(1), F.lit(40))), 2)).first()
    assert list(got) == ["1", "hi", "1.5000", "1, 2, ..."]


def test_queries(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b")], "graph_id long, text string")
    assert [r.text for r in query.run("node.text", nodes=nodes).collect()] == ["a", "b"]
    assert query.sql(spark, "SELECT COUNT(*) AS n FROM nodes WHERE text = 'a'", nodes=nodes).first().n == 1
    labels = spark.createDataFrame([("r", 1, 1), ("r", 2, 0), ("d", 1, 1)], "analysis string, graph_id long, value long")
    assert query.run("SELECT COUNT(data_flow_value)", labels=labels).first()["count"] == 3
    assert query.label_counts(labels).where("analysis IS NULL").first()["count"] == 3
    with pytest.raises(ValueError):
        query.run("SELECT *")


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, ADD)], "ir_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ir_id long, text string").parquet(f"{tmp_path}/in")
    q = analyse_stream(stream, "reachability", f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").where("value = 1").count() > 0
    with pytest.raises(ValueError):
        analyse_stream(stream, "nothing", "", "")
