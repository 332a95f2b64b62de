"""Command line: ``python -m weftgraph TOOL PATH [NAME] [options]``.

Tools: llvm2graph, clang2graph, xla2graph (sources to graphs); analyze, graph2cdfg, graph2dot,
graph2json, graph2seq, inst2vec, pbq (graphs to results).  A path is a folder or file, or ``-`` for
standard input.  Graphs come from LLVM text, or from files or input in the exchange format.
Without ``--out`` graphs are written to standard output in ``--stdout_fmt``, other results as lines.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUILD = ["llvm2graph", "clang2graph", "xla2graph"]
USE = ["analyze", "graph2cdfg", "graph2dot", "graph2json", "graph2seq", "inst2vec", "pbq", "query"]
FORMATS = ["pbtxt", "pb", "json"]


def parser() -> argparse.ArgumentParser:
    args = argparse.ArgumentParser(prog="weftgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    args.add_argument("tool", choices=BUILD + USE)
    args.add_argument("path", help="folder or file; - for standard input")
    args.add_argument("name", nargs="?", default="reachability", help="analysis or query")
    args.add_argument("--stdin_fmt", choices=FORMATS, default="pbtxt", help="form of graphs on standard input")
    args.add_argument("--stdout_fmt", choices=FORMATS, default="pbtxt", help="form of graphs on standard output")
    args.add_argument("--pretty_print", action="store_true", help="indent JSON")
    args.add_argument("--node_label", choices=["text", "none", "feature"], default="text")
    args.add_argument("--node_feature", default="")
    args.add_argument("--instructions_only", action="store_true")
    args.add_argument("--ignore_call_returns", action="store_true")
    args.add_argument("--strict", action="store_true")
    args.add_argument("--ir_list_index", type=int, default=None)
    args.add_argument("--vocabulary", help="tab-separated text and id, for inst2vec")
    args.add_argument("--compiler", default="clang")
    args.add_argument("--max_nodes", type=int, default=1_000_000)
    args.add_argument("--out", help="folder to write Parquet to")
    return args


def _tables(packed: DataFrame, unpack: Any) -> dict[str, DataFrame]:
    return {part: unpack(packed, part) for part in ("nodes", "edges", "functions", "modules")}


def _built(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Packed graphs of sources."""
    from weftgraph.sources import compilers, hlo, ir

    options = {k: True for k in ("instructions_only", "ignore_call_returns", "strict") if getattr(args, k)}
    if args.tool == "xla2graph":
        if args.path == "-":
            return hlo.from_hlo_proto(spark.createDataFrame([(0, bytearray(sys.stdin.buffer.read()))], "ir_id long, data binary"))
        return hlo.read_hlo(spark, args.path, "*")
    if args.path == "-":
        texts = spark.createDataFrame([(0, sys.stdin.read())], "ir_id long, text string")
    else:
        pattern = "*" if args.tool == "clang2graph" else "*.{ll,pb}"
        texts = ir.read_any(spark, args.path, pattern, args.ir_list_index).where("error IS NULL").select(F.xxhash64("path", "idx").alias("ir_id"), "text")
    return compilers.from_cpp(texts, args.compiler, **options) if args.tool == "clang2graph" else ir.from_llvm_ir(texts, **options)


def _given(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The tables of graphs: from LLVM text where there is any, else from the exchange format."""
    from weftgraph.sources import files, ir

    if args.path == "-":
        data = spark.createDataFrame([("stdin", bytearray(sys.stdin.buffer.read()))], "path string, data binary")
        packed = files.numbered(files.decode(data, "path", "data", None, lambda _: "ProgramGraph", lambda _: args.stdin_fmt))
        return _tables(packed, files.unpack)
    texts = ir.read_ir(spark, args.path).selectExpr("xxhash64(path) AS ir_id", "text")
    if not texts.isEmpty():
        return _tables(ir.from_llvm_ir(texts), ir.unpack) | {"irs": texts}
    return _tables(files.numbered(files.read_graphs(spark, args.path, "*ProgramGraph*")), files.unpack)


def _write_graphs(tables: dict[str, DataFrame], form: str) -> None:
    """Each graph as a message on standard output."""
    from weftgraph.sources import files

    for row in files.to_bytes(tables["nodes"], tables["edges"], form, tables.get("functions"), tables.get("modules")).toLocalIterator():
        sys.stdout.buffer.write(bytes(row.data))
    sys.stdout.buffer.flush()


def main(argv: list[str] | None = None) -> int:
    from weftgraph.operators import analysis, query, transforms
    from weftgraph.sources import ir

    args = parser().parse_args(argv)
    if args.tool in ("pbq", "query") and args.name not in query.QUERIES:
        print(f"unknown query: {args.name}", file=sys.stderr)
        return 4
    if args.tool == "analyze" and args.name not in analysis.ANALYSES:
        print(f"unknown analysis: {args.name}", file=sys.stderr)
        return 4
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    if args.tool in BUILD:
        packed = _built(spark, args)
        if args.out:
            packed.write.parquet(args.out)
            return 0
        failed = packed.where("error IS NOT NULL").select("error").first()
        if failed:
            print(failed.error, file=sys.stderr)
            return 2
        _write_graphs(_tables(packed, ir.unpack), args.stdout_fmt)
        return 0
    tables = _given(spark, args)
    nodes, edges, functions, modules = (tables[t] for t in ("nodes", "edges", "functions", "modules"))
    lines = None
    if args.tool == "analyze":
        out = analysis.run(args.name, nodes, edges)[0]
    elif args.tool in ("pbq", "query"):
        out = query.run(args.name, **tables)
    elif args.tool == "graph2cdfg":
        parts = transforms.cdfg(nodes, edges, functions)
        out = parts["edges"]
        if not args.out:
            _write_graphs({"nodes": parts["nodes"].drop("source_node_index").withColumn("type", F.lit(0)), "edges": out.withColumn("edge_id", F.monotonically_increasing_id()), "functions": functions}, args.stdout_fmt)
            return 0
    elif args.tool == "inst2vec":
        words = spark.read.csv(args.vocabulary, sep="\t", schema="text string, id long", quote="")
        out, graphs = transforms.annotate_inst2vec(nodes, words)
        if not args.out:
            _write_graphs({"nodes": out.drop("full_text"), "edges": edges, "functions": functions, "modules": modules}, args.stdout_fmt)
            return 0
    elif args.tool == "graph2dot":
        out, lines = transforms.dot_text(nodes, edges, args.node_label, args.node_feature, functions), "dot"
    elif args.tool == "graph2json":
        out, lines = transforms.node_link_json(nodes, edges, functions, modules), "json"
    else:
        out, lines = transforms.instruction_sequence(edges, args.max_nodes), "node_ids"
    if args.out:
        out.write.parquet(args.out)
    elif lines:
        for row in out.toLocalIterator():
            text = row[lines] if isinstance(row[lines], str) else json.dumps(list(row[lines]))
            print(json.dumps(json.loads(text), indent=2) if args.pretty_print and lines == "json" else text)
    else:
        for row in out.toJSON().toLocalIterator():
            print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
