"""Program graphs of HLO modules held as nested rows.

A module is ``{name, entry_computation_id, computations: [{id, name, instructions: [{id,
name, opcode, shape, operand_ids, control_predecessor_ids, called_computation_ids,
literal}]}]}``; ``shape`` is ``{type, dimensions}`` or a text.  ``decode_hlo`` makes such rows of
the wire format.  Only an instruction whose opcode is ``constant`` gets a constant for its literal.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.schema import CALL, CONSTANT, CONTROL, DATA, INSTRUCTION, ROOT_TEXT, VARIABLE, GraphCreationError
from weftgraph.sources import wire
from weftgraph.sources.ir import PACKED, packed_rows
from weftgraph.sources.llvm_text import EDGE_FIELDS, NODE_FIELDS

MODULE = (
    "struct<name: string, entry_computation_id: bigint, computations: array<struct<id: bigint, name: string, instructions: array<struct<"
    "id: bigint, name: string, opcode: string, shape: struct<type: string, dimensions: array<bigint>>, operand_ids: array<bigint>, "
    "control_predecessor_ids: array<bigint>, called_computation_ids: array<bigint>, literal: string>>>>>"
)


def shape_text(shape) -> str:
    if shape is None or isinstance(shape, str):
        return shape or ""
    dimensions = [] if shape["dimensions"] is None else [str(int(x)) for x in shape["dimensions"]]
    return f"{shape['type'] or ''} {'x'.join(dimensions)}".strip()


def _text(row) -> str:
    return "<param>" if row["opcode"] == "parameter" else row["name"] if row["opcode"] == "constant" else row["opcode"]


def build_module(module) -> dict:
    """Nodes, edges, functions and modules, as dicts; calls join instructions and the computations they name."""
    made = build_rows(module)
    nodes, edges = ([{key: i, **dict(zip(fields, row, strict=True))} for i, row in enumerate(made[part])] for part, key, fields in (("nodes", "node_id", NODE_FIELDS), ("edges", "edge_id", EDGE_FIELDS)))
    return {**made, "nodes": nodes, "edges": edges}


def build_rows(module) -> dict:
    """The same with nodes and edges as tuples of ``NODE_FIELDS`` and ``EDGE_FIELDS``."""
    nodes: list[tuple] = [(INSTRUCTION, ROOT_TEXT, None, 0, 0, None)]
    edges: list[tuple[int, int, int, int]] = []

    def node(kind: int, text: str, function: int, block: int) -> int:
        nodes.append((kind, text, text, function, block, None))
        return len(nodes) - 1

    def edge(flow: int, position: int, source: int, target: int) -> None:
        edges.append((flow, position, source, target))

    made: dict[int, tuple[int, int]] = {}  # instruction: (node, its output)
    ends: dict[int, tuple[int, int]] = {}
    computations = list(module["computations"] if module["computations"] is not None else ())
    for index, c in enumerate(computations):
        last = entry = node(INSTRUCTION, "<entry>", index, index)
        for row in c["instructions"]:
            last = node(INSTRUCTION, _text(row), index, index)
            output = node(VARIABLE, shape_text(row["shape"]), index, index)
            edge(DATA, 0, last, output)
            made[row["id"]] = last, output
            if row["opcode"] == "parameter":
                edge(CONTROL, 0, entry, last)
        ends[c["id"]] = entry, last
    for c in computations:
        for row in c["instructions"]:
            at = made[row["id"]][0]
            operands = [] if row["operand_ids"] is None else list(row["operand_ids"])
            for position, operand in enumerate(operands):
                if operand not in made:
                    raise GraphCreationError(f"Failed to locate operand {operand} of {row['name']}")
                edge(DATA, position, made[operand][1], at)
                edge(CONTROL, position, made[operand][0], at)
            if row["literal"] is not None and row["opcode"] == "constant":
                edge(DATA, len(operands), node(CONSTANT, row["literal"], 0, 0), at)
            for before in () if row["control_predecessor_ids"] is None else row["control_predecessor_ids"]:
                edge(CONTROL, 0, made[before][0], at)
            for called in () if row["called_computation_ids"] is None else row["called_computation_ids"]:
                if called not in ends:
                    raise GraphCreationError(f"Failed to locate computation {called} of {row['name']}")
                edge(CALL, 0, at, ends[called][0])
                edge(CALL, 0, ends[called][1], at)
    if module["entry_computation_id"] not in ends:
        raise GraphCreationError("Failed to locate entry computation")
    entry, last = ends[module["entry_computation_id"]]
    edge(CALL, 0, 0, entry)
    edge(CALL, 0, last, 0)
    functions = [{"function_id": i, "name": c["name"], "module_id": 0, "features": None} for i, c in enumerate(computations)]
    return {"nodes": nodes, "edges": edges, "functions": functions, "modules": [{"module_id": 0, "name": module["name"], "features": None}]}


def _built(column: str, read, parts: tuple[str, ...] | None = None):
    """Kernel that builds the graph of each row of a column."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = []
                for graph_id, one in zip(batch.column("k").to_pylist(), batch.column(column).to_pylist(), strict=True):
                    try:
                        rows.append({"graph_id": graph_id, **build_rows(read(one)), "error": None})
                    except (ValueError, KeyError, TypeError, IndexError, OSError) as e:
                        rows.append({"graph_id": graph_id, **dict.fromkeys(("nodes", "edges", "functions", "modules")), "error": str(e)})
                yield from packed_rows(rows, parts)

    return build


def from_hlo(modules: DataFrame, key: str = "ir_id", module: str = "module", parts: tuple[str, ...] | None = None) -> DataFrame:
    """One packed graph for each module row; ``error`` says why there is none; ``parts`` as in ``ir.from_llvm_ir``."""
    whole = F.to_json(F.from_json(F.to_json(module), MODULE), {"ignoreNullFields": "false"})  # all fields of ``MODULE``
    return modules.select(F.col(key).cast("long").alias("k"), whole.alias("m")).mapInArrow(_built("m", lambda one: one and json.loads(one), parts), PACKED)


def module_of(data: bytes, encoding: str = "pb") -> dict:
    """The nested row of an ``HloProto``."""
    found = wire.loads("HloProto", data, encoding)["hlo_module"]
    if found is None:
        raise GraphCreationError("Failed to locate entry computation")

    def shape(x: dict | None) -> dict | None:
        return x and {"type": wire.PRIMITIVE_TYPES[x["element_type"]], "dimensions": x["dimensions"]}

    def instruction(x: dict) -> dict:
        kept = {k: x[k] for k in ("id", "name", "opcode", "operand_ids", "control_predecessor_ids", "called_computation_ids")}
        return kept | {"shape": shape(x["shape"]), "literal": shape_text(shape(x["literal"]["shape"])) if x["literal"] else None}

    computations = [{"id": c["id"], "name": c["name"], "instructions": [instruction(x) for x in c["instructions"]]} for c in found["computations"]]
    return {"name": found["name"], "entry_computation_id": found["entry_computation_id"], "computations": computations}


def from_hlo_proto(blobs: DataFrame, key: str = "ir_id", data: str = "data", encoding: str = "pb") -> DataFrame:
    """One packed graph for each row of wire format; ``error`` says why there is none."""
    read = lambda content: module_of(bytes(content or b""), encoding)
    return blobs.select(F.col(key).cast("long").alias("k"), F.col(data).cast("binary").alias("d")).mapInArrow(_built("d", read), PACKED)


def read_hlo(spark: SparkSession, path: str, pattern: str = "*.pb") -> DataFrame:
    """Packed graphs of files of ``HloProto``; the key is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return from_hlo_proto(files.select(F.xxhash64("path").alias("ir_id"), F.col("content").alias("data")))
