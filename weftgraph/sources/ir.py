"""Tables of intermediate representations, and the graphs made of them."""

from __future__ import annotations

import signal
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.features import integer
from weftgraph.schema import UnsupportedCompiler
from weftgraph.sources import wire
from weftgraph.sources.llvm_text import EDGE_FIELDS, NODE_FIELDS, build_rows

#: Versions whose text can be read; the first is the default.
LLVM_VERSIONS = ["10", "6", "3.8"]
PACKED = (
    "graph_id long, nodes array<struct<node_id: bigint, type: bigint, text: string, full_text: string, function: bigint, block: bigint, features: map<string, bigint>>>, "
    "edges array<struct<edge_id: bigint, flow: bigint, position: bigint, source: bigint, target: bigint>>, "
    "functions array<struct<function_id: bigint, name: string, module_id: bigint, features: map<string, bigint>>>, "
    "modules array<struct<module_id: bigint, name: string, features: map<string, bigint>>>, error string"
)

_COUNTS = pa.map_(pa.string(), pa.int64())


def _struct(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


#: The same for Arrow.
ARROW = pa.schema(
    {
        "graph_id": pa.int64(),
        "nodes": _struct(node_id=pa.int64(), type=pa.int64(), text=pa.string(), full_text=pa.string(), function=pa.int64(), block=pa.int64(), features=_COUNTS),
        "edges": _struct(edge_id=pa.int64(), flow=pa.int64(), position=pa.int64(), source=pa.int64(), target=pa.int64()),
        "functions": _struct(function_id=pa.int64(), name=pa.string(), module_id=pa.int64(), features=_COUNTS),
        "modules": _struct(module_id=pa.int64(), name=pa.string(), features=_COUNTS),
        "error": pa.string(),
    }
)


def read_ir(spark: SparkSession, path: str, pattern: str = "*.ll") -> DataFrame:
    """``path, text`` of the files under a folder."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_any(spark: SparkSession, path: str, pattern: str = "*", ir_list_index: int | None = None) -> DataFrame:
    """``path, idx, text, error`` by suffix: ``.Ir.pb`` holds one, ``.IrList.pb`` several (``ir_list_index`` picks one), all else is text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    if name.endswith(".IrList.pb"):
                        found = [x["text"] for x in wire.loads("IrList", data)["ir"]]
                        rows += [(name, i, found[i], None) for i in (range(len(found)) if ir_list_index is None else [ir_list_index])]
                    else:
                        rows.append((name, 0, wire.loads("Ir", data)["text"] if name.endswith(".Ir.pb") else bytes(data).decode("utf-8", "replace"), None))
                except (ValueError, IndexError) as e:
                    rows.append((name, 0, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "idx", "text", "error"])

    return files.mapInPandas(read, "path string, idx int, text string, error string")


def unpack_lists(lists: DataFrame, key: str = "ir_id", irs: str = "irs") -> DataFrame:
    """``key, idx, text`` and so on: each of a row's list of intermediate representations, in order."""
    return lists.select(key, F.posexplode(irs).alias("idx", "ir")).select(key, F.col("idx").cast("long").alias("idx"), "ir.*" if "struct" in lists.schema[irs].dataType.elementType.typeName() else F.col("ir").alias("text"))


class _Clock:
    """Raise ``TimeoutError`` in this thread when a text takes too long, where the system has alarms."""

    def __init__(self, seconds: float | None):
        self.seconds = seconds if seconds and threading.current_thread() is threading.main_thread() and hasattr(signal, "setitimer") else None

    def __enter__(self) -> None:
        if self.seconds:
            self.before = signal.signal(signal.SIGALRM, self._ring)
            signal.setitimer(signal.ITIMER_REAL, self.seconds)

    def _ring(self, *_) -> None:
        raise TimeoutError(f"no result after {self.seconds} seconds")

    def __exit__(self, *_) -> None:
        if self.seconds:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, self.before)


def _flat(rows: list[list[tuple] | None], kind: pa.DataType, key: str, fields: tuple[str, ...]) -> pa.Array:
    """Lists of structs from lists of tuples of ``fields``, columns at once; ``key`` is a row's place in its list."""
    sizes = np.array([0 if x is None else len(x) for x in rows], np.int64)
    ends = np.append(0, np.cumsum(sizes))
    columns = dict(zip(fields, zip(*(row for x in rows if x is not None for row in x), strict=True), strict=False)) if ends[-1] else {}
    arrays = []
    for field in kind.value_type:
        if field.name == key:
            arrays.append(pa.array(np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)))
            continue
        values = columns.get(field.name)
        # features are mostly absent
        arrays.append(pa.nulls(int(ends[-1]), field.type) if values is None or field.name == "features" and not any(values) else pa.array(values, field.type))
    inner = pa.StructArray.from_arrays(arrays, fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), inner, type=kind, mask=pa.array([x is None for x in rows]))


def packed_rows(rows: list[dict], parts: tuple[str, ...] | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow rows of ``graph_id``, the parts and ``error``, nodes and edges as tuples; parts that are not asked for are null."""
    for start in range(0, len(rows), 256):
        some = rows[start : start + 256]
        columns = []
        for field in ARROW:
            values = [x[field.name] for x in some]
            if field.name in ("graph_id", "error"):
                columns.append(pa.array(values, field.type))
            elif parts is not None and field.name not in parts:
                columns.append(pa.nulls(len(some), field.type))
            elif field.name in ("nodes", "edges"):
                columns.append(_flat(values, field.type, f"{field.name[:-1]}_id", NODE_FIELDS if field.name == "nodes" else EDGE_FIELDS))
            else:
                columns.append(pa.array(values, field.type))
        yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def from_llvm_ir(irs: DataFrame, key: str = "ir_id", text: str = "text", version: str = LLVM_VERSIONS[0], timeout: float | None = 300, parts: tuple[str, ...] | None = None, **options: bool) -> DataFrame:
    """One packed graph for each row; ``error`` says why there is none, as when a text takes longer than ``timeout`` seconds.

    ``parts`` names those that a caller goes on with; others are null then.
    """
    if version not in LLVM_VERSIONS:
        raise UnsupportedCompiler(f"unknown LLVM version {version}; known are {', '.join(LLVM_VERSIONS)}")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = []
                for graph_id, ir in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                    try:
                        with _Clock(timeout):
                            rows.append({"graph_id": graph_id, **build_rows(ir or "", **options), "error": None})
                    except (ValueError, IndexError, KeyError, RecursionError, TimeoutError) as e:
                        rows.append({"graph_id": graph_id, **dict.fromkeys(("nodes", "edges", "functions", "modules")), "error": str(e) or type(e).__name__})
                yield from packed_rows(rows, parts)

    return irs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(build, PACKED)


def unpack(packed: DataFrame, part: str) -> DataFrame:
    """``nodes``, ``edges``, ``functions`` or ``modules`` as a table of its own, features in the form of the data model."""
    rows = packed.where("error IS NULL").select("graph_id", F.explode(part).alias("x")).select("graph_id", "x.*")
    if "features" not in rows.columns:
        return rows
    return rows.withColumn("features", F.transform_values("features", lambda _, v: integer(v)))
