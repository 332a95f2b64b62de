"""Files of program graphs: read into tables, and written from them.

A set of graphs is four tables (nodes, edges, functions, modules) and, where graphs have
features of their own, a fifth (``graph_id, features``).  Written and read again they are
equal.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from weftgraph.functions.text import stem
from weftgraph.plans.ordered import running_sum
from weftgraph.plans.scratch import Scratch
from weftgraph.schema import EDGES, FEATURE, FUNCTIONS, MODULES, NODES, GraphTransformError
from weftgraph.sources import wire, wire_batches

_PARTS = {"nodes": NODES, "edges": EDGES, "functions": FUNCTIONS, "modules": MODULES}


def _array(schema: str) -> str:
    fields = schema.split(", ", 1)[1]
    inner = ", ".join(f"{name}: {kind.replace('long', 'bigint')}" for name, kind in (x.split(" ", 1) for x in _split(fields)))
    return f"array<struct<{inner}>>"


def _split(fields: str) -> list[str]:
    out, depth = [""], 0
    for c in fields:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


_BODY = ", ".join(f"{name} {_array(schema)}" for name, schema in _PARTS.items()) + f", features map<string, {FEATURE}>, error string"
PACKED = "path string, idx int, " + _BODY
_SUFFIXES = (".ProgramGraphList.pb", ".ProgramGraphList.pbtxt", ".ProgramGraphList.txt", ".ProgramGraphList.json")


def _features(found: dict | None) -> dict | None:
    if found is None:
        return None
    names = (("bytes", "bytes_list"), ("floats", "float_list"), ("ints", "int64_list"))
    return {e["key"]: {a: e["value"][b]["value"] if e["value"] and e["value"][b] else None for a, b in names} for e in found["feature"]}


def _message_features(found) -> dict | None:
    if found is None:
        return None
    items = found.items() if isinstance(found, dict) else found
    names = (("bytes", "bytes_list"), ("floats", "float_list"), ("ints", "int64_list"))
    return {"feature": [{"key": k, "value": {b: {"value": list(v[a])} for a, b in names if v[a] is not None}} for k, v in items]}


def rows_of(graph: dict) -> dict:
    """The arrays of one graph message."""
    return {
        "nodes": [{"node_id": i, "type": n["type"], "text": n["text"], "function": n["function"], "block": n["block"], "features": _features(n["features"])} for i, n in enumerate(graph["node"])],
        "edges": [{"edge_id": i, "flow": e["flow"], "position": e["position"], "source": e["source"], "target": e["target"], "features": _features(e["features"])} for i, e in enumerate(graph["edge"])],
        "functions": [{"function_id": i, "name": f["name"], "module_id": f["module"], "features": _features(f["features"])} for i, f in enumerate(graph["function"])],
        "modules": [{"module_id": i, "name": m["name"], "features": _features(m["features"])} for i, m in enumerate(graph["module"])],
        "features": _features(graph["features"]),
    }


def message_of(row) -> dict:
    """The message of one packed graph: the inverse of ``rows_of``.

    A message knows rows by their places, so ids with gaps are numbered anew.
    """

    def entries(found):
        return None if found is None else [(e["key"], e["value"]) for e in found] if not isinstance(found, dict) else found

    def number(x, name: str) -> int:
        return int(x[name]) if name in x and x[name] is not None else 0

    def part(name: str) -> list:
        return [] if row[name] is None else list(row[name])

    nodes, functions, modules = (part(name) for name in ("nodes", "functions", "modules"))
    node_at, function_at, module_at = ({x[key]: i for i, x in enumerate(rows)} for key, rows in (("node_id", nodes), ("function_id", functions), ("module_id", modules)))

    def place(x, name: str, at: dict) -> int:
        found = number(x, name)
        if at and found not in at:
            raise GraphTransformError(f"graph {row['graph_id']}: there is no {name} {found}")
        return at.get(found, found)

    return {
        "node": [{"type": number(n, "type"), "text": n["text"] or "", "function": place(n, "function", function_at) if number(n, "type") < 2 and n["node_id"] else number(n, "function"), "block": number(n, "block"), "features": _message_features(entries(n.get("features")))} for n in nodes],
        "edge": [{"flow": number(e, "flow"), "position": number(e, "position"), "source": place(e, "source", node_at), "target": place(e, "target", node_at), "features": _message_features(entries(e.get("features")))} for e in part("edges")],
        "function": [{"name": f["name"] or "", "module": place(f, "module_id", module_at), "features": _message_features(entries(f.get("features")))} for f in functions],
        "module": [{"name": m["name"] or "", "features": _message_features(entries(m.get("features")))} for m in modules],
        "features": _message_features(entries(row["features"])),
    }


def _is_list(name: str) -> bool:
    return name.removesuffix(".gz").endswith(_SUFFIXES)


def _parsed(kind: str, data: bytes, encoding: str, idx_list: list[int] | None) -> list[tuple[int, dict]]:
    value = wire.loads(kind, data, encoding)
    graphs = value["graph"] if kind == "ProgramGraphList" else [value]
    return [(i, rows_of(graphs[i])) for i in (range(len(graphs)) if idx_list is None else idx_list)]


def decode(blobs: DataFrame, name: str, data: str, idx_list: list[int] | None, kind_of, encoding_of) -> DataFrame:
    """``path, idx``, the parts and ``error`` of each graph in the column ``data``, kinds and encodings by the column ``name``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, rows = whole.slice(start, 256), []
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    try:
                        rows += [{"path": path, "idx": i, **parts, "error": None} for i, parts in _parsed(kind_of(path), content, encoding_of(path), idx_list)]
                    except (ValueError, OSError, IndexError, TypeError, EOFError) as e:
                        rows.append({"path": path, "idx": 0, **dict.fromkeys(_PARTS), "features": None, "error": str(e)})
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 256], schema=arrow)

    found = blobs.select(F.col(name).cast("string").alias("path"), F.col(data).cast("binary").alias("content"))
    arrow = to_arrow_schema(_parse_datatype_string(PACKED))
    return found.mapInArrow(read, PACKED)


def _compression(compression: str | None) -> str:
    """The suffix of a compression: gzip or none."""
    if compression not in ("gz", None):
        raise TypeError(f"unknown compression {compression!r}; known are 'gz' and None")
    return ".gz" if compression else ""


def read_graphs(spark: SparkSession, path: str, pattern: str = "*", idx_list: list[int] | None = None, message: str | None = None, limit: int | None = None, seed: int | None = None) -> DataFrame:
    """One packed graph for each graph of each file; the suffix names encoding and message.

    ``idx_list`` picks graphs of a list by place: none for ``[]``, all for ``None``.  ``limit``
    takes that many files, in the order of their names or, with a ``seed``, of a hash.
    Files are listed once and dealt to tasks by size before they are read.
    """
    files = read_balanced(list_files(spark, path, pattern, limit, seed))
    return decode(files, "path", "content", idx_list, lambda name: message or ("ProgramGraphList" if _is_list(name) else "ProgramGraph"), wire.encoding_of)


def list_files(spark: SparkSession, path: str, pattern: str = "*", limit: int | None = None, seed: int | None = None) -> DataFrame:
    """``path, length`` of the files below a folder: all, or ``limit`` of them by name or by a seeded hash."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    if limit is not None:
        order = F.col("path") if seed is None else F.xxhash64(F.lit(seed), "path")
        found = found.orderBy(order, "path").limit(limit)
    return Scratch(spark).keep(found, "files")


#: Files that are packed one by one, for each task; smaller ones fill up what these leave.
LARGEST = 64


def dealt(listing: DataFrame, tasks: int) -> DataFrame:
    """Add ``task``: files of ``listing``, a written table, packed by size, so that tasks have about equal bytes.

    The ``LARGEST`` largest files for each task go, largest first, to the task with the fewest
    bytes.  What each task then lacks is an interval of the running sum of all other sizes.
    """
    scratch = Scratch(listing.sparkSession)
    sized = listing.withColumn("length", F.coalesce("length", F.lit(0)))
    big = sized.orderBy(F.col("length").desc(), "path").limit(LARGEST * tasks)
    loads = [(0, t) for t in range(tasks)]
    packed = []
    for row in big.collect():  # bounded by the tasks
        load, task = heapq.heappop(loads)
        packed.append((row["path"], row["length"], task))
        heapq.heappush(loads, (load + row["length"], task))
    first = listing.sparkSession.createDataFrame(packed, "path string, length long, task int")
    rest = running_sum(sized.join(F.broadcast(first.select("path")), "path", "left_anti"), [F.col("path").asc()], "length", "__upto", scratch, "rest")
    total = sum(load for load, _ in loads) + (sized.agg(F.sum("length")).first()[0] or 0) - sum(length for _, length, _ in packed)
    ends, upto = [], 0.0
    for load, task in sorted(loads, key=lambda x: x[1]):
        upto += max(0.0, total / tasks - load)
        ends.append(upto)
    middle = F.col("__upto") - F.col("length") / 2
    task = F.least(F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end <= middle)), F.lit(tasks - 1))
    return first.unionByName(rest.select("path", "length", task.cast("int").alias("task")))


def read_balanced(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """``path, content`` of listed files, which each task reads for itself, on any file system that Arrow knows."""
    tasks = tasks or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = _file_system(path)
                with system.open_input_stream(name, compression=None) as file:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read()], pa.binary())], ["path", "content"])

    return dealt(listing, tasks).repartitionById(tasks, F.col("task")).select("path").mapInArrow(read, "path string, content binary")


def from_bytes(blobs: DataFrame, key: str = "graph_id", data: str = "data", idx_list: list[int] | None = None, compression: str | None = "gz", message: str = "ProgramGraphList") -> DataFrame:
    """Packed graphs of protobuf bytes, each a list or, by ``message``, a graph; ``path`` is the key."""
    encoding = "pb" + _compression(compression)
    return decode(blobs, key, data, idx_list, lambda _: message, lambda _: encoding)


def from_string(texts: DataFrame, key: str = "graph_id", text: str = "text", idx_list: list[int] | None = None, message: str = "ProgramGraphList") -> DataFrame:
    """Packed graphs of text format."""
    return decode(texts, key, text, idx_list, lambda _: message, lambda _: "pbtxt")


def rows_from(blobs: DataFrame, part: str, key: str = "graph_id", data: str = "data", encoding: str = "pb.gz", message: str = "ProgramGraphList") -> DataFrame:
    """``unpack`` of the graphs in a column of bytes or texts, by their own key: no graph is packed in between."""
    fields = _PARTS[part].split(", ", 1)[1]
    found = blobs.select(F.col(key), F.col(data).cast("binary").alias("__content"))
    schema = f"`{key}` {found.schema[0].dataType.simpleString()}, {fields}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = wire_batches.Reader(part, pa.schema([arrow.field(i) for i in range(2, len(arrow))]), message, encoding, rows_of)
        for whole in batches:
            for batch in wire_batches.cut(whole, "__content"):
                of, place, rows = reader.read(batch.column("__content").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(place), *rows.columns], schema=arrow)

    return found.mapInArrow(read, schema)


def unpack(packed: DataFrame, part: str, key: str = "graph_id") -> DataFrame:
    return packed.where("error IS NULL").select(key, F.explode(part).alias("x")).select(key, "x.*")


def numbered(packed: DataFrame) -> DataFrame:
    """Add ``graph_id``, a hash of path and place."""
    return packed.withColumn("graph_id", F.xxhash64("path", "idx"))


def concatenated(*packed: DataFrame) -> DataFrame:
    """Lists of graphs one after the other: places go on where the list before ends."""
    out, upto = packed[0], None
    for more in packed[1:]:
        ends = out.groupBy("path").agg(F.max("idx").alias("upto"))
        upto = F.coalesce("upto", F.lit(-1))
        moved = more.join(ends, "path", "left").withColumn("idx", (F.col("idx") + upto + 1).cast("int")).select(*out.columns)
        out = out.unionByName(moved)
    return out


def _list(df: DataFrame, order: str, out: str) -> DataFrame:
    extra = [c for c in df.columns if c not in ("graph_id", order)]
    return df.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(order, *[F.map_entries(c).alias(c) if c == "features" else F.col(c) for c in extra]))).alias(out))


def packed_tables(nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None, modules: DataFrame | None = None, graphs: DataFrame | None = None) -> DataFrame:
    """One row for each graph of the nodes: ``graph_id`` and the lists ``nodes, edges, functions, modules, features``."""
    both = _list(nodes, "node_id", "nodes").join(_list(edges, "edge_id", "edges"), "graph_id", "left")
    for name, table, order in (("functions", functions, "function_id"), ("modules", modules, "module_id")):
        both = both.withColumn(name, F.lit(None).cast("array<struct<name: string>>")) if table is None else both.join(_list(table, order, name), "graph_id", "left")
    entries = f"array<struct<key: string, value: {FEATURE}>>"
    if graphs is None:
        return both.withColumn("features", F.lit(None).cast(entries))
    return both.join(graphs.select("graph_id", F.map_entries("features").alias("features")), "graph_id", "left")


def _rows(column: pa.Array) -> list:
    """``to_pylist``, but lists of structs field by field, not value by value."""
    if not pa.types.is_list(column.type) or not pa.types.is_struct(column.type.value_type):
        return column.to_pylist()
    inner = column.flatten()
    names, fields = [f.name for f in inner.type], inner.flatten()
    values = [x.to_numpy().tolist() if pa.types.is_integer(x.type) and not x.null_count else x.to_pylist() for x in fields]
    dicts, at, out = [dict(zip(names, row, strict=True)) for row in zip(*values, strict=True)], 0, []
    for size in pa.compute.list_value_length(column).to_pylist():
        out.append(None if size is None else dicts[at : at + size])
        at += size or 0
    return out


def to_bytes(nodes: DataFrame, edges: DataFrame, encoding: str = "pb.gz", functions: DataFrame | None = None, modules: DataFrame | None = None, graphs: DataFrame | None = None, as_list: bool = False) -> DataFrame:
    """``graph_id, data``: each graph as a message of its own, or as a list of one."""
    wire.dumps("ProgramGraph", {}, encoding)  # an unknown encoding is an error here

    def one_by_one(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            columns = [_rows(column) for column in batch.columns]
            found = [message_of(dict(zip(batch.schema.names, row, strict=True))) for row in zip(*columns, strict=True)]
            data = [wire.dumps("ProgramGraphList", {"graph": [m]}, encoding) if as_list else wire.dumps("ProgramGraph", m, encoding) for m in found]
            yield pa.RecordBatch.from_arrays([batch.column("graph_id"), pa.array(data, pa.binary())], ["graph_id", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wire_batches.pieces(whole):
                data = wire_batches.encoded(wire_batches.packed_rows(batch), encoding, as_list)
                if data is None:
                    yield from one_by_one(batch)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column("graph_id"), pa.array(data, pa.binary())], ["graph_id", "data"])

    packed = packed_tables(nodes, edges, functions, modules, graphs)
    return packed.withColumn("graph_id", F.col("graph_id").cast("long")).mapInArrow(write, "graph_id long, data binary")


def clustered_to_bytes(rows: DataFrame, encoding: str = "pb.gz", as_list: bool = False) -> DataFrame:
    """``to_bytes`` of rows with some nodes and edges each, as ``sources.orders.order_rows`` has them: those of a graph follow each other, so none is collected."""
    wire.dumps("ProgramGraph", {}, encoding)

    def one(graph_id: int | None, lines: pa.RecordBatch) -> bytes:
        lists = []
        for name, by in (("nodes", ("node_id", "type", "text")), ("edges", ("flow", "source", "target", "position"))):
            found = [x for x in lines.column(name).flatten().to_pylist() if x is not None]
            lists.append(sorted(found, key=lambda x, by=by: [(x[c] is not None, x[c]) if x[c] is not None else (False,) for c in by]))
        message = message_of({"graph_id": graph_id, "nodes": lists[0], "edges": lists[1], "functions": None, "modules": None, "features": None})
        return wire.dumps("ProgramGraphList", {"graph": [message]}, encoding) if as_list else wire.dumps("ProgramGraph", message, encoding)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in wire_batches.whole_graphs(batches):
            ids = batch.column("graph_id").take(pa.array(begins))
            data = wire_batches.encoded(wire_batches.clustered_rows(batch, begins), encoding, as_list)
            if data is None:
                ends = [*begins[1:].tolist(), batch.num_rows]
                data = [one(k, batch.slice(a, b - a)) for k, a, b in zip(ids.to_pylist(), begins.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary())], ["graph_id", "data"])

    return rows.mapInArrow(write, "graph_id long, data binary")


def to_string(nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None, modules: DataFrame | None = None, graphs: DataFrame | None = None, as_list: bool = True) -> DataFrame:
    """``graph_id, text``: each graph in text format."""
    return to_bytes(nodes, edges, "pbtxt", functions, modules, graphs, as_list).select("graph_id", F.col("data").cast("string").alias("text"))


def save_graphs(path: str, nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None, modules: DataFrame | None = None, graphs: DataFrame | None = None, compression: str | None = "gz", exist_ok: bool = True) -> int:
    """Write a list file for each task that holds graphs, and return the number of graphs.

    The folder then holds these graphs and no others: tasks write into a folder beside it under
    names of their attempts, and when all are done it takes the place of what was there.  With
    ``exist_ok`` off a folder that holds anything is an error.
    """
    place, staging = path.rstrip("/"), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    system, name = _file_system(place)
    if not exist_ok and system.get_file_info(pyarrow.fs.FileSelector(name, allow_not_found=True)):
        raise FileExistsError(path)
    suffix = f".ProgramGraphList.pb{_compression(compression)}"
    encoding = f"pb{_compression(compression)}"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        found, ids = [], []
        for batch in batches:
            found += [message_of(row) for row in batch.to_dict("records")]
            ids += batch["graph_id"].tolist()
        if found:
            file = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}{suffix}"
            _write_file(f"{staging}/{file}", wire.dumps("ProgramGraphList", {"graph": found}, encoding))
            yield pd.DataFrame({"file": [file], "graphs": [len(ids)]})

    rows = packed_tables(nodes, edges, functions, modules, graphs).sortWithinPartitions("graph_id")
    try:
        done = {r["file"]: r["graphs"] for r in rows.mapInPandas(write, "file string, graphs long").collect()}  # a row for each task
        _publish(staging, place, set(done))
    finally:
        _, left = _file_system(staging)
        if system.get_file_info(left).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(left)
    return sum(done.values())


def _publish(staging: str, place: str, files: set[str]) -> None:
    """Put a folder with just ``files`` of ``staging`` in the place of what is there."""
    system, source = _file_system(staging)
    _, target = _file_system(place)
    system.create_dir(source, recursive=True)
    for found in system.get_file_info(pyarrow.fs.FileSelector(source)):
        if found.base_name not in files:  # of an attempt that did not end
            system.delete_file(found.path)
    if system.get_file_info(target).type != pyarrow.fs.FileType.NotFound:
        system.delete_dir(target)
    system.move(source, target)


def load_graphs(spark: SparkSession, path: str, idx_list: list[int] | None = None, compression: str | None = "gz") -> DataFrame:
    """Packed graphs of list files, whatever their names."""
    encoding = "pb" + _compression(compression)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return decode(files, "path", "content", idx_list, lambda _: "ProgramGraphList", lambda _: encoding)


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Any file system that Arrow knows."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def _write_file(path: str, data: bytes, exist_ok: bool = True) -> None:
    """Whole or not at all; attempts that write the same file do not meet in one that is half done."""
    system, name = _file_system(path)
    if not exist_ok and system.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    own = f"{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own, compression=None) as out:
        out.write(data)
    system.move(own, name)


def write_files(blobs: DataFrame, path: str, suffix: str, name: str = "graph_id", exist_ok: bool = True) -> int:
    """One file ``name + suffix`` for each row of ``data``; returns their number.  With ``exist_ok`` off a file that is there is an error."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for found, data in zip(batch["name"], batch["data"], strict=True):
                _write_file(f"{path.rstrip('/')}/{found}{suffix}", bytes(data), exist_ok)
            yield batch[["name"]]

    return blobs.select(F.col(name).cast("string").alias("name"), "data").mapInPandas(write, "name string").count()


def joined_by_stem(graphs: DataFrame, irs: DataFrame) -> DataFrame:
    """Packed graphs with the ``text`` of the file of the same stem, null where there is none.

    A stem is a file's name without its whole suffix: ``a.1.ProgramGraph.pb`` goes with ``a.1.ll``.
    """
    texts = irs.select(stem(F.col("path")).alias("stem"), F.col("text").alias("ir"))
    return graphs.withColumn("stem", stem(F.col("path"))).join(texts, "stem", "left")
