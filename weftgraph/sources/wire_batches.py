"""The exchange format of many graphs at once: fields as columns, equal rows read once.

Both ways take what is plain and leave the rest to ``wire`` one message after the other, so
that results, errors too, are those of ``wire``.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from weftgraph.plans.kernels import cuts, sizes
from weftgraph.sources import wire

#: Rows of graphs to write at once, bytes of them where they come line by line, and of their texts; bytes of messages to read at once.
MOST_ROWS, MOST_HELD, MOST_TEXT, MOST_BYTES = 200_000, 1 << 24, 1 << 26, 1 << 20
#: Known rows, and their bytes, before a reader starts anew.
MOST_KNOWN, KNOWN_BYTES = 1 << 16, 1 << 24
#: Numbers up to this have a table.
_DENSE = 1 << 12
_FIELDS = {"Node": ("type", "text", "function", "block"), "Edge": ("flow", "position", "source", "target")}


# writing


def _table(values: np.ndarray, render: Callable[[int], bytes]) -> pa.Array:
    """What ``render`` makes of each value, called once for each that there is."""
    if not len(values):
        return pa.array([], pa.binary())
    low, high = int(values.min()), int(values.max())
    known, at = (np.arange(high + 1), values) if low >= 0 and high < min(_DENSE, 16 + len(values)) else np.unique(values, return_inverse=True)
    return pa.array([render(x) for x in known.tolist()], pa.binary()).take(pa.array(at))


def _joined(*parts: pa.Array | bytes) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(x, pa.binary()) if isinstance(x, bytes) else x for x in parts], pa.scalar(b"", pa.binary()))


def _wrapped(message: str, field: str, bodies: pa.Array, text: bool, indent: int) -> pa.Array:
    """Each body as a field of a message."""
    if text:
        pad = b"  " * indent
        return _joined(pad + field.encode() + b" {\n", bodies, pad + b"}\n")
    tag = wire._varint(wire.MESSAGES[message][field][0] << 3 | 2)
    return _joined(_table(pc.binary_length(bodies).to_numpy(), lambda n: tag + wire._varint(n)), bodies)


def _ints(column: pa.Array) -> np.ndarray | None:
    if not pa.types.is_integer(column.type):
        return None
    return (pc.fill_null(column, 0) if column.null_count else column).to_numpy().astype(np.int64)


def _fields(column: pa.Array, names: tuple[str, ...]) -> dict | None:
    """The named fields of all structs of a column of lists as arrays, nulls as 0 or an empty text; None if there is more to a row."""
    if not pa.types.is_list(column.type) or not pa.types.is_struct(column.type.value_type):
        return None
    inner = column.flatten()
    found = dict(zip([f.name for f in inner.type], inner.flatten(), strict=True))
    if inner.null_count or "features" in found and found["features"].null_count < len(inner):
        return None
    if "text" in names and not pa.types.is_string(found["text"].type if "text" in found else pa.null()):
        return None
    out = {name: pc.fill_null(found[name], "") if name == "text" else _ints(found[name]) for name in names if name in found}
    return None if any(x is None for x in out.values()) else out


def _places(begins: np.ndarray, count: np.ndarray, row: np.ndarray, ids: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray | None:
    """The place among the ids of its row, which ascend, of each wanted id of row ``at``; the last of equal ones, None if one is not there."""
    last = begins + count - 1
    high = ids[last] + 1
    if ids.min() >= 0 and high.sum() <= 16 * len(ids) + 16:
        base = np.cumsum(high) - high
        table = np.full(int(high.sum()) + 1, -1)
        table[base[row] + ids] = np.arange(len(ids)) - begins[row]
        known = (wanted >= 0) & (wanted < high[at])
        found = np.where(known, table[np.where(known, base[at] + wanted, -1)], -1)
        return found if (found >= 0).all() else None
    known, code = np.unique(ids, return_inverse=True)
    here = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    keys, key = row * len(known) + code, at * len(known) + here
    found = np.searchsorted(keys, key, side="right") - 1
    return found - begins[at] if ((known[here] == wanted) & (found >= 0) & (keys[np.maximum(found, 0)] == key)).all() else None


class Rows:
    """Nodes and edges of some graphs side by side: fields as arrays, and how many each graph has."""

    def __init__(self, nodes: dict, edges: dict, count: np.ndarray, degree: np.ndarray):
        self.nodes, self.edges, self.count, self.degree = nodes, edges, count, degree

    def placed(self) -> bool:
        """Put nodes' places for the ends of edges; False if nodes do not ascend or an end is not there."""
        number, each = self.nodes["node_id"], np.arange(len(self.count))
        begins, row, at = np.cumsum(self.count) - self.count, np.repeat(each, self.count), np.repeat(each, self.degree)
        if not self.count.all() or (np.diff(number)[np.diff(row) == 0] < 0).any():
            return False
        for end in ("source", "target"):
            found = _places(begins, self.count, row, number, at, self.edges.get(end, np.zeros(len(at), np.int64))) if len(row) else None
            if found is None:
                return False
            self.edges[end] = found
        return True


def packed_rows(batch: pa.RecordBatch) -> Rows | None:
    """The rows of packed graphs; None if there is more to one than nodes and edges without features, or less."""
    if any(batch.column(name).null_count < batch.num_rows for name in ("functions", "modules", "features")):
        return None
    nodes, edges = _fields(batch.column("nodes"), ("node_id", *_FIELDS["Node"])), _fields(batch.column("edges"), _FIELDS["Edge"])
    if nodes is None or edges is None or not {"node_id", "text"} <= nodes.keys() or batch.column("nodes").flatten().field("node_id").null_count:
        return None
    return Rows(nodes, edges, sizes(batch, "nodes"), sizes(batch, "edges"))


def _rows(kind: str, fields: dict, text: bool, indent: int) -> pa.Array:
    """The body of each row."""

    def render(field: str) -> Callable[[int | str], bytes]:
        return lambda x: wire.to_text(kind, {field: x}, indent).encode() if text else wire.encode(kind, {field: x})

    parts = []
    for field in _FIELDS[kind]:
        if field == "text":
            coded = fields[field].dictionary_encode()
            parts.append(pa.array([render(field)(x) for x in coded.dictionary.to_pylist()], pa.binary()).take(coded.indices))
        elif field in fields:
            parts.append(_table(fields[field], render(field)))
    return _joined(*parts)


def _together(count: np.ndarray, rows: pa.Array) -> pa.Array:
    """The rows of each graph, one after the other."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), rows), pa.scalar(b"", pa.binary()))


def encoded(graphs: Rows | None, encoding: str, as_list: bool) -> list[bytes] | None:
    """The message of each graph, or None if not all are plain."""
    plain = encoding.removesuffix(".gz")
    text, indent, parts = plain != "pb", int(as_list), []
    if graphs is None or plain not in ("pb", "pbtxt", "txt") or not graphs.placed() or pc.sum(pc.binary_length(graphs.nodes["text"])).as_py() > MOST_TEXT:
        return None
    for x, names in ((graphs.nodes.get("type"), wire.NODE_TYPES), (graphs.edges.get("flow"), wire.FLOWS)):
        if text and x is not None and len(x) and (x.min() < 0 or x.max() >= len(names)):
            return None
    for kind, fields, count in (("Node", graphs.nodes, graphs.count), ("Edge", graphs.edges, graphs.degree)):
        parts.append(_together(count, _wrapped("ProgramGraph", kind.lower(), _rows(kind, fields, text, indent + 1), text, indent)))
    whole = _joined(*parts)
    data = (_wrapped("ProgramGraphList", "graph", whole, text, 0) if as_list else whole).to_pylist()
    return [zipped(x) for x in data] if encoding.endswith(".gz") else data


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut so that parts have about ``MOST_ROWS`` nodes and edges, or one graph."""
    for start, end in cuts(1 + sizes(batch, "nodes") + sizes(batch, "edges"), MOST_ROWS):
        yield batch.slice(start, end - start)


def whole_graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of about ``MOST_HELD`` bytes that end where a graph ends, and where each graph begins; a graph's rows follow each other."""
    held, n = [], 0

    def cut(last: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        nonlocal held, n
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids = rows.column("graph_id")
        number, absent = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        begins = np.append(0, 1 + np.flatnonzero((np.diff(number) != 0) | (np.diff(absent.astype(np.int8)) != 0)))
        end = rows.num_rows if last else int(begins[-1])
        if end:
            yield rows.slice(0, end), begins if last else begins[:-1]
        held, n = [rows.slice(end)], 0  # a long graph is looked at again when there is as much more of it

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.nbytes
        if n >= MOST_HELD:
            yield from cut(False)
    if any(x.num_rows for x in held):
        yield from cut(True)


def _order(*keys: np.ndarray) -> np.ndarray:
    """``np.lexsort``, first key first, by one key where all fit in it."""
    low = [int(x.min()) if len(x) else 0 for x in keys]
    bits = [(int(x.max()) - at).bit_length() if len(x) else 0 for x, at in zip(keys, low, strict=True)]
    if sum(bits) > 62:
        return np.lexsort(keys[::-1])
    key = np.zeros(len(keys[0]), np.int64)
    for x, at, n in zip(keys, low, bits, strict=True):
        key = key << n | x - at
    return np.argsort(key, kind="stable")


def clustered_rows(batch: pa.RecordBatch, begins: np.ndarray) -> Rows | None:
    """Nodes by id and edges by ``flow, source, target, position`` of rows as ``sources.orders.order_rows`` has them; None if one lacks a number."""
    graph, out = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, batch.num_rows))), []
    for name, by in (("nodes", ("node_id", "type")), ("edges", ("flow", "source", "target", "position"))):
        inner, of = batch.column(name).flatten(), np.repeat(graph, sizes(batch, name))
        there = inner.is_valid()
        inner, of = inner.filter(there), of[there.to_numpy(zero_copy_only=False)]
        fields = dict(zip([f.name for f in inner.type], inner.flatten(), strict=True))
        if any(fields[x].null_count for x in by):
            return None
        order = _order(of, *[fields[x].to_numpy() for x in by])
        out.append({x: pc.fill_null(v.take(pa.array(order)), "") if x == "text" else v.to_numpy()[order] for x, v in fields.items()})
        out.append(np.bincount(of, minlength=len(begins)))
    nodes, count, edges, degree = out
    return Rows(nodes, edges, count, degree)


def zipped(data: bytes) -> bytes:
    """``gzip.compress`` with no time, and with small tables for what is small."""
    bits = min(15, max(9, len(data).bit_length()))
    made = zlib.compressobj(9, zlib.DEFLATED, 16 + bits, max(1, min(8, bits - 7)))
    return made.compress(data) + made.flush()


def unzipped(data: bytes) -> bytes:
    """``gzip.decompress``, which also takes what is not a single whole member."""
    made = zlib.decompressobj(31)
    try:
        found = made.decompress(data)
    except zlib.error:
        return gzip.decompress(data)
    return found if made.eof and not made.unused_data else gzip.decompress(data)


# reading

_LINE = rb'    \w+: (?:[-+.\w]+|"(?:[^"\\\n]|\\[^\n])*")\n'
_BLOCK = re.compile(rb"  (?:node|edge|function|module) \{\n(?:" + _LINE + rb")*")


#: With fewer graphs than this left, fields are looked for graph by graph.
_FEW = 24


def _fields_of(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Blocks of graphs, and how many each has: a field with its tag, or all from the first that is not short and of a low number."""
    data = b"".join(bodies)
    raw, ends = np.frombuffer(data + b"\0\0", np.uint8), np.cumsum([len(x) for x in bodies])
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    starts = np.zeros(len(data) + 1, bool)
    starts[-1] = True
    live = np.flatnonzero(begins < ends)
    at, end = begins[live], ends[live]
    while len(at) >= _FEW:
        starts[at] = True
        stop = at + 2 + raw[at + 1]
        stop = np.where((raw[at] & 135 == 2) & (raw[at + 1] < 128) & (stop <= end), stop, end)
        more = stop < end
        at, end = stop[more], end[more]
    for here, last in zip(at.tolist(), end.tolist(), strict=True):
        while here < last:
            starts[here] = True
            stop = here + 2 + data[here + 1] if here + 1 < last else last + 1
            here = stop if stop <= last and data[here] & 135 == 2 and data[here + 1] < 128 else last
    offsets = np.flatnonzero(starts)
    blocks = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return blocks, np.searchsorted(offsets, ends) - np.searchsorted(offsets, begins)


def _binary(message: str, data: bytes) -> list[bytes] | None:
    """The bytes of each graph."""
    if message == "ProgramGraph":
        return [data]
    out, at = [], 0
    while at < len(data):
        if data[at] != 18:
            return None
        size, at = wire._read_varint(data, at + 1)
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out


def _lines(message: str, data: bytes) -> list[bytes] | None:
    """The text of each graph of a list as ``wire.to_text`` writes it."""
    if message != "ProgramGraphList" or not data.startswith(b"graph {\n") or not data.endswith(b"}\n"):
        return None
    return data[8:-2].split(b"}\ngraph {\n")


def _rows_of(bodies: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Blocks of graphs in text, one for each row, and how many each has; what does not end in a row is a block too."""
    split = [x.split(b"  }\n") for x in bodies]
    for x in split:
        if not x[-1]:
            x.pop()
    return pa.array([b for x in split for b in x], pa.binary()), np.array([len(x) for x in split], np.int64)


def _text_of(block: bytes) -> dict:
    if not _BLOCK.fullmatch(block):
        raise ValueError("not a row of its own")
    return wire.from_text("ProgramGraph", block.decode() + "}\n")


class Reader:
    """Rows of one part of many messages.

    A block is some fields of a graph; blocks one after the other mean what their fields mean.
    ``rows_of`` makes the rows of a graph's parts of its message.
    """

    def __init__(self, part: str, schema: pa.Schema, message: str, encoding: str, rows_of: Callable[[dict], dict]):
        self.part, self.schema, self.message, self.encoding, self.rows_of = part, schema, message, encoding, rows_of
        plain = encoding.removesuffix(".gz")
        self.graphs, self.split, self.one = {"pb": (_binary, _fields_of, lambda x: wire.decode("ProgramGraph", x)), "pbtxt": (_lines, _rows_of, _text_of)}.get(plain, (lambda *_: None, _fields_of, None))
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes, self.total = 0, 0
        self.begin, self.count, self.fresh = [], [], []
        self.table = pa.RecordBatch.from_pylist([], schema=self.schema)

    def add(self, rows: list[dict]) -> int:
        """The number under which rows are kept."""
        self.begin.append(self.total)
        self.count.append(len(rows))
        self.total += len(rows)
        self.fresh += rows
        return len(self.begin) - 1

    def learn(self, block: bytes) -> int:
        """The number of a block's rows, -1 if it can't be read by itself."""
        if block not in self.known:
            try:
                self.known[block] = self.add(self.rows_of(self.one(block))[self.part])
            except (ValueError, OSError, IndexError, TypeError, EOFError):
                self.known[block] = -1
            self.bytes += len(block)
        return self.known[block]

    def whole(self, data: bytes | None) -> list[int]:
        """The number of each graph's rows, read as one message; none of what is null or can't be read."""
        if data is None:
            return []
        try:
            found = wire.loads(self.message, data, self.encoding)
            rows = [self.rows_of(g)[self.part] for g in (found["graph"] if self.message == "ProgramGraphList" else [found])]
        except (ValueError, OSError, IndexError, TypeError, EOFError):
            return []
        return [self.add(x) for x in rows]

    def bodies(self, data: bytes | None) -> list[bytes] | None:
        """The graphs of a message, None if it is not plain, or none at all."""
        try:
            return None if data is None else self.graphs(self.message, unzipped(data) if self.encoding.endswith(".gz") else data)
        except (ValueError, OSError, EOFError):
            return None

    def read(self, contents: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
        """For each row the place of its message and its own in its graph, and the rows."""
        if len(self.known) > MOST_KNOWN or self.total > 4 * MOST_KNOWN or self.bytes > KNOWN_BYTES:
            self.forget()
        found = [self.bodies(x) for x in contents]
        of = np.repeat(np.arange(len(found)), [0 if x is None else len(x) for x in found])
        blocks, sized = self.split([g for x in found if x is not None for g in x])
        blocks = blocks.dictionary_encode()
        code = np.array([self.learn(x) for x in blocks.dictionary.to_pylist()], np.int64)[blocks.indices.to_numpy()]
        alone = np.array([x is None for x in found], bool)
        alone[np.repeat(of, sized)[code < 0]] = True
        if alone.any():
            code, sized, of = code[~np.repeat(alone[of], sized)], sized[~alone[of]], of[~alone[of]]
            for i in np.flatnonzero(alone).tolist():
                more = self.whole(contents[i])
                code, sized, of = (np.append(x, y).astype(np.int64) for x, y in ((code, more), (sized, [1] * len(more)), (of, [i] * len(more))))
        if self.fresh:
            self.table = pa.Table.from_batches([self.table, pa.RecordBatch.from_pylist(self.fresh, schema=self.schema)]).combine_chunks().to_batches()[0]
            self.fresh = []
        begin, count = np.array(self.begin, np.int64)[code], np.array(self.count, np.int64)[code]
        before, rows = np.cumsum(count) - count, int(count.sum())
        graph = np.repeat(np.repeat(np.arange(len(sized)), sized), count)
        first = np.searchsorted(graph, np.arange(len(sized)))
        at = np.arange(rows)
        return of[graph], at - first[graph], self.table.take(pa.array(np.repeat(begin - before, count) + at))


def cut(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch cut so that the messages of a part have about ``MOST_BYTES``, or it has one."""
    for start, end in cuts(64 + pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False), MOST_BYTES):
        yield batch.slice(start, end - start)
