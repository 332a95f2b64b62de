"""The exchange format of program graphs: protobuf bytes, text format and JSON, with or without gzip.

A message is described by a table of its fields; one encoder and one decoder serve all.
Fixed values: field numbers and enum names are those of the format.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
from functools import lru_cache
from typing import Any

from weftgraph.schema import FLOWS, NODE_TYPES

#: Names of HLO's element types, by their codes.
PRIMITIVE_TYPES = ["PRIMITIVE_TYPE_INVALID", "PRED", "S8", "S16", "S32", "S64", "U8", "U16", "U32", "U64", "F16", "F32", "F64", "TUPLE", "OPAQUE_TYPE", "C64", "BF16", "TOKEN", "C128"]

#: Message: {field: (number, kind, repeated)}; a kind is a scalar, an enum's names, or a message.
MESSAGES: dict[str, dict[str, tuple[int, Any, bool]]] = {
    "BytesList": {"value": (1, "bytes", True)},
    "FloatList": {"value": (1, "float", True)},
    "Int64List": {"value": (1, "int", True)},
    "Feature": {"bytes_list": (1, "BytesList", False), "float_list": (2, "FloatList", False), "int64_list": (3, "Int64List", False)},
    "FeatureEntry": {"key": (1, "string", False), "value": (2, "Feature", False)},
    "Features": {"feature": (1, "FeatureEntry", True)},
    "FeatureList": {"feature": (1, "Feature", True)},
    "FeatureListEntry": {"key": (1, "string", False), "value": (2, "FeatureList", False)},
    "FeatureLists": {"feature_list": (1, "FeatureListEntry", True)},
    "Node": {"type": (1, NODE_TYPES, False), "text": (2, "string", False), "function": (4, "int", False), "block": (7, "int", False), "features": (8, "Features", False)},
    "Edge": {"flow": (1, FLOWS, False), "position": (2, "int", False), "source": (3, "int", False), "target": (4, "int", False), "features": (5, "Features", False)},
    "Function": {"name": (1, "string", False), "module": (2, "int", False), "features": (3, "Features", False)},
    "Module": {"name": (1, "string", False), "features": (2, "Features", False)},
    "ProgramGraph": {"node": (1, "Node", True), "edge": (2, "Edge", True), "function": (4, "Function", True), "module": (5, "Module", True), "features": (6, "Features", False)},
    "ProgramGraphList": {"context": (1, "Features", False), "graph": (2, "ProgramGraph", True)},
    "ProgramGraphFeatures": {"node_features": (1, "FeatureLists", False), "edge_features": (2, "FeatureLists", False), "function_features": (3, "FeatureLists", False), "module_features": (4, "FeatureLists", False), "features": (5, "Features", False)},
    "ProgramGraphFeaturesList": {"context": (1, "Features", False), "graph": (2, "ProgramGraphFeatures", True)},
    "Ir": {"type": (1, ["UNKNOWN", "LLVM", "XLA_HLO"], False), "compiler_version": (2, "int", False), "cmd": (3, "string", False), "text": (4, "string", False)},
    "IrList": {"ir": (1, "Ir", True)},
    "SourceFile": {"relpath": (1, "string", False), "language": (2, ["UNKNOWN", "C", "CXX", "OPENCL", "SWIFT", "HASKELL", "FORTRAN"], False), "text": (3, "string", False)},
    "Repo": {"url": (1, "string", False), "sha1": (2, "string", False), "created_ms_timestamp": (3, "int", False)},
    "NodeIndexList": {"node": (1, "int", True)},
    "Shape": {"element_type": (2, PRIMITIVE_TYPES, False), "dimensions": (3, "int", True)},
    "Literal": {"shape": (1, "Shape", False)},
    "HloInstruction": {"name": (1, "string", False), "opcode": (2, "string", False), "shape": (3, "Shape", False), "literal": (8, "Literal", False), "parameter_number": (9, "int", False), "id": (35, "int", False), "operand_ids": (36, "int", True), "control_predecessor_ids": (37, "int", True), "called_computation_ids": (38, "int", True)},
    "HloComputation": {"name": (1, "string", False), "instructions": (2, "HloInstruction", True), "id": (5, "int", False), "root_id": (6, "int", False)},
    "HloModule": {"name": (1, "string", False), "entry_computation_name": (2, "string", False), "computations": (3, "HloComputation", True), "id": (5, "int", False), "entry_computation_id": (6, "int", False)},
    "HloProto": {"hlo_module": (1, "HloModule", False)},
}


_BY_NUMBER = {message: {number: (name, kind, repeated) for name, (number, kind, repeated) in fields.items()} for message, fields in MESSAGES.items()}


def _nested(kind: Any) -> bool:
    return isinstance(kind, str) and kind in MESSAGES


_ONE_BYTE = [bytes([i]) for i in range(128)]


def _varint(value: int) -> bytes:
    value = int(value) & ((1 << 64) - 1)
    if value < 128:
        return _ONE_BYTE[value]
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _default(kind: Any) -> Any:
    return {"string": "", "bytes": b"", "float": 0.0, "int": 0}.get(kind, 0) if isinstance(kind, str) else 0


#: Rows without features repeat within and across graphs: what was made of one serves all equal ones.
_SMALL, _SMALL_BYTES = {name: [f for f in MESSAGES[name] if f != "features"] for name in ("Node", "Edge")}, 96


@lru_cache(maxsize=1 << 15)
def _row_encoded(kind: str, values: tuple) -> bytes:
    return encode(kind, dict(zip(_SMALL[kind], values, strict=True)))


@lru_cache(maxsize=1 << 15)
def _row_decoded(kind: str, data: bytes) -> dict:
    return decode(kind, data)


@lru_cache(maxsize=1 << 15)
def _row_text(kind: str, values: tuple, indent: int) -> str:
    return to_text(kind, dict(zip(_SMALL[kind], values, strict=True)), indent)


def _row_values(kind: str, value: dict) -> tuple | None:
    """The fields of a row without features."""
    return tuple([value.get(f) for f in _SMALL[kind]]) if kind in _SMALL and value.get("features") is None else None


def _part_encoded(kind: str, value: dict) -> bytes:
    values = _row_values(kind, value)
    return encode(kind, value) if values is None else _row_encoded(kind, values)


def _part_decoded(kind: str, data: bytes) -> dict:
    if kind not in _SMALL or len(data) > _SMALL_BYTES:
        return decode(kind, data)
    found = _row_decoded(kind, bytes(data))
    return dict(found) if found["features"] is None else decode(kind, data)


def _part_text(kind: str, value: dict, indent: int) -> str:
    values = _row_values(kind, value)
    return to_text(kind, value, indent) if values is None else _row_text(kind, values, indent)


def encode(message: str, value: dict) -> bytes:
    """Protobuf bytes of a message held as a dict; defaults are left out."""
    out = bytearray()
    for name, (number, kind, repeated) in MESSAGES[message].items():
        found = value.get(name)
        if found is None:
            continue
        scalar = kind in ("float", "int") or isinstance(kind, list)
        if repeated and scalar:
            packed = b"".join(struct.pack("<f", x) if kind == "float" else _varint(x) for x in found)
            out += _varint(number << 3 | 2) + _varint(len(packed)) + packed if found else b""
            continue
        for x in found if repeated else [found]:
            if _nested(kind):
                data = _part_encoded(kind, x)
            elif not repeated and x == _default(kind):
                continue
            elif scalar:
                out += _varint(number << 3 | (5 if kind == "float" else 0)) + (struct.pack("<f", x) if kind == "float" else _varint(x))
                continue
            else:
                data = x.encode() if kind == "string" else bytes(x)
            out += _varint(number << 3 | 2) + _varint(len(data)) + data
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the message ends too early")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def decode(message: str, data: bytes) -> dict:
    """The dict of protobuf bytes: scalars have defaults, absent messages are None, unknown fields are skipped."""
    fields, by_number = MESSAGES[message], _BY_NUMBER[message]
    out = {name: [] if repeated else None if _nested(kind) else _default(kind) for name, (_, kind, repeated) in fields.items()}
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        name, kind, repeated = by_number.get(tag >> 3, (None, None, False))
        wire = tag & 7
        if wire == 0:
            raw, at = _read_varint(data, at)
            found = [_signed(raw)]
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            found, at = [struct.unpack("<f", data[at : at + 4])[0]] if wire == 5 else [0], at + size
        elif wire == 2:
            size, at = _read_varint(data, at)
            if at + size > len(data):
                raise ValueError("the message ends too early")
            part, at = data[at : at + size], at + size
            if kind == "float":
                found = list(struct.unpack(f"<{size // 4}f", part))
            elif kind == "int" or isinstance(kind, list):
                found, i = [], 0
                while i < size:
                    raw, i = _read_varint(part, i)
                    found.append(_signed(raw))
            else:
                found = [part.decode("utf-8", "replace") if kind == "string" else part if kind == "bytes" else _part_decoded(kind, part) if kind else None]
        else:
            raise ValueError(f"wire type {wire} is not known")
        if name:
            if repeated:
                out[name] += found
            else:
                out[name] = found[-1]
    return out


def _quoted(data: bytes) -> str:
    named = {34: '\\"', 92: "\\\\", 10: "\\n", 13: "\\r", 9: "\\t"}
    return '"' + "".join(named.get(b) or (chr(b) if 32 <= b < 127 else f"\\{b:03o}") for b in data) + '"'


def to_text(message: str, value: dict, indent: int = 0) -> str:
    """Text format, one field a line."""
    pad, out = "  " * indent, []
    for name, (_, kind, repeated) in MESSAGES[message].items():
        found = value.get(name)
        for x in (found or []) if repeated else [] if found is None else [found]:
            if isinstance(kind, list):
                if x or repeated:
                    out.append(f"{pad}{name}: {kind[x]}\n")
            elif _nested(kind):
                out.append(f"{pad}{name} {{\n{_part_text(kind, x, indent + 1)}{pad}}}\n")
            elif repeated or x != _default(kind):
                shown = _quoted(x.encode() if isinstance(x, str) else bytes(x)) if kind in ("string", "bytes") else f"{x:.9g}" if kind == "float" else str(x)
                out.append(f"{pad}{name}: {shown}\n")
    return "".join(out)


_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<s>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<w>[-+.\w]+)|(?P<p>[{}<>:;,\[\]])""")


def _unquoted(token: str) -> bytes:
    named = {"n": 10, "r": 13, "t": 9, "a": 7, "b": 8, "f": 12, "v": 11}

    def one(m: re.Match) -> bytes:
        part = m[0].decode()
        if part[1] in "01234567":
            return bytes([int(part[1:], 8) & 255])
        if part[1] in "xX":
            return bytes([int(part[2:], 16)])
        return bytes([named[part[1]]]) if part[1] in named else part[1].encode()

    return re.sub(rb"\\(?:[0-7]{1,3}|[xX][0-9a-fA-F]{1,2}|.)", one, token[1:-1].encode())


def from_text(message: str, text: str) -> dict:
    """The dict of a message in text format."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    tokens.reverse()

    def scalar(kind: Any) -> Any:
        group, token = tokens.pop()
        if kind in ("string", "bytes"):
            data = _unquoted(token)
            while tokens and tokens[-1][0] == "s":
                data += _unquoted(tokens.pop()[1])
            return data.decode("utf-8", "replace") if kind == "string" else data
        if isinstance(kind, list):
            return kind.index(token) if token in kind else int(token)
        return float(token) if kind == "float" else int(token, 0)

    def body(of: str, end: str | None) -> dict:
        out = decode(of, b"")
        while tokens:
            group, token = tokens.pop()
            if token == end:
                return out
            if token in ",;":
                continue
            if token not in MESSAGES[of]:
                raise ValueError(f"{of} has no field {token}")
            _, kind, repeated = MESSAGES[of][token]
            if tokens and tokens[-1][1] == ":":
                tokens.pop()
            if _nested(kind):
                found = [body(kind, {"{": "}", "<": ">"}[tokens.pop()[1]])]
            elif tokens[-1][1] == "[":
                tokens.pop()
                found = []
                while tokens[-1][1] != "]":
                    found.append(scalar(kind))
                    if tokens[-1][1] == ",":
                        tokens.pop()
                tokens.pop()
            else:
                found = [scalar(kind)]
            if repeated:
                out[token] += found
            else:
                out[token] = found[-1]
        if end:
            raise ValueError(f"no {end} for {of}")
        return out

    return body(message, None)


def _json(message: str, value: dict) -> dict:
    import base64

    out = {}
    for name, (_, kind, repeated) in MESSAGES[message].items():
        found = value.get(name)
        if found is None or found == [] or not repeated and not isinstance(found, dict) and found == _default(kind):
            continue
        show = (lambda x, k=kind: k[x]) if isinstance(kind, list) else (lambda x, k=kind: _json(k, x)) if _nested(kind) else (lambda x: base64.b64encode(x).decode()) if kind == "bytes" else (lambda x: x)
        if kind in ("FeatureEntry", "FeatureListEntry"):
            out[name] = {x["key"]: _json(MESSAGES[kind]["value"][1], x["value"] or {}) for x in found}
        else:
            out[name] = [show(x) for x in found] if repeated else show(found)
    return out


def _from_json(message: str, value: dict) -> dict:
    import base64

    out = decode(message, b"")
    for name, found in value.items():
        _, kind, repeated = MESSAGES[message][name]
        if kind in ("FeatureEntry", "FeatureListEntry"):
            out[name] = [{"key": k, "value": _from_json(MESSAGES[kind]["value"][1], v)} for k, v in found.items()]
            continue
        take = (lambda x, k=kind: k.index(x) if x in k else x) if isinstance(kind, list) else (lambda x, k=kind: _from_json(k, x)) if _nested(kind) else base64.b64decode if kind == "bytes" else (lambda x: x)
        out[name] = [take(x) for x in found] if repeated else take(found)
    return out


def dumps(message: str, value: dict, encoding: str = "pb") -> bytes:
    """Bytes in ``pb``, ``pbtxt`` or ``json``, each also with ``.gz``."""
    plain = encoding.removesuffix(".gz")
    if plain == "pb":
        data = encode(message, value)
    elif plain in ("pbtxt", "txt"):
        data = to_text(message, value).encode()
    elif plain == "json":
        data = json.dumps(_json(message, value)).encode()
    else:
        raise TypeError(f"unknown encoding {encoding}; known are pb, pbtxt, json, each also with .gz")
    return gzip.compress(data, mtime=0) if encoding.endswith(".gz") else data


def loads(message: str, data: bytes, encoding: str = "pb") -> dict:
    if encoding.endswith(".gz"):
        data, encoding = gzip.decompress(data), encoding.removesuffix(".gz")
    if encoding == "pb":
        return decode(message, data)
    if encoding in ("pbtxt", "txt"):
        return from_text(message, data.decode())
    if encoding == "json":
        return _from_json(message, json.loads(data))
    raise TypeError(f"unknown encoding {encoding}; known are pb, pbtxt, json, each also with .gz")


def pretty_json(message: str, value: dict, longest: int | None = None) -> str:
    """Indented JSON; with ``longest`` texts are cut to that many characters, with dots."""

    def cut(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: cut(v) for k, v in x.items()}
        if isinstance(x, list):
            return [cut(v) for v in x]
        return f"{x[: longest - 3]}..." if longest and isinstance(x, str) and len(x) > longest else x

    return json.dumps(cut(_json(message, value)), indent=2, sort_keys=True)


class MissingField(ValueError):
    """A field that must be set is not, or breaks its rule."""


def is_readable(message: str, data: bytes, encoding: str = "pb") -> bool:
    """Whether bytes are a message."""
    try:
        loads(message, data, encoding)
    except (ValueError, TypeError, OSError, EOFError, KeyError, IndexError):
        return False
    return True


def check_set(message: str, value: dict, field: str, why: str | None = None) -> Any:
    """The field's value; an error where it is absent or its default."""
    _, kind, repeated = MESSAGES[message][field]
    found = value.get(field)
    if found is None or (repeated and not found) or (not repeated and not isinstance(found, dict) and found == _default(kind)):
        raise MissingField(why or f"field not set: {message}.{field}")
    return found


def check_rule(message: str, value: dict, field: str, rule, why: str | None = None) -> Any:
    """The field's value, which must be set and which ``rule`` must hold for."""
    found = check_set(message, value, field, why)
    if not rule(found):
        raise MissingField(why or f"field {message}.{field} is {found!r}")
    return found


def encoding_of(path: str) -> str:
    """The encoding that a file's suffix names."""
    zipped = ".gz" if path.endswith(".gz") else ""
    bare = path.removesuffix(".gz")
    return ("pbtxt" if bare.endswith((".pbtxt", ".txt")) else "json" if bare.endswith(".json") else "pb") + zipped
