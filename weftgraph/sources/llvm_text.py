"""Program graphs of LLVM assembly text (typed pointers, the syntax up to version 14).

A reader of lines and typed operands, not a compiler: it knows what each instruction's
operands are and where control goes, and leaves the rest of the text alone.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import lru_cache

from weftgraph.schema import CALL, CONSTANT, CONTROL, DATA, INSTRUCTION, ROOT_TEXT, TYPE, TYPE_FLOW, VARIABLE, GraphCreationError

_NAME = r'(?:[-a-zA-Z$._][-a-zA-Z$._0-9]*|\d+|"(?:[^"\\]|\\.)*")'
_TOP = re.compile(rf"source_filename|target |module asm|attributes|uselistorder|declare|define|!|[%@$^]{_NAME} *=|\^\d+ *=|;|$")
_LABEL = re.compile(rf"^({_NAME}):")
_OLD_LABEL = re.compile(r"^; <label>:(\d+)")
_DEFINE = re.compile(rf"^(define|declare)\b(.*?)@({_NAME})\s*\(")
_NAMED = re.compile(rf"%{_NAME}")
_POINTER, _BRACKET = re.compile(r"\s*addrspace\(\d+\)\*|\s*\*"), re.compile(r"\s*\(")
_TYPE_LINE = re.compile(rf"(%{_NAME})\s*=\s*type\s+(.*)")
_SOURCE_LINE = re.compile(r'source_filename\s*=\s*"(.*)"')
_GOES_ON = re.compile(r"(?:catch|filter|cleanup|to label|unwind)\b")
_PROFILE = re.compile(r"!prof\s+(!\d+)")
_SIMPLE = re.compile(r"i\d+|void|half|bfloat|float|double|fp128|x86_fp80|ppc_fp128|x86_mmx|label|token|metadata|ptr|opaque")
#: Words that may stand between an opcode and its first typed operand.
_FLAGS = re.compile(r"^(?:(?:nuw|nsw|exact|inbounds|volatile|atomic|weak|fast|nnan|ninf|nsz|arcp|contract|afn|reassoc|tail|musttail|notail|inalloca|swifterror|cleanup|zeroext|signext|inreg|noalias|nonnull|ccc|fastcc|coldcc|cc \d+|addrspace\(\d+\)|dereferenceable(?:_or_null)?\(\d+\)|align \d+|noundef|x86_\w+|spir_\w+)\s+)*")
_NO_OPERAND = re.compile(r"^(?:align \d+|![\w.]+|syncscope\(.*|unordered|monotonic|acquire|release|acq_rel|seq_cst|addrspace\(.*|#\d+|to |unwind |within |from )")
_TERMINATORS = {"ret", "br", "switch", "indirectbr", "invoke", "resume", "unreachable", "cleanupret", "catchret", "catchswitch", "callbr"}


def split_top(text: str, mark: str = ",") -> list[str]:
    """Split at marks outside brackets and strings."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted:
            if c in "([{<":
                depth += 1
            elif c in ")]}>":
                depth -= 1
            elif c == mark and not depth:
                out.append(text[start:i].strip())
                start = i + 1
    last = text[start:].strip()
    return [*out, last] if last else out


def _closing(text: str, at: int) -> int:
    pairs, depth = {"(": ")", "[": "]", "{": "}", "<": ">"}, []
    for i in range(at, len(text)):
        if text[i] in pairs:
            depth.append(pairs[text[i]])
        elif depth and text[i] == depth[-1]:
            depth.pop()
            if not depth:
                return i
    raise GraphCreationError(f"error: no closing bracket in: {text}")


def read_type(text: str) -> tuple[str, str]:
    """The type that a text begins with, and what follows it."""
    text = text.strip()
    if text[:1] in "[{<":
        end = _closing(text, 0) + 1
    elif m := _NAMED.match(text) or _SIMPLE.match(text):
        end = m.end()
    else:
        return "", text
    while True:
        rest = text[end:]
        if m := _POINTER.match(rest):
            end += m.end()
        elif (m := _BRACKET.match(rest)) and _is_signature(rest[m.end() - 1 :]):
            end = _closing(text, end + m.end() - 1) + 1
        else:
            return text[:end].strip(), rest.strip()


def _is_signature(text: str) -> bool:
    """Whether brackets hold types alone: then they belong to a function type."""
    inside = text[1 : _closing(text, 0)]
    return all(part == "..." or (read_type(part)[0] and not read_type(part)[1]) for part in split_top(inside))


@dataclass
class Instruction:
    opcode: str
    text: str
    result: str | None
    operands: list[tuple[str, str] | None] = field(default_factory=list)  # (type, value); None: a block, metadata, assembly
    successors: list[str] = field(default_factory=list)
    callee: str | None = None
    profile: str | None = None  # the metadata that holds its weights


def _operand(text: str) -> tuple[str, str] | None:
    kind, value = read_type(_FLAGS.sub("", text))
    if not kind or kind in ("label", "metadata"):
        return None
    value = _FLAGS.sub("", value + " ").strip()
    return kind, value


def _plain(parts: list[str]) -> list[tuple[str, str] | None]:
    """Typed operands; one without a type has that of the operand before."""
    out: list[tuple[str, str] | None] = []
    for part in parts:
        if _NO_OPERAND.match(part) or not part:
            continue
        kind, value = read_type(part)
        if kind and value or kind == "label":
            out.append(_operand(part))
        elif out and out[-1]:
            out.append((out[-1][0], part.strip()))
    return out


def _call(rest: str) -> tuple[list[tuple[str, str] | None], str | None, str]:
    """(operands with the callee last, name of the function called directly, what follows)."""
    rest = _FLAGS.sub("", rest)
    kind, after = read_type(rest)
    if after.startswith("asm"):
        start = after.index("(", after.rindex('"'))
        callee, name = None, None
    else:
        m = re.match(rf"([@%])({_NAME})\s*\(", after)
        start = m.end() - 1 if m else after.index("(")
        name = m[2].strip('"') if m and m[1] == "@" else None
        callee = None if name else (f"{kind}*", after[:start].strip())
    end = _closing(after, start)
    args = [_operand(x) for x in split_top(after[start + 1 : end])]
    return [*args, callee], name, after[end + 1 :]


def read_instruction(line: str) -> Instruction:
    bare = line.split(" ; ")[0].strip()
    text = re.sub(r"(?:,\s*![\w.]+\s+!\w+)+\s*$", "", bare)
    prof = re.search(r"!prof\s+(!\d+)", bare[len(text) :])
    m = re.match(rf"(%{_NAME})\s*=\s*", text)
    result, rest = (m[1], text[m.end() :]) if m else (None, text)
    rest = re.sub(r"^(?:tail|musttail|notail)\s+", "", rest)
    m = re.match(r"[a-z_]+[a-z0-9_.]*", rest)
    if not m:
        raise GraphCreationError(f"error: expected instruction opcode: {line}")
    op, rest = m[0], rest[m.end() :].strip()
    made = Instruction(op, text, result, profile=prof and prof[1])
    labels = [x.strip('"') for x in re.findall(rf"label %({_NAME})", rest)]
    parts = split_top(_FLAGS.sub("", rest + " ").strip())
    if op == "br":
        made.successors = labels
        made.operands = [None] if len(labels) == 1 else [_operand(parts[0]), None, None]
    elif op == "switch":
        made.successors = labels
        value, _, cases = rest.partition("[")
        made.operands = [_operand(split_top(value)[0]), None]
        for case in re.findall(r"(i\d+ \S+?),\s*label", cases):
            made.operands += [_operand(case.strip()), None]
    elif op in ("call", "invoke"):
        made.operands, made.callee, after = _call(rest)
        if op == "invoke":
            made.successors = [x.strip('"') for x in re.findall(rf"label %({_NAME})", after)]
            made.operands[-1:-1] = [None, None]
            made.callee = None
    elif op == "phi":
        kind, pairs = read_type(_FLAGS.sub("", rest))
        made.operands = [(kind, split_top(x[1:-1])[0]) for x in split_top(pairs) if x.startswith("[")]
    elif op == "alloca":
        sizes = [x for x in parts[1:] if not _NO_OPERAND.match(x)]
        made.operands = _plain(sizes) or [("i32", "1")]
    elif op in ("load", "getelementptr"):
        made.operands = _plain(parts[1:])
    elif op in ("icmp", "fcmp", "atomicrmw"):
        made.operands = _plain([parts[0].partition(" ")[2], *parts[1:]])
    elif op in ("extractvalue", "insertvalue"):
        made.operands = _plain([x for x in parts if not re.fullmatch(r"\d+", x)])
    elif op == "ret":
        made.operands = [] if rest.startswith("void") else _plain(parts)
    elif op == "landingpad":
        made.operands = [_operand(x) for x in re.findall(r"(?:catch|filter)\s+([^\n]+?)(?=\s+catch|\s+filter|$)", rest)]
    elif op in ("fence", "unreachable"):
        pass
    elif op in _TERMINATORS:
        made.operands, made.successors = _plain(parts), labels
    else:
        made.operands = _plain([re.split(r"\s+to\s+", parts[0])[0], *parts[1:]] if parts else [])
    return made


#: Modules repeat lines: what was read of one serves all. Nothing changes an instruction once it is read.
_instruction = lru_cache(maxsize=1 << 14)(read_instruction)


@lru_cache(maxsize=1 << 12)
def _header(line: str) -> tuple[str, str, list[tuple[str, str]], str | None] | None:
    """Kind, name, arguments and profile of the first line of a function or declaration."""
    m = _DEFINE.match(line)
    if not m:
        return None
    end = _closing(line, m.end() - 1)
    arguments = []
    for i, x in enumerate(split_top(line[m.end() : end])):
        if x != "..." and (kind := read_type(_FLAGS.sub("", x))[0]):
            found = re.search(rf"(%{_NAME})$", x[len(kind) :]) if m[1] == "define" else None
            arguments.append((kind, found[1] if found else f"%{i}"))
    prof = _PROFILE.search(line)
    return m[1], m[3].strip('"'), arguments, prof and prof[1]


@dataclass
class Routine:
    name: str
    arguments: list[tuple[str, str]]
    blocks: list[tuple[str, list[Instruction]]]  # none: a declaration
    profile: str | None = None


_NODE = re.compile(r"(![\w.]+)\s*=\s*(?:distinct\s+)?!\{(.*)\}")


def read_metadata(text: str) -> dict[str, list[str]]:
    """The members of each numbered or named metadata node."""
    return {m[1]: split_top(m[2]) for m in map(_NODE.match, text.split("\n")) if m}


def _weights(nodes: dict[str, list[str]], name: str | None, kind: str) -> list[int]:
    """The numbers of a profile node of a kind."""
    found = nodes.get(name or "", [])
    return [int(x.split()[-1]) for x in found[1:]] if found and found[0] == f'!"{kind}"' else []


def instruction_profile(nodes: dict[str, list[str]], row: Instruction) -> dict[str, int]:
    """Total weight, and of two ways the true and the false one."""
    weights = _weights(nodes, row.profile, "branch_weights")
    if not weights:
        return {}
    ways = {"llvm_profile_true_weight": weights[0], "llvm_profile_false_weight": weights[1]} if len(weights) == 2 and row.opcode in ("br", "select") else {}
    return {"llvm_profile_total_weight": sum(weights)} | ways


#: Members of a profile summary and the features that hold them.
SUMMARY = {"NumFunctions": "num_functions", "MaxFunctionCount": "max_function_count", "NumCounts": "num_counts", "TotalCount": "total_count", "MaxCount": "max_count", "MaxInternalCount": "max_internal_count"}


def module_profile(nodes: dict[str, list[str]]) -> dict[str, int]:
    """The profile summary among the module's flags."""
    for flag in nodes.get("!llvm.module.flags", ()):
        members = nodes.get(flag, [])
        if len(members) == 3 and members[1] == '!"ProfileSummary"':
            pairs = [nodes.get(x, []) for x in nodes.get(members[2], [])]
            return {f"llvm_profile_{SUMMARY[key]}": int(pair[1].split()[-1]) for pair in pairs if len(pair) == 2 for key in [pair[0].strip('!"')] if key in SUMMARY}
    return {}


def text_components(line: str, result_type: str = "") -> dict[str, str]:
    """The parts of an instruction's text: the whole, left and right of its sign, name and type of the left, opcode.

    The left side's type is given, as the text does not always hold it; one of structs is ``struct``.
    """
    row = read_instruction(line)
    left, sign, right = row.text.partition(" = ")
    if not sign:
        return {"text": row.text, "lhs": "", "rhs": "", "lhs_identifier": "", "lhs_type": "", "opcode_name": row.opcode}
    base = result_type.rstrip("*")
    shown = f"struct{result_type[len(base) :]}" if base.startswith(("{", "<{", "%")) else result_type
    return {"text": row.text, "lhs": f"{shown} {left}", "rhs": right, "lhs_identifier": left, "lhs_type": shown, "opcode_name": row.opcode}


def read_module(text: str) -> tuple[str, dict[str, str], list[Routine]]:
    """Name, named types, and functions of a module."""
    name, types, routines = "<stdin>", {}, []
    lines = text.split("\n")
    at = 0
    while at < len(lines):
        line = lines[at].strip()
        at += 1
        if not _TOP.match(line):
            raise GraphCreationError(f"{at}:1: error: expected top-level entity\n{line}\n^")
        if m := _SOURCE_LINE.match(line):
            name = m[1]
        elif m := _TYPE_LINE.match(line):
            types[m[1]] = m[2].strip()
        elif found := _header(line):
            kind, function, arguments, profile = found
            blocks: list[tuple[str, list[Instruction]]] = []
            if kind == "define":
                if not line.rstrip().endswith("{"):
                    raise GraphCreationError(f"{at}:1: error: expected '{{' in function body")
                unnamed = sum(bool(re.fullmatch(r"%\d+", v)) for _, v in arguments)
                blocks.append((str(unnamed), []))
                while True:
                    if at >= len(lines):
                        raise GraphCreationError(f"{at}:1: error: found end of file when expecting more instructions")
                    line = lines[at].strip()
                    at += 1
                    if line == "}":
                        break
                    label = (_OLD_LABEL.match(line) or _LABEL.match(line)) if ":" in line else None
                    if label:
                        if blocks[-1][1] or len(blocks) > 1:
                            blocks.append((label[1].strip('"'), []))
                        else:
                            blocks[-1] = (label[1].strip('"'), [])
                    elif line and not line.startswith(";"):
                        while line.count("[") > line.count("]") and at < len(lines):  # a switch over lines
                            line += " " + lines[at].strip()
                            at += 1
                        if _GOES_ON.match(line) and blocks[-1][1]:
                            line = f"{blocks[-1][1].pop().text} {line}"
                        try:
                            blocks[-1][1].append(_instruction(line))
                        except GraphCreationError as e:
                            raise GraphCreationError(f"{at}:1: {e}\n{line}\n^") from e
                if any(not rows for _, rows in blocks):
                    raise GraphCreationError(f"{at}:1: error: expected instruction opcode")
            routines.append(Routine(function, arguments, blocks, profile))
    return name, types, routines


class _Builder:
    def __init__(self, types: dict[str, str], metadata: dict[str, list[str]] | None = None):
        self.metadata = metadata or {}
        self.nodes: list[tuple] = []
        self.edges: list[tuple[int, int, int, int]] = []
        self.named, self.shared, self.open = types, {}, {}
        self.block = 0
        self.node(INSTRUCTION, ROOT_TEXT, None, 0)

    def node(self, kind: int, text: str, full: str | None, function: int, features: dict[str, int] | None = None) -> int:
        self.nodes.append((kind, text, full, function, self.block, features))
        return len(self.nodes) - 1

    def edge(self, flow: int, position: int, source: int, target: int) -> None:
        self.edges.append((flow, position, source, target))

    def value(self, kind: int, text: str, type_name: str, value: str, function: int) -> int:
        at = self.node(kind, text, f"{type_name} {value}", function)
        self.open = {}
        self.edge(TYPE_FLOW, 0, self.type_of(type_name), at)
        return at

    def type_of(self, name: str) -> int:
        if name not in self.shared:
            self.shared[name] = self.new_type(name)
        return self.shared[name]

    def new_type(self, name: str) -> int:
        body = self.named.get(name, name)
        if body is name and _SIMPLE.fullmatch(name) and name != "opaque":
            at = self.node(TYPE, name, name, 0)
        elif m := re.fullmatch(r"(.*?)\s*(?:addrspace\(\d+\))?\*", name, re.S):
            at = self.node(TYPE, "*", name, 0)
            inner = m[1]
            self.edge(TYPE_FLOW, 0, self.open[inner] if inner in self.open else self.type_of(inner), at)
        elif body[:1] == "{" or body[:2] == "<{" or body == "opaque":
            at = self.node(TYPE, "struct", f"{name} = type {body}" if name in self.named else name, 0)
            self.open[name] = at
            inside = body.strip("<>").strip()[1:-1] if body != "opaque" else ""
            for i, member in enumerate(split_top(inside)):
                self.edge(TYPE_FLOW, i, self.new_type(member), at)
        elif m := re.fullmatch(r"([\[<])\s*(?:vscale x )?\d+ x (.*)[\]>]", name, re.S):
            at = self.node(TYPE, "[]" if m[1] == "[" else "vector", name, 0)
            self.edge(TYPE_FLOW, 0, self.type_of(m[2].strip()), at)
        else:
            at = self.node(TYPE, name, name, 0)
        return at


#: The fields of a graph's rows, which are tuples, but for ``node_id`` and ``edge_id``, their places.
NODE_FIELDS = ("type", "text", "full_text", "function", "block", "features")
EDGE_FIELDS = ("flow", "position", "source", "target")


def build_graph(text: str, **options: bool) -> dict:
    """Nodes, edges, functions and modules of one module's text, as dicts."""
    made = build_rows(text, **options)
    nodes, edges = ([{key: i, **dict(zip(fields, row, strict=True))} for i, row in enumerate(made[part])] for part, key, fields in (("nodes", "node_id", NODE_FIELDS), ("edges", "edge_id", EDGE_FIELDS)))
    return {**made, "nodes": nodes, "edges": edges}


def build_rows(text: str, instructions_only: bool = False, ignore_call_returns: bool = False, strict: bool = False) -> dict:
    """The same with nodes and edges as tuples of ``NODE_FIELDS`` and ``EDGE_FIELDS``."""
    name, types, routines = read_module(text)
    metadata = read_metadata(text) if "!prof" in text or "ProfileSummary" in text else {}
    made = _Builder(types, metadata)
    known = {r.name for r in routines}
    constants: dict[tuple[str, str], list[tuple[int, int]]] = {}
    calls: list[tuple[int, str]] = []
    ends: dict[str, tuple[int, list[int]]] = {}
    for index, routine in enumerate(routines):
        ends[routine.name] = _visit(made, routine, index, known, constants, calls, instructions_only)
    for entry, leaving in ends.values():
        _connect_call(made, 0, entry, leaving, ignore_call_returns)
    for site, callee in calls:
        _connect_call(made, site, *ends[callee], ignore_call_returns)
    for (kind, value), users in constants.items():
        at = made.value(CONSTANT, "val", kind, value, 0)
        for user, position in users:
            made.edge(DATA, position, at, user)
    if strict:
        touched = {x for e in made.edges for x in e[2:]}
        if not routines or len(touched) < len(made.nodes):
            raise GraphCreationError("module is empty or has unconnected nodes")
    counts = [_weights(metadata, r.profile, "function_entry_count") for r in routines]
    functions = [{"function_id": i, "name": r.name, "module_id": 0, "features": {"llvm_profile_entry_count": c[0]} if c else None} for i, (r, c) in enumerate(zip(routines, counts, strict=True))]
    return {"nodes": made.nodes, "edges": made.edges, "functions": functions, "modules": [{"module_id": 0, "name": name, "features": module_profile(metadata) or None}]}


def _connect_call(made: _Builder, site: int, entry: int, leaving: list[int], ignore_returns: bool) -> None:
    made.edge(CALL, 0, site, entry)
    for at in () if ignore_returns else leaving:
        made.edge(CALL, 0, at, site)


def _visit(made: _Builder, routine: Routine, index: int, known: set[str], constants: dict, calls: list, instructions_only: bool) -> tuple[int, list[int]]:
    if not routine.blocks:
        at = made.node(INSTRUCTION, "; undefined function", "", index)
        return at, [at]
    producers: dict[str, int] = {}
    arguments = {value: kind for kind, value in routine.arguments}
    uses: dict[str, list[tuple[int, int]]] = {}
    waiting: list[tuple[str, int]] = []
    spans: dict[str, tuple[int, int, list[str]]] = {}
    for label, rows in routine.blocks:
        ids = []
        for row in rows:
            at = made.node(INSTRUCTION, row.opcode, row.text, index, (instruction_profile(made.metadata, row) or None) if made.metadata else None)
            if ids:
                made.edge(CONTROL, 0, ids[-1], at)
            ids.append(at)
            if row.result:
                producers[row.result] = at
            if row.callee in known:
                calls.append((at, row.callee))
            for position, operand in enumerate(row.operands):
                if operand is None or instructions_only or (operand[1].startswith("@") and operand[1][1:].strip('"') in known):
                    continue
                kind, value = operand
                if value in arguments:
                    uses.setdefault(value, []).append((at, position))
                elif value.startswith("%"):
                    variable = made.value(VARIABLE, "var", kind, value, index)
                    made.edge(DATA, position, variable, at)
                    waiting.append((value, variable))
                else:
                    constants.setdefault((kind, value), []).append((at, position))
        made.block += 1
        spans[label] = (ids[0], ids[-1], rows[-1].successors)
    for value, users in uses.items():
        at = made.value(VARIABLE, "var", arguments[value], value, index)
        for user, position in users:
            made.edge(DATA, position, at, user)
    for value, variable in waiting:
        if value not in producers:
            raise GraphCreationError(f"error: use of undefined value '{value}'")
        made.edge(DATA, 0, producers[value], variable)
    first = routine.blocks[0][0]
    seen, queue, leaving = {first}, deque([first]), []
    while queue:
        _, last, after = spans[queue.popleft()]
        for position, label in enumerate(after):
            if label not in spans:
                raise GraphCreationError(f"error: use of undefined value '%{label}'")
            made.edge(CONTROL, position, last, spans[label][0])
            if label not in seen:
                seen.add(label)
                queue.append(label)
        if not after:
            leaving.append(last)
    return spans[first][0], leaving
