"""The data model: codes of node types and edge flows, and table schemas.

Fixed values: the codes are those of the exchange format that graphs are read from and
written to.
"""

from __future__ import annotations

INSTRUCTION, VARIABLE, CONSTANT, TYPE = 0, 1, 2, 3
NODE_TYPES = ["INSTRUCTION", "VARIABLE", "CONSTANT", "TYPE"]
CONTROL, DATA, CALL, TYPE_FLOW = 0, 1, 2, 3
FLOWS = ["CONTROL", "DATA", "CALL", "TYPE"]
ROOT_TEXT = "[external]"

FEATURE = "struct<bytes: array<binary>, floats: array<float>, ints: array<bigint>>"
NODES = f"graph_id long, node_id long, type long, text string, function long, block long, features map<string, {FEATURE}>"
EDGES = f"graph_id long, edge_id long, flow long, position long, source long, target long, features map<string, {FEATURE}>"
FUNCTIONS = f"graph_id long, function_id long, name string, module_id long, features map<string, {FEATURE}>"
MODULES = f"graph_id long, module_id long, name string, features map<string, {FEATURE}>"

#: Operations whose operands may change places.
COMMUTATIVE = ["add", "fadd", "mul", "fmul", "or", "and", "xor"]


class GraphCreationError(ValueError):
    """A graph can't be made of an input."""


class GraphTransformError(ValueError):
    """A graph can't be brought into another form."""


class UnsupportedCompiler(TypeError):
    """No such compiler or version is known."""
