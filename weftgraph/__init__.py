"""Program graphs and corpus preparation on Spark: the names most programs need."""

from weftgraph.operators.adapters import to_dgl, to_dicts, to_networkx
from weftgraph.operators.analysis import Analysis, run
from weftgraph.operators.builder import GraphBuilder
from weftgraph.operators.transforms import annotate_inst2vec, cdfg, dot_text, instruction_sequence, node_link_json
from weftgraph.schema import GraphCreationError, GraphTransformError, UnsupportedCompiler
from weftgraph.sources.compilers import CLANG_VERSIONS, from_clang, from_cpp
from weftgraph.sources.files import from_bytes, from_string, load_graphs, read_graphs, save_graphs, to_bytes, to_string
from weftgraph.sources.hlo import from_hlo, from_hlo_proto
from weftgraph.sources.ir import LLVM_VERSIONS, from_llvm_ir, unpack

__all__ = [
    "CLANG_VERSIONS",
    "LLVM_VERSIONS",
    "Analysis",
    "GraphBuilder",
    "GraphCreationError",
    "GraphTransformError",
    "UnsupportedCompiler",
    "annotate_inst2vec",
    "cdfg",
    "dot_text",
    "from_bytes",
    "from_clang",
    "from_cpp",
    "from_hlo",
    "from_hlo_proto",
    "from_llvm_ir",
    "from_string",
    "instruction_sequence",
    "load_graphs",
    "node_link_json",
    "read_graphs",
    "run",
    "save_graphs",
    "to_bytes",
    "to_dgl",
    "to_dicts",
    "to_networkx",
    "to_string",
    "unpack",
]
