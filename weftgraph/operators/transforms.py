"""Graphs brought into other forms: control/data-flow graphs, batches, sequences, JSON, DOT, vocabulary ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.features import as_text, integer, put, text
from weftgraph.plans.fixpoint import MOST_EDGES, queue_order
from weftgraph.plans.kernels import sequence_kernel
from weftgraph.plans.ordered import consecutive_bins, running_sum
from weftgraph.plans.scratch import Scratch
from weftgraph.schema import CALL, CONSTANT, CONTROL, DATA, FEATURE, INSTRUCTION, ROOT_TEXT, TYPE, VARIABLE


def cdfg_map(nodes: DataFrame) -> DataFrame:
    """``graph_id, node_id, new_id``: instructions numbered anew in their order."""
    order = Window.partitionBy("graph_id").orderBy("node_id")
    return nodes.where(F.col("type") == INSTRUCTION).select("graph_id", "node_id", (F.row_number().over(order) - 1).cast("long").alias("new_id"))


def cdfg_nodes(nodes: DataFrame) -> DataFrame:
    kept = [c for c in nodes.columns if c in ("function", "features")]
    return nodes.join(cdfg_map(nodes), ["graph_id", "node_id"]).select("graph_id", F.col("new_id").alias("node_id"), "text", *kept, F.col("node_id").alias("source_node_index"))


def cdfg_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Control and call edges at position 0, with their features; data edges from each definition to each use of a variable."""
    kept = [c for c in edges.columns if c == "features"]
    order = Window.partitionBy("graph_id", "type").orderBy("node_id")
    ends = nodes.where(F.col("type").isin(INSTRUCTION, VARIABLE)).select("graph_id", "node_id", "type", (F.row_number().over(order) - 1).cast("long").alias("new_id"))
    # each edge once with the kinds and new ids of both ends; ids of variables are not asked for
    tagged = edges.where(F.col("flow").isin(CONTROL, CALL, DATA)).select("graph_id", "flow", "source", "target", *kept)
    tagged = tagged.join(ends.toDF("graph_id", "source", "from", "s"), ["graph_id", "source"]).join(ends.toDF("graph_id", "target", "to", "t"), ["graph_id", "target"])
    tagged = Scratch(nodes.sparkSession).keep(tagged.where((F.col("from") == INSTRUCTION) | (F.col("to") == INSTRUCTION)), "tagged")
    ordered = tagged.where((F.col("flow") != DATA) & (F.col("from") == INSTRUCTION) & (F.col("to") == INSTRUCTION)).select("graph_id", "flow", "s", "t", *kept)
    data = tagged.where(F.col("flow") == DATA)
    defs = data.where(F.col("to") == VARIABLE).select("graph_id", F.col("target").alias("v"), "s").distinct()
    uses = data.where(F.col("from") == VARIABLE).select("graph_id", F.col("source").alias("v"), "t").distinct()
    flows = defs.join(uses, ["graph_id", "v"]).select("graph_id", F.lit(DATA).cast("long").alias("flow"), "s", "t")
    both = ordered.unionByName(flows, allowMissingColumns=True)
    return both.select("graph_id", "flow", F.lit(0).cast("long").alias("position"), F.col("s").alias("source"), F.col("t").alias("target"), *kept)


def cdfg(nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole control/data-flow graph as tables; functions are copied, modules and blocks are not."""
    found = {"nodes": cdfg_nodes(nodes), "edges": cdfg_edges(nodes, edges)}
    return found if functions is None else found | {"functions": functions}


def tuple_offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_id, node_size, edge_size, node_offset``: graphs side by side in the order of their ids."""
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("node_size"))
    sizes = sizes.join(edges.groupBy("graph_id").agg(F.count("*").alias("edge_size")), "graph_id", "left").withColumn("edge_size", F.coalesce("edge_size", F.lit(0)).cast("long"))
    summed = running_sum(sizes, [F.col("graph_id").asc()], "node_size", "upto", Scratch(nodes.sparkSession), "tuple")
    return summed.select("graph_id", "node_size", "edge_size", (F.col("upto") - F.col("node_size")).alias("node_offset"))


def tuple_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with its ends shifted by the nodes of the graphs before."""
    offsets = tuple_offsets(nodes, edges).select("graph_id", "node_offset")
    return edges.join(offsets, "graph_id").select("flow", (F.col("source") + F.col("node_offset")).alias("source"), (F.col("target") + F.col("node_offset")).alias("target"), "position")


def tuple_batches(nodes: DataFrame, edges: DataFrame, most_nodes: int) -> DataFrame:
    """``graph_id, batch, node_size, edge_size, node_offset`` (in its batch): graphs in the order of their ids, as many to a batch as have ``most_nodes`` nodes or less.

    A graph with more nodes is a batch of its own.
    """
    offsets = tuple_offsets(nodes, edges)
    return consecutive_bins(offsets, [F.col("graph_id").asc()], "node_size", most_nodes, "batch", "node_offset", Scratch(nodes.sparkSession), "batches")


def tuple_arrays(nodes: DataFrame, edges: DataFrame, most_nodes: int) -> DataFrame:
    """``batch, flow, sources, targets, positions``: the edges of each flow of a batch's graphs, in the order of graphs and edges, ends shifted by the nodes before."""
    placed = tuple_batches(nodes, edges, most_nodes).select("graph_id", "batch", "node_offset")
    moved = edges.join(placed, "graph_id").select("batch", "flow", F.struct("graph_id", "edge_id", (F.col("source") + F.col("node_offset")).alias("source"), (F.col("target") + F.col("node_offset")).alias("target"), "position").alias("e"))
    rows = moved.groupBy("batch", "flow").agg(F.sort_array(F.collect_list("e")).alias("r"))
    return rows.select("batch", "flow", *[F.col("r")[name].alias(f"{name}s") for name in ("source", "target", "position")])


def _sequenced(edges: DataFrame, most_nodes: int, most_edges: int, fits: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``graph_id, node_ids`` of packed graphs, and ``graph_id, node_id, place`` of those with more edges; ``fits`` says that there are none of these."""
    walked, none = edges.where(F.col("flow").isin(CONTROL, CALL)).select("graph_id", "flow", "edge_id", "source", "target"), fits
    if not fits:
        scratch = Scratch(edges.sparkSession)
        walked = scratch.keep(walked, "walked")
        large = scratch.keep(walked.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > most_edges).select("graph_id"), "large")
        none = large.isEmpty()
    few = walked if none else walked.join(large, "graph_id", "left_anti")
    edge = F.struct(*[F.col(c).cast("long").alias(c) for c in ("edge_id", "source", "target")])
    entry = F.struct(*[F.col(c).cast("long").alias(c) for c in ("edge_id", "target")])
    entered = (F.col("flow") == CALL) & (F.col("source") == 0)
    rows = few.groupBy("graph_id").agg(F.collect_list(F.when(F.col("flow") == CONTROL, edge)).alias("cs"), F.collect_list(F.when(entered, entry)).alias("ks"))
    found = rows.mapInArrow(sequence_kernel(most_nodes), "graph_id long, node_ids array<long>")
    if none:
        return found, None
    many = walked.join(large, "graph_id", "left_semi")
    order = queue_order(many.where(F.col("flow") == CONTROL), many.where(entered).select("graph_id", "edge_id", F.col("target").alias("node_id")))
    return found, order.where(F.col("place") < most_nodes)


def instruction_order(edges: DataFrame, most_nodes: int = 1_000_000, most_edges: int = MOST_EDGES) -> DataFrame:
    """``graph_id, place`` (from 0) ``, node_id``: instructions in breadth-first order from each call of the root, in edge order.

    Graphs of ``most_edges`` or less go through one kernel, others level by level through joins;
    no row holds a graph of those.
    """
    found, order = _sequenced(edges, most_nodes, most_edges)
    rows = found.select("graph_id", F.posexplode("node_ids").alias("place", "node_id")).withColumn("place", F.col("place").cast("long"))
    return rows if order is None else rows.unionByName(order.select("graph_id", "place", "node_id"))


def instruction_sequence(edges: DataFrame, most_nodes: int = 1_000_000, most_edges: int = MOST_EDGES, fits: bool = False) -> DataFrame:
    """``graph_id, node_ids``: the same as one list for each graph; ``fits`` says that none has more edges."""
    found, order = _sequenced(edges, most_nodes, most_edges, fits)
    if order is None:
        return found
    listed = order.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("place", "node_id"))).alias("r"))
    return found.unionByName(listed.select("graph_id", F.transform("r", lambda x: x["node_id"]).alias("node_ids")))


def _quoted(text: Column) -> Column:
    """A JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _features_json(features: Column) -> Column:
    """An object of bare arrays."""
    values = lambda v: F.coalesce(F.to_json(F.transform(v["bytes"], lambda x: x.cast("string"))), F.to_json(v["floats"]), F.to_json(v["ints"]), F.lit("[]"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(features), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), values(e["value"]))), ","), F.lit("}"))


def _objects(df: DataFrame, order: str, out: str, fields: dict[str, Column]) -> DataFrame:
    """``graph_id`` and ``out``: the JSON list of a graph's rows, each with its features, if it has any."""
    made = F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))
    if "features" in df.columns:
        made = F.when(F.col("features").isNull(), made).otherwise(F.concat(F.substring(made, F.lit(1), F.length(made) - 1), F.lit(',"features":'), _features_json(F.col("features")), F.lit("}")))
    rows = df.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), made.alias("j")))).alias("r"))
    return rows.select("graph_id", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["j"]), ","), F.lit("]")).alias(out))


def node_link_json(nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None, modules: DataFrame | None = None, graphs: DataFrame | None = None) -> DataFrame:
    """``graph_id, json`` in node-link form: enums as numbers, every link with key 0, features as bare arrays."""
    zero = lambda df, c: F.col(c) if c in df.columns else F.lit(0).cast("long")
    both = _objects(nodes, "node_id", "ns", {"id": F.col("node_id"), "type": F.col("type"), "text": F.col("text"), "function": zero(nodes, "function"), "block": zero(nodes, "block")})
    links = _objects(edges, "edge_id", "ls", {"flow": F.col("flow"), "position": F.col("position"), "source": F.col("source"), "target": F.col("target"), "key": F.lit(0)})
    both = both.join(links, "graph_id", "left")
    none = F.lit(None).cast("string")
    both = both.withColumn("fs", none) if functions is None else both.join(_objects(functions, "function_id", "fs", {"name": F.col("name"), "module": F.col("module_id")}), "graph_id", "left")
    both = both.withColumn("ms", none) if modules is None else both.join(_objects(modules, "module_id", "ms", {"name": F.col("name")}), "graph_id", "left")
    both = both.withColumn("own", none) if graphs is None else both.join(graphs.select("graph_id", _features_json(F.col("features")).alias("own")), "graph_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("[]"))
    graph = F.concat(F.lit('"graph":{"function":'), empty("fs"), F.lit(',"module":'), empty("ms"), F.coalesce(F.concat(F.lit(',"features":'), "own"), F.lit("")), F.lit("}"))
    return both.select("graph_id", F.concat(F.lit('{"directed":true,"multigraph":true,'), graph, F.lit(',"nodes":'), "ns", F.lit(',"links":'), empty("ls"), F.lit("}")).alias("json"))


def _short(text: Column, most: int = 32) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


#: Attributes of node types and of flows, and those of all graphs, nodes and edges.
NODE_STYLE = {
    INSTRUCTION: 'shape=box, fillcolor="#3c78d8", fontcolor="#ffffff"',
    VARIABLE: 'shape=ellipse, fillcolor="#f4cccc", color="#990000", fontcolor="#990000"',
    CONSTANT: 'shape=octagon, fillcolor="#e99c9c", color="#990000", fontcolor="#990000"',
    TYPE: 'shape=diamond, fillcolor="#cccccc", color="#cccccc", fontcolor="#222222"',
}
EDGE_COLOR = ["#345393", "#990000", "#65ae4d", "#aaaaaa"]
EDGE_STYLE = ["weight=10", "weight=0", "weight=1", 'weight=1, penwidth="1.5"']
DEFAULTS = [
    'graph [margin=0, nodesep="0.4", ranksep="0.4", fontname=Inconsolata, fontsize=20];',
    "node [fontname=Inconsolata, fontsize=20, penwidth=2, width=1, margin=0];",
    'edge [fontname=Inconsolata, fontsize=20, penwidth=3, arrowsize=".8"];',
]


def _pick(code: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (code + 1).cast("int"))


def _escaped(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _dot_lines(nodes: DataFrame, edges: DataFrame, label: str, feature: str, *kept: Column) -> tuple[DataFrame, DataFrame]:
    """``graph_id, kind, ord, line`` of nodes, with what else is ``kept`` of them, and of edges."""
    if label not in ("text", "none", "feature"):
        raise ValueError(f"unknown label: {label}; known are text, none, feature")
    if label == "feature":
        shown = F.coalesce(as_text(F.try_element_at("features", F.lit(feature))), F.lit("")) if "features" in nodes.columns else F.lit("")
    else:
        shown = F.coalesce(F.col("text"), F.lit("")) if label == "text" else F.lit("")
    ns = nodes.select("graph_id", F.lit("node").alias("kind"), F.col("node_id").alias("ord"), *kept, F.concat(F.lit("n"), F.col("node_id").cast("string"), F.lit(" [label="), _escaped(_short(shown)), F.lit(", style=filled, "), _pick(F.col("type"), list(NODE_STYLE.values())), F.lit("];")).alias("line"))
    color = _pick(F.col("flow"), EDGE_COLOR)
    place = F.concat(F.when(F.col("flow") == CONTROL, F.lit(", taillabel=")).otherwise(F.lit(", headlabel=")), F.col("position").cast("string"), F.lit(', labelfontcolor="'), color, F.lit('"'))
    where = F.when(F.col("position") == 0, F.lit("")).otherwise(place)
    es = edges.select("graph_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("ord"), F.concat(F.lit("n"), F.col("source").cast("string"), F.lit(" -> n"), F.col("target").cast("string"), F.lit(' [color="'), color, F.lit('", '), _pick(F.col("flow"), EDGE_STYLE), where, F.lit("];")).alias("line"))
    return ns, es


def dot_lines(nodes: DataFrame, edges: DataFrame, label: str = "text", feature: str = "") -> DataFrame:
    """``graph_id, kind, ord, line``: a DOT statement for each node and edge; ``label`` is text, none or feature (of that name)."""
    ns, es = _dot_lines(nodes, edges, label, feature)
    return ns.unionByName(es)


def dot_text(nodes: DataFrame, edges: DataFrame, label: str = "text", feature: str = "", functions: DataFrame | None = None) -> DataFrame:
    """``graph_id, dot``: the whole graph; instructions and variables stand in a cluster for each of ``functions``.

    Everything is grouped and joined by graph alone, so nodes and edges that lie by graph stay where they are.
    """
    inside = (F.col("node_id") > 0) & F.col("type").isin(INSTRUCTION, VARIABLE)
    clustered = functions is not None and "function" in nodes.columns
    home = (F.when(inside, F.col("function")).otherwise(-1) if clustered else F.lit(-1)).cast("long").alias("home")
    ns, es = _dot_lines(nodes, edges, label, feature, home)
    ns = ns.groupBy("graph_id", "home").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(F.lit("    "), x["line"], F.lit("\n"))), "")
    ns = ns.select("graph_id", "home", body.alias("body")).groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("home", "body"))).alias("bodies"))
    part = lambda h, name, body: F.struct(h.alias("home"), F.concat(F.when(h < 0, F.lit("  subgraph external {\n")).otherwise(F.concat(F.lit("  subgraph cluster"), h.cast("string"), F.lit(" {\n    label="), _escaped(_short(F.coalesce(name, F.lit("")))), F.lit(";\n    margin=10;\n    style=dotted;\n"))), F.coalesce(body, F.lit("")), F.lit("  }\n")).alias("part"))
    if functions is None:
        parts = ns.select("graph_id", F.transform("bodies", lambda b: part(b["home"], F.lit(""), b["body"])).alias("p"))
    else:
        named = functions.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(F.col("function_id").cast("long").alias("home"), "name"))).alias("names"))
        both = ns.join(named, "graph_id", "full")
        none = lambda c, fields: F.coalesce(F.col(c), F.array().cast(f"array<struct<{fields}>>"))
        both = both.select("graph_id", none("bodies", "home: bigint, body: string").alias("bodies"), none("names", "home: bigint, name: string").alias("names"))
        body_of = F.map_from_entries(F.filter("bodies", lambda b: b["home"].isNotNull()))
        bare = F.filter("bodies", lambda b: ~F.coalesce(F.array_contains(F.col("homes"), b["home"]), F.lit(False)))
        both = both.select("graph_id", "bodies", "names", body_of.alias("body_of"), F.transform("names", lambda n: n["home"]).alias("homes"))
        named_parts = F.transform("names", lambda n: part(n["home"], n["name"], F.try_element_at(F.col("body_of"), n["home"])))
        bare_parts = F.transform(bare, lambda b: part(b["home"], F.lit(None).cast("string"), b["body"]))
        parts = both.select("graph_id", F.sort_array(F.concat(named_parts, bare_parts)).alias("p"))
    es = es.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("ord", "line"))).alias("e"))
    shown = F.coalesce(F.array_join(F.transform("e", lambda x: F.concat(F.lit("  "), x["line"], F.lit("\n"))), ""), F.lit(""))
    start = "digraph main {\n" + "".join(f"  {line}\n" for line in DEFAULTS)
    return parts.join(es, "graph_id", "left").select("graph_id", F.concat(F.lit(start), F.array_join(F.transform("p", lambda x: x["part"]), ""), shown, F.lit("}\n")).alias("dot"))


def encode_vocabulary(nodes: DataFrame, vocabulary: DataFrame, unknown: str = "!UNK", identifier: str = "!IDENTIFIER", immediate: str = "!IMMEDIATE") -> DataFrame:
    """``graph_id, node_id, token, token_id`` by a vocabulary of ``text, id``.

    Instructions are looked up by text and fall back to ``unknown``; variables are
    identifiers, constants and types immediates.
    """
    key = F.when(F.col("type") == INSTRUCTION, F.col("text")).when(F.col("type") == VARIABLE, identifier).otherwise(immediate)
    known = vocabulary.select(F.col("text").alias("token"), F.col("id").cast("long").alias("token_id"))
    default = vocabulary.where(F.col("text") == unknown).select(F.col("id").cast("long")).first()
    joined = nodes.where(F.col("text") != ROOT_TEXT).select("graph_id", "node_id", key.alias("token")).join(known, "token", "left")
    return joined.select("graph_id", "node_id", F.when(F.col("token_id").isNull(), unknown).otherwise(F.col("token")).alias("token"), F.coalesce("token_id", F.lit(default[0] if default else None)).cast("long").alias("token_id"))


#: What stands for identifiers, labels and literals in preprocessed instruction texts.
PLACEHOLDERS = {"local": "<%ID>", "global": "<@ID>", "label": "<LABEL>", "float": "<FLOAT>", "int": "<INT>", "string": "<STRING>"}


def preprocessed(statement: Column) -> Column:
    """An instruction's text without metadata, attributes and alignment, with placeholders for names and literals."""
    name = r'(?:"[^"]*"|[-a-zA-Z$._0-9]+)'
    steps = [
        (r",?\s*![\w.]+(?:\s*!\w+)*", ""),
        (r",?\s*align \d+", ""),
        (r"\s*#\d+", ""),
        (r'c"[^"]*"', PLACEHOLDERS["string"]),
        (rf"label %{name}", f"label {PLACEHOLDERS['label']}"),
        (rf"%{name}", PLACEHOLDERS["local"]),
        (rf"@{name}", PLACEHOLDERS["global"]),
        (r"(?<![\w<>.%@])-?\d+\.\d+(?:e[+-]?\d+)?|(?<![\w.])0x[KLMH]?[0-9A-Fa-f]+", PLACEHOLDERS["float"]),
        (r"(?<![\w<>.%@\[*])-?\d+(?![\w.]| x )", PLACEHOLDERS["int"]),
    ]
    out = F.trim(F.coalesce(statement, F.lit("")))
    for pattern, instead in steps:
        out = F.regexp_replace(out, pattern, instead.replace("$", r"\$"))
    return F.trim(out)


def annotate_inst2vec(nodes: DataFrame, vocabulary: DataFrame, full_text: str = "full_text", structs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with the features ``inst2vec_preprocessed`` (instructions) and ``inst2vec_embedding``, and each graph's feature ``inst2vec_annotated``.

    ``vocabulary`` has ``text, id``; ``structs`` (graph_id, name, body) are written into the texts first.
    Where it has no ``!UNK`` (``!IDENTIFIER``, ``!IMMEDIATE``), such ids are null.
    """
    from weftgraph.operators.adapters import inline_structs

    base = nodes.withColumn("__text", F.col(full_text) if full_text in nodes.columns else F.col("text"))
    if structs is not None:
        base = inline_structs(base, structs, "__text")
    base = base.withColumn("__text", preprocessed(F.col("__text")))
    known = vocabulary.select(F.col("text").alias("__text"), F.col("id").cast("long").alias("__id"))
    fixed = {r["text"]: r["id"] for r in vocabulary.where(F.col("text").isin("!UNK", "!IDENTIFIER", "!IMMEDIATE")).collect()}
    found = base.join(known, "__text", "left")
    token = F.when(F.col("type") == INSTRUCTION, F.coalesce("__id", F.lit(fixed.get("!UNK")).cast("long"))).when(F.col("type") == VARIABLE, F.lit(fixed.get("!IDENTIFIER")).cast("long")).otherwise(F.lit(fixed.get("!IMMEDIATE")).cast("long"))
    features = F.col("features") if "features" in nodes.columns else F.lit(None)
    with_text = F.when(F.col("type") == INSTRUCTION, put(features.cast(_FEATURES), "inst2vec_preprocessed", text(F.col("__text")))).otherwise(features.cast(_FEATURES))
    found = found.withColumn("__features", put(with_text, "inst2vec_embedding", integer(token.cast("long"))))
    out = found.select(*[c for c in nodes.columns if c != "features"], F.col("__features").alias("features"))
    graphs = nodes.select("graph_id").distinct().withColumn("features", put(F.lit(None).cast(_FEATURES), "inst2vec_annotated", integer(F.lit(1).cast("long"))))
    return out, graphs


_FEATURES = f"map<string,{FEATURE}>"
