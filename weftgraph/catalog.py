"""Every query of the program-graph operators over the given tables, with its DuckDB twin.

Graphs are those that ``sources.orders`` makes of ``lineitem``; roots of the analyses
are a seeded sample, so that most are not the first instruction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import adapters, analysis, statistics, transforms, validation
from weftgraph.sources import ir
from weftgraph.sources.orders import ORACLE_HEAD, all_fit, order_graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function by its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def graph_query(sql: str | None = None, fits: bool = False) -> Callable:
    """The same for a function of nodes and edges; the SQL follows those of the graphs.

    With ``fits`` the function is also told whether each graph fits in one row.
    """

    def add(f: Callable[..., DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*order_graphs(spark, sf_dir), *([all_fit(spark, sf_dir)] if fits else []))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = ORACLE_HEAD + sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _roots_sql(candidates: str, seed: int = 0) -> str:
    return f""",
roots AS (
  SELECT graph_id, node_id AS root FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY (node_id % 10007 * 7919 + graph_id % 10007 * 104729 + {seed}) % 10007, node_id) AS rk,
           count(*) OVER (PARTITION BY graph_id) AS cnt FROM ({candidates}))
  WHERE rk <= least(ceil(cnt / 10), 10))"""


_INSTRUCTIONS = "SELECT graph_id, node_id FROM nodes WHERE type = 0 AND node_id > 0"
_VARIABLES = "SELECT graph_id, node_id FROM nodes WHERE type = 1"
_LABELS = """
SELECT r.graph_id, r.root, n.node_id, (n.node_id = r.root)::BIGINT AS is_root, (f.node_id IS NOT NULL)::BIGINT AS value
FROM roots r JOIN nodes n USING (graph_id) LEFT JOIN found f ON f.graph_id = r.graph_id AND f.root = r.root AND f.node_id = n.node_id"""


def _instruction_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return analysis.sample_roots(analysis.eligible(nodes, 0))


# scans and projections


@graph_query(" SELECT text, count(*) AS n FROM nodes GROUP BY text")
def node_texts(nodes, edges):
    return nodes.groupBy("text").agg(F.count("*").alias("n"))


@graph_query(" SELECT graph_id, node_id, text FROM nodes WHERE type = 0 AND node_id > 0")
def instructions(nodes, edges):
    return nodes.where("type = 0 AND node_id > 0").select("graph_id", "node_id", "text")


@graph_query(" SELECT type, count(*) AS n, count(DISTINCT graph_id) AS graphs FROM nodes GROUP BY type")
def nodes_by_type(nodes, edges):
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("graph_id").alias("graphs"))


@graph_query(" SELECT flow, position, count(*) AS n FROM edges GROUP BY flow, position")
def edges_by_flow(nodes, edges):
    return edges.groupBy("flow", "position").agg(F.count("*").alias("n"))


@graph_query(" SELECT graph_id, source, list(target ORDER BY edge_id) AS targets FROM edges WHERE flow = 0 GROUP BY graph_id, source")
def adjacency_lists(nodes, edges):
    rows = analysis.flow(edges, 0).groupBy("graph_id", "source").agg(F.sort_array(F.collect_list(F.struct("edge_id", "target"))).alias("r"))
    return rows.select("graph_id", "source", F.transform("r", lambda x: x["target"]).alias("targets"))


@query("SELECT i.pos, d.doc_id, d.n_chars FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 0)) i(pos, idx) JOIN documents d ON d.doc_id = i.idx")
def index_select(spark, sf_dir):
    wanted = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 0)], "pos int, idx long")
    docs = _table(spark, sf_dir, "documents")
    return docs.join(F.broadcast(wanted), docs.doc_id == wanted.idx).select("pos", "doc_id", "n_chars")  # four fixed rows


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type NOT LIKE 'pur%' AND user_id = 7")
def filter_not_like(spark, sf_dir):
    return _table(spark, sf_dir, "events").where(~F.col("event_type").like("pur%") & (F.col("user_id") == 7)).select("event_id", "event_type", "user_id")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'cc' WHEN 'de' THEN 'c' WHEN 'fr' THEN 'ml' ELSE lang END AS extension FROM documents")
def value_remap(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in (("en", "cc"), ("de", "c"), ("fr", "ml")) for x in pair])
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), F.col("lang")).alias("extension"))


@query("""SELECT concat_ws('-', o_orderpriority, o_orderstatus) AS name, o_orderkey, round(ln(1 + o_totalprice), 6) AS price_log1p,
  (o_totalprice < 100000)::BIGINT AS label FROM orders""")
def feature_projection(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("name"), "o_orderkey", F.round(F.log(1 + F.col("o_totalprice")), 6).alias("price_log1p"), (F.col("o_totalprice") < 100000).cast("long").alias("label"))


@query("""SELECT o.o_orderkey, coalesce(CASE WHEN c.c_custkey % 3 = 0 THEN c.c_name END, n.n_name, 'unknown') AS resolved
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def name_resolution(spark, sf_dir):
    orders, customer, nation = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.col("n_name"), F.lit("unknown")).alias("resolved"))


@query("SELECT doc_id, opt, fast FROM documents, (VALUES ('O0'), ('O1'), ('O2'), ('O3')) o(opt), (VALUES (false), (true)) f(fast)")
def compile_configurations(spark, sf_dir):
    configs = F.array(*[F.struct(F.lit(o).alias("opt"), F.lit(f).alias("fast")) for o in ("O0", "O1", "O2", "O3") for f in (False, True)])
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(configs).alias("c")).select("doc_id", "c.opt", "c.fast")


@query("SELECT conv_id, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS text FROM (SELECT conv_id, list(text ORDER BY turn) AS l FROM conversations GROUP BY conv_id)")
def unpack_lists(spark, sf_dir):
    lists = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return ir.unpack_lists(lists.select("conv_id", F.transform("l", lambda x: x["text"]).alias("l")), "conv_id", "l")


# counts by query string


@graph_query(" SELECT count(*) AS n FROM (SELECT DISTINCT graph_id FROM nodes)")
def count_graphs(nodes, edges):
    return nodes.select("graph_id").distinct().agg(F.count("*").alias("n"))


@graph_query(_roots_sql(_INSTRUCTIONS) + " SELECT count(*) AS n FROM roots r JOIN nodes n USING (graph_id)")
def count_labels(nodes, edges):
    return _instruction_roots(nodes, edges).join(nodes, "graph_id").agg(F.count("*").alias("n"))


@graph_query(" SELECT graph_id, type, count(*) AS n FROM nodes GROUP BY ROLLUP (graph_id, type)")
def rollup_counts(nodes, edges):
    return nodes.rollup("graph_id", "type").agg(F.count("*").alias("n"))


# analyses

_REACH = _roots_sql(_INSTRUCTIONS) + """,
found AS (
  SELECT graph_id, root, root AS node_id FROM roots
  UNION SELECT f.graph_id, f.root, e.target FROM found f JOIN edges e ON e.graph_id = f.graph_id AND e.source = f.node_id AND e.flow = 0)"""
_DEPTH = """,
walk AS (
  SELECT graph_id, root, root AS node_id, {first}::BIGINT AS depth FROM roots
  UNION SELECT f.graph_id, f.root, e.{to}, f.depth + 1 FROM walk f JOIN edges e ON e.graph_id = f.graph_id AND e.{at} = f.node_id AND e.flow = {flow}
  WHERE f.depth < 40),
nearest AS (SELECT graph_id, root, node_id, min(depth) AS depth FROM walk GROUP BY ALL)"""


@graph_query(_roots_sql(_INSTRUCTIONS) + " SELECT graph_id, root FROM roots")
def root_sample(nodes, edges):
    return _instruction_roots(nodes, edges)


@graph_query(_REACH + _LABELS)
def reachability_labels(nodes, edges):
    return analysis.reachability(nodes, edges, _instruction_roots(nodes, edges))


@graph_query(_roots_sql(_INSTRUCTIONS) + _DEPTH.format(first=1, at="source", to="target", flow=0) + " SELECT graph_id, root, max(depth) AS step_count, count(*) AS active_node_count FROM nearest GROUP BY ALL")
def reachability_summary(nodes, edges):
    return analysis.reachability_instances(nodes, edges, _instruction_roots(nodes, edges))


_DATADEP = _roots_sql(_VARIABLES) + """,
back AS (
  SELECT graph_id, root, root AS node_id FROM roots
  UNION SELECT f.graph_id, f.root, e.source FROM back f JOIN edges e ON e.graph_id = f.graph_id AND e.target = f.node_id AND e.flow = 1),
found AS (SELECT b.* FROM back b JOIN nodes n ON n.graph_id = b.graph_id AND n.node_id = b.node_id AND n.type = 0)"""


@graph_query(_DATADEP + _LABELS)
def datadep_labels(nodes, edges):
    return analysis.datadep(nodes, edges, analysis.sample_roots(analysis.eligible(nodes, 1)))


@graph_query(_roots_sql(_VARIABLES) + _DEPTH.format(first=0, at="target", to="source", flow=1) + """
 SELECT x.graph_id, x.root, max(depth) AS step_count, sum((n.type = 0)::BIGINT)::BIGINT AS active_node_count
 FROM nearest x JOIN nodes n ON n.graph_id = x.graph_id AND n.node_id = x.node_id GROUP BY ALL""", fits=True)
def datadep_summary(nodes, edges, fits):
    return analysis.sampled_datadep_instances(nodes, edges, fits=fits)


# a node is not dominated if it, or what leads to it past the root, has no predecessor or lies on a cycle
_DOMINANCE = _roots_sql(_INSTRUCTIONS) + """,
ce AS (SELECT DISTINCT graph_id, source, target FROM edges WHERE flow = 0),
path AS (
  SELECT r.graph_id, r.root, e.source AS a, e.target AS b FROM roots r JOIN ce e ON e.graph_id = r.graph_id AND e.target <> r.root
  UNION SELECT p.graph_id, p.root, p.a, e.target FROM path p JOIN ce e ON e.graph_id = p.graph_id AND e.source = p.b AND e.target <> p.root AND p.b <> p.root),
inner_path AS (SELECT * FROM path WHERE a <> root),
bad AS (
  SELECT r.graph_id, r.root, n.node_id FROM roots r JOIN nodes n ON n.graph_id = r.graph_id AND n.node_id <> r.root
  WHERE NOT EXISTS (SELECT 1 FROM ce e WHERE e.graph_id = n.graph_id AND e.target = n.node_id)
  UNION SELECT graph_id, root, a FROM inner_path WHERE a = b),
lost AS (SELECT graph_id, root, node_id FROM bad UNION SELECT p.graph_id, p.root, p.b FROM inner_path p JOIN bad USING (graph_id, root) WHERE bad.node_id = p.a),
found AS (SELECT r.graph_id, r.root, n.node_id FROM roots r JOIN nodes n USING (graph_id) ANTI JOIN lost l ON l.graph_id = r.graph_id AND l.root = r.root AND l.node_id = n.node_id)"""


@graph_query(_DOMINANCE + _LABELS)
def dominance_labels(nodes, edges):
    return analysis.dominance(nodes, edges, _instruction_roots(nodes, edges))


# the sweeps themselves: one step of the recursion visits one node of the scope; sets are bits
_SWEEPS = _roots_sql(_INSTRUCTIONS) + """,
scope AS (SELECT graph_id, list(node_id ORDER BY node_id) AS ids, list(type ORDER BY node_id) AS kinds FROM nodes WHERE node_id > 0 GROUP BY graph_id),
ce AS (SELECT DISTINCT graph_id, source, target FROM edges WHERE flow = 0),
preds AS (
  SELECT s.graph_id, list(coalesce(p.ps, []) ORDER BY s.i) AS preds
  FROM (SELECT graph_id, ids, generate_subscripts(ids, 1) AS i, unnest(ids) AS node_id FROM scope) s
  LEFT JOIN (SELECT c.graph_id, c.target, list(coalesce(list_position(sc.ids, c.source), 0)) AS ps FROM ce c JOIN scope sc USING (graph_id) GROUP BY ALL) p
    ON p.graph_id = s.graph_id AND p.target = s.node_id GROUP BY s.graph_id),
sweep AS (
  SELECT r.graph_id, r.root, list_position(s.ids, r.root)::BIGINT AS place, len(s.ids)::BIGINT AS n, p.preds, 1::BIGINT AS i, false AS again, false AS done, 0::BIGINT AS updates,
         list_transform(s.ids, lambda x: CASE WHEN x = r.root THEN 1::BIGINT << (list_position(s.ids, r.root) - 1)::INT
           ELSE ((1::BIGINT << len(s.ids)::INT) - 1) - (1::BIGINT << (list_position(s.ids, r.root) - 1)::INT) END) AS sets
  FROM roots r JOIN scope s USING (graph_id) JOIN preds p USING (graph_id)
  UNION ALL
  SELECT graph_id, root, place, n, preds, CASE WHEN i = n THEN 1 ELSE i + 1 END, CASE WHEN i = n THEN false ELSE again OR differs END, i = n AND NOT (again OR differs), updates + differs::BIGINT,
         CASE WHEN differs THEN list_transform(sets, lambda x, k: CASE WHEN k = i THEN new ELSE x END) ELSE sets END
  FROM (
    SELECT *, i <> place AND new <> sets[i] AS differs FROM (
      SELECT *, (CASE WHEN len(preds[i]) = 0 THEN 0 ELSE list_reduce(list_transform(preds[i], lambda p: CASE WHEN p = 0 THEN 0::BIGINT ELSE sets[p] END), lambda x, y: x & y) END) | (1::BIGINT << (i - 1)::INT) AS new
      FROM sweep WHERE NOT done)))
SELECT w.graph_id, w.root, w.updates AS step_count,
       len(list_filter(w.sets, lambda x, k: s.kinds[k] = 0 AND (x >> (w.place - 1)::INT) & 1 = 1))::BIGINT AS active_node_count, 'ok' AS status
FROM sweep w JOIN scope s USING (graph_id) WHERE w.done"""


@graph_query(_SWEEPS)
def dominance_summary(nodes, edges):
    return analysis.dominance_instances(nodes, edges, _instruction_roots(nodes, edges))


_LIVE = """,
ends AS (SELECT n.graph_id, n.node_id FROM nodes n WHERE n.type = 0 AND n.node_id > 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.source = n.node_id AND e.flow = 0)),
ending AS (SELECT * FROM ends UNION SELECT p.graph_id, e.source FROM ending p JOIN edges e ON e.graph_id = p.graph_id AND e.target = p.node_id AND e.flow = 0),
defs AS (SELECT e.graph_id, e.source AS node_id, e.target AS v FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.node_id = e.source AND n.type = 0 WHERE e.flow = 1),
live AS (
  SELECT e.graph_id, e.target AS node_id, e.source AS variable FROM edges e JOIN ending p ON p.graph_id = e.graph_id AND p.node_id = e.target WHERE e.flow = 1
  UNION SELECT l.graph_id, e.source, l.variable FROM live l JOIN edges e ON e.graph_id = l.graph_id AND e.target = l.node_id AND e.flow = 0
  WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.graph_id = l.graph_id AND d.node_id = e.source AND d.v = l.variable)),
outs AS (SELECT DISTINCT l.graph_id, e.source AS node_id, l.variable FROM live l JOIN edges e ON e.graph_id = l.graph_id AND e.target = l.node_id AND e.flow = 0)"""


@graph_query(_LIVE + " SELECT graph_id, node_id, variable FROM live", fits=True)
def liveness_in(nodes, edges, fits):
    return analysis.live_in(nodes, edges, fits)


@graph_query(_LIVE + " SELECT graph_id, node_id, variable FROM outs", fits=True)
def liveness_out(nodes, edges, fits):
    return analysis.live_out(nodes, edges, fits)


@graph_query(_LIVE + _roots_sql("SELECT DISTINCT graph_id, node_id FROM outs") + ", found AS (SELECT o.graph_id, o.node_id AS root, o.variable AS node_id FROM outs o)" + _LABELS, fits=True)
def liveness_labels(nodes, edges, fits):
    return analysis.sampled_liveness(nodes, edges, fits=fits)


# the queue itself: one step of the recursion takes one level, in the order of first entry
_QUEUE = _LIVE + _roots_sql("SELECT DISTINCT graph_id, node_id FROM outs") + """,
steps AS (SELECT graph_id, list(struct_pack(s := source, f := flow, t := target) ORDER BY flow, edge_id) AS es FROM edges WHERE flow < 2 GROUP BY graph_id),
lives AS (SELECT r.graph_id, r.root, list(o.variable) AS live FROM roots r JOIN outs o ON o.graph_id = r.graph_id AND o.node_id = r.root GROUP BY ALL),
levels AS (
  SELECT l.graph_id, l.root, l.live, e.es, [l.root] AS level, []::BIGINT[] AS seen, 1::BIGINT AS depth, 0::BIGINT AS deepest FROM lives l JOIN steps e USING (graph_id)
  UNION ALL
  SELECT graph_id, root, live, es, list_filter(below, lambda x, i: list_position(below, x) = i), seen || level, depth + 1,
         CASE WHEN list_has_any(level, live) THEN depth ELSE deepest END
  FROM (
    SELECT *, flatten(list_transform(level, lambda n, i: list_transform(list_filter(es, lambda e: e.s = n AND NOT list_contains(seen, e.t) AND NOT list_contains(level[1:i], e.t)), lambda e: e.t))) AS below
    FROM levels WHERE len(level) > 0))
SELECT graph_id, root, deepest AS step_count, len(live)::BIGINT AS active_node_count FROM levels WHERE len(level) = 0"""


@graph_query(_QUEUE, fits=True)
def liveness_summary(nodes, edges, fits):
    return analysis.sampled_liveness_instances(nodes, edges, fits=fits)


_CSE = """,
operands AS (
  SELECT n.graph_id, n.node_id, n.text, list(e.source ORDER BY CASE WHEN n.text IN ('add', 'fadd', 'mul', 'fmul', 'or', 'and', 'xor') THEN 0 ELSE e.position END, e.source) AS operands
  FROM nodes n JOIN edges e ON e.graph_id = n.graph_id AND e.target = n.node_id AND e.flow = 1 WHERE n.type = 0 AND n.node_id > 0 GROUP BY ALL),
sets AS (SELECT graph_id, text, operands, list(node_id ORDER BY node_id) AS members, count(*) AS size FROM operands GROUP BY graph_id, text, operands HAVING count(*) > 1)"""


@graph_query(_CSE + " SELECT graph_id, text, operands, members, size FROM sets")
def cse_sets(nodes, edges):
    return analysis.expression_sets(nodes, edges)


# numbers by windows: no table is joined with itself
_NUMBERS = _CSE.split(",\nsets AS")[0].replace("operands AS (", "operands AS MATERIALIZED (", 1) + """,
members AS MATERIALIZED (SELECT graph_id, node_id, min(node_id) OVER w AS number, count(*) OVER w AS size FROM operands WINDOW w AS (PARTITION BY graph_id, text, operands))"""


@graph_query(_NUMBERS + """,
roots AS MATERIALIZED (
  SELECT graph_id, node_id AS root, number FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY (node_id % 10007 * 7919 + graph_id % 10007 * 104729) % 10007, node_id) AS rk, count(*) OVER (PARTITION BY graph_id) AS cnt FROM members WHERE size > 1)
  WHERE rk <= least(ceil(cnt / 10), 10)),
every AS MATERIALIZED (SELECT graph_id, node_id, max(number) AS number FROM (SELECT graph_id, node_id, NULL::BIGINT AS number FROM nodes UNION ALL SELECT graph_id, node_id, number FROM members WHERE size > 1) GROUP BY ALL)
SELECT r.graph_id, r.root, e.node_id, (e.node_id = r.root)::BIGINT AS is_root, coalesce(e.number = r.number, false)::BIGINT AS value FROM roots r JOIN every e USING (graph_id)""")
def cse_labels(nodes, edges):
    return analysis.subexpressions(nodes, edges, analysis.sample_roots(analysis.subexpression_roots(nodes, edges)))


# transforms

_CDFG = """,
ids AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS new_id FROM nodes WHERE type = 0),
vars AS (SELECT graph_id, node_id FROM nodes WHERE type = 1),
du AS (
  SELECT DISTINCT v.graph_id, v.node_id AS v, d.source, u.target FROM vars v
  JOIN edges d ON d.graph_id = v.graph_id AND d.target = v.node_id AND d.flow = 1
  JOIN edges u ON u.graph_id = v.graph_id AND u.source = v.node_id AND u.flow = 1
  JOIN ids a ON a.graph_id = v.graph_id AND a.node_id = d.source JOIN ids b ON b.graph_id = v.graph_id AND b.node_id = u.target),
ce AS (SELECT graph_id, flow, source, target FROM edges WHERE flow IN (0, 2) UNION ALL SELECT graph_id, 1, source, target FROM du)"""


@graph_query(_CDFG + " SELECT graph_id, node_id, new_id FROM ids")
def cdfg_node_map(nodes, edges):
    return transforms.cdfg_map(nodes)


@graph_query(" SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 AS node_id, text, node_id AS source_node_index FROM nodes WHERE type = 0")
def cdfg_nodes(nodes, edges):
    return transforms.cdfg_nodes(nodes)


@graph_query(_CDFG + """ SELECT e.graph_id, e.flow, 0::BIGINT AS position, a.new_id AS source, b.new_id AS target
 FROM ce e JOIN ids a ON a.graph_id = e.graph_id AND a.node_id = e.source JOIN ids b ON b.graph_id = e.graph_id AND b.node_id = e.target""")
def cdfg_edges(nodes, edges):
    return transforms.cdfg_edges(nodes, edges)


_TUPLE = """,
sizes AS (SELECT graph_id, count(*) AS node_size FROM nodes GROUP BY graph_id),
offsets AS (SELECT graph_id, node_size, (sum(node_size) OVER (ORDER BY graph_id) - node_size)::BIGINT AS node_offset FROM sizes)"""


@graph_query(_TUPLE + " SELECT o.graph_id, node_size, (SELECT count(*) FROM edges e WHERE e.graph_id = o.graph_id) AS edge_size, node_offset FROM offsets o")
def graph_tuple_offsets(nodes, edges):
    return transforms.tuple_offsets(nodes, edges)


#: Nodes of a batch at most, in the query.
BUDGET = 5000
_BATCHES = _TUPLE + f""",
sums AS MATERIALIZED (SELECT graph_id, node_size, node_offset, node_offset + node_size AS upto FROM offsets),
cuts AS (
  SELECT 0::BIGINT AS batch, 0::BIGINT AS low, max(upto) AS high FROM sums WHERE upto <= {BUDGET} OR node_offset = 0
  UNION ALL SELECT c.batch + 1, c.high, max(s.upto) FROM cuts c JOIN sums s ON s.upto > c.high AND (s.upto <= c.high + {BUDGET} OR s.node_offset = c.high) GROUP BY c.batch, c.high),
placed AS MATERIALIZED (SELECT s.graph_id, c.batch, s.node_size, s.node_offset - c.low AS node_offset FROM sums s JOIN cuts c ON s.upto > c.low AND s.upto <= c.high)"""


@graph_query(_BATCHES + " SELECT graph_id, batch, node_size, node_offset FROM placed")
def graph_batches(nodes, edges):
    return transforms.tuple_batches(nodes, edges, BUDGET).select("graph_id", "batch", "node_size", "node_offset")


@graph_query(_BATCHES + """ SELECT batch, flow, list(source + node_offset ORDER BY graph_id, edge_id) AS sources, list(target + node_offset ORDER BY graph_id, edge_id) AS targets, list(position ORDER BY graph_id, edge_id) AS positions
 FROM edges JOIN placed USING (graph_id) GROUP BY batch, flow""")
def graph_batch_arrays(nodes, edges):
    return transforms.tuple_arrays(nodes, edges, BUDGET)


@graph_query(_TUPLE + " SELECT flow, source + node_offset AS source, target + node_offset AS target, position FROM edges JOIN offsets USING (graph_id)")
def graph_tuple_edges(nodes, edges):
    return transforms.tuple_adjacency(nodes, edges)


# breadth-first order is that of the least path of edges among the shortest ones
_SEQUENCE = """,
walk AS (
  SELECT graph_id, target AS node_id, 0::BIGINT AS depth, [edge_id] AS path, [target] AS nodes_of FROM edges WHERE flow = 2 AND source = 0
  UNION ALL
  SELECT w.graph_id, e.target, w.depth + 1, w.path || [e.edge_id], w.nodes_of || [e.target] FROM walk w
  JOIN edges e ON e.graph_id = w.graph_id AND e.source = w.node_id AND e.flow = 0 WHERE NOT list_contains(w.nodes_of, e.target)),
nearest AS (SELECT graph_id, node_id, min(depth) AS depth FROM walk GROUP BY ALL),
first AS (SELECT graph_id, node_id, depth, min(path) AS path FROM walk JOIN nearest USING (graph_id, node_id, depth) GROUP BY ALL)
SELECT graph_id, list(node_id ORDER BY depth, path) AS node_ids FROM first GROUP BY graph_id"""


@graph_query(_SEQUENCE, fits=True)
def instruction_sequence(nodes, edges, fits):
    return transforms.instruction_sequence(edges, fits=fits)


@graph_query(""" SELECT n.graph_id, '{"directed":true,"multigraph":true,"graph":{"function":[],"module":[]},"nodes":[' || n.j || '],"links":[' || e.j || ']}' AS json
 FROM (SELECT graph_id, string_agg('{"id":' || node_id || ',"type":' || type || ',"text":"' || text || '","function":0,"block":0}', ',' ORDER BY node_id) AS j FROM nodes GROUP BY graph_id) n
 JOIN (SELECT graph_id, string_agg('{"flow":' || flow || ',"position":' || position || ',"source":' || source || ',"target":' || target || ',"key":0}', ',' ORDER BY edge_id) AS j FROM edges GROUP BY graph_id) e USING (graph_id)""")
def node_link_json(nodes, edges):
    return transforms.node_link_json(nodes, edges)


@graph_query(""" SELECT graph_id, 'node' AS kind, node_id AS ord, 'n' || node_id || ' [label="' || text || '", style=filled, ' || ['shape=box, fillcolor="#3c78d8", fontcolor="#ffffff"',
   'shape=ellipse, fillcolor="#f4cccc", color="#990000", fontcolor="#990000"', 'shape=octagon, fillcolor="#e99c9c", color="#990000", fontcolor="#990000"',
   'shape=diamond, fillcolor="#cccccc", color="#cccccc", fontcolor="#222222"'][type + 1] || '];' AS line FROM nodes
 UNION ALL SELECT graph_id, 'edge', edge_id, 'n' || source || ' -> n' || target || ' [color="' || c || '", ' || ['weight=10', 'weight=0', 'weight=1', 'weight=1, penwidth="1.5"'][flow + 1]
   || CASE WHEN position = 0 THEN '' ELSE CASE WHEN flow = 0 THEN ', taillabel=' ELSE ', headlabel=' END || position || ', labelfontcolor="' || c || '"' END || '];'
 FROM (SELECT *, ['#345393', '#990000', '#65ae4d', '#aaaaaa'][flow + 1] AS c FROM edges)""")
def dot_lines(nodes, edges):
    return transforms.dot_lines(nodes, edges)


@graph_query(""" SELECT graph_id, node_id, CASE WHEN type = 1 THEN '!IDENTIFIER' WHEN type > 1 THEN '!IMMEDIATE' WHEN text IN ('add', 'sub') THEN text ELSE '!UNK' END AS token,
 (CASE WHEN type = 1 THEN 1 WHEN type > 1 THEN 2 WHEN text = 'add' THEN 3 WHEN text = 'sub' THEN 4 ELSE 0 END)::BIGINT AS token_id FROM nodes WHERE text <> '[external]'""")
def vocabulary_lookup(nodes, edges):
    spark = nodes.sparkSession
    vocabulary = spark.createDataFrame([("!UNK", 0), ("!IDENTIFIER", 1), ("!IMMEDIATE", 2), ("add", 3), ("sub", 4)], "text string, id int")
    return transforms.encode_vocabulary(nodes, vocabulary)


@query("SELECT o.o_orderkey, e.vec_id, len(e.embedding) AS dims FROM orders o JOIN embeddings e ON e.vec_id = o.o_orderkey % 97")
def embedding_lookup(spark, sf_dir):
    encoded = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 97).alias("token_id"))
    found = adapters.embed(encoded, _table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")).where("embedding IS NOT NULL")
    return found.select("o_orderkey", F.col("token_id").alias("vec_id"), F.size("embedding").cast("long").alias("dims"))


# an order's graph has one entry and one exit
@graph_query(" SELECT graph_id, max(target) FILTER (source = 0) AS entry, max(source) FILTER (target = 0) AS exit FROM edges WHERE flow = 2 GROUP BY graph_id")
def call_edges(nodes, edges):
    calls = edges.where("flow = 2")
    into = calls.where("source = 0").select("graph_id", F.col("target").alias("entry"))
    return into.join(calls.where("target = 0").select("graph_id", F.col("source").alias("exit")), "graph_id")


# validation


@graph_query(""" SELECT e.graph_id, e.edge_id, e.flow, e.source, e.target, a.type AS source_type, b.type AS target_type FROM edges e
 JOIN nodes a ON a.graph_id = e.graph_id AND a.node_id = e.source JOIN nodes b ON b.graph_id = e.graph_id AND b.node_id = e.target
 WHERE NOT CASE e.flow WHEN 0 THEN a.type = 0 AND b.type = 0 WHEN 1 THEN (a.type IN (1, 2) AND b.type = 0) OR (a.type = 0 AND b.type IN (1, 2)) OR (a.type IN (1, 2) AND b.type IN (1, 2))
   WHEN 2 THEN a.type = 0 AND b.type = 0 AND e.position = 0 ELSE a.type = 3 AND b.type IN (1, 2, 3) END""")
def edge_type_violations(nodes, edges):
    return validation.edge_violations(nodes, edges)


@graph_query(" SELECT graph_id, node_id, type FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND (e.source = n.node_id OR e.target = n.node_id) AND e.flow < 2)")
def strict_unconnected(nodes, edges):
    return validation.unconnected_nodes(nodes, edges.where("flow < 2"))


@query("SELECT o_orderkey AS graph_id, 0::BIGINT AS function_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def strict_empty_functions(spark, sf_dir):
    nodes, _ = order_graphs(spark, sf_dir)
    functions = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("graph_id"), F.lit(0).cast("long").alias("function_id"))
    return validation.empty_functions(functions, nodes.withColumn("function", F.lit(0).cast("long")))


# statistics


@graph_query(""" SELECT text, n AS count, round(sum(n) OVER (ORDER BY n DESC, text) / sum(n) OVER (), 6) AS cumulative_frequency FROM (SELECT text, count(*) AS n FROM nodes GROUP BY text)""")
def vocab_text(nodes, edges):
    return statistics.vocabulary(nodes)


@graph_query(""" SELECT text, n AS count, round(sum(n) OVER (ORDER BY n DESC, text) / sum(n) OVER (), 6) AS cumulative_frequency FROM (SELECT text, count(*) AS n FROM nodes WHERE type = 0 AND node_id > 0 GROUP BY text)""")
def vocab_instruction(nodes, edges):
    return statistics.vocabulary(nodes.where("type = 0 AND node_id > 0"))


@query("SELECT text, n AS count, round(sum(n) OVER (ORDER BY n DESC, text) / sum(n) OVER (), 6) AS cumulative_frequency FROM (SELECT event_type || ':' || user_id AS text, count(*) AS n FROM events GROUP BY 1)")
def vocab_events(spark, sf_dir):
    return statistics.vocabulary(_table(spark, sf_dir, "events").select(F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("text")))


@graph_query(""" SELECT n.graph_id, n.node_count, n.instruction_count, e.edge_count, e.max_position
 FROM (SELECT graph_id, count(*) AS node_count, count(*) FILTER (type = 0) AS instruction_count FROM nodes GROUP BY graph_id) n
 JOIN (SELECT graph_id, count(*) AS edge_count, max(position) AS max_position FROM edges GROUP BY graph_id) e USING (graph_id)""")
def graph_stats(nodes, edges):
    return statistics.graph_sizes(nodes, edges)


@graph_query(_REACH + " SELECT graph_id, root, count(*) AS label_count FROM found GROUP BY ALL")
def label_stats(nodes, edges):
    labels = analysis.reachability(nodes, edges, _instruction_roots(nodes, edges))
    return labels.where("value = 1").groupBy("graph_id", "root").agg(F.count("*").alias("label_count"))


@graph_query(""" SELECT n.type, x.flow, sum(x.o)::BIGINT AS out_edges, sum(x.i)::BIGINT AS in_edges
 FROM (SELECT graph_id, source AS node_id, flow, 1 AS o, 0 AS i FROM edges UNION ALL SELECT graph_id, target, flow, 0, 1 FROM edges) x JOIN nodes n USING (graph_id, node_id) GROUP BY ALL""")
def degree_stats(nodes, edges):
    return statistics.degrees(nodes, edges)


@query("""SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, round(quantile_cont(value, 0), 6) AS p0, round(quantile_cont(value, 0.5), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(quantile_cont(value, 1), 6) AS p100 FROM events""")
def runtime_percentiles(spark, sf_dir):
    return statistics.summary(_table(spark, sf_dir, "events"), "value")


@query("""SELECT doc_id, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, ((doc_id % 10007 * 7919 + 104729) % 10007) % 100 AS b FROM documents)""")
def split_random(spark, sf_dir):
    return statistics.random_split(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("""SELECT doc_id, lang, CASE WHEN rk <= floor(3 * n / 5) THEN 'train' WHEN rk <= floor(3 * n / 5) + floor(n / 5) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':0'), doc_id) AS rk, count(*) OVER (PARTITION BY lang) AS n FROM documents)""")
def split_stratified(spark, sf_dir):
    return statistics.stratified_split(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")


# scalar functions


@query("SELECT doc_id, sha256(text) AS sha256, CASE WHEN length(text) <= 32 THEN text ELSE substr(text, 1, 29) || '...' END AS short FROM documents")
def content_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), text.truncate(F.col("text")).alias("short"))


@query("""SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
  CASE WHEN substr(lower(o_orderpriority), 1, 1) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || o_orderpriority AS noun, epoch_ms(o_orderdate) AS millis FROM orders""")
def readable_orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.ordinal(F.col("o_orderkey")).alias("ordinal"), text.with_article(F.col("o_orderpriority")).alias("noun"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("millis"))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS name FROM events, (SELECT unnest(['page', 'ref', 'k']) AS k) WHERE json_extract_string(props, '$.' || k) IS NOT NULL")
def feature_values(spark, sf_dir):
    names = F.array(*map(F.lit, ("page", "ref", "k")))
    events = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("features"), F.explode(names).alias("name"))
    return events.select("event_id", F.try_element_at("features", F.col("name")).alias("value"), "name").where("value IS NOT NULL")


@graph_query(""" SELECT n.text, count(*) AS uses, count(DISTINCT e.graph_id) AS graphs FROM edges e JOIN nodes n ON n.graph_id = e.graph_id AND n.node_id = e.source WHERE e.flow = 1 GROUP BY n.text""")
def operand_texts(nodes, edges):
    sources = edges.where("flow = 1").select("graph_id", F.col("source").alias("node_id"))
    return sources.join(nodes.select("graph_id", "node_id", "text"), ["graph_id", "node_id"]).groupBy("text").agg(F.count("*").alias("uses"), F.countDistinct("graph_id").alias("graphs"))


@graph_query(" SELECT graph_id, node_id FROM nodes n WHERE type = 0 AND node_id > 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = n.graph_id AND e.source = n.node_id AND e.flow = 0)")
def exit_instructions(nodes, edges):
    return analysis.exits(nodes, edges)
