"""Program graphs made from orders: each order is a function, each of its lines an instruction.

Lines are numbered in a total order.  Node 0 is the root; instruction ``rn`` defines
variable ``n + rn`` and uses the variable of a line shortly before and a constant.
Control goes to the next line, from returned lines also to the one after it, and from
accepted, finished lines back to the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SCAN = """
  SELECT {key} AS graph_id, l_partkey, l_suppkey, l_returnflag AS flag, l_linestatus AS status,
         CAST(row_number() OVER (PARTITION BY {key} ORDER BY {first}l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) AS rn,
         CAST(count(*) OVER (PARTITION BY {key}) AS BIGINT) AS n
  FROM {lineitem}"""

_LINES = _SCAN.replace("{key}", "l_orderkey").replace("{first}", "")
#: Orders to a graph in wide graphs, which then have some 580 nodes.
WIDE = 64
_WIDE_LINES = _SCAN.replace("{key}", f"(l_orderkey - l_orderkey % {WIDE}) / {WIDE}").replace("{first}", "l_orderkey, ")

_NODES = """
  SELECT graph_id, CAST(0 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS type, '[external]' AS text FROM {li} WHERE rn = 1
  UNION ALL SELECT graph_id, rn, 0, CASE flag WHEN 'A' THEN 'add' WHEN 'N' THEN 'sub' ELSE 'mul' END FROM {li}
  UNION ALL SELECT graph_id, n + rn, 1, 'var' FROM {li}
  UNION ALL SELECT DISTINCT graph_id, 2 * n + 1 + l_suppkey % 4, 2, 'val' FROM {li}
  UNION ALL SELECT graph_id, 2 * n + 5, 3, 'i32' FROM {li} WHERE rn = 1"""

_EDGES = """
  SELECT graph_id, flow, position, source, target,
         CAST(row_number() OVER (PARTITION BY graph_id ORDER BY flow, source, target, position) - 1 AS BIGINT) AS edge_id
  FROM (
    SELECT graph_id, CAST(0 AS BIGINT) AS flow, CAST(0 AS BIGINT) AS position, rn AS source, rn + 1 AS target FROM {li} WHERE rn < n
    UNION ALL SELECT graph_id, 0, 1, rn, rn + 2 FROM {li} WHERE flag = 'R' AND rn + 2 <= n
    UNION ALL SELECT graph_id, 0, 2, rn, rn - 1 FROM {li} WHERE flag = 'A' AND status = 'F' AND rn > 1
    UNION ALL SELECT graph_id, 1, 0, rn, n + rn FROM {li}
    UNION ALL SELECT graph_id, 1, 0, n + 1 + l_partkey % least(rn - 1, 2), rn FROM {li} WHERE rn > 1
    UNION ALL SELECT graph_id, 1, 1, 2 * n + 1 + l_suppkey % 4, rn FROM {li}
    UNION ALL SELECT graph_id, 2, 0, 0, 1 FROM {li} WHERE rn = 1
    UNION ALL SELECT graph_id, 2, 0, n, 0 FROM {li} WHERE rn = n
    UNION ALL SELECT graph_id, 3, 0, 2 * n + 5, n + rn FROM {li}
  ) e"""


#: The same tables as DuckDB expressions, to head a query.
def _head(lines: str) -> str:
    return "WITH RECURSIVE li AS MATERIALIZED (" + lines.format(lineitem="lineitem") + "),\nnodes AS MATERIALIZED (" + _NODES.format(li="li") + "),\nedges AS MATERIALIZED (" + _EDGES.format(li="li") + ")"


ORACLE_HEAD, WIDE_HEAD = _head(_LINES), _head(_WIDE_LINES.replace(" / ", " // "))


def _made(columns: list[str], parts: list[tuple]) -> Column:
    """The rows of ``columns`` that a line makes, a null for each part (condition, values...) that does not hold."""
    return F.array(*[F.when(F.expr(when), F.struct(*[F.expr(f"CAST({v} AS {'STRING' if c == 'text' else 'BIGINT'})").alias(c) for c, v in zip(columns, values, strict=True)])) for when, *values in parts])


def _rows(lines: DataFrame, columns: list[str], parts: list[tuple]) -> DataFrame:
    """One row of ``columns`` for each part that holds for a line: one pass, no union.

    What does not hold goes after the explode: a lambda would keep Spark from compiling the stage.
    """
    return lines.select("graph_id", F.explode(_made(columns, parts)).alias("made")).where("made IS NOT NULL").select("graph_id", "made.*")


def _lines(spark: SparkSession, sf_dir: str, wide: bool) -> DataFrame:
    """The rows of ``_LINES`` or ``_WIDE_LINES``.

    ``graph_id`` is there before the lines are shuffled by it: Spark then knows that whatever is
    made of them lies by graph, and shuffles nothing else.
    """
    key = f"(l_orderkey - l_orderkey % {WIDE}) DIV {WIDE}" if wide else "l_orderkey"
    scan = _SCAN.format(key="graph_id", first="l_orderkey, " if wide else "", lineitem=f"(SELECT *, CAST({key} AS BIGINT) AS graph_id FROM {{lineitem}})")
    # columns get their new names after the shuffle, which so is the same for nodes and edges and done once
    scan = f"SELECT graph_id, l_partkey, l_suppkey, l_returnflag AS flag, l_linestatus AS status, rn, n FROM ({scan})".replace("l_returnflag AS flag, l_linestatus AS status,\n", "l_returnflag, l_linestatus,\n")
    return spark.sql(scan, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


#: Lines of a graph that fits in one row at most, with its edges and the states of any analysis.
MOST_LINES = 1000


def all_fit(spark: SparkSession, sf_dir: str, wide: bool = False, most_lines: int = MOST_LINES) -> bool:
    """Whether no graph has more lines: nothing made of it needs to be counted before it is packed."""
    key = F.expr(f"(l_orderkey - l_orderkey % {WIDE}) DIV {WIDE}" if wide else "l_orderkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(key.alias("graph_id")).agg(F.count("*").alias("n"))
    return lines.where(F.col("n") > most_lines).isEmpty()


#: Rows that a line makes: where, and the values of the columns.
_NODE_COLUMNS, _EDGE_COLUMNS = ["node_id", "type", "text"], ["flow", "position", "source", "target"]
_NODE_ROWS = [
    ("rn = 1", "0", "0", "'[external]'"),
    ("true", "rn", "0", "CASE flag WHEN 'A' THEN 'add' WHEN 'N' THEN 'sub' ELSE 'mul' END"),
    ("true", "n + rn", "1", "'var'"),
    ("first", "2 * n + 1 + l_suppkey % 4", "2", "'val'"),
    ("rn = 1", "2 * n + 5", "3", "'i32'"),
]
_EDGE_ROWS = [
    ("rn < n", "0", "0", "rn", "rn + 1"),
    ("flag = 'R' AND rn + 2 <= n", "0", "1", "rn", "rn + 2"),
    ("flag = 'A' AND status = 'F' AND rn > 1", "0", "2", "rn", "rn - 1"),
    ("true", "1", "0", "rn", "n + rn"),
    ("rn > 1", "1", "0", "n + 1 + l_partkey % least(rn - 1, 2)", "rn"),
    ("true", "1", "1", "2 * n + 1 + l_suppkey % 4", "rn"),
    ("rn = 1", "2", "0", "0", "1"),
    ("rn = n", "2", "0", "n", "0"),
    ("true", "3", "0", "2 * n + 5", "n + rn"),
]


def order_graphs(spark: SparkSession, sf_dir: str, wide: bool = False) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (graph_id, node_id, type, text) and ``edges`` (graph_id, edge_id, flow, position, source, target).

    ``wide`` graphs hold the lines of ``WIDE`` orders.

    All windows are over one graph, so lines are shuffled once for each table.
    """
    lines = _lines(spark, sf_dir, wide)
    first = F.row_number().over(Window.partitionBy("graph_id", F.expr("l_suppkey % 4")).orderBy("rn")) == 1
    nodes = _rows(
        lines.withColumn("first", first),
        _NODE_COLUMNS,
        _NODE_ROWS,
    )
    edges = _rows(
        lines,
        _EDGE_COLUMNS,
        _EDGE_ROWS,
    )
    order = Window.partitionBy("graph_id").orderBy("flow", "source", "target", "position")
    return nodes, edges.withColumn("edge_id", (F.row_number().over(order) - 1).cast("long"))


def order_rows(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """``graph_id, nodes, edges`` for each line: the rows of ``order_graphs`` that it makes, edges without ids, and nulls among them.

    The lines of a graph follow each other, as they are sorted by it and nothing is shuffled after.  A graph
    without an id has no edges.  Lists are not exploded: each row that goes to Python has its price.
    """
    # the first line of each rest of l_suppkey by a window that needs no sort of its own
    rest, whole = F.expr("l_suppkey % 4"), Window.partitionBy("graph_id")
    lines = _lines(spark, sf_dir, wide).withColumns({f"first_{i}": F.min(F.when(rest.eqNullSafe(F.lit(x)), F.col("rn"))).over(whole) for i, x in enumerate(_RESTS)})
    firsts = F.array(*[F.col(f"first_{i}") for i in range(len(_RESTS))])
    lines = lines.withColumn("first", F.array_contains(firsts, F.col("rn")))
    edges = [(f"graph_id IS NOT NULL AND ({when})", *values) for when, *values in _EDGE_ROWS]
    return lines.select("graph_id", _made(_NODE_COLUMNS, _NODE_ROWS).alias("nodes"), _made(_EDGE_COLUMNS, edges).alias("edges"))


#: What is left of a number divided by four.
_RESTS = [None, -3, -2, -1, 0, 1, 2, 3]
