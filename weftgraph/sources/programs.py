"""Programs made from orders, as LLVM text and as HLO rows: an order is a module, its lines are instructions.

Line ``k`` computes ``%vk`` from ``%v(k-1)`` (the argument for the first): returned lines call an
external function, others calculate with a constant.  After a finished line a block ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources.orders import _LINES

_BODY = """concat('  %v', rn, ' = ', CASE WHEN flag = 'R' THEN concat('call i32 @ext(i32 ', before, ')')
  ELSE concat(CASE flag WHEN 'A' THEN 'add' ELSE 'sub' END, ' i32 ', before, ', ', l_suppkey % 4) END,
  CASE WHEN status = 'F' AND rn < n THEN concat('\\n  br label %b', rn, '\\n\\nb', rn, ':') ELSE '' END)"""


def order_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ir_id, text``: the LLVM text of each order."""
    lines = spark.sql(_LINES.format(lineitem="{lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    made = lines.selectExpr("*", "CASE WHEN rn = 1 THEN '%a' ELSE concat('%v', rn - 1) END AS before").selectExpr("graph_id", "n", f"struct(rn, {_BODY} AS body) AS line")
    grouped = made.groupBy("graph_id", "n").agg({"line": "collect_list"}).withColumnRenamed("collect_list(line)", "lines")
    body = "array_join(transform(array_sort(lines), x -> x.body), '\\n')"
    text = f"""concat('source_filename = "order-', graph_id, '.c"\\n\\ndeclare i32 @ext(i32)\\n\\ndefine i32 @f(i32 %a) {{\\nentry:\\n', {body}, '\\n  ret i32 %v', n, '\\n}}\\n')"""
    return grouped.selectExpr("graph_id AS ir_id", f"{text} AS text")


def order_hlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ir_id, module``: the HLO rows of each order: a parameter, then an addition for each line, with a constant for each."""
    lines = spark.sql(_LINES.format(lineitem="{lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    none = "CAST(array() AS array<bigint>)"
    shape = "named_struct('type', 'F32', 'dimensions', array(CAST(l_suppkey % 4 AS bigint)))"
    row = lambda i, name, opcode, operands, literal: f"named_struct('id', {i}, 'name', {name}, 'opcode', '{opcode}', 'shape', {shape}, 'operand_ids', {operands}, 'control_predecessor_ids', {none}, 'called_computation_ids', {none}, 'literal', {literal})"
    constant = row("2 * rn", "concat('c', rn)", "constant", none, "'F32 []'")
    add = row("2 * rn + 1", "concat('a', rn)", "add", "array(CASE WHEN rn = 1 THEN 1 ELSE 2 * rn - 1 END, 2 * rn)", "CAST(NULL AS STRING)")
    parameter = row("CAST(1 AS bigint)", "'p'", "parameter", none, "CAST(NULL AS STRING)").replace("l_suppkey % 4", "3")
    made = lines.selectExpr("graph_id", f"struct(rn, {constant} AS c, {add} AS a) AS line").groupBy("graph_id").agg({"line": "collect_list"}).withColumnRenamed("collect_list(line)", "lines")
    instructions = f"concat(array({parameter}), flatten(transform(array_sort(lines, (x, y) -> CAST(x.rn - y.rn AS INT)), x -> array(x.c, x.a))))"
    return made.selectExpr("graph_id AS ir_id", f"named_struct('name', concat('m', graph_id), 'entry_computation_id', 9L, 'computations', array(named_struct('id', 9L, 'name', 'main', 'instructions', {instructions}))) AS module")
