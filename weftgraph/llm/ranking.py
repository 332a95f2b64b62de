"""Grouped ranking with ties: the rows of each group whose place is ``k`` at most, by an external merge tree.

1. Each task sorts its rows with Arrow in runs of ``RUN_ROWS`` and writes them.  A pair that
   stands behind ``k`` others in its run does so in its group as well: such rows end here.
2. Runs are dealt by ranges of the whole order: groups, then pairs, then what breaks ties, and
   at last a hash of the row's place in its run, so no group, pair or copied row is too hot to
   be cut.
3. The task of a range merges its slices of the runs group by group with ``heapq``, as a tree of
   ``FAN`` streams to a node.  A merge stops as soon as the place exceeds ``k``; the row that
   shows this is the lookahead that ends the tie count of the pair before.
4. A group or pair may go on in other ranges.  Only the first and the last group of a range can,
   so two groups and 2 ``k`` pairs of each range are counted, and what lies before a range, or
   is tied in others, is added.  These tables grow with the number of ranges, which is a setting
   of the session (``spark.sql.shuffle.partitions``), and not with the rows.

A task holds one run, or one range.  A hot group costs no more than others: its pairs behind
the first ``k`` of each run are never shuffled.

Edge cases: nulls come last in every column, whatever its direction, and are equal to each
other, so null groups and pairs are groups and pairs of their own; equal rows are rows of their
own with a ``pos`` each; floating-point columns must hold no NaN; an empty table gives no rows;
only the named columns are carried, under the names given, and the results' names ``pos``,
``place`` and ``tied`` must not be among them; other columns of the input, whatever their names,
are left alone.  Rows hold no texts; long values only make tasks larger.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.scratch import Scratch

#: Rows to sort at once, and streams to a node of the merge tree.
RUN_ROWS, FAN = 1 << 18, 64


def changes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before in some of the columns; the first one does."""
    out = np.ones(table.num_rows, bool)
    if table.num_rows:
        out[1:] = False
    for name in names:
        column = table.column(name).combine_chunks()
        before, after = column.slice(0, max(0, len(column) - 1)), column.slice(1)
        null = column.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
    return out


def sorted_runs(order: list[tuple[str, str]], group: list[str], pair: list[str], k: int):
    """Kernel: the rows of a partition in sorted runs, without those behind ``k`` pairs of their group in the run."""
    names = [name for name, _ in order]

    def run(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_end"))
        starts = changes(table, group)
        pairs = np.cumsum(changes(table, group + pair))
        place = pairs - np.maximum.accumulate(np.where(starts, pairs, 0)) + 1
        table = table.filter(pa.array(place <= k))
        table = table.append_column("__run", pa.array(np.full(table.num_rows, number)))
        yield from table.append_column("__at", pa.array(np.arange(table.num_rows))).combine_chunks().to_batches(1 << 16)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, number = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            held.append(batch.select(names))
            rows += batch.num_rows
            if rows >= RUN_ROWS:
                yield from run(pa.Table.from_batches(held), number)
                held, rows, number = [], 0, number + 1
        if rows:
            yield from run(pa.Table.from_batches(held), number)

    return kernel


def tree(streams: list, key) -> Iterator[int]:
    """The streams merged lazily, ``FAN`` of them to a node."""
    while len(streams) > FAN:
        streams = [heapq.merge(*streams[i : i + FAN], key=key) for i in range(0, len(streams), FAN)]
    return heapq.merge(*streams, key=key)


def _comparable(table: pa.Table, order: list[tuple[str, str]]) -> list[tuple]:
    """A tuple for each row that compares in the order, nulls last."""
    columns = []
    for name, way in order:
        values = table.column(name).to_pylist()
        if way == "descending":
            values = [None if v is None else -v for v in values]
        columns.append([(1,) if v is None else (0, v) for v in values] if None in values else values)
    return list(zip(*columns, strict=True))


def merge_ranges(order: list[tuple[str, str]], group: list[str], pair: list[str], k: int):
    """Kernel over the rows of a range: those with ``pos``, ``place`` and ``tied`` inside it, and whether their group may go on elsewhere."""
    inner = order[len(group) :]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        # slices of runs come in any order, and each is sorted
        table = table.take(pc.sort_indices(table, sort_keys=[("__run", "ascending"), ("__at", "ascending")]))
        begins = np.flatnonzero(changes(table, ["__run", *group]))
        ends = np.append(begins[1:], table.num_rows)
        heads = _comparable(table.take(pa.array(begins)), order[: len(group)])
        slices: dict[tuple, list[range]] = {}
        for head, start, end in zip(heads, begins.tolist(), ends.tolist(), strict=True):
            slices.setdefault(head, []).append(range(start, end))
        keys, width = _comparable(table, inner), len(pair)
        rows, pos, place, tied, edge = [], [], [], [], []
        # nulls make nested tuples: a group with one in some head is told apart, and sorts last
        heads = sorted(slices, key=lambda h: tuple(x if isinstance(x, tuple) else (0, x) for x in h))
        for head in heads:
            at, count, current, first = 0, 0, None, len(rows)
            for i in tree(slices[head], keys.__getitem__):
                if keys[i][:width] != current:
                    tied.extend([count] * count)
                    current, at, count = keys[i][:width], at + 1, 0
                    if at > k:
                        break
                count += 1
                rows.append(i)
                place.append(at)
            tied.extend([count] * count)
            pos.extend(range(1, len(rows) - first + 1))
            edge.extend([head == heads[0] or head == heads[-1]] * (len(rows) - first))
        out = table.select([name for name, _ in order]).take(pa.array(rows, pa.int64()))
        part = TaskContext.get().partitionId()
        for name, values, kind in (("pos", pos, pa.int64()), ("place", place, pa.int64()), ("tied", tied, pa.int64()), ("__edge", edge, pa.bool_()), ("__part", [part] * len(rows), pa.int32())):
            out = out.append_column(name, pa.array(values, kind))
        yield from out.combine_chunks().to_batches(1 << 16)

    return kernel


def _same(columns: list[str]) -> Column:
    found = F.lit(True)
    for c in columns:
        found &= F.col(f"`{c}`").eqNullSafe(F.col(f"`={c}`"))
    return found


def top_places(rows: DataFrame, group: list[str], pair: list[tuple[str, bool]], ties: list[str], k: int) -> DataFrame:
    """The rows whose place in their group is ``k`` or less, with ``pos, place, tied``.

    ``pair`` has the columns that places are counted by, and whether the larger comes first;
    such columns must be numbers.  ``ties`` order equal pairs, ascending.  A row's place is 1 plus
    the different pairs before it, ``pos`` its number in its group, ``tied`` the rows with its pair.
    """
    if not group or not pair:
        raise ValueError("name at least one column of groups and one of pairs")
    scratch = Scratch(rows.sparkSession)
    order = [(c, "ascending") for c in group] + [(c, "descending" if down else "ascending") for c, down in pair] + [(c, "ascending") for c in ties]
    names, pairs = [c for c, _ in order], [c for c, _ in pair]
    picked = rows.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    runs = scratch.keep(picked.mapInArrow(sorted_runs(order, group, pairs, k), f"{schema}, __run long, __at long"), "runs")
    ranges = [F.col(c).desc_nulls_last() if way == "descending" else F.col(c).asc_nulls_last() for c, way in order]
    dealt = runs.repartitionByRange(*ranges, F.xxhash64("__run", "__at").asc())
    merged = scratch.keep(dealt.mapInArrow(merge_ranges(order, group, pairs, k), f"{schema}, pos long, place long, tied long, __edge boolean, __part int"), "merged")

    edge = merged.where("__edge")
    pair_of = F.struct(*pairs)
    groups = edge.groupBy(F.col("__part").alias("__of"), *[F.col(c).alias(f"={c}") for c in group]).agg(F.count("*").alias("n"), F.max("place").alias("d"), F.min_by(pair_of, "place").alias("low"), F.max_by(pair_of, "place").alias("high"))
    ranged = Window.partitionBy(*[f"={c}" for c in group]).orderBy("__of")
    before = ranged.rowsBetween(Window.unboundedPreceding, -1)
    # a pair that goes on from the range before is one pair, not two
    groups = groups.withColumn("on", F.coalesce(F.lag("high").over(ranged) == F.col("low"), F.lit(False)).cast("long"))
    shifts = groups.select("__of", *[f"={c}" for c in group], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"), (F.coalesce(F.sum("d").over(before), F.lit(0)) - F.sum("on").over(ranged.rowsBetween(Window.unboundedPreceding, 0))).alias("_places"))
    whole = edge.groupBy(*[F.col(c).alias(f"={c}") for c in group + pairs]).agg(F.count("*").alias("_whole"))
    # both: some rows for each range
    found = merged.join(F.broadcast(shifts), (F.col("__part") == F.col("__of")) & _same(group), "left").drop("__of", *[f"={c}" for c in group])
    found = found.join(F.broadcast(whole), F.col("__edge") & _same(group + pairs), "left")
    place = F.col("place") + F.coalesce("_places", F.lit(0))
    return found.select(*names, (F.col("pos") + F.coalesce("_rows", F.lit(0))).alias("pos"), place.alias("place"), F.coalesce("_whole", "tied").alias("tied")).where(F.col("place") <= k)


def finite(value: Column) -> Column:
    """Null for what is no finite number."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def sale_ranks(lines: DataFrame, k: int = 5) -> DataFrame:
    """``vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied`` of sale lines, all long.

    Groups are vendor, parity of the item (null: -1) and month (null: -1), but a fifth of the
    sales, by crc32, is one group with -1 for all three.  NaN and infinite amounts or discounts
    count as null.
    """
    pooled = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    grouped = lambda c: F.when(pooled, F.lit(-1)).otherwise(c).cast("long")
    cents = lambda c: F.floor(100 * finite(F.col(c)) + 0.5).cast("long")
    rows = lines.select(
        grouped(F.col("vendor_id")).alias("vendor_id"),
        grouped(F.coalesce(F.col("item_id") % 2, F.lit(-1))).alias("part"),
        grouped(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"),
        cents("discount").alias("percent"),
        F.col("sale_id").cast("long"),
        F.col("line_no").cast("long"),
        F.col("quantity").cast("long"),
        cents("amount").alias("amount_cents"),
    )
    found = top_places(rows, ["vendor_id", "part", "month"], [("tens", True), ("percent", False)], ["sale_id", "line_no", "quantity", "amount_cents"], k)
    return found.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: The checksum's table and steps are those of CRC-32: a polynomial, eight shifts for each byte.
ORACLE = r"""
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
crc AS (
  SELECT sale_id, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(sale_id::VARCHAR) + 1), lambda i: ascii(substr(sale_id::VARCHAR, i::INT, 1))::BIGINT)),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM ids, t),
g AS (
  SELECT coalesce(h % 5 = 0, false) AS pooled, vendor_id, coalesce(item_id % 2, -1) AS part, coalesce(100 * year(shipped_at) + month(shipped_at), -1) AS month,
         floor(quantity / 10)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, l.sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity,
         floor(100 * amount + 0.5)::BIGINT AS amount_cents
  FROM sale_lines l LEFT JOIN crc ON l.sale_id = crc.sale_id),
r AS (
  SELECT CASE WHEN pooled THEN -1 ELSE vendor_id END::BIGINT AS vendor_id, CASE WHEN pooled THEN -1 ELSE part END::BIGINT AS part,
         CASE WHEN pooled THEN -1 ELSE month END::BIGINT AS month, tens, percent, sale_id, line_no, quantity, amount_cents FROM g),
p AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
         dense_rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST) AS place,
         count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM r)
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM p WHERE place <= 5
"""
