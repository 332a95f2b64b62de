"""Running sums, ranks and selections in the order of all rows, without one task that sees them all.

Rows are dealt to range partitions and written, so that every pass sees the same ones.  Each
partition counts its own rows; what lies before it comes from a table with one or two rows
for each partition, whose size is that of the session's partitions and not of the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.scratch import Scratch


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, scratch: Scratch, label: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and with each row in the order of all rows.

    Sums are taken inside range partitions and shifted by the totals of the partitions
    before.  The ranges are written first, so that totals and rows see the same ones.
    """
    ranged = scratch.keep(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), label)
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row for each range partition, so its size is bounded by their number
    return ranged.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.sum(value).over(within)).drop("__part", "__before")


def ranks_within(df: DataFrame, keys: list[str], order: list[Column], scratch: Scratch, label: str, rank: str = "rank", size: str | None = None) -> DataFrame:
    """Add ``rank``, from 1, of each row among the rows with its ``keys`` in ``order``, and ``size``, their number.

    Ranges are cut by keys and order together, so a hot key is spread over many partitions as
    far as ``order`` tells its rows apart.  In its partition a key that is neither the first
    nor the last one is whole; only for those two do rows lie elsewhere, and only theirs are
    counted before.  Null keys are equal to each other.
    """
    ranged = scratch.keep(df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("__part", F.spark_partition_id()), label)
    key, names = F.struct(*keys), [f"__key{i}" for i in range(len(keys))]
    ends = ranged.groupBy("__part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select(F.col("__part").alias("__at"), F.explode(F.array("low", "high")).alias("key")).distinct()
    ends = ends.select("__at", *[F.col("key")[k].alias(n) for k, n in zip(keys, names, strict=True)])

    def same(part: str) -> Column:
        found = F.col("__part") == F.col(part)
        for k, n in zip(keys, names, strict=True):
            found &= F.col(k).eqNullSafe(F.col(n))
        return found

    # two rows for each range partition at most, here and below
    counts = ranged.join(F.broadcast(ends), same("__at"), "left_semi").groupBy(F.col("__part").alias("__at"), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias("__n"))
    of_key = Window.partitionBy(*names)
    before = of_key.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__at", *names, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(of_key).alias("__all"))
    here = Window.partitionBy("__part", *keys)
    local = ranged.withColumn("__local", F.row_number().over(here.orderBy(*order)))
    if size is not None:
        local = local.withColumn("__here", F.count("*").over(here))
    found = local.join(F.broadcast(shifts), same("__at"), "left").withColumn(rank, (F.col("__local") + F.coalesce("__before", F.lit(0))).cast("long"))
    if size is not None:
        found = found.withColumn(size, F.coalesce("__all", "__here").cast("long")).drop("__here")
    return found.drop("__part", "__local", "__at", "__before", "__all", *names)


def values_at(df: DataFrame, column: str, ranks: list[int], scratch: Scratch, label: str) -> dict[int, object]:
    """The values of ``column`` at some ranks, from 0, in ascending order; nulls are left out.

    Equal values are counted together first.  Of the range partitions of the different values
    only the sizes are looked at, and then the rows of those that hold a wanted rank.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = scratch.keep(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()), label)
    wanted: dict[int, list[int]] = {}
    start, starts = 0, {}
    for row in ranged.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each partition
        inside = [r for r in ranks if start <= r < start + row["n"]]
        if inside:
            wanted[row["part"]], starts[row["part"]] = inside, start
        start += row["n"]
    found: dict[int, object] = {}
    for part, inside in wanted.items():
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
        rows = ranged.where(F.col("part") == part).withColumn("upto", upto)
        hit = F.filter(F.array(*[F.lit(r - starts[part]) for r in inside]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
        for row in rows.select("value", F.explode(hit).alias("rank")).collect():  # a row for each wanted rank
            found[row["rank"] + starts[part]] = row["value"]
    return found


def next_starts(upto: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """For a bin that starts at each row: the row that starts the next one, or the number of rows."""
    return np.maximum(np.searchsorted(upto, upto - size + most, side="right"), np.arange(len(upto)) + 1)


def last_starts(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last start of the chain from each row, and the starts of the chain, by jumps twice as long each time."""
    rows = len(after)
    jump = np.append(after, rows)
    last, count = np.arange(rows + 1), np.append(np.ones(rows, np.int64), 0)
    while (jump[:rows] < rows).any():
        last, count = np.where(jump < rows, last[jump], last), count + count[jump]
        jump = jump[jump]
    return last[:rows], count[:rows]


def consecutive_bins(df: DataFrame, order: list[Column], size: str, most: int, number: str, offset: str, scratch: Scratch, label: str) -> DataFrame:
    """``df`` with ``number``, the bin of each row, and ``offset``, the sizes before it in its bin.

    Bins are consecutive rows in ``order`` whose sizes, integers from 1, sum up to ``most`` or
    less, or one row; each takes as many as it can.  A bin that goes on into a range partition
    ends within ``most`` of its beginning, so only rows there can be the partition's first start:
    for each the chain of starts through the partition is followed by jump pointers.  These
    tables, ``most`` rows for a partition at most, are read one after the other, in order; what
    is held of them is where the last bin began.
    """
    base = df.drop(offset) if offset in df.columns else df
    columns = base.columns
    summed = scratch.keep(running_sum(base, order, size, "__upto", scratch, f"{label}-sums").repartitionByRange("__upto").sortWithinPartitions("__upto").withColumn("__part", F.spark_partition_id()), label)

    def entries(part: pa.Table) -> pa.Table:
        part = part.sort_by("__upto")
        upto, sizes = part.column("__upto").to_numpy(), part.column("__size").to_numpy()
        last, count = last_starts(next_starts(upto, sizes, most))
        few = np.append(0, upto)[:-1] - (upto[0] - sizes[0]) <= most if len(upto) else np.zeros(0, bool)
        few[:1] = True
        low = upto - sizes
        return pa.table({"part": part.column("__part").filter(few), "low": low[few], "upto": upto[few], "began": low[last][few], "starts": count[few]})

    found = summed.select("__part", "__upto", F.col(size).cast("long").alias("__size")).groupBy("__part").applyInArrow(entries, "part int, low long, upto long, began long, starts long")
    # part: (bin that goes on into it, where that began, first start of its own, the number of that)
    state: dict[int, tuple] = {}
    began, before = None, 0
    for row in scratch.keep(found, f"{label}-entries").orderBy("part", "low").toLocalIterator():
        coming = state.setdefault(row["part"], (before - 1, began or 0, None, 0))
        if coming[2] is None and (began is None or row["upto"] > began + most):
            state[row["part"]] = (*coming[:2], row["low"], before)
            began, before = row["began"], before + row["starts"]

    def numbered(part: pa.Table) -> pa.Table:
        part = part.sort_by("__upto")
        upto, sizes = part.column("__upto").to_numpy(), part.column(size).to_numpy()
        low, after = upto - sizes, next_starts(upto, sizes, most)
        bin_, start, entry, first = state[part.column("__part")[0].as_py()]
        at, starts = len(upto) if entry is None else int(np.searchsorted(low, entry)), []
        while at < len(upto):
            starts.append(at)
            at = int(after[at])
        local = np.searchsorted(np.array(starts, np.int64), np.arange(len(upto)), side="right")
        begins = np.append(start, low[starts])[local]
        out = part.select(columns).append_column(number, pa.array(np.where(local > 0, first + local - 1, bin_)))
        return out.append_column(offset, pa.array(low - begins))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return summed.groupBy("__part").applyInArrow(numbered, f"{schema}, `{number}` long, `{offset}` long")
