"""Mixing sources to target weights by weighted fair queueing.

Each source holds its documents in a shuffled order (by a hash of the id).  A copy of
a document finishes at the virtual time of its source's cumulative words divided by
the source's weight; a source may be gone through ``most`` times.  All copies are
sorted by virtual time over range partitions, and the mix ends where the budget, all
words there are, is spent.

A source that runs out leaves its share to the others by weight, which is also how
the targets are made: shares by weight, each at most ``most`` times the source.

Only sizes are shuffled, never texts.  Sums along an order are taken inside range
partitions and shifted by the totals of the partitions before, so a hot source is
spread over many tasks.

Edge cases: null and empty texts have size 0 and are never taken; very long texts count
whole; a null source is a source of its own, last in order; ties in hash go by id and then
size; rows with the same id, or none, are documents of their own, and which of those that
are equal in id, source and size is taken more often does not matter for the sums; an empty
table gives an empty result; columns of the input with the names of results, or any other,
are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, unused
from weftgraph.plans.ordered import running_sum
from weftgraph.plans.scratch import Scratch


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int, scratch: Scratch) -> DataFrame:
    """``source, source_size, before, weight, target`` from ``source, source_size``."""
    ranked = running_sum(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "one", "rank", scratch, "sources")
    placed = running_sum(ranked.drop("one"), [F.col("rank").asc()], "source_size", "upto", scratch, "ranked")
    turn = F.array(*map(F.lit, weights))
    placed = placed.withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    placed = scratch.keep(placed.withColumn("before", F.col("upto") - F.col("source_size")), "placed")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    capped, rest, total, ended = F.lit(False), None, None, -1
    while True:  # each round caps at least one more source; one row comes back
        one = placed.select(capped.alias("capped"), "weight", "source_size").agg(
            F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("w"),
            F.sum("source_size").alias("all"),
            F.sum(F.when(F.col("capped"), F.col("source_size") * most)).alias("used"),
            F.count(F.when(F.col("capped"), 1)).alias("n"),
        ).first()
        if one["n"] == ended or one["w"] is None:
            break
        ended, total = one["n"], one["w"]
        rest = (one["all"] or 0) - (one["used"] or 0)
        capped = wide("source_size") * most * F.lit(total).cast("decimal(18,0)") < wide("weight") * F.lit(rest).cast("decimal(18,0)")
    share = (F.col("weight") * F.lit(rest or 0)).cast("double") / F.lit(float(total or 1))
    return placed.select("source", "source_size", "before", "weight", F.when(capped, (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", row: str | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``, and the column ``row`` if named, for each row of ``docs``.

    ``copies`` is how often the mix holds the document, ``taken`` its words times that.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    spread = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    more = [row] if row else []
    sized = scratch.keep(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), spread.alias("spread"), *more), "sized")
    targets = scratch.keep(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, scratch), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("spread").asc(), F.col("doc_id").asc(), F.col("size").asc()]
    placed = running_sum(sized, order, "size", "upto", scratch, "ordered")
    # each range partition holds few sources, so the sources' rows meet by key without a hot one: AQE splits it
    named = placed.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    named = scratch.keep(named.withColumn("upto", F.col("upto") - F.col("before")), "named")

    def finish(epoch: Column | int) -> Column:
        return (F.lit(epoch) * F.col("source_size") + F.col("upto")).cast("double") / F.col("weight").cast("double")

    copies = named.where("size > 0").select(F.explode(F.array(*map(F.lit, range(most)))).alias("epoch"), "doc_id", "spread", "size", "source_size", "upto", "weight")
    copies = copies.select(finish(F.col("epoch")).alias("finish"), "spread", "doc_id", "epoch", "size")
    queue = running_sum(copies, [F.col(c).asc() for c in ("finish", "spread", "doc_id", "epoch")], "size", "spent", scratch, "queue")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    last = queue.where(F.col("spent") <= budget).agg(F.max(F.struct("finish", "spread", "doc_id", "epoch")).alias("cut")).first()["cut"]
    if last is None:
        count = F.lit(0)
    else:
        cut = F.struct(F.lit(last["finish"]), F.lit(last["spread"]), F.lit(last["doc_id"]).cast(docs.schema[key].dataType), F.lit(last["epoch"]))
        count = sum((F.when(F.struct(finish(e), F.col("spread"), F.col("doc_id"), F.lit(e)) <= cut, 1).otherwise(0) for e in range(most)), F.lit(0))
        count = F.when(F.col("size") > 0, count).otherwise(0)
    return named.select("doc_id", "source", "size", "source_size", "target", count.alias("copies"), (F.col("size") * count).cast("long").alias("taken"), *more)


def mixed_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows are told apart by a key of their own."""
    scratch = Scratch(docs.sparkSession)
    row = unused(docs, "__row")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = unused(rows, "__copies")
    taken = mix(rows, key, row=row, **options).where("copies > 0").select(row, F.col("copies").alias(copies))
    joined = rows.join(taken, row)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).drop(copies)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 15))::BIGINT AS spread
  FROM documents),
src AS (
  SELECT source, sum(size)::HUGEINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
fill AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
         sum(weight::HUGEINT) OVER () - coalesce(sum(weight::HUGEINT) OVER before, 0) AS total
  FROM src WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT rest, total FROM fill WHERE 3 * source_size * total >= weight * rest ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size, weight,
         CASE WHEN 3 * source_size * stop.total < weight * stop.rest THEN (3 * source_size)::DOUBLE
              ELSE (weight * stop.rest)::DOUBLE / stop.total::DOUBLE END AS target
  FROM src, stop),
placed AS (
  SELECT s.*, t.source_size, t.weight, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spread, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, spread, size, epoch, (epoch * source_size + upto)::DOUBLE / weight::DOUBLE AS finish
  FROM placed, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0),
queue AS (
  SELECT *, sum(size) OVER (ORDER BY finish, spread, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS spent FROM copies),
taken AS (SELECT doc_id, count(*) AS copies FROM queue WHERE spent <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target, (p.size * coalesce(t.copies, 0))::BIGINT AS taken
FROM placed p LEFT JOIN taken t USING (doc_id)
"""
