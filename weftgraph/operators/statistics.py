"""Vocabularies, counts of graphs and labels, and splits of datasets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.ordered import ranks_within, running_sum, values_at
from weftgraph.plans.scratch import Scratch


def vocabulary(texts: DataFrame, text: str = "text", total_nodes: int | None = None) -> DataFrame:
    """``text, count, cumulative_frequency`` in falling order of counts, ties by text; no text is lost to a tie.

    With ``total_nodes`` also ``cumulative_node_frequency``, against all nodes there are.
    """
    counts = texts.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("count"))
    scratch = Scratch(texts.sparkSession)
    counts = scratch.keep(counts, "counts")
    total = counts.agg(F.sum("count")).first()[0] or 1
    summed = running_sum(counts, [F.col("count").desc(), F.col("text").asc_nulls_last()], "count", "upto", scratch, "ordered")
    more = [F.round(F.col("upto") / F.lit(max(1, total_nodes)), 6).alias("cumulative_node_frequency")] if total_nodes is not None else []
    return summed.select("text", "count", F.round(F.col("upto") / F.lit(total), 6).alias("cumulative_frequency"), *more)


def frequency_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The four vocabularies of a corpus: node texts, instruction texts, and both forms of the annotated features."""
    total = nodes.count()
    tables = {"text": vocabulary(nodes, "text", total), "instruction": vocabulary(nodes.where(F.col("type") == 0), "text", total)}
    if "features" in nodes.columns:
        feature = lambda name: F.try_element_at("features", F.lit(name))
        preprocessed = nodes.select(feature("inst2vec_preprocessed")["bytes"][0].cast("string").alias("text")).where("text IS NOT NULL")
        embedded = nodes.select(feature("inst2vec_embedding")["ints"][0].alias("text")).where("text IS NOT NULL")
        tables |= {"inst2vec_preprocessed": vocabulary(preprocessed, "text", total), "inst2vec": vocabulary(embedded, "text", total)}
    return tables


#: What a field may not hold as it is, and what stands for it; the backslash goes first.
ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))
_TSV = {"sep": "\t", "header": True, "quote": "", "escape": "", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_tsv(table: DataFrame, path: str, order: list[Column] | None = None) -> None:
    """Tab-separated with a header in each part; backslashes, tabs and line ends in texts are escaped, nulls empty.

    With ``order`` rows are dealt by ranges of it and sorted in them, and parts are numbered by
    their ranges: read in the order of their names they are in the order of all rows.
    """
    ordered = table if order is None else table.repartitionByRange(*order).sortWithinPartitions(*order)
    texts = {f.name for f in table.schema if f.dataType.typeName() == "string"}

    def escaped(name: str) -> Column:
        value = F.col(name)
        for c, instead in ESCAPES if name in texts else ():
            value = F.replace(value, F.lit(c), F.lit(instead))
        return value.alias(name)

    ordered.select(*map(escaped, table.columns)).write.mode("overwrite").csv(path, **_TSV)


def write_vocabulary(table: DataFrame, path: str) -> None:
    """A table of ``vocabulary``, in its own order."""
    write_tsv(table, path, [F.col("count").desc(), F.col("text").asc_nulls_last()])


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_tsv`` wrote, with texts as they were; an empty text is null."""
    found = spark.read.csv(path, schema=schema, **_TSV)

    def plain(text: Column) -> Column:
        # between escaped backslashes there are none but those of other escapes
        for c, instead in ESCAPES[1:]:
            text = F.replace(text, F.lit(instead), F.lit(c))
        return text

    back = lambda c: F.array_join(F.transform(F.split(c, r"\\\\", -1), plain), "\\")
    return found.select(*[back(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in found.schema])


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """A folder for each split."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)


def graph_sizes(nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None, modules: DataFrame | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Counts for each graph; with ``functions``, ``modules`` and ``splits`` (graph_id, split) also theirs."""
    ns = nodes.groupBy("graph_id").agg(F.count("*").alias("node_count"), F.count(F.when(F.col("type") == 0, 1)).alias("instruction_count"))
    es = edges.groupBy("graph_id").agg(F.count("*").alias("edge_count"), F.max("position").alias("max_position"))
    out = ns.join(es, "graph_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)).cast("long"))
    for name, table in (("function_count", functions), ("module_count", modules)):
        if table is not None:
            out = out.join(table.groupBy("graph_id").agg(F.count("*").alias(name)), "graph_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out if splits is None else out.join(splits.select("graph_id", "split"), "graph_id", "left")


def label_sizes(labels: DataFrame, instances: DataFrame) -> DataFrame:
    """``graph_id, root, label_count, step_count`` of each instance; a missing step count is 0."""
    counts = labels.groupBy("graph_id", "root").agg(F.count("*").alias("label_count"))
    steps = instances.select("graph_id", "root", "step_count")
    return counts.join(steps, ["graph_id", "root"], "left").withColumn("step_count", F.coalesce("step_count", F.lit(0)).cast("long"))


def batches(rows: DataFrame, order: str, size: int = 512) -> DataFrame:
    """Add ``batch``, the number of each row's batch of ``size`` in the order of a column, as LIMIT and OFFSET would cut them."""
    counted = running_sum(rows.withColumn("__one", F.lit(1)), [F.col(order).asc()], "__one", "__rank", Scratch(rows.sparkSession), "batches")
    return counted.withColumn("batch", F.floor((F.col("__rank") - 1) / size).cast("long")).drop("__one", "__rank")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``type, flow, out_edges, in_edges`` over all nodes of each type."""
    kinds = nodes.select("graph_id", "node_id", "type")
    ends = edges.select("graph_id", "flow", F.explode(F.array(F.struct(F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("end")).select("graph_id", "flow", "end.node_id", "end.o", "end.i")
    # one row for each node and flow before the join
    ends = ends.groupBy("graph_id", "node_id", "flow").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return ends.join(kinds, ["graph_id", "node_id"]).groupBy("type", "flow").agg(F.sum("o").cast("long").alias("out_edges"), F.sum("i").cast("long").alias("in_edges"))


def spread(column: str, buckets: int = 100, seed: int = 0) -> Column:
    """A bucket of an integer key that SQL engines compute alike."""
    return F.pmod(F.col(column) % 10007 * 7919 + 104729 * (seed + 1), F.lit(10007)) % buckets


def random_split(rows: DataFrame, key: str, train: int = 60, val: int = 20, seed: int = 0) -> DataFrame:
    """Add ``split`` by a hash of the key, in hundredths."""
    bucket = spread(key, 100, seed)
    return rows.withColumn("split", F.when(bucket < train, "train").when(bucket < train + val, "val").otherwise("test"))


def stratified_split(rows: DataFrame, source: str, label: str, seed: int = 0) -> DataFrame:
    """``source, label, split``: of each label's sources three fifths train, one fifth val, the rest test; a source stays whole."""
    sources = rows.groupBy(source).agg(F.min(label).alias(label)).withColumn("__spread", F.md5(F.concat(F.col(source).cast("string"), F.lit(f":{seed}"))))
    ranked = ranks_within(sources, [label], [F.col("__spread").asc(), F.col(source).asc()], Scratch(rows.sparkSession), "split", "rank", "n")
    third, fifth = F.floor(3 * F.col("n") / 5), F.floor(F.col("n") / 5)
    return ranked.select(source, label, F.when(F.col("rank") <= third, "train").when(F.col("rank") <= third + fifth, "val").otherwise("test").alias("split"))


def summary(values: DataFrame, column: str) -> DataFrame:
    """``n, mean, stdev, p0, p50, p95, p99, p100`` with the population deviation.

    Percentiles are exact, between the two nearest ranks by distance; no task sees all values.
    """
    found = values.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("stdev"))
    n = values.where(F.col(column).isNotNull()).count()
    places = {name: share * (n - 1) for name, share in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p100", 1.0))}
    ends = {r for at in places.values() for r in (math.floor(at), math.ceil(at))} if n else set()
    at_rank = values_at(values, column, sorted(ends), Scratch(values.sparkSession), "values")

    def between(at: float) -> float | None:
        low, high = math.floor(at), math.ceil(at)
        return None if not n else float(at_rank[low]) if low == high else (high - at) * at_rank[low] + (at - low) * at_rank[high]

    return found.select("n", "mean", "stdev", *[F.round(F.lit(between(at)).cast("double"), 6).alias(name) for name, at in places.items()])
