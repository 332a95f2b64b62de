"""Queries by name over tables of graphs and labels, and SQL over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources import wire

#: Query text: (table it reads, what it does).
QUERIES: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "node.text": ("nodes", lambda df: df.select("text")),
    "ir.text": ("irs", lambda df: df.select("text")),
    "SELECT COUNT(graph)": ("instances", lambda df: df.agg(F.count("*").alias("count"))),
    "SELECT COUNT(data_flow_value)": ("labels", lambda df: df.agg(F.count("value").alias("count"))),
    **{name: (name, lambda df: df.select(F.to_json(F.struct("*")).alias("json"))) for name in ("nodes", "edges", "functions", "modules", "instances", "labels", "irs", "sources")},
}


def run(query: str, **tables: DataFrame) -> DataFrame:
    if query not in QUERIES:
        raise ValueError(f"unknown query: {query}; known are {', '.join(QUERIES)}")
    table, ask = QUERIES[query]
    return ask(tables[table])


def sql(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Any statement over the tables by their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)


def messages(blobs: DataFrame, message: str, key: str = "path", data: str = "content", encoding: str = "pb") -> DataFrame:
    """``key, json, error``: messages of any kind of the exchange format as JSON, lists, features and HLO among them."""
    if message not in wire.MESSAGES:
        raise ValueError(f"unknown message: {message}; known are {', '.join(wire.MESSAGES)}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, content in zip(batch["k"], batch["d"], strict=True):
                try:
                    rows.append((k, wire.dumps(message, wire.loads(message, bytes(content or b""), encoding), "json").decode(), None))
                except (ValueError, TypeError, OSError, EOFError) as e:
                    rows.append((k, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "json", "error"])

    kind = blobs.schema[key].dataType.simpleString()
    return blobs.select(F.col(key).alias("k"), F.col(data).cast("binary").alias("d")).mapInPandas(read, f"`{key}` {kind}, json string, error string")


def label_counts(labels: DataFrame) -> DataFrame:
    """``analysis, graph_id, count`` with totals (null) for each analysis and all."""
    return labels.rollup("analysis", "graph_id").agg(F.count("*").alias("count"))
