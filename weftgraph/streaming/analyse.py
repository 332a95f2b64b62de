"""Analyses of graphs that arrive as a stream.

Graphs do not depend on each other, so each micro-batch is a batch of its own and no
state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators import analysis
from weftgraph.sources.ir import from_llvm_ir, unpack


def analyse_stream(irs: DataFrame, name: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the labels of a stream of ``ir_id, text`` to ``path``; a batch that is done again replaces itself."""
    if name not in analysis.ANALYSES:
        raise ValueError(f"unknown analysis: {name}")

    def one(batch: DataFrame, number: int) -> None:
        packed = from_llvm_ir(batch)
        labels, _ = analysis.run(name, unpack(packed, "nodes"), unpack(packed, "edges"))
        labels.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return irs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
