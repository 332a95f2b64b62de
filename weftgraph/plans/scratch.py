"""Scratch tables in the folder that driver and executors share.

Cutting lineage with a written Parquet table survives the loss of any executor,
which a local checkpoint does not.  The folder is the one the cluster names in
``spark.checkpoint.dir``; only a session whose master is ``local`` may fall back
to a folder of this machine.

What an operator returns still reads its tables, so they can't go when it returns.
``scope`` deletes all tables made inside it, for callers that have written the result;
the rest is deleted when the driver's JVM ends.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_OPEN: list[list[Scratch]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; ``RuntimeError`` when a cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        folder = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _LOCAL[context.applicationId]


class Scratch:
    """The scratch tables of one operator call."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/weftgraph-{uuid.uuid4().hex}"
        self.made = False
        for tables in _OPEN[-1:]:
            tables.append(self)

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and read it back: its lineage is now a table."""
        if not self.made:  # only a folder that is there can be marked
            files, path = self._files(self.base)
            files.mkdirs(path)
            files.deleteOnExit(path)
            self.made = True
        path = f"{self.base}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        """Delete a table that no later plan reads."""
        files, path = self._files(f"{self.base}/{label}")
        files.delete(path, True)

    def close(self) -> None:
        """Delete all tables."""
        if self.made:
            files, path = self._files(self.base)
            files.delete(path, True)

    def release(self) -> None:
        """Let Spark delete shuffle files that no plan needs any more: it does so as the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


@contextmanager
def scope() -> Iterator[None]:
    """Delete the scratch tables made inside, at the end: by then results must be written elsewhere."""
    _OPEN.append([])
    try:
        yield
    finally:
        for tables in _OPEN.pop():
            tables.close()
