"""What the corpus operators share: words, table reading and batch sizes."""

from __future__ import annotations

import gc
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of the corpus operators state it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with marks before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words: ``bytes.split`` parts at just the six characters that ``WORD`` excludes."""
    return text.encode("utf-8", "replace").split() if text else []


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``; Spark bounds its batches by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``) and kernels cut them with ``slices``."""
    return df.mapInArrow(kernel, schema)


#: Keys to broadcast at most: those with more than this part of all rows.
HEAVY = 100_000


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, most: int = HEAVY) -> DataFrame:
    """An inner join of ``left``, a written table, with ``right``, whose keys are unique, without a hot key in the shuffle.

    ``weight`` says how many rows a key stands for, of ``total`` in all.  Fewer than ``most`` keys
    have more than that part of the total, whatever its size: these are broadcast.
    """
    heavy = F.col(weight) > total // most
    few = F.broadcast(right.where(heavy))
    return left.join(few, on).unionByName(left.join(few.select(*on), on, "left_anti").join(right.where(~heavy), on))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and no other letters; a text of one byte for each letter has no others."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def hashed_part(key: str, folds: int, fold: int) -> Column:
    """Whether the key's crc32, as text, falls into one part of several; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column``, or one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for at, size in enumerate(sizes):
            if at > start and total + size > most:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def rare_gc() -> None:
    """Large caches without cycles: look through them for cycles less often."""
    gc.set_threshold(200_000, 50, 100)


_HELD: list[Callable[[], None]] = []


def held_by_worker(clear: Callable[[], None]) -> None:
    """Register what empties a cache that outlives its task in a Python worker."""
    _HELD.append(clear)


def release_held() -> None:
    """Empty the caches that earlier stages left in this worker, for a kernel that uses none of them."""
    for clear in _HELD:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


class Recent(dict):
    """A bounded cache in two generations: what is still asked for outlives a full one."""

    def __init__(self, make: Callable, most: int, longest: int = 64):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
