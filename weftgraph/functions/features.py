"""Features: maps from names to one of bytes, floats or integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.schema import FEATURE


def _feature(bytes_: Column | None = None, floats: Column | None = None, ints: Column | None = None) -> Column:
    parts = (("bytes", bytes_, "array<binary>"), ("floats", floats, "array<float>"), ("ints", ints, "array<bigint>"))
    return F.struct(*[(F.lit(None) if x is None else x).cast(kind).alias(name) for name, x, kind in parts])


def integer(value: Column) -> Column:
    return _feature(ints=F.array(value))


def integers(values: Column) -> Column:
    return _feature(ints=values)


def floats(values: Column) -> Column:
    return _feature(floats=values)


def text(value: Column) -> Column:
    return _feature(bytes_=F.array(value.cast("binary")))


def add(features: Column, name: str, feature: Column) -> Column:
    """Add a feature unless there is one of that name."""
    base = F.coalesce(features, F.create_map().cast(f"map<string,{FEATURE}>"))
    return F.when(F.map_contains_key(base, name), base).otherwise(F.map_concat(base, F.create_map(F.lit(name), feature)))


def put(features: Column, name: str, feature: Column) -> Column:
    """Add a feature, in place of one of that name."""
    base = F.coalesce(features, F.create_map().cast(f"map<string,{FEATURE}>"))
    return F.map_concat(F.map_filter(base, lambda k, _: k != name), F.create_map(F.lit(name), feature))


def as_text(feature: Column, most: int = 32) -> Column:
    """A feature's values, ``most`` at most, floats with four digits."""
    def joined(values: Column, show) -> Column:
        shown = F.array_join(F.transform(F.slice(values, 1, most), show), ", ")
        return F.when(F.size(values) > most, F.concat(shown, F.lit(", ..."))).otherwise(shown)

    return F.coalesce(
        F.when(feature["bytes"].isNotNull(), joined(feature["bytes"], lambda x: x.cast("string"))),
        F.when(feature["floats"].isNotNull(), joined(feature["floats"], lambda x: F.format_string("%.4f", x))),
        F.when(feature["ints"].isNotNull(), joined(feature["ints"], lambda x: x.cast("string"))),
        F.lit(""),
    )
