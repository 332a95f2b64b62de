"""Scalar functions over texts, numbers and durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate(text: Column, most: int = 32) -> Column:
    """At most ``most`` characters, with dots where something is cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


def strip_non_utf8(data: Column) -> Column:
    return F.regexp_replace(F.make_valid_utf8(data), "�", "")


#: The suffixes of file names that stems are told without; compression comes after them.
SUFFIXES = ("ProgramGraph.pb", "ProgramGraph.pbtxt", "ProgramGraph.json", "ProgramGraphList.pb", "ProgramGraphList.pbtxt", "ProgramGraphList.json", "Ir.pb", "IrList.pb", "ll", "bc")


def stem(path: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """File name without one of the whole ``suffixes`` (and ``.gz``); other dots, and the name itself, stay."""
    known = "|".join(s.replace(".", r"\.") for s in suffixes)
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), rf"(?<=.)\.(?:{known})(?:\.gz)?$", "")


def commas(number: Column) -> Column:
    return F.format_number(number, 0)


def plural(count: Column, singular: str, several: str | None = None) -> Column:
    return F.concat(commas(count), F.lit(" "), F.when(count == 1, singular).otherwise(several or f"{singular}s"))


def word_series(words: Column, conjunction: str = "and") -> Column:
    """``a, b and c``."""
    n = F.size(words)
    head = F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, words[0]).otherwise(F.concat(head, F.lit(f" {conjunction} "), F.element_at(words, -1)))


def with_article(noun: Column) -> Column:
    return F.concat(F.when(F.lower(F.left(noun, F.lit(1))).isin(*"aeiou"), "an ").otherwise("a "), noun)


def _scaled(quantity: Column, unit: str, base: int, prefixes: list[str], digits: int) -> Column:
    out = F.concat(F.format_number(quantity.cast("double"), digits), F.lit(f" {unit}"))
    for power, prefix in enumerate(prefixes, 1):
        out = F.when(F.abs(quantity) >= float(base**power), F.concat(F.format_number(quantity / float(base**power), digits), F.lit(f" {prefix}{unit}"))).otherwise(out)
    return out


def decimal_prefix(quantity: Column, unit: str = "", digits: int = 1) -> Column:
    return _scaled(quantity, unit, 1000, ["k", "M", "G", "T", "P"], digits)


def binary_prefix(quantity: Column, unit: str = "B", digits: int = 1) -> Column:
    return _scaled(quantity, unit, 1024, ["Ki", "Mi", "Gi", "Ti", "Pi"], digits)


def pretty_fraction(numerator: Column, denominator: Column) -> Column:
    return F.concat(commas(numerator), F.lit(" of "), commas(denominator), F.lit(" ("), F.format_number(100 * numerator / denominator, 1), F.lit("%)"))


def duration(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` without leading zeros."""
    whole = F.floor(seconds)
    parts = [(F.floor(whole / 86400), "d"), (F.floor(whole / 3600) % 24, "h"), (F.floor(whole / 60) % 60, "m")]
    shown = F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts]))
    return F.array_join(F.concat(shown, F.array(F.concat((whole % 60).cast("string"), F.lit("s")))), " ")


def ordinal(number: Column) -> Column:
    last, teens = number % 10, (number % 100).between(11, 13)
    return F.concat(number.cast("string"), F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def natural_key(text: Column) -> Column:
    """A sort key in which numbers count as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(F.lower(x))), "")


def unix_millis(year: Column, month: Column, day: Column) -> Column:
    return F.unix_millis(F.make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)))


def sha1(data: Column) -> Column:
    return F.sha1(data.cast("binary"))


def plural_word(count: Column, singular: str, several: str | None = None) -> Column:
    """The noun alone, in the number that the count asks for."""
    irregular = singular[:-1] + "ies" if singular.endswith("y") and singular[-2:-1] not in tuple("aeiou") else singular + ("es" if singular.endswith(("s", "x", "z", "ch", "sh")) else "s")
    return F.when(count == 1, singular).otherwise(several or irregular)


#: Prefixes of powers of 1000 and 1024.
DECIMAL = ["k", "M", "G", "T", "P", "E", "Z", "Y"]
BINARY = ["Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi", "Yi"]


def _scale(quantity: Column, unit: str, base: int, prefixes: list[str]) -> Column:
    """``struct(value, unit)`` with the least prefix whose value is below the base."""
    value = quantity.cast("double")
    out = F.struct((value / float(base ** len(prefixes))).alias("value"), F.lit(prefixes[-1] + unit).alias("unit"))
    for power in range(len(prefixes) - 1, -1, -1):
        name = (prefixes[power - 1] if power else "") + unit
        out = F.when(F.abs(value) < float(base ** (power + 1)), F.struct((value / float(base**power)).alias("value"), F.lit(name).alias("unit"))).otherwise(out)
    plain = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(plain, F.struct(value.alias("value"), F.lit(unit).alias("unit"))).otherwise(out)


def decimal_scale(quantity: Column, unit: str = "") -> Column:
    return _scale(quantity, unit, 1000, DECIMAL)


def binary_scale(quantity: Column, unit: str = "B") -> Column:
    return _scale(quantity, unit, 1024, BINARY)


def time_delta(micros: Column, separator: str = " ") -> Column:
    """``5d 12h 30m 45.5s`` of microseconds; parts that are zero are left out, but for ``0s``."""
    whole = F.floor(micros / 1_000_000)
    parts = [(F.floor(whole / 86400), "d"), (F.floor(whole / 3600) % 24, "h"), (F.floor(whole / 60) % 60, "m")]
    rest = (whole % 60) + (micros % 1_000_000) / 1e6
    shown = F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts]))
    seconds = F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", rest), "0+$", ""), r"\.$", ""), F.lit("s"))
    return F.array_join(F.when((rest > 0) | (F.size(shown) == 0), F.concat(shown, F.array(seconds))).otherwise(shown), separator)


def unix_timestamp_text(seconds: Column, zone: str = "UTC") -> Column:
    """``2013-11-17 11:08:27.720000 UTC`` of seconds since the epoch."""
    there = F.timestamp_micros((seconds * 1_000_000).cast("long")).cast("timestamp_ntz")  # in the session's zone
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), there)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(f" {zone}"))
