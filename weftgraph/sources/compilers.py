"""Source code through a compiler that the user names, and tables of a corpus."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import UnsupportedCompiler
from weftgraph.sources.ir import from_llvm_ir

#: Fixed values.
CLANG_VERSIONS = ["10"]
LANGUAGES = ["c", "c++"]
OPTIMISATIONS = [f"-O{level}{math}" for level in range(4) for math in ("", " -ffast-math")]


def _checked(version: str, language: str) -> None:
    if version not in CLANG_VERSIONS:
        raise UnsupportedCompiler(f"unknown clang version {version}; known are {', '.join(CLANG_VERSIONS)}")
    if language not in LANGUAGES:
        raise UnsupportedCompiler(f"unknown language {language}; known are {', '.join(LANGUAGES)}")


@lru_cache(maxsize=4)
def system_includes(compiler: str = "c++", timeout: int = 30) -> tuple[str, ...]:
    """The folders that a compiler searches for headers."""
    said = subprocess.run([compiler, "-xc++", "-v", "-E", "-"], input="", capture_output=True, text=True, timeout=timeout, check=False).stderr
    found = re.search(r"#include <\.\.\.> search starts here:\n(.*?)\nEnd of search list", said, re.S)
    return tuple(x.strip().removesuffix(" (framework directory)") for x in found[1].split("\n")) if found else ()


def compile_sources(sources: DataFrame, command: list[str], key: str = "ir_id", text: str = "text", timeout: float = 300) -> DataFrame:
    """``ir_id, text, error``: what ``command`` writes for each source on its standard input.

    The command is given by the user and run on the executors; nothing else is.
    """
    command = list(command)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *run_command(command, source or "", timeout)) for k, source in zip(batch["k"], batch["t"], strict=True)]
            yield pd.DataFrame(rows, columns=["ir_id", "text", "error"])

    return sources.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, "ir_id long, text string, error string")


def from_cpp(sources: DataFrame, compiler: str = "clang", copts: tuple[str, ...] = (), language: str = "c++", version: str = CLANG_VERSIONS[0], includes: bool = False, timeout: float = 300, **options: bool) -> DataFrame:
    """Packed graphs of C or C++ sources ``ir_id, text``."""
    _checked(version, language)
    extra = [x for folder in (system_includes() if includes else ()) for x in ("-isystem", folder)]
    compiled = compile_sources(sources, [compiler, f"-x{language}", "-S", "-emit-llvm", "-o", "-", *extra, *copts, "-"], timeout=timeout)
    return _graphs(compiled, options)


def from_clang(commands: DataFrame, key: str = "ir_id", arguments: str = "args", compiler: str = "clang", version: str = CLANG_VERSIONS[0], timeout: float = 300, **options: bool) -> DataFrame:
    """Packed graphs of compiler runs: ``args`` is a run's list of arguments, sources among them.

    The compiler is named by the user and run on the executors; nothing else is.
    """
    _checked(version, "c++")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *run_command([compiler, *a, "-S", "-emit-llvm", "-o", "-"], "", timeout)) for k, a in zip(batch["k"], batch["a"], strict=True)]
            yield pd.DataFrame(rows, columns=["ir_id", "text", "error"])

    compiled = commands.select(F.col(key).cast("long").alias("k"), F.col(arguments).alias("a")).mapInPandas(run, "ir_id long, text string, error string")
    return _graphs(compiled, options)


def run_command(command: list[str], given: str | bytes, timeout: float) -> tuple[str | None, str | None]:
    """(output, why there is none) of a process."""
    try:
        done = subprocess.run(command, input=given if isinstance(given, bytes) else given.encode(), capture_output=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return None, f"no result after {timeout} seconds"
    except OSError as e:
        return None, str(e)
    if done.returncode:
        return None, done.stderr.decode("utf-8", "replace") or f"exit {done.returncode}"
    return done.stdout.decode("utf-8", "replace"), None


def run_messages(rows: DataFrame, command: list[str], key: str = "graph_id", data: str = "data", timeout: float = 360) -> DataFrame:
    """``key, data, error``: what a process writes for each row's bytes; without output in place of them when ``error`` says why."""
    command = list(command)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, given in zip(batch["k"], batch["d"], strict=True):
                try:
                    done = subprocess.run(command, input=bytes(given or b""), capture_output=True, timeout=timeout, check=False)
                    out.append((k, done.stdout, None) if done.returncode == 0 else (k, None, done.stderr.decode("utf-8", "replace") or f"exit {done.returncode}"))
                except subprocess.TimeoutExpired:
                    out.append((k, None, f"no result after {timeout} seconds"))
                except OSError as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, data, "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(data).cast("binary").alias("d")).mapInPandas(run, f"`{key}` {kind}, `{data}` binary, error string")


def _graphs(compiled: DataFrame, options: dict) -> DataFrame:
    """Graphs of what was compiled, and errors of what was not."""
    failed = compiled.where("error IS NOT NULL")
    graphs = from_llvm_ir(compiled.where("error IS NULL"), **options)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in graphs.schema.fields[1:-1]]
    return graphs.unionByName(failed.select(F.col("ir_id").alias("graph_id"), *none, "error"))


def configurations(sources: DataFrame) -> DataFrame:
    """Each source with each of the eight optimisation settings."""
    return sources.withColumn("copts", F.explode(F.array(*map(F.lit, OPTIMISATIONS))))


def database_scan(spark, url: str, table: str = "intermediate_representation", **options: str) -> DataFrame:
    """``source, source_language, type, binary_ir`` of compiled rows; the predicates go to the database."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return rows.where((F.col("compilation_succeeded") == 1) & ~F.col("source").like("poj-104:%")).select("source", "source_language", "type", "binary_ir")


def checked_content(files: DataFrame, sha256: str) -> DataFrame:
    """Rows of ``content`` whose hash is as expected; others raise when read."""
    return files.where(F.assert_true(F.sha2("content", 256) == sha256, F.lit("sha256 differs")).isNull())


def csv_scan(spark, path: str, sha256: str | None = None, **options) -> DataFrame:
    """A table of a CSV file with a header; with ``sha256`` the file's content must have that hash."""
    if sha256 is not None:
        content = spark.read.format("binaryFile").load(path)
        if content.where(F.sha2("content", 256) != sha256).count():
            raise ValueError(f"the sha256 of {path} is not {sha256}")
    return spark.read.csv(path, header=True, inferSchema=True, **options)


def database_batches(spark, url: str, column: str, low: int, high: int, parts: int, table: str = "intermediate_representation", **options: str) -> DataFrame:
    """The same scan in ``parts`` ranges of an integer column, each read by a task of its own, in place of LIMIT and OFFSET."""
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return database_scan(spark, url, table, **bounds, **options)


def preprocess_source(text: Column, header: str = "") -> Column:
    """Contest sources made compilable: ``main`` returns int, a header goes before."""
    text = F.regexp_replace(text, r"\bvoid\s+main\b", "int main ")
    text = F.regexp_replace(text, r"(^|\n)\s*main\s*\(", "$1int main(")
    return F.concat(F.lit(header), text)
