"""Line dedup: a line that several documents hold stays in the first of them.

Texts are cut into lines, and each line long enough gets a key: the line without space at its
ends and with A-Z lower-cased, as a 128-bit hash.  Documents are counted for each key; keys in
``least_docs`` or more lose their lines everywhere but in the smallest id that holds them.  What
is left of a text is put together again by the lines' positions.

Shuffled are keys and positions, and each text once, to meet the list of its dropped lines.
The few keys that hold a fixed share of all lines are broadcast, fewer than ``common.HEAVY`` of
them at any size of the table; the others meet their lines by a join, and none is hot there.

Edge cases: a null or empty text is one empty line; rows with the same id are one document,
which keeps what it is the first to hold in all its rows; rows without an id are one document,
after all others; lines shorter than ``least_chars`` code points are never dropped; if all lines
go, the text is empty; very long texts are one array of lines; ties do not arise; repeated rows
are treated alike; an empty table gives no rows; columns of the input with the names of results,
or any other, are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import heavy_join, lower_ascii, unused
from weftgraph.plans.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
#: A row for the joins: its id and text by hash, so that a hot or missing id is no hot key.
_ROW = ["__r1", "__r2"]


def _with_row(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    own = (F.col(key).isNull(), F.col(key), whole)
    return docs.select(F.col(key).alias("doc_id"), whole.alias("__text"), F.xxhash64(*own).alias("__r1"), F.xxhash64(F.lit(1), *own).alias("__r2"))


def line_keys(docs: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """``__r1, __r2, doc_id, at`` (from 0) and ``key`` of each line long enough to count."""
    rows = _with_row(docs, key, text).select("doc_id", *_ROW, F.posexplode(F.split("__text", "\n", -1)).alias("at", "line"))
    bare = rows.withColumn("line", F.trim("line", F.lit(SPACES))).where(F.length("line") >= least_chars)
    return bare.select(*_ROW, "doc_id", "at", F.unhex(F.md5(lower_ascii(F.col("line")))).alias("key"))


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 10, least_docs: int = 2) -> DataFrame:
    """``__r1, __r2`` and ``gone``, the positions of the lines to drop, of each row that loses any."""
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(line_keys(docs, key, text, least_chars), "lines")
    counts = lines.groupBy("key").agg(F.count_distinct(F.struct("doc_id")).alias("docs"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    common = scratch.keep(counts.where(F.col("docs") >= least_docs).select("key", "n", "first"), "common")
    found = heavy_join(lines, common, ["key"], "n", lines.count())
    later = found.where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return later.groupBy(*_ROW).agg(F.collect_set("at").alias("gone"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, n_lines`` (before) ``, n_dropped, kept_text`` of each row."""
    joined = _with_row(docs, key, text).join(dropped_lines(docs, key, text, **options), _ROW, "left")
    joined = joined.withColumn("lines", F.split("__text", "\n", -1)).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.size("gone") == 0, F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept_text"))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; null texts stay null, and all other columns as they are."""
    r1, r2, gone = (unused(docs, name) for name in (*_ROW, "__gone"))
    own = (F.col(key).isNull(), F.col(key), F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumn(r1, F.xxhash64(*own)).withColumn(r2, F.xxhash64(F.lit(1), *own))
    found = dropped_lines(docs, key, text, **options).toDF(r1, r2, gone)
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return rows.join(found, [r1, r2], "left").select(*[kept.alias(c) if c == text else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM s),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
d AS (SELECT k.*, c.first IS NOT NULL AND c.first <> doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
