"""Quality rules: base counts of each text, and cross-document line frequency.

Lines are normalised (lower case, words joined by one space, digit runs as 0) and
hashed together with their host.  For each such key the documents are counted; a line is
boilerplate if it is in more than ``most_docs`` documents of its host, or in more than
``least_docs`` and ``share`` of them: in a small host the floor decides, in a middling one
the share, and in a host of any size a line in more than ``most_docs`` documents goes.
Boilerplate lines are taken out, and a document that loses more than half of its words with
them is depleted and rejected.

Everything runs in built-in functions.  What is shuffled for the counts is one number for
each line, summed up before; texts are shuffled only where cleaned texts are asked for.

Edge cases: a null or empty text has no words and fails the base rules; a null host is
a host of its own; rows with the same id are documents of their own; equal lines of one text
count as one document; very long texts are read whole, their lines as one array; ties do
not arise, as limits are strict; an empty table gives no rows; columns of the input with the
names of results, or any other, are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD
from weftgraph.plans.scratch import Scratch

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Lines to broadcast at most: 16 bytes each, so 16 MB.
BROADCAST_LINES = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = 3) -> Column:
    """Words in windows that the text holds twice or more.

    Windows are hashed; only where some hash repeats are they sorted with their places,
    so that equal ones are neighbours.
    """
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(window))))

    def neighbours(rows: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)["h"]
            after = F.get(rows, i + 1)["h"]
            return ((i > 0) & (before == x["h"])) | F.coalesce(after == x["h"], F.lit(False))

        places = F.array_sort(F.transform(F.filter(rows, twice), lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(i, a["end"])).alias("n"))
        return F.aggregate(places, zero, step, lambda a: a["n"])

    def counted(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(F.array_sort(pairs), neighbours)).otherwise(0)

    return F.when(F.size(words) > window, let(hashes, counted)).otherwise(0).cast("long")


def base_counts(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """``doc_id, host, h`` (the text's hash) ``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``lines``, each line's key, words and number."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"), whole.alias("text"))
    split = split.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    split = split.withColumn("whole", F.split("text", "\n", -1)).withColumn("filled", F.filter("whole", lambda x: x.rlike(WORD)))

    def line(x: Column, i: Column) -> Column:
        def keyed(w: Column) -> Column:
            normal = F.regexp_replace(F.array_join(w, " "), "[0-9]+", "0")
            return F.struct(F.xxhash64(F.col("host"), normal).alias("key"), F.size(w).alias("n"), i.alias("at"))

        return let(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)), keyed)

    return split.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("h"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.filter(F.transform("whole", line), lambda x: x["n"] > 0).alias("lines"),
    )


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least_words: int = 50, least_docs: int = 10, share: float = 0.005, most_docs: int = 1000) -> DataFrame:
    """``doc_id, host, h``, the base counts, ``removed_lines`` (numbers from 0), ``removed_words``, ``base_failed`` and ``kept`` for each row."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counted = scratch.keep(base_counts(docs, key, text, host).withColumn("__row", F.monotonically_increasing_id()), "counts")
    distinct = counted.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key"))
    common = distinct.groupBy("key").agg(F.count("*").alias("docs"), F.first("host").alias("host")).where(F.col("docs") > least_docs)
    hosts = counted.groupBy("host").agg(F.count("*").alias("host_docs")).withColumnRenamed("host", "__host")
    common = common.join(hosts, F.col("host").eqNullSafe(F.col("__host"))).where((F.col("docs") > most_docs) | (F.col("docs") > share * F.col("host_docs")))
    common = scratch.keep(common.select("key"), "common")
    lines = counted.select("__row", F.explode("lines").alias("line")).select("__row", "line.*")
    if common.count() <= BROADCAST_LINES:
        common = F.broadcast(common)
    removed = lines.join(common, "key").groupBy("__row").agg(F.sum("n").alias("removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    joined = counted.drop("lines").join(removed, "__row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    joined = joined.withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>"))).withColumn("base_failed", failed)
    return joined.withColumn("kept", ~F.col("base_failed") & (2 * F.col("removed_words") <= F.col("n_words"))).drop("__row")


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, without their boilerplate lines; all other columns as they were.

    Rows are found again by id, host and the text's hash: where these are equal, so is the verdict.
    """
    found = quality(docs, key, text, host, **options).where("kept")
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("h").alias("__h")).agg(F.first("removed_lines").alias("__gone"))
    same = F.col(key).eqNullSafe(F.col("__id")) & F.col(host).eqNullSafe(F.col("__host")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__h"))
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    rest = F.when(F.size("__gone") > 0, left).otherwise(F.col(text))
    return docs.join(found, same).select(*[rest.alias(c) if c == text else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tri AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY doc_id),
l AS (
  SELECT doc_id, source, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
nl AS (SELECT doc_id, source, regexp_replace(array_to_string(lw, ' '), '[0-9]+', '0', 'g') AS line, len(lw) AS n FROM l),
freq AS (
  SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS docs FROM nl GROUP BY source, line) f
  JOIN (SELECT source AS s, count(*) AS host_docs FROM w GROUP BY source) h ON f.source IS NOT DISTINCT FROM h.s
  WHERE docs > 1000 OR (docs > 10 AND docs > 0.005 * host_docs)),
gone AS (SELECT nl.doc_id, sum(n) AS n FROM nl JOIN freq ON nl.source IS NOT DISTINCT FROM freq.source AND nl.line = freq.line GROUP BY nl.doc_id),
c AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept
FROM c
"""
