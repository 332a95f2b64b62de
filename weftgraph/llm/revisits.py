"""WARC: not-modified revisits resolved to the response they stand for.

A revisit record says that a page had not changed.  It is resolved to the latest
earlier full response of the same canonical URL; its validators (entity tag, else
modification date, else payload digest) are compared with that response's; and the
headers that a 304 answer may update are merged into the response's.

Where records have a ``profile`` (the ``WARC-Profile`` of a revisit), one of an identical payload
is no 304 answer: its own headers are whole and stay as they are, and its digest alone is compared.

The as-of join works on the different times of each URL, of which equal ones are one row
with the response that counts, summed up before they are shuffled.  They are sorted by URL and
time over range partitions: inside a partition a window finds the last response before each
time, and the last response of the partitions before, one row each, is carried into the URL
that goes on.  So a URL captured very often is spread over tasks, however short the time.

Edge cases: a revisit without an earlier response has a null target; a response at the
same time is not earlier; of responses at one time the larger record id counts; records
without URL or time resolve to nothing; without validators the state is ``unchecked``; rows
of one kind with one record id are one record, the one with the least URL, time, digest,
headers and profile; rows without a record id or of another kind are left out; an empty table gives no
rows; very long URLs and headers are kept whole; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import BinaryIO

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.scratch import Scratch

#: Headers that a 304 answer may carry anew (RFC 9110, 15.4.5), in lower case.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "set-cookie"]
#: Query parameters that only track a visit.
TRACKING = "utm_[^=&]*|gclid|fbclid|ref"
#: Fixed value: how the profile of a revisit with an identical payload ends (WARC 1.0 and 1.1).
SAME_PAYLOAD = "/revisit/identical-payload-digest/?$"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and port, path without a last slash, sorted query without tracking parameters."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def as_of(events: DataFrame, scratch: Scratch) -> DataFrame:
    """``url, at, target_id``: for each different time of ``url, at, record_id, full`` the latest earlier full record."""
    times = events.where("url is not null and at is not null").groupBy("url", "at").agg(F.max(F.when(F.col("full"), F.col("record_id"))).alias("id"))
    # ranges are written, so that rows and what is carried over see the same ones
    ranged = scratch.keep(times.repartitionByRange("url", "at").withColumn("__part", F.spark_partition_id()), "ranged")
    response = F.when(F.col("id").isNotNull(), F.struct("url", "at", "id"))
    ends = ranged.groupBy("__part").agg(F.max(response).alias("last"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__part", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("__part", "url").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range partition, so its size is bounded by their number
    near = ranged.withColumn("near", F.max(response).over(inside)).join(F.broadcast(carried), "__part")
    return near.select("url", "at", F.coalesce(F.col("near.id"), F.when(F.col("carried.url") == F.col("url"), F.col("carried.id"))).alias("target_id"))


def _spread(key: Column, by: Column) -> Column:
    """0, or for a null key one of many values, so that rows without a partner are not one group."""
    return F.when(key.isNull(), F.pmod(F.xxhash64(by), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long"))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit of ``record_id, url, at`` (seconds) ``, kind, headers`` (names in lower case) ``, digest``
    and, if there is such a column, ``profile``.

    Returns ``record_id, url`` (canonical) ``, target_id, state, headers``.
    """
    scratch = Scratch(records.sparkSession)
    known = records.where(F.col("kind").isin("response", "revisit") & F.col("record_id").isNotNull())
    profile = F.col("profile").cast("string") if "profile" in records.columns else F.lit(None).cast("string")
    known = known.select("record_id", "kind", profile.alias("profile"), canonical_url(F.col("url")).alias("url"), F.col("at").cast("long").alias("at"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    least = F.min_by(F.struct("url", "at", "headers", "digest", "profile"), F.struct("url", "at", "digest", F.to_json("headers"), "profile"))
    known = scratch.keep(known.groupBy("record_id", "kind").agg(least.alias("r")).select("record_id", "kind", "r.*"), "records")
    targets = as_of(known.select("url", "at", "record_id", (F.col("kind") == "response").alias("full")), scratch).withColumn("salt", F.lit(0).cast("long"))
    whole = F.coalesce(F.col("profile").rlike(SAME_PAYLOAD), F.lit(False))
    revisits = known.where("kind = 'revisit'").select("record_id", "url", "at", whole.alias("whole"), F.col("headers").alias("new"), F.col("digest").alias("new_digest"))
    revisits = revisits.withColumn("salt", _spread(F.when(F.col("at").isNotNull(), F.col("url")), F.col("record_id")))
    placed = revisits.join(targets, ["url", "at", "salt"], "left").withColumn("salt", _spread(F.col("target_id"), F.col("record_id")))
    full = known.where("kind = 'response'").select(F.col("record_id").alias("target_id"), F.col("headers").alias("old"), "digest", F.lit(0).cast("long").alias("salt"))
    joined = placed.join(full, ["target_id", "salt"], "left")
    old, new = F.col("old"), F.col("new")
    alike = F.coalesce(F.col("new_digest") == F.col("digest"), F.lit(False))
    same = (
        F.when(F.col("whole"), F.when(F.col("new_digest").isNotNull(), alike))
        .when(_tag(new).isNotNull(), F.coalesce(_tag(new) == _tag(old), F.lit(False)))
        .when(new["last-modified"].isNotNull(), F.coalesce(new["last-modified"] == old["last-modified"], F.lit(False)))
        .when(F.col("new_digest").isNotNull(), alike)
    )
    state = F.when(F.col("target_id").isNull(), "no_response").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    allowed = F.map_filter(new, lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)
    return joined.select("record_id", "url", "target_id", state.alias("state"), F.when(state.isin("resolved", "unchecked") & ~F.col("whole"), merged).otherwise(new).alias("headers"))


RECORD = "record_id string, url string, at long, kind string, headers map<string,string>, digest string, profile string"
#: Bytes read at a time of what no one asks for.
STEP = 1 << 20


def fields(lines: list[bytes]) -> dict[str, str]:
    """Header fields, names in lower case; values of a repeated one are joined by a comma, cookies by a line end."""
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        if colon:
            found[name] = found[name] + ("\n" if name == "set-cookie" else ", ") + value if name in found else value
    return found


class Members(io.RawIOBase):
    """What the members of a gzipped stream hold, one after the other; one cut short gives what it has."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.member, self.rest = stream, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while True:
            if self.member is None or self.member.eof:
                self.rest = (self.member.unused_data if self.member else b"").lstrip(b"\0") or self.stream.read(STEP)
                if not self.rest:
                    return 0
                self.member = zlib.decompressobj(31)  # with a gzip header
            self.rest = self.rest or self.stream.read(STEP)
            ended = not self.rest
            out = self.member.decompress(self.rest, len(into))
            self.rest = self.member.unconsumed_tail
            if out or ended:
                into[: len(out)] = out
                return len(out)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[str | None, str | None, int | None, str, dict[str, str], str | None, str | None]]:
    """``record_id, url, at, kind, headers, digest, profile`` of each record of a WARC file, gzipped or not.

    Headers are those of the HTTP answer.  The file is read once from start to end, member by
    member, and no more of a record is held than its headers.  A file cut short ends there.
    """
    stream = io.BufferedReader(stream, STEP) if not hasattr(stream, "peek") else stream
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(Members(stream), STEP)
    left = 0  # bytes of the block that were not read

    def head() -> list[bytes] | None:
        lines = []
        while (here := stream.readline()).endswith(b"\n"):
            if not here.strip():
                return lines
            lines.append(here)
        return None

    while True:
        while left > 0 and (passed := len(stream.read(min(left, STEP)))):
            left -= passed
        here = stream.readline(STEP)
        if not here:
            return
        if not here.startswith(b"WARC/"):
            continue
        lines = head()
        if lines is None:
            return
        warc = fields(lines)
        size = warc.get("content-length", "")
        left = int(size) if size.isdigit() else 0
        lines = []
        while left > 0 and (here := stream.readline(min(left, STEP))):
            left -= len(here)
            if lines and not lines[-1].endswith(b"\n"):
                lines[-1] += here
            elif here.strip() and (lines or here.startswith(b"HTTP/")):
                lines.append(here)
            else:
                break
        try:
            when = int(datetime.fromisoformat(warc.get("warc-date", "").replace("Z", "+00:00")).timestamp())
        except ValueError:
            when = None
        yield warc.get("warc-record-id"), warc.get("warc-target-uri"), when, warc.get("warc-type", ""), fields(lines[1:]), warc.get("warc-payload-digest"), warc.get("warc-profile")


def open_file(path: str) -> BinaryIO:
    """A stream over a file of this machine or of a store that pyarrow knows (``hdfs``, ``s3``, ``gs``)."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return open(rest if colon else path, "rb")
    store, inside = pyarrow.fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1) if scheme == "s3a" else path)
    return store.open_input_stream(inside)


def read_warc(spark: SparkSession, path: str, pattern: str = "*.warc*", opened: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """The records of all WARC files under a folder, as ``resolve`` takes them.

    Spark lists the files and deals them to tasks by size; a task reads each as a stream, so
    memory does not grow with a file.  ``opened`` opens a path of any other store.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
    columns = [part.split()[0] for part in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                with opened(file) as stream:
                    records = parse_warc(stream)
                    while rows := [r for _, r in zip(range(1000), records, strict=False)]:
                        yield pd.DataFrame(rows, columns=columns).astype({"at": "Int64"})

    return files.mapInPandas(read, RECORD)


def captures(pages: DataFrame) -> DataFrame:
    """WARC records made from all of ``page_id, url, html``: a response of each page, and a revisit days later.

    Each fifth revisit has another entity tag than its page, each seventh of the others
    only a payload digest, each eleventh no validator.
    """
    at = F.col("page_id") * 60
    digest = F.md5("html")
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"),
        "url",
        at.alias("at"),
        F.lit("response").alias("kind"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"), F.lit("date"), at.cast("string")).alias("headers"),
        digest.alias("digest"),
    )
    later = at + 86_400 * (1 + F.col("page_id") % 7)
    kind = F.when(F.col("page_id") % 5 == 0, 1).when(F.col("page_id") % 7 == 0, 2).when(F.col("page_id") % 11 == 0, 3).otherwise(0)
    sent = F.when(kind == 1, F.lit('"changed"')).when(kind == 0, F.concat(F.lit("W/"), tag))
    base = F.create_map(F.lit("date"), later.cast("string"), F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"),
        F.concat("url", F.lit("#again")).alias("url"),
        later.alias("at"),
        F.lit("revisit").alias("kind"),
        F.when(sent.isNull(), base).otherwise(F.map_concat(base, F.create_map(F.lit("etag"), sent))).alias("headers"),
        F.when(kind == 2, digest).alias("digest"),
    )
    return response.unionByName(revisit)


ORACLE = r"""
WITH p AS (
  SELECT page_id, md5(html) AS digest, length(html) AS n, page_id % 7 AS w,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
         CASE WHEN page_id % 5 = 0 THEN 1 WHEN page_id % 7 = 0 THEN 2 WHEN page_id % 11 = 0 THEN 3 ELSE 0 END AS kind
  FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www[0-9]*\.', ''), ':(80|443)$', '')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
         list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|gclid|fbclid|ref)(=|$)'))) AS params
  FROM p),
u AS (SELECT page_id, digest, n, w, kind, base || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM q),
found AS (
  SELECT r.page_id, max(struct_pack(at := f.page_id, id := f.page_id)) AS hit
  FROM u r LEFT JOIN u f ON f.url = r.url AND f.page_id * 60 < r.page_id * 60 + 86400 * (1 + r.w) GROUP BY r.page_id),
j AS (
  SELECT r.page_id * 2 + 1 AS record_id, r.url, f.page_id * 2 AS target_id, r.kind, r.digest AS new_digest, f.digest, f.n,
         r.page_id * 60 + 86400 * (1 + r.w) AS later
  FROM u r JOIN found USING (page_id) LEFT JOIN u f ON f.page_id = found.hit.id),
s AS (
  SELECT *, CASE WHEN target_id IS NULL THEN 'no_response' WHEN kind = 3 THEN 'unchecked' WHEN kind = 1 THEN 'mismatch'
                 WHEN kind = 0 AND substr(new_digest, 1, 16) = substr(digest, 1, 16) THEN 'resolved'
                 WHEN kind = 2 AND new_digest = digest THEN 'resolved' ELSE 'mismatch' END AS state FROM j)
SELECT record_id, url, target_id, state,
       CASE WHEN kind = 1 THEN '"changed"' WHEN kind = 0 THEN 'W/"' || substr(new_digest, 1, 16) || '"'
            WHEN state IN ('resolved', 'unchecked') THEN '"' || substr(digest, 1, 16) || '"' END AS etag,
       later::VARCHAR AS date,
       CASE WHEN state IN ('resolved', 'unchecked') THEN n::VARCHAR ELSE '0' END AS content_length,
       CASE WHEN state IN ('resolved', 'unchecked') THEN 'text/html' END AS content_type
FROM s
"""
