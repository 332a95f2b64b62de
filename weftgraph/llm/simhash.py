"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints have 64 bits over hashed word shingles; texts whose fingerprints differ in
at most ``most_bits`` (3) bits are linked, and what links reach is one component.

1. Equal fingerprints are one class, named by the fingerprint: copies never meet each
   other again, and ids may be of any type.
2. Two fingerprints within 3 bits agree on at least one of four 16-bit blocks.  Each
   class goes to four groups, one for each block and its value.  A group larger than
   ``most_group`` is split by 12-bit blocks of the other 48 bits, of which four again
   make sure that each pair meets; still larger ones go on with 9-bit blocks of the
   remaining 36, and so on until 12 bits are left, which no more than 4,096 fingerprints
   can differ in.
3. A task indexes its groups: fingerprints in Gray order, runs of neighbours under one
   node that holds the bits on which they all agree and that no node above holds yet.
   A search adds up differences from the root down and leaves a node, with all
   below, when they exceed 3.
4. A task joins what it finds and hands on one link from each class to its smallest
   partner, not all pairs; components then follow from alternating star contraction,
   with links in tables of the shared folder.

Edge cases: a null, empty or wordless text has fingerprint zero, linked like any other;
texts shorter than a shingle are one shingle; very long texts are hashed in blocks of
shingles; repeated rows and rows with equal ids are rows of their own; a row with a null id
is linked like any other but does not name a component, so a component of such rows alone
has a null name; an empty table gives no rows; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import map_arrow, slices, unused
from weftgraph.plans.scratch import Scratch

FANOUT = 8
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The bits set in over half of the hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        rows = [b" ".join(words)]
    else:
        rows = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(row, seed) for row in rows], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``doc_id`` and ``print``, the fingerprint as a signed long."""
    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    kind = kept.schema[0].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = np.array([fingerprint(x, shingle) for x in batch.column("__text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return map_arrow(kept, kernel, f"doc_id {kind}, print long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the binary-reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Groups of fingerprints under shared masked patterns.

    ``levels[0]`` are the fingerprints in order of group and Gray rank.  A node above
    holds ``first``, its first child, ``size``, their number, and the ``mask`` and
    ``bits`` that all below share beyond what the nodes above share.
    """

    def __init__(self, groups: np.ndarray, prints: np.ndarray, fanout: int = FANOUT):
        self.order = np.lexsort((gray_rank(prints), groups))
        prints, groups = prints[self.order], groups[self.order]
        self.prints, self.groups = prints, groups
        levels = [{"mask": np.full(len(prints), ~np.uint64(0)), "bits": prints}]
        while True:
            ends = np.flatnonzero(np.append(groups[1:] != groups[:-1], True))
            starts = np.append(0, ends[:-1] + 1)
            if len(starts) == len(groups):
                break
            within = np.arange(len(groups)) - np.repeat(starts, ends - starts + 1)
            first = np.flatnonzero(within % fanout == 0)
            below = levels[-1]
            same_one = np.bitwise_and.reduceat(below["bits"] & below["mask"], first)
            same_zero = np.bitwise_and.reduceat(~below["bits"] & below["mask"], first)
            levels.append({"first": first, "size": np.diff(np.append(first, len(groups))), "mask": same_one | same_zero, "bits": same_one})
            groups = groups[first]
        for above, below in zip(levels[:0:-1], levels[-2::-1], strict=True):  # keep what is new below
            below["rest"] = below["mask"] & ~np.repeat(above["mask"], above["size"])
        levels[-1]["rest"] = levels[-1]["mask"]
        self.levels = levels
        self.roots = np.searchsorted(groups, self.groups)  # of each fingerprint's group

    def pairs(self, most: int = 3, block: int = 1 << 10) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of positions (a, b), a before b, of the fingerprints within ``most`` bits in one group."""
        for start in range(0, len(self.prints), block):
            query = np.arange(start, min(start + block, len(self.prints)))
            node, off = self.roots[query], np.zeros(len(query), np.int8)
            for depth in range(len(self.levels) - 1, -1, -1):
                level = self.levels[depth]
                off = off + np.bitwise_count((self.prints[query] ^ level["bits"][node]) & level["rest"][node]).astype(np.int8)
                near = off <= most
                query, node, off = query[near], node[near], off[near]
                if depth:
                    size = level["size"][node]
                    child = np.repeat(level["first"][node] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                    query, node, off = np.repeat(query, size), child, np.repeat(off, size)
            later = node > query
            yield query[later], node[later]


def _smallest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of ``n`` reaches by the pairs."""
    parent = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = parent[a], parent[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            apart = parent[a] != parent[b]
            a, b = a[apart], b[apart]
    return parent


def _link_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (node, to) that join each class to the smallest id that it reaches in its group."""

    def linked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["group", "id"], kind="stable")
        ids = part["id"].to_numpy()
        index = GrayIndex(part["group"].to_numpy(), part["print"].to_numpy().view(np.uint64))
        back = index.order
        root = _smallest(len(ids), ((np.minimum(back[a], back[b]), np.maximum(back[a], back[b])) for a, b in index.pairs()))
        far = root != np.arange(len(ids))
        return pd.DataFrame({"node": ids[far], "to": ids[root[far]]})

    held: list[pd.DataFrame] = []
    rows, mark = 0, 1 << 16
    for batch in batches:  # sorted by group: whole groups are worked on as soon as they are many
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= mark:
            part = pd.concat(held, ignore_index=True)
            last = part["group"].iloc[-1]
            ready = part["group"] != last
            if ready.any():
                yield linked(part[ready])
            held, rows = [part[~ready]], int((~ready).sum())
            mark = max(1 << 16, 2 * rows)  # a large group is not put together again for each batch
    if held:
        yield linked(pd.concat(held, ignore_index=True))


def _block(value: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1))


def _without(value: Column, bits: int, width: int, k: int) -> Column:
    """A word of ``bits`` bits without its ``k``-th block from above."""
    low = bits - width * (k + 1)
    below = value.bitwiseAND(F.lit((1 << low) - 1))
    return below if k == 0 else F.shiftleft(F.shiftrightunsigned(value, low + width), low).bitwiseOR(below)


def _dealt(classes: DataFrame, most_group: int, scratch: Scratch) -> DataFrame:
    """``group, id, print``: each class in groups such that each pair within 3 bits meets in one."""
    names = F.array(*(F.struct(F.lit(k).alias("k"), _block(F.col("print"), 48 - 16 * k, 16).alias("v"), _without(F.col("print"), 64, 16, k).alias("rest")) for k in range(4)))
    left = classes.select("id", "print", F.explode(names).alias("b")).select("id", "print", (F.col("b.k") * 65536 + F.col("b.v")).cast("long").alias("group"), F.col("b.rest").alias("rest"))
    done = []
    for bits, width in ((48, 12), (36, 9), (27, 6), (21, 5), (16, 4)):
        large = scratch.keep(left.groupBy("group").count().where(F.col("count") > most_group).select("group"), f"large{width}")
        if not large.count():
            break
        marked = left.join(large.withColumn("large", F.lit(True)), "group", "left")
        done.append(marked.where("large is null").select("group", "id", "print"))
        names = F.array(*(F.struct(F.lit(k).alias("k"), _block(F.col("rest"), bits - width * (k + 1), width).alias("v"), _without(F.col("rest"), bits, width, k).alias("rest")) for k in range(4)))
        split = marked.where("large").select("group", "id", "print", F.explode(names).alias("b"))
        left = split.select("id", "print", F.xxhash64("group", "b.k", "b.v").alias("group"), F.col("b.rest").alias("rest"))
    out = left.select("group", "id", "print")
    for more in done:
        out = out.unionByName(more)
    return out


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest id that each linked node reaches; roots themselves are left out.

    Large and small stars in turn: each node ties its neighbours to its smallest one.
    """
    edges = scratch.keep(links.select(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).where("node != to").distinct(), "links")
    before = None
    for turn in range(most_rounds):
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = edges.unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.where("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to")).where("node != to").distinct()
        large = scratch.keep(large, f"large-{turn}")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("node").agg(F.min("to").alias("least"))
        joined = large.join(low, "node")
        small = joined.select(F.col("to").alias("node"), F.col("least").alias("to")).where("node != to").unionByName(low.select("node", F.col("least").alias("to"))).distinct()
        small = scratch.keep(small, f"small-{turn}")
        scratch.drop(f"large-{turn}")
        if turn:
            scratch.drop(f"small-{turn - 1}")
        edges = small
        one = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)")).alias("sum"), F.countDistinct("node").alias("nodes")).first()
        if tuple(one) == before:
            return edges.withColumnRenamed("to", "root")
        before = tuple(one)
    raise RuntimeError(f"components are not complete after {most_rounds} rounds")


def linked_prints(prints: DataFrame, most_group: int, scratch: Scratch) -> DataFrame:
    """``print, root`` for each different fingerprint; equal roots are one component."""
    classes = scratch.keep(prints.select("print", F.col("print").alias("id")).distinct(), "classes")
    dealt = _dealt(classes, most_group, scratch)
    links = dealt.repartition("group").sortWithinPartitions("group").select("group", "id", "print").mapInPandas(_link_groups, "node long, to long")
    roots = components(links, scratch)
    return classes.join(roots, F.col("id") == F.col("node"), "left").select("print", F.coalesce("root", "id").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, most_group: int = 4096) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` for each row."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(fingerprints(docs, key, text, shingle), "prints")
    roots = linked_prints(prints, most_group, scratch)
    least = prints.groupBy("print").agg(F.min("doc_id").alias("id"))
    named = scratch.keep(least.join(roots, "print"), "named")
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(names, "root").select(F.col("print").alias("__print"), "component_id")
    return prints.join(named, F.col("print") == F.col("__print")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, most_group: int = 4096) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest ``key``, null ones last, and of equal ones any."""
    scratch = Scratch(docs.sparkSession)
    name = unused(docs, "__row")
    rows = scratch.keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    prints = scratch.keep(fingerprints(rows, name, text, shingle).join(rows.select(F.col(name).alias("doc_id"), F.col(key).alias("key")), "doc_id"), "prints")
    roots = linked_prints(prints, most_group, scratch)
    order = F.struct(F.col("key").isNull().alias("none"), "key", F.col("doc_id").alias("row"))
    least = prints.groupBy("print").agg(F.min(order).alias("first"))
    keep = least.join(roots, "print").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(name))
    return rows.join(keep, name, "left_semi").select(*docs.columns)


def _oracle() -> str:
    """DuckDB SQL for ``near_duplicates``: XXH64 step by step over the bytes of each shingle, in 128-bit integers.

    Fixed values: the five primes of XXH64 and its seed.
    """
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    mask, seed = f"{(1 << 64) - 1}::UHUGEINT", 42
    primes = [int(p.split(":")[0]) for p in (p1, p2)]
    starts = [(seed + primes[0] + primes[1]) % (1 << 64), (seed + primes[1]) % (1 << 64), seed, (seed - primes[0]) % (1 << 64)]

    def mul(a: str, b: str) -> str:
        return f"((({a}) * {b}) & {mask})"

    def rotl(a: str, r: int) -> str:
        return f"(((({a}) * {1 << r}::UHUGEINT) & {mask}) | (({a}) // {1 << (64 - r)}::UHUGEINT))"

    def number(at: str, n: int) -> str:
        """The little-endian number of ``n`` bytes from a place on."""
        digits = " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in range(n - 1, -1, -1))
        return f"('0x' || {digits})::UBIGINT::UHUGEINT"

    def turn(v: str) -> str:
        return mul(rotl(mul(v, p2), 31), p1)

    def stripes(j: int) -> str:
        lanes = f"list_transform(range(n // 32), lambda k: {number(f'32 * k + {8 * j}', 8)})"
        return f"list_reduce({lanes}, lambda a, l: {mul(rotl(f'(a + {mul("l", p2)}) & {mask}', 31), p1)}, {starts[j]}::UHUGEINT)"

    merged = f"(({rotl('v0', 1)} + {rotl('v1', 7)} + {rotl('v2', 12)} + {rotl('v3', 18)}) & {mask})"
    for j in range(4):
        merged = f"(({mul(f'xor({merged}, {turn(f"v{j}")})', p1)} + {p4}) & {mask})"
    eight = f"list_reduce(list_transform(range(n % 32 // 8), lambda k: {number('n // 32 * 32 + 8 * k', 8)}), lambda a, l: ({mul(rotl(f'xor(a, {turn("l")})', 27), p1)} + {p4}) & {mask}, h)"
    four = f"CASE WHEN n % 8 >= 4 THEN ({mul(rotl(f'xor(h, {mul(number("n // 8 * 8", 4), p1)})', 23), p2)} + {p3}) & {mask} ELSE h END"
    one = f"list_reduce(list_transform(range(n % 4), lambda k: {number('n // 4 * 4 + k', 1)}), lambda a, l: {mul(rotl(f'xor(a, {mul("l", p5)})', 11), p1)}, h)"
    bits = ", ".join(f"(2 * sum((h >> {b}) & 1) > count(*))::INT::UBIGINT << {b} AS b{b}" for b in range(64))
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 2),
kinds AS MATERIALIZED (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles)),
long AS MATERIALIZED (SELECT s, x, n, {", ".join(f"CASE WHEN n >= 32 THEN {stripes(j)} END AS v{j}" for j in range(4))} FROM kinds),
a AS MATERIALIZED (SELECT s, x, n, ((CASE WHEN n >= 32 THEN {merged} ELSE {seed}::UHUGEINT + {p5} END) + n::UHUGEINT) & {mask} AS h FROM long),
b AS MATERIALIZED (SELECT s, x, n, {eight} AS h FROM a),
c AS MATERIALIZED (SELECT s, x, n, {four} AS h FROM b),
d AS MATERIALIZED (SELECT s, {one} AS h FROM c),
e AS MATERIALIZED (SELECT s, {mul(f"xor(h, h // {1 << 33}::UHUGEINT)", p2)} AS h FROM d),
f AS MATERIALIZED (SELECT s, {mul(f"xor(h, h // {1 << 29}::UHUGEINT)", p3)} AS h FROM e),
g AS MATERIALIZED (SELECT s, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM f),
found AS (SELECT doc_id, {bits} FROM shingles JOIN g USING (s) GROUP BY doc_id),
prints AS MATERIALIZED (SELECT w.doc_id, coalesce({" | ".join(f"b{b}" for b in range(64))}, 0::UBIGINT) AS print FROM w LEFT JOIN found USING (doc_id)),
classes AS MATERIALIZED (SELECT print, min(doc_id) AS id FROM prints GROUP BY print),
links AS MATERIALIZED (SELECT l.print AS p, r.print AS q FROM classes l JOIN classes r ON l.print <> r.print AND bit_count(xor(l.print, r.print)) <= 3),
reach AS (SELECT print, print AS q FROM classes UNION SELECT r.print, l.q FROM reach r JOIN links l ON l.p = r.q),
named AS (SELECT r.print, min(c.id) AS component_id FROM reach r JOIN classes c ON c.print = r.q GROUP BY r.print)
SELECT doc_id, lower(lpad(to_hex(print), 16, '0')) AS fingerprint, component_id FROM prints JOIN named USING (print)
"""


ORACLE = _oracle()
