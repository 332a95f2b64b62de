"""Near-duplicates by Jaccard similarity of word shingles, without loss.

A text is the set of its hashed shingles of ``width`` words.  Texts whose sets are alike
by ``share`` (4 of 5) or more are linked, and what links reach is one component.

At that similarity about 10 of 64 SimHash bits differ, and 19 or more in some pairs: blocks
in which all such pairs agree would have 3 bits, and nearly all texts would meet.  So texts
meet by shingles:

1. Texts with equal sets are one class, named by its smallest row.
2. Sets are ordered, rare shingles first; how common one is, is read off one text in
   ``ONE_IN``, at any size, and only the work depends on it.  Two sets that are alike by
   ``share`` have one of their first ``n - ceil(share n) + 1`` shingles in common, and at its
   place enough shingles are left in both.
3. In each group of classes with such a shingle all are compared with the one whose shingle
   stands earliest; then all pairs that no link joins yet.  First shingles are compared
   before whole sets, and say for most pairs that they cannot be alike enough.
4. A group of more than ``most_group`` classes is cut by lengths and a hash into blocks of
   bounded bytes.  A task holds two blocks of whole sets, counts what all their pairs share,
   and gives a forest of its links: fewer links than classes, and no candidates.
5. Components follow from alternating star contraction.

Edge cases: null, empty and wordless texts are one class; a text shorter than a shingle is
one shingle; very long texts are whole sets, one row each; rows are told apart by a key of
their own, so ids may be null, repeat or be of any type; of rows with equal ids one stays for
each component; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import map_arrow, slices, unused
from weftgraph.llm.simhash import _LOWER, components
from weftgraph.plans.scratch import Scratch

WIDTH, SHARE = 5, (4, 5)
#: Common shingles are found in one text of so many, but in so many texts at least; so many of these make one common.
ONE_IN, LEAST_SAMPLE, COMMON = 16, 10_000, 3
#: How common shingles are is held in so many bytes, by hash.
CELLS = 1 << 22
#: Classes of a group that are compared in one task as they are, and the classes and shingles of a block of a larger one.
MOST_GROUP, BLOCK_CLASSES, BLOCK_SHINGLES = 2_000, 1_000, 1 << 20
#: Shingles or row keys to broadcast at most, 8 bytes each; more are joined.
BROADCAST_ROWS = 2_000_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of a text's shingles, each once, in ascending order."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    rows = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(row, 42) for row in rows], np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _only(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` with one of ``keys``, a written table."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, name, "left_semi")


def shingle_sets(rows: DataFrame, text: str, width: int) -> DataFrame:
    """``id`` (the row) and ``shingles``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(x, width) for x in batch.column("__text").to_pylist()])], ["id", "shingles"])

    return map_arrow(rows.select("__row", F.col(text).cast("string").alias("__text")), kernel, "id long, shingles array<long>")


def common_shingles(rows: DataFrame, text: str, width: int) -> np.ndarray:
    """For each of ``CELLS`` remainders of shingles, the binary logarithm of the most texts of a sample that one of them stands in, or 0."""
    part = max(1 / ONE_IN, LEAST_SAMPLE / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("__row"), F.lit(1 << 30)) < int(min(1.0, part) * (1 << 30)))
    found = shingle_sets(some, text, width).select(F.explode("shingles").alias("token")).groupBy("token").count().where(F.col("count") >= COMMON)
    # CELLS rows at most, of five bytes
    table = found.groupBy(F.pmod("token", F.lit(CELLS)).cast("int").alias("cell")).agg(F.floor(F.log2(F.max("count"))).cast("byte").alias("level")).toArrow()
    levels = np.zeros(CELLS, np.int8)
    levels[table.column("cell").to_numpy()] = table.column("level").to_numpy()
    return levels


def first_shingles(rows: DataFrame, text: str, width: int, share: tuple[int, int], levels: np.ndarray) -> DataFrame:
    """``__row``, ``same`` (equal for equal sets), ``n`` and ``tokens``, the first shingles of the set in order."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            same, sizes, firsts = [], [], []
            for x in batch.column("__text").to_pylist():
                found = shingle_set(x, width)
                n = len(found)
                same.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(n)
                firsts.append(found[np.lexsort((found, levels[found % CELLS]))][: n + 1 + -share[0] * n // share[1]] if n else found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), _lists(firsts)], ["__row", "same", "n", "tokens"])

    return map_arrow(rows.select("__row", F.col(text).cast("string").alias("__text")), kernel, "__row long, same binary, n int, tokens array<long>")


def _pairs(share: tuple[int, int]):
    """Pairs of classes of one group and different components that may be alike enough."""
    up, down = share

    def paired(part: pd.DataFrame, block: int = 1024) -> Iterator[pd.DataFrame]:
        part = part.sort_values(["token", "id"], kind="stable")
        token, ids, n, at, root = (part[c].to_numpy() for c in ("token", "id", "n", "at", "root"))
        ends = np.flatnonzero(np.append(token[1:] != token[:-1], True)) + 1
        for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            for low in range(start, end, block):
                i = np.arange(low, min(low + block, end))[:, None]
                for right in range(low, end, block):
                    j = np.arange(right, min(right + block, end))[None, :]
                    left = 1 + np.minimum(n[i] - at[i] - 1, n[j] - at[j] - 1)
                    near = (i < j) & (root[i] != root[j]) & (left * (up + down) >= up * (n[i] + n[j]))
                    a, b = np.nonzero(near)
                    if len(a):
                        yield pd.DataFrame({"a": ids[i[a, 0]], "b": ids[j[0, b]]})

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows, mark = 0, 1 << 16
        for batch in batches:  # sorted by token: whole groups are worked on as soon as they are many
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows >= mark:
                part = pd.concat(held, ignore_index=True)
                ready = part["token"] != part["token"].iloc[-1]
                if ready.any():
                    yield from paired(part[ready])
                held, rows = [part[~ready]], int((~ready).sum())
                mark = max(1 << 16, 2 * rows)
        if held:
            yield from paired(pd.concat(held, ignore_index=True))

    return kernel


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """How many members each set of ``left`` has in common with each of ``right``."""
    sizes = [len(x) for x in (*left, *right)]
    names, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mine = owner < len(left)
    both = (np.bincount(at[mine], minlength=len(names)) > 0) & (np.bincount(at[~mine], minlength=len(names)) > 0)
    column = np.cumsum(both) - 1
    used = both[at]
    owner, column = owner[used], column[at[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    counts = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(both.sum()), most):
        here = slice(*np.searchsorted(column, (low, low + most)))
        held = np.zeros((len(sizes), most), np.float32)
        held[owner[here], column[here] - low] = 1
        counts += held[: len(left)] @ held[len(left) :].T
    return counts.astype(np.int64)


def _forest(share: tuple[int, int]):
    """Links of the pairs of two blocks, rows sorted by pair of blocks and side: a forest of those of each pair of blocks."""
    up, down = share

    def joined(left: list[tuple], right: list[tuple]) -> Iterator[tuple[int, int]]:
        (id_l, root_l, set_l), (id_r, root_r, set_r) = (list(zip(*side, strict=True)) for side in (left, right))
        n_l, n_r = (np.array([len(x) for x in sets])[:, None] for sets in (set_l, set_r))
        alike = shared_counts(set_l, set_r) * (up + down) >= up * (n_l + n_r.T)
        names, roots = np.unique(np.array([*root_l, *root_r]), return_inverse=True)
        of_l, of_r = roots[: len(left)], roots[len(left) :]
        parent = np.arange(len(names))
        for i in range(len(left)):
            near = np.flatnonzero(alike[i])
            own = parent[of_l[i]]
            other, first = np.unique(parent[of_r[near]], return_index=True)
            for root, j in zip(other.tolist(), near[first].tolist(), strict=True):
                if root != own:
                    yield id_l[i], id_r[j]
                    parent[parent == root] = own

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])
        links: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("token", "pair", "side", "id", "root")]
            sets = batch.column("shingles")
            for at, (token, pair, side, row, root) in enumerate(zip(*(c.to_pylist() for c in columns), strict=True)):
                if (token, pair) != key:
                    if sides[0] and sides[1]:
                        links.extend(joined(*sides))
                    key, sides = (token, pair), ([], [])
                sides[side].append((row, root, sets[at].values.to_numpy()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["node", "to"])
                links = []
        if sides[0] and sides[1] and (links := list(joined(*sides))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["node", "to"])

    return kernel


def block_links(large: DataFrame, rows: DataFrame, text: str, width: int, share: tuple[int, int], block: tuple[int, int], scratch: Scratch) -> DataFrame:
    """``node, to``: a forest of the links inside each group of ``token, id, n, root``, by pairs of blocks.

    Alike sets differ in length by less than ``1 / share``, so their bands of lengths are the same
    or neighbours.  A band is cut by a hash into blocks of about ``block`` classes and shingles.
    """
    up, down = share
    most, weight = block
    step = max(math.log(down / up), 1e-3) * (1 + 1e-9)
    large = large.withColumn("band", F.floor(F.log("n") / step).cast("int"))
    sizes = large.groupBy("token", "band").agg(F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum("n") / weight)).cast("int").alias("blocks"))
    sizes = scratch.keep(sizes, "blocks")
    placed = large.join(sizes, ["token", "band"]).withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
    blocks = sizes.select("token", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    upper = blocks.select("token", F.col("band").alias("band_b"), F.col("salt").alias("salt_b"), F.explode(F.array("band", F.col("band") - 1)).alias("band"))
    pairs = blocks.join(upper, ["token", "band"]).where((F.col("band_b") > F.col("band")) | (F.col("salt_b") >= F.col("salt")))
    pairs = scratch.keep(pairs.withColumn("pair", F.concat_ws(":", "band", "salt", "band_b", "salt_b")), "block-pairs")
    names = ["token", "pair", "side", "id", "root"]
    left = placed.join(pairs, ["token", "band", "salt"]).withColumn("side", F.lit(0)).select(*names)
    right = placed.join(pairs.select("token", "pair", F.col("band_b").alias("band"), F.col("salt_b").alias("salt")), ["token", "band", "salt"]).withColumn("side", F.lit(1)).select(*names)
    ids = scratch.keep(large.select(F.col("id").alias("__row")).distinct(), "block-ids")
    sets = scratch.keep(shingle_sets(_only(rows, ids, "__row"), text, width), "block-sets")
    both = left.unionByName(right).join(sets, "id").repartition("token", "pair").sortWithinPartitions("token", "pair", "side")
    found = scratch.keep(both.select(*names, "shingles").mapInArrow(_forest(share), "node long, to long"), "block-links")
    scratch.drop("block-sets")
    scratch.release()
    return found


def row_components(rows: DataFrame, text: str = "text", width: int = WIDTH, share: tuple[int, int] = SHARE, most_group: int = MOST_GROUP, block: tuple[int, int] = (BLOCK_CLASSES, BLOCK_SHINGLES)) -> DataFrame:
    """``__row`` and ``root``, the smallest row of its component, for each of ``rows``, which have a ``__row``."""
    scratch = Scratch(rows.sparkSession)
    up, down = share
    firsts = scratch.keep(first_shingles(rows, text, width, share, common_shingles(rows, text, width)), "firsts")
    classes = scratch.keep(firsts.groupBy("same").agg(F.min("__row").alias("id")), "classes")
    one = _only(firsts, classes.select(F.col("id").alias("__row")), "__row")
    placed = one.select(F.col("__row").alias("id"), "n", F.posexplode("tokens").alias("at", "token"))
    repeated = scratch.keep(placed.groupBy("token").count().where("count > 1").select("token"), "repeated")
    members = scratch.keep(_only(placed, repeated, "token"), "members")
    leads = members.groupBy("token").agg(F.min(F.struct("at", "n", "id")).alias("lead"))
    del one, placed
    scratch.release()

    def alike(pairs: DataFrame, label: str) -> DataFrame:
        # of two sets' first shingles, the set whose last one is rarer has no more in common but among its others
        few = pairs.distinct().join(firsts.select(F.col("__row").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("fa")), "a").join(firsts.select(F.col("__row").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("fb")), "b")
        most = F.size(F.array_intersect("fa", "fb")) + F.greatest(F.col("na") - F.size("fa"), F.col("nb") - F.size("fb"))
        pairs = scratch.keep(few.where(most.cast("long") * (up + down) >= up * (F.col("na") + F.col("nb"))).select("a", "b"), f"{label}-pairs")
        ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("__row")).distinct(), f"{label}-ids")
        sets = scratch.keep(shingle_sets(_only(rows, ids, "__row"), text, width), f"{label}-sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
        shared = F.size(F.array_intersect("left", "right")).cast("long")
        enough = shared * (up + down) >= up * (F.size("left") + F.size("right"))
        found = scratch.keep(both.where(enough).select(F.col("a").alias("node"), F.col("b").alias("to")), f"{label}-links")
        scratch.drop(f"{label}-sets")
        scratch.release()
        return found

    left = F.least(F.col("n") - F.col("at"), F.col("lead.n") - F.col("lead.at"))
    links = alike(members.join(leads, "token").where((F.col("id") != F.col("lead.id")) & (left * (up + down) >= up * (F.col("n") + F.col("lead.n")))).select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")), "lead")
    roots = scratch.keep(components(links, scratch), "lead-roots")
    named = members.join(roots, F.col("id") == F.col("node"), "left").select("token", "id", "n", "at", F.coalesce("root", "id").alias("root"))
    named = scratch.keep(named, "named")
    # groups of two are settled by now
    apart = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("count")).where("low < high and count > 2")
    apart = scratch.keep(apart.select("token", (F.col("count") > most_group).alias("is_large")), "apart")
    rest = named.join(apart.where("not is_large"), "token", "left_semi").repartition("token").sortWithinPartitions("token").mapInPandas(_pairs(share), "a long, b long")
    links = links.unionByName(alike(rest, "rest"))
    if not apart.where("is_large").isEmpty():
        large = scratch.keep(named.join(apart.where("is_large"), "token", "left_semi").select("token", "id", "n", "root"), "large")
        links = links.unionByName(block_links(large, rows, text, width, share, block, scratch))
    roots = components(links, Scratch(rows.sparkSession))
    joined = classes.join(roots, F.col("id") == F.col("node"), "left").select("same", F.coalesce("root", "id").alias("root"))
    return firsts.select("__row", "same").join(joined, "same").select("__row", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest ``key``, null ones last, and of equal ones any."""
    scratch = Scratch(docs.sparkSession)
    name = unused(docs, "__row")
    rows = scratch.keep(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    bare = rows.select(F.col(name).alias("__row"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    found = bare.select("__row", "__key").join(row_components(bare, "__text", **options), "__row")
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("__key").isNull().alias("null"), "__key", "__row")).alias("first")).select(F.col("first.__row").alias(name))
    return _only(rows, scratch.keep(keep, "first"), name).select(*docs.columns)
