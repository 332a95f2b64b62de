"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on ``most_train`` vectors at most, chosen by a
hash; every vector is indexed: it joins the list of its nearest centroid and is coded by
its residual's nearest codeword in each subspace.  A query goes to the lists of its nearest
centroids, as many as hold ``coverage`` of the neighbours of some of the queries within the
sample (of queries, as they may lie apart from other rows): clustered vectors need few lists,
random ones nearly all.  There a table of distances from its residual to all codewords gives
asymmetric distances to the codes; the best ``rerank`` are measured again on the original
vectors, in double precision, and then all others that may be as near as the ``k``-th of these: a
row is no nearer than its code less its distance from its code, which the index holds.  So
nothing is lost inside a list, be its codes as coarse as they may.  A query
that its lists leave with fewer than ``k`` neighbours, though there are more rows, is sent to
its other lists too.

Lists grow in number with the rows.  The first level has as many as the sample can fit
(``LEAST_TRAIN`` of its vectors for each).  A list of more than ``most_list`` rows has a second
level of centroids, fitted in a task of its own on ``LEAST_TRAIN`` rows for each, chosen by a
hash: two for each ``most_list`` rows, ``MOST_SECOND`` at most.  Its rows and queries descend to
that level in one shuffle, and the list's sample says how many of its second lists a query needs; where that is more than half, as in vectors without
clusters, the list has one second list only.
So a query is copied once for each list that it searches, and lists stay short.  Should a second
list be longer than ``most_list`` still, then of its equal vectors only the smallest ``k + 1`` ids
are kept, as no more can be among the nearest ``k``, and what remains too long is split by a hash
of the row, its queries going to each part: no row is left out.  A task reads the rows of a part
first and then its queries batch by batch, so it never holds more than one part.

A row for each second list that is too long (of ``MOST_SECOND`` for each list of the first level at
most) and one for each long list are broadcast; centroids of the second level never are.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id; vectors of different dimensions never meet, and each dimension has
an index of its own; ties go to the smaller id; with fewer candidates than ``k`` all are
returned; rows with the same id are rows of their own, as queries and as candidates; a table
without valid vectors gives no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.plans.scratch import Scratch

CODES = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of ``x``; an empty one moves to the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near, far = assign(x, c)
        count = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.append(0, np.cumsum(count[filled])[:-1]))
        c[filled] = sums / count[filled, None]
        empty = np.flatnonzero(count == 0)
        c[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return c


def assign(x: np.ndarray, c: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the squared distance less the row's own norm."""
    norms = (c**2).sum(1)
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    for i in range(0, len(x), block):
        d = norms - 2 * (x[i : i + block] @ c.T)
        near[i : i + block] = d.argmin(1)
        far[i : i + block] = d.min(1)
    return near, far + (x**2).sum(1)


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimension
    books: list[np.ndarray]  # codewords of each subspace
    cuts: list[int]  # where subspaces begin

    @staticmethod
    def fit(sample: np.ndarray, lists: int, width: int = 4) -> Index:
        x = sample
        centroids = kmeans(x, min(lists, len(x)))
        rest = x - centroids[assign(x, centroids)[0]]
        cuts = list(range(0, x.shape[1], width))
        return Index(centroids, [kmeans(rest[:, a : a + width], min(CODES, len(x))) for a in cuts], cuts)

    def _part(self, x: np.ndarray, i: int) -> np.ndarray:
        return x[:, self.cuts[i] : self.cuts[i] + self.books[i].shape[1]]

    def encode(self, x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals of the vectors of one list, and how far each vector is from its code."""
        rest = x - self.centroids[at]
        codes = np.stack([assign(self._part(rest, i), book)[0] for i, book in enumerate(self.books)], 1)
        apart = sum(((self._part(rest, i) - book[codes[:, i]]) ** 2).sum(1) for i, book in enumerate(self.books))
        return codes, np.sqrt(apart)

    def distances(self, query: np.ndarray, codes: np.ndarray, at: int) -> np.ndarray:
        """Asymmetric squared distances of one query to the codes of one list."""
        rest = query - self.centroids[at]
        out = np.zeros(len(codes))
        for i, book in enumerate(self.books):
            table = ((book - rest[self.cuts[i] : self.cuts[i] + book.shape[1]]) ** 2).sum(1)
            out += table[codes[:, i]]
        return out

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` lists of the nearest centroids of each row, nearest first."""
        d = (self.centroids**2).sum(1) - 2 * (x @ self.centroids.T)
        return np.argsort(d, axis=1, kind="stable")[:, :n]


#: Vectors of the sample for each centroid at least.
LEAST_TRAIN = 64
#: Lists of the second level in one of the first at most.
MOST_SECOND = 1024
#: A task that sends rows to the second level takes this many times ``most_list`` of them.
DESCENT = 50
#: Queries of the sample that choose how many lists are searched.
TRIALS = 256


def needed_probes(index: Index, sample: np.ndarray, k: int, coverage: float, trials: np.ndarray | None = None, own: np.ndarray | None = None) -> int:
    """The least number of lists that hold ``coverage`` of the ``k`` nearest neighbours, within the sample, of ``trials``.

    Without trials some of the sample are asked; ``own`` is a trial's place in the sample, if any, or -1.
    """
    x = sample
    if trials is None:
        trials, own = x[:TRIALS], np.arange(min(TRIALS, len(x)))
    lists_of, norms = assign(x, index.centroids)[0], (x**2).sum(1)
    depth = np.argsort(index.probes(trials, len(index.centroids)), axis=1)  # the place of each list for each query
    found = []
    for i, trial in enumerate(trials):
        d = norms - 2 * (x @ trial)
        if own[i] >= 0:
            d[own[i]] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else np.zeros(0, np.int64)
        found.append(depth[i][lists_of[near]])
    places = np.sort(np.concatenate(found)) if found else []
    return int(places[min(len(places) - 1, int(np.ceil(coverage * len(places))))]) + 1 if len(places) else 1


def _unpack(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def runs(batch: pa.RecordBatch, names: list[str]) -> Iterator[list[int]]:
    """Start, end and keys of each run of rows with equal keys."""
    keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], 1)
    cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else np.zeros(0, np.int64)
    for start, end in zip(cuts.tolist(), np.append(cuts[1:], len(keys)).tolist(), strict=False):
        yield [start, end, *keys[start].tolist()]


class Part:
    """The rows of one part of a list, ready for its queries."""

    def __init__(self, index: Index, at: int, row: np.ndarray, ids: np.ndarray, packed: list[bytes], k: int):
        rows = pd.DataFrame({"row": row, "id": ids, "vec": packed}).sort_values(["id", "row"], kind="stable")
        rows = rows[rows.groupby("vec").cumcount() <= k]
        self.index, self.at, self.k = index, at, k
        self.row, self.ids, self.vectors = rows["row"].to_numpy(), rows["id"].to_numpy(), _unpack(rows["vec"])
        self.codes, self.apart = index.encode(self.vectors, at)

    def search(self, row: int, query: np.ndarray, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the nearest, best first; no other row of the part is nearer."""
        coarse = np.nan_to_num(self.index.distances(query, self.codes, self.at), nan=0.0)
        others = np.flatnonzero(self.row != row)
        best = others
        if len(others) > rerank:
            best = others[np.argpartition(coarse[others], rerank - 1)[:rerank]]
        exact = self.measure(query, best)
        if len(others) > rerank:
            last = np.partition(exact, self.k - 1)[self.k - 1] if len(exact) >= self.k else np.inf
            # the last term is for what rounding takes from the difference
            low = np.sqrt(coarse) - self.apart - 1e-12 * np.sqrt(query @ query)
            low[best] = low[self.row == row] = np.inf
            more = np.flatnonzero(low <= last)
            best, exact = np.concatenate([best, more]), np.concatenate([exact, self.measure(query, more)])
        order = np.lexsort((self.ids[best], exact))[: self.k]
        return self.ids[best][order], exact[order]

    def measure(self, query: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[places] - query) ** 2).sum(1))


FOUND = "query_row long, query_id long, vec_id long, score double"


def search_parts(indexes: dict[int, Index], k: int, rerank: int):
    """Kernel over rows sorted by part, in each the vectors first and then the queries."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for start, end, *here, asks in runs(batch, ["size", "list", "second", "part", "asks"]):
                if here != key:
                    key, held, part = here, [], None
                rows, ids = (batch.column(c)[start:end].to_numpy() for c in ("row", "vec_id"))
                vecs = batch.column("vec")[start:end].to_pylist()
                if not asks:
                    held.append((rows, ids, vecs))
                    continue
                if part is None and held:
                    part = Part(indexes[here[0]], int(here[1]), np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), [v for x in held for v in x[2]], k)
                    held = []
                for row, query_id, query in zip(rows.tolist(), ids.tolist(), _unpack(vecs), strict=True) if part else ():
                    near, far = part.search(row, query, rerank)
                    out.append((np.full(len(near), row), np.full(len(near), query_id), near, far))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_row", "query_id", "vec_id", "score"])

    return kernel


def valid(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def fit(rows: DataFrame, sizes: dict[int, int], k: int, lists: int | None, coverage: float, most_train: int) -> tuple[dict[int, Index], dict[int, int], dict[int, np.ndarray]]:
    """An index, the number of lists to search, and the queries that chose it, for each dimension."""

    def drawn(some: DataFrame, most: int):
        table = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", "v").toArrow()
        column = table.column("v").combine_chunks()
        flat, long = column.flatten().to_numpy(), pa.compute.list_value_length(column).to_numpy()
        starts, ids = np.cumsum(long) - long, table.column("vec_id").to_numpy()
        return lambda size: (ids[long == size], flat[starts[long == size][:, None] + np.arange(size)])

    sample, asked = drawn(rows, most_train), drawn(rows.where("is_query"), TRIALS)
    indexes, probes, trials = {}, {}, {}
    for size, n in sizes.items():
        (ids, x), (query_ids, queries) = sample(size), asked(size)
        trials[size] = queries
        if not len(x):  # too rare for the sample: one list
            indexes[size], probes[size] = Index.fit(np.zeros((1, size)), 1), 1
            continue
        indexes[size] = Index.fit(x, min(lists or int(max(1, n**0.5 / 2)), max(1, len(x) // LEAST_TRAIN)))
        place = {i: at for at, i in enumerate(ids.tolist())}
        own = np.array([place.get(i, -1) for i in query_ids.tolist()], np.int64)
        probes[size] = needed_probes(indexes[size], x, k, coverage, queries if len(queries) else None, own)
    return indexes, probes, trials


LIST = ["size", "list"]
ROW = ["row", "vec_id", "vec"]
#: What a row of the descent is: a list's centroids, a row to place, a query for the lists it needs, for the others, for all.
LEVEL, PLACE, FIRST, REST, ALL = range(5)


def second_level(stored: DataFrame, indexes: dict[int, Index], first: dict[int, int], trials: dict[int, np.ndarray], k: int, coverage: float, most_list: int, scratch: Scratch) -> DataFrame | None:
    """``size, list, salts, centroids, probes`` of each list of more than ``most_list`` rows; none where all are short."""
    counts = stored.groupBy(*LIST).count().where(F.col("count") > most_list)
    share = F.col("count") / most_list
    long = scratch.keep(counts.withColumn("seconds", F.least(F.ceil(share * 2), F.lit(MOST_SECOND)).cast("int")).withColumn("salts", F.ceil(share / DESCENT).cast("int")), "long")
    if long.isEmpty():
        return None

    def fit_list(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        x = _unpack(rows["vec"])
        index = Index(kmeans(x, min(int(rows["seconds"].iloc[0]), len(x))), [], [])
        probes = needed_probes(index, x, k, coverage)
        size, at = int(rows["size"].iloc[0]), int(rows["list"].iloc[0])
        asked = trials[size]
        asked = asked[(indexes[size].probes(asked, first[size]) == at).any(1)] if len(asked) else asked
        if len(asked):  # queries that search this list may lie apart from its rows
            equal = [np.flatnonzero((x == one).all(1)) for one in asked]
            probes = max(probes, needed_probes(index, x, k, coverage, asked, np.array([e[0] if len(e) else -1 for e in equal])))
        if probes * 2 > len(index.centroids):  # vectors without clusters: parts by a hash, which are half as many
            index, probes = Index(x.mean(0, keepdims=True), [], []), 1
        return rows[["size", "list", "salts"]].head(1).assign(centroids=index.centroids.tobytes(), probes=probes)

    # a thousand vectors at least, or the sample of a list hardly longer than ``most_list`` would say little
    wanted = F.greatest(F.col("seconds") * LEAST_TRAIN, F.lit(1024))
    sample = stored.join(F.broadcast(long), LIST).where(F.pmod(F.xxhash64("row"), F.col("count")) < wanted)
    fitted = sample.groupBy(*LIST).applyInPandas(fit_list, "size int, list int, salts int, centroids binary, probes int")
    return scratch.keep(fitted, "levels")


def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second lists of rows and queries, sorted by list and salt, in each the centroids first."""
    key, index, n = None, None, 0
    for batch in batches:
        for start, end, *here, kind in runs(batch, ["size", "list", "salt", "kind"]):
            if kind == LEVEL:
                found = batch.column("centroids")[start].as_py()
                key, index, n = here, Index(np.frombuffer(found, "<f8").reshape(-1, here[0]), [], []), batch.column("probes")[start].as_py()
                continue
            assert here == key  # else a list without centroids: the sample of a long list is never empty
            lists = len(index.centroids)
            places = slice(0, 1) if kind == PLACE else slice(0, n) if kind == FIRST else slice(n, lists) if kind == REST else slice(0, lists)
            step = max(1, 16_384 // lists)
            for at in range(start, end, step):
                some = batch.slice(at, min(step, end - at))
                to = index.probes(_unpack(some.column("vec").to_pylist()), lists)[:, places]
                many = pa.array(np.repeat(np.arange(len(to)), to.shape[1]))
                columns = [some.column(c).take(many) for c in (*LIST, "kind", *ROW)]
                yield pa.RecordBatch.from_arrays([pa.array(to.reshape(-1).astype(np.int32)), *columns], ["second", *LIST, "kind", *ROW])


def to_second(rows: DataFrame, levels: DataFrame | None) -> DataFrame:
    """Rows of ``size, list, kind, row, vec_id, vec`` with their ``second`` lists: 0 in a list without them."""
    columns = ["second", *LIST, "kind", *ROW]
    if levels is None:
        return rows.where(F.col("kind") != REST).withColumn("second", F.lit(0)).select(*columns)
    salts = F.broadcast(levels.select(*LIST, "salts"))
    known = rows.join(salts, LIST, "left")
    short = known.where(F.col("salts").isNull() & (F.col("kind") != REST)).withColumn("second", F.lit(0)).select(*columns)
    sent = known.where(F.col("salts").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("row", "kind"), F.col("salts")).cast("int"))
    tops = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("kind", F.lit(LEVEL)).drop("salts")
    both = sent.drop("salts").unionByName(tops, allowMissingColumns=True).repartition(*LIST, "salt").sortWithinPartitions(*LIST, "salt", "kind")
    return short.unionByName(both.mapInArrow(descend, "second int, size int, list int, kind int, row long, vec_id long, vec binary"))


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, lists: int | None = None, coverage: float = 0.98, rerank: int = 200, most_train: int = 20_000, most_list: int = 20_000) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows that ``queries`` holds for, against all others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & valid(F.col("v")))
    sizes = {r["size"]: r["count"] for r in rows.groupBy(F.size("v").alias("size")).count().collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexes, probes, trials = fit(rows, sizes, k, lists, coverage, most_train)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("v").to_pylist()
            lists_of = np.zeros(len(found), np.int32)
            size_of = np.array([len(v) for v in found], np.int32)
            for size in np.unique(size_of):
                here = np.flatnonzero(size_of == size)
                x = np.array([found[i] for i in here], np.float64)
                lists_of[here] = assign(x, indexes[int(size)].centroids)[0]
            packed = pa.array([np.asarray(v, "<f8").tobytes() for v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(size_of), pa.array(lists_of), batch.column("vec_id"), batch.column("is_query"), packed], ["size", "list", "vec_id", "is_query", "vec"])

    def send(first: bool):
        """Each query to its nearest lists, or to all that it did not search."""

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size_of = batch.column("size").to_numpy()
                vecs = batch.column("vec").to_pylist()
                for size in np.unique(size_of):
                    here, n, index = np.flatnonzero(size_of == size), probes[int(size)], indexes[int(size)]
                    for at in range(0, len(here), 64):  # a query is as often in the output as it has lists
                        some = here[at : at + 64]
                        to = index.probes(_unpack([vecs[i] for i in some]), len(index.centroids))
                        to = to[:, :n] if first else to
                        kind = np.full(to.shape, FIRST if first else ALL, np.int32)
                        if not first:
                            kind[:, :n] = REST
                        many = pa.array(np.repeat(some, to.shape[1]))
                        columns = [batch.column(c).take(many) for c in ("size", *ROW)]
                        yield pa.RecordBatch.from_arrays([pa.array(to.reshape(-1).astype(np.int32)), pa.array(kind.reshape(-1)), *columns], ["list", "kind", "size", *ROW])

        return kernel

    stored = rows.mapInArrow(place, "size int, list int, vec_id long, is_query boolean, vec binary").withColumn("row", F.monotonically_increasing_id())
    stored = scratch.keep(stored, "stored")
    levels = second_level(stored, indexes, probes, trials, k, coverage, most_list, scratch)
    placed = to_second(stored.withColumn("kind", F.lit(PLACE)), levels)
    key = [*LIST, "second"]
    parts = None
    if levels is not None:
        placed = scratch.keep(placed, "placed")
        heavy = F.broadcast(scratch.keep(placed.groupBy(*key).count().where(F.col("count") > most_list).drop("count"), "heavy"))
        place_of = F.row_number().over(Window.partitionBy(*key, "vec").orderBy("vec_id", "row"))
        few = scratch.keep(placed.join(heavy, key, "left_semi").withColumn("n", place_of).where(F.col("n") <= k + 1).drop("n"), "few")
        placed = placed.join(heavy, key, "left_anti").unionByName(few)
        parts = F.broadcast(scratch.keep(few.groupBy(*key).agg(F.ceil(F.count("*") / most_list).cast("int").alias("parts")).where("parts > 1"), "parts"))

    def parted(df: DataFrame, part: Column) -> DataFrame:
        df = df.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))) if parts is not None else df.withColumn("parts", F.lit(1))
        return df.withColumn("part", part).withColumn("asks", (F.col("kind") != PLACE).cast("int")).select(*key, "part", "asks", *ROW)

    searched = parted(placed, F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    def search(asking: DataFrame, first: bool, label: str) -> DataFrame:
        asked = to_second(asking.mapInArrow(send(first), "list int, kind int, size int, row long, vec_id long, vec binary"), levels)
        asked = parted(asked, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        both = searched.unionByName(asked).repartition(*key, "part").sortWithinPartitions(*key, "part", "asks", "row")
        return scratch.keep(both.mapInArrow(search_parts(indexes, k, rerank), FOUND), label)

    asking = stored.where("is_query").select("size", "row", "vec_id", "vec")
    found = search(asking, True, "found")
    counts = found.groupBy("query_row").count()
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for size, n in sizes.items() for x in (size, min(k, n - 1))]), F.col("size")), F.lit(0))
    short = asking.join(counts, F.col("row") == F.col("query_row"), "left").where(F.coalesce("count", F.lit(0)) < most).select(*asking.columns)
    short = scratch.keep(short, "short")
    if not short.isEmpty():
        found = found.unionByName(search(short, False, "more"))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
