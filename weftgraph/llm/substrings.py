"""Substring dedup: compressed FM-indexes over shards of passages that may repeat.

A window is ``window`` consecutive words.  Each word goes that a window covers whose
word sequence also starts earlier, in a smaller id or further left in the same text.

1. Equal windows have equal minimisers (the least hash of their short word runs), so
   only stretches of windows whose minimiser occurs twice or more can repeat; the rest,
   most of a clean corpus, never leaves its task.  Counting minimisers shuffles about
   one number for eight words.
2. Such stretches are passages, dealt to shards by minimiser.  In a shard equal
   passages are one: all but the earliest are removed whole, and the earliest stands
   for them in the index.
3. A shard indexes its passages: suffix order, Burrows-Wheeler transform, wavelet
   matrix of bit rows with block counts.  The passages are streamed through it from
   right to left: each word is one backward step, and at full window length the match
   is cut by its last word, so the matching statistics up to the window length fall
   out; windows whose suffix interval holds an earlier start are reported.
4. A minimiser with more than ``most_places`` places (a passage within very many texts)
   does not go to a shard as it is.  Its passages are first made one where equal, summed
   up before they are shuffled, with a join back to the places that Spark splits where
   one passage is hot.  If more different ones than ``most_places`` are left (each text
   surrounds the passage in its own way), they are dealt by single windows.

   The index decides all other windows; these are equal or not by hashes of 128 bits, as a
   group that grows with the corpus fits no index.

Edge cases: null, empty and short texts lose nothing; very long texts are passages like any
other; rows with the same id and place, repeated rows among them, do not precede each other;
rows without an id are kept whole and remove nothing; ids that are not integers are ordered
as they are and numbered first; an empty table gives no rows; columns of the input with the
names of results, or any other, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import map_arrow, slices
from weftgraph.plans.ordered import running_sum
from weftgraph.plans.scratch import Scratch

#: Words of the runs that a window's minimiser is taken from.
RUN = 6
#: Words of one index; a shard's groups are cut into indexes of about this size.
INDEX_WORDS = 200_000
#: Factor of the hash of words, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row)
    return _POWERS["up"], _POWERS["down"]


class Stretches:
    """The windows of a batch of texts, joined where neighbours have the same minimiser."""

    def __init__(self, texts: list[str | None], window: int):
        raw = [x.encode("utf-8", "replace") if x else b"" for x in texts]
        self.data = b"\n".join([*raw, b""])
        data = np.frombuffer(self.data, np.uint8)
        edges = np.diff(np.concatenate([[False], ~_IS_SPACE[data], [False]]).astype(np.int8))
        self.left, self.right = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        n = len(self.left)
        offsets = np.append(0, np.cumsum([len(x) + 1 for x in raw]))
        bounds = np.searchsorted(self.left, offsets)
        self.begins = bounds[:-1]
        self.text = np.repeat(np.arange(len(texts)), np.diff(bounds))
        if n < window:
            self.runs = self.least = np.zeros(0, np.uint64)
            self.ok = np.zeros(0, bool)
            return
        up, down = _powers(len(data))
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]))
        hashes = _mixed((sums[self.right] - sums[self.left]) * down[self.left])
        runs = np.zeros(n - RUN + 1, np.uint64)
        for k in range(RUN):
            runs = runs * np.uint64(_BASE) + hashes[k : n - RUN + 1 + k]
        self.runs = _mixed(runs)
        self.span = window - RUN + 1
        self.least = _slide(np.minimum, self.runs, self.span)
        self.ok = self.text[: n - window + 1] == self.text[window - 1 :]

    def words(self, first: int, n: int) -> bytes:
        """``n`` words joined by one space."""
        return b" ".join(self.data[self.left[first] : self.right[first + n - 1]].split())

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each place that is the minimiser of some window."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pad = np.zeros(self.span - 1, np.uint64)
        most = _slide(np.maximum, np.concatenate([pad, np.where(self.ok, self.least, 0), pad]), self.span)
        chosen = np.flatnonzero(self.runs == most)
        return self.text[chosen], self.runs[chosen]

    def passages(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, minimiser) of each stretch whose minimiser is wanted."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        change = np.append(True, (self.least[1:] != self.least[:-1]) | (self.ok[1:] != self.ok[:-1]) | (self.text[1 : len(self.least)] != self.text[: len(self.least) - 1]))
        first = np.flatnonzero(change)
        size = np.diff(np.append(first, len(self.least)))
        use = self.ok[first] & np.isin(self.least[first], wanted)
        return first[use], size[use], self.least[first][use]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _slide(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


def minimisers(docs: DataFrame, window: int) -> DataFrame:
    """``anchor, doc_id`` for each minimiser place of ``doc_id, text``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=500_000):
            text, anchor = Stretches(batch.column("text").to_pylist(), window).minimisers()
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), batch.column("doc_id").take(pa.array(text))], ["anchor", "doc_id"])

    return map_arrow(docs.where("doc_id is not null"), kernel, "anchor long, doc_id long")


def passages(docs: DataFrame, window: int) -> DataFrame:
    """``anchor, span, doc_id, h, start, n`` of the stretches of ``doc_id, h, text, anchors, hot``.

    ``sid`` is a hash of the passage where its minimiser is hot, else null.
    """

    def numbers(column: pa.Array) -> np.ndarray:
        return np.unique(pa.compute.list_flatten(column).to_numpy(zero_copy_only=False)).view(np.uint64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=500_000):
            s = Stretches(batch.column("text").to_pylist(), window)
            first, size, anchor = s.passages(numbers(batch.column("anchors")))
            hot = np.isin(anchor, numbers(batch.column("hot"))).tolist()
            spans = [s.words(a, n + window - 1) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
            sids = [xxhash.xxh3_128_digest(x) if h else None for x, h in zip(spans, hot, strict=True)]
            text = s.text[first] if len(first) else first
            start = first - s.begins[text] if len(first) else first
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(spans, pa.binary()).cast(pa.string()), pa.array(sids, pa.binary()), batch.column("doc_id").take(take), batch.column("h").take(take), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))],
                ["anchor", "span", "sid", "doc_id", "h", "start", "n"],
            )

    return map_arrow(docs, kernel, "anchor long, span string, sid binary, doc_id long, h long, start int, n int")


class WaveletMatrix:
    """A sequence of symbols as one bit row for each bit, with counts for each 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.rows = bits, []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view("<u8")
            counts = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]).astype(np.int32)
            self.rows.append((packed, counts, int(len(symbols) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbols before ``at`` that equal ``symbol`` end in the matrix's last order."""
        for k, (packed, counts, zeros) in enumerate(self.rows):
            block = at >> 6
            below = packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(below)
            at = np.where(symbol >> (self.bits - 1 - k) & 1, zeros + ones, at - ones)
        return at


class FmIndex:
    """An index over passages of words, for matches of up to ``window`` words."""

    def __init__(self, text: np.ndarray, window: int):
        n = len(text)
        self.text, self.window = text, window
        ranks = {1: text.astype(np.int32)}
        width = 1
        while width < window + 1:  # ranks by the first 1, 2, 4 ... words
            here = ranks[width]
            after = np.append(here[width:], np.zeros(min(width, n), np.int32))[:n]
            both = here.astype(np.int64) * (int(max(here.max(), after.max())) + 1) + after
            order = np.argsort(both, kind="stable")
            new = np.append(True, both[order][1:] != both[order][:-1])
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new)
            width *= 2
            ranks[width] = rank
        self.suffixes = order.astype(np.int32)
        for width in [w for w in ranks if w < (window - 1) // 2]:
            del ranks[width]
        bits = max(1, int(text.max()).bit_length())
        self.matrix = WaveletMatrix(text[order - 1], bits)
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=1 << bits)))
        symbols = np.arange(1 << bits)
        self.base = self.matrix.place(symbols, np.zeros(len(symbols), np.int64))
        self.short, self.short_end = self._blocks(ranks, window - 1)
        self.full, _ = self._blocks(ranks, window)

    def _blocks(self, ranks: dict[int, np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
        """First row, and row after the last, of the suffixes that share the first ``words`` words with each row's."""
        width = max(w for w in ranks if w <= words)
        rank, n = ranks[width], len(self.text)
        shifted = np.append(rank[words - width :], np.zeros(words - width, np.int32))
        a, b = rank[self.suffixes], shifted[self.suffixes]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        first = np.flatnonzero(new)
        block = np.cumsum(new) - 1
        return first[block].astype(np.int32), np.append(first[1:], n)[block].astype(np.int32)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals after one backward step."""
        base = self.smaller[symbol] - self.base[symbol]
        return base + self.matrix.place(symbol, low), base + self.matrix.place(symbol, high)

    def windows(self, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream the passages ``text[begins:ends]``: (place, low, high) of each full window."""
        order = np.argsort(begins - ends, kind="stable")  # long ones first, so those still read are a prefix
        begins, ends = begins[order], ends[order]
        size = ends - begins
        low, high = np.zeros(len(begins), np.int64), np.full(len(begins), len(self.text))
        for read in range(int(size.max(initial=0))):
            alive = int(np.searchsorted(-size, -read, side="left"))
            at = ends[:alive] - 1 - read
            low, high = self.step(self.text[at], low[:alive], high[:alive])
            if read >= self.window - 1:
                yield at, low, high
                low, high = self.short[low], self.short_end[low]  # without the last word


def earlier_windows(spans: list[str], doc: np.ndarray, start: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each passage the ranges of its windows that start earlier in some passage."""
    ids: dict[str, int] = {}
    lengths = np.array([span.count(" ") + 1 for span in spans])
    flat = np.fromiter((ids.setdefault(w, len(ids) + 1) for span in spans for w in f"{span} ".split(" ")), np.int32, int(lengths.sum()) + len(spans))
    flat[flat == ids.pop("")] = 0
    del ids
    begins = np.append(0, np.cumsum(lengths + 1)[:-1])
    index = FmIndex(flat, window)
    # places in the order of (doc, start); equal ones alike
    which = np.repeat(np.arange(len(spans)), lengths + 1)
    place = start[which] + np.arange(len(flat)) - begins[which]
    order = np.lexsort((place, doc[which]))
    new = np.append(True, (np.diff(doc[which][order]) != 0) | (np.diff(place[order]) != 0))
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.cumsum(new)
    first_rows = np.flatnonzero(index.full == np.arange(len(flat)))
    least = np.minimum.reduceat(rank[index.suffixes], first_rows)
    least = np.repeat(least, np.diff(np.append(first_rows, len(flat))))
    hit = np.zeros(len(flat), bool)
    for at, low, _ in index.windows(begins, begins + lengths):
        hit[at] = least[low] < rank[at]
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    out: list[list[tuple[int, int]]] = [[] for _ in spans]
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        out[which[a]].append((a - int(begins[which[a]]), b - int(begins[which[a]])))
    return out


def _shard_ranges(part: pd.DataFrame, window: int) -> pd.DataFrame:
    """Word ranges to remove (doc_id, h, a, b), of the passages of whole minimisers."""
    part = part.sort_values(["doc_id", "start"], kind="stable").reset_index(drop=True)
    class_of, _ = pd.factorize(part["span"])
    doc, start, size = part["doc_id"].to_numpy(), part["start"].to_numpy().astype(np.int64), part["n"].to_numpy()
    _, first = np.unique(class_of, return_index=True)  # classes are numbered in the order of their earliest passages
    earliest = (doc == doc[first][class_of]) & (start == start[first][class_of])
    # a passage that is alone with its minimiser, and holds it once, has no equal windows
    many = part["anchor"].to_numpy()[first]
    alone = pd.Series(many).groupby(many).transform("size").to_numpy() == 1
    search = np.flatnonzero(~alone | (size[first] > window - RUN + 1) | _inner(part["span"].to_numpy()[first], alone))
    marks: list[list[tuple[int, int]]] = [[] for _ in first]
    if len(search):
        rows = first[search]
        for at, found in zip(search.tolist(), earlier_windows(part["span"].to_numpy()[rows].tolist(), doc[rows], start[rows], window), strict=True):
            marks[at] = found
    out = [(i, 0, int(size[i])) for i in np.flatnonzero(~earliest).tolist()]
    out += [(i, a, b) for i in np.flatnonzero(earliest).tolist() for a, b in marks[class_of[i]]]
    at, a, b = np.array(out, np.int64).reshape(-1, 3).T
    return pd.DataFrame({"doc_id": doc[at], "h": part["h"].to_numpy()[at], "a": (start[at] + a).astype(np.int32), "b": (start[at] + b + window - 1).astype(np.int32)})


def _inner(spans: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Whether a passage that is alone repeats some run of words within itself."""
    out = np.zeros(len(spans), bool)
    for i in np.flatnonzero(alone):
        words = spans[i].split(" ")
        if len(set(words)) < len(words) - RUN + 1:  # a repeated run repeats as many words
            out[i] = True
    return out


def _index_shard(window: int):
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        words = 0
        for batch in batches:  # sorted by minimiser: whole groups are indexed as soon as they are many
            if not len(batch):
                continue
            held.append(batch)
            words += int(batch["n"].sum()) + (window - 1) * len(batch)
            if words >= INDEX_WORDS:
                part = pd.concat(held, ignore_index=True)
                ready = part["anchor"] != part["anchor"].iloc[-1]
                if ready.any():
                    yield _shard_ranges(part[ready], window)
                held = [part[~ready]]
                words = int(held[0]["n"].sum()) + (window - 1) * len(held[0])
        if held:
            yield _shard_ranges(pd.concat(held, ignore_index=True), window)

    return kernel


def _split_equal(rows: DataFrame, scratch: Scratch, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``sid`` also stands at an earlier (doc_id, start), and one row for each earliest place."""
    # a table of its own, so that the join has two plain shuffles and Spark can split a hot key
    earliest = scratch.keep(rows.groupBy("sid").agg(F.min(F.struct("doc_id", "start")).alias("first")), f"{label}-first")
    marked = rows.join(earliest, "sid").withColumn("later", F.struct("doc_id", "start") > F.col("first")).drop("first")
    if "span" in rows.columns:
        marked = marked.withColumn("span", F.when(~F.col("later"), F.col("span")))
    marked = scratch.keep(marked, label)
    return marked.where("later"), marked.where("not later")


def repeated_ranges(docs: DataFrame, scratch: Scratch, window: int, most_places: int) -> DataFrame:
    """``doc_id, h, ranges``: the word ranges to remove from each row of ``doc_id, h, text``."""
    places = scratch.keep(minimisers(docs.select("doc_id", "text"), window), "places")
    twice = places.groupBy("anchor").count().where("count > 1").select("anchor", (F.col("count") > most_places).alias("hot"))
    twice = scratch.keep(twice, "twice")
    wanted = places.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    wanted = scratch.keep(wanted, "wanted")
    scratch.drop("places")
    scratch.release()
    spans = scratch.keep(passages(docs.join(wanted, "doc_id"), window), "spans")
    scratch.release()
    columns = ["anchor", "span", "doc_id", "h", "start", "n"]
    cold = spans.where("sid is null").select(*columns)
    whole = lambda df, n: df.select("doc_id", "h", F.col("start").alias("a"), (F.col("start") + n + window - 1).alias("b"))
    more = []
    if twice.where("hot").count():
        later, first = _split_equal(spans.where("sid is not null"), scratch, "equal")
        more.append(whole(later, F.col("n")))
        crowded = scratch.keep(first.groupBy("anchor").count().where(F.col("count") > most_places).select("anchor"), "crowded")
        cold = cold.unionByName(first.join(crowded, "anchor", "left_anti").select(*columns))
        cut = first.join(crowded, "anchor", "left_semi").withColumn("words", F.split("span", " ")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        cut = cut.select(F.unhex(F.md5(F.array_join(F.slice("words", F.col("i") + 1, F.lit(window)), " "))).alias("sid"), "doc_id", "h", (F.col("start") + F.col("i")).alias("start"))
        again, _ = _split_equal(cut, scratch, "windows")
        more.append(whole(again, F.lit(1)))
    ranges = cold.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_index_shard(window), "doc_id long, h long, a int, b int")
    for part in more:
        ranges = ranges.unionByName(part)
    ranges = scratch.keep(ranges.groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")
    scratch.drop("spans")
    scratch.release()
    return ranges


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, most_places: int = 3000, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` and the columns in ``keep`` for each row.

    ``kept_text`` is the kept words joined by one space.
    """
    scratch = Scratch(docs.sparkSession)
    if docs.schema[key].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        return _by_number(docs, key, scratch, text=text, window=window, most_places=most_places, keep=keep)
    keep = [c for c in keep or [] if c not in ("n_words", "n_removed", "kept_text")]
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("string").alias("text"))
    ranges = repeated_ranges(plain, scratch, window, most_places).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "ranges")
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.join(ranges, (F.col("doc_id") == F.col("__id")) & (F.col("h") == F.col("__h")), "left").drop("__id", "__h", "h")
    kept = [f.name for f in rows.schema if f.name.startswith("keep_")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name in kept)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, gone, texts = [], [], []
            for x, cuts in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = x.encode("utf-8", "replace").split() if x else []
                left, upto = [], 0
                for a, b in sorted((c["a"], c["b"]) for c in cuts or ()):
                    left += words[upto : max(a, upto)]
                    upto = max(upto, b)
                left += words[upto:]
                counts.append(len(words))
                gone.append(len(words) - len(left))
                texts.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], [*kept, "doc_id", "n_words", "n_removed", "kept_text"])

    out = map_arrow(rows, kernel, f"{schema}doc_id long, n_words long, n_removed long, kept_text string")
    return out.select("doc_id", *[F.col(f"keep_{c}").alias(c) for c in keep if c != "doc_id"], "n_words", "n_removed", "kept_text")


def _by_number(docs: DataFrame, key: str, scratch: Scratch, keep: list[str] | None, **options) -> DataFrame:
    """The same for ids of another type: in their order they get numbers."""
    ids = docs.select(F.col(key).alias("__id")).where("__id IS NOT NULL").distinct().withColumn("__one", F.lit(1))
    numbers = running_sum(ids, [F.col("__id").asc()], "__one", "__number", scratch, "ids").select("__id", F.col("__number").cast("long").alias("__number"))
    numbered = docs.join(numbers, F.col(key) == F.col("__id"), "left").withColumn("__id", F.col(key))
    keep = [c for c in keep or [] if c not in ("n_words", "n_removed", "kept_text", key)]
    found = remove_repeats(numbered, "__number", keep=[*keep, "__id"], **options)
    return found.select(F.col("__id").alias("doc_id"), *keep, "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with repeated passages taken out; a text that loses nothing stays as it is."""
    cleaned = remove_repeats(docs, keep=[c for c in docs.columns], **options)
    return cleaned.select(*[F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
places AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM places p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.i = p.i) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
