"""Phrase collocation mining: phrases of several words that stand together more than their parts.

Texts are cut into pieces at punctuation and line ends, and pieces into words.  A shard is some
``SHARD_WORDS`` words of one task; in it the words of a language have ids, and the suffixes of all
pieces are sorted by prefix doubling in numpy: by one word, then two, then four.  Neighbours'
common prefixes (LCP) part the sorted suffixes into intervals, one for each n-gram, whose
lengths are its counts.  Counts of all shards are merged by key.

Most n-grams stand in a text or two, and their merge would be many times the texts.  So it goes
in three rounds over the texts, and an n-gram is only sent on if both its (n-1)-grams may be
frequent:

1. pairs of words, by 64-bit hash and count;
2. triples whose pairs are frequent, by hash;
3. all words, and the pairs, triples and quadruples left, by their words.

What is frequent is kept between rounds as bits by hash, 16 MB at any size (``SLOTS``).  Hashes
that meet only let more through; counts and phrases of the last round are exact.

Each phrase is cut in two at its best place, both parts' counts come by joins, phrases that a
longer one holds nearly always are dropped, and the first of each language are found by ranks
over range partitions, so neither a hot language nor a hot word is one task's work.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count
each; very long texts are whole, in one shard; ties in score go by count and then by the bytes
of the phrase; a language without frequent phrases, or an empty table, gives no rows; other
columns, whatever their names, are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import heavy_join, map_arrow, slices
from weftgraph.plans.ordered import ranks_within
from weftgraph.plans.scratch import Scratch

#: Words of a shard, words of a phrase, and bits that say what is frequent.
SHARD_WORDS, LONGEST, SLOTS = 1 << 20, 4, 1 << 27
#: A-Z to lower case, tabs to spaces, and what ends a piece to a line end.
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + b"\t.,;:!?\x0b\x0c\r", string.ascii_lowercase.encode() + b" " + b"\n" * 9)


class Words(dict):
    """Ids of words in the order of their first use; 0 is nothing, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at

    def of(self, text: str | None) -> np.ndarray:
        """The text's word ids, with a piece's end at the end."""
        found = (text or "").encode("utf-8", "replace").translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, found), np.int32, len(found))
        return np.append(ids[ids > 0], np.int32(1))


class Shard:
    """The suffixes of a shard's pieces, sorted by their first ``depth`` words."""

    def __init__(self, ids: np.ndarray, depth: int):
        word = ids > 1
        at = np.flatnonzero(word)
        # the word k places on in the same piece, or -1
        padded = np.append(np.where(word, ids, -1), np.full(depth, -1, np.int32)).astype(np.int64)
        own = [padded[at]]
        for k in range(1, depth):
            own.append(np.where(own[-1] < 0, -1, padded[at + k]))
        # ranks by one word are the ids; each round doubles the prefix that ranks stand for
        rank, width = padded.copy(), 1
        while width < depth:
            ahead = np.append(rank[width:], np.full(width, -1))
            # a prefix that ends in its piece is shorter than the others: its rank holds no more words
            key = rank[at] * (int(rank.max(initial=0)) + 2) + np.where(own[width - 1] < 0, -1, ahead[at]) + 1
            width *= 2
            order = np.argsort(key, kind="stable")
            new = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
            rank = np.full(len(padded), -1)
            rank[at[order]] = np.cumsum(new) - 1
        self.words = [w[order] for w in own]
        # words that a suffix has in common with the one before
        self.lcp = np.zeros(len(order), np.int8)
        alike = np.ones(max(0, len(order) - 1), bool)
        for w in self.words:
            alike &= (w[1:] == w[:-1]) & (w[1:] >= 0)
            self.lcp[1:] += alike

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first suffix of each interval of common prefixes of ``n`` words, and the intervals' sizes."""
        starts = np.flatnonzero(self.lcp < n)
        sizes = np.diff(np.append(starts, len(self.lcp)))
        whole = self.words[n - 1][starts] >= 0
        return starts[whole], sizes[whole]


def mixed(seed: np.ndarray | np.uint64, word: np.ndarray) -> np.ndarray:
    """A hash of what is hashed before and one word more."""
    with np.errstate(over="ignore"):
        x = (seed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _hashes(shard: Shard, rows: np.ndarray, names: np.ndarray, lang: np.uint64, start: int, n: int) -> np.ndarray:
    """Hashes of the ``n`` words of some suffixes from their word ``start`` on."""
    found = np.full(len(rows), lang)
    for k in range(start, start + n):
        found = mixed(found, names[shard.words[k][rows]])
    return found


class Frequent:
    """Which hashes may be frequent: a bit for each."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.bits = np.zeros(SLOTS // 8, np.uint8)
        for bucket, bits in rows:
            self.bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes & np.uint64(SLOTS - 1)
        return (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def frequent_bits(counts: DataFrame, least: int) -> list[tuple[int, bytes]]:
    """Bits of the hashes that stand for ``least`` or more, in 4,096 rows of as many bytes at most."""
    often = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slot = F.col("hash").bitwiseAND(F.lit(SLOTS - 1)) + 1
    rows = often.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    return [(r["bucket"], bytes(r["bits"])) for r in rows.collect()]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, dict[str, np.ndarray]]]:
    """Words and the ids of each language, some ``SHARD_WORDS`` words at a time."""
    words, found, size = Words(), {}, 0
    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = words.of(text)
            found.setdefault(lang, []).append(ids)
            size += len(ids)
            if size >= SHARD_WORDS:
                yield words, {k: np.concatenate(v) for k, v in found.items()}
                words, found, size = Words(), {}, 0
    if found:
        yield words, {k: np.concatenate(v) for k, v in found.items()}


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")))


def _names(words: Words) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def hashed_grams(n: int, before):
    """Kernel over ``lang, text``: ``hash, n`` of the n-grams of each shard whose (n-1)-grams are in ``before``, a broadcast, if there is one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(before.value) if before is not None else None
        for words, found in shards(batches):
            names = _names(words)
            for lang, ids in found.items():
                shard, seed = Shard(ids, n), _seed(lang)
                rows, sizes = shard.grams(n)
                if known:
                    keep = known(_hashes(shard, rows, names, seed, 0, n - 1)) & known(_hashes(shard, rows, names, seed, 1, n - 1))
                    rows, sizes = rows[keep], sizes[keep]
                hashes = _hashes(shard, rows, names, seed, 0, n)
                for at in range(0, len(rows), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[at : at + (1 << 17)].view(np.int64)), pa.array(sizes[at : at + (1 << 17)], pa.int64())], ["hash", "n"])

    return kernel


def spelled_grams(pairs, triples):
    """Kernel over ``lang, text``: ``lang, size, phrase, n`` of the words of each shard and the longer phrases that may be frequent."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = Frequent(pairs.value), Frequent(triples.value)
        for words, found in shards(batches):
            names, spelled = _names(words), pa.array(list(words), pa.binary()).cast(pa.string())
            for lang, ids in found.items():
                shard, seed = Shard(ids, LONGEST), _seed(lang)
                for n in range(1, LONGEST + 1):
                    rows, sizes = shard.grams(n)
                    hashed = lambda start, m: _hashes(shard, rows, names, seed, start, m)  # noqa: B023, E731
                    if n == 2:
                        keep = two(hashed(0, 2))
                    elif n == 3:
                        keep = three(hashed(0, 3)) & two(hashed(0, 2)) & two(hashed(1, 2))
                    else:
                        keep = np.ones(len(rows), bool) if n == 1 else three(hashed(0, 3)) & three(hashed(1, 3))
                    rows, sizes = rows[keep], sizes[keep]
                    for at in range(0, len(rows), 1 << 16):
                        some = rows[at : at + (1 << 16)]
                        parts = [spelled.take(pa.array(shard.words[k][some])) for k in range(n)]
                        phrase = parts[0] if n == 1 else pa.compute.binary_join_element_wise(*parts, " ")
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(np.full(len(some), n, np.int32)), phrase, pa.array(sizes[at : at + (1 << 16)], pa.int64())], ["lang", "size", "phrase", "n"])

    return kernel


def gram_counts(docs: DataFrame, text: str, lang: str, least: int) -> DataFrame:
    """``lang, size, phrase, f``: all words, and the phrases of up to ``LONGEST`` words that stand ``least`` times or more."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    pairs = context.broadcast(frequent_bits(map_arrow(rows, hashed_grams(2, None), "hash long, n long"), least))  # 16 MB at most, as below
    triples = context.broadcast(frequent_bits(map_arrow(rows, hashed_grams(3, pairs), "hash long, n long"), least))
    spelled = map_arrow(rows, spelled_grams(pairs, triples), "lang string, size int, phrase string, n long")
    return spelled.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where((F.col("size") == 1) | (F.col("f") >= least))


def _span(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of each phrase of two words or more, cut where the score is least."""
    cuts = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = scratch.keep(cuts.select("lang", "phrase", "size", "a", "k", _span("words", F.lit(1), F.col("k")).alias("first"), _span("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")), "cuts")
    parts = counts.where(F.col("size") < LONGEST)
    # counts of words, pairs and triples each sum up to all words at most
    total = 3 * (counts.where("size = 1").agg(F.sum("f")).first()[0] or 0)
    left = scratch.keep(heavy_join(cuts, parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], "l", total), "left")
    both = heavy_join(left, parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "r", total)
    # decimals: the product may pass 64 bits
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV CAST(l + r AS DECIMAL(20, 0))")
    least = both.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def not_inside(counts: DataFrame, share: int) -> DataFrame:
    """``lang, phrase`` of the phrases that a longer one holds in ``share`` hundredths of their places or more."""
    words = F.split("phrase", " ", -1)
    longer = counts.where("size > 2").select("lang", F.col("f").alias("longer"), "size", words.alias("words"))
    spans = longer.select("lang", "longer", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    spans = spans.select("lang", "longer", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inner = spans.groupBy("lang", _span("words", F.col("at"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    return counts.where("size > 1").join(inner, ["lang", "phrase"]).where(100 * F.col("longer") >= share * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: int = 80, most: int = 2000) -> DataFrame:
    """``lang, rank`` (from 1) ``, phrase, a, l, r, n, score`` of the ``most`` best phrases of each language.

    ``a``, ``l`` and ``r`` count the phrase and its two parts, ``n`` all words of the language;
    the score is ``a`` in millionths of the mean of ``l`` and ``r``, rounded down.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.keep(gram_counts(docs, text, lang, least), "counts")
    words = counts.where("size = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    often = scratch.keep(counts.where(F.col("f") >= least), "often")
    left = scored(often, scratch).join(not_inside(often, share), ["lang", "phrase"], "left_anti")
    ranked = ranks_within(left.drop("size"), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], scratch, "ranked")
    best = ranked.where(F.col("rank") <= most)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, m AS size, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(m) WHERE len(ws) >= m)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30),
often AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, f FROM f WHERE f >= 30),
cut AS MATERIALIZED (
  SELECT lang, size, phrase, a, k, lang || chr(10) || array_to_string(ws[1:k], ' ') AS first, lang || chr(10) || array_to_string(ws[k + 1:size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
lefts AS MATERIALIZED (SELECT cut.*, x.f AS l FROM cut JOIN often x ON x.key = cut.first),
cuts AS (SELECT lang, size, phrase, a, k, l, y.f AS r, (2000000::HUGEINT * a) // (l + y.f) AS score FROM lefts JOIN often y ON y.key = lefts.rest),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
spans AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2))),
inside AS (SELECT lang, phrase, max(a) AS longer FROM spans GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
