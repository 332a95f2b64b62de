"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed character
n-grams (1 to 4 bytes of lower-case letters) says how likely the bit is set.  A text
gets the language whose codeword has the least loss, where each bit's loss is weighted
by the classifier's accuracy in training.  The score is the best language's share
against the others by that loss; a small margin flags the text as ambiguous.

Training reads a sample of labelled rows, ``per_lang`` different texts of each language in
the order of a hash of the text, and fewer of each where all languages together would have
more than ``most_rows`` (200 MB on the driver); every language takes part.  Executors send
hashed counts, not texts.  All counts are taken over whole texts.

Edge cases: a text that is null, empty or without letters (by Unicode category) is ``und``
with score 0; with no labelled rows every text is ``und``; ties between languages go to
the smaller name; very long texts are one row of counts; repeated rows get equal answers
and count once in training; a null id is not held out; an empty table gives no rows;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from weftgraph.llm.common import hashed_part, map_arrow, release_held, slices

UNKNOWN = "und"
BUCKETS, BITS, ORDERS = 1 << 13, 15, 4
_MAYBE = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def has_letters(text: str) -> bool:
    """Whether some character is a letter; ``str.isalpha`` is the Unicode category, the pattern also takes other numbers."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


def grams(text: str) -> np.ndarray:
    """Bucket of each n-gram of a text's words in lower case, each word between spaces."""
    data = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out, value = [], np.zeros(len(data), np.uint32)
    for order in range(1, ORDERS + 1):
        value = value[: len(data) - order + 1] * np.uint32(257) + data[order - 1 :] + np.uint32(1)
        out.append((value * np.uint32(2654435769)) >> np.uint32(32 - 13))
    return np.concatenate(out)


def features(text: str) -> np.ndarray:
    """Square roots of n-gram counts, of length 1."""
    x = np.sqrt(np.bincount(grams(text), minlength=BUCKETS).astype(np.float32))
    return x / np.linalg.norm(x)


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """``n`` words of -1 and 1, chosen from random ones to lie far apart, every bit of which differs among them."""
    bits = max(bits, 4 * int(np.ceil(np.log2(max(n, 2)))))
    rng = np.random.default_rng(7)
    best, far = None, -1
    for _ in range(200 if n <= 64 else 3):
        words = np.where(rng.random((n, bits)) < 0.5, -1, 1)
        same = np.abs(words.sum(0)) == n
        words[0, same] *= -1
        gaps = (bits - words @ words.T) // 2 + np.eye(n, dtype=int) * bits
        if gaps.min() > far:
            best, far = words, gaps.min()
    return best


@dataclass
class Model:
    langs: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def predict(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        if not text or not self.langs or not has_letters(text):
            return UNKNOWN, 0.0, True
        bits = features(text) @ self.weights + self.bias
        loss = (self.trust * np.logaddexp(0, -self.words * bits)).sum(1)
        share = np.exp(-(loss - loss.min()))
        share /= share.sum()
        order = np.lexsort((np.arange(len(share)), -share))
        second = share[order[1]] if len(order) > 1 else 0.0
        return self.langs[order[0]], float(share[order[0]]), bool(share[order[0]] - second < margin)


NOTHING = Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", per_lang: int = 300, most_rows: int = 6000, rounds: int = 150) -> Model:
    """Fit on ``per_lang`` different texts of each language, ``most_rows`` in all, but 1 of each language at least."""
    rows = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    # a sketch of the different texts of each language: copies count once
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"))).collect()}
    if not sizes:
        return NOTHING
    per_lang = max(1, min(per_lang, most_rows // len(sizes)))
    # a hash threshold leaves a few times the sample, so the ranking meets few texts whatever the table's size
    spread = F.pmod(F.xxhash64(F.lit("lang"), "text"), F.lit(1 << 30))
    bounds = docs.sparkSession.createDataFrame([(k, int(min(1.0, 4 * per_lang / n) * (1 << 30))) for k, n in sizes.items()], StructType([rows.schema["lang"], StructField("bound", LongType())]))
    near = rows.withColumn("spread", spread).join(F.broadcast(bounds), "lang").where(F.col("spread") < F.col("bound"))  # a row for each language
    # copies have one hash and go before the ranking, summed up in each partition first
    different = near.groupBy("lang", "spread").agg(F.min("text").alias("text"))
    ranked = different.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("spread")))
    chosen = ranked.where(F.col("rank") <= per_lang).select("lang", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, at, value = [], [], []
            for name, x in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if has_letters(x):
                    v = features(x)
                    here = np.flatnonzero(v)
                    langs.append(name)
                    at.append(here.astype(np.int16))
                    value.append(v[here])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())], ["lang", "at", "value"])

    found = map_arrow(chosen, kernel, "lang string, at binary, value binary").toArrow().sort_by([("lang", "ascending"), ("value", "ascending")])
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return NOTHING
    x = np.zeros((len(names), BUCKETS), np.float32)
    for row, at, value in zip(x, found.column("at").to_pylist(), found.column("value").to_pylist(), strict=True):
        row[np.frombuffer(at, np.int16)] = np.frombuffer(value, np.float32)
    index = {name: i for i, name in enumerate(langs)}
    kind = np.array([index[n] for n in names])
    words = codewords(len(langs))
    y = words[kind].astype(np.float32)
    balance = 1.0 / np.bincount(kind)[kind]
    balance = (balance / balance.sum()).astype(np.float32)[:, None]
    weights, bias = np.zeros((BUCKETS, words.shape[1]), np.float32), np.zeros(words.shape[1], np.float32)
    rate = 60.0
    for _ in range(rounds):  # full-batch logistic regression
        pull = balance * y / (1 + np.exp(np.clip(y * (x @ weights + bias), -30, 30)))
        weights += rate * (x.T @ pull - 1e-5 * weights)
        bias += rate * 0.1 * pull.sum(0)
    right = (balance * (np.sign(x @ weights + bias) == y)).sum(0)
    right = np.clip(right, 0.5, 1 - 1 / (2 * len(names)))
    trust = np.log(right / (1 - right))
    return Model(langs, words, weights, bias, np.maximum(trust, 1e-3) / max(trust.max(), 1e-3))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", margin: float = 0.1) -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and ``ambiguous`` for each row."""
    kept = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = kept.schema[0].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = [model.predict(x, margin) for x in batch.column("__text").to_pylist()]
            langs, scores, doubt = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())], [key, "lang_pred", "score", "ambiguous"])

    return map_arrow(kept, kernel, f"`{key}` {kind}, lang_pred string, score double, ambiguous boolean")


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return hashed_part(key, folds, fold)


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """The rows whose language is known, with their own columns; one pass over the texts.

    A row goes when it has no letters or is ambiguous.
    """
    model = fit(docs, ~held_out(), **options)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_held()
        for batch in slices(batches):
            keep = [not model.predict(x, 0.1)[2] for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, kernel, docs.schema)
