"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is the mean vector of its hashed character n-grams and, if enough training
texts hold it, a vector of its own, which half of the training steps leave out, so that
n-grams learn to speak for words never seen.  Two gated recurrent layers read a window of
words from both ends, attention pools their states, and a logistic unit scores the window.
Windows overlap and cover the whole text; a text's score is that of its worst window,
calibrated on training texts that were set apart.

Training runs in numpy on the driver.  It reads at most ``most_texts`` toxic
and three times as many clean rows, in the order of a hash, and all windows of each; where
the windows of a label would be more than ``most_windows``, rows at the end of that order
are left out whole.  After the first passes only the worst windows of a toxic text count as
toxic.

Edge cases: a null, empty or wordless text has score 0; very long texts are scored window
by window, in blocks; of equally bad windows any gives the score; repeated rows get equal scores; with labels of one kind only, or
none, every score is that kind's (0 if there is none); rows with more than one label count
once for each; a null id is not held out; an empty table gives no rows; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weftgraph.llm.common import hashed_part, map_arrow, slices

WORDS, STRIDE = 32, 24
SIZE, HIDDEN = 8, 8
GRAM_BITS, ORDERS = 15, (3, 4, 6)
#: Words with vectors of their own at most, and the training texts each must be in; any word has its n-grams.
MOST_VECTORS, LEAST_TEXTS = 30_000, 4
#: Chance that a word's own vector takes part in a training step; else its n-grams speak for it alone.
KEEP = 0.5
#: Passes over the training windows at most.
MOST_PASSES = 80
#: Training pace of vectors against the layers, and the squares that their paces start from.
PACE, START = 3.0, 1e-5
#: Weight of a clean text in the calibration: the sample holds fewer of them than a corpus.
CLEAN_WEIGHT = 2
#: Texts that the network's own probability counts for in the calibration.
OWN_TEXTS = 4.0


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the character n-grams of ``^word$``; a word with none has its whole."""
    data = "".join(f"^{w}$" for w in words).encode("utf-8", "replace")
    sizes = np.array([len(w.encode("utf-8", "replace")) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    data = np.frombuffer(data, np.uint8).astype(np.uint32)
    owners, buckets = [], []
    for order in ORDERS:
        if len(data) < order:
            continue
        n = len(data) - order + 1
        value = np.full(n, order, np.uint32)
        for k in range(order):
            value = value * np.uint32(16777619) ^ data[k : n + k]
        inside = word[:n] == word[order - 1 :]
        owners.append(word[:n][inside])
        buckets.append(((value * np.uint32(2654435769)) >> np.uint32(32 - GRAM_BITS))[inside].astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def window_starts(n: int) -> list[int]:
    """Starts of the windows over ``n`` words; the last one ends with the text."""
    if n <= WORDS:
        return [0]
    return [*range(0, n - WORDS, STRIDE), n - WORDS]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Tables, both layers (index 0 forward, 1 backward), attention and output."""

    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]  # row 0 is for all other words
    scale: tuple[float, float] = (1.0, 0.0)

    @staticmethod
    def fresh(vocabulary: dict[str, int], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        r = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
        p = {"word": np.zeros((len(vocabulary) + 1, SIZE), np.float32), "gram": r(1 << GRAM_BITS, SIZE, by=0.05), "att": r(2 * HIDDEN, 8), "att_v": r(8), "out": r(2 * HIDDEN), "out_b": np.zeros(1, np.float32)}
        for d in "01":
            p |= {f"in{d}": r(SIZE, 3 * HIDDEN, by=0.5), f"in_b{d}": np.zeros(3 * HIDDEN, np.float32), f"rec{d}": r(HIDDEN, 3 * HIDDEN)}
        return Network(p, vocabulary)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Vector of each word."""
        owner, bucket = gram_buckets(words)
        order = np.argsort(owner, kind="stable")
        sums = np.add.reduceat(self.p["gram"][bucket[order]], np.searchsorted(owner[order], np.arange(len(words))))
        return self.p["word"][[self.vocabulary.get(w, 0) for w in words]] + sums / np.bincount(owner, minlength=len(words))[:, None].astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the words add to the gates of both layers."""
        return np.concatenate([x @ self.p["in0"] + self.p["in_b0"], x @ self.p["in1"] + self.p["in_b1"]], axis=1).astype(np.float32)

    def forward(self, gates: np.ndarray, mask: np.ndarray | None, tape: list | None = None) -> np.ndarray:
        """Window logits from ``gates`` (steps, windows, 6 HIDDEN); ``mask`` (steps, windows) is None if all are full."""
        steps, n, _ = gates.shape
        both = np.empty((steps, n, 2 * HIDDEN), np.float32)
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            h, rec = np.zeros((n, HIDDEN), np.float32), self.p[f"rec{d}"]
            for t in order:
                g = gates[t, :, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
                u = h @ rec
                zr = _sigmoid(g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                un = u[:, 2 * HIDDEN :]
                new = np.tanh(g[:, 2 * HIDDEN :] + r * un)
                after = new + z * (h - new)
                if mask is not None:
                    after = np.where(mask[t][:, None], after, h)
                if tape is not None:
                    tape.append((d, t, h, z, r, un, new))
                h = after
                both[t, :, HIDDEN * d : HIDDEN * (d + 1)] = h
        hidden = np.tanh(both @ self.p["att"])
        score = hidden @ self.p["att_v"]
        if mask is not None:
            score = np.where(mask, score, -1e9)
        score = np.exp(score - score.max(0))
        alpha = score / score.sum(0)
        pooled = (alpha[:, :, None] * both).sum(0)
        if tape is not None:
            tape.append((both, hidden, alpha, pooled))
        return pooled @ self.p["out"] + self.p["out_b"][0]

    def backward(self, gates: np.ndarray, mask: np.ndarray, tape: list, pull: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense parameters, and of ``gates``; ``pull`` is the logits' gradient."""
        p, grad = self.p, {}
        both, hidden, alpha, pooled = tape.pop()
        grad["out"], grad["out_b"] = pooled.T @ pull, pull.sum(keepdims=True)
        d_pooled = pull[:, None] * p["out"]
        d_both = alpha[:, :, None] * d_pooled
        d_alpha = (both * d_pooled).sum(2)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        grad["att_v"] = np.einsum("tn,tnk->k", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden**2)
        grad["att"] = np.einsum("tnh,tnk->hk", both, d_hidden)
        d_both = d_both + d_hidden @ p["att"].T
        d_gates = np.zeros_like(gates)
        for d in (1, 0):
            rec = p[f"rec{d}"]
            d_rec, d_h = np.zeros_like(rec), np.zeros((gates.shape[1], HIDDEN), np.float32)
            while tape and tape[-1][0] == d:
                _, t, h, z, r, un, new = tape.pop()
                total = d_h + d_both[t, :, HIDDEN * d : HIDDEN * (d + 1)]
                live = mask[t][:, None]
                d_after = np.where(live, total, 0)
                d_new = d_after * (1 - z) * (1 - new**2)
                d_z = d_after * (h - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                g = np.concatenate([d_z, d_r, d_new], axis=1)
                d_gates[t, :, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)] = g
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_rec += h.T @ d_u
                d_h = d_u @ rec.T + d_after * z + np.where(live, 0, total)
            grad[f"rec{d}"] = d_rec
        return grad, d_gates

    def probability(self, logit: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return _sigmoid(a * logit + b)


class Scorer:
    """Scores whole texts; projected words are kept in a bounded table."""

    MOST = 150_000

    def __init__(self, network: Network):
        self.network = network
        self.rows = np.zeros((0, 6 * HIDDEN), np.float32)
        self.at: dict[str, int] = {}

    def _look_up(self, words: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.at))
        if len(self.at) + len(new) > self.MOST:
            self.at.clear()
            self.rows = self.rows[:0]
            new = list(dict.fromkeys(words))
        if new:
            self.at |= zip(new, range(len(self.at), len(self.at) + len(new)), strict=True)
            parts = [self.network.project(self.network.inputs(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
            self.rows = np.concatenate([self.rows, *parts])
        return np.fromiter(map(self.at.__getitem__, words), np.int32, len(words))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf, np.float32)
        split = [words_of(x) for x in texts]
        index = self._look_up([w for x in split for w in x])
        begin, full, short = 0, [], []
        for at, x in enumerate(split):
            if len(x) >= WORDS:
                full += [(at, begin + s) for s in window_starts(len(x))]
            elif x:
                short.append((at, begin, len(x)))
            begin += len(x)
        steps = np.arange(WORDS)[:, None]
        for i in range(0, len(full), 2048):
            owner, start = np.array(full[i : i + 2048]).T
            np.maximum.at(out, owner, self.network.forward(self.rows[index[start + steps]], None))
        for i in range(0, len(short), 2048):
            owner, start, size = np.array(short[i : i + 2048]).T
            mask = steps < size
            np.maximum.at(out, owner, self.network.forward(self.rows[index[np.where(mask, start + steps, start)]], mask))
        blank = float(self.network.scale[0] == 0 and self.network.scale[1] > 0)  # all labels were 1
        return np.where(np.isneginf(out), blank, self.network.probability(np.where(np.isneginf(out), 0, out).astype(np.float64)))


def sample(docs: DataFrame, labels: DataFrame, train: Column, label: str, most_texts: int, most_windows: int) -> pa.Table:
    """(text number, label, words) of the windows to train on."""
    known = labels.where(train & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    spread = F.pmod(F.xxhash64(F.lit("tox"), "doc_id"), F.lit(1 << 30))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    few: list[tuple] = []
    for kind, most in ((0, 3 * most_texts), (1, most_texts)):
        # a hash threshold leaves a few times the sample, so that few rows are ordered whatever the table's size
        chance = min(1.0, 3 * most / max(1, sizes.get(kind, 1)))
        near = known.where(F.col("label") == kind).withColumn("spread", spread).where(F.col("spread") < chance * (1 << 30))
        few += [(r["doc_id"], kind, rank) for rank, r in enumerate(near.orderBy("spread", "doc_id").limit(most).collect(), 1)]
    schema = StructType([known.schema["doc_id"], StructField("label", IntegerType()), StructField("rank", IntegerType())])
    # 4 * most_texts rows at most, so they can be sent to all texts
    ids = F.broadcast(docs.sparkSession.createDataFrame(few, schema))
    chosen = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id").select("label", "rank", "text")

    # whole rows, the first in order, as far as the driver's memory goes
    words = F.size(F.split(F.trim("text"), r"\s+"))
    windows = chosen.groupBy("label", "rank").agg(F.sum(F.greatest(F.lit(1), F.ceil((words - WORDS) / STRIDE) + 1)).alias("n")).collect()
    last, spent = {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in sorted(windows):
        spent[r["label"]] += r["n"]
        if spent[r["label"]] <= most_windows or not last[r["label"]]:
            last[r["label"]] = r["rank"]
    chosen = chosen.where(F.col("rank") <= F.when(F.col("label") == 1, last[1]).otherwise(last[0]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for y, rank, text in zip(*(batch.column(c).to_pylist() for c in ("label", "rank", "text")), strict=True):
                words = words_of(text)
                if words:
                    out += ((rank, y, " ".join(words[s : s + WORDS])) for s in window_starts(len(words)))
            ranks, ys, texts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int32()), pa.array(ys, pa.int32()), pa.array(texts, pa.string())], ["rank", "label", "words"])

    return map_arrow(chosen, kernel, "rank int, label int, words string").toArrow().sort_by([("label", "ascending"), ("rank", "ascending"), ("words", "ascending")])


def _sum_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places of ``rows``, in order, and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[starts], np.add.reduceat(rows[order], starts)


def train(table: pa.Table, visits: int = 150_000, batch: int = 512, rate: float = 0.01, seed: int = 5) -> Network:
    """Train until windows were seen about ``visits`` times in all, in five passes or more."""
    rank, y = table.column("rank").to_numpy(), table.column("label").to_numpy()
    if not len(y) or y.min() == y.max():
        return Network(Network.fresh({}, seed).p, {}, (0.0, 60.0 if len(y) and y[0] else -60.0))
    ids: dict[str, int] = {}
    tokens = np.zeros((WORDS, len(y)), np.int32)
    mask = np.zeros((WORDS, len(y)), bool)
    for i, window in enumerate(table.column("words").to_pylist()):
        x = window.split(" ")
        tokens[: len(x), i] = [ids.setdefault(w, len(ids)) for w in x]
        mask[: len(x), i] = True
    words = list(ids)
    owner, grams = gram_buckets(words)
    order = np.argsort(owner, kind="stable")
    owner, grams = owner[order], grams[order]
    count = np.bincount(owner, minlength=len(words)).astype(np.float32)
    begins = np.searchsorted(owner, np.arange(len(words) + 1))
    doc = rank.astype(np.int64) * 2 + y
    # words of several texts have a vector of their own beside that of their n-grams
    pairs = np.unique(doc[np.nonzero(mask.T)[0]] << 32 | tokens.T[mask.T])
    docs = np.unique(doc)
    texts_with = np.bincount(pairs & 0xFFFFFFFF, minlength=len(words))
    usual = sorted(np.flatnonzero(texts_with >= LEAST_TEXTS).tolist(), key=lambda i: (-texts_with[i], words[i]))[:MOST_VECTORS]
    network = Network.fresh({words[i]: row for row, i in enumerate(usual, 1)}, seed)
    p = network.p
    bucket = np.array([network.vocabulary.get(w, 0) for w in words])

    dense = [k for k in p if k not in ("word", "gram")]
    moment = {k: (np.zeros_like(p[k]), np.zeros_like(p[k])) for k in dense}
    squares = {k: np.full(len(p[k]), START, np.float32) for k in ("word", "gram")}
    rng = np.random.default_rng(seed)
    learn = rank % 5 != 0  # every fifth text is for the calibration alone
    use, turn = np.flatnonzero(learn), 0

    def vectors(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(begins)[of]
        at = np.repeat(begins[of] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        near = np.repeat(np.arange(len(of)), n)
        sums = np.add.reduceat(p["gram"][grams[at]], np.append(0, np.cumsum(n)[:-1]))
        return p["word"][bucket[of]] + sums / count[of][:, None], at, near

    def logits() -> np.ndarray:
        gates = network.project(np.concatenate([vectors(np.arange(i, min(i + 20_000, len(words))))[0] for i in range(0, len(words), 20_000)]))
        return np.concatenate([network.forward(gates[tokens[:, i : i + 2048]], mask[:, i : i + 2048]) for i in range(0, len(y), 2048)])

    batch = min(batch, max(256, len(y) // 64))
    passes = min(MOST_PASSES, max(5, visits // len(y)))
    for done in range(passes):
        if done >= 2 * passes // 5:  # only the worst windows of a toxic text count as toxic, and those of a clean one most
            now = logits()
            best = np.full(int(doc.max()) + 1, -np.inf)
            np.maximum.at(best, doc, now)
            use = np.flatnonzero(np.where(y == 1, now >= np.minimum(best[doc], 2.0), (now > -3) | (now >= best[doc]) | (rng.random(len(y)) < 0.2)) & learn)
        heavy = np.where(y == 1, (y[use] == 0).sum() / max(1, (y[use] == 1).sum()) / 2, 1.0).clip(0.5, 4)
        for start in range(0, len(use), batch):
            if start == 0:
                rng.shuffle(use)
            pick = use[start : start + batch]
            seen, place = np.unique(tokens[:, pick], return_inverse=True)
            x, at, near = vectors(seen)
            whole = rng.random(len(seen)) < KEEP  # the others are known by their n-grams alone in this step
            x -= np.where(whole, 0, 1)[:, None] * p["word"][bucket[seen]]
            gates = network.project(x)[place.reshape(WORDS, -1)]
            tape: list = []
            logit = network.forward(gates, mask[:, pick], tape)
            pull = ((_sigmoid(logit) - y[pick]) * heavy[pick] / len(pick)).astype(np.float32)
            grad, d_gates = network.backward(gates, mask[:, pick], tape, pull)
            flat = _sum_rows(place.reshape(-1), d_gates.reshape(-1, 6 * HIDDEN))[1]  # each word has a place
            d_x = flat[:, : 3 * HIDDEN] @ p["in0"].T + flat[:, 3 * HIDDEN :] @ p["in1"].T
            for d in (0, 1):
                part = flat[:, 3 * HIDDEN * d : 3 * HIDDEN * (d + 1)]
                grad[f"in{d}"], grad[f"in_b{d}"] = x.T @ part, part.sum(0)
            turn += 1
            for k in dense:
                m, v = moment[k]
                m += 0.1 * (grad[k] - m)
                v += 0.001 * (grad[k] ** 2 - v)
                p[k] -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-7)
            for k, row, g in (("word", bucket[seen][whole], d_x[whole]), ("gram", grams[at], (d_x / count[seen][:, None])[near])):
                if not len(row):
                    continue
                rows, total = _sum_rows(row, g)
                squares[k][rows] += (total**2).mean(1)
                p[k][rows] -= PACE * rate * total / np.sqrt(squares[k][rows])[:, None]
            p["word"][0] = 0
    worst = np.full(int(doc.max()) + 1, -np.inf)
    np.maximum.at(worst, doc, logits())
    apart = docs[docs // 2 % 5 == 0]
    apart = apart if len(set((apart % 2).tolist())) == 2 else docs
    network.scale = _calibrated(worst[apart], apart % 2)
    return network


def _calibrated(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make probabilities of the texts' worst windows, by Newton's method.

    Few texts hardly move the network's own logit, which counts as ``OWN_TEXTS`` texts.
    """
    weight = np.where(y == 1, 1, CLEAN_WEIGHT) / np.where(y == 1, 1, CLEAN_WEIGHT).sum()
    middle, spread = float(logit.mean()), float(logit.std()) or 1.0
    x = np.stack([(logit - middle) / spread, np.ones(len(y))])
    own = np.array([spread, middle])  # the network's own logit
    beta = own.copy()
    ridge = OWN_TEXTS / len(y)
    for _ in range(50):
        q = _sigmoid(beta @ x)
        slope = x @ (weight * (q - y)) + ridge * (beta - own)
        bend = (x * weight * q * (1 - q)) @ x.T + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    a, b = beta
    return a / spread, b - a * middle / spread


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return hashed_part(key, folds, fold)


def fit(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "toxic", most_texts: int = 500, most_windows: int = 200_000) -> Network:
    return train(sample(docs, labels, train_rows, label, most_texts, most_windows))


def score(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` for each row."""
    kept = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = kept.schema[0].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in slices(batches, "__text", 1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column("__text").to_pylist()), pa.float64())], [key, "score"])

    return map_arrow(kept, kernel, f"`{key}` {kind}, score double")
