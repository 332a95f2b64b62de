"""Token counts of a piece vocabulary with byte fallback, by dynamic programming over prefixes.

For each prefix of a segment the table holds the one token that ends its encoding and
the number of tokens.  A token ends the encoding of a prefix if it stands after the
last token of what precedes it, that is if the two, merged together, stay as they are.
So the table has the exact count at every prefix, and tells without encoding anew how
much of a text fits a budget.

Segments start at runs of the space mark, and unknown control characters are segments
of their own: no piece reaches across either, so each segment is counted alone.

Edge cases: null and empty texts have 0 tokens; a character outside the vocabulary
counts one token for each of its UTF-8 bytes; very long texts are counted whole, segment by
segment, with one batch of some megabytes in memory; ties do not arise, as each prefix has one
last token; repeated rows are counted alike; an empty table gives no rows; only the named
columns are read, so others, whatever their names, are left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Recent, held_by_worker, map_arrow, rare_gc, slices

SPACE = "▁"
MOST_SEGMENTS = 250_000


class PrefixCounter:
    """Counts of every prefix, for the vocabulary of a piece model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.longest = max(map(len, self.scores))
        across = {c for piece in self.scores for c in piece}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.scores):
            raise ValueError("a piece reaches across a space")
        alone = "".join(c for c in "\n\t\r" if c not in across)
        self.find = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known = Recent(self._segment, MOST_SEGMENTS)

    def merged(self, text: str) -> list[str]:
        """The merges applied one by one; used for pairs of tokens only."""
        parts = list(text)
        while len(parts) > 1:
            best, at = max((self.scores.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1))
            if best == float("-inf"):
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def stands(self, last: str, token: str) -> bool:
        found = self.pairs.get((last, token))
        if found is None:
            if len(self.pairs) >= 4 * MOST_SEGMENTS:
                self.pairs.clear()
            found = self.pairs[last, token] = self.merged(last + token) == ([last, token] if last else [token])
        return found

    def _segment(self, text: str) -> tuple[int, ...]:
        """The number of tokens of each prefix of a segment, the empty one first."""
        counts, lasts = [0], [""]
        scores, longest, stands, pairs = self.scores, self.longest, self.stands, self.pairs
        for end in range(1, len(text) + 1):
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                token = text[start:end]
                known = pairs.get((lasts[start], token))
                if known or known is None and token in scores and stands(lasts[start], token):
                    counts.append(counts[start] + 1)
                    lasts.append(token)
                    break
            else:  # not in the vocabulary: bytes, which nothing merges with
                token = text[end - 1]
                counts.append(counts[-1] + len(token.encode("utf-8", "replace")))
                lasts.append(token)
        return tuple(counts)

    def segments(self, text: str) -> list[tuple[int, ...]]:
        return list(map(self.known.__getitem__, self.find(SPACE + text.replace(" ", SPACE)))) if text else []

    def count(self, text: str) -> int:
        return sum(x[-1] for x in self.segments(text))

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of ``text[:i]`` for each i from 0."""
        out, base = [], 0
        for counts in self.segments(text):
            out += (base + x for x in counts[1:])
            base += counts[-1]
        return [0, *out[1:]]  # the first character is the mark put before the text

    def fit(self, segments: list[tuple[int, ...]], budget: int) -> int:
        """Length of the longest prefix with at most ``budget`` tokens."""
        ends = [0, *accumulate(x[-1] for x in segments)]
        at = min(bisect_left(ends, budget), len(segments)) if ends[-1] > budget else len(segments)
        length = sum(len(x) - 1 for x in segments[:at])
        for i in range(at, -1, -1):
            if i < len(segments):
                for size in range(len(segments[i]) - 1, 0, -1):
                    if ends[i] + segments[i][size] <= budget:
                        return max(0, length + size - 1)
            if ends[i] <= budget or i == 0:
                return max(0, length - 1)
            length -= len(segments[i - 1]) - 1
        return 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    rare_gc()
    return PrefixCounter(path)


held_by_worker(counter.cache_clear)


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens``, ``over_limit``, and ``fit_chars``: characters of the longest prefix within ``limit``."""
    kept = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = kept.schema[0].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = counter(path)
        for batch in slices(batches, "__text", 1_000_000):
            sizes, tokens, fits = [], [], []
            for x in batch.column("__text").to_pylist():
                segments = one.segments(x or "")
                sizes.append(len(x.encode()) if x else 0)
                tokens.append(sum([s[-1] for s in segments]))
                fits.append(len(x or "") if tokens[-1] <= limit else one.fit(segments, limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(fits, pa.int64())], [key, "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return map_arrow(kept, kernel, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
