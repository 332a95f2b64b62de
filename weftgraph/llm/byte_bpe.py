"""Byte-level BPE encoding and decoding.

The merges are compiled into a finite-state transducer that reads a piece byte by
byte.  A state is the set of all open tokens: the trie nodes reached from each place
where a token may still be growing.  States and moves come from a subset construction
that is carried out only where a text leads, and are kept.  A move lists the tokens
that end with its byte; a register holds the last token of each recent place.  A token
is emitted as soon as the ways back from all open places agree on it, which the
longest token bounds; a piece's end closes all open tokens.

Which token ends at a place is decided by pairs alone: a sequence of tokens is what
the merges give if and only if each two neighbours, encoded together, stay as they
are.  So each place has exactly one last token.

Decoding joins the tokens' bytes; a UTF-8 state machine holds back the bytes of a
character that is not complete yet.

Edge cases: a null or empty text has no tokens and decodes to no bytes; very long texts are
encoded piece by piece, with a register of ``REGISTER`` places; ties do not arise, as each place
has one last token; repeated rows are encoded alike; an empty table gives no rows; columns besides the text are passed on, and names that clash with the new
columns are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Recent, held_by_worker, map_arrow, rare_gc, slices

#: Kept moves, tested pairs and cached pieces in a Python worker; beyond that they start anew.
MOST_MOVES, MOST_PAIRS, MOST_PIECES = 1_000_000, 1_000_000, 200_000
#: Places in the register before sure tokens are emitted.
REGISTER = 1024


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Transducer:
    """The merges of ``ranks`` as a lazily determinised transducer over bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        self.depth = [0]
        nodes = 0
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = node << 8 | byte
                node = self.trie.get(step, 0)
                if not node:
                    nodes += 1
                    self.depth.append(self.depth[step >> 8] + 1)
                    node = self.trie[step] = nodes
            self.ends[node] = rank
        self.inner = {step >> 8 for step in self.trie}
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = [(0,)]
        self.known: dict[tuple[int, ...], int] = {(0,): 0}
        self.moves: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.made:
            data = self.bytes_of[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
                if best >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.made[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else () if len(parts) > 2 else None
        return self.made[token]

    def stands(self, last: int, token: int) -> bool:
        """Whether ``token`` may follow ``last`` (-1: may begin a piece).

        Merges are undone, the latest first, on the two parts that touch: they would
        have been merged with each other if their joint rank comes before that of
        the merge that took one of them away from the seam.
        """
        found = self.pairs.get(last << 32 | token)
        if found is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            found = self.pairs[last << 32 | token] = self.halves(token) != () and (last < 0 or self._apart(last, token))
        return found

    def _apart(self, left: int, right: int) -> bool:
        ranks, data = self.ranks, self.bytes_of
        gone_left = gone_right = 1 << 62  # when each part is taken up by its own side
        while True:
            joint = ranks.get(data[left] + data[right], 1 << 62)
            # on equal ranks the merge further left comes first
            if joint < gone_left and joint <= gone_right:
                return False
            up, down = self.halves(left), self.halves(right)
            if up and (not down or left >= right):
                left, gone_left = up[1], left
            elif down:
                right, gone_right = down[0], right
            else:
                return True

    def _move(self, at: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The next state, and (length, token) of each token that ends with ``byte``."""
        nodes, ends = [], []
        for node in self.states[at]:
            child = self.trie.get(node << 8 | byte)
            if child is not None:
                if child in self.inner:  # a leaf can't grow
                    nodes.append(child)
                if child in self.ends:
                    token = self.ends[child]
                    ends.append((self.lengths[token], token))
        nodes = (*nodes, 0)
        found = self.known.get(nodes)
        if found is None:
            found = self.known[nodes] = len(self.states)
            self.states.append(nodes)
        return found, tuple(ends)

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) > MOST_MOVES:
            self._forget()
        out: list[int] = []
        register, at, moves, pairs = [-1], 0, self.moves, self.pairs
        for byte in piece:
            move = moves.get(at << 8 | byte)
            if move is None:
                move = moves[at << 8 | byte] = self._move(at, byte)
            at, ends = move
            for length, token in ends:
                last = register[-length]
                known = pairs.get(last << 32 | token)
                if known or known is None and self.stands(last, token):
                    register.append(token)
                    break
            else:
                raise ValueError(f"no token ends with byte {byte}: the vocabulary lacks single bytes")
            if len(register) > REGISTER:
                register = self._emit(at, register, out)
        place, lengths, left = len(register) - 1, self.lengths, []
        while place:
            token = register[place]
            left.append(token)
            place -= lengths[token]
        left.reverse()
        return out + left if out else left

    def _back(self, register: list[int], place: int) -> list[int]:
        """The tokens that end at ``place``, back to the register's first place."""
        out = []
        while place:
            out.append(register[place])
            place -= self.lengths[register[place]]
        return out[::-1]

    def _emit(self, at: int, register: list[int], out: list[int]) -> list[int]:
        """Move the tokens on which all open places agree to ``out``; the register that is left."""
        last = len(register) - 1
        ways = [self._back(register, last - self.depth[node]) for node in self.states[at]]
        sure = 0
        while all(len(way) > sure for way in ways) and len({way[sure] for way in ways}) == 1:
            sure += 1
        if not sure:
            return register
        out += ways[0][:sure]
        return [ways[0][sure - 1], *register[sum(self.lengths[token] for token in ways[0][:sure]) + 1 :]]


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.transducer = Transducer(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.pieces = Recent(lambda piece: self.transducer.encode(piece.encode("utf-8", "replace")), MOST_PIECES)
        self.bytes_of = self.transducer.bytes_of

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def stream(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        """Text of each chunk of ids, whole characters only; wrong bytes become U+FFFD."""
        machine = Utf8()
        for ids in chunks:
            yield machine.feed(self.decode(ids))
        yield machine.end()


#: Fixed values of UTF-8: lead bytes, the bytes that must follow, and the range of the second byte.
_LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]


class Utf8:
    """UTF-8 as a state machine: (bytes still due, range of the next one)."""

    def __init__(self) -> None:
        self.held, self.due, self.low, self.high = b"", 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        """Characters that are whole by now; bytes between whole characters are read as one run, the machine goes on where that ends."""
        whole = ""
        if not self.held:
            try:
                return data.decode("utf-8")
            except UnicodeDecodeError as wrong:
                whole, data = data[: wrong.start].decode("utf-8"), data[wrong.start :]
        return whole + self._step(data)

    def _step(self, data: bytes) -> str:
        done = bytearray()
        for at, byte in enumerate(data):
            if self.due:
                if self.low <= byte <= self.high:
                    self.held += bytes((byte,))
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        done += self.held
                        self.held = b""
                    continue
                done += "�".encode()
                self.held, self.due = b"", 0
            if byte < 0x80:
                done.append(byte)
                continue
            lead = next((x for x in _LEADS if x[0] <= byte <= x[1]), None)
            if lead:
                self.held, (self.due, self.low, self.high) = bytes((byte,)), lead[2:]
            else:
                done += "�".encode()
        return done.decode("utf-8")

    def end(self) -> str:
        left, self.held, self.due = self.held, b"", 0
        return "�" if left else ""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec for each Python worker."""
    rare_gc()
    return Codec(path, pattern)


held_by_worker(codec.cache_clear)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids array<int>``; ``keep`` names the columns to pass on (default: all)."""
    keep = [c for c in (df.columns if keep is None else keep) if c != ids]
    kept = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in slices(batches, "__text", 1_000_000):
            out = [one.encode(x) if x else [] for x in batch.column("__text").to_pylist()]
            ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(out), np.int32, ends[-1])
            array = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], array], [*batch.schema.names[:-1], ids])

    return map_arrow(kept, kernel, ", ".join(x for x in (schema, f"`{ids}` array<int>") if x))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", chunk: int = 4096) -> DataFrame:
    """Replace ``ids`` by ``out string``, decoded in a stream of chunks; null ids give an empty text."""
    keep = [c for c in df.columns if c not in (ids, out)]
    kept = df.select(*keep, F.col(ids).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), f"`{out}` string"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path)
        for batch in batches:
            column = batch.column("__ids")
            texts = ("".join(one.stream(row[i : i + chunk] for i in range(0, len(row), chunk))) for row in (x.as_py() or [] for x in column))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], out])

    return map_arrow(kept, kernel, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN, chunk: int = 4096) -> DataFrame:
    """``key``, ``ids`` and the text ``decoded`` from them, in one pass: ids are never rebuilt from the text."""
    kept = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    kind = kept.schema[0].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in slices(batches, "__text", 1_000_000):
            out = [one.encode(x) if x else [] for x in batch.column("__text").to_pylist()]
            ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(out), np.int32, ends[-1])
            texts = ["".join(one.stream(row[i : i + chunk] for i in range(0, len(row), chunk))) for row in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(texts, pa.string())], [key, "ids", "decoded"])

    return map_arrow(kept, kernel, f"`{key}` {kind}, ids array<int>, decoded string")
