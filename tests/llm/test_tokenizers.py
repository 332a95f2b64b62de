import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from weftgraph.llm import byte_bpe, token_counts

RANKS, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "é", "ü", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "²", "the", "ing", "'s", "👍", "中", "ß", "_", "▁", "​", "　", "<s>", "<|endoftext|>"]


def texts(n, longest=60):
    rnd = random.Random(1)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS)


def test_ids_are_those_of_the_library(codec):
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})
    for text in [*texts(500), "a" * 5000, "thehe" * 3000, "é中" * 2000]:
        assert codec.encode(text) == other.encode_ordinary(text)
        assert codec.decode(codec.encode(text)).decode() == text


def test_streaming_decode_holds_back_parts_of_characters(codec):
    for text in texts(200):
        ids = codec.encode(text)
        for size in (1, 3):
            out = list(codec.stream(ids[i : i + size] for i in range(0, len(ids), size)))
            assert "".join(out) == text and "�" not in "".join(out)


def test_wrong_bytes_are_replaced_as_python_does():
    rnd = random.Random(2)
    for _ in range(500):
        data = bytes(rnd.choice([65, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rnd.randint(0, 12)))
        machine = byte_bpe.Utf8()
        assert "".join(machine.feed(data[i : i + 2]) for i in range(0, len(data), 2)) + machine.end() == data.decode("utf-8", "replace")


def test_counts_of_every_prefix():
    counter, other = token_counts.PrefixCounter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts(200, 40):
        expected = [len(other.encode(text[:i])) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == expected and counter.count(text) == expected[-1]
        for budget in (0, 3, 9):
            assert counter.fit(counter.segments(text), budget) == max(i for i, n in enumerate(expected) if n <= budget)


def test_queries_on_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "Hello  wörld\n" * 3000, 5), (4, "x", 5), (4, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = {r.doc_id: r for r in byte_bpe.round_trip(df, RANKS).collect()}
    assert found[1].ids == [] and found[1].decoded == "" and found[3].decoded == rows[2][1]
    both = byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS).collect()
    assert sorted((r.doc_id, r.decoded) for r in both) == sorted((a, b or "") for a, b, _ in rows)
    counted = {r.doc_id: r for r in token_counts.count_tokens(df, PIECES).collect()}
    assert counted[1].n_tokens == 0 and counted[3].over_limit and counted[3].fit_chars < len(rows[2][1]) and counted[3].n_bytes == len(rows[2][1].encode())
    assert byte_bpe.round_trip(df.limit(0), RANKS).count() == 0 and token_counts.count_tokens(df.limit(0), PIECES).count() == 0
