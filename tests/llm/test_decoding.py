"""Decoding reads runs of whole characters at once; only what a chunk cuts goes byte by byte."""

import random

from weftgraph.llm.byte_bpe import Utf8


def test_whole_characters_need_no_steps(monkeypatch):
    stepped, step = [], Utf8._step
    monkeypatch.setattr(Utf8, "_step", lambda self, data: stepped.append(len(data)) or step(self, data))
    machine, text = Utf8(), "é中👍a" * 100
    assert machine.feed(text.encode()) + machine.end() == text and not stepped
    cut = Utf8()
    assert cut.feed(text.encode() + b"\xf0\x9f") == text and stepped == [2]
    assert cut.feed(b"\x91\x8d") + cut.end() == "👍"


def test_wrong_bytes_in_any_chunks():
    rnd = random.Random(1)
    for _ in range(3000):
        data = bytes(rnd.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rnd.randint(0, 14)))
        machine, size = Utf8(), rnd.randint(1, 5)
        assert "".join([*(machine.feed(data[i : i + size]) for i in range(0, len(data), size)), machine.end()]) == data.decode("utf-8", "replace")
