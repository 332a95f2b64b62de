import random
import re
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import phrases


def by_hand(rows, least, share, most):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + m])) for m in range(1, 5) for i in range(len(ws) - m + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, ws), a in found.items():
        score, k = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        inside = any(x == lang and len(longer) > len(ws) and 100 * b >= share * a and any(longer[i : i + len(ws)] == ws for i in range(len(longer) - len(ws) + 1)) for (x, longer), b in found.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    out.sort()
    ranks, result = Counter(), []
    for lang, score, a, phrase, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= most:
            result.append((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(result)


def mined(df, **options):
    return sorted(map(tuple, phrases.collocations(df, **options).collect()))


@pytest.mark.parametrize(("shard_words", "most"), [(40, 5), (1 << 20, 2000)])
def test_against_brute_force(spark, monkeypatch, shard_words, most):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard_words)
    rng = random.Random(7)
    pool = ["New", "york", "CITY", "é", "É", "of", "the", "the", "the", "a b", "x"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und"]), "".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randrange(60)))) for _ in range(80)]
    rows += [("en", "one two three four five " * 5), ("en", None), ("fr", ""), ("en", "...")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(df, least=4, most=most) == by_hand(rows, 4, 80, most)


def test_copies_and_one_long_text(spark):
    rows = [("en", "alpha beta gamma delta")] * 500 + [("de", "so und so weiter " * 20000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mined(df) == by_hand(rows, 30, 80, 2000)


def test_bits_that_meet_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases.Frequent, "__call__", lambda self, hashes: np.ones(len(hashes), bool))
    rows = [("en", "a b c d e"), ("en", "a b c"), ("en", "c d e a b")] * 20
    assert mined(spark.createDataFrame(rows, "lang string, text string"), least=10) == by_hand(rows, 10, 80, 2000)


def test_nothing_and_clashing_columns(spark):
    df = spark.createDataFrame([("x y", "en", 1, "q")] * 40, "body string, tongue string, n int, phrase string")
    assert mined(df, text="body", lang="tongue") == [("en", 1, "x y", 40, 40, 40, 80, 1000000)]
    assert mined(df.limit(0), text="body", lang="tongue") == [] and mined(df.limit(3), text="body", lang="tongue") == []


def test_exact_beyond_64_bits(spark):
    from weftgraph.plans.scratch import Scratch

    big = 9_000_000_000_000_001
    counts = spark.createDataFrame([("en", 2, "p q", big), ("en", 1, "p", big + 5), ("en", 1, "q", big + 6)], "lang string, size int, phrase string, f long")
    assert phrases.scored(counts, Scratch(spark)).first().score == 2000000 * big // (2 * big + 11)
