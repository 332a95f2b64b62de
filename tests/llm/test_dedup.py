import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from weftgraph.llm import similar, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 90))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        words = list(rnd.choice(base))
        if rnd.random() < 0.5 and words:
            words[rnd.randrange(len(words))] = "other"
        if rnd.random() < 0.3:
            words = words[10:] + rnd.choice(base)
        out.append((i, rnd.choice([" ", "\n", "  "]).join(words)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "spam " * 70), (n + 3, "a b " * 40), (n + 4, "Spam " * 70)]


def removed(rows, window):
    seen, out = {}, {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - window + 1):
            seen.setdefault(tuple(words[i : i + window]), []).append((doc, i))
    first = {k: min(v) for k, v in seen.items()}
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < (doc, i) for j in range(i, i + window)}
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


@pytest.mark.parametrize("most_places", [3000, 4, 1])
def test_substrings_against_brute_force(spark, most_places):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("*", "1 as n_words")
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(df, most_places=most_places).collect()}
    assert found == removed(rows, 20)


def test_substrings_with_repeated_ids_and_none(spark):
    text = "x " + "a " * 21 + "y"
    df = spark.createDataFrame([(7, text), (7, text), (None, "a " * 100)], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_removed, r.kept_text[:3]) for r in substrings.remove_repeats(df).collect())
    assert found == [(0, 0, "a a"), (7, 20, "x a"), (7, 20, "x a")]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_untouched_texts_keep_their_white_space(spark):
    df = spark.createDataFrame([(1, "a\n b"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in substrings.without_repeats(df).collect()) == [(1, "a\n b"), (2, None)]


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    parent = {d: d for d in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(prints)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: top(d) for d in docs}


@pytest.mark.parametrize("most_group", [4096, 2])
def test_simhash_against_brute_force(spark, most_group):
    rows = corpus(seed=9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {d: fingerprint(t) for d, t in rows}
    named = groups(prints)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, most_group=most_group).collect()}
    assert found == {d: (f"{prints[d]:016x}", named[d]) for d in prints}
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert kept == set(named.values())


@pytest.mark.parametrize("most_group", [4096, 3])
def test_links_within_three_bits_are_all_found(spark, most_group):
    rnd = random.Random(5)
    prints = {}
    for centre in range(30):
        x = rnd.getrandbits(64)
        for _ in range(6):
            prints[len(prints)] = x
            for bit in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << bit
        prints[len(prints)] = centre  # a group that shares most blocks
    named = groups(prints)
    from weftgraph.plans.scratch import Scratch

    scratch = Scratch(spark)
    classes = spark.createDataFrame([(d, p - (1 << 64) if p >> 63 else p) for d, p in prints.items()], "id long, print long")
    dealt = simhash._dealt(classes, most_group, scratch)
    links = dealt.repartition("group").sortWithinPartitions("group").select("group", "id", "print").mapInPandas(simhash._link_groups, "node long, to long")
    roots = {r.node: r.root for r in simhash.components(links, scratch).collect()}
    assert {d: roots.get(d, d) for d in prints} == named


def test_components_of_a_long_chain(spark):
    from weftgraph.plans.scratch import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(100, 180)] + [(3, 7)], "node long, to long")
    found = {r.node: r.root for r in simhash.components(links, Scratch(spark)).collect()}
    assert found == {7: 3} | {i: 100 for i in range(101, 181)}


def test_gray_index_counts_differences():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 12, 300).astype(np.uint64)
    index = simhash.GrayIndex(np.zeros(300, np.int64), prints)
    found = {tuple(sorted((int(index.order[a]), int(index.order[b])))) for x, y in index.pairs(3) for a, b in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if int(prints[i] ^ prints[j]).bit_count() <= 3}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0


def test_similar_against_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "one two", "ONE two", "one two three"]
    for _ in range(25):
        base = [word() for _ in range(rnd.choice((12, 60, 200)))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(6)):
            x = list(base)
            for _ in range(rnd.randrange(1 + len(x) // 20)):
                x[rnd.randrange(len(x))] = word()
            texts.append(" ".join(x[: len(x) - rnd.randrange(len(x) // 8)]))
    base = [word() for _ in range(100)]  # one large group
    texts += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(100)] + [" ".join(base)] * 20
    sets = [set(similar.shingle_set(x).tolist()) for x in texts]
    root = list(range(len(texts)))
    far = 0
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b):
                far += (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = similar.one_of_each(df).collect()
    assert far > 50 and sorted(r.doc_id for r in kept) == sorted(set(root))
    assert all(r.text == texts[r.doc_id] for r in kept)
    assert similar.one_of_each(df.limit(0)).count() == 0
    for block in ((7, 1 << 20), (1000, 500)):
        cut = similar.one_of_each(df, most_group=2, block=block)
        assert sorted(r.doc_id for r in cut.collect()) == sorted(set(root))


def test_similar_blocks_of_a_passage_that_is_not_known_as_common(spark, monkeypatch):
    """A passage in a fifth of all texts, which the order puts anywhere; some of these texts are alike."""
    monkeypatch.setattr(similar, "common_shingles", lambda *_: np.zeros(similar.CELLS, np.int8))
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    own = [" ".join(word() for _ in range(40)) for _ in range(1200)]
    texts = [f"{passage} {x}" if i % 5 == 0 else x for i, x in enumerate(own)]
    texts += [f"{passage} {own[i]} {word()}" for i in range(0, 300, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = similar.one_of_each(df, most_group=50, block=(64, 1 << 20)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(1200))


def test_shared_counts():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 50, n)) for n in (1, 5, 30, 60, 9)]
    found = similar.shared_counts(sets[:3], sets[2:], most=4)
    assert found.tolist() == [[len(set(a) & set(b)) for b in sets[2:]] for a in sets[:3]]


def test_similar_is_the_stage(spark):
    words = [f"w{i}" for i in range(200)]
    near = [f"x{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(words)]  # 176 of 216 shingles shared
    rows = [(1, " ".join(words), "a"), (2, " ".join(near), "b"), (3, " ".join(words[:150]), "c")]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
