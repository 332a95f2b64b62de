import corpus_pipeline
from weftgraph.llm import byte_bpe, common, mixing, simhash
from weftgraph.plans.scratch import Scratch


def test_stages_on_planted_rows(spark, tmp_path):
    import random

    rnd = random.Random(1)
    words = {"en": ["the", "thing", "whale", "otion", "erring"], "de": ["schung", "keitlich", "über", "straße", "einung"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + rnd.choice(words[lang]) for _ in range(n))
    passage = text("en", 60)
    rows = [(i, text(lang, 80), lang, f"s{i % 3}") for i in range(60) for lang in (("en", "de")[i % 2],)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1], "de", "s1")]  # exact copies
    rows += [(102, text("en", 40) + " " + passage, "en", "s2"), (103, passage + " " + text("en", 40), "en", "s0")]
    rows += [(104, None, None, None), (105, "12 34", "en", "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, scratch, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs
        if name != "byte_bpe":
            assert docs.columns == df.columns
    ids = {name: sorted(r.doc_id for r in x.collect()) for name, x in kept.items()}
    assert set(ids["language_id"]) == {r[0] for r in rows} - {104, 105}
    assert not {100, 101} & set(ids["simhash_near_dedup"]) and {102, 103} <= set(ids["simhash_near_dedup"])
    cleaned = {r.doc_id: r.text for r in kept["substring_dedup"].collect()}
    assert passage in cleaned[102] and passage not in cleaned[103] and len(cleaned[103].split()) == 40
    expected = sorted(i for r in mixing.mix(kept["substring_dedup"]).collect() for i in [r.doc_id] * r.copies)
    assert ids["source_mixing"] == expected == ids["byte_bpe"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_near_duplicates_are_linked_by_simhash(spark):
    """Texts with one word changed are alike by 0.8 in five-word shingles; the stage goes by 3 bits of their fingerprints."""
    import random

    rnd = random.Random(3)
    texts = []
    for _ in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        texts += [" ".join(words), " ".join([*words[:60], "changed", *words[61:]])]
    prints = [simhash.fingerprint(x) for x in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 40 < len(set(root)) < 80
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(root)


def test_workers_drop_the_caches_of_earlier_stages():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    before = byte_bpe.codec(path)
    common.release_held()
    assert byte_bpe.codec(path) is not before
