"""Nulls, copies, ties, odd ids and empty tables for the corpus operators and the pipeline's stages."""

import gzip
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import language, mixing, neighbours, quality, revisits, similar, simhash, substrings, toxicity


def test_neighbours_are_always_as_many_as_there_are(spark):
    rng = np.random.default_rng(3)
    equal, far = rng.standard_normal(16), rng.standard_normal((9, 16)) * 50
    rows = [(i, equal.tolist()) for i in range(128)] + [(200 + i, x.tolist()) for i, x in enumerate(far)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 4 == 0, lists=6, coverage=0.1).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    assert set(found) == {i for i in ids.tolist() if i % 4 == 0}
    for q, got in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        assert len(got) == 10 and all(s == pytest.approx(d[ids == v][0], abs=1e-12) for s, v in got)
        if q < 128:
            assert [v for _, v in got] == [i for i in range(12) if i != q][:10]


def test_neighbours_of_other_dimensions_and_repeated_ids(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(3)] + [(7, [100.0, 1.0])]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(7, 100), k=3).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found[100]) == [(1, 101, 1.0), (2, 102, 2.0)]
    assert sorted(found[7]) == [(1, 6, 1.0), (1, 29, 71.0), (2, 8, 1.0), (2, 28, 72.0), (3, 5, 2.0), (3, 27, 73.0)]


def test_toxicity_is_the_worst_of_all_windows():
    """Against one plain pass over each window, step by step."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    network = toxicity.Network.fresh({w: i + 1 for i, w in enumerate(words[:20])}, 3)
    network.p["word"] = rng.standard_normal(network.p["word"].shape).astype(np.float32)
    network.p["word"][0] = 0
    network.scale = (1.3, -0.2)
    p, h = network.p, toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def plain(window):
        vectors = []
        for w in window:
            _, buckets = toxicity.gram_buckets([w])
            vectors.append(p["word"][network.vocabulary.get(w, 0)] + np.mean([p["gram"][b] for b in buckets], axis=0))
        sides = []
        for d, order in (("0", range(len(window))), ("1", range(len(window) - 1, -1, -1))):
            state, states = np.zeros(h), [None] * len(window)
            for t in order:
                g, u = vectors[t] @ p["in" + d] + p["in_b" + d], state @ p["rec" + d]
                z, r = sigmoid(g[:h] + u[:h]), sigmoid(g[h : 2 * h] + u[h : 2 * h])
                new = np.tanh(g[2 * h :] + r * u[2 * h :])
                state = z * state + (1 - z) * new
                states[t] = state
            sides.append(np.array(states))
        both = np.concatenate(sides, axis=1)
        weight = np.exp(np.tanh(both @ p["att"]) @ p["att_v"])
        return (weight / weight.sum()) @ both @ p["out"] + p["out_b"][0]

    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 31, 32, 33, 56, 57, 200)]
    found = toxicity.Scorer(network).score([*texts, None, " "])
    for text, score in zip(texts, found, strict=False):
        x = text.split()
        starts = [0] if len(x) <= 32 else [*range(0, len(x) - 32, 24), len(x) - 32]
        assert score == pytest.approx(sigmoid(1.3 * max(plain(x[s : s + 32]) for s in starts) - 0.2), abs=1e-4)
    assert found[-1] == found[-2] == 0


def test_toxicity_of_words_never_seen(spark):
    """The parts of words speak for the whole: toxic words share a beginning, and none occurs twice."""
    rnd = random.Random(6)
    letters = "abcdefghiklmnoprstu"
    word = lambda: "".join(rnd.choice(letters) for _ in range(6))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rnd.randint(20, 60))]
        if i % 3 == 0:
            for _ in range(4):
                words[rnd.randrange(len(words))] = "zawx" + word()
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    network = toxicity.fit(docs, marks, ~toxicity.held_out())
    found = {r.doc_id: r.score for r in toxicity.score(docs.where(toxicity.held_out()), network).collect()}
    network.p["gram"][:] = 0
    blind = {r.doc_id: r.score for r in toxicity.score(docs.where(toxicity.held_out()), network).collect()}

    def ordered(scores):
        """The share of toxic and clean pairs in right order."""
        toxic, clean = ([scores[i] for i, y in labels if i in scores and y == k] for k in (1, 0))
        return np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])

    assert ordered(found) > 0.85 and ordered(blind) < ordered(found) - 0.15


def test_toxicity_of_one_kind_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "a")], "doc_id long, text string")
    ones = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"), F.lit(True))
    assert all(r.score > 0.99 for r in toxicity.score(docs, ones).collect())
    zeros = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"), F.lit(True))
    assert all(r.score < 0.01 for r in toxicity.score(docs, zeros).collect())
    assert all(r.h is False for r in docs.where("doc_id IS NULL").select(toxicity.held_out().alias("h")).union(docs.where("doc_id IS NULL").select(language.held_out())).collect())


def test_language_decodes_to_the_nearest_codeword(spark):
    rnd = random.Random(2)
    langs = [f"l{i:02d}" for i in range(9)]
    sounds = {x: ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for x in langs}
    rows = [(i, " ".join("".join(rnd.choice(sounds[x]) for _ in range(2)) for _ in range(25)), x) for i in range(450) for x in [langs[i % 9]]]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == langs
    for _, text, lang in rows[:60]:
        bits = language.features(text) @ model.weights + model.bias
        loss = [sum(t * np.log1p(np.exp(-w * b)) for t, w, b in zip(model.trust, word, bits, strict=True)) for word in model.words]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        pred, score, doubt = model.predict(text, 0.1)
        assert pred == langs[int(np.argmin(loss))] == lang and score == pytest.approx(share.max(), abs=1e-6)
        assert doubt == (np.sort(share)[-1] - np.sort(share)[-2] < 0.1)


def test_language_training_rows(spark):
    """Copies count once, every language takes part, and what looks like a letter but is a number is none."""
    rnd = random.Random(7)
    text = lambda parts, n=12: " ".join(rnd.choice(parts) + rnd.choice(parts) for _ in range(n))
    rows = [(i, text(["tha", "whi", "ing"]), "en") for i in range(60)] + [(100 + i, "same same same", "en") for i in range(400)]
    rows += [(600 + i, text(["sch", "ung", "ber"]), "de") for i in range(60)] + [(900, "rare zyq zyq", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True), per_lang=20)
    assert model.langs == ["de", "en", "xx"]
    odd = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "12"), (4, None), (5, "")], "doc_id long, text string")
    assert {r.lang_pred for r in language.identify(odd, model).collect()} == {"und"}
    assert language.has_letters("x²") and language.fit(df.limit(0), F.lit(True)).langs == []
    right = [r.lang_pred == "en" for r in language.identify(df.where("doc_id < 60"), model).collect()]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("kind", ["string", "long"])
def test_simhash_and_similar_of_any_ids(spark, kind):
    a, b = "one two three four five six seven " * 3, "ten eleven twelve " * 9
    rows = [("3", a), ("1", a), (None, b), (None, b), ("2", None), ("2", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("print", F.lit(1)).withColumn("root", F.lit("r"))
    found = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert found == [("1", "1"), ("2", "2"), ("2", "2"), ("3", "1"), ("None", "None"), ("None", "None")]
    for kept in (simhash.one_of_each(df), similar.one_of_each(df)):
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", a), ("2", None), ("None", b)] and kept.columns == df.columns
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_substrings_of_text_ids(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([("b", f"x {passage} y"), ("a", f"{passage} z"), (None, passage)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {"a": 0, "b": 30, None: 0}
    assert sorted(substrings.without_repeats(df).collect(), key=repr)[0].text is not None


def test_revisits_of_repeated_records(spark):
    rows = [(1, "a.com", 10, "response", {"etag": "1"}, "p")] * 3 + [(2, "a.com", 20, "revisit", {"etag": "1"}, None)] * 2 + [(None, "a.com", 20, "revisit", {}, None), (3, "a.com", 20, "other", {}, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, digest string")
    assert [(r.record_id, r.target_id, r.state) for r in revisits.resolve(df).collect()] == [(2, 1, "resolved")]


def test_revisits_of_one_hot_url(spark):
    """Many captures of one URL in little time, against a plain search."""
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["http://hot.com/"] * 9 + ["cold.com"]), rnd.randrange(300), rnd.choice(["response", "revisit"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string").withColumn("headers", F.create_map().cast("map<string,string>")).withColumn("digest", F.lit(None).cast("string"))
    found = {r.record_id: r.target_id for r in revisits.resolve(df.repartition(7)).collect()}
    for i, url, at, kind in rows:
        if kind == "revisit":
            before = [(a, j) for j, u, a, k in rows if k == "response" and u == url and a < at]
            assert found[i] == (max(before)[1] if before else None)


def test_warc_files(spark, tmp_path):
    def record(kind, name, url, date, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Target-URI": url, "WARC-Date": date, "Content-Length": str(len(block)), **more}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    full = b'HTTP/1.1 200 OK\r\nETag: "a"\r\nContent-Type: text/html\r\n\r\nWARC/1.0 is in the text\r\n\r\n'
    not_modified = b'HTTP/1.1 304 Not Modified\r\nETag: W/"a"\r\nDate: d2\r\n\r\n'
    parts = [record("warcinfo", "<i>", "x", "2024-01-01T00:00:00Z", b"software: x"), record("response", "<r>", "http://a.com/", "2024-01-01T00:00:00Z", full), record("revisit", "<v>", "https://www.a.com", "2024-01-02T00:00:00Z", not_modified, **{"WARC-Profile": "server-not-modified"})]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "b.warc").write_bytes(record("revisit", "<w>", "b.com", "no date", not_modified) + b"WARC/1.0\r\ncut")
    found = {r.record_id: r for r in revisits.resolve(revisits.read_warc(spark, str(tmp_path))).collect()}
    assert {k: (r.target_id, r.state) for k, r in found.items()} == {"<v>": ("<r>", "resolved"), "<w>": (None, "no_response")}
    assert found["<v>"].headers == {"etag": 'W/"a"', "date": "d2", "content-type": "text/html"}


def warc_record(kind, name, url, date, block, size=None, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Target-URI": url, "WARC-Date": date, "Content-Length": str(len(block) if size is None else size), **more}
    return b"WARC/1.1\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_warc_profiles_and_repeated_headers(spark, tmp_path):
    payload = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    full = b'HTTP/1.1 200 OK\r\nETag: "a"\r\nVary: x\r\nvary: y\r\nSet-Cookie: a=1, b\r\nSet-Cookie: c=2\r\nServer: one\r\n\r\nbody'
    again = b'HTTP/1.1 200 OK\r\nETag: "b"\r\nServer: two\r\n\r\n'
    day = "2024-01-0{}T00:00:00Z".format
    parts = [
        warc_record("response", "<r>", "http://a.com/", day(1), full, WARC_Payload_Digest="d"),
        warc_record("revisit", "<same>", "a.com", day(2), again, WARC_Payload_Digest="d", WARC_Profile=payload),
        warc_record("revisit", "<other>", "a.com", day(3), again, WARC_Payload_Digest="e", WARC_Profile=payload),
        warc_record("revisit", "<none>", "a.com", day(4), again, WARC_Profile=payload),
        warc_record("revisit", "<tag>", "a.com", day(5), b'HTTP/1.1 304 x\r\nETag: "a"\r\n\r\n', WARC_Profile="http://netpreserve.org/warc/1.1/revisit/server-not-modified"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    records = revisits.read_warc(spark, str(tmp_path))
    found = {r.record_id: r for r in revisits.resolve(records).collect()}
    assert {k: r.state for k, r in found.items()} == {"<same>": "resolved", "<other>": "mismatch", "<none>": "unchecked", "<tag>": "resolved"}
    assert all(found[k].headers == {"etag": '"b"', "server": "two"} for k in ("<same>", "<other>", "<none>"))
    assert found["<tag>"].headers == {"etag": '"a"', "vary": "x, y", "set-cookie": "a=1, b\nc=2", "server": "one"}


def test_warc_files_are_streams():
    class Counted(io.RawIOBase):
        """A file of many records that is never whole in memory; ``peak`` is the most bytes asked for at once."""

        def __init__(self, n):
            self.left, self.data, self.peak = n, b"", 0

        def readable(self):
            return True

        def readinto(self, into):
            self.peak = max(self.peak, len(into))
            if not self.data and self.left:
                self.left -= 1
                self.data = warc_record("response", f"<{self.left}>", "a.com", "", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"WARC/1.0\r\n" * 300_000)
            n = min(len(into), len(self.data))
            into[:n], self.data = self.data[:n], self.data[n:]
            return n

    file = Counted(30)
    assert [r[0] for r in revisits.parse_warc(file)] == [f"<{i}>" for i in range(29, -1, -1)] and file.peak <= 2 * revisits.STEP
    member = gzip.compress(warc_record("response", "<a>", "a.com", "", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody" * 50))
    assert [r[0] for r in revisits.parse_warc(io.BytesIO(member + member[:-20]))] == ["<a>", "<a>"]
    long = warc_record("response", "<a>", "a.com", "", b"HTTP/1.1 200 OK\r\nA: " + b"b" * 3_000_000 + b"\r\nB: c\r\n\r\nD: e")
    assert [(len(r[4]["a"]), r[4]["b"], len(r[4])) for r in revisits.parse_warc(io.BytesIO(long))] == [(3_000_000, "c", 2)]
    assert list(revisits.parse_warc(io.BytesIO(b""))) == list(revisits.parse_warc(io.BytesIO(b"WARC/1.0\r\ncut"))) == []
    assert [r[0] for r in revisits.parse_warc(io.BytesIO(warc_record("response", "<a>", "a.com", "", b"short", size=99)))] == ["<a>"]


def test_neighbours_of_long_lists(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([c + rng.standard_normal((n, 8)) * 0.1 for c, n in zip(rng.standard_normal((12, 8)) * 4, [900] + [60] * 11, strict=True)])
    x[:250] = x[0]  # a hot list that centroids cannot split
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    copies = {}

    def counted(rows, levels, to_second=neighbours.to_second):
        found = to_second(rows, levels)
        copies[levels is not None] = copies.get(levels is not None, 0) + found.where(F.col("kind") != neighbours.PLACE).count()
        return found

    queries = F.col("vec_id") % 10 == 0
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neighbours, "to_second", counted)
        got = neighbours.nearest(df, queries, lists=2, most_list=100, rerank=100).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, len(x), 10)) and all(len(v) == 10 for v in found.values())
    hits = 0
    for q, ids in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10].tolist()
        hits += len(set(ids) & set(best))
        if q < 250:
            assert ids == best
    assert hits >= 0.9 * 10 * len(found)
    assert copies[True] < len(found) * 20  # lists of the second level: some 30


def test_cleaned_texts(spark):
    line = "All rights reserved 2024 by the host"
    body = lambda i: " ".join(chr(97 + i % 26) * (i + 1) + chr(97 + j % 26) * (j + 1) for j in range(60))
    rows = [(i, f"{line}\n{body(i)}\n\n{line.upper()}", "h", "x") for i in range(40)]
    rows += [(50, None, "h", "x"), (51, line, "h", "x"), (None, f"{body(51)}\n{line}", "h", "y"), (60, body(60), None, "z"), (60, body(60), None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, removed_lines string")
    found = quality.cleaned(df)
    assert found.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in found.collect()), key=repr)
    assert texts == sorted([*((i, f"{body(i)}\n") for i in range(40)), (None, body(51)), (60, body(60)), (60, body(60))], key=repr)
    spans = {r.doc_id: r.removed_lines for r in quality.quality(df).collect()}
    assert spans[1] == [0, 3] and spans[51] == [0] and spans[60] == []
    assert quality.cleaned(df.limit(0)).count() == 0


def test_mixed_documents_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 4 + [(None, "d e f", "s")] * 4 + [(2, "g h i", "t")], "doc_id long, text string, source string")
    total = sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.mixed_documents(df).count() == total <= 9


def test_stages_of_odd_tables(spark, tmp_path):
    rnd = random.Random(5)
    words = {"en": ["the", "thing", "whale", "otion"], "de": ["schung", "keitlich", "über", "straße"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + rnd.choice(words[lang]) for _ in range(n))
    rows = [(i if i % 5 else None, text(lang, 40), lang, f"s{i % 2}", 1, "more") for i in range(40) for lang in (("en", "de")[i % 2],)]
    rows += [(7, text("en", 40), "en", None, 1, "more"), (7, None, "en", "s0", 1, None), (8, "", None, "s1", 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string")
    for name, table, most in (("odd", df.withColumnRenamed("__row", "copies"), 200), ("empty", df.drop("__row").limit(0), 0)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        docs = corpus_pipeline.known_languages(spark, spark.read.parquet(f"{tmp_path}/{name}/documents.parquet"), "")
        near = corpus_pipeline.near_duplicates(spark, docs, "")
        assert near.count() == docs.count() == (41 if most else 0)  # no clean row goes, whatever its id
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() <= most
