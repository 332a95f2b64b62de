import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import language, neighbours, revisits, toxicity

SOUNDS = {"aa": ["the", "wh", "ing", "tion", "er"], "bb": ["sch", "ung", "keit", "ü", "ß"], "cc": ["eau", "ç", "tion", "le", "é"]}


def spoken(n=240, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(sorted(SOUNDS))
        out.append((i, " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(8, 60))), lang))
    return out


def test_language_held_out_accuracy(spark):
    rows = spoken()
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 ...", "bb"), (902, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = language.fit(df, ~language.held_out())
    found = {r.doc_id: r for r in language.identify(df, model).collect()}
    truth = {i: lang for i, _, lang in rows}
    apart = [r.doc_id for r in df.where(language.held_out()).collect() if r.doc_id in truth]
    assert len(apart) > 20 and all(found[i].lang_pred == truth[i] for i in apart)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {found[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert {r.doc_id for r in language.keep_known(df.drop("score")).collect()} == set(truth)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    assert [r.lang_pred for r in language.identify(df, model).collect()] == ["und"]
    assert language.identify(df.limit(0), model).count() == 0


def test_codewords_lie_apart():
    words = language.codewords(12)
    assert min((a != b).sum() for i, a in enumerate(words) for b in words[:i]) >= 3


def test_recurrent_gradients():
    network = toxicity.Network.fresh({}, 1)
    for k in network.p:
        network.p[k] = network.p[k].astype(np.float64)
    gates = np.random.default_rng(0).standard_normal((5, 3, 6 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    tape = []
    network.forward(gates, mask, tape)
    grad, d_gates = network.backward(gates, mask, tape, np.ones(3))

    def slope(array, at, e=1e-2):
        was = array[at]
        values = []
        for x in (was + e, was - e):
            array[at] = x
            values.append(network.forward(gates, mask).astype(np.float64).sum())
        array[at] = was
        return (values[0] - values[1]) / (2 * e)

    for name in ("rec0", "rec1", "att", "att_v", "out"):
        at = tuple(0 for _ in network.p[name].shape)
        assert grad[name][at] == pytest.approx(slope(network.p[name], at), abs=2e-3)
    assert d_gates[1, 1, 5] == pytest.approx(slope(gates, (1, 1, 5)), abs=2e-3)


def test_toxicity_held_out(spark):
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("la", "mi", "no", "ru", "ti") for b in ("", "sa", "po", "ke", "vu")]
    rows, labels = [], []
    for i in range(400):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 160))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 20)):
                words[rnd.randrange(len(words))] = rnd.choice(["zagh", "qurg", "xolt"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").withColumn("label", F.lit(3))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    network = toxicity.fit(docs, marks, ~toxicity.held_out())
    found = {r.doc_id: r.score for r in toxicity.score(docs, network).collect()}
    assert found[900] == found[901] == 0 and all(0 <= x <= 1 for x in found.values())
    apart = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    right = [(found[i] >= 0.7) == bool(y) for i, y, _ in labels if i in apart]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert toxicity.score(docs.limit(0), network).count() == 0


def test_toxicity_sample_has_every_window(spark):
    long = [" ".join(f"w{i}x{k}" for k in range(5000)) for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    found = toxicity.sample(docs, marks, F.lit(True), "toxic", 1000, 200_000).to_pylist()
    assert {w for r in found for w in r["words"].split()} == {w for x in long for w in x.split()}
    assert len(found) == 4 * len(toxicity.window_starts(5000))
    few = toxicity.sample(docs, marks, F.lit(True), "toxic", 1000, 300).to_pylist()  # whole rows go, not windows
    assert [sum(r["label"] == y for r in few) for y in (0, 1)] == [len(toxicity.window_starts(5000))] * 2


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    network = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(docs, network).first().score < 0.01


def vectors(spark, n=3000, size=16):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, size)) + 2 * rng.standard_normal((20, size))[rng.integers(0, 20, n)]
    x[500:900] = x[500]  # many equal vectors
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(n, None), (n + 1, [0.0] * size), (n + 2, [float("nan")] + [1.0] * (size - 1)), (n + 3, [None] + [1.0] * (size - 1)), (n + 4, [1.0]), (100 * n, [float("inf")] * size)]
    return x, spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumn("rank", F.lit(0))


def test_neighbours_recall_and_order(spark):
    x, df = vectors(spark)
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, most_list=200).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(found) == set(range(0, 3000, 100))
    hits = 0
    for q, rows in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len({v for _, v in rows} & set(best.tolist()))
        assert rows == sorted(rows) and len(rows) == 10
        assert all(s == pytest.approx(d[v], abs=1e-12) for s, v in rows)
    assert hits >= 0.9 * 10 * len(found)
    assert [v for _, v in found[500]] == list(range(501, 511))


@pytest.mark.parametrize("kind", ["heavy norms", "huge", "odd queries"])
def test_neighbours_recall_on_odd_rows(spark, kind):
    """Rows of very different lengths share a code, squares pass single precision, queries lie apart from other rows."""
    rng = np.random.default_rng(5)
    n, size = 6000, 32
    x = rng.standard_normal((n, size))
    if kind == "heavy norms":
        x *= np.exp(3 * rng.standard_normal((n, 1)))
    elif kind == "huge":
        x *= 1e25
    else:
        x = 0.1 * x + rng.standard_normal((8, size))[rng.integers(0, 8, n)]
        x[::100] = 2 * rng.standard_normal((n // 100, size))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        d = np.sqrt(((x - x[r.query_id]) ** 2).sum(1))
        d[r.query_id] = np.inf
        hits += d[r.vec_id] <= np.sort(d)[9]
    assert hits >= 0.9 * 10 * n / 100


def test_neighbours_of_few_or_none(spark):
    _, df = vectors(spark)
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2, 3002)"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in sorted(few)] == [1, 2]
    assert neighbours.nearest(df.where("vec_id >= 3000"), F.lit(True)).count() == 0


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTP://www.Example.com:80/A/b/#x", "example.com/A/b"),
        ("https://example.com/?utm_source=a&b=2&a=1", "example.com?a=1&b=2"),
        ("https://Example.com/p?ref=x", "example.com/p"),
        ("example.com", "example.com"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, expected):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(revisits.canonical_url(F.col("url")).alias("u")).first().u == expected


def test_revisits(spark):
    rows = [
        (1, "http://a.com/x", 10, "response", {"etag": '"1"', "content-type": "t", "date": "d1"}, "p1"),
        (2, "https://www.a.com/x/", 200, "response", {"etag": '"2"', "content-type": "t"}, "p2"),
        (3, "a.com/x#f", 10, "revisit", {"etag": '"1"'}, None),  # the same time is not earlier
        (4, "a.com/x", 150, "revisit", {"etag": 'W/"1"', "date": "d2", "server": "s"}, None),
        (5, "a.com/x", 100_000_000, "revisit", {"etag": '"1"'}, None),  # other slice, other tag
        (6, "a.com/x", 300, "revisit", {}, "p2"),
        (7, "a.com/x", 300, "revisit", None, None),
        (8, "b.com", 300, "revisit", {}, None),
        (9, None, 300, "revisit", {}, None),
        (10, "a.com/x", None, "revisit", {}, None),
        (11, "a.com/x", 200, "response", {"etag": '"3"'}, "p2"),  # a tie in time: the larger id
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, digest string").withColumn("state", F.lit("x"))
    found = {r.record_id: r for r in revisits.resolve(df).collect()}
    assert {i: (r.target_id, r.state) for i, r in found.items()} == {3: (None, "no_response"), 4: (1, "resolved"), 5: (11, "mismatch"), 6: (11, "resolved"), 7: (11, "unchecked"), 8: (None, "no_response"), 9: (None, "no_response"), 10: (None, "no_response")}
    assert found[4].headers == {"etag": 'W/"1"', "date": "d2", "content-type": "t"}
    assert revisits.resolve(df.limit(0)).count() == 0
