import random

from weftgraph.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def by_hand(rows, least_chars=10, least_docs=2):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))

    holders = {}
    last = (1, 0)
    name = lambda d: last if d is None else (0, d)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(name(doc))
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= least_docs and min(holders[key(x)]) != name(doc) for x in parts]
        out.append((doc, len(parts), sum(gone), "\n".join(x for x, g in zip(parts, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(11)
    pool = ["a line that is long", "  A Line that is LONG \t", "short", "", "ÄRGER bleibt Ärger", "ärger bleibt Ärger", "one more long line\r", "x" * 10, "y" * 9, "\x0b" + "x" * 10]
    rows = [(rng.choice([None, 1, 2, 3, 4, 50]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for _ in range(60)] + [(7, None), (8, ""), (9, "\n\n"), (10, "  a line that is long\n" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for least_docs in (2, 4):
        got = lines.line_dedup(df, least_docs=least_docs).collect()
        assert sorted(map(tuple, got), key=str) == by_hand(rows, least_docs=least_docs)


def test_keys_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "heavy_join", lambda *a: __import__("weftgraph.llm.common", fromlist=["x"]).heavy_join(*a, most=3))
    rows = [(i, f"line number {i % 4}\nonly here: {i}\na line of all documents") for i in range(40)]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_long_text_and_hot_copies(spark):
    long = "\n".join(f"line number {i % 15000}" for i in range(30000))
    rows = [(1, long), (2, long)] + [(3, "the same copied line")] * 300
    got = {r.doc_id: r for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_dropped, got[2].n_dropped, got[3].n_dropped) == (0, 30000, 0) and got[2].kept_text == "" and got[1].kept_text == long


def test_clashing_columns_text_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "some long line\nother", 1, None), ("a", "some long line", 2, "x"), (None, "SOME LONG LINE", 3, "y"), ("c", None, 4, "z")], "id string, body string, __r1 int, kept_text string")
    got = {r.id: r for r in lines.cleaned(df, "id", "body").collect()}
    assert lines.cleaned(df, "id", "body").columns == df.columns
    assert (got["a"].body, got["b"].body, got[None].body, got["c"].body) == ("some long line", "other", "", None) and got["b"]["__r1"] == 1
    assert lines.line_dedup(df.limit(0), "id", "body").count() == 0 and lines.cleaned(df.limit(0), "id", "body").count() == 0
