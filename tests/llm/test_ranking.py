import random
from collections import Counter

import pytest

from weftgraph.llm import ranking


def by_hand(rows, k):
    """Rows are (group, down, up, tie)."""
    last = lambda v, sign=1: (1, 0) if v is None else (0, sign * v)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = []
    for members in groups.values():
        members.sort(key=lambda r: (last(r[1], -1), last(r[2]), last(r[3])))
        tied, seen = Counter(r[1:3] for r in members), []
        for pos, r in enumerate(members, 1):
            if not seen or seen[-1] != r[1:3]:
                seen.append(r[1:3])
            if len(seen) <= k:
                out.append((*r, pos, len(seen), tied[r[1:3]]))
    return sorted(out, key=str)


def ranked(df, k):
    return sorted(map(tuple, ranking.top_places(df, ["g"], [("a", True), ("b", False)], ["t"], k).collect()), key=str)


@pytest.mark.parametrize(("k", "run_rows"), [(1, 16), (3, 50), (5, 1 << 18)])
def test_against_brute_force(spark, monkeypatch, k, run_rows):
    monkeypatch.setattr(ranking, "RUN_ROWS", run_rows)
    monkeypatch.setattr(ranking, "FAN", 3)
    rng = random.Random(k)
    pick = lambda *values: rng.choice(values)
    rows = [(pick(None, 1, 2, 3, -4), pick(None, 1, 2, 3, 4), pick(None, 0, 1), pick(None, 5, 6, 7)) for _ in range(400)]
    rows += [(9, pick(1, 2, 3, 4, 5, 6, 7), pick(0, 1, None), rng.randrange(900)) for _ in range(900)]  # a hot group over all ranges
    df = spark.createDataFrame(rows, "g long, a long, b long, t long").repartition(6)
    assert ranked(df, k) == by_hand(rows, k)


def test_one_pair_and_equal_rows(spark):
    rows = [(1, 2, 3, 4)] * 500 + [(1, 1, None, None)] * 200 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "g long, a long, b long, t long").repartition(5)
    assert ranked(df, 1) == by_hand(rows, 1) and ranked(df, 2) == by_hand(rows, 2)


def test_text_groups_other_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("x", 1.5, "p", 0), ("x", 1.5, None, 1), (None, 2.5, "q", 2), ("x", 0.5, "r", 3)], "g string, a double, t string, pos int")
    got = ranking.top_places(df, ["g"], [("a", True)], ["t"], 1)
    assert got.columns == ["g", "a", "t", "pos", "place", "tied"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", 1.5, "p", 1, 1, 2), ("x", 1.5, None, 2, 1, 2), (None, 2.5, "q", 1, 1, 1)], key=str)
    assert ranking.top_places(df.limit(0), ["g"], [("a", True)], ["t"], 1).count() == 0
    with pytest.raises(ValueError):
        ranking.top_places(df, [], [("a", True)], ["t"], 1)


def test_broken_sale_lines(spark):
    rows = [(None, 1, None, None, None, float("nan"), None, None), (2, None, 3, 4, 25, float("inf"), float("nan"), None), (2, 1, 3, 4, 25, 1.005, 0.015, None)]
    df = spark.createDataFrame(rows, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, shipped_at timestamp_ntz")
    got = ranking.sale_ranks(df).collect()
    assert len(got) == 3 and {r.amount_cents for r in got} == {None, 100} and {r.month for r in got} == {-1}
    assert ranking.sale_ranks(df.limit(0)).count() == 0
