import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import statistics
from weftgraph.plans.ordered import consecutive_bins, ranks_within, values_at
from weftgraph.plans.scratch import Scratch


def by_hand(rows):
    groups = {}
    for key, value in rows:
        groups.setdefault(key, []).append(value)
    return sorted(((k, v, i, len(vs)) for k, vs in groups.items() for i, v in enumerate(sorted(vs), 1)), key=str)


@pytest.mark.parametrize("hot", [0, 400])
def test_ranks_within(spark, hot):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 40]), i) for i in range(600)] + [(2, 1000 + i) for i in range(hot)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    found = ranks_within(df, ["k"], [F.col("v").asc()], Scratch(spark), "ranks", "rank", "n")
    assert found.columns == ["k", "v", "rank", "n"]
    assert sorted(map(tuple, found.collect()), key=str) == by_hand(rows)
    assert [r["rank"] for r in ranks_within(df.limit(0), ["k"], [F.col("v").asc()], Scratch(spark), "none").collect()] == []


def test_ranks_within_a_key_of_two_columns(spark):
    rows = [(i % 3, "x" if i % 2 else None, i) for i in range(90)]
    df = spark.createDataFrame(rows, "a long, b string, v long")
    got = ranks_within(df, ["a", "b"], [F.col("v").desc()], Scratch(spark), "two").where("rank = 1").collect()
    assert sorted((r.a, r.b or "", r.v) for r in got) == sorted((a, b or "", max(v for x, y, v in rows if (x, y) == (a, b))) for a, b in {(x, y) for x, y, _ in rows})


def test_values_at(spark):
    values = [5.0, 1.0, None, 5.0, 5.0, 2.0, 9.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert values_at(df, "v", [0, 1, 2, 4, 5], Scratch(spark), "values") == {0: 1.0, 1: 2.0, 2: 5.0, 4: 5.0, 5: 9.5}


def test_summary(spark):
    rng = random.Random(5)
    values = [rng.choice([None, 7.0, rng.random()]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = statistics.summary(df, "v").first()
    want = df.select(F.percentile("v", F.array(*map(F.lit, (0.0, 0.5, 0.95, 0.99, 1.0))))).first()[0]
    assert [got.p0, got.p50, got.p95, got.p99, got.p100] == [round(x, 6) for x in want] and got.n == sum(v is not None for v in values)
    assert tuple(statistics.summary(df.limit(0), "v").first()) == (0, None, None, None, None, None, None, None)


@pytest.mark.parametrize(("most", "sizes"), [(10, [1, 9, 1, 30, 2, 2, 2, 5, 10]), (7, None), (40, None)])
def test_consecutive_bins(spark, most, sizes):
    rng = random.Random(most)
    sizes = sizes or [rng.choice([1, 2, 3, 5, 50]) for _ in range(300)]
    want, number, used = [], -1, None
    for i, s in enumerate(sizes):
        if used is None or used + s > most:
            number, used = number + 1, 0
        want.append((i, s, number, used))
        used += s
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, s long").repartition(5)
    got = consecutive_bins(df, [F.col("i").asc()], "s", most, "bin", "before", Scratch(spark), "bins")
    assert sorted(map(tuple, got.collect())) == want
    assert consecutive_bins(df.limit(0), [F.col("i").asc()], "s", most, "bin", "before", Scratch(spark), "none").count() == 0
