import random
import time

import pytest
from pyspark.sql import functions as F
from graphs import build, counts, labels, roots

from weftgraph.operators import analysis, statistics
from weftgraph.plans import fixpoint

WIKI = "k:0>6 c:6>7 c:6>8 c:7>8 c:8>9 d:6>1 d:6>2 d:6>4 d:6>5 d:7>3 d:7>4 d:8>3 d:1>7 d:2>7 d:2>9 d:3>9 d:4>9"


def test_reachability_of_a_chain(spark):
    n, e = build(spark, "IIII", "c:0>1 c:1>2 c:2>3 c:3>4")
    r = roots(spark, 1, 4)
    assert labels(analysis.reachability(n, e, r)) == {1: {1, 2, 3, 4}, 4: {4}}
    assert counts(analysis.reachability_instances(n, e, r)) == {1: (4, 4), 4: (1, 1)}


def test_labels_cover_every_node(spark):
    n, e = build(spark, "IIII", "c:0>1 c:1>2 c:2>3 c:3>4")
    found = analysis.reachability(n, e, roots(spark, 2)).collect()
    assert len(found) == 5 and [r.node_id for r in found if r.is_root] == [2]


def test_data_dependency(spark):
    n, e = build(spark, "IIIIVV", "c:0>1 c:1>2 c:2>3 c:3>4 d:1>5 d:5>2 d:2>6 d:6>4")
    r = roots(spark, 5, 6, 3, 4)
    assert labels(analysis.datadep(n, e, r)) == {5: {1}, 6: {1, 2}, 3: {3}, 4: {1, 2, 4}}
    assert counts(analysis.datadep_instances(n, e, r)) == {5: (1, 1), 6: (2, 3), 3: (1, 0), 4: (3, 4)}


@pytest.mark.parametrize(
    ("kinds", "edges", "expected", "count"),
    [
        ("IIIIV", "c:0>1 c:1>2 c:1>3 c:2>4 c:3>4 d:1>5 d:5>3", {1, 2, 3, 4}, (4, 4)),
        ("IIIIIV", "c:0>1 c:1>2 c:1>3 c:2>4 c:3>4 d:1>6 d:6>3 c:5>2", {1, 3}, (2, 5)),
    ],
)
def test_dominance(spark, kinds, edges, expected, count):
    n, e = build(spark, kinds, edges)
    r = roots(spark, 1)
    assert labels(analysis.dominance(n, e, r)) == {1: expected}
    assert counts(analysis.dominance_instances(n, e, r)) == {1: count}


def test_a_loop_header_is_not_dominated(spark):
    n, e = build(spark, "III", "c:0>1 c:1>2 c:2>3 c:3>2")
    assert labels(analysis.dominance(n, e, roots(spark, 1))) == {1: {1}}


def test_dominance_reports_what_does_not_converge(spark):
    n, e = build(spark, "IIII", "c:0>1 c:1>2 c:2>3 c:3>4")
    found = analysis.dominance_instances(n, e, roots(spark, 1), most_updates=1).first()
    assert found.status == "not_converged" and found.step_count is None


def test_liveness(spark):
    n, e = build(spark, "VVVVVIIII", WIKI)
    ins, outs = {}, {}
    for df, out in ((analysis.live_in(n, e), ins), (analysis.live_out(n, e), outs)):
        for r in df.collect():
            out.setdefault(r.node_id, set()).add(r.variable)
    assert ins == {7: {1, 2}, 8: {2, 4}, 9: {2, 3, 4}}
    assert outs == {6: {1, 2, 4}, 7: {2, 4}, 8: {2, 3, 4}}
    r = roots(spark, 6, 7)
    assert labels(analysis.liveness(n, e, r)) == {6: {1, 2, 4}, 7: {2, 4}}
    assert counts(analysis.liveness_instances(n, e, r)) == {6: (3, 3), 7: (2, 2)}


def test_liveness_steps_of_many_branches(spark):
    turns = range(1, 61, 3)  # 20 diamonds: a queue of single entries would hold four million
    n, e = build(spark, "I" * 61, " ".join(f"c:{i}>{i + 1} c:{i}>{i + 2} c:{i + 1}>{i + 3} c:{i + 2}>{i + 3}" for i in turns))
    out = spark.createDataFrame([(1, 1, 61), (1, 1, 3)], "graph_id long, node_id long, variable long")
    assert counts(analysis.liveness_instances(n, e, roots(spark, 1), out)) == {1: (2, 41)}


def test_liveness_steps_follow_the_queue(spark):
    rnd = random.Random(3)
    for _ in range(3):
        pairs = [(rnd.choice("cd"), rnd.randrange(1, 13), rnd.randrange(1, 13)) for _ in range(22)]
        n, e = build(spark, "I" * 12, " ".join(f"{f}:{a}>{b}" for f, a, b in pairs))
        lives = {r: set(rnd.sample(range(1, 13), 3)) for r in range(1, 13)}
        expected = {}
        for r, live in lives.items():
            deepest, seen, queue = 0, set(), [(r, 1)]
            for node, depth in queue:
                seen.add(node)
                deepest = max(deepest, depth) if node in live else deepest
                queue += [(b, depth + 1) for flow in "cd" for f, a, b in pairs if f == flow and a == node and b not in seen]
            expected[r] = (3, deepest)
        out = spark.createDataFrame([(1, r, v) for r, live in lives.items() for v in live], "graph_id long, node_id long, variable long")
        assert counts(analysis.liveness_instances(n, e, roots(spark, *lives), out)) == expected


@pytest.mark.parametrize(("first", "uses", "expected"), [("mul", "d:4>10@0 d:5>10@1", [[9, 10]]), ("sdiv", "d:5>10@0 d:4>10@1", []), ("mul", "d:5>10@0 d:4>10@1", [[9, 10]])])
def test_common_subexpressions(spark, first, uses, expected):
    texts = ["t0", "t1", "a", "b", "c", "d", "e", "g", first, first, "add", "mul"]
    n, e = build(spark, "VVVVVVVVIIII", f"c:0>9 c:9>10 c:10>11 c:11>12 d:9>1 d:10>2 d:11>3 d:11>6 d:4>9@0 d:5>9@1 {uses} d:1>11@0 d:8>11@1 d:2>12@0 d:7>12@1", texts)
    assert [r.members for r in analysis.expression_sets(n, e).collect()] == expected
    if expected:
        r = roots(spark, 9)
        assert labels(analysis.subexpressions(n, e, r)) == {9: {9, 10}}
        assert counts(analysis.subexpressions_instances(n, e, r)) == {9: (2, 2)}


def test_root_sample_is_a_tenth(spark):
    n, _ = build(spark, "I" * 25, "")
    found = analysis.sample_roots(analysis.eligible(n, 0)).collect()
    assert len(found) == 3 and all(r.root for r in found)
    assert found == analysis.sample_roots(analysis.eligible(n, 0)).collect()


def test_run_by_name(spark):
    n, e = build(spark, "VVVVVIIII", WIKI)
    for name in analysis.ANALYSES:
        found, instances = analysis.run(name, n, e)
        assert found.columns == ["graph_id", "root", "node_id", "is_root", "value"] and "step_count" in instances.columns
    with pytest.raises(ValueError):
        analysis.run("nothing", n, e)


def test_packed_and_level_by_level_closures_agree(spark):
    rnd = random.Random(3)
    edges = spark.createDataFrame([(g, rnd.randrange(12), rnd.randrange(12)) for g in range(6) for _ in range(20)], "graph_id long, source long, target long")
    starts = spark.createDataFrame([(g, s, s) for g in range(6) for s in (1, 5)], "graph_id long, root long, node_id long")
    blocked = spark.createDataFrame([(g, 1, 3) for g in range(6)], "graph_id long, root long, node_id long")
    for stop in (None, blocked):
        small = {tuple(r) for r in fixpoint.closure(edges, starts, stop).collect()}
        large = {tuple(r) for r in fixpoint.closure(edges, starts, stop, most_edges=3).collect()}
        assert small == large and len(small) > 12


def test_packed_and_counted_predecessors_agree(spark):
    rnd = random.Random(8)
    edges = spark.createDataFrame([(g, s, t) for g in range(8) for t in range(1, 10) for s in rnd.sample(range(10), rnd.randint(0, 3))], "graph_id long, source long, target long")
    starts = spark.createDataFrame([(g, r, r) for g in range(8) for r in (0, 2)], "graph_id long, root long, node_id long")
    nodes = spark.createDataFrame([(g, i, 0) for g in range(8) for i in range(10)], "graph_id long, node_id long, type long")
    small = sorted(map(str, fixpoint.all_predecessors(edges, starts, nodes).collect()))
    large = sorted(map(str, fixpoint.all_predecessors(edges, starts, nodes, most_edges=15).collect()))
    assert small == large and len(small) == 160 and sum("depth=0" in x for x in small) > 16


def test_packed_and_joined_liveness_agree(spark):
    rnd = random.Random(4)
    kinds = [0, 0, 0, 0, 0, 0, 1, 1, 1, 2]
    nodes = spark.createDataFrame([(g, i, k) for g in range(6) for i, k in enumerate(kinds)], "graph_id long, node_id long, type long")
    ends = lambda f: (rnd.randrange(6), rnd.randrange(6)) if f == 0 else rnd.choice([(rnd.randrange(1, 6), rnd.randrange(6, 9)), (rnd.randrange(6, 10), rnd.randrange(1, 6))])
    rows = [(g, i, f, 0, *ends(f)) for g in range(6) for i in range(14) for f in (rnd.randrange(2),)]
    edges = spark.createDataFrame(rows, "graph_id long, edge_id long, flow long, position long, source long, target long")
    for outs in (False, True):
        small = sorted(analysis._live(nodes, edges, outs).collect())
        assert small == sorted(analysis._live(nodes, edges, outs, most_edges=13).collect()) == sorted(analysis._live(nodes, edges, outs, most_states=1).collect())
        assert len(small) > 10


def test_ids_may_be_any_long(spark):
    """As hashes of paths are."""
    n, e = build(spark, "VVVVVIIII", WIKI)
    large = F.xxhash64(F.lit("a/b.ll"))
    n, e = n.withColumn("graph_id", large), e.withColumn("graph_id", large)
    for name in analysis.ANALYSES:
        found, instances = analysis.run(name, n, e)
        assert found.count() % 10 == 0 and instances.count() <= 1
    split = statistics.random_split(spark.range(-500, 500).select(F.xxhash64("id").alias("key")), "key")
    assert {r.split: r["count"] > 100 for r in split.groupBy("split").count().collect()} == {"train": True, "val": True, "test": True}


def test_large_graphs_are_closed_quickly(spark):
    """20 graphs of 600 nodes: chains with forks and loops."""
    n = 300
    steps = [(0, i, i + 1) for i in range(1, n)] + [(0, i, i + 7) for i in range(1, n - 7, 3)] + [(0, i, i - 20) for i in range(30, n, 25)]
    data = [(1, i, n + i) for i in range(1, n + 1)] + [(1, n + 1 + i * 7 % i, i) for i in range(2, n + 1)] + [(1, n + max(1, i - 5), i) for i in range(2, n + 1)]
    nodes = spark.range(20).selectExpr("id AS graph_id", f"explode(sequence(0L, {2 * n}L)) AS node_id").selectExpr("*", f"CAST(node_id > {n} AS LONG) AS type", "'x' AS text")
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(steps + data)], "edge_id long, flow long, source long, target long")
    edges = spark.range(20).selectExpr("id AS graph_id").join(F.broadcast(rows)).withColumn("position", F.lit(0).cast("long"))
    began = time.time()
    labels, instances = analysis.run("liveness", nodes, edges)
    assert labels.count() == 20 * 10 * (2 * n + 1) and instances.count() == 200
    assert time.time() - began < 60


def test_no_rows(spark):
    n, e = build(spark, "I", "c:0>1")
    none = roots(spark, 1).limit(0)
    assert analysis.reachability(n, e, none).count() == 0
    assert analysis.live_in(n, e.limit(0)).count() == 0
