"""Walks in the order of a queue: kernels and joins against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import analysis, transforms

EDGES = "graph_id long, edge_id long, flow long, position long, source long, target long"


def some_edges(rnd, graphs=6, n=14, flows=(0, 0, 0, 1, 2)):
    rows = []
    for g in range(graphs):
        for i in range(3 * n):
            flow = rnd.choice(flows)
            rows.append((g, i, flow, 0, 0 if flow == 2 else rnd.randrange(1, n), rnd.randrange(1, n)))
    return rows


def walk(rows, graph, most=10**6):
    edges = sorted(r for r in rows if r[0] == graph)
    seen = {}
    for start in (r[5] for r in edges if r[2] == 2 and r[4] == 0):
        queue = [start]
        for node in queue:
            if node not in seen and len(seen) < most:
                seen[node] = None
                queue += [r[5] for r in edges if r[2] == 0 and r[4] == node and r[5] not in seen]
    return list(seen)


def test_sequences(spark):
    rows = some_edges(random.Random(5))
    df = spark.createDataFrame(rows, EDGES).coalesce(2)
    want = {g: walk(rows, g) for g in range(6)}
    assert {r.graph_id: r.node_ids for r in transforms.instruction_sequence(df, 4).collect()} == {g: nodes[:4] for g, nodes in want.items()}
    assert {r.graph_id: r.node_ids for r in transforms.instruction_sequence(df).collect()} == want
    by_joins = transforms.instruction_sequence(df, 9, most_edges=20).collect()
    assert {r.graph_id: r.node_ids for r in by_joins} == {g: nodes[:9] for g, nodes in want.items()}
    placed = transforms.instruction_order(df).collect()
    assert {(r.graph_id, r.place): r.node_id for r in placed} == {(g, i): x for g, nodes in want.items() for i, x in enumerate(nodes)}


def test_a_large_tree_without_a_row_that_holds_it(spark):
    n = 30_000
    edges = spark.range(1, n).selectExpr("1L AS graph_id", "id AS edge_id", "0L AS flow", "0L AS position", "(id + 9) DIV 10 AS source", "id + 1 AS target")
    edges = edges.unionByName(spark.createDataFrame([(1, 0, 2, 0, 0, 1)], EDGES))
    found = transforms.instruction_order(edges, most_edges=1000)
    assert found.count() == n and found.where("node_id <> place + 1").count() == 0


def test_liveness_steps_of_large_graphs(spark):
    rnd = random.Random(9)
    rows = some_edges(rnd, flows=(0, 1))
    df = spark.createDataFrame(rows, EDGES)
    lives = [(g, r, v) for g in range(6) for r in (1, 4, 7) for v in rnd.sample(range(1, 14), 3)]
    out = spark.createDataFrame(lives, "graph_id long, node_id long, variable long")
    roots = spark.createDataFrame([(g, r) for g in range(6) for r in (1, 4, 7, 9)], "graph_id long, root long")
    want = {}
    for g in range(6):
        edges = sorted(r for r in rows if r[0] == g)
        for root in (1, 4, 7, 9):
            live = {v for a, b, v in lives if (a, b) == (g, root)}
            deepest, seen = 0, set()
            level, depth = {root: None}, 1
            while level:
                below = {}
                for node in level:
                    seen.add(node)
                    deepest = depth if node in live else deepest
                    below |= dict.fromkeys(e[5] for flow in (0, 1) for e in edges if e[2] == flow and e[4] == node and e[5] not in seen)
                level, depth = below, depth + 1
            want[g, root] = (deepest, len(live))
    for most_edges in (10**6, 3):
        got = analysis.liveness_instances(None, df, roots, out, most_edges=most_edges).collect()
        assert {(r.graph_id, r.root): (r.step_count, r.active_node_count) for r in got} == want


def sweeps(kinds, rows, root, most):
    """As sets, one node after the other."""
    scope = [i for i, k in kinds.items() if i and kinds[root][1] == k[1] and (k[0] < 2 or k[1] == 0)]
    sets = {i: set(scope) - {root} for i in scope} | {root: {root}}
    updates, again = 0, True
    while again and updates <= most:
        again = False
        for i in scope:
            before = [r[4] for r in rows if r[2] == 0 and r[5] == i]
            new = ({i} | set.intersection(*[sets.get(p, set()) for p in before])) if before else {i}
            if i != root and new != sets[i]:
                sets[i], again, updates = new, True, updates + 1
    return (updates, sum(root in sets[i] and kinds[i][0] == 0 for i in scope), "ok") if updates <= most else (None, None, "not_converged")


@pytest.mark.parametrize(("dense", "most"), [(4096, 1000), (4, 1000), (4096, 9), (4, 9)])
def test_dominance_steps(spark, monkeypatch, dense, most):
    from weftgraph.plans import kernels

    rnd = random.Random(dense + most)
    rows, kinds = [], {}
    for g in range(8):
        n = rnd.choice([3, 9, 40, 90])
        kinds[g] = {i: (rnd.choice([0, 0, 0, 1, 2]), rnd.choice([0, 1])) for i in range(n)}
        kinds[g][1] = (0, 1)
        rows += [(g, i, rnd.choice([0, 0, 1]), 0, rnd.randrange(n), rnd.randrange(n)) for i in range(rnd.choice([n, 2 * n]))]
    nodes = spark.createDataFrame([(g, i, k, f) for g, found in kinds.items() for i, (k, f) in found.items()], "graph_id long, node_id long, type long, function long")
    asked = [(g, i) for g, found in kinds.items() for i, (k, _) in found.items() if i and k == 0]
    roots = spark.createDataFrame(asked, "graph_id long, root long")
    edges = spark.createDataFrame(rows, EDGES)
    # kernels run in other processes: what they are bound to is set where they are made
    def kernel(updates):
        inner = kernels.dominators_kernel(updates)

        def bound(batches):
            kernels.MOST_DENSE = dense
            return inner(batches)

        return bound

    monkeypatch.setattr(analysis, "dominators_kernel", kernel)
    got = analysis.dominance_instances(nodes, edges, roots, most).collect()
    want = {(g, r): sweeps(kinds[g], [x for x in rows if x[0] == g], r, most) for g, r in asked}
    assert {(r.graph_id, r.root): (r.step_count, r.active_node_count, r.status) for r in got} == want


def test_a_set_of_many_members(spark):
    n = 100_000
    nodes = spark.range(n + 1).selectExpr("1L AS graph_id", "id AS node_id", "IF(id = 1, 1L, 0L) AS type", "'add' AS text")
    edges = spark.range(2, n + 1).selectExpr("1L AS graph_id", "id AS edge_id", "1L AS flow", "0L AS position", "1L AS source", "id AS target")
    roots = spark.createDataFrame([(1, 2), (1, 3)], "graph_id long, root long")
    found = analysis.subexpressions(nodes, edges, roots)
    assert found.groupBy("root").agg(F.sum("value").alias("n"), F.sum("is_root").alias("r")).where(f"n = {n - 1} AND r = 1").count() == 2
    assert [tuple(r) for r in analysis.subexpressions_instances(nodes, edges, roots).orderBy("root").collect()] == [(1, 2, 2, n - 1), (1, 3, 2, n - 1)]
