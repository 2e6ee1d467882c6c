"""Chains, strongly connected components and cycles against plain searches."""

import random

import pytest

from loomwright.operators import graphs


def _reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, todo = set(), list(after[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[a] = seen
    return out


def _components(edges):
    reach = _reach(edges)
    on = {a for a in reach if a in reach[a]}
    return {a: min(b for b in on if b in reach[a] and a in reach[b]) for a in on}


@pytest.mark.parametrize("seed,nodes,n", [(1, 30, 25), (2, 40, 60), (3, 12, 40), (4, 60, 62)])
def test_components_by_plain_search(spark, seed, nodes, n):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
    # a circle of its own, a loop at one of its nodes, a long way round and a tail
    edges += [(100, 101), (101, 102), (102, 100), (101, 101), (0, 200), (200, 201), (201, 202), (202, 0), (202, 300), (300, 301)]
    df = spark.createDataFrame(edges + [(None, 1), (1, None), edges[0]], "src long, dst long")
    found = [(r.node, r.component) for r in graphs.strong_components(df).collect()]
    assert len(found) == len(dict(found)) and dict(found) == _components(edges)


def test_components_of_nothing(spark):
    assert graphs.strong_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    assert graphs.strong_components(spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).collect() == []


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """100,000 nodes in a row: rounds grow with the logarithm."""
    n, rounds = 100_000, []
    plain = graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, label, **k: rounds.append(label) or plain(df, label, **k))
    edges = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    found = graphs.walk(edges, spark.createDataFrame([(0,), (99_990,), (None,)], "start long"))
    assert found.selectExpr("count(*)", "max(depth)", "sum(depth)").first()[:] == (n + 1 + 11, n, n * (n + 1) // 2 + 55)
    assert rounds.count("walk") < 20


def test_chains_end_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "src long, dst long")
    found = {(r.start, r.node): r.depth for r in graphs.chains(edges, spark.createDataFrame([(9,), (2,)], "start long")).collect()}
    assert found == {(9, 9): 0, (9, 1): 1, (9, 2): 2, (9, 3): 3, (2, 2): 0, (2, 3): 1, (2, 1): 2}


def test_long_circle(spark):
    n = 3000
    edges = spark.range(n).selectExpr("id + 5 as src", f"(id + 1) % {n} + 5 as dst")
    assert graphs.strong_components(edges).selectExpr("count(*)", "min(component)", "max(component)").first()[:] == (n, 5, 5)


def test_cycles_come_once(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (4, 1), (3, 2), (5, 6)]
    found = sorted(tuple(r.cycle) for r in graphs.cycles(spark.createDataFrame(edges, "src long, dst long"), 3).collect())
    assert found == [(1, 2), (1, 2, 3), (2, 3), (3,)]
    assert [tuple(r.cycle) for r in graphs.cycles(spark.createDataFrame(edges, "src long, dst long"), 1).collect()] == [(3,)]
