"""Graph operators on small graphs, by hand and against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from stratalog.operators import graph as G
from stratalog.operators import kernels as K
from stratalog.operators.components import connected_components


def edges(spark, pairs, kind="string", group=True):
    rows = [("g", *p) for p in pairs] if group else list(pairs)
    return spark.createDataFrame(rows, f"{'g string, ' if group else ''}src {kind}, dst {kind}")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def random_edges(seed, n=14, m=22):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def closure(pairs):
    out = set(pairs)
    while True:
        new = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not new:
            return out
        out |= new


def parts(nodes, pairs):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("seed", range(3))
def test_components_closure_and_strong_components(spark, seed):
    pairs = random_edges(seed)
    df = edges(spark, pairs, "long", False)
    proper = [(a, b) for a, b in pairs if a != b]
    assert rows(connected_components(df), "node", "root") == sorted(parts({x for p in proper for x in p}, proper).items())
    paths = closure(pairs)
    assert rows(G.transitive_closure(df), "src", "dst") == sorted(paths)
    strong = {}
    for a, b in paths:
        if a != b and (b, a) in paths:
            strong[a] = min(strong.get(a, a), b)
    assert rows(G.strong_components(df), "node", "component") == sorted(strong.items())
    assert rows(G.strong_components(df, one_task=0), "node", "component") == sorted(strong.items())
    assert rows(K.strong_components_in_task(edges(spark, pairs, "long")), "node", "component") == sorted(strong.items())


def test_long_chain_of_components(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001), (None, 5), (7, 7)]
    found = dict(rows(connected_components(edges(spark, pairs, "long", False)), "node", "root"))
    assert {found[i] for i in range(201)} == {0} and found[1001] == 1000 and len(found) == 203
    assert connected_components(edges(spark, [], "long", False)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_articulation_points(spark, seed):
    pairs = [(a, b) for a, b in random_edges(seed + 10, 12, 16) if a != b]
    nodes = {x for p in pairs for x in p}

    def count(without=None):
        left = nodes - {without}
        return len(set(parts(left, [p for p in pairs if without not in p]).values()))

    whole = count()
    truth = sorted((n, count(n)) for n in nodes if count(n) > whole)
    assert rows(K.articulation_points(edges(spark, pairs, "long")), "node", "severity") == truth


def test_articulation_by_hand(spark):
    assert rows(K.articulation_points(edges(spark, ["AB", "BC"])), "node", "severity") == [("B", 2)]
    assert rows(K.articulation_points(edges(spark, ["AB", "BC", "CD", "DE"])), "node") == [("B",), ("C",), ("D",)]


def test_min_cut_by_hand_and_by_enumeration(spark):
    rng = random.Random(3)
    for _ in range(4):
        home = {n: "PQ"[n % 2] for n in range(8)}
        pairs = sorted({tuple(sorted(rng.sample(range(8), 2))) for _ in range(12)})
        sources, sinks = [n for n in home if home[n] == "P"], [n for n in home if home[n] == "Q"]
        least = sum(home[a] != home[b] for a, b in pairs)  # all nodes are terminals: the crossing edges
        df = spark.createDataFrame([("g", a, b, home[a], home[b]) for a, b in pairs], "g string, src long, dst long, ps string, pd string")
        assert rows(K.package_min_cut(df), "a", "b", "cut") == [("P", "Q", least)] and sources and sinks
    # free nodes between the packages: all cuts are tried
    pairs = [("p", "x"), ("p", "y"), ("x", "z"), ("y", "z"), ("z", "q"), ("x", "q")]
    adj: dict = {}
    for a, b in pairs:
        adj.setdefault(a, {})[b] = 1
        adj.setdefault(b, {})[a] = 1
    best = min(sum((a in side) != (b in side) for a, b in pairs) for n in range(4) for own in itertools.combinations("xyz", n) for side in [{"p", *own}])
    assert K.max_flow(adj, ["p"], ["q"]) == best == 2


def test_spectral_value_is_the_largest_eigenvalue():
    adj = K._adjacency(__import__("pandas").DataFrame([(i, i + 1) for i in range(5)], columns=["src", "dst"]))
    lap = np.diag([1, 2, 2, 2, 2, 1]) - np.diag([1] * 5, 1) - np.diag([1] * 5, -1)
    assert K.laplacian_quotient(adj) == pytest.approx(np.linalg.eigvalsh(lap)[-1], abs=1e-6) == pytest.approx(3.732, abs=1e-3)


def test_spectral_scopes_need_three_nodes(spark):
    assert K.spectral_scopes(edges(spark, ["AB"])).count() == 0
    assert rows(K.spectral_scopes(edges(spark, ["AB", "BC"])), "nodes", "edges", "lambda_x1000") == [(3, 2, 3000)]


def test_persistence_by_hand(spark):
    data = [("a", "b", 100), ("b", "c", 100), ("x", "y", 80), ("y", "z", 80), ("c", "x", 2)]
    df = spark.createDataFrame([("g", *r) for r in data], "g string, src string, dst string, w long")
    found = rows(K.persistence(df), "rep", "birth", "death", "persistence", "size")
    assert ("x", 80, 2, 78, 3) in found and len(found) == 2 and found[0][1:4] == (100, 0, 100)


def test_hitting_times_by_hand(spark):
    found = {(r["src"], r["dst"]): r["steps_x1000"] for r in K.hitting_times(edges(spark, ["AB", "BC"])).collect()}
    assert found["A", "B"] == 1000 and found["A", "C"] == 2000 and found["B", "C"] == 1000
    assert found["C", "A"] == found["C", "B"] == 200_000, "what cannot be reached ends at the number of sweeps"


def test_louvain_finds_two_cliques(spark):
    clique = lambda names: list(itertools.combinations(names, 2))
    pairs = clique("abcd") + clique("wxyz") + [("d", "w")]
    found = dict(rows(K.communities(edges(spark, pairs)), "node", "community"))
    assert {found[n] for n in "abcd"} == {"a"} and {found[n] for n in "wxyz"} == {"w"}
    member = spark.createDataFrame(list(found.items()), "node string, community string")
    q = G.modularity(edges(spark, pairs, group=False), member).head()["modularity_x1000"]
    m = len(pairs)
    assert q == int(np.floor(1000 * (2 * 6 / m - 2 * (13 / (2 * m)) ** 2) + 0.5))


def test_structure_matrix_and_back_edges(spark):
    pairs = ["AB", "BC", "CB", "CD", "XA"]
    order = K.structure_matrix(edges(spark, pairs))
    assert rows(order, "position", "node", "level") == [(0, "X", 0), (1, "A", 1), (2, "B", 2), (3, "C", 2), (4, "D", 3)]
    assert rows(K.back_edges(edges(spark, pairs), order), "src", "dst") == [("C", "B")]


@pytest.mark.parametrize("seed", range(2))
def test_ranks_sum_to_one(spark, seed):
    pairs = [p for p in random_edges(seed + 30) if p[0] != p[1]]
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(8):
        lost = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a in nodes for b in out[a] if b == n) + lost / len(nodes)) for n in nodes}
    found = dict(rows(G.pagerank(edges(spark, pairs, "long", False), 8), "node", "rank"))
    assert sum(found.values()) == pytest.approx(1) and all(found[n] == pytest.approx(rank[n]) for n in nodes)


def test_personalized_rank(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "a", 1.0), ("a", "d", 0.3)], "src string, dst string, w double")
    focus = spark.createDataFrame([("d", 100.0)], "node string, boost double")
    found = dict(rows(G.personalized_pagerank(df, focus), "node", "rank"))
    assert sum(found.values()) == pytest.approx(1, abs=1e-6) and found["d"] > 0.15
    even = dict(rows(G.personalized_pagerank(df, focus.where("false")), "node", "rank"))
    assert even["d"] < found["d"]


def test_paths_reach_and_impact(spark):
    df = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a"), ("tests/t", "a"), ("x", "y")], group=False)
    seed = spark.createDataFrame([("a",)], "node string")
    assert rows(G.reach(df, seed), "node", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    paths = {r["node"]: r["path"] for r in G.shortest_paths(df, seed).collect()}
    assert paths["d"] == ["a", "c", "d"] and "b" not in paths, "one step away is no path"
    hit = rows(G.affected(df, spark.createDataFrame([("c",), ("gone",)], "node string"), 1), "node", "is_test")
    assert ("b", False) in hit and ("a", False) in hit and ("tests/t", True) not in hit
    assert ("tests/t", True) in rows(G.affected(df, seed), "node", "is_test")


def test_cycle_record_id(spark):
    import hashlib

    member = spark.createDataFrame([("b", "a"), ("a", "a"), ("c", "a")], "node string, component string")
    assert rows(G.cycle_records(member), "id", "size") == [(hashlib.sha1(b"a|b|c").hexdigest()[:12], 3)]


def test_event_chains(spark):
    emits = spark.createDataFrame([("f1", "e1"), ("f2", "e2"), ("f3", "e3"), ("f4", "e4")], "file string, event string")
    listens = spark.createDataFrame([("e1", "f2"), ("e2", "f3"), ("e3", "f4"), ("e4", "f1")], "event string, file string")
    chains = [tuple(r["events"].split(">")) for r in G.event_chains(emits, listens).collect()]
    assert ("e1", "e2", "e3") in chains and all(len(c) <= 3 for c in chains)


def test_module_ranks_stand_to_all_digits(spark):
    """A star of many leaves: the sum of movements is small long before the leaves' ranks stand to six digits of the largest."""
    pairs = [(a, f"p{a[1:]}{i}") for a in (f"s{j}" for j in range(40)) for i in range(3)] + [(f"s{j}", "hub") for j in range(0, 40, 7)] + [(f"s{j}", f"s{j + 1}") for j in range(39)]
    nodes = sorted({n for p in pairs for n in p})
    at, n = {x: i for i, x in enumerate(nodes)}, len(nodes)
    out = np.bincount([at[a] for a, _ in pairs], minlength=n)
    m = np.zeros((n, n))
    for a, b in pairs:
        m[at[b], at[a]] = 1 / out[at[a]]
    m[:, out == 0] = 1 / n
    truth = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    for tolerance in (1e-6, 1e-2):
        found = dict(rows(G.module_ranks(edges(spark, pairs, group=False), tolerance=tolerance), "node", "rank"))
        assert max(abs(found[x] - truth[at[x]] / truth.max()) for x in nodes) <= 5.1e-7


@pytest.mark.parametrize(("seed", "one_task"), [(3, 0), (4, 0), (5, 6)])
def test_structure_matrix_of_a_large_graph_is_that_of_one_task(spark, seed, one_task, monkeypatch):
    rng = random.Random(seed)
    pairs = [*random_edges(seed, 12, 14), *((b, a) for a, b in itertools.combinations(range(20, 26), 2) if rng.random() < 0.4), (30, 30)]
    both = edges(spark, pairs, "long").unionByName(spark.createDataFrame([("h", 2, 1)], "g string, src long, dst long"))
    known = rows(K.structure_matrix(both), "g", "position", "node", "level")
    held, own = [], K.structure_matrix
    monkeypatch.setattr(G, "structure_matrix_in_task", lambda e, group: held.append(e.groupBy(group).count().agg({"count": "max"}).head()[0] or 0) or own(e, group))
    assert rows(G.structure_matrix(both, one_task=one_task), "g", "position", "node", "level") == known
    assert max(held) <= one_task, "a task held a larger graph"


def test_structure_matrix_of_names(spark):
    pairs = [(f"c{i}", f"n{i % 3}") for i in range(30)] + [(f"n{i}", "a") for i in range(3)]
    df = edges(spark, pairs)
    assert rows(G.structure_matrix(df, one_task=8), "position", "node", "level") == rows(K.structure_matrix(df), "position", "node", "level")
