from __future__ import annotations

import random

import pytest

from citeloom.operators import clusters as K
from citeloom.operators import graph as G


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "citing long, cited long")


def sparse(n, m, seed):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def brute_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted(((x, find(x)) for x in list(parent)), key=repr)


def brute_coreness(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        low = [x for x in near if len(near[x]) <= k]
        if not low:
            k += 1
            continue
        for x in low:
            for y in near.pop(x):
                if y in near:
                    near[y].discard(x)
            core[x] = k
    return sorted(core.items(), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_cores_against_brute_force(spark, rows, seed):
    pairs = sparse(40, 38, seed)
    assert rows(G.components(graph(spark, pairs))) == brute_components(pairs)
    pairs = sparse(20, 50, seed)
    assert rows(G.coreness(graph(spark, pairs))) == brute_coreness(pairs)


def test_components_of_a_long_chain_and_an_empty_graph(spark, rows):
    chain = [(i, i + 1) for i in range(60)]
    assert {r[1] for r in rows(G.components(graph(spark, chain)))} == {0}
    assert rows(G.components(graph(spark, []))) == []
    assert rows(G.components(graph(spark, [(3, 3)]))) == [(3, 3)]


def test_pagerank_against_brute_force(spark, rows):
    pairs = sparse(12, 30, 5)
    nodes = sorted({x for p in pairs for x in p})
    out = {x: [b for a, b in pairs if a == x] for x in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(200):
        lost = sum(rank[x] for x in nodes if not out[x])
        rank = {x: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[a] / len(out[a]) for a, b in pairs if b == x)) for x in nodes}
    got = dict(rows(G.pagerank(graph(spark, pairs), tolerance=1e-9)))
    assert sum(got.values()) == pytest.approx(1)
    assert all(got[x] == pytest.approx(rank[x], abs=1e-7) for x in nodes)


def test_shortest_paths_betweenness_closeness(spark, rows):
    #   0 -> 1 -> 3 -> 4 and 0 -> 2 -> 3
    e = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)])
    s = spark.createDataFrame([(0,)], "node long")
    assert rows(G.shortest_paths(e, s)) == [(0, 0, 0, 1), (0, 1, 1, 1), (0, 2, 1, 1), (0, 3, 2, 2), (0, 4, 3, 2)]
    got = dict(rows(G.betweenness(e, s)))
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0}
    assert rows(G.closeness(e, s)) == [(0, 4, pytest.approx(4 / 7))]
    t = spark.createDataFrame([(4,)], "node long")
    assert rows(G.bounded_paths(e, s, t, 4)) == [(1, 0), (2, 0), (3, 2), (4, 0)]
    assert rows(G.most_used_nodes(e, s, t, 3, 2)) == [(1, 1), (3, 2)]
    one = spark.createDataFrame([(1,)], "node long")
    assert rows(G.most_used_nodes(e, s, t, 3, 5, one)) == [(1, 1), (3, 1)]
    assert rows(G.through_flagged(e, s, t, one)) == [(0, 4, 3, 2, 1)]
    assert rows(G.through_flagged(e, s, t, spark.createDataFrame([(0,), (4,)], "node long"))) == [(0, 4, 3, 2, 0)]


def test_flagged_paths_within_a_bound_look_only_where_targets_are(spark, rows, monkeypatch):
    """The bound leaves out farther targets and nothing else, and levels hold no nodes that lead to no target in time."""
    pairs, sizes = sparse(40, 120, 4), []
    e, s, t, f = graph(spark, pairs), spark.range(0, 8).toDF("node"), spark.range(30, 36).toDF("node"), spark.range(5, 25, 3).toDF("node")
    every = rows(G.through_flagged(e, s, t, f))
    assert {r[2] for r in every} >= {1, 2, 3, 4} and any(0 < r[4] < r[3] for r in every)
    for bound in (0, 3):
        assert rows(G.through_flagged(e, s, t, f, bound)) == [r for r in every if r[2] <= bound]
    write = G.materialise

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "materialise", counted)
    # 0 -> 1 -> 2, and from 1 to a hundred others that go on
    pairs = [(0, 1), (1, 2)] + [x for i in range(10, 110) for x in ((1, i), (i, i + 100))]
    got = rows(G.through_flagged(graph(spark, pairs), *(spark.createDataFrame([(i,)], "node long") for i in (0, 2, 1)), 3))
    assert got == [(0, 2, 2, 1, 1)]
    assert max(sorted(sizes)[:-1]) <= 3  # all but the links


def test_long_chains_have_no_bound(spark, rows):
    """Farther than 20 steps, and a chain of components: nothing is left out."""
    e = graph(spark, [(i, i + 1) for i in range(45)])
    s = spark.createDataFrame([(0,)], "node long")
    assert rows(G.shortest_paths(e, s)) == sorted([(0, i, i, 1) for i in range(46)], key=repr)
    assert rows(G.shortest_paths(e, s, 3)) == [(0, i, i, 1) for i in range(4)]
    assert rows(G.closeness(e, s)) == [(0, 45, pytest.approx(45 / (45 * 46 / 2)))]
    assert {r["component"] for r in G.components(e).collect()} == {0}


def test_coreness_in_one_loop(spark, rows):
    rng = random.Random(3)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(200)) if a != b})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, k = {}, 1
    while near:
        low = [n for n, x in near.items() if len(x) < k]
        if not low:
            k += 1
            continue
        for n in low:
            want[n] = k - 1
            for x in near.pop(n):
                if x in near:
                    near[x].discard(n)
    assert dict(rows(G.coreness(graph(spark, pairs)))) == want
    assert G.coreness(graph(spark, [])).count() == 0


def test_relabel_counts_from_one(spark, rows):
    labelled, mapping = G.relabel(graph(spark, [(100, 7), (7, 50)]))
    assert rows(mapping) == [(100, 3), (50, 2), (7, 1)]
    assert rows(labelled) == [(1, 2), (3, 1)]


def clique(nodes):
    return [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]


TOYS = {
    "line": ([(i, i + 1) for i in range(5)], range(1, 6), {}),
    "clique of four with a tail": ([(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (3, 1), (3, 4), (3, 4), (4, 5)], range(6), {}),
    "one core": ([*clique(range(6)), *((i, 0) for i in range(6, 11)), (11, 0), (11, 1), (12, 0), (12, 1)], range(13), {0: ({0, 1, 2, 3, 4, 5}, {11, 12})}),
    "two cores": ([*clique(range(4, 10)), *clique(range(10, 16)), (0, 7), (0, 8), (0, 11), (0, 12), (1, 8), (1, 11), (2, 6), (2, 12), (2, 13), (2, 3)], range(16), {4: (set(range(4, 10)), {0}), 10: (set(range(10, 16)), {2})}),
}


@pytest.mark.parametrize("name", TOYS)
def test_parsing_of_the_toy_graphs(spark, name):
    pairs, nodes, want = TOYS[name]
    c = spark.createDataFrame([(0, n) for n in nodes], "cluster_no long, node long")
    got = {}
    for r in K.kmp_parse(graph(spark, pairs), c, 5, 2, skip_modularity=True).collect():
        got.setdefault(r["cluster_no"], (set(), set()))[0 if r["is_core"] else 1].add(r["node"])
    assert got == want


def test_validity_ikc_kc(spark, rows):
    pairs, nodes, _ = TOYS["two cores"]
    e = graph(spark, pairs)
    c = spark.createDataFrame([(0, n) for n in nodes], "cluster_no long, node long")
    for r in K.kmp_validity(e, K.kmp_parse(e, c, 5, 2), 5, 2).collect():
        assert (r["size"], r["core_size"], r["min_core_degree"]) == (7, 6, 5)
        assert r["k_valid"] and r["m_valid"] and r["p_valid"]
    assert {(r["cluster_no"], r["node"]) for r in K.ikc(e, 5).collect()} == {(4, n) for n in range(4, 10)} | {(10, n) for n in range(10, 16)} | {(n, n) for n in range(4)}
    tail = graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (9, 9)])
    assert rows(K.ikc(tail, 2)) == [(n, n, 0) for n in (1, 2, 3, 4, 9)]  # the triangle holds no more edges than by chance
    assert rows(K.ikc(graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (6, 7), (5, 7)]), 2)) == [(1, 1, 2), (1, 2, 2), (1, 3, 2), (4, 4, 0), (5, 5, 2), (5, 6, 2), (5, 7, 2)]
    assert {r["cluster_no"] for r in K.kc_clusters(e, 5).collect()} == {4, 10}


def test_cluster_sums_hold(spark):
    pairs = sparse(30, 120, 9)
    e = graph(spark, pairs)
    c = spark.createDataFrame([(n % 3, n) for n in range(30)], "cluster_no long, node long")
    m = K.modularity(e, c).collect()
    assert sum(r["d_s"] for r in m) == 2 * len(pairs)
    assert all(0 <= r["conductance"] <= 1 for r in K.conductance(e, c).collect())


def test_agglomerate_and_threshold(spark, rows):
    m = spark.createDataFrame([(1, 2, 5.0), (2, 3, 4.0), (1, 3, 3.0), (3, 4, 6.5)], "cluster_1 long, cluster_2 long, weight double")
    assert rows(K.agglomerate(m, 9)) == [(1, 3, 4, 5, 6.5), (2, 1, 2, 6, 5.0), (3, 5, 6, 7, 4.0)]
    assert rows(K.agglomerate(m, 2)) == [(1, 3, 4, 5, 6.5), (2, 1, 2, 6, 5.0)]
    p = spark.createDataFrame([(1, 2, 9.0), (2, 3, 8.0), (3, 4, 1.0), (5, 6, 7.0)], "cited_1 long, cited_2 long, v double")
    assert rows(K.threshold_clusters(p, "v", [0.25, 0.75], 3)) == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (5, 5, 1), (5, 6, 1)]


def test_agglomerate_against_greedy_merging(spark, rows):
    """Every step looks for the heaviest link anew and keeps the heavier of two merged links."""
    rng = random.Random(5)
    links = {}
    for _ in range(60):
        a, b = rng.randrange(14), rng.randrange(14)
        if a != b:
            links[(min(a, b), max(a, b))] = float(rng.randrange(1000))
    left, want, number = {k: (w, k) for k, w in links.items()}, [], max(b for _, b in links)
    for step in range(1, 14):
        if not left:
            break
        (a, b), (w, _) = min(left.items(), key=lambda x: (-x[1][0], x[1][1]))
        number += 1
        want.append((step, a, b, number, w))
        new = {}
        for (x, y), v in left.items():
            x, y = (number if x in (a, b) else x), (number if y in (a, b) else y)
            if x != y:
                key = (min(x, y), max(x, y))
                new[key] = min([new.get(key, v), v], key=lambda t: (-t[0], t[1]))
        left = new
    got = K.agglomerate(spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "cluster_1 long, cluster_2 long, weight double"), 13)
    assert rows(got) == sorted(want, key=repr)


def dense_mcl(pairs, rounds=200):
    nodes = sorted({n for p in pairs for n in p})
    m = {j: {i: 1.0 for i in nodes if i == j or (i, j) in pairs or (j, i) in pairs} for j in nodes}
    m = {j: {i: p / sum(c.values()) for i, p in c.items()} for j, c in m.items()}
    for _ in range(rounds):
        new = {}
        for j in nodes:
            c = {}
            for k, q in m[j].items():
                for i, p in m[k].items():
                    c[i] = c.get(i, 0.0) + p * q
            c = {i: p * p for i, p in c.items() if p > 1e-12}
            new[j] = {i: p / sum(c.values()) for i, p in c.items()}
        m = new
    name = {n: n for n in nodes}
    for _ in nodes:
        for j, c in m.items():
            h = max(c, key=lambda i: (round(c[i], 9), -i))
            name[j] = name[h] = min(name[j], name[h])
    return sorted((c, n) for n, c in name.items())


def test_mcl_keeps_the_nodes_of_a_dense_part(spark, rows):
    pairs = [*clique(range(120)), (119, 200), (200, 201), (201, 202), (200, 202)]
    got = rows(K.mcl(graph(spark, pairs)))
    assert sorted(n for _, n in got) == [*range(120), 200, 201, 202]
    assert {n for c, n in got if c == 0} == set(range(120))


def test_mcl_runs_until_nothing_changes(spark, rows):
    pairs = {(100 + i, 101 + i) for i in range(13)} | {(i, i + 1) for i in range(9)} | {(0, 20), (0, 21), (20, 21)}  # no ties
    e = graph(spark, sorted(pairs))
    assert sorted(rows(K.mcl(e, least=1e-9))) == dense_mcl(pairs)
    with pytest.raises(RuntimeError):
        K.mcl(e, max_rounds=2)
