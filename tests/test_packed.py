from __future__ import annotations

import random

import numpy as np
import pytest

from citeloom.operators import graph as G
from citeloom.operators import packed as P


def sparse(n, m, seed):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def brute_paths(pairs, source):
    """node: (distance, paths) and the levels."""
    found, front = {source: (0, 1)}, {source: 1}
    while front:
        new = {}
        for a, b in pairs:
            if a in front and b not in found:
                new[b] = new.get(b, 0) + front[a]
        depth = 1 + max(d for d, _ in found.values())
        found |= {x: (depth, n) for x, n in new.items()}
        front = new
    return found


def packed(pairs):
    ids = np.unique(np.array(pairs).ravel())
    a, b = (np.searchsorted(ids, [p[i] for p in pairs]).astype(np.int32) for i in (0, 1))
    return P.Graph(ids, a, b)


@pytest.mark.parametrize(("n", "m", "piece"), [(40, 60, 1 << 19), (60, 400, 7), (30, 500, 1)])
def test_searches_against_brute_force(monkeypatch, n, m, piece):
    """Levels along and against the edges, in pieces of any size."""
    monkeypatch.setattr(P, "PIECE", piece)
    pairs = sparse(n, m, n)
    g = packed(pairs)
    for at, source in enumerate(g.ids.tolist()):
        distance, paths, _ = P.search(g, at, None)
        want = brute_paths(pairs, source)
        assert {x: (d, p) for x, d, p in zip(g.ids.tolist(), distance.tolist(), paths.tolist(), strict=True) if d >= 0} == want
        near = P.search(g, at, 2)[0]
        assert {x for x, d in zip(g.ids.tolist(), near.tolist(), strict=True) if d >= 0} == {x for x, (d, _) in want.items() if d <= 2}


def test_more_paths_than_a_long_holds_are_an_error():
    """70 diamonds one behind the other: 2^70 paths."""
    pairs = sorted(x for i in range(0, 210, 3) for x in ((i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3)))
    assert P.search(packed(pairs[: 4 * 62]), 0, None)[1].max() == 1 << 62
    with pytest.raises(ArithmeticError):
        P.search(packed(pairs), 0, None)


def test_closeness_writes_no_levels(spark, rows, monkeypatch):
    pairs = sparse(30, 90, 2)
    source = pairs[0][0]
    write, written = G.materialise, []
    monkeypatch.setattr(G, "materialise", lambda df: written.append(df.columns) or write(df))
    got = rows(G.closeness(spark.createDataFrame(pairs, "citing long, cited long"), spark.createDataFrame([(source,), (99,)], "node long")))
    near = [d for d, _ in brute_paths(pairs, source).values()]
    assert got == [(source, len(near) - 1, pytest.approx((len(near) - 1) / sum(near)))] and written == [["citing", "cited"]]


def test_shares_against_brute_force():
    """Of all paths through a node and on to another one, listed."""
    pairs = sparse(14, 40, 6)
    g = packed(pairs)
    for at, source in enumerate(g.ids.tolist()):
        near = brute_paths(pairs, source)
        want = dict.fromkeys(g.ids.tolist(), 0.0)
        for mid in near:
            beyond = brute_paths(pairs, mid)
            for end, (d, n) in near.items():
                if end != mid and end in beyond and near[mid][0] + beyond[end][0] == d:
                    want[mid] += near[mid][1] * beyond[end][1] / n
        assert dict(zip(g.ids.tolist(), P.shares(g, *P.search(g, at, None)).tolist(), strict=True)) == pytest.approx(want)


def test_packed_and_joined_agree(spark, rows, monkeypatch):
    """Also for sources outside the graph and links without an end. The packed searches write the links and no level."""
    pairs = [*sparse(30, 90, 2), (3, None), (None, 4), (1, 2), (1, 2)]
    e = spark.createDataFrame(pairs, "citing long, cited long").coalesce(2)
    s = spark.createDataFrame([(i,) for i in (0, 1, 2, 2, 5, 99)], "node long").coalesce(1)
    write, written = G.materialise, []
    monkeypatch.setattr(G, "materialise", lambda df: written.append(df.columns) or write(df))
    got = [rows(f(e, s)) for f in (G.shortest_paths, G.closeness, G.betweenness)]
    assert written == [["citing", "cited"]] * 3
    monkeypatch.setattr(G, "PACKED_EDGES", 0)
    for a, b in zip(got, [rows(f(e, s)) for f in (G.shortest_paths, G.closeness, G.betweenness)], strict=True):
        assert len(a) == len(b) > 0 and all(x == pytest.approx(y) for x, y in zip(a, b, strict=True))
    text = rows(G.shortest_paths(spark.createDataFrame([("a", "b")], "citing string, cited string"), spark.createDataFrame([("a",)], "node string")))
    assert text == [("a", "a", 0, 1), ("a", "b", 1, 1)]
    empty = spark.createDataFrame([], "citing long, cited long")
    monkeypatch.undo()
    assert rows(G.shortest_paths(empty, s)) == [(i, i, 0, 1) for i in (0, 1, 2, 5, 99)]
    assert rows(G.closeness(empty, s)) == rows(G.betweenness(empty, s)) == rows(G.shortest_paths(e, s.limit(0))) == []
