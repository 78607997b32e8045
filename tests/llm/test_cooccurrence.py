from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from citeloom.llm.cooccurrence import basket_pairs, collapsed_baskets, cooccurrences, counts_by_group, distinct_memberships


def memberships(spark, data):
    return distinct_memberships(spark.createDataFrame(data, "scp long, ref long, __basket string, __items long"), "scp", "ref")


def brute(data):
    baskets = {}
    for b, i, *_ in data:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    single = Counter(i for s in baskets.values() for i in s)
    pairs = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    return single, pairs, len(baskets)


def data(seed, baskets=60, items=25, hot=True):
    rng = random.Random(seed)
    rows = [(b, rng.randrange(items), "x", 1) for b in range(baskets) for _ in range(rng.randrange(9))]
    rows += [(b, 3, None, None) for b in range(baskets) if hot and b % 3]
    rows += [(b % 5 + 1000, i, None, None) for b in range(10) for i in (1, 2, 3)]  # equal baskets, rows repeated
    return rows + rows[:20] + [(None, 1, "", 0), (5, None, "", 0), (None, None, "", 0)]


@pytest.mark.parametrize("block", [2, 3, 256])
@pytest.mark.parametrize(("least", "lift"), [(1, 0.0), (2, 0.0), (3, 1.5)])
def test_against_brute_force(spark, block, least, lift):
    rows = data(7)
    single, pairs, n = brute(rows)
    got = {(r["item_1"], r["item_2"]): r for r in cooccurrences(memberships(spark, rows), least, lift, block).collect()}
    want = {p: c for p, c in pairs.items() if c >= least and c * n / (single[p[0]] * single[p[1]]) >= lift}
    assert {p: r["n"] for p, r in got.items()} == want
    for (a, b), r in got.items():
        assert (r["n_1"], r["n_2"], r["n_baskets"]) == (single[a], single[b], n)
        assert r["lift"] == pytest.approx(r["n"] * n / (single[a] * single[b]))
        if r["n"] == single[a]:
            assert r["conviction_12"] is None
        else:
            assert r["conviction_12"] == pytest.approx((1 - single[b] / n) / (1 - r["n"] / single[a]))


def test_one_basket_with_most_rows(spark):
    rows = [(1, i, "", 0) for i in range(300)] + [(b, i, "", 0) for b in (2, 3, 4) for i in (1, 2)]
    pieces = collapsed_baskets(memberships(spark, rows), block=32).collect()
    assert max(len(r["__items"]) for r in pieces) < 150
    got = {(r["item_1"], r["item_2"]): r["n"] for r in basket_pairs(collapsed_baskets(memberships(spark, rows), block=32)).collect()}
    assert len(got) == 300 * 299 // 2 and got[(1, 2)] == 4 and got[(0, 299)] == 1


def test_equal_baskets_collapse(spark):
    rows = [(b, i, "", 0) for b in range(50) for i in (1, 2, 3)]
    assert [(r["__items"], r["__weight"]) for r in collapsed_baskets(memberships(spark, rows)).collect()] == [([1, 2, 3], 50)]


def test_empty_and_single(spark):
    assert cooccurrences(memberships(spark, []), 1).count() == 0
    assert cooccurrences(memberships(spark, [(1, 1, "", 0), (2, 1, "", 0)]), 1).count() == 0


def test_counts_by_group(spark):
    rows = data(3)
    baskets = {}
    for b, i, *_ in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    groups = [(b, 1990 + b % 3) for b in baskets] + [(0, 1990), (1, None), (None, 1990)]
    wanted = [(1, 2), (2, 3), (1, 3), (1, 999), (4, 9)]
    years = {b: {y for k, y in groups if k == b and y is not None} for b in baskets}
    want = Counter((*p, y) for b, s in baskets.items() for p in wanted if set(p) <= s for y in years[b])
    out = counts_by_group(memberships(spark, rows), spark.createDataFrame(groups, "sgr long, year int"), "sgr", "year", spark.createDataFrame([*wanted, wanted[0]], "item_1 long, item_2 long"))
    assert {(r["item_1"], r["item_2"], r["year"]): r["n"] for r in out.collect()} == dict(want)
