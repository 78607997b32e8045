from __future__ import annotations

import random

import numpy as np
import pytest

from citeloom.llm.spans import _codes, compact_windows, gram_hashes, shared_share, shared_spans


def brute(docs, least):
    owner: dict[str, int] = {}
    for doc, text in docs:
        for s in range(len(text or "") - least + 1):
            piece = text[s : s + least]
            owner[piece] = doc if owner.get(piece, doc) == doc else -1
    out = set()
    for doc, text in docs:
        run = None
        for s in range(len(text or "") - least + 1):
            if owner[text[s : s + least]] == -1:
                if run and s <= run[1]:
                    run[1] = s + least
                else:
                    if run:
                        out.add((doc, *run))
                    run = [s, s + least]
        if run:
            out.add((doc, *run))
    return out


def random_docs(seed, n=40):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdé中😀 ") for _ in range(k))
    stock = [word(rng.randrange(15, 60)) for _ in range(5)]
    docs = []
    for i in range(n):
        parts = [rng.choice([word(rng.randrange(30)), rng.choice(stock), rng.choice(stock)[: rng.randrange(60)], "ab" * rng.randrange(20)]) for _ in range(rng.randrange(7))]
        docs.append((i, "".join(parts)))
    return docs + [(200, None), (201, ""), (202, " " * 50), (203, " " * 60), (204, docs[0][1]), (205, docs[0][1])]


def spans(spark, docs, least, gram, group):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, doc string, sig long")
    return {tuple(r) for r in shared_spans(df, "doc_id", "text", least, gram, group).collect()}


@pytest.mark.parametrize(("least", "gram", "group"), [(20, 6, 256), (20, 6, 2), (12, 12, 4), (25, 1, 256)])
def test_against_brute_force(spark, least, gram, group):
    docs = random_docs(least + group)
    assert spans(spark, docs, least, gram, group) == brute(docs, least)


def test_a_stock_line_in_most_texts_with_other_surroundings(spark):
    rng = random.Random(1)
    line = "".join(rng.choice("xyz") for _ in range(30))
    docs = [(i, f"{i:05d}" * 3 + line + f"{i * 7:05d}" * 3) for i in range(400)]
    assert spans(spark, docs, 20, 8, 64) == brute(docs, 20)


def test_repeated_rows_own_repeats_and_empty(spark):
    text = "abcdefghij" * 6
    assert spans(spark, [(1, text), (1, text)], 20, 6, 256) == set()
    assert spans(spark, [(1, text), (1, text), (2, text)], 20, 6, 256) == {(1, 0, 60), (2, 0, 60)}
    assert spans(spark, [], 20, 6, 256) == set()
    assert spans(spark, [(None, text), (3, text)], 20, 6, 256) == set()
    with pytest.raises(ValueError):
        spans(spark, [(1, text)], 5, 6, 256)


def test_shares(spark):
    df = spark.createDataFrame([(1, "abcdefghijkl" * 2 + "zz"), (2, "abcdefghijkl" * 2), (3, None), (4, "")], "doc_id long, text string")
    found = shared_share(df, "doc_id", "text", shared_spans(df, "doc_id", "text", 20, 6))
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    assert got == {1: (26, 1, 24, 24 / 26), 2: (24, 1, 24, 1.0), 3: (None, 0, 0, None), 4: (0, 0, 0, None)}


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(3)
    for _ in range(200):
        h = rng.integers(0, rng.integers(2, 40), rng.integers(1, 60)).astype(np.uint64)
        width = int(rng.integers(1, 20))
        want = []
        for c in sorted({i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)}):
            low = c
            while low and h[low - 1] > h[c]:
                low -= 1
            high = c
            while high < len(h) - 1 and h[high + 1] >= h[c]:
                high += 1
            want.append((low, c, high))
        got = compact_windows(h, np.array([0, len(h)]), width)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want
        # Two texts one behind the other have the windows of each.
        both = compact_windows(np.concatenate([h, h]), np.array([0, len(h), len(h), 2 * len(h)]), width)
        assert list(zip(*(x.tolist() for x in both), strict=True)) == want + [tuple(x + len(h) for x in w) for w in want]
        # Each run of width hashes belongs to one window, whose place is in it.
        for i in range(len(h) - width + 1):
            assert sum(lo <= i <= c <= i + width - 1 <= hi for lo, c, hi in want) == 1


def test_grams_depend_on_their_own_characters_only():
    text = "banana bandana 😀banana"
    for gram in (1, 2, 3, 5, 8):
        hashes = gram_hashes(_codes(text), gram)
        seen = {}
        for i, h in enumerate(hashes):
            assert seen.setdefault(text[i : i + gram], h) == h
        assert len(set(seen.values())) == len(seen)
