from __future__ import annotations

import random

import numpy as np
import pytest

from citeloom.llm import leakage
from citeloom.llm.leakage import held_pairs, holds_passage, leak_report, leaked_items, normal_words, seeds, word_codes


def brute(item, text):
    """Whether some run of 12 or more words of the item is within 2 edits in 10 of some run of the text's words."""
    for i in range(len(item)):
        for j in range(len(text)):
            row = list(range(len(text) - j + 1))
            for n, word in enumerate(item[i:], 1):
                new = [n]
                for k, w in enumerate(text[j:], 1):
                    new.append(min(row[k - 1] + (w != word), row[k] + 1, new[k - 1] + 1))
                row = new
                if n >= 12 and min(row) * 10 <= 2 * n:
                    return True
    return False


def test_words():
    assert normal_words("The <b>Acute</b>&nbsp;саll, in\xadhibited ｖａｒ! 5.9 in😀duced ‮İone né") == ["the", "acute", "call", "inhibited", "var", "59", "induced", "ione", "ne"]
    assert normal_words("weak-\n ened co-citation O\u2019Neil 1,000 end. Next") == ["weakened", "cocitation", "oneil", "1000", "end", "next"]
    assert normal_words("中文 mix漢a") == ["中", "文", "mix", "漢", "a"]
    assert normal_words(f'<p class="{"c " * 300}">hello world</p> a < b') == ["hello", "world", "a", "b"]
    assert normal_words("a<!-- x\n y -->b <!-- c") == ["a", "b", "c"] and len(normal_words("<!--" * 100_000 + " <a b=" * 100_000)) == 200_000
    assert normal_words(None) == normal_words("") == normal_words(" .,! ") == []


def altered(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            out.insert(at, f"more{rng.randrange(99)}")
        elif len(out) > 1:
            del out[at]
    return out


@pytest.mark.parametrize("seed", range(2))
def test_search_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 30)))) for i in range(12)]
    texts = []
    for _ in range(120):
        item = rng.choice(items)[1].split()
        a = rng.randrange(max(1, len(item) - 11))
        part = altered(rng, item[a : a + rng.randrange(9, 24)], rng.randrange(5))
        filler = lambda: [rng.choice(vocabulary + ["zz"] * 30) for _ in range(rng.randrange(12))]
        texts.append([*filler(), *part, *filler()])
    got = {tuple(r) for r in frame(spark, [(n, " ".join(t)) for n, t in enumerate(texts)], items).collect()}
    want = {(n, i) for n, t in enumerate(texts) for i, s in items if brute(s.split(), t)}
    assert want and got == want


def test_an_alignment_at_the_limit():
    item = np.arange(1, 16)
    text = item.copy()
    text[[3, 7, 11]] = 99
    assert holds_passage(item, text)
    text[5] = 99
    assert not holds_passage(item, text)
    # Three changes at even distances leave no four words together: the gapped mask finds them.
    words = [f"a{i}" for i in range(15)]
    spoiled = [w if i not in (3, 7, 11) else "x" for i, w in enumerate(words)]
    a, b = word_codes(words), word_codes(spoiled)
    keys, _, places = seeds([a, b])
    half = len(seeds([a])[0])
    assert set(seeds([a])[0]) & set(seeds([b])[0]) and len(keys) == 2 * half
    at = {k: p for k, p in zip(*(seeds([a])[i] for i in (0, 2)), strict=True)}
    hits = [(int(p), int(at[k])) for k, p in zip(*(seeds([b])[i] for i in (0, 2)), strict=True) if k in at]
    n, (texts_at, items_at) = len(hits), np.array(hits).T
    one, other = (np.concatenate([a, a]), np.array([0, 15, 30])), (np.concatenate([b, b[:9]]), np.array([0, 15, 24]))
    assert held_pairs(one, other, (np.array([0, n, n + 1]), np.append(texts_at, 0), np.append(items_at, 0))) == [0]


def test_seeds_do_not_cross_texts():
    texts = [word_codes(x.split()) for x in ("a b c", "d e f g h", "", "i")]
    keys, numbers, places = seeds(texts)
    assert list(zip(numbers, places, strict=True)) == [(1, 0), (1, 1), (1, 0)] and set(keys) <= set(seeds([texts[1]])[0])


def frame(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, item_text string, doc_id string")
    return leaked_items(d, "doc_id", "text", i, "item_id", "item_text")


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_documents(spark, rows, monkeypatch):
    docs = [(1, f"x {ITEM.upper()}. y"), (1, f"x {ITEM.upper()}. y"), (2, " ".join(ITEM.split()[:9])), (7, " ".join(ITEM.split()[:10])), (3, None), (4, ""), (None, ITEM), (5, "z " * 50_000 + ITEM), (6, ITEM.replace("three", "<i>thrëe</i>,").replace("nine ", ""))]
    items = [(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "too short an item"), (None, ITEM), (14, ITEM)]
    want = sorted([(d, i) for d in (1, 5, 6, 7) for i in (10, 14)], key=repr)
    assert rows(frame(spark, docs, items)) == want
    monkeypatch.setattr(leakage, "FILTER_BITS", 1 << 15)
    assert rows(frame(spark, docs, items)) == want
    assert rows(leak_report(frame(spark, docs, items), "item_id", "doc_id")) == [(10, 4), (14, 4)]


def test_empty(spark, rows):
    assert rows(frame(spark, [], [(1, ITEM)])) == []
    assert rows(frame(spark, [(1, ITEM)], [])) == []
