"""Text queries over texts and items beyond ASCII, against brute force; keys of such names."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from citeloom.operators.text import STOP_WORDS
from citeloom.plans import analytics

TEXTS = [
    (1, "Клиническое исследование: клиническое наблюдение", "abstract"), (2, "臨床試験の結果、対照群。臨床試験の結果", "abstract"), (3, "Κλινική μελέτη και θεραπεία", "abstract"),
    (4, "François étudie l'épidémiologie naïve", "note"), (5, "plain trial of plain words 2020 and x1y", "note"), (6, "Исследование Épidémiologie trial", "note"), (7, "", None), (8, None, "note"),
]


def terms(text):
    return Counter(w for w in re.split(r"[\W_]+", (text or "").lower().replace("ς", "σ")) if len(w) >= 3 and not re.fullmatch("[0-9]+", w) and w not in STOP_WORDS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(TEXTS, "doc_id long, text string, text_kind string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_whole_token_counts(spark, rows, folder):
    df, n = Counter(), Counter()
    for _, text, _ in TEXTS:
        df.update(terms(text).keys())
        n.update(terms(text))
    assert n["клиническое"] == 2 and n["臨床試験の結果"] == 2 and n["épidémiologie"] == df["épidémiologie"] == 2
    assert rows(analytics.text_token_counts(spark, folder)) == sorted(((t, df[t], n[t]) for t in df), key=repr)
    idf = {r["term"]: r["idf"] for r in analytics.text_idf(spark, folder).collect()}
    assert idf == {t: pytest.approx(math.log10((len(TEXTS) - df[t] + 0.5) / (df[t] + 0.5)), abs=1e-7) for t in df}


def test_whole_cluster_terms_and_divergence(spark, rows, folder):
    df = Counter((kind, t) for _, text, kind in TEXTS if kind for t in terms(text))
    kept = {k: v for k, v in df.items() if v >= 2}
    assert ("note", "épidémiologie") in kept
    assert rows(analytics.text_cluster_terms(spark, folder)) == sorted(((*k, v) for k, v in kept.items()), key=repr)
    want = {}
    for doc, text, kind in TEXTS:
        q = {t: v for (k, t), v in kept.items() if k == kind}
        p = {t: v for t, v in terms(text).items() if t in q}
        if p:
            part = lambda x, m: x * math.log(x / m) if x else 0.0
            p, q = ({t: v / sum(d.values()) for t, v in d.items()} for d in (p, q))
            want[doc] = sum(part(p.get(t, 0.0), (p.get(t, 0.0) + q[t]) / 2) + part(q[t], (p.get(t, 0.0) + q[t]) / 2) for t in q) / 2
    assert {r["doc"]: r["jsd"] for r in analytics.text_doc_jsd(spark, folder).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_coherence_sees_the_whole_texts(spark, tmp_path):
    docs = [(i, "клиническое исследование", "abstract") for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, text_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    for query in (analytics.text_coherence, analytics.text_cluster_jsd):
        assert [(r["cluster_no"], r["size"], r["mean"]) for r in query(spark, str(tmp_path)).collect()] == [("abstract", 12, 0.0)]


def test_whole_author_keys(spark, rows, tmp_path):
    names = [(1, "François", "Müller"), (2, "Zoë", " Ångström "), (3, "Élodie", "Smith"), (4, None, "Ødegård"), (5, "José", None), (6, "Ann", "Lee"), (7, "李", "王")]
    spark.createDataFrame(names, "id long, first_name string, last_name string").write.parquet(f"{tmp_path}/ct_overall_officials.parquet")
    assert rows(analytics.fn_author_key(spark, str(tmp_path))) == [(1, "müllerf"), (2, "ångströmz"), (3, "smithé"), (4, "ødegård"), (6, "leea"), (7, "王李")]


def test_whole_rankings_take_every_item(spark, folder):
    items = [(1, "labelcheck", "plain trial"), (2, "trialqa", "Клиническое исследование"), (3, "citeread", "l'épidémiologie trial"), (4, "abstractfit", "臨床試験の結果"), (5, "trialqa", "of the")]
    spark.createDataFrame(items, "item_id long, bench string, item_text string").write.mode("overwrite").parquet(f"{folder}/eval_items.parquet")
    index, queries = {d: terms(t) for d, t, _ in TEXTS if terms(t)}, {i: terms(t) for i, _, t in items}
    length = lambda v: math.sqrt(sum(n * n for n in v.values()))
    shared = [(q, d) for q in queries for d in index if queries[q].keys() & index[d].keys()]
    assert {q for q, _ in shared} == {1, 2, 3, 4}
    cosine = {(q, d): sum(queries[q][t] * index[d][t] for t in queries[q]) / length(queries[q]) / length(index[d]) for q, d in shared}
    assert {(r["query"], r["doc"]): r["cosine"] for r in analytics.text_cosine(spark, folder).collect()} == {k: pytest.approx(v, abs=1e-7) for k, v in cosine.items()}
    df, mean = Counter(t for v in index.values() for t in v), sum(sum(v.values()) for v in index.values()) / len(index)
    weight = {t: math.log10((len(index) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    score = {(q, d): sum(weight[t] * index[d][t] * 3 / (index[d][t] + 2 * (0.25 + 0.75 * sum(index[d].values()) / mean)) for t in queries[q].keys() & index[d].keys()) for q, d in shared}
    assert {(r["query"], r["doc"]): r["score"] for r in analytics.text_bm25(spark, folder).collect()} == {k: pytest.approx(v, abs=1e-5) for k, v in score.items()}
    assert {r["query"] for r in analytics.text_rank_blend(spark, folder).collect()} == {1, 2, 3, 4}
