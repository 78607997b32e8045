"""Small fixtures with known answers for the citation measures and null models."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.operators import cocitation as P
from citeloom.operators import disruption as D
from citeloom.operators import nullmodel as N
from citeloom.operators import scores as S
from citeloom.operators import text as T


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "citing long, cited long")


def test_disruption_of_a_known_paper(spark):
    # F = 1 cites 2 and 3; 10 cites F; 11 cites F and 2; 12 cites F, 2 and 3; 13 cites 2.
    e = edges(spark, [(1, 2), (1, 3), (10, 1), (11, 1), (11, 2), (12, 1), (12, 2), (12, 3), (13, 2)])
    r = D.disruption(e, spark.createDataFrame([(1,)], "node long"), (1, 2)).first()
    assert (r["i"], r["j"], r["k"], r["j_2"], r["k_2"], r["disruption"]) == (1, 2, 1, 1, 0, -0.25)
    d = D.dependency(e, spark.createDataFrame([(1,)], "node long")).first()
    assert (d["n_citers"], d["n_links"], d["dependency"]) == (3, 3, 1.0)
    assert (676 - 811) / (676 + 811 + 11714) == pytest.approx(-0.01022649799257632)


def test_sleeping_beauty(spark):
    s = spark.createDataFrame([(1, 2, y, f) for y, f in zip(range(2000, 2004), (0, 0, 0, 6), strict=True)] + [(1, 3, 2000, 4), (1, 3, 2001, 0)], "cited_1 long, cited_2 long, co_cited_year int, frequency int")
    assert {(r[0], r[1]): r[2] for r in P.sleeping_beauty(s).collect()} == {(1, 2): 6.0, (1, 3): 0.0}


def test_hazen(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("c", 1, 1), ("d", 3, 1), ("e", None, 2)], "id string, n int, y int")
    assert {r["id"]: r["hazen_perc"] for r in S.hazen(df, "n", "y").collect()} == {"a": 0.0, "b": 50.0, "c": 50.0, "d": 87.5, "e": 0.0}


def test_jaccard_and_star(spark):
    e = edges(spark, [(c, 1) for c in (10, 11, 12)] + [(c, 2) for c in (11, 12, 13)])
    p = spark.createDataFrame([(1, 2), (1, 3)], "cited_1 long, cited_2 long")
    assert {r["cited_2"]: r["jaccard"] for r in P.jaccard(e, p).collect()} == {2: 0.5, 3: 0.0}
    assert {r["cited_2"]: r["jaccard"] for r in P.jaccard(e, p, star=True).collect()}[2] == pytest.approx(2 / 6)


def test_pairs_of_a_paper_and_triplets(spark, rows):
    e = edges(spark, [(9, i) for i in range(5)] + [(8, i) for i in range(3)])
    assert sum(r["frequency"] for r in P.cocited_pairs(e).collect()) == math.comb(5, 2) + math.comb(3, 2)
    y = spark.createDataFrame([(9, 2001), (8, 1999)], "node long, year int")
    assert rows(P.triplets(e, y, 2)) == [(0, 1, 2, 2, 1999)]


def slice_(spark):
    data = [(s, f"j{s % 3}", 100 + (s * 7 + i) % 23, 1990 + (s * 7 + i) % 23 % 4, f"i{(s * 7 + i) % 23 % 5}") for s in range(12) for i in range(6)]
    return spark.createDataFrame(sorted(set(data)), "source_id long, source_issn string, ref_id long, ref_year int, ref_issn string")


def test_shuffle_keeps_references_whole(spark):
    rows = slice_(spark)
    refs = {r["ref_id"]: (r["ref_year"], r["ref_issn"]) for r in rows.collect()}
    out = N.shuffle_refs(rows, 3, drop=None).collect()
    assert all(refs[r["ref_id"]] == (r["ref_year"], r["ref_issn"]) for r in out)
    want = Counter((r["ref_year"], r["ref_id"]) for r in rows.collect())
    for perm in (1, 2, 3):
        assert Counter((r["ref_year"], r["ref_id"]) for r in out if r["perm_id"] == perm) == want
        assert Counter(r["source_id"] for r in out if r["perm_id"] == perm) == Counter(r["source_id"] for r in rows.collect())
    kept = Counter((r["perm_id"], r["source_id"], r["ref_id"]) for r in N.shuffle_refs(rows, 3).collect())
    assert max(kept.values()) == 1
    by_source = Counter((r["perm_id"], r["source_id"]) for r in N.shuffle_refs(rows, 3, "sources").collect())
    assert set(by_source.values()) <= {6}


def test_swaps_keep_degrees(spark):
    rows = slice_(spark)
    out = N.mcmc_swap(rows, 3).collect()
    old = rows.collect()
    assert Counter((r["source_id"], r["ref_year"]) for r in out) == Counter((r["source_id"], r["ref_year"]) for r in old)
    assert Counter(r["ref_id"] for r in out) == Counter(r["ref_id"] for r in old)
    assert len({(r["source_id"], r["ref_id"]) for r in out}) == len(out)


def test_z_scores_agree_with_one_pass(spark):
    obs = spark.createDataFrame([("a", "b", 5), ("a", "c", 2), ("a", "d", 2), ("a", "e", 1)], "issn_1 string, issn_2 string, frequency long")
    values = {"b": [1, 2, 3], "c": [2, 2], "d": [1, 1]}
    bg = spark.createDataFrame([(i, "a", k, v) for k, vs in values.items() for i, v in enumerate(vs)], "perm_id int, issn_1 string, issn_2 string, frequency long")
    got = {r["issn_2"]: r for r in N.z_scores(obs, bg, 3).collect()}
    n, mean, std = N.welford([1, 2, 3])
    assert got["b"]["n"] == n and got["b"]["z"] == pytest.approx((5 - mean) / std)
    assert got["c"]["z"] is None and got["d"]["z"] == math.inf and got["e"]["z"] is None
    zero = {r["issn_2"]: r for r in N.z_scores(obs, bg, 4, "zero").collect()}
    assert zero["b"]["mean"] == pytest.approx(1.5)


def test_p_values():
    assert N.gamma_upper(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert N.gamma_upper(5, 18.307038053275146 / 2) == pytest.approx(0.05, abs=1e-9)
    assert N.binomial_tail(3, 10, 0.5) == pytest.approx(0.9453125)
    assert N.binomial_tail(0, 10, 0.5) == 1.0


def test_divergence_is_bounded(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "delta delta"), (4, None), (5, "")], "doc_id long, text string")
    tokens = T.token_table(docs, "doc_id", "text")
    same = spark.createDataFrame([("x", 1), ("x", 2)], "cluster_no string, node long")
    assert all(r["jsd"] == pytest.approx(0, abs=1e-12) for r in T.doc_jsd(tokens, same).collect())
    mixed = spark.createDataFrame([("x", i) for i in range(1, 6)], "cluster_no string, node long")
    got = {r["doc"]: r["jsd"] for r in T.doc_jsd(tokens, mixed, 1).collect()}
    assert set(got) == {1, 2, 3} and all(0 <= v <= math.log(2) for v in got.values())
    q = {"alpha": 2 / 7, "beta": 2 / 7, "gamma": 2 / 7, "delta": 1 / 7}
    p = {"delta": 1.0}
    dense = sum(0.5 * p.get(t, 0) * math.log(p[t] / ((p[t] + q[t]) / 2)) if t in p else 0 for t in q) + sum(0.5 * q[t] * math.log(q[t] / ((p.get(t, 0) + q[t]) / 2)) for t in q)
    assert got[3] == pytest.approx(dense)


def test_bigrams_and_phrases(spark, rows):
    docs = spark.createDataFrame([(1, "Deep nets learn; deep nets fail"), (2, "nets deep"), (3, None)], "doc_id long, text string")
    assert ("deep nets" in {r["term"] for r in T.token_table(docs, "doc_id", "text", 2).collect()})
    assert rows(T.text_match(docs, "doc_id", "text", "deep nets", "phrase")) == [(1,)]
    assert rows(T.text_match(docs, "doc_id", "text", "deep nets")) == [(1,), (2,)]
    assert rows(T.text_match(docs, "doc_id", "text", "fail other", "any")) == [(1,)]
    assert rows(docs.select(F.size(T.ngrams(F.array(F.lit("a")), 2)))) == [(0,), (0,), (0,)]


def test_ngrams_make_the_tokens_once(spark, rows):
    """Not anew for each run, of which a long text has many; with fewer tokens than a run there is none."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i:05d}" for i in range(6000))), (2, "alone"), (3, None), (4, "the 123 of")], "doc_id long, text string")
    table = T.token_table(docs, "doc_id", "text", 3)
    assert table._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert rows(table) == [(1, f"w{i:05d} w{i + 1:05d} w{i + 2:05d}", 1) for i in range(5998)]
    assert rows(docs.select("doc_id", T.ngrams(T.words(F.col("text"), stop=[]), 1)).filter("doc_id > 1")) == [(2, ["alone"]), (3, []), (4, ["the"])]
