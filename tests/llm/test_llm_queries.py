from __future__ import annotations

import pytest

from citeloom.llm.queries import QUERIES, SQL
from tests.oracle import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


def test_whole_pairs_have_those_of_one_record(spark, tmp_path):
    cited = [(1, 10), (1, 11), (2, 10), (2, 11), (3, 10), (3, 12), (3, 12), (4, 13), (5, None), (None, 11)]
    spark.createDataFrame(cited, "scp long, ref_sgr long").write.parquet(f"{tmp_path}/scopus_references.parquet")
    got = {(r["cited_1"], r["cited_2"], r["n"], r["n_1"], r["n_2"], r["n_records"]) for r in QUERIES["p2_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(10, 11, 2, 3, 2, 4), (10, 12, 1, 3, 1, 4)}
