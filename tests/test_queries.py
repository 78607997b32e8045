"""Every query against its SQL, and those without SQL for a stable, non-empty schema."""

from __future__ import annotations

import pytest

from citeloom.plans import analytics, problems, reference, relational
from tests.oracle import DATA, compare

MODULES = (problems, relational, reference, analytics)
QUERIES = {n: q for m in MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.SQL.items()}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert len(df.columns) == len(set(df.columns)) > 0
    assert df.count() >= 0


def test_names_are_unique():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)
    assert set(SQL) <= set(QUERIES)


def test_core_does_not_need_the_llm_subpackage():
    from pathlib import Path

    package = Path(problems.__file__).parent.parent
    for file in package.rglob("*.py"):
        if "llm" not in file.relative_to(package).parts:
            assert "citeloom.llm" not in file.read_text(), file
