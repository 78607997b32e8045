from __future__ import annotations

from datetime import datetime

from citeloom.operators.orphans import Side, orphan_references, orphan_report


def t(day: int) -> datetime:
    return datetime(2012, 1 + day // 28, 1 + day % 28)


def build(spark, refs, groups, deletes, find=orphan_references):
    r = spark.createDataFrame(refs, "scp long, ref_sgr long, at timestamp, kind string, parent string")
    g = spark.createDataFrame(groups, "sgr long, at timestamp, extra string")
    d = spark.createDataFrame(deletes, "sgr long, gone timestamp")
    return find(r, "scp", "ref_sgr", "at", Side(g, "sgr", "at"), Side(d, "sgr", "gone"), "groups")


def test_kinds_and_periods(spark, rows):
    refs = [(1, 10, t(40), "x", "y"), (1, 10, t(5), "x", "y"), (1, 11, t(5), "", ""), (1, 12, t(5), "", ""), (1, 13, t(5), "", ""), (1, 14, t(30), "", ""), (1, 15, None, "", ""), (2, None, t(1), "", ""), (None, 10, t(1), "", ""), (3, 16, t(5), "", ""), (4, 13, t(20), "", "")]
    groups = [(11, t(1), ""), (11, t(9), ""), (12, t(1), ""), (13, t(10), ""), (14, None, ""), (16, t(1), ""), (16, t(30), ""), (None, t(1), "")]
    deletes = [(12, t(3)), (12, t(2)), (16, t(20)), (17, t(1)), (15, None), (None, t(1))]
    got = rows(build(spark, refs, groups, deletes).select("scp", "ref_sgr", "kind", "period"))
    # 10 missing from its first arrival; 12 deleted after its last load; 13 came late for 1 but not for 4; 16 was loaded again
    # after its deletion; 15 has a delete entry without time and no group; 14's group has no time.
    assert got == sorted([(1, 10, "missing", "2012-01"), (1, 12, "deleted", "2012-01"), (1, 13, "late", "2012-01"), (1, 15, "deleted", None)], key=repr)
    counted = rows(build(spark, refs, groups, deletes, orphan_report))
    assert counted == sorted([("groups", "missing", "2012-01", 1), ("groups", "deleted", "2012-01", 1), ("groups", "late", "2012-01", 1), ("groups", "deleted", None, 1)], key=repr)


def test_report_and_empty_tables(spark, rows):
    refs = [(i, 7, t(5), "", "") for i in range(50)] + [(i, 7, t(5), "", "") for i in range(50)]
    assert rows(build(spark, refs, [], [], orphan_report)) == [("groups", "missing", "2012-01", 50)]
    assert rows(build(spark, [], [], [])) == rows(build(spark, [], [], [], orphan_report)) == []
    assert rows(build(spark, [], [(1, t(1), "")], [(1, t(2))])) == []
