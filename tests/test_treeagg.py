from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.operators.skew import pairs_within, skew_join
from citeloom.operators.treeagg import group_counts, heavy_keys, row_counts, total_rows, tree_aggregate


def frame(spark, rows):
    return spark.createDataFrame(rows, "ref_sgr long, scp long, n_rows string, __k string")


def test_counts_with_nulls_repeats_and_clashing_columns(spark, rows):
    data = [(1, i % 7, "x", "y") for i in range(100)] + [(2, 1, None, None), (2, 1, None, None), (None, 5, "z", None), (3, None, None, None)]
    assert rows(group_counts(frame(spark, data), "ref_sgr", "scp")) == sorted([(1, 100, 7), (2, 2, 1), (3, 1, 0), (None, 1, 1)], key=repr)


@pytest.mark.parametrize("fan_in", [2, 3, 8])
@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_tree_equals_flat_aggregation(spark, rows, fan_in, partitions):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(partitions)
    tree = tree_aggregate(df, ["k"], {"total": (F.col("v"), F.sum), "top": (F.col("v"), F.max)}, partitions, fan_in)
    assert rows(tree) == rows(df.groupBy("k").agg(F.sum("v"), F.max("v")))


def rows_sent(df):
    """The rows written to shuffles by df's plan."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        plan, sent, nodes = df._jdf.queryExecution().executedPlan(), 0, []
        nodes.append(plan)
        while nodes:
            node = nodes.pop()
            if "ShuffleExchangeExec" in node.getClass().getName():
                sent += node.metrics().get("shuffleRecordsWritten").get().value()
            nodes += [node.children().apply(i) for i in range(node.children().length())]
        return sent
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_hot_key_is_merged_in_rounds(spark):
    df = spark.range(0, 1000, 1, 64).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    plan = tree_aggregate(df, ["k"], {"n": (F.lit(1), F.count)}, 64, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2  # 64 chunks: 8 by 8, in two rounds
    assert rows_sent(row_counts(spark.range(0, 100_000, 1, 64).select(F.lit(1).alias("k")), "k")) <= 64 + 8


def test_empty_and_ties(spark, rows):
    assert rows(group_counts(frame(spark, []), "ref_sgr", "scp")) == []
    assert rows(heavy_keys(frame(spark, []), "ref_sgr")) == []
    tied = frame(spark, [(k, i, "", "") for k in range(4) for i in range(5)] + [(None, 1, "", "")] * 50)
    assert [r[0] for r in rows(heavy_keys(tied, "ref_sgr", 0.25))] == [0, 1, 2, 3]
    assert total_rows(group_counts(tied, "ref_sgr", "scp"), "n_rows").first()[0] == 70


def test_skew_join_equals_join(spark, rows):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(600)] + [(None, -1)], "k long, v long")
    counts = Counter(r[0] for r in left.collect())
    right = spark.createDataFrame([(k, n, f"r{k}") for k, n in counts.items() if k is not None and k % 2 == 1], "k long, n long, w string")
    total = left.agg(F.count(F.lit(1)))
    for how in ("inner", "left_semi"):
        assert rows(skew_join(left, right, "k", "n", total, how)) == rows(left.join(right, "k", how))
    with pytest.raises(ValueError):
        skew_join(left, right, "k", "n", total, "full")


@pytest.mark.parametrize("block", [1, 3, 7, 256])
def test_pairs_within_hot_keys(spark, rows, block):
    data = [(1, i) for i in range(30)] + [(2, 5), (2, 9), (3, 4), (None, 1), (None, 2), (4, None), (4, 1)]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(data, "k long, x long"), ["k"], "x", block).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1, a, b) for a in range(30) for b in range(a + 1, 30)} | {(2, 5, 9)}
    assert rows(pairs_within(spark.createDataFrame([], "k long, x long"), ["k"], "x", block)) == []
