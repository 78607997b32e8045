"""Data-quality checks: each returns the violations, an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: keys that several rows have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_not_all_null(df: DataFrame) -> DataFrame:
    """column: columns without any value, found in one pass."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n")) for i, c in enumerate(df.columns)))).alias("r")).select("r.*")
    return rows.filter("n = 0").select("column")


def check_min_rows(df: DataFrame, least: int) -> DataFrame:
    """n: the number of rows, if below least."""
    return df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < least)


def check_no_decrease(loads: DataFrame, order: str, value: str) -> DataFrame:
    """order, value, before: loads with a lower value than the one before."""
    return loads.withColumn("before", F.lag(value).over(Window.orderBy(order))).filter(F.col(value) < F.col("before")).select(order, value, "before")


def check_yearly_growth(df: DataFrame, year: Column, least: float = 0.0) -> DataFrame:
    """year, n, before, growth: years in which the number of rows grew by less than least (a part) on the year before."""
    counts = df.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n")).filter("year is not null")
    rows = counts.withColumn("before", F.lag("n").over(Window.orderBy("year"))).withColumn("growth", (F.col("n") - F.col("before")) / F.col("before"))
    return rows.filter(F.col("growth") < least)


def check_no_future(df: DataFrame, time: str, as_of: Column) -> DataFrame:
    """The rows with a time after as_of."""
    return df.filter(F.col(time) > as_of)


def check_tables(spark, names: list[str]) -> DataFrame:
    """table: the names that the catalog does not have."""
    missing = [(n,) for n in names if not spark.catalog.tableExists(n)]
    return spark.createDataFrame(missing, "table string")


def check_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """key, n: non-null child keys without a parent."""
    counts = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations, passed: all checks in one result."""
    parts = [d.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations", (F.col("violations") == 0).alias("passed")) for name, d in checks.items()]
    return reduce(DataFrame.unionByName, parts)
