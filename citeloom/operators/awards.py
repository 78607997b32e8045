"""Productivity of groups and participants: means by distance from the start, shares, quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def award_means(rows: DataFrame, award: str, person: str, year: str, start: str, value: str, low: int, high: int) -> DataFrame:
    """award, distance, persons, mean_rows, std_rows, mean_value, std_value: per-person rows and value sums by years from the
    start, within low..high; deviations are those of the population."""
    d = rows.withColumn("distance", (F.col(year) - F.col(start)).cast("int")).filter(F.col("distance").between(low, high))
    each = d.groupBy(award, "distance", person).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    return each.groupBy(award, "distance").agg(F.count(F.lit(1)).alias("persons"), F.avg("n").alias("mean_rows"), F.stddev_pop("n").alias("std_rows"), F.avg("v").alias("mean_value"), F.stddev_pop("v").alias("std_value"))


def share_reaching(rows: DataFrame, award: str, person: str, least: list[int]) -> DataFrame:
    """award, persons, and for each n the percentage of persons with at least n rows."""
    each = rows.groupBy(award, person).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(award).agg(F.count(F.lit(1)).alias("persons"), *((100 * F.count_if(F.col("n") >= k) / F.count(F.lit(1))).alias(f"percent_{k}") for k in least))


def award_quartiles(rows: DataFrame, award: str, year: str, value: str) -> DataFrame:
    """award, n, q1, middle, q3 of the rows' cumulative distribution by value within their year."""
    placed = rows.withColumn("cume", F.cume_dist().over(Window.partitionBy(year).orderBy(value)))
    return placed.groupBy(award).agg(F.count(F.lit(1)).alias("n"), F.percentile("cume", 0.25).alias("q1"), F.percentile("cume", 0.5).alias("middle"), F.percentile("cume", 0.75).alias("q3"))


def coauthor_links(members: DataFrame, work: str, group: str) -> DataFrame:
    """group_1 <= group_2, works: the link matrix of groups by common works; a group alone on a work counts with itself."""
    m = members.select(work, group).distinct().withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy(work)))
    one, two = m.select(work, F.col(group).alias("group_1"), "__k"), m.select(work, F.col(group).alias("group_2"))
    pairs = one.join(two, work).filter((F.col("group_1") < F.col("group_2")) | ((F.col("__k") == 1) & (F.col("group_1") == F.col("group_2"))))
    return pairs.groupBy("group_1", "group_2").agg(F.count(F.lit(1)).alias("works"))
