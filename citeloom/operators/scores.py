"""Citation counts, scores of articles and authors, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.relational import tiles


def citation_counts(edges: DataFrame, years: DataFrame | None = None, span: int | None = None) -> DataFrame:
    """node, citation_count (and pub_year): citers of each cited node; with span only citers of its first years."""
    if span is not None:
        citer = years.select(F.col("node").alias("citing"), F.col("year").alias("__y"))
        edges = edges.join(citer, "citing").join(years.select(F.col("node").alias("cited"), F.col("year").alias("__z")), "cited").filter(F.col("__y").between(F.col("__z"), F.col("__z") + span))
    counts = edges.groupBy(F.col("cited").alias("node")).agg(F.count(F.lit(1)).alias("citation_count"))
    return counts if years is None else counts.join(years.select("node", F.col("year").alias("pub_year")), "node")


def counts_of_kind(edges: DataFrame, years: DataFrame, first: int, last: int, kinds: DataFrame, kind: object) -> DataFrame:
    """node, pub_year, citation_count: citers of the cited nodes of the years first to last that are of one kind (node,
    kind). A node of several entries of the kind counts once."""
    wanted = years.filter(F.col("year").between(first, last)).select("node", F.col("year").alias("pub_year")).distinct().join(kinds.filter(F.col("kind") == kind).select("node"), "node", "left_semi")
    return edges.groupBy(F.col("cited").alias("node")).agg(F.count(F.lit(1)).alias("citation_count")).join(wanted, "node").select("node", "pub_year", "citation_count")


def weighted_citation(edges: DataFrame) -> DataFrame:
    """node, citation, weighted_citation: citers, and citers plus the citers of each of them; 0 for nodes never cited."""
    counts = edges.groupBy(F.col("cited").alias("node")).agg(F.count(F.lit(1)).alias("citation"))
    second = edges.join(counts.select(F.col("node").alias("citing"), F.col("citation").alias("__c")), "citing").groupBy(F.col("cited").alias("node")).agg(F.sum("__c").alias("__s"))
    nodes = edges.select(F.col("citing").alias("node")).unionByName(edges.select(F.col("cited").alias("node"))).distinct()
    joined = nodes.join(counts, "node", "left").join(second, "node", "left").na.fill(0, ["citation", "__s"])
    return joined.select("node", "citation", (F.col("citation") + F.col("__s")).alias("weighted_citation"))


def author_scores(edges: DataFrame, authors: DataFrame) -> DataFrame:
    """author, in_degree (papers), total_citation, pir, each also scaled by its maximum."""
    papers = authors.select("node", "author").distinct()
    sums = papers.join(weighted_citation(edges), "node", "left").na.fill(0, ["citation", "weighted_citation"]).groupBy("author").agg(F.count(F.lit(1)).alias("in_degree"), F.sum("citation").alias("total_citation"), F.sum("weighted_citation").alias("pir"))
    return scaled_by_max(sums, ["in_degree", "total_citation", "pir"])


def scaled_by_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with column_scaled = column / its maximum: the maxima are one row, joined as scalars."""
    tops = df.agg(*(F.max(c).cast("double").alias(c) for c in columns))
    return df.withColumns({f"{c}_scaled": F.try_divide(F.col(c).cast("double"), tops.select(c).scalar()) for c in columns})


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank of value within the group, ties sharing the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def hazen(df: DataFrame, value: str, by: str) -> DataFrame:
    """df with hazen_perc: 100 * (average rank - 0.5) / n within by; a null value counts as 0, and 0 gets 0."""
    v = F.coalesce(F.col(value), F.lit(0))
    out = df.withColumn(value, v)
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return out.withColumn("hazen_perc", F.when(F.col(value) == 0, F.lit(0.0)).otherwise(100 * (average_rank(F.col(value), [by]) - 0.5) / n))


def percentile_bands(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """df with band: the highest cut (linear quantile) that value reaches, as a number of hundredths; null below all."""
    limits = df.agg(*(F.percentile(value, c).alias(f"__q{i}") for i, c in enumerate(sorted(cuts, reverse=True))))
    band = None
    for i, c in enumerate(sorted(cuts, reverse=True)):
        test = F.col(value) >= limits.select(f"__q{i}").scalar()
        band = F.when(test, F.lit(int(round(c * 100)))) if band is None else band.when(test, F.lit(int(round(c * 100))))
    return df.withColumn("band", band)


def bin_profile(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """bin, n, low, high, middle of n bins of equal size by (value, key)."""
    binned = tiles(df, [value, key], n, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.median(value).alias("middle"))


def hit_rate_by_bin(df: DataFrame, value: str, key: str, flag: Column, n: int) -> DataFrame:
    """bin, n, hits, rate over n bins of equal size."""
    binned = tiles(df, [value, key], n, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("hits")).withColumn("rate", F.col("hits") / F.col("n"))
