"""Disruption and dependency for all focal papers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import skew_join

#: Papers of a list of citers.
CHUNK = 4096


def disruption(edges: DataFrame, focal: DataFrame | None = None, thresholds: tuple[int, ...] = (1, 2, 3, 5, 10), universe: DataFrame | None = None, complete: bool = True) -> DataFrame:
    """focal, i, j, k, j_n and k_n for each threshold n, disruption.

    i papers cite the focal paper and none of its references, j cite both, k only references; j_n and k_n ask for at least
    n shared references; disruption is (i - j) / (i + j + k). universe (node) limits the citers of references. complete
    keeps focal papers with j > 0 and k > 0 only.

    The citers of a reference travel as lists of at most CHUNK papers, so a reference that a third of all papers cite is many
    rows of bounded size, joined in as many tasks. They are laid under the focal paper's own citers by focal paper and
    unfolded there, where its papers are counted without a further shuffle.
    """
    own = edges.select(F.col("citing").alias("focal"), F.col("cited").alias("ref"))
    papers = edges.select(F.col("cited").alias("focal"), F.col("citing").alias("paper"))
    if focal is not None:
        wanted = focal.select(F.col("node").alias("focal")).distinct()
        own, papers = own.join(wanted, "focal", "left_semi"), papers.join(wanted, "focal", "left_semi")
    third = edges.select(F.col("citing").alias("paper"), F.col("cited").alias("ref"))
    if universe is not None:
        third = third.join(universe.select(F.col("node").alias("paper")), "paper", "left_semi")
    total = third.agg(F.count(F.lit(1)).alias("n"))
    sizes = third.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("paper"), F.ceil(F.col("n") / CHUNK).cast("int")).cast("int").alias("chunk")
    lists = skew_join(third, sizes, "ref", "n", total).groupBy("ref", chunk).agg(F.collect_list("paper").alias("papers"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    wide = skew_join(own, sizes, "ref", "n", total).select("focal", "ref", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    met = wide.join(lists, ["ref", "chunk"]).select("focal", "papers", F.lit(0).alias("cites"))
    every = met.unionByName(papers.select("focal", F.array("paper").alias("papers"), F.lit(1).alias("cites"))).repartition("focal")
    pairs = every.select("focal", "cites", F.explode("papers").alias("paper")).filter("paper <> focal")
    rows = pairs.groupBy("focal", "paper").agg(F.count_if(F.col("cites") == 0).alias("shared"), F.max("cites").alias("cites"))
    cites, other = F.col("cites") == 1, F.col("cites") == 0
    aggs = [F.count_if(cites & (F.col("shared") == 0)).alias("i"), F.count_if(cites & (F.col("shared") > 0)).alias("j"), F.count_if(other).alias("k")]
    for n in thresholds:
        aggs += [F.count_if(cites & (F.col("shared") >= n)).alias(f"j_{n}"), F.count_if(other & (F.col("shared") >= n)).alias(f"k_{n}")]
    out = rows.groupBy("focal").agg(*aggs)
    if complete:
        out = out.filter("j > 0 and k > 0")
    return out.withColumn("disruption", F.try_divide((F.col("i") - F.col("j")).cast("double"), F.col("i") + F.col("j") + F.col("k")))


def dependency(edges: DataFrame, focal: DataFrame | None = None) -> DataFrame:
    """focal, n_citers, n_links, dependency: links from citers to the focal paper's references, per citer."""
    citers = edges.select(F.col("cited").alias("focal"), F.col("citing").alias("paper"))
    if focal is not None:
        citers = citers.join(focal.select(F.col("node").alias("focal")).distinct(), "focal", "left_semi")
    own = edges.select(F.col("citing").alias("focal"), F.col("cited").alias("ref"))
    links = citers.join(edges.select(F.col("citing").alias("paper"), F.col("cited").alias("ref")), "paper").join(own, ["focal", "ref"], "left_semi").groupBy("focal").agg(F.count(F.lit(1)).alias("n_links"))
    counts = citers.groupBy("focal").agg(F.count(F.lit(1)).alias("n_citers"))
    return counts.join(links, "focal", "left").na.fill(0, ["n_links"]).withColumn("dependency", F.col("n_links") / F.col("n_citers"))
