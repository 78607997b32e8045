"""The co-citation family. E is (citing, cited), Y is (node, year), pairs are (cited_1, cited_2) with cited_1 < cited_2.

A pair list is one more DataFrame: every index is computed for all pairs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.skew import pairs_within

PAIR = ["cited_1", "cited_2"]


def cocited_pairs(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """cited_1, cited_2, frequency: how many papers cite both; with pairs only for those, 0 included."""
    if pairs is not None:
        both = _both(edges, pairs).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("frequency"))
        return pairs.select(*PAIR).distinct().join(both, PAIR, "left").na.fill(0, ["frequency"])
    pairs = pairs_within(edges.select("citing", "cited"), ["citing"], "cited")
    return pairs.groupBy(F.col("item_1").alias("cited_1"), F.col("item_2").alias("cited_2")).agg(F.count(F.lit(1)).alias("frequency"))


def _both(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """cited_1, cited_2, citing: the papers that cite both."""
    wanted = pairs.select(*PAIR).distinct()
    first = wanted.join(edges.select("citing", F.col("cited").alias("cited_1")), "cited_1")
    return first.join(edges.select("citing", F.col("cited").alias("cited_2")), ["citing", "cited_2"])


def restricted_edges(edges: DataFrame, min_refs: int) -> DataFrame:
    """The edges of papers with at least min_refs references."""
    return edges.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("citing"))).filter(F.col("__n") >= min_refs).drop("__n")


def kinetics(edges: DataFrame, years: DataFrame, pairs: DataFrame) -> DataFrame:
    """cited_1, cited_2, co_cited_year, frequency of the given pairs by year of the citing paper."""
    y = years.select(F.col("node").alias("citing"), F.col("year").alias("co_cited_year"))
    return _both(edges, pairs).join(y, "citing").groupBy(*PAIR, "co_cited_year").agg(F.count(F.lit(1)).alias("frequency"))


def kinetics_summary(series: DataFrame, years: DataFrame, min_sum: int = 0, min_peak: int = 0) -> DataFrame:
    """The series with its pair's extremes and first years; years before the pair can exist are dropped, and pairs whose
    sum or peak is too small."""
    y1, y2 = years.select(F.col("node").alias("cited_1"), F.col("year").alias("cited_1_pub_year")), years.select(F.col("node").alias("cited_2"), F.col("year").alias("cited_2_pub_year"))
    w = Window.partitionBy(*PAIR)
    rows = series.join(y1, "cited_1", "left").join(y2, "cited_2", "left").withColumn("first_possible_year", F.greatest("cited_1_pub_year", "cited_2_pub_year"))
    rows = rows.withColumns({"max_frequency": F.max("frequency").over(w), "min_frequency": F.min("frequency").over(w), "first_co_cited_year": F.min("co_cited_year").over(w), "__sum": F.sum("frequency").over(w)})
    peak = F.when(F.col("frequency") == F.col("max_frequency"), F.col("co_cited_year"))
    rows = rows.withColumns({"peak_year": F.min(peak).over(w), "peak_count": F.count(peak).over(w)})
    rows = rows.filter((F.col("__sum") >= min_sum) & (F.col("max_frequency") >= min_peak) & (F.col("first_possible_year").isNull() | (F.col("co_cited_year") >= F.col("first_possible_year"))))
    return rows.drop("__sum")


def sleeping_beauty(series: DataFrame, value: str = "frequency", year: str = "co_cited_year", keys: list[str] | None = None, start: DataFrame | None = None) -> DataFrame:
    """keys, sb: the sum over the years up to the peak of (line from the first year to the peak - value) / max(1, value).

    The series is meant without gaps; the first of several peaks counts. A peak in the first year gives 0. start (keys,
    start_year) sets the year from which the line begins in place of the first one, with the value of that year; earlier
    years do not count, and keys without that year or without start give no row.
    """
    keys = keys or PAIR
    w = Window.partitionBy(*keys)
    if start is not None:
        series = series.join(start.select(*keys, "start_year"), keys).filter(F.col(year) >= F.col("start_year"))
        series = series.withColumn("__first", F.min(year).over(w)).filter("__first = start_year").drop("start_year", "__first")
    rows = series.withColumns({"__t0": F.min(year).over(w), "__top": F.max(value).over(w), "__c0": F.min_by(value, year).over(w)})
    rows = rows.withColumn("__tp", F.min(F.when(F.col(value) == F.col("__top"), F.col(year))).over(w)).filter(F.col(year) <= F.col("__tp"))
    line = F.try_divide(F.col("__top") - F.col("__c0"), F.col("__tp") - F.col("__t0")) * (F.col(year) - F.col("__t0")) + F.col("__c0")
    term = (line - F.col(value)) / F.greatest(F.lit(1), F.col(value))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("sb"))


def sleeping_pairs(series: DataFrame, sleep: int = 10, max_frequency: int = 2, max_mean: float = 1.0) -> DataFrame:
    """cited_1, cited_2, awake_year, awake_frequency, sleep_mean: pairs whose first year above max_frequency comes after at
    least sleep years with a mean of at most max_mean."""
    order = Window.partitionBy(*PAIR).orderBy("co_cited_year")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = series.withColumns({"__i": F.row_number().over(order) - 1, "sleep_mean": F.avg("frequency").over(past)}).filter(F.col("frequency") > max_frequency)
    first = rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1")
    return first.filter((F.col("__i") >= sleep) & (F.col("sleep_mean") <= max_mean)).select(*PAIR, F.col("co_cited_year").alias("awake_year"), F.col("frequency").alias("awake_frequency"), "sleep_mean")


def awakening_slope(series: DataFrame, awake: DataFrame) -> DataFrame:
    """cited_1, cited_2, slope: rise from the awakening to the peak per year; null where they fall in one year."""
    peak = series.groupBy(*PAIR).agg(F.max("frequency").alias("__top"), F.max_by("co_cited_year", F.struct("frequency", -F.col("co_cited_year"))).alias("__tp"))
    return awake.join(peak, PAIR).select(*PAIR, F.try_divide((F.col("__top") - F.col("awake_frequency")).cast("double"), (F.col("__tp") - F.col("awake_year")).cast("double")).alias("slope"))


def _citers(edges: DataFrame, pairs: DataFrame, years: DataFrame | None, first_year: str | None) -> DataFrame:
    """pair, citing, in_x, in_y: the citers of either end, with flags; limited to years up to the pair's own."""
    columns = [*PAIR, *([first_year] if first_year else [])]
    wanted = pairs.select(*columns).distinct()
    ends = wanted.select(*columns, F.explode(F.array(F.struct(F.col("cited_1").alias("cited"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col("cited_2").alias("cited"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("e"))
    met = ends.select(*columns, "e.*").join(edges, "cited")
    if first_year:
        met = met.join(years.select(F.col("node").alias("citing"), F.col("year").alias("__y")), "citing").filter(F.col("__y") <= F.col(first_year))
    return met.groupBy(*columns, "citing").agg(F.max("x").alias("in_x"), F.max("y").alias("in_y"))


def jaccard(edges: DataFrame, pairs: DataFrame, star: bool = False, closed: bool = False, years: DataFrame | None = None, first_year: str | None = None) -> DataFrame:
    """cited_1, cited_2, n_both, n_any, jaccard over the citers of the two.

    star: the two are left out of each other's citers, and the union counts 2 more. closed: the two belong to the union
    and, where one cites the other, to the citers as usual. With years and first_year only citers up to that year count.
    """
    citers = _citers(edges, pairs, years, first_year)
    if star or closed:
        inside = (F.col("citing") == F.col("cited_1")) | (F.col("citing") == F.col("cited_2"))
        citers = citers.filter(~inside)
    counts = citers.groupBy(*PAIR).agg(F.sum(F.col("in_x") * F.col("in_y")).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    out = pairs.select(*PAIR).distinct().join(counts, PAIR, "left").na.fill(0, ["n_both", "n_any"])
    if star or closed:
        out = out.withColumn("n_any", F.col("n_any") + 2)
    return out.withColumn("jaccard", F.try_divide(F.col("n_both").cast("double"), F.col("n_any")))


def theta_omega(edges: DataFrame, years: DataFrame, pairs: DataFrame, first_year: str, prime: bool = False, delta: bool = False) -> DataFrame:
    """cited_1, cited_2, n_x, n_y, edges_xy, edges_yx, theta: citations between the citers of the two up to first_year.

    X and Y are the citers of cited_1 and cited_2; prime leaves out the common ones up to first_year, delta those of any
    year. An end that cites the other is one of its citers. edges_xy run from X to Y. theta is the number of distinct edges
    in either direction over n_x * n_y, 0 if that is 0.
    """
    citers = _citers(edges, pairs, years, first_year)
    if prime:
        citers = citers.filter("in_x + in_y = 1")
    if delta:
        citers = citers.join(_both(edges, pairs), [*PAIR, "citing"], "left_anti")
    sizes = citers.groupBy(*PAIR).agg(F.sum("in_x").alias("n_x"), F.sum("in_y").alias("n_y"))
    a = citers.select(*PAIR, F.col("citing").alias("u"), F.col("in_x").alias("ux"), F.col("in_y").alias("uy"))
    b = citers.select(*PAIR, F.col("citing").alias("v"), F.col("in_x").alias("vx"), F.col("in_y").alias("vy"))
    links = a.join(edges.select(F.col("citing").alias("u"), F.col("cited").alias("v")), "u").join(b, [*PAIR, "v"])
    xy, yx = F.col("ux") * F.col("vy"), F.col("uy") * F.col("vx")
    counts = links.groupBy(*PAIR).agg(F.sum(xy).alias("edges_xy"), F.sum(yx).alias("edges_yx"), F.sum(F.greatest(xy, yx)).alias("__n"))
    out = pairs.select(*PAIR).distinct().join(sizes, PAIR, "left").join(counts, PAIR, "left").na.fill(0)
    return out.select(*PAIR, "n_x", "n_y", "edges_xy", "edges_yx", F.coalesce(F.try_divide(F.col("__n").cast("double"), F.col("n_x") * F.col("n_y")), F.lit(0.0)).alias("theta"))


def normalized_frequency(edges: DataFrame, frequencies: DataFrame) -> DataFrame:
    """frequencies with normalized = frequency / sqrt(citers of the one * citers of the other)."""
    c = edges.groupBy("cited").agg(F.count(F.lit(1)).alias("n"))
    return frequencies.join(c.select(F.col("cited").alias("cited_1"), F.col("n").alias("__a")), "cited_1").join(c.select(F.col("cited").alias("cited_2"), F.col("n").alias("__b")), "cited_2").withColumn("normalized", F.col("frequency") / F.sqrt(F.col("__a").cast("double") * F.col("__b"))).drop("__a", "__b")


def connected_flag(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with connected: does one end cite the other."""
    either = edges.select(F.least("citing", "cited").alias("cited_1"), F.greatest("citing", "cited").alias("cited_2")).distinct().withColumn("connected", F.lit(True))
    return pairs.join(either, PAIR, "left").na.fill(False, ["connected"])


def time_lag(edges: DataFrame, years: DataFrame, pairs: DataFrame, sane: tuple[int, int] = (1100, 2100)) -> DataFrame:
    """cited_1, cited_2, first_co_cited_year (not before either end's own year), time_lag from the later end."""
    y = years.filter(F.col("year").between(*sane))
    first = _both(edges, pairs).join(y.select(F.col("node").alias("citing"), "year"), "citing").groupBy(*PAIR).agg(F.min("year").alias("__f"))
    rows = first.join(y.select(F.col("node").alias("cited_1"), F.col("year").alias("__1")), "cited_1").join(y.select(F.col("node").alias("cited_2"), F.col("year").alias("__2")), "cited_2")
    rows = rows.withColumn("first_co_cited_year", F.greatest("__1", "__2", "__f"))
    return rows.select(*PAIR, "first_co_cited_year", (F.col("first_co_cited_year") - F.greatest("__1", "__2")).alias("time_lag"))


def max_cocitations(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, other, frequency, place: the k nodes most often cited together with each given node (ties by id)."""
    mine = edges.join(nodes.select(F.col("node").alias("cited")), "cited").select(F.col("cited").alias("node"), "citing")
    pairs = mine.join(edges.select("citing", F.col("cited").alias("other")), "citing").filter("node <> other").groupBy("node", "other").agg(F.count(F.lit(1)).alias("frequency"))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("frequency"), "other"))).filter(F.col("place") <= k)


def bibliographic_coupling(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """citing_1, citing_2, coupling: how many references two papers share."""
    flipped = edges.select(F.col("cited").alias("citing"), F.col("citing").alias("cited"))
    wanted = pairs.select(F.col("citing_1").alias("cited_1"), F.col("citing_2").alias("cited_2")) if pairs is not None else None
    return cocited_pairs(flipped, wanted).withColumnsRenamed({"cited_1": "citing_1", "cited_2": "citing_2", "frequency": "coupling"})


def common_neighbours(edges: DataFrame, node: int, min_degree: int, mode: str = "citers") -> DataFrame:
    """neighbour, other, n: for the neighbours of node with many citations, what else shares their citers (or refs)."""
    degree = edges.groupBy(F.col("cited").alias("neighbour")).agg(F.count(F.lit(1)).alias("__d")).filter(F.col("__d") >= min_degree)
    near = edges.filter(F.col("citing") == node).select(F.col("cited").alias("neighbour")).distinct().join(degree, "neighbour", "left_semi")
    if mode == "citers":
        met = near.join(edges, near["neighbour"] == edges["cited"]).select("neighbour", "citing").join(edges.withColumnRenamed("cited", "other"), "citing")
    else:
        met = near.join(edges, near["neighbour"] == edges["citing"]).select("neighbour", "cited").join(edges.withColumnRenamed("citing", "other"), "cited")
    return met.filter("neighbour <> other").groupBy("neighbour", "other").agg(F.count(F.lit(1)).alias("n"))


def triplets(edges: DataFrame, years: DataFrame, min_frequency: int = 1, pairs_min: int = 1) -> DataFrame:
    """scp1 < scp2 < scp3, frequency, first_year: three papers cited together.

    A triple is at most as frequent as each of its pairs, so pairs below min_frequency are left out first.
    """
    floor = max(min_frequency, pairs_min)
    frequent = cocited_pairs(edges).filter(F.col("frequency") >= floor).select(*PAIR)
    one, two = edges.select("citing", F.col("cited").alias("cited_1")), edges.select("citing", F.col("cited").alias("cited_2"))
    kept = one.join(two, "citing").filter("cited_1 < cited_2").join(frequent, PAIR, "left_semi")
    third = kept.join(kept.select("citing", F.col("cited_1").alias("cited_2"), F.col("cited_2").alias("cited_3")), ["citing", "cited_2"])
    third = third.join(kept.select("citing", "cited_1", F.col("cited_2").alias("cited_3")), ["citing", "cited_1", "cited_3"])
    y = years.select(F.col("node").alias("citing"), "year")
    counts = third.join(y, "citing", "left").groupBy(F.col("cited_1").alias("scp1"), F.col("cited_2").alias("scp2"), F.col("cited_3").alias("scp3")).agg(F.count(F.lit(1)).alias("frequency"), F.min("year").alias("first_year"))
    return counts.filter(F.col("frequency") >= min_frequency)


def triplet_direct_citations(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """triples with direct: how many citations run among the three."""
    key = ["scp1", "scp2", "scp3"]
    ends = triples.select(*key, F.explode(F.array(*(F.struct(F.col(a).alias("citing"), F.col(b).alias("cited")) for a in key for b in key if a != b))).alias("e")).select(*key, "e.*")
    counts = ends.join(edges, ["citing", "cited"], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("direct"))
    return triples.join(counts, key, "left").na.fill(0, ["direct"])


def patent_cocitation(pairs: DataFrame, cites: DataFrame, document: list[str]) -> DataFrame:
    """cited_1, cited_2, document: the patents that cite both publications of a pair. cites: document, scp."""
    rows = cites.select(*document, "scp").distinct()
    one, two = rows.withColumnRenamed("scp", "cited_1"), rows.withColumnRenamed("scp", "cited_2")
    return pairs.select(*PAIR).distinct().join(one, "cited_1").join(two, [*document, "cited_2"]).select(*PAIR, *document)


def edges_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """cited_1, cited_2, edges: how many citations run between the two, in either direction, of each given pair."""
    either = edges.select(F.least("citing", "cited").alias("cited_1"), F.greatest("citing", "cited").alias("cited_2"))
    counts = either.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("edges"))
    return pairs.select(*PAIR).distinct().join(counts, PAIR, "left").na.fill(0, ["edges"])


def self_citations(edges: DataFrame) -> DataFrame:
    """node, edges: records that cite themselves."""
    return edges.filter("citing = cited").groupBy(F.col("citing").alias("node")).agg(F.count(F.lit(1)).alias("edges"))


def exy_density(theta: DataFrame) -> DataFrame:
    """cited_1, cited_2, density: citations from X to Y and back over n_x * n_y, of what theta_omega gives; null if that
    is 0."""
    return theta.select(*PAIR, F.try_divide((F.col("edges_xy") + F.col("edges_yx")).cast("double"), F.col("n_x") * F.col("n_y")).alias("density"))


def triplet_citers(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """scp1, scp2, scp3, citing: the papers that cite all three."""
    key = ["scp1", "scp2", "scp3"]
    out = triples.select(*key).distinct().join(edges.select("citing", F.col("cited").alias("scp1")), "scp1")
    for name in key[1:]:
        out = out.join(edges.select("citing", F.col("cited").alias(name)), ["citing", name])
    return out.select(*key, "citing")


def mutual_citations(edges: DataFrame) -> DataFrame:
    """node_1 < node_2 that cite each other."""
    back = edges.select(F.col("cited").alias("citing"), F.col("citing").alias("cited"))
    return edges.filter("citing < cited").join(back, ["citing", "cited"], "left_semi").select(F.col("citing").alias("node_1"), F.col("cited").alias("node_2"))


def line_graph(edges: DataFrame, edge: str, through: Column | None = None) -> DataFrame:
    """edge_1 < edge_2, shared: citations that have an end in common (of the ends for which through holds)."""
    ends = edges.select(edge, F.explode(F.array("citing", "cited")).alias("shared"))
    ends = ends.filter(through) if through is not None else ends
    return pairs_within(ends.distinct(), ["shared"], edge).select(F.col("item_1").alias("edge_1"), F.col("item_2").alias("edge_2"), "shared")
