"""Null models of citation: year slices, shuffled references, pair frequencies, z-scores, categories."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.relational import numbered
from citeloom.session import materialise, ship


def year_slice(edges: DataFrame, pubs: DataFrame, year: int, min_refs: int = 2) -> DataFrame:
    """source_id, source_issn, ref_id, ref_year, ref_issn: references, not newer than the year, of the year's papers that
    have at least min_refs such. pubs: node, year, issn."""
    source = pubs.filter(F.col("year") == year).select(F.col("node").alias("source_id"), F.col("issn").alias("source_issn"))
    ref = pubs.filter(F.col("year") <= year).select(F.col("node").alias("ref_id"), F.col("year").alias("ref_year"), F.col("issn").alias("ref_issn"))
    rows = edges.select(F.col("citing").alias("source_id"), F.col("cited").alias("ref_id")).join(source, "source_id").join(ref, "ref_id")
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("source_id"))).filter(F.col("__n") >= min_refs).select("source_id", "source_issn", "ref_id", "ref_year", "ref_issn")


def best_issn(issns: DataFrame) -> DataFrame:
    """node, issn: of several ISSNs the one of the highest type, then the least used, then the first."""
    used = issns.groupBy("issn").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("node").orderBy(F.desc("type"), "__n", "issn")
    return issns.join(used, "issn").withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("node", "issn")


def k_values(rows: DataFrame) -> DataFrame:
    """source_id, ref_year, k: references by source and year."""
    return rows.groupBy("source_id", "ref_year").agg(F.count(F.lit(1)).alias("k"))


def portable_hash(*parts: Column) -> Column:
    """A whole-number hash below 2^31 that other engines can compute: squares and products modulo a prime.

    Each step squares what came before; with products alone another first part would only turn the order of all hashes
    round, and every permutation would give the same shuffle.
    """
    h = F.lit(17).cast("long")
    for p in (*parts, F.lit(0)):
        h = F.pmod(h * h + h * 48271 + F.pmod(p.cast("long"), F.lit(2147483647)) * 69621 + 12345, F.lit(2147483647))
    return h


def shuffle_refs(rows: DataFrame, permutations: int, drop: str | None = "rows") -> DataFrame:
    """perm_id, source_id, source_issn, ref_id, ref_year, ref_issn: references exchanged among those of one year.

    In each permutation and year the rows are put in a seeded order, and each source gets the whole reference of the next
    row in it, so no row mixes parts of several references. All permutations are one job. drop: rows removes references
    that a source gets more than once, sources removes such sources, None keeps all.
    """
    many = rows.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    hashed = many.withColumn("__h", portable_hash(F.col("perm_id"), F.col("source_id"), F.col("ref_id")))
    placed = materialise(numbered(hashed, ["perm_id", "ref_year", "__h", "source_id", "ref_id"], "__i"))
    ends = placed.groupBy("perm_id", "ref_year").agg(F.min("__i").alias("__low"), F.max("__i").alias("__high"))
    # A row's successor is found by its number, the last one's is the first: no task holds a whole year.
    following = placed.join(ends, ["perm_id", "ref_year"]).withColumn("__next", F.when(F.col("__i") == F.col("__high"), F.col("__low")).otherwise(F.col("__i") + 1))
    refs = placed.select(F.col("__i").alias("__next"), "ref_id", "ref_issn")
    out = following.drop("ref_id", "ref_issn").join(refs, "__next").select("perm_id", "source_id", "source_issn", "ref_year", "ref_id", "ref_issn")
    if drop is None:
        return out
    twice = F.count(F.lit(1)).over(Window.partitionBy("perm_id", "source_id", "ref_id"))
    if drop == "rows":
        return out.withColumn("__n", twice).filter("__n = 1").drop("__n")
    return out.withColumn("__n", twice).withColumn("__m", F.max("__n").over(Window.partitionBy("perm_id", "source_id"))).filter("__m = 1").drop("__n", "__m")


def mcmc_swap(rows: DataFrame, seed: int, sweeps: int = 1, retries: int = 20) -> DataFrame:
    """The rows with references swapped at random within each year, never giving a source a reference it has or is.

    Each swap depends on those before it, so a year is one Python group: the years run side by side.
    """
    ship(rows.sparkSession)
    columns = rows.columns

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        import random

        pdf = pdf.sort_values(["source_id", "ref_id"], ignore_index=True)
        rng = random.Random(f"{seed}-{pdf['ref_year'].iloc[0]}")
        source = pdf["source_id"].tolist()
        at = list(range(len(pdf)))
        ref = pdf["ref_id"].tolist()
        held = set(zip(source, ref, strict=True))
        for _ in range(sweeps):
            for i in range(len(at)):
                for _ in range(retries):
                    j = rng.randrange(len(at))
                    a, b = ref[at[i]], ref[at[j]]
                    if a == b or source[i] == b or source[j] == a or (source[i], b) in held or (source[j], a) in held:
                        continue
                    held -= {(source[i], a), (source[j], b)}
                    held |= {(source[i], b), (source[j], a)}
                    at[i], at[j] = at[j], at[i]
                    break
        new = pdf[["ref_id", "ref_issn"]].iloc[at].reset_index(drop=True)
        return pdf.assign(ref_id=new["ref_id"], ref_issn=new["ref_issn"])[columns]

    return rows.groupBy("ref_year").applyInPandas(swap, rows.schema)


def pair_frequency(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, issn_1, issn_2, frequency: how often references of two journals stand in one source; two references of one
    journal count once each pair. issn_1 <= issn_2."""
    by = by or []
    key = [*by, "source_id"]
    counts = rows.filter("ref_issn is not null").groupBy(*key, "ref_issn").agg(F.count(F.lit(1)).alias("n"))
    one, two = counts.select(*key, F.col("ref_issn").alias("issn_1"), F.col("n").alias("a")), counts.select(*key, F.col("ref_issn").alias("issn_2"), F.col("n").alias("b"))
    # The pairs of journals of a source with their numbers of reference pairs: enumerated once for all references.
    pairs = one.join(two, key).filter("issn_1 <= issn_2")
    n = F.when(F.col("issn_1") == F.col("issn_2"), F.floor(F.col("a") * (F.col("a") - 1) / 2)).otherwise(F.col("a") * F.col("b"))
    return pairs.groupBy(*by, "issn_1", "issn_2").agg(F.sum(n).cast("long").alias("frequency")).filter("frequency > 0")


def z_scores(observed: DataFrame, background: DataFrame, permutations: int, missing: str = "skip", ddof: int = 0) -> DataFrame:
    """issn_1, issn_2, observed, mean, std, n, z: the observed frequency against those of the permutations.

    missing: skip takes mean and deviation over the permutations that have the pair, zero counts the others as 0. With no
    deviation z is infinite with the sign of the difference, and null where there is none or no permutation has the pair.
    """
    key = ["issn_1", "issn_2"]
    f = F.col("frequency").cast("double")
    sums = background.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(f).alias("__mean"), F.var_pop(f).alias("__var"))
    rows = observed.withColumnRenamed("frequency", "observed").join(sums, key, "left")
    m = F.lit(permutations) if missing == "zero" else F.col("n")
    # The permutations without the pair are m - n zeros: their part is added to the n others' squares about the mean.
    rows = rows.withColumn("mean", F.try_divide(F.col("__mean") * F.col("n"), m))
    squares = F.col("n") * F.col("__var") + F.try_divide(F.col("n") * (m - F.col("n")) * F.pow("__mean", 2), m)
    rows = rows.withColumn("std", F.sqrt(F.try_divide(squares, m - ddof)))
    gap = F.col("observed") - F.col("mean")
    infinite = F.when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    return rows.select(*key, "observed", "mean", "std", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("std") > 1e-12, gap / F.col("std")).otherwise(infinite).alias("z"))


def pub_z_summary(rows: DataFrame, z: DataFrame) -> DataFrame:
    """source_id, med, ten, one: median, 10th and 1st percentile of the finite z-scores of a paper's pairs of references.

    Each pair of references counts, so a journal pair counts as often as the paper has such pairs, and a journal's pair
    with itself only where the paper cites it more than once.
    """
    counts = rows.filter("ref_issn is not null").groupBy("source_id", "ref_issn").agg(F.count(F.lit(1)).alias("n"))
    one, two = counts.toDF("source_id", "issn_1", "a"), counts.toDF("source_id", "issn_2", "b")
    times = F.when(F.col("issn_1") == F.col("issn_2"), F.floor(F.col("a") * (F.col("a") - 1) / 2)).otherwise(F.col("a") * F.col("b")).cast("long")
    pairs = one.join(two, "source_id").filter("issn_1 <= issn_2").select("source_id", "issn_1", "issn_2", times.alias("times")).filter("times > 0")
    scored = pairs.join(z.select("issn_1", "issn_2", "z"), ["issn_1", "issn_2"]).filter("z is not null and abs(z) < double('infinity')")
    return scored.groupBy("source_id").agg(*(F.percentile("z", p, F.col("times")).alias(name) for name, p in (("med", 0.5), ("ten", 0.1), ("one", 0.01))))


def pub_pairs(rows: DataFrame, z: DataFrame) -> DataFrame:
    """source_id, ref_1, ref_2, issn_1, issn_2, observed, mean, std, n, z: each pair of references of a paper with the
    figures of its journal pair; pairs without a z-score are left out. issn_1 <= issn_2, of equal ones ref_1 < ref_2."""
    refs = rows.filter("ref_issn is not null").select("source_id", "ref_id", "ref_issn")
    one, two = refs.toDF("source_id", "ref_1", "issn_1"), refs.toDF("source_id", "ref_2", "issn_2")
    pairs = one.join(two, "source_id").filter("issn_1 < issn_2 or (issn_1 = issn_2 and ref_1 < ref_2)")
    known = z.filter("z is not null").select("issn_1", "issn_2", "observed", "mean", "std", "n", "z")
    return pairs.join(known, ["issn_1", "issn_2"]).select("source_id", "ref_1", "ref_2", "issn_1", "issn_2", "observed", "mean", "std", "n", "z")


def category_shares(summary: DataFrame, subset: DataFrame | None = None, low: str = "ten") -> DataFrame:
    """category, n, percent: papers by novelty and conventionality, as whole percents rounded down. With a subset
    (source_id) only its papers count, and conventionality is taken against their own median."""
    rows = summary if subset is None else summary.join(subset.select("source_id").distinct(), "source_id", "left_semi")
    middle, total = rows.agg(F.percentile("med", 0.5)).scalar(), rows.agg(F.count(F.lit(1))).scalar()
    category = F.concat(F.when(F.col("med") <= middle, "LC").otherwise("HC"), F.when(F.col(low) >= 0, "LN").otherwise("HN"))
    counts = rows.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.floor(100 * F.col("n") / total).cast("long"))


def novelty_category(summary: DataFrame, citations: str = "citation_count", low: str = "ten", hit: float = 0.9) -> DataFrame:
    """summary with conventionality (HC above the median of med, else LC), novelty (HN for a negative low tail, else LN)
    and is_hit (citations at or above the quantile)."""
    limits = summary.agg(F.percentile("med", 0.5).alias("m"), F.percentile(citations, hit).alias("h"))
    return summary.withColumns({"conventionality": F.when(F.col("med") > limits.select("m").scalar(), "HC").otherwise("LC"), "novelty": F.when(F.col(low) < 0, "HN").otherwise("LN"), "is_hit": F.col(citations) >= limits.select("h").scalar()})


def category_counts(categories: DataFrame) -> DataFrame:
    """category, n, hits, hit_share, expected_hits (the category's size times the overall share of hits)."""
    total, hits = categories.agg(F.count(F.lit(1)).alias("n")), categories.agg(F.count_if("is_hit").alias("h"))
    counts = categories.groupBy(F.concat("novelty", "conventionality").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_hit").alias("hits"))
    return counts.withColumn("hit_share", F.col("hits") / F.col("n")).withColumn("expected_hits", F.col("n") * hits.scalar().cast("double") / total.scalar())


def chi_square(df: DataFrame, observed: str, expected: str) -> DataFrame:
    """statistic, df, p_value of a goodness-of-fit test over the rows of df."""
    ship(df.sparkSession)
    sums = df.agg(F.sum(F.pow(F.col(observed) - F.col(expected), 2) / F.col(expected)).alias("statistic"), (F.count(F.lit(1)) - 1).alias("df"))
    p = F.udf(lambda x, k: None if x is None or k < 1 else gamma_upper(k / 2, x / 2), "double")
    return sums.withColumn("p_value", p("statistic", "df"))  # one row: the UDF is not in the data's way


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def binomial_tail(k: int, n: int, p: float) -> float:
    """The chance of k or more of n."""
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1))
    return min(1.0, math.fsum(math.exp(x) for x in logs))


def kl_divergence(df: DataFrame, left: str, right: str) -> DataFrame:
    """d_left, d_right, distance: Kullback-Leibler distances, base 2, of two columns taken as distributions, and their mean.

    Rows with a null, or where either is not positive, are left out before the columns are scaled to sum 1.
    """
    rows = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) > 0) & (F.col(right) > 0))
    sums = rows.agg(F.sum(left).cast("double").alias("a"), F.sum(right).cast("double").alias("b"))
    p, q = F.col(left) / sums.select("a").scalar(), F.col(right) / sums.select("b").scalar()
    out = rows.agg(F.sum(p * F.log2(p / q)).alias("d_left"), F.sum(q * F.log2(q / p)).alias("d_right"))
    return out.withColumn("distance", (F.col("d_left") + F.col("d_right")) / 2)


def fold_change(original: DataFrame, shuffled: DataFrame, key: str, n: str = "n") -> DataFrame:
    """key, original, shuffled, fold: shuffled / original, or -original / shuffled where that is larger; whole numbers,
    a missing count is 1, equal ones give 1."""
    rows = original.select(key, F.col(n).alias("original")).join(shuffled.select(key, F.col(n).alias("shuffled")), key, "full").na.fill(1, ["original", "shuffled"])
    fold = F.when(F.col("shuffled") > F.col("original"), F.floor(F.col("shuffled") / F.col("original"))).when(F.col("shuffled") < F.col("original"), -F.floor(F.col("original") / F.col("shuffled"))).otherwise(F.lit(1))
    return rows.withColumn("fold", fold.cast("long"))


def mean_and_error(df: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, mean, error: mean and standard error; the error of a single row is 0."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("error"))


def welford(batches: Iterator[float]) -> tuple[int, float, float]:
    """Count, mean and population deviation in one pass, for checks of the set form."""
    n, mean, m2 = 0, 0.0, 0.0
    for x in batches:
        n += 1
        d = x - mean
        mean += d / n
        m2 += d * (x - mean)
    return n, mean, math.sqrt(m2 / n) if n else 0.0
