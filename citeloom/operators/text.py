"""Text operators over long token tables: frequencies, divergence, ranking, search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.relational import numbered
from citeloom.session import materialise

# English stop words.
STOP_WORDS = "a about after all also an and any are as at be because been before but by can could did do does each for from had has have he her his how if in into is it its may more most no not of on one only or other our out over she so some such than that the their them then there these they this those through to two under up was we were what when where which while who will with would you".split()


def folded(text: Column) -> Column:
    """Lower case, in which a letter does not depend on its place: the final form of the Greek sigma is the usual one, and
    the dotted capital I becomes a plain i."""
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), "\u03c2", "\u03c3")


def words(text: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """Lower-case words of letters and digits, at least `least` long, not all digits, without stop words, in order."""
    stops = STOP_WORDS if stop is None else stop
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= least) & ~w.rlike(r"^\d+$") & ~w.isin(stops))


def ngrams(tokens: Column, n: int) -> Column:
    """The runs of n tokens, joined by a blank. The tokens are the variable of a lambda, so they are made once and not anew
    for each run."""

    def runs(t: Column) -> Column:
        return F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0))), lambda w, i: F.concat_ws(" ", w, *(F.get(t, i + k) for k in range(1, n))))

    return F.coalesce(F.element_at(F.transform(F.array(tokens), runs), 1), F.array().cast("array<string>"))


def token_table(df: DataFrame, doc: str, text: str, n: int = 1, least: int = 3, stop: list[str] | None = None) -> DataFrame:
    """doc, term, n: how often each term (n-gram) is in each document."""
    tokens = words(F.col("text"), least, stop)
    # Texts are smaller than their terms: these are counted where the text is, not sent by document and term.
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartition("doc").select("doc", (tokens if n == 1 else ngrams(tokens, n)).alias("t"))
    # Outer: for explode the optimiser filters by the size of the array, for which it makes the tokens a second time.
    terms = rows.select("doc", F.explode_outer("t").alias("term")).filter("term is not null")
    return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


def cluster_terms(tokens: DataFrame, clusters: DataFrame, least_docs: int = 2) -> DataFrame:
    """cluster_no, term, df: in how many documents of the cluster a term is, at least least_docs."""
    return tokens.join(clusters.select(F.col("node").alias("doc"), "cluster_no"), "doc").groupBy("cluster_no", "term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least_docs)


def doc_jsd(tokens: DataFrame, clusters: DataFrame, least_docs: int = 2) -> DataFrame:
    """cluster_no, doc, jsd: Jensen-Shannon divergence (natural logarithm) of a document from its cluster.

    p is the document over the cluster's kept terms, q the cluster's document frequencies, both scaled to 1. Terms that
    the document lacks add q * ln 2 / 2 each, so only its own terms are joined; no dense vector is made. Documents
    without a kept term are left out.
    """
    terms = cluster_terms(tokens, clusters, least_docs)
    q = terms.withColumn("q", F.col("df") / F.sum("df").over(Window.partitionBy("cluster_no")))
    rows = tokens.join(clusters.select(F.col("node").alias("doc"), "cluster_no"), "doc").join(q.select("cluster_no", "term", "q"), ["cluster_no", "term"])
    rows = rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cluster_no", "doc")))
    m = (F.col("p") + F.col("q")) / 2
    part = F.sum(F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)) / 2
    rest = F.lit(math.log(2) / 2) * (1 - F.sum("q"))
    return rows.groupBy("cluster_no", "doc").agg(F.greatest(F.lit(0.0), part + rest).alias("jsd"))


def cluster_jsd(tokens: DataFrame, clusters: DataFrame, min_docs: int = 10, least_docs: int = 2) -> DataFrame:
    """cluster_no, size, mean, deviation, low, q1, middle, q3, high of the divergences; null below min_docs documents."""
    d = doc_jsd(tokens, clusters, least_docs)
    sizes = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"))
    stats = d.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("k"), F.avg("jsd").alias("mean"), F.stddev_pop("jsd").alias("deviation"), F.min("jsd").alias("low"), F.percentile("jsd", 0.25).alias("q1"), F.percentile("jsd", 0.5).alias("middle"), F.percentile("jsd", 0.75).alias("q3"), F.max("jsd").alias("high"))
    return sizes.join(stats, "cluster_no", "left").select("cluster_no", "size", *(F.when(F.col("k") >= min_docs, F.col(c)).alias(c) for c in ("mean", "deviation", "low", "q1", "middle", "q3", "high")))


def random_clusters(docs: DataFrame, doc: str, sizes: DataFrame, repeats: int, seed: int = 1) -> DataFrame:
    """size, cluster_no, node: for each cluster size, `repeats` random sets of that many documents (seeded hash order)."""
    many = docs.select(F.col(doc).alias("node")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    placed = materialise(numbered(many.withColumn("h", F.xxhash64(F.lit(seed), "rep", "node")), ["rep", "h", "node"], "i"))
    first = placed.groupBy("rep").agg(F.min("i").alias("low"))
    order = placed.join(F.broadcast(first), "rep").withColumn("place", F.col("i") - F.col("low") + 1)
    picked = order.join(sizes.select("size").distinct(), F.col("place") <= F.col("size"))
    return picked.select("size", F.concat_ws("-", "size", "rep").alias("cluster_no"), "node")


def random_jsd(tokens: DataFrame, docs: DataFrame, doc: str, sizes: DataFrame, repeats: int = 5, seed: int = 1) -> DataFrame:
    """size, random_mean: the mean over random sets of each size of their mean divergence."""
    sets = random_clusters(docs, doc, sizes, repeats, seed)
    means = doc_jsd(tokens, sets.select("cluster_no", "node")).groupBy("cluster_no").agg(F.avg("jsd").alias("m"))
    return means.join(sets.select("size", "cluster_no").distinct(), "cluster_no").groupBy("size").agg(F.avg("m").alias("random_mean"))


def coherence(stats: DataFrame, random: DataFrame) -> DataFrame:
    """cluster_no, size, mean, random_mean, coherence: how much closer the documents are than random ones."""
    return stats.join(random, "size", "left").select("cluster_no", "size", "mean", "random_mean", (F.col("random_mean") - F.col("mean")).alias("coherence"))


def idf(tokens: DataFrame, n_docs: Column) -> DataFrame:
    """term, df, idf = log10((N - df + .5) / (df + .5))."""
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log10((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def similarities(queries: DataFrame, index: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """query, doc, cosine: of the term vectors (doc, term, n), over the terms of the query that both have, weighted by idf
    where weights are given. Candidates share a term: they come from the inverted index."""
    def vector(df: DataFrame, name: str, value: str) -> DataFrame:
        out = df.select(F.col("doc").alias(name), "term", F.col("n").cast("double").alias(value))
        return out if weights is None else out.join(weights.select("term", "idf"), "term").select(name, "term", (F.col(value) * F.col("idf")).alias(value))

    a, b = vector(queries, "query", "x"), vector(index, "doc", "y")
    na, nb = a.groupBy("query").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx")), b.groupBy("doc").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    dots = a.join(b, "term").groupBy("query", "doc").agg(F.sum(F.col("x") * F.col("y")).alias("d"))
    return dots.join(na, "query").join(nb, "doc").select("query", "doc", F.try_divide(F.col("d"), F.col("nx") * F.col("ny")).alias("cosine"))


def bm25(queries: DataFrame, index: DataFrame, lengths: DataFrame, k: float = 2.0, b: float = 0.75, okapi: bool = True) -> DataFrame:
    """query, doc, score of documents that share a term with the query. okapi puts the term frequency into the denominator,
    otherwise it holds the idf, as in the study."""
    n = lengths.agg(F.count(F.lit(1)).cast("double")).scalar()
    mean = lengths.agg(F.avg("length")).scalar()
    w = idf(index, n).select("term", "idf")
    rows = queries.select(F.col("doc").alias("query"), "term").distinct().join(index, "term").join(w, "term").join(lengths, "doc")
    base = k * (1 - b + b * F.col("length") / mean)
    score = F.col("idf") * F.col("n") * (k + 1) / ((F.col("n") if okapi else F.col("idf")) + base)
    return rows.groupBy("query", "doc").agg(F.sum(score).alias("score"))


def rank_matches(scores: DataFrame, first: str, second: str, top: int = 10, share: float = 0.5) -> DataFrame:
    """query, doc, blend, place: both scores scaled to 0..1 within the query and mixed; the top by mix (ties by doc)."""
    w = Window.partitionBy("query")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))

    rows = scores.withColumn("blend", share * scaled(first) + (1 - share) * scaled(second))
    return rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("blend"), "doc"))).filter(F.col("place") <= top).select("query", "doc", "blend", "place")


def match_any(df: DataFrame, fields: dict[str, float], doc: str, query: str) -> DataFrame:
    """doc, hits, score: rows of which some field holds some word of the query (an OR over words and fields).

    hits counts the query's words found in any field; score adds up, for each word, the weight of the best field that
    holds it, as a disjunction-max query does.
    """
    wanted = list(dict.fromkeys("".join(c.lower() if c.isalnum() else " " for c in query).split()))
    lists = {c: F.coalesce(F.split(folded(F.col(c)), r"[^\p{L}\p{N}]+"), F.array().cast("array<string>")) for c in fields}
    best = [F.greatest(F.lit(0.0), *(F.when(F.array_contains(lists[c], w), F.lit(float(weight))).otherwise(0.0) for c, weight in fields.items())) for w in wanted]
    rows = df.select(F.col(doc).alias("doc"), F.array(*best).alias("b"))
    hits, score = F.size(F.filter("b", lambda x: x > 0)), F.aggregate("b", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc", hits.alias("hits"), score.alias("score")).filter("hits > 0")


def text_match(df: DataFrame, doc: str, text: str, query: str, mode: str = "all") -> DataFrame:
    """doc of the texts that match the query: all words, any word, or the words next to each other in order (phrase)."""
    wanted = [w for w in "".join(c.lower() if c.isalnum() else " " for c in query).split()]
    tokens = F.filter(F.split(folded(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if mode == "phrase":
        test = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(" " + " ".join(wanted) + " ")
    else:
        test = F.lit(mode == "all")
        for w in wanted:
            hit = F.array_contains(tokens, w)
            test = (test & hit) if mode == "all" else (test | hit)
    return df.filter(test).select(F.col(doc).alias("doc"))
