"""Clusterings: evaluation, k-core based clustering, matching, merging. C is (cluster_no, node), E (citing, cited)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.graph import components, coreness, degrees, induced, kcore, nodes_of, symmetrise, unique_pairs
from citeloom.operators.skew import pairs_within
from citeloom.session import discard, materialise, replaced


def labelled_edges(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """citing, cited, citing_cluster, cited_cluster; null for nodes without cluster."""
    a = clusters.select(F.col("node").alias("citing"), F.col("cluster_no").alias("citing_cluster"))
    b = clusters.select(F.col("node").alias("cited"), F.col("cluster_no").alias("cited_cluster"))
    return edges.select("citing", "cited").join(a, "citing", "left").join(b, "cited", "left").select("citing", "cited", "citing_cluster", "cited_cluster")


def internal_degrees(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_no, node and its degrees within the cluster, with centralities (over the other nodes with inner edges)."""
    inner = labelled_edges(edges, clusters).filter("citing_cluster = cited_cluster")
    ends = inner.select(F.col("citing_cluster").alias("cluster_no"), F.explode(F.array(F.struct(F.col("citing").alias("node"), F.lit(0).alias("i")), F.struct(F.col("cited").alias("node"), F.lit(1).alias("i")))).alias("e")).select("cluster_no", "e.*")
    d = ends.groupBy("cluster_no", "node").agg(F.sum("i").alias("in_degree"), F.count_if(F.col("i") == 0).alias("out_degree"), F.count(F.lit(1)).alias("degree"))
    others = F.count(F.lit(1)).over(Window.partitionBy("cluster_no")) - 1
    return d.withColumn("centrality", F.try_divide(F.col("degree").cast("double"), others))


def external_degrees(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """node, cluster_no and its degrees to other clusters."""
    outer = labelled_edges(edges, clusters).filter("citing_cluster <> cited_cluster")
    ends = outer.select(F.explode(F.array(F.struct(F.col("citing_cluster").alias("cluster_no"), F.col("citing").alias("node"), F.lit(0).alias("i")), F.struct(F.col("cited_cluster").alias("cluster_no"), F.col("cited").alias("node"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("cluster_no", "node").agg(F.sum("i").alias("in_degree"), F.count_if(F.col("i") == 0).alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def _sums(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_no, l_s inner edges, d_s sum of degrees, boundary edges, ext_in, ext_out: one pass over both ends."""
    e = labelled_edges(edges, clusters)
    same = F.coalesce(F.col("citing_cluster") == F.col("cited_cluster"), F.lit(False))
    ends = e.select(F.explode(F.array(F.struct(F.col("citing_cluster").alias("cluster_no"), same.alias("same"), F.lit(0).alias("i")), F.struct(F.col("cited_cluster").alias("cluster_no"), same.alias("same"), F.lit(1).alias("i")))).alias("e")).select("e.*").filter("cluster_no is not null")
    return ends.groupBy("cluster_no").agg(F.count_if(F.col("same") & (F.col("i") == 0)).alias("l_s"), F.count(F.lit(1)).alias("d_s"), F.count_if(~F.col("same") & (F.col("i") == 1)).alias("ext_in"), F.count_if(~F.col("same") & (F.col("i") == 0)).alias("ext_out"))


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_no, l_s, d_s, modularity: l_s / L - (d_s / 2L)^2 over the L edges of the graph."""
    total = edges.agg(F.count(F.lit(1)).cast("double")).scalar()
    return _sums(edges, clusters).select("cluster_no", "l_s", "d_s", (F.col("l_s") / total - F.pow(F.col("d_s") / (2 * total), 2)).alias("modularity"))


def conductance(edges: DataFrame, clusters: DataFrame, style: str = "cut") -> DataFrame:
    """cluster_no, boundary, volume, conductance: boundary / min(volume, the rest's volume), null if that is 0.

    cut: all edges count. study: only edges with both ends in a cluster, rounded to 3 digits.
    """
    e = edges
    if style == "study":
        e = labelled_edges(edges, clusters).filter("citing_cluster is not null and cited_cluster is not null").select("citing", "cited")
    total = e.agg(F.count(F.lit(1))).scalar()
    s = _sums(e, clusters).select("cluster_no", (F.col("ext_in") + F.col("ext_out")).alias("boundary"), F.col("d_s").alias("volume"))
    value = F.try_divide(F.col("boundary").cast("double"), F.least(F.col("volume"), 2 * total - F.col("volume")))
    return s.withColumn("conductance", F.round(value, 3) if style == "study" else value)


def edge_density(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_no, size, inner_edges, density: inner edges per node."""
    sizes = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(_sums(edges, clusters).select("cluster_no", F.col("l_s").alias("inner_edges")), "cluster_no", "left").na.fill(0, ["inner_edges"]).withColumn("density", F.col("inner_edges") / F.col("size"))


def sampled_clusters(clusters: DataFrame, low: int, high: int) -> DataFrame:
    """The clusters of a size between low and high."""
    keep = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(low, high))
    return clusters.join(keep, "cluster_no", "left_semi")


def article_tiers(edges: DataFrame, clusters: DataFrame, share: float = 0.1) -> DataFrame:
    """cluster_no, node, in_degree, tier: 1 for the top share by citations within the cluster, ties included, 3 for those
    without any, 2 for the others."""
    d = internal_degrees(edges, clusters).select("cluster_no", "node", "in_degree")
    rows = clusters.join(d, ["cluster_no", "node"], "left").na.fill(0, ["in_degree"])
    w = Window.partitionBy("cluster_no")
    place = F.rank().over(w.orderBy(F.desc("in_degree")))
    top = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(w) * share))
    return rows.select("cluster_no", "node", "in_degree", F.when(F.col("in_degree") == 0, 3).when(place <= top, 1).otherwise(2).alias("tier"))


def author_tiers(tiers: DataFrame, authors: DataFrame) -> DataFrame:
    """author, tier_1, tier_2, tier_3: in how many clusters the author's best tier is each."""
    best = tiers.join(authors, "node").groupBy("cluster_no", "author").agg(F.min("tier").alias("tier"))
    return best.groupBy("author").agg(*(F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)))


def tier_shares(tiers: DataFrame, authors: DataFrame) -> DataFrame:
    """author, clusters, tier_1_share: in what part of the author's clusters the best tier is 1."""
    t = author_tiers(tiers, authors)
    total = F.col("tier_1") + F.col("tier_2") + F.col("tier_3")
    return t.select("author", total.alias("clusters"), (F.col("tier_1") / total).alias("tier_1_share"))


def author_stats(clusters: DataFrame, authors: DataFrame, levels: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """For each cluster: articles, authors, co-author pairs (distinct, total, share of all possible), and for each level the
    discrete percentile of papers per author with the authors and articles at or above it."""
    rows = clusters.join(authors, "node").select("cluster_no", "node", "author").distinct()
    papers = rows.groupBy("cluster_no", "author").agg(F.count(F.lit(1)).alias("n"))
    limits = papers.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("num_authors"), *(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n)").cast("long").alias(f"p_{round(p * 100)}") for p in levels))
    articles = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("num_articles"))
    two = rows.join(rows.select("cluster_no", "node", F.col("author").alias("other")), ["cluster_no", "node"]).filter("author < other")
    pairs = two.groupBy("cluster_no", "author", "other").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_no").agg(F.count(F.lit(1)).alias("coauthor_pairs"), F.sum("n").alias("coauthor_total"))
    out = articles.join(limits, "cluster_no", "left").join(pairs, "cluster_no", "left").na.fill(0)
    for p in levels:
        c = f"p_{round(p * 100)}"
        high = papers.join(limits.select("cluster_no", c), "cluster_no").filter(F.col("n") >= F.col(c)).select("cluster_no", "author")
        above = high.groupBy("cluster_no").agg(F.count(F.lit(1)).alias(f"authors_{c}"))
        held = rows.join(high, ["cluster_no", "author"], "left_semi").select("cluster_no", "node").distinct().groupBy("cluster_no").agg(F.count(F.lit(1)).alias(f"articles_{c}"))
        out = out.join(above, "cluster_no", "left").join(held, "cluster_no", "left").na.fill(0)
    possible = F.col("num_authors") * (F.col("num_authors") - 1) / 2
    return out.withColumn("coauthor_share", F.try_divide(F.col("coauthor_pairs").cast("double"), possible))


def match_clusterings(left: DataFrame, right: DataFrame) -> DataFrame:
    """cluster_no, match_no, n_both, n_any, overlap, multiple_options: the right cluster with most common nodes; of several
    the lowest number, and the flag says so."""
    both = left.select("node", F.col("cluster_no").alias("a")).join(right.select("node", F.col("cluster_no").alias("b")), "node").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    w = Window.partitionBy("a")
    rows = both.withColumn("top", F.max("n_both").over(w)).filter("n_both = top").withColumn("options", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("b"))).filter("rn = 1")
    sa, sb = left.groupBy(F.col("cluster_no").alias("a")).agg(F.count(F.lit(1)).alias("na")), right.groupBy(F.col("cluster_no").alias("b")).agg(F.count(F.lit(1)).alias("nb"))
    rows = rows.join(sa, "a").join(sb, "b").withColumn("n_any", F.col("na") + F.col("nb") - F.col("n_both"))
    return rows.select(F.col("a").alias("cluster_no"), F.col("b").alias("match_no"), "n_both", "n_any", (F.col("n_both") / F.col("n_any")).alias("overlap"), (F.col("options") > 1).alias("multiple_options"))


def connected_clusters(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_no, other, edges: for each cluster the other clusters with most edges to it, all of them where several."""
    e = labelled_edges(edges, clusters).filter("citing_cluster <> cited_cluster")
    both = e.select(F.explode(F.array(F.struct(F.col("citing_cluster").alias("cluster_no"), F.col("cited_cluster").alias("other")), F.struct(F.col("cited_cluster").alias("cluster_no"), F.col("citing_cluster").alias("other")))).alias("p")).select("p.*")
    counts = both.groupBy("cluster_no", "other").agg(F.count(F.lit(1)).alias("edges"))
    return counts.withColumn("top", F.max("edges").over(Window.partitionBy("cluster_no"))).filter("edges = top").drop("top")


def shared_author_clusters(clusters: DataFrame, authors: DataFrame, share: float = 0.05) -> DataFrame:
    """cluster_no, other, shared, shared_share: cluster pairs that share at least this part of the first one's authors."""
    rows = clusters.join(authors, "node").select("cluster_no", "author").distinct()
    sizes = rows.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n"))
    both = rows.join(rows.select(F.col("cluster_no").alias("other"), "author"), "author").filter("cluster_no <> other").groupBy("cluster_no", "other").agg(F.count(F.lit(1)).alias("shared"))
    return both.join(sizes, "cluster_no").withColumn("shared_share", F.col("shared") / F.col("n")).filter(F.col("shared_share") >= share).drop("n")


def in_cluster_author_citations(edges: DataFrame, clusters: DataFrame, authors: DataFrame) -> DataFrame:
    """cluster_no, n_edges, n_self: inner citations, and those with a common author of both ends."""
    inner = labelled_edges(edges, clusters).filter("citing_cluster = cited_cluster").select("citing", "cited", F.col("citing_cluster").alias("cluster_no"))
    own = inner.join(authors.select(F.col("node").alias("citing"), "author"), "citing").join(authors.select(F.col("node").alias("cited"), "author"), ["cited", "author"]).select("citing", "cited").distinct().withColumn("self", F.lit(1))
    return inner.join(own, ["citing", "cited"], "left").groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n_edges"), F.count("self").alias("n_self"))


def link_stats(edges: DataFrame, clusters: DataFrame, kind: Column) -> DataFrame:
    """citing_cluster, cited_cluster, kind, n, share: edges between clusters by kind of link, and their part of the pair's."""
    e = labelled_edges(edges, clusters).filter("citing_cluster is not null and cited_cluster is not null").withColumn("kind", kind)
    counts = e.groupBy("citing_cluster", "cited_cluster", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("citing_cluster", "cited_cluster")))


def inter_cluster_matrix(pairs: DataFrame, clusters: DataFrame, value: str) -> DataFrame:
    """cluster_1 <= cluster_2, n, max, median, mean, q1, q3 of a value of the pairs (cited_1, cited_2) between clusters."""
    a, b = clusters.select(F.col("node").alias("cited_1"), F.col("cluster_no").alias("a")), clusters.select(F.col("node").alias("cited_2"), F.col("cluster_no").alias("b"))
    rows = pairs.join(a, "cited_1").join(b, "cited_2").select(F.least("a", "b").alias("cluster_1"), F.greatest("a", "b").alias("cluster_2"), F.col(value).alias("v"))
    return rows.groupBy("cluster_1", "cluster_2").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("max"), F.percentile("v", 0.5).alias("median"), F.avg("v").alias("mean"), F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.75).alias("q3"))


def assign_unclustered(edges: DataFrame, clusters: DataFrame, min_degree: int = 1, mode: str = "total") -> DataFrame:
    """cluster_no, node, n, share for nodes without cluster: the cluster in which most of its members, as a part of its size,
    are neighbours (by references, citations or both), of equal ones the lowest number."""
    links = {"out": edges.select(F.col("citing").alias("node"), F.col("cited").alias("near")), "in": edges.select(F.col("cited").alias("node"), F.col("citing").alias("near")), "total": symmetrise(edges).toDF("node", "near")}[mode]
    free = links.join(clusters.select("node"), "node", "left_anti")
    counts = free.join(clusters.select(F.col("node").alias("near"), "cluster_no"), "near").groupBy("node", "cluster_no").agg(F.countDistinct("near").alias("n")).filter(F.col("n") >= min_degree)
    sizes = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"))
    rows = counts.join(sizes, "cluster_no").withColumn("share", F.col("n") / F.col("size"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("share"), "cluster_no"))).filter("rn = 1").select("cluster_no", "node", "n", "share")


def merge_clusterings(parts: list[DataFrame]) -> DataFrame:
    """cluster_no, node: clusterings one after the other, the numbers of each shifted past those before it."""
    out, shift = None, F.lit(0).cast("long")
    for part in parts:
        rows = part.select((F.col("cluster_no") + shift).cast("long").alias("cluster_no"), "node")
        shift = shift + F.coalesce(part.agg(F.max("cluster_no") + 1).scalar(), F.lit(0))
        out = rows if out is None else out.unionByName(rows)
    return out


def renumber_by_size(clusters: DataFrame) -> DataFrame:
    """cluster_no, node with numbers from 1 for the largest cluster on (of equal ones the lower old number first)."""
    sizes = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n"))
    numbers = sizes.select("cluster_no", F.row_number().over(Window.orderBy(F.desc("n"), "cluster_no")).alias("new"))
    return clusters.join(numbers, "cluster_no").select(F.col("new").alias("cluster_no"), "node")


def unsplit(before: DataFrame, after: DataFrame) -> DataFrame:
    """The clusters of before none of whose nodes are in after."""
    touched = before.join(after.select("node"), "node", "left_semi").select("cluster_no").distinct()
    return before.join(touched, "cluster_no", "left_anti").select("cluster_no", "node")


def marker_cooccurrence(clusterings: DataFrame, markers: DataFrame) -> DataFrame:
    """version, marker_1 < marker_2, cluster_no: markers that share a cluster of a clustering version."""
    m = clusterings.join(markers.select("node"), "node", "left_semi")
    pairs = pairs_within(m.select("version", "cluster_no", "node"), ["version", "cluster_no"], "node")
    return pairs.select("version", "cluster_no", F.col("item_1").alias("marker_1"), F.col("item_2").alias("marker_2"))


def marker_distribution(clusters: DataFrame, markers: DataFrame) -> DataFrame:
    """cluster_no, size, markers, share."""
    m = clusters.join(markers.select("node").withColumn("m", F.lit(1)), "node", "left")
    return m.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"), F.count("m").alias("markers")).withColumn("share", F.col("markers") / F.col("size"))


def clustering_summary(clusters: DataFrame, n_nodes: int | Column) -> DataFrame:
    """One row: clusters with more than one node, their share of the nodes, and the quartiles of their sizes."""
    sizes = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), (100 * F.sum("n") / n_nodes).alias("coverage"), F.min("n").alias("size_min"), F.percentile("n", 0.25).alias("size_q1"), F.percentile("n", 0.5).alias("size_median"), F.avg("n").alias("size_mean"), F.percentile("n", 0.75).alias("size_q3"), F.max("n").alias("size_max"))


def code_composition(clusters: DataFrame, codes: DataFrame, values: list[str]) -> DataFrame:
    """cluster_no and for each code the number of distinct nodes that have it."""
    return clusters.join(codes, "node").groupBy("cluster_no").pivot("code", values).agg(F.countDistinct("node")).na.fill(0)


def kc_clusters(edges: DataFrame, k: int) -> DataFrame:
    """cluster_no, node, modularity: the components of the k-core."""
    core = materialise(kcore(edges, k))
    found = components(core).withColumnRenamed("component", "cluster_no")
    return found.join(modularity(unique_pairs(edges), found).select("cluster_no", "modularity"), "cluster_no")


def ikc(edges: DataFrame, k: int) -> DataFrame:
    """cluster_no, node, core: iterative k-core clustering of all nodes. The components of the innermost core with positive
    modularity are clusters; they are removed, and so on until the core is below k. What is rejected, and what is left
    then, are clusters of one node each with core 0."""
    full = materialise(unique_pairs(edges))
    left, out = full, None
    while not left.isEmpty():
        cores = materialise(coreness(left))
        top = cores.agg(F.max("core")).first()[0]
        if top < k:
            break
        found = materialise(components(induced(left, cores.filter(F.col("core") == top).select("node"))).withColumnRenamed("component", "cluster_no"))
        good = modularity(full, found).filter("modularity > 0").select("cluster_no")
        taken = materialise(found.join(good, "cluster_no", "left_semi").select("cluster_no", "node").withColumn("core", F.lit(top)))
        out = taken if out is None else out.unionByName(taken)
        gone = found.select("node")
        rest = left.join(gone.withColumnRenamed("node", "citing"), "citing", "left_anti").join(gone.withColumnRenamed("node", "cited"), "cited", "left_anti").select("citing", "cited")
        left = replaced(rest, *([left] if left is not full else []), found, cores)
    every = nodes_of(edges)
    lone = every if out is None else every.join(out.select("node"), "node", "left_anti")
    lone = lone.select(F.col("node").alias("cluster_no"), "node", F.lit(0).alias("core"))
    return lone if out is None else out.unionByName(lone)


def kmp_parse(edges: DataFrame, clusters: DataFrame, k: int, p: int, skip_modularity: bool = False) -> DataFrame:
    """cluster_no, node, is_core: clusters parsed into k-cores with attached nodes.

    Edges between clusters are removed; the components of the k-core of each cluster, with positive modularity unless
    skipped, are the new clusters (named by their least node), with core nodes. With p >= 0 another node of the cluster
    with at least p core neighbours joins the new cluster in which they are the largest part of the core; ties go to the
    lowest name. With p < 0 nothing is attached.
    """
    inner = labelled_edges(unique_pairs(edges), clusters).filter("citing_cluster = cited_cluster").select("citing", "cited")
    inner = materialise(inner)
    core = materialise(kcore(inner, k))
    found = components(core).select(F.col("component").alias("cluster_no"), "node")
    if not skip_modularity:
        good = modularity(unique_pairs(edges), found).filter("modularity > 0").select("cluster_no")
        found = found.join(good, "cluster_no", "left_semi")
    found = materialise(found.select("cluster_no", "node"))
    out = found.withColumn("is_core", F.lit(True))
    if p >= 0:
        members = nodes_of(inner).join(found.select("node"), "node", "left_anti")
        near = symmetrise(inner).toDF("node", "near").join(members, "node", "left_semi").join(found.select("cluster_no", F.col("node").alias("near")), "near")
        sizes = found.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"))
        counts = near.groupBy("node", "cluster_no").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= p).join(sizes, "cluster_no").withColumn("share", F.col("n") / F.col("size"))
        joined = counts.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("share"), "cluster_no"))).filter("rn = 1")
        out = out.unionByName(joined.select("cluster_no", "node", F.lit(False).alias("is_core")))
    return out


def kmp_validity(edges: DataFrame, parsed: DataFrame, k: int, p: int) -> DataFrame:
    """cluster_no, size, core_size, min_core_degree, min_attachment, modularity, k_valid, m_valid, p_valid."""
    e = unique_pairs(edges)
    core = parsed.filter("is_core").select("cluster_no", "node")
    inner = internal_degrees(e, core).groupBy("cluster_no").agg(F.min("degree").alias("min_core_degree"))
    outer = parsed.filter("not is_core").select("cluster_no", "node")
    near = symmetrise(e).toDF("node", "near").join(outer, "node").join(core.select(F.col("cluster_no").alias("c"), F.col("node").alias("near")), "near").filter("cluster_no = c").groupBy("cluster_no", "node").agg(F.count(F.lit(1)).alias("n"))
    attach = outer.join(near, ["cluster_no", "node"], "left").na.fill(0, ["n"]).groupBy("cluster_no").agg(F.min("n").alias("min_attachment"))
    sizes = parsed.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("size"), F.count_if("is_core").alias("core_size"))
    m = modularity(e, parsed.select("cluster_no", "node")).select("cluster_no", "modularity")
    rows = sizes.join(inner, "cluster_no", "left").join(attach, "cluster_no", "left").join(m, "cluster_no", "left")
    return rows.withColumns({"k_valid": F.coalesce(F.col("min_core_degree") >= k, F.lit(False)), "m_valid": F.coalesce(F.col("modularity") > 0, F.lit(False)), "p_valid": F.coalesce(F.col("min_attachment") >= p, F.lit(True))})


def kmp_summary(validity: DataFrame) -> DataFrame:
    """measure, n, low, middle, mean, high: over the clusters of kmp_validity, of each of its measures that is not null."""
    names = ["size", "core_size", "min_core_degree", "min_attachment", "modularity"]
    long = validity.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in names))).alias("r")).select("r.*").filter("v is not null")
    return long.groupBy("measure").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.percentile("v", 0.5).alias("middle"), F.avg("v").alias("mean"), F.max("v").alias("high"))


def threshold_clusters(pairs: DataFrame, value: str, quantiles: list[float], max_size: int = 100) -> DataFrame:
    """cluster_no, node, round: single-link clusters of the pairs at or above a quantile of value; components of at most
    max_size nodes are kept, the others go on with the next, higher quantile."""
    left = materialise(pairs.select(F.col("cited_1").alias("citing"), F.col("cited_2").alias("cited"), F.col(value).alias("v")))
    out = None
    for i, q in enumerate(quantiles):
        limit = left.agg(F.percentile("v", q)).first()[0]
        if limit is None:
            break
        strong = left.filter(F.col("v") >= limit)
        found = materialise(components(strong.select("citing", "cited")).withColumnRenamed("component", "cluster_no"))
        sizes = found.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("n"))
        last = i == len(quantiles) - 1
        good = sizes if last else sizes.filter(F.col("n") <= max_size)
        taken = materialise(found.join(good, "cluster_no", "left_semi").select("cluster_no", "node").withColumn("round", F.lit(i + 1)))
        out = taken if out is None else out.unionByName(taken)
        rest = found.join(good, "cluster_no", "left_anti").select("node")
        left = materialise(left.join(rest.withColumnRenamed("node", "citing"), "citing", "left_semi").join(rest.withColumnRenamed("node", "cited"), "cited", "left_semi"))
    return out


def spanning_forest(links: DataFrame) -> DataFrame:
    """a, b, w: the heaviest spanning forest of the links (a < b), of equal weights the lowest (a, b) first.

    In each round every component takes its heaviest link to another one; there are at most log2(nodes) rounds.
    """
    best = F.max_by(F.struct("a", "b", "w"), F.struct(F.col("w"), -F.col("a"), -F.col("b"))).alias("e")
    left = materialise(links.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")))
    out = None
    while not left.isEmpty():
        ends = left.select(F.col("x").alias("c"), "a", "b", "w").unionByName(left.select(F.col("y").alias("c"), "a", "b", "w"))
        chosen = materialise(ends.groupBy("c").agg(best).select("e.*").distinct())
        out = chosen if out is None else out.unionByName(chosen)
        joined = left.join(chosen.select("a", "b"), ["a", "b"], "left_semi").select(F.col("x").alias("citing"), F.col("y").alias("cited"))
        names = materialise(components(joined))
        u, v = names.select(F.col("node").alias("x"), F.col("component").alias("u")), names.select(F.col("node").alias("y"), F.col("component").alias("v"))
        moved = left.join(u, "x", "left").join(v, "y", "left").select("a", "b", "w", F.coalesce("u", "x").alias("x"), F.coalesce("v", "y").alias("y"))
        left = replaced(moved.filter("x <> y"), left, names)
    return out if out is not None else left.select("a", "b", "w")


def agglomerate(matrix: DataFrame, merges: int) -> DataFrame:
    """step, cluster_a < cluster_b, merged, weight: greedy merging, `merges` times, of the two clusters with the heaviest link
    (cluster_1, cluster_2, weight), of equal ones that between the lowest original numbers.

    The merged pair gets a new number above all others and to each other cluster the heavier of the two links. So this is
    single linkage: the merges are the links of the heaviest spanning forest from the heaviest on. That forest is
    found in the cluster; only the first `merges` of its links come to the driver, which numbers them.
    """
    pairs = matrix.select(F.least("cluster_1", "cluster_2").cast("long").alias("a"), F.greatest("cluster_1", "cluster_2").cast("long").alias("b"), F.col("weight").cast("double").alias("w")).filter("a <> b")
    links = materialise(pairs.groupBy("a", "b").agg(F.max("w").alias("w")))
    number = links.agg(F.max("b")).first()[0] or 0
    steps, name = [], {}

    def now(x: int) -> int:
        while x in name:
            x = name[x]
        return x

    for step, (a, b, w) in enumerate(spanning_forest(links).orderBy(F.desc("w"), "a", "b").limit(merges).collect(), 1):
        number += 1
        low, high = sorted((now(a), now(b)))
        name[low] = name[high] = number
        steps.append((step, low, high, number, w))
    return matrix.sparkSession.createDataFrame(steps, "step int, cluster_a long, cluster_b long, merged long, weight double")


def mcl(edges: DataFrame, inflation: float = 2.0, max_rounds: int = 100, least: float = 1e-4, tolerance: float = 1e-6) -> DataFrame:
    """cluster_no, node: Markov clustering by sparse matrix products as joins, until no entry changes by more than tolerance.

    Entries below the share least of their column's largest are dropped, so every column keeps its largest. Raises an
    error if the matrix still changes after max_rounds.
    """
    both = symmetrise(edges).toDF("i", "j")
    loops = both.select(F.col("i"), F.col("i").alias("j")).distinct()
    m = both.unionByName(loops).distinct().withColumn("p", F.lit(1.0))
    column = Window.partitionBy("j")
    norm = lambda d: d.withColumn("p", F.col("p") / F.sum("p").over(column))
    m = materialise(norm(m))
    for _ in range(max_rounds):
        square = m.join(m.select(F.col("i").alias("j"), F.col("j").alias("l"), F.col("p").alias("q")), "j").groupBy("i", F.col("l").alias("j")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        scaled = square.withColumn("p", F.pow(F.col("p") / F.max("p").over(column), F.lit(inflation)))
        new = materialise(norm(scaled.filter(F.col("p") >= least)))
        both = new.unionByName(m.select("i", "j", (-F.col("p")).alias("p"))).groupBy("i", "j").agg(F.abs(F.sum("p")).alias("d"))
        same = both.filter(F.col("d") > tolerance).isEmpty()
        discard(m)
        m = new
        if same:
            break
    else:
        raise RuntimeError(f"Markov clustering still changes after {max_rounds} rounds")
    head = m.groupBy(F.col("j").alias("node")).agg(F.max_by("i", F.struct(F.round("p", 9), -F.col("i"))).alias("h"))
    found = components(head.select(F.col("node").alias("citing"), F.col("h").alias("cited")))
    return found.select(F.col("component").alias("cluster_no"), "node")


def edge_counts(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_no, nodes, inner, incoming, outgoing: edges within each cluster and to and from all that is outside."""
    s = _sums(edges, clusters).select("cluster_no", F.col("l_s").alias("inner"), F.col("ext_in").alias("incoming"), F.col("ext_out").alias("outgoing"))
    sizes = clusters.groupBy("cluster_no").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(s, "cluster_no", "left").na.fill(0, ["inner", "incoming", "outgoing"])


def node_links(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster_no, node, in_inner, in_outer, out_inner, out_outer: of each clustered node the citations and references
    within its cluster and across its border; 0 where it has none."""
    e = labelled_edges(edges, clusters)
    same = F.coalesce(F.col("citing_cluster") == F.col("cited_cluster"), F.lit(False))
    ends = e.select(F.explode(F.array(F.struct(F.col("citing").alias("node"), F.lit("out").alias("way"), same.alias("same")), F.struct(F.col("cited").alias("node"), F.lit("in").alias("way"), same.alias("same")))).alias("x")).select("x.*")
    names = {(w, s): f"{w}_{'inner' if s else 'outer'}" for w in ("in", "out") for s in (True, False)}
    counts = ends.groupBy("node").agg(*(F.count_if((F.col("way") == w) & (F.col("same") == s)).alias(n) for (w, s), n in names.items()))
    return clusters.select("cluster_no", "node").join(counts, "node", "left").na.fill(0, list(names.values())).select("cluster_no", "node", *names.values())


def top_share(edges: DataFrame, clusters: DataFrame, share: float, by: str = "in_inner") -> DataFrame:
    """cluster_no, node, value, place: the share of each cluster's nodes with the most links of a kind of node_links, at
    least one node a cluster (ties by node)."""
    w = Window.partitionBy("cluster_no")
    rows = node_links(edges, clusters).select("cluster_no", "node", F.col(by).alias("value"))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("value"), "node"))).withColumn("__n", F.count(F.lit(1)).over(w))
    return rows.filter(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__n")


def link_types(edges: DataFrame, clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """cluster_1, cluster_2, kind, n, ratio, mean_rank: links between clusters by type, dc (one node cites the other), bc
    (two nodes share references), cc (two nodes are cited together), of the given pairs (cited_1, cited_2).

    n is the number of pairs with such a link, ratio its part of all the pair of clusters has of any type, and mean_rank the
    average over the types of the rank by n (ties share their mean rank, 1 is the most).
    """
    links = pairs.select("cited_1", "cited_2").distinct()
    flipped = edges.select(F.col("cited").alias("citing"), F.col("citing").alias("cited"))
    direct = edges.select(F.least("citing", "cited").alias("cited_1"), F.greatest("citing", "cited").alias("cited_2")).distinct().join(links, ["cited_1", "cited_2"], "left_semi").withColumn("kind", F.lit("dc"))

    def shared(e: DataFrame, kind: str) -> DataFrame:
        one, two = e.select("citing", F.col("cited").alias("cited_1")), e.select("citing", F.col("cited").alias("cited_2"))
        return links.join(one, "cited_1").join(two, ["citing", "cited_2"]).select("cited_1", "cited_2").distinct().withColumn("kind", F.lit(kind))

    every = direct.unionByName(shared(flipped, "bc")).unionByName(shared(edges, "cc"))
    a, b = clusters.select(F.col("node").alias("cited_1"), F.col("cluster_no").alias("a")), clusters.select(F.col("node").alias("cited_2"), F.col("cluster_no").alias("b"))
    rows = every.join(a, "cited_1").join(b, "cited_2").filter("a <> b").groupBy(F.least("a", "b").alias("cluster_1"), F.greatest("a", "b").alias("cluster_2"), "kind").agg(F.count(F.lit(1)).alias("n"))
    w, of_kind = Window.partitionBy("cluster_1", "cluster_2"), Window.partitionBy("kind").orderBy(F.desc("n"))
    place = F.rank().over(of_kind) + (F.count(F.lit(1)).over(Window.partitionBy("kind", "n")) - 1) / 2
    rows = rows.withColumns({"ratio": F.col("n") / F.sum("n").over(w), "__place": place})
    return rows.withColumn("mean_rank", F.avg("__place").over(w)).drop("__place")


def subject_ranks(clusters: DataFrame, subjects: DataFrame, top: int = 3) -> DataFrame:
    """cluster_no, subject, n, place: the subjects (node, subject) of most distinct nodes of each cluster, ties included;
    nodes without subject count under null."""
    rows = clusters.select("cluster_no", "node").distinct().join(subjects.select("node", "subject").distinct(), "node", "left")
    counts = rows.groupBy("cluster_no", "subject").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.rank().over(Window.partitionBy("cluster_no").orderBy(F.desc("n")))).filter(F.col("place") <= top)


def degree_top(edges: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    """cluster_no, node, degree, place: the n nodes of highest total degree of each cluster (ties by node)."""
    d = clusters.join(degrees(edges), "node", "left").na.fill(0, ["degree"])
    return d.withColumn("place", F.row_number().over(Window.partitionBy("cluster_no").orderBy(F.desc("degree"), "node"))).filter(F.col("place") <= n).select("cluster_no", "node", "degree", "place")
