"""Graph operators over an edge table (citing, cited). Loops run on the driver, each round is a plan over DataFrames whose
lineage is cut by a table in the shared folder. Loops run until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.packed import PACKED_EDGES, searched
from citeloom.session import discard, materialise, replaced


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("citing", "cited")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree: one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("citing").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("cited").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """degrees with each divided by the number of other nodes."""
    d = degrees(edges)
    others = d.agg((F.count(F.lit(1)) - 1).cast("double")).scalar()
    return d.withColumns({f"{c}_centrality": F.try_divide(F.col(c).cast("double"), others) for c in ("in_degree", "out_degree", "degree")})


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("citing")).distinct(), "citing", "left_semi").join(nodes.select(F.col("node").alias("cited")).distinct(), "cited", "left_semi").select("citing", "cited")


def unique_pairs(edges: DataFrame) -> DataFrame:
    """Undirected edges without repeats and loops, citing < cited."""
    return edges.filter("citing <> cited").select(F.least("citing", "cited").alias("citing"), F.greatest("citing", "cited").alias("cited")).distinct()


def symmetrise(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select("citing", "cited").unionByName(edges.select(F.col("cited").alias("citing"), F.col("citing").alias("cited"))).distinct()


def k_hop(edges: DataFrame, seed: DataFrame, k: int, direction: str = "cited") -> DataFrame:
    """node, hop: the nodes within k steps of the seed with the least number of steps. direction: cited follows references
    backwards in time, citing follows citers, both either."""
    steps = {"cited": edges, "citing": edges.select(F.col("cited").alias("citing"), F.col("citing").alias("cited")), "both": symmetrise(edges)}[direction].select("citing", "cited")
    seen = seed.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, k + 1):
        new = front.join(steps, front["node"] == steps["citing"]).select(F.col("cited").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        front = materialise(new) if k > 2 else new
        seen = seen.unionByName(front)
    return seen


def expand(edges: DataFrame, seed: DataFrame, k: int = 1, direction: str = "both") -> DataFrame:
    """The edges among the nodes within k steps of the seed."""
    return induced(edges, k_hop(edges, seed, k, direction))


def seed_network(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """citing, cited, tag: the seed's references and citations, without loops; an edge of both kinds is tagged cited."""
    s = seed.select("node").distinct()
    refs = edges.join(s, edges["citing"] == s["node"], "left_semi").withColumn("tag", F.lit("cited"))
    cites = edges.join(s, edges["cited"] == s["node"], "left_semi").withColumn("tag", F.lit("citing"))
    return refs.unionByName(cites).filter("citing <> cited").groupBy("citing", "cited").agg(F.min("tag").alias("tag"))


def multi_year_network(edges: DataFrame, seeds: list[DataFrame], texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of the networks of several seeds (node) as one, each once, and their nodes with the columns of texts."""
    seed = None
    for s in seeds:
        seed = s.select("node") if seed is None else seed.unionByName(s.select("node"))
    found = seed_network(edges, seed).select("citing", "cited")
    return found, nodes_of(found).join(texts, "node", "left")


def with_attributes(nodes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """nodes with one array column for each table (node, value): the distinct values of the node, sorted, empty where it has
    none. A node's values are its own record's, so they are few."""
    out = nodes
    for name, rows in tables.items():
        values = rows.filter("value is not null").groupBy("node").agg(F.array_sort(F.collect_set("value")).alias(name))
        out = out.join(values, "node", "left").withColumn(name, F.coalesce(name, F.array().cast(values.schema[name].dataType)))
    return out


def sabpq(edges: DataFrame, seed: DataFrame) -> DataFrame:
    """node, tag: the seed S, its citers A and references B, and the citers P and references Q of all these; of several
    tags the first in the order S, A, B, P, Q."""

    def ends(of: DataFrame, by: str, get: str, tag: int) -> DataFrame:
        return of.select(F.col("node").alias(by)).distinct().join(edges, by).select(F.col(get).alias("node"), F.lit(tag).alias("t"))

    s = seed.select("node", F.lit(0).alias("t")).distinct()
    first = s.unionByName(ends(s, "cited", "citing", 1)).unionByName(ends(s, "citing", "cited", 2)).groupBy("node").agg(F.min("t").alias("t"))
    every = first.unionByName(ends(first, "cited", "citing", 3)).unionByName(ends(first, "citing", "cited", 4)).groupBy("node").agg(F.min("t").alias("t"))
    return every.select("node", F.element_at(F.array(*(F.lit(x) for x in "SABPQ")), F.col("t") + 1).alias("tag"))


def edge_class(edges: DataFrame, high: int) -> DataFrame:
    """edges with class: high or low in-degree (at least high) of the citing and of the cited end, such as high-low."""
    d = edges.groupBy(F.col("cited").alias("node")).agg(F.count(F.lit(1)).alias("n"))

    def side(end: str) -> DataFrame:
        return d.select(F.col("node").alias(end), F.when(F.col("n") >= high, "high").otherwise("low").alias(f"__{end}"))

    out = edges.join(side("citing"), "citing", "left").join(side("cited"), "cited", "left").na.fill("low", ["__citing", "__cited"])
    return out.select("citing", "cited", F.concat_ws("-", "__citing", "__cited").alias("class"))


def role_label(edges: DataFrame) -> DataFrame:
    """node, role: both, cites or is_cited."""
    d = degrees(edges)
    return d.select("node", F.when((F.col("in_degree") > 0) & (F.col("out_degree") > 0), "both").when(F.col("out_degree") > 0, "cites").otherwise("is_cited").alias("role"))


def relabel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with whole numbers from 1 in place of nodes, and the mapping (node, label) in order of node.

    Labels are counted within sorted partitions and shifted by the partitions' sizes, so no task sorts all nodes.
    """
    spread = nodes_of(edges).repartitionByRange("node").sortWithinPartitions("node").withColumn("__p", F.spark_partition_id())
    spread = materialise(spread)
    sizes = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", F.coalesce("__before", F.lit(0)).alias("__before"))
    mapping = spread.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy("node"))).join(before, "__p").select("node", (F.col("__i") + F.col("__before")).cast("long").alias("label"))
    a, b = mapping.select(F.col("node").alias("citing"), F.col("label").alias("a")), mapping.select(F.col("node").alias("cited"), F.col("label").alias("b"))
    return edges.join(a, "citing").join(b, "cited").select(F.col("a").alias("citing"), F.col("b").alias("cited")), mapping


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """label, neighbours: a METIS body, the sorted neighbours of each node of the undirected graph as one text."""
    return symmetrise(edges).groupBy(F.col("citing").alias("label")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("cited")), lambda x: x.cast("string")), " ").alias("neighbours"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: weakly connected components, named by their least node.

    Alternating star contractions: every node hands its larger neighbours to its least one, then its smaller neighbours
    too; the number of rounds grows with the logarithm of the size. A hub's neighbours are aggregated, never collected.
    """
    pairs = materialise(edges.filter("citing <> cited").select(F.greatest("citing", "cited").alias("u"), F.least("citing", "cited").alias("v")).distinct())
    n = pairs.count()
    while n:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = materialise(small)
        m = new.count()
        same = m == n and new.join(pairs, ["u", "v"], "left_anti").isEmpty()
        discard(pairs)
        pairs, n = new, m
        if same:
            break
    # Sorted, not broadcast by the size of the file, in which the components' names are compressed.
    return nodes_of(edges).join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def kcore(edges: DataFrame, k: int) -> DataFrame:
    """The edges (citing < cited) of the k-core: nodes with fewer than k neighbours are dropped until there are none."""
    left = materialise(unique_pairs(edges))
    n = left.count()
    while n:
        keep = degrees(left).filter(F.col("degree") >= k).select("node")
        left = replaced(induced(left, keep), left)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def coreness(edges: DataFrame) -> DataFrame:
    """node, core: the highest k whose k-core holds the node.

    One loop for all k: a node starts with its degree and takes the h-index of its neighbours' values (the most h of
    which h or more have at least h) until no value changes, which is then its coreness. Neighbours are counted by value
    before the shuffle, so a hub is as many rows as its neighbours have values up to its own.
    """
    links = materialise(symmetrise(unique_pairs(edges)).toDF("node", "near"))
    at = materialise(links.groupBy("node").agg(F.count(F.lit(1)).alias("core")))
    down = Window.partitionBy("node").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        values = links.join(at.select(F.col("node").alias("near"), F.col("core").alias("other")), "near").join(at, "node")
        counts = values.groupBy("node", "core", F.least("core", "other").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        reached = counts.withColumn("upto", F.sum("n").over(down))
        new = materialise(reached.groupBy("node", F.col("core").alias("old")).agg(F.max(F.least("v", "upto")).alias("core")))
        same = new.filter("core <> old").isEmpty()
        discard(at)
        at = new
        if same:
            return at.select("node", F.col("core").cast("int").alias("core"))


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """node, rank: ranks that sum to 1; what nodes without references hold is spread over all. Ends when the ranks change
    by less than tolerance in sum, which they do by a factor of damping each round."""
    links = materialise(edges.select("citing", "cited").distinct())
    out = links.groupBy("citing").agg(F.count(F.lit(1)).alias("n"))
    base = materialise(nodes_of(links).join(out.withColumnRenamed("citing", "node"), "node", "left"))
    n, moved = base.count(), 1.0
    ranks = base.withColumn("rank", F.lit(1.0 / n) if n else F.lit(0.0))
    while n and moved >= tolerance:
        lost = ranks.filter("n is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(ranks.filter("n is not null").select(F.col("node").alias("citing"), (F.col("rank") / F.col("n")).alias("p")), "citing").groupBy(F.col("cited").alias("node")).agg(F.sum("p").alias("p"))
        step = ranks.join(given, "node", "left").select("node", "n", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("p", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        new = materialise(step)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        discard(base)
        base, ranks = new, new.drop("old")
    return ranks.select("node", "rank")


def _search(edges: DataFrame, sources: DataFrame, max_depth: int | None, report: str) -> DataFrame | None:
    """packed.searched over edges with whole numbers as nodes that are few enough for a worker to hold; None otherwise."""
    ends, starts = edges.select("citing", "cited"), sources.select("node").distinct()
    if {kind for df in (ends, starts) for _, kind in df.dtypes} != {"bigint"}:
        return None
    links = materialise(ends.dropna().distinct())
    return searched(links, starts, max_depth, report) if links.count() <= PACKED_EDGES else None


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """source, node, distance, paths: the number of shortest directed paths from each source (breadth first, all at once),
    to all nodes that can be reached or, with max_depth, to those within so many steps.

    Each task searches from its share of the sources over the packed graph; a graph too large for that, or one whose nodes
    are no whole numbers, is joined level by level.
    """
    packed = _search(edges, sources, max_depth, "paths")
    return _joined_paths(edges, sources, max_depth) if packed is None else packed


def _joined_paths(edges: DataFrame, sources: DataFrame, max_depth: int | None) -> DataFrame:
    front, links = materialise(sources.select(F.col("node").alias("source"), "node").distinct().withColumns({"distance": F.lit(0), "paths": F.lit(1).cast("long")})), materialise(edges.select("citing", "cited").dropna().distinct())
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.join(links, front["node"] == links["citing"]).groupBy("source", F.col("cited").alias("node")).agg(F.sum("paths").alias("paths"))
        front = materialise(new.join(seen.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(depth).alias("distance"), "paths"))
        if front.isEmpty():
            break
        seen = replaced(seen.unionByName(front), seen) if depth % 8 == 0 else seen.unionByName(front)
    return seen


def through_flagged(edges: DataFrame, sources: DataFrame, targets: DataFrame, flagged: DataFrame, max_depth: int | None = None) -> DataFrame:
    """source, target, distance, paths, paths_through: the shortest paths from each source to each target (of at most
    max_depth steps, if given), and how many of them pass through a flagged node between the two.

    All paths and those that avoid the flagged nodes inside are counted along the levels of one breadth-first search, so
    none is listed. With max_depth a level holds only nodes from which a target is within the steps that are left: a
    shortest path has no others, so distances and counts are the same, and the last levels go straight to the targets.
    """
    links = materialise(edges.select("citing", "cited").distinct())
    ends, marks = targets.select("node").distinct(), flagged.select("node").distinct().withColumn("flag", F.lit(True))
    near = materialise(k_hop(links, ends, max_depth - 1, "citing")) if max_depth else None
    front = materialise(sources.select(F.col("node").alias("source"), "node").distinct().withColumns({"paths": F.lit(1).cast("long"), "clear": F.lit(1).cast("long")}))
    seen, depth = front.select("source", "node"), 0
    out = front.limit(0).select("source", F.col("node").alias("target"), F.lit(0).alias("distance"), "paths", F.col("clear").alias("paths_through"))
    while max_depth is None or depth < max_depth:
        depth += 1
        steps = links if near is None else links.join(near.filter(F.col("hop") <= max_depth - depth).select(F.col("node").alias("cited")), "cited", "left_semi")
        new = front.join(steps, front["node"] == steps["citing"]).groupBy("source", F.col("cited").alias("node")).agg(F.sum("paths").alias("paths"), F.sum("clear").alias("clear"))
        level = materialise(new.join(seen, ["source", "node"], "left_anti").join(marks, "node", "left").select("source", "node", "paths", "clear", F.coalesce("flag", F.lit(False)).alias("flag")))
        if level.isEmpty():
            break
        out = out.unionByName(level.join(ends, "node", "left_semi").select("source", F.col("node").alias("target"), F.lit(depth).alias("distance"), "paths", (F.col("paths") - F.col("clear")).alias("paths_through")))
        front = level.select("source", "node", "paths", F.when(F.col("flag"), 0).otherwise(F.col("clear")).alias("clear"))
        seen = seen.unionByName(level.select("source", "node"))
        if depth % 8 == 0:
            seen = materialise(seen)
    return out


def closeness(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, reached, closeness of each source: nodes reached over the sum of their distances."""
    rows = _search(edges, sources, max_depth, "closeness")
    if rows is None:
        paths = _joined_paths(edges, sources, max_depth).filter("distance > 0")
        rows = paths.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("reached"), F.sum("distance").alias("far"))
    return rows.select("node", "reached", (F.col("reached") / F.col("far")).alias("closeness"))


def betweenness(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, betweenness: the shares of the shortest paths from the sources that pass through the node (not its ends)."""
    parts = _search(edges, sources, max_depth, "betweenness")
    return _joined_betweenness(edges, sources, max_depth) if parts is None else parts.groupBy("node").agg(F.sum("betweenness").alias("betweenness"))


def _joined_betweenness(edges: DataFrame, sources: DataFrame, max_depth: int | None) -> DataFrame:
    tree = materialise(_joined_paths(edges, sources, max_depth))
    links = edges.select("citing", "cited").distinct()
    deepest = tree.agg(F.max("distance")).first()[0] or 0
    above = tree.select("source", F.col("node").alias("citing"), F.col("distance").alias("d0"), F.col("paths").alias("p0"))
    share = tree.filter(F.col("distance") == deepest).select("source", "node", F.lit(0.0).alias("delta"))
    total = share
    for depth in range(deepest, 0, -1):
        low = tree.filter(F.col("distance") == depth).join(share, ["source", "node"])
        up = low.join(links, low["node"] == links["cited"]).join(above.filter(F.col("d0") == depth - 1), ["source", "citing"])
        given = up.groupBy("source", F.col("citing").alias("node")).agg(F.sum(F.col("p0") / F.col("paths") * (1 + F.col("delta"))).alias("delta"))
        level = tree.filter(F.col("distance") == depth - 1).select("source", "node").join(given, ["source", "node"], "left").na.fill(0.0, ["delta"])
        share = materialise(level)
        total = total.unionByName(share)
    return total.filter("source <> node").groupBy("node").agg(F.sum("delta").alias("betweenness"))


def bounded_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_length: int) -> DataFrame:
    """length, paths: the number of directed walks of each length from a source to a target, counted by dynamic programming
    over (node, length) instead of being listed."""
    links = edges.select("citing", "cited").distinct()
    front = sources.select("node").distinct().withColumn("paths", F.lit(1).cast("long"))
    out = None
    for length in range(1, max_length + 1):
        front = materialise(front.join(links, front["node"] == links["citing"]).groupBy(F.col("cited").alias("node")).agg(F.sum("paths").alias("paths")))
        found = front.join(targets.select("node").distinct(), "node", "left_semi").agg(F.coalesce(F.sum("paths"), F.lit(0)).alias("paths")).withColumn("length", F.lit(length))
        out = found if out is None else out.unionByName(found)
    return out.select("length", "paths")


def most_used_nodes(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_length: int, k: int, through: DataFrame | None = None) -> DataFrame:
    """node, paths: the k nodes inside most walks of up to max_length steps from a source to a target, ends not counted.

    through (node) asks for walks that pass, inside, through one of these nodes at least. Walks are counted by length with
    and without having met such a node, from either end, never listed.
    """
    links = edges.select("citing", "cited").distinct()
    back = links.select(F.col("cited").alias("citing"), F.col("citing").alias("cited"))
    marks = through.select("node").distinct().withColumn("flag", F.lit(1)) if through is not None else None

    def counts(start: DataFrame, steps: DataFrame) -> list[DataFrame]:
        """By length: node, walks to it, and those that met no flagged node before it (ends not looked at)."""
        level = [start.select("node").distinct().withColumns({"n": F.lit(1).cast("long"), "clear": F.lit(1).cast("long")})]
        for length in range(1, max_length):
            front = level[-1]
            if marks is not None and length > 1:
                front = front.join(marks, "node", "left").withColumn("clear", F.when(F.col("flag").isNull(), F.col("clear")).otherwise(0)).drop("flag")
            level.append(materialise(front.join(steps, front["node"] == steps["citing"]).groupBy(F.col("cited").alias("node")).agg(F.sum("n").alias("n"), F.sum("clear").alias("clear"))))
        return level

    ahead, behind = counts(sources, links), counts(targets, back)
    out = None
    for a in range(1, max_length):
        for b in range(1, max_length - a + 1):
            part = ahead[a].join(behind[b].withColumnsRenamed({"n": "m", "clear": "clear_m"}), "node")
            paths = F.col("n") * F.col("m")
            if marks is not None:
                part = part.join(marks, "node", "left")
                paths = F.when(F.col("flag").isNotNull(), paths).otherwise(paths - F.col("clear") * F.col("clear_m"))
            part = part.select("node", paths.alias("paths"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("node").agg(F.sum("paths").alias("paths")).filter("paths > 0").orderBy(F.desc("paths"), "node").limit(k)
