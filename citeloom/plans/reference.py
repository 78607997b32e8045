"""Queries for the citation-analytics operators, on graphs derived from the test tables.

Citations: citing = l_orderkey modulo the number of parts, cited = l_partkey, distinct, without loops. A node's year is
1970 + node % 40, its cluster node % 20, its journal p_brand; the authors of a node are the suppliers of its orders. The
sparse graph of the loops is that of the pairs with recorded kinetics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import cocitation as P
from citeloom.operators import disruption as D
from citeloom.operators import graph as G
from citeloom.operators import nullmodel as N
from citeloom.operators import relational as R
from citeloom.operators import scores as S
from citeloom.session import materialise

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").agg(F.count(F.lit(1))).scalar()
    rows = table(spark, folder, "lineitem").select(F.pmod(F.col("l_orderkey"), parts).alias("citing"), F.col("l_partkey").alias("cited"))
    return rows.filter("citing <> cited").distinct()


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select(F.col("p_partkey").alias("node"), (1970 + F.col("p_partkey") % 40).cast("int").alias("year"), (F.col("p_partkey") % 20).cast("int").alias("cluster_no"), F.col("p_brand").alias("issn"))


def authors(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").agg(F.count(F.lit(1))).scalar()
    return table(spark, folder, "lineitem").select(F.pmod(F.col("l_orderkey"), parts).alias("node"), F.col("l_suppkey").alias("author")).distinct()


def recorded_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The sparse graph: pairs of the recorded kinetics, as edges from the lower to the higher id."""
    rows = table(spark, folder, "sb_plus_complete_kinetics")
    return rows.select(F.least("cited_1", "cited_2").alias("citing"), F.greatest("cited_1", "cited_2").alias("cited")).filter("citing is not null and cited is not null and citing <> cited").distinct()


def pair_list(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of parts next to each other, with a year."""
    part = nodes(spark, folder)
    return part.join(part.select(F.col("node").alias("cited_2"), F.col("year").alias("y2")), F.col("node") + 1 == F.col("cited_2")).select(F.col("node").alias("cited_1"), "cited_2", (F.greatest("year", "y2") - 10).alias("first_year"))


COUNT = "(SELECT count(*) FROM part)"
E = f"e AS (SELECT DISTINCT l_orderkey % {COUNT} AS citing, l_partkey AS cited FROM lineitem WHERE l_orderkey % {COUNT} <> l_partkey)"
Y = "y AS (SELECT p_partkey AS node, CAST(1970 + p_partkey % 40 AS INTEGER) AS year, CAST(p_partkey % 20 AS INTEGER) AS cluster_no, p_brand AS issn FROM part)"
A = f"a AS (SELECT DISTINCT l_orderkey % {COUNT} AS node, l_suppkey AS author FROM lineitem)"
K = "k AS (SELECT DISTINCT least(cited_1, cited_2) AS citing, greatest(cited_1, cited_2) AS cited FROM sb_plus_complete_kinetics WHERE cited_1 IS NOT NULL AND cited_2 IS NOT NULL AND cited_1 <> cited_2)"
L = "l AS (SELECT u.node AS cited_1, v.node AS cited_2, greatest(u.year, v.year) - 10 AS first_year FROM y u JOIN y v ON v.node = u.node + 1)"
W = f"WITH {E}, {Y}"
WP = f"{W}, {L}"


# Counts, scores, percentiles.


@query(f"{W}, n AS (SELECT cited AS node, count(*) AS citation_count FROM e GROUP BY cited) SELECT node, citation_count, year AS pub_year FROM n JOIN y USING (node)")
def score_citation_counts(spark, folder):
    return S.citation_counts(citations(spark, folder), nodes(spark, folder))


@query(f"{W} SELECT e.cited AS node, count(*) AS citation_count, z.year AS pub_year FROM e JOIN y ON y.node = e.citing JOIN y z ON z.node = e.cited WHERE y.year BETWEEN z.year AND z.year + 10 GROUP BY ALL")
def score_ten_year_counts(spark, folder):
    return S.citation_counts(citations(spark, folder), nodes(spark, folder), 10)


_WEIGHTED = "n AS (SELECT cited, count(*) AS c FROM e GROUP BY cited), s AS (SELECT e.cited, sum(n.c) AS s FROM e JOIN n ON n.cited = e.citing GROUP BY e.cited), v AS (SELECT citing AS node FROM e UNION SELECT cited FROM e), w AS (SELECT node, coalesce(c, 0) AS citation, CAST(coalesce(c, 0) + coalesce(s, 0) AS BIGINT) AS weighted_citation FROM v LEFT JOIN n ON n.cited = node LEFT JOIN s ON s.cited = node)"


@query(f"WITH {E}, {_WEIGHTED} SELECT * FROM w")
def score_weighted_citation(spark, folder):
    return S.weighted_citation(citations(spark, folder))


@query(
    f"WITH {E}, {A}, {_WEIGHTED}, q AS (SELECT author, count(*) AS in_degree, CAST(sum(coalesce(citation, 0)) AS BIGINT) AS total_citation, CAST(sum(coalesce(weighted_citation, 0)) AS BIGINT) AS pir FROM a LEFT JOIN w USING (node) GROUP BY author) "
    "SELECT *, round(in_degree / (SELECT max(in_degree) FROM q), 6) AS in_degree_scaled, round(total_citation / (SELECT max(total_citation) FROM q), 6) AS total_citation_scaled, round(pir / (SELECT max(pir) FROM q), 6) AS pir_scaled FROM q"
)
def score_authors(spark, folder):
    out = S.author_scores(citations(spark, folder), authors(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_scaled")})


_HAZEN = f"{W}, n AS (SELECT cited AS node, count(*) AS c FROM e GROUP BY cited), h AS (SELECT y.node, y.year, coalesce(n.c, 0) AS citation_count FROM y LEFT JOIN n USING (node)), r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY citation_count) + (count(*) OVER (PARTITION BY year, citation_count) - 1) / 2 AS ar, count(*) OVER (PARTITION BY year) AS n FROM h)"


def _counts(spark, folder):
    return nodes(spark, folder).join(S.citation_counts(citations(spark, folder)), "node", "left").select("node", "year", "citation_count")


@query(_HAZEN + " SELECT node, year, citation_count, CASE WHEN citation_count = 0 THEN 0 ELSE round(100 * (ar - 0.5) / n, 6) END AS hazen_perc FROM r")
def score_hazen(spark, folder):
    return S.hazen(_counts(spark, folder), "citation_count", "year").withColumn("hazen_perc", F.round("hazen_perc", 6))


@query(_HAZEN + ", q AS (SELECT quantile_cont(citation_count, 0.99) AS a, quantile_cont(citation_count, 0.95) AS b, quantile_cont(citation_count, 0.75) AS c FROM h) SELECT node, citation_count, CAST(CASE WHEN citation_count >= a THEN 99 WHEN citation_count >= b THEN 95 WHEN citation_count >= c THEN 75 END AS INTEGER) AS band FROM h, q")
def score_percentile_bands(spark, folder):
    return S.percentile_bands(_counts(spark, folder).na.fill(0, ["citation_count"]), "citation_count", [0.99, 0.95, 0.75]).select("node", "citation_count", "band")


@query(_HAZEN + ", b AS (SELECT *, ntile(20) OVER (ORDER BY citation_count, node) AS bin FROM h) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, min(citation_count) AS low, max(citation_count) AS high, median(citation_count) AS middle FROM b GROUP BY bin")
def score_bin_profile(spark, folder):
    return S.bin_profile(_counts(spark, folder).na.fill(0, ["citation_count"]), "citation_count", "node", 20)


@query(_HAZEN + ", b AS (SELECT *, ntile(10) OVER (ORDER BY citation_count, node) AS bin FROM h) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, count(CASE WHEN year >= 1990 THEN 1 END) AS hits, round(count(CASE WHEN year >= 1990 THEN 1 END) / count(*), 6) AS rate FROM b GROUP BY bin")
def score_hit_rate(spark, folder):
    return S.hit_rate_by_bin(_counts(spark, folder).na.fill(0, ["citation_count"]), "citation_count", "node", F.col("year") >= 1990, 10).withColumn("rate", F.round("rate", 6))


@query(f"{W}, k AS (SELECT p_partkey AS node, p_size % 5 AS kind FROM part) SELECT y.node, y.year AS pub_year, count(*) AS citation_count FROM e JOIN y ON y.node = e.cited JOIN k ON k.node = y.node WHERE y.year BETWEEN 1980 AND 1995 AND k.kind = 2 GROUP BY ALL")
def score_counts_of_kind(spark, folder):
    """Citations of the papers of a range of years and of one type."""
    kinds = table(spark, folder, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 5).alias("kind"))
    return S.counts_of_kind(citations(spark, folder), nodes(spark, folder), 1980, 1995, kinds, 2)


# Degrees.

_DEG = f"WITH {E}, d AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT citing AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT cited, 1, 0 FROM e) GROUP BY node)"


@query(_DEG + " SELECT * FROM d")
def net_degrees(spark, folder):
    return G.degrees(citations(spark, folder))


@query(_DEG + " SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree")
def net_degree_distribution(spark, folder):
    return G.degree_distribution(citations(spark, folder))


@query(_DEG + ", m AS (SELECT count(*) - 1 AS m FROM d) SELECT node, round(in_degree / m, 8) AS in_centrality, round(out_degree / m, 8) AS out_centrality, round(degree / m, 8) AS centrality FROM d, m")
def net_degree_centrality(spark, folder):
    return G.degree_centrality(citations(spark, folder)).select("node", *(F.round(f"{a}_centrality", 8).alias(b) for a, b in (("in_degree", "in_centrality"), ("out_degree", "out_centrality"), ("degree", "centrality"))))


@query(_DEG + " SELECT node, CASE WHEN in_degree > 0 AND out_degree > 0 THEN 'both' WHEN out_degree > 0 THEN 'cites' ELSE 'is_cited' END AS role FROM d")
def net_role_label(spark, folder):
    return G.role_label(citations(spark, folder))


# Network construction.


def _seed(spark, folder):
    return nodes(spark, folder).filter("year = 1985 and cluster_no = 15").select("node")


_S = "s AS (SELECT node FROM y WHERE year = 1985 AND cluster_no = 15)"


@query(f"{W}, {_S} SELECT citing, cited, min(tag) AS tag FROM (SELECT citing, cited, 'cited' AS tag FROM e WHERE citing IN (SELECT node FROM s) UNION ALL SELECT citing, cited, 'citing' FROM e WHERE cited IN (SELECT node FROM s)) GROUP BY ALL")
def net_seed_network(spark, folder):
    return G.seed_network(citations(spark, folder), _seed(spark, folder))


@query(
    f"{W}, {_S}, f AS (SELECT node, min(t) AS t FROM (SELECT node, 0 AS t FROM s UNION ALL SELECT citing, 1 FROM e WHERE cited IN (SELECT node FROM s) UNION ALL SELECT cited, 2 FROM e WHERE citing IN (SELECT node FROM s)) GROUP BY node), "
    "g AS (SELECT node, min(t) AS t FROM (SELECT * FROM f UNION ALL SELECT citing, 3 FROM e WHERE cited IN (SELECT node FROM f) UNION ALL SELECT cited, 4 FROM e WHERE citing IN (SELECT node FROM f)) GROUP BY node) "
    "SELECT node, substr('SABPQ', t + 1, 1) AS tag FROM g"
)
def net_sabpq(spark, folder):
    return G.sabpq(citations(spark, folder), _seed(spark, folder))


@query(f"{W}, {_S}, h1 AS (SELECT DISTINCT cited AS node FROM e WHERE citing IN (SELECT node FROM s) AND cited NOT IN (SELECT node FROM s)), h2 AS (SELECT DISTINCT cited AS node FROM e WHERE citing IN (SELECT node FROM h1) AND cited NOT IN (SELECT node FROM s UNION SELECT node FROM h1)) SELECT node, 0 AS hop FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2")
def net_k_hop(spark, folder):
    return G.k_hop(citations(spark, folder), _seed(spark, folder), 2, "cited")


@query(f"{W}, {_S}, b AS (SELECT node FROM s UNION SELECT cited FROM e WHERE citing IN (SELECT node FROM s) UNION SELECT citing FROM e WHERE cited IN (SELECT node FROM s)) SELECT citing, cited FROM e WHERE citing IN (SELECT node FROM b) AND cited IN (SELECT node FROM b)")
def net_expand(spark, folder):
    return G.expand(citations(spark, folder), _seed(spark, folder), 1, "both")


_SEEDS = "ss AS (SELECT node, year AS seed_year FROM y WHERE year BETWEEN 1985 AND 1987), mn AS (SELECT citing, cited FROM e WHERE citing IN (SELECT node FROM ss) UNION SELECT citing, cited FROM e WHERE cited IN (SELECT node FROM ss))"


@query(f"{W}, {_SEEDS}, v AS (SELECT citing AS node FROM mn UNION SELECT cited FROM mn) SELECT v.node, p_name AS title, p_type AS abstract, CAST((SELECT count(*) FROM mn WHERE mn.citing = v.node) AS BIGINT) AS n_refs FROM v LEFT JOIN part ON p_partkey = v.node")
def net_multi_year(spark, folder):
    """The networks of three years' seeds as one, with its nodes and their texts."""
    seeds = nodes(spark, folder).filter("year between 1985 and 1987")
    texts = table(spark, folder, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"))
    edges, found = G.multi_year_network(citations(spark, folder), [seeds.filter(F.col("year") == y) for y in (1985, 1986, 1987)], texts)
    refs = edges.groupBy(F.col("citing").alias("node")).agg(F.count(F.lit(1)).alias("n_refs"))
    return found.join(refs, "node", "left").na.fill(0, ["n_refs"]).select("node", "title", "abstract", "n_refs")


@query(f"{W}, {A}, {_SEEDS}, v AS (SELECT citing AS node FROM mn UNION SELECT cited FROM mn), p AS (SELECT author AS a, s_nationkey AS nation FROM (SELECT DISTINCT author FROM a) JOIN supplier ON s_suppkey = author) SELECT v.node, y.year, (SELECT count(DISTINCT author) FROM a WHERE a.node = v.node) AS n_authors, (SELECT count(DISTINCT nation) FROM a JOIN p ON p.a = a.author WHERE a.node = v.node) AS n_places FROM v LEFT JOIN y ON y.node = v.node")
def net_attributes(spark, folder):
    """Years, authors and places of a network's nodes."""
    n = nodes(spark, folder)
    seeds = n.filter("year between 1985 and 1987")
    found = G.multi_year_network(citations(spark, folder), [seeds], n.select("node"))[1]
    who = authors(spark, folder)
    places = who.join(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("author"), "s_nationkey"), "author").select("node", F.col("s_nationkey").alias("place"))
    rows = G.with_attributes(found.select("node"), {"authors": who.withColumnRenamed("author", "value"), "places": places.withColumnRenamed("place", "value")})
    return rows.join(n.select("node", "year"), "node", "left").select("node", "year", F.size("authors").cast("long").alias("n_authors"), F.size("places").cast("long").alias("n_places"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'MED:' || p_partkey WHEN p_partkey % 5 = 1 THEN '' WHEN p_partkey % 5 = 2 THEN NULL ELSE 'W:' || p_partkey END AS id FROM part")
def net_repair_ids(spark, folder):
    """Ids without a known prefix get the usual one."""
    key = F.col("p_partkey")
    raw = F.when(key % 5 == 0, F.concat(F.lit("MED:"), key)).when(key % 5 == 1, "").when(key % 5 == 2, F.lit(None)).otherwise(key.cast("string"))
    return table(spark, folder, "part").select("p_partkey", R.repair_ids(raw, ("MED:", "W:"), "W:").alias("id"))


@query(f"{W} SELECT citing, cited FROM e WHERE citing IN (SELECT node FROM y WHERE cluster_no < 5) AND cited IN (SELECT node FROM y WHERE cluster_no < 5)")
def net_induced(spark, folder):
    return G.induced(citations(spark, folder), nodes(spark, folder).filter("cluster_no < 5"))


@query(f"WITH {E} SELECT DISTINCT least(citing, cited) AS citing, greatest(citing, cited) AS cited FROM e")
def net_unique_pairs(spark, folder):
    return G.unique_pairs(citations(spark, folder))


@query(f"WITH {E} SELECT citing, cited FROM e UNION SELECT cited, citing FROM e")
def net_symmetrise(spark, folder):
    return G.symmetrise(citations(spark, folder))


@query(f"WITH {E}, d AS (SELECT cited AS node, count(*) AS n FROM e GROUP BY cited) SELECT citing, cited, CASE WHEN a.n >= 30 THEN 'high' ELSE 'low' END || '-' || CASE WHEN b.n >= 30 THEN 'high' ELSE 'low' END AS class FROM e LEFT JOIN d a ON a.node = citing LEFT JOIN d b ON b.node = cited")
def net_edge_class(spark, folder):
    return G.edge_class(citations(spark, folder), 30)


@query(f"WITH {E}, v AS (SELECT citing AS node FROM e UNION SELECT cited FROM e), m AS (SELECT node, row_number() OVER (ORDER BY node) AS label FROM v) SELECT a.label AS citing, b.label AS cited FROM e JOIN m a ON a.node = citing JOIN m b ON b.node = cited")
def net_relabel(spark, folder):
    return G.relabel(citations(spark, folder))[0]


@query(f"WITH {E}, b AS (SELECT citing AS x, cited AS z FROM e UNION SELECT cited, citing FROM e) SELECT x AS label, string_agg(CAST(z AS VARCHAR), ' ' ORDER BY z) AS neighbours FROM b GROUP BY x")
def net_adjacency_lists(spark, folder):
    return G.adjacency_lists(citations(spark, folder))


@query(f"{W} SELECT y.node, y.year, y.issn, a.citing AS citer, z.year AS citer_year FROM y JOIN e a ON a.cited = y.node JOIN y z ON z.node = a.citing")
def net_enrich(spark, folder):
    n = nodes(spark, folder)
    return citations(spark, folder).join(n.select(F.col("node").alias("cited"), "year", "issn"), "cited").join(n.select(F.col("node").alias("citing"), F.col("year").alias("citer_year")), "citing").select(F.col("cited").alias("node"), "year", "issn", F.col("citing").alias("citer"), "citer_year")


# Loops over the citation graph. In the SQL a loop is a recursion whose rows carry the whole state and its number.

_U = "u AS (SELECT DISTINCT least(citing, cited) AS a, greatest(citing, cited) AS b FROM e), b2 AS (SELECT a AS x, b AS z FROM u UNION ALL SELECT b, a FROM u)"
CORE_K, ROUNDS = 41, 60


@query(f"WITH RECURSIVE {E}, {_U}, v AS (SELECT DISTINCT x FROM b2), r(i, x, c) AS (SELECT 0, x, x FROM v UNION ALL SELECT i + 1, r.x, least(r.c, m.c) FROM r JOIN (SELECT b2.x, min(q.c) AS c FROM b2 JOIN r q ON q.x = b2.z GROUP BY b2.x) m ON m.x = r.x WHERE i < 12) SELECT x AS node, c AS component FROM r WHERE i = 12")
def graph_components(spark, folder):
    return G.components(citations(spark, folder))


_KCORE = f"k(i, a, b) AS (SELECT 0, a, b FROM u UNION ALL SELECT i + 1, k.a, k.b FROM k WHERE i < {ROUNDS} AND k.a IN (SELECT x FROM (SELECT a AS x FROM k UNION ALL SELECT b FROM k) GROUP BY x HAVING count(*) >= {CORE_K}) AND k.b IN (SELECT x FROM (SELECT a AS x FROM k UNION ALL SELECT b FROM k) GROUP BY x HAVING count(*) >= {CORE_K}))"


@query(f"WITH RECURSIVE {E}, {_U}, {_KCORE} SELECT a AS citing, b AS cited FROM k WHERE i = {ROUNDS}")
def graph_kcore(spark, folder):
    return G.kcore(citations(spark, folder), CORE_K)


_CORENESS = f"d0 AS (SELECT x, count(*) AS c FROM b2 GROUP BY x), h(i, x, c) AS (SELECT 0, x, c FROM d0 UNION ALL SELECT i + 1, x, max(least(v, n)) FROM (SELECT q.i, b2.x, w.c AS v, row_number() OVER (PARTITION BY b2.x ORDER BY w.c DESC) AS n FROM b2 JOIN h w ON w.x = b2.z JOIN h q ON q.x = b2.x WHERE q.i < {ROUNDS}) GROUP BY i, x)"


@query(f"WITH RECURSIVE {E}, {_U}, {_CORENESS} SELECT x AS node, CAST(c AS INTEGER) AS core FROM h WHERE i = {ROUNDS}")
def graph_coreness(spark, folder):
    return G.coreness(citations(spark, folder))


_RANK = (
    "v AS (SELECT citing AS x FROM e UNION SELECT cited FROM e), o AS (SELECT citing AS x, count(*) AS n FROM e GROUP BY citing), t AS (SELECT count(*) AS n FROM v), "
    "p(i, x, r) AS (SELECT 0, x, 1.0::DOUBLE / t.n FROM v, t UNION ALL SELECT p.i + 1, p.x, 0.15 / t.n + 0.85 * l.lost / t.n + 0.85 * coalesce(g.r, 0) FROM p, t, (SELECT coalesce(sum(q.r), 0) AS lost FROM p q WHERE q.x NOT IN (SELECT x FROM o)) l "
    "LEFT JOIN (SELECT e.cited AS x, sum(q.r / o.n) AS r FROM e JOIN p q ON q.x = e.citing JOIN o ON o.x = e.citing GROUP BY e.cited) g ON g.x = p.x WHERE p.i < 40), "
    "m AS (SELECT a.i, sum(abs(a.r - b.r)) AS moved FROM p a JOIN p b ON b.i = a.i - 1 AND b.x = a.x GROUP BY a.i), w AS (SELECT min(i) AS i FROM m WHERE moved < 1e-4)"
)


@query(f"WITH RECURSIVE {E}, {_RANK} SELECT x AS node, round(r, 8) AS rank FROM p WHERE i = (SELECT i FROM w)")
def graph_pagerank(spark, folder):
    return G.pagerank(citations(spark, folder)).withColumn("rank", F.round("rank", 8))


LEVELS = 8


def _levels_sql() -> str:
    """Breadth first from the seed, level by level: l<d> (source, node, paths), lv all levels with their distance."""
    out = ["l0 AS (SELECT node AS source, node, 1::HUGEINT AS paths FROM s)", "z0 AS (SELECT source, node FROM l0)"]
    for d in range(1, LEVELS + 1):
        out.append(f"l{d} AS (SELECT n.* FROM (SELECT source, e.cited AS node, sum(paths) AS paths FROM l{d - 1} JOIN e ON e.citing = node GROUP BY ALL) n ANTI JOIN z{d - 1} z ON z.source = n.source AND z.node = n.node)")
        out.append(f"z{d} AS (SELECT * FROM z{d - 1} UNION ALL SELECT source, node FROM l{d})")
    every = " UNION ALL ".join(f"SELECT source, node, {d} AS distance, paths FROM l{d}" for d in range(LEVELS + 1))
    return ", ".join(out) + f", lv AS ({every})"


_BFS = f"{W}, s AS (SELECT node FROM y WHERE year = 1985 AND cluster_no = 15), {_levels_sql()}"


@query(_BFS + " SELECT source, node, CAST(distance AS INTEGER) AS distance, CAST(paths AS BIGINT) AS paths FROM lv")
def graph_shortest_paths(spark, folder):
    return G.shortest_paths(citations(spark, folder), _seed(spark, folder))


@query(_BFS + " SELECT source AS node, count(*) AS reached, round(count(*) / sum(distance), 8) AS closeness FROM lv WHERE distance > 0 GROUP BY source")
def graph_closeness(spark, folder):
    return G.closeness(citations(spark, folder), _seed(spark, folder)).withColumn("closeness", F.round("closeness", 8))


_DELTA = f"b{LEVELS} AS (SELECT source, node, 0.0::DOUBLE AS delta FROM l{LEVELS})" + "".join(
    f", b{d} AS (SELECT a.source, a.node, coalesce(sum(CASE WHEN c.node IS NOT NULL THEN a.paths / c.paths::DOUBLE * (1 + g.delta) END), 0) AS delta FROM l{d} a LEFT JOIN e ON e.citing = a.node LEFT JOIN l{d + 1} c ON c.source = a.source AND c.node = e.cited LEFT JOIN b{d + 1} g ON g.source = c.source AND g.node = c.node GROUP BY a.source, a.node)" for d in range(LEVELS - 1, 0, -1)
)


@query(_BFS + f", {_DELTA} SELECT node, round(sum(delta), 5) AS betweenness FROM (" + " UNION ALL ".join(f"SELECT node, delta FROM b{d}" for d in range(1, LEVELS + 1)) + ") GROUP BY node")
def graph_betweenness(spark, folder):
    return G.betweenness(citations(spark, folder), _seed(spark, folder)).withColumn("betweenness", F.round("betweenness", 5))


def _ends(spark, folder):
    n = nodes(spark, folder)
    return n.filter("year = 2009 and cluster_no = 19").select("node"), n.filter("year = 1970 and cluster_no = 0").select("node")


_WALK = "s AS (SELECT node FROM y WHERE year = 2009 AND cluster_no = 19), t AS (SELECT node FROM y WHERE year = 1970 AND cluster_no = 0)"


@query(f"{W}, {_WALK}, w1 AS (SELECT cited AS node, count(*) AS p FROM e JOIN s ON s.node = citing GROUP BY cited), w2 AS (SELECT cited AS node, sum(p) AS p FROM e JOIN w1 ON w1.node = citing GROUP BY cited), w3 AS (SELECT cited AS node, sum(p) AS p FROM e JOIN w2 ON w2.node = citing GROUP BY cited) SELECT 1 AS length, CAST(coalesce(sum(p), 0) AS BIGINT) AS paths FROM w1 JOIN t USING (node) UNION ALL SELECT 2, CAST(coalesce(sum(p), 0) AS BIGINT) FROM w2 JOIN t USING (node) UNION ALL SELECT 3, CAST(coalesce(sum(p), 0) AS BIGINT) FROM w3 JOIN t USING (node)")
def graph_bounded_paths(spark, folder):
    return G.bounded_paths(citations(spark, folder), *_ends(spark, folder), 3)


_FLAG = "f AS (SELECT node FROM y WHERE cluster_no = 7)"


@query(f"{W}, {_WALK}, {_FLAG}, s1 AS (SELECT DISTINCT s.node AS source, e.cited AS node FROM s JOIN e ON e.citing = s.node), p2 AS (SELECT a.source, e.cited AS target, count(*) AS paths, count(*) FILTER (WHERE a.node IN (SELECT node FROM f)) AS paths_through FROM s1 a JOIN e ON e.citing = a.node GROUP BY ALL), near AS (SELECT source, node AS target, 1 AS distance, 1 AS paths, 0 AS paths_through FROM s1 UNION ALL SELECT source, target, 2, paths, paths_through FROM p2 WHERE source <> target AND (source, target) NOT IN (SELECT (source, node) FROM s1)), p3 AS (SELECT a.source, d.cited AS target, count(*) AS paths, count(*) FILTER (WHERE a.node IN (SELECT node FROM f) OR c.cited IN (SELECT node FROM f)) AS paths_through FROM s1 a JOIN e c ON c.citing = a.node JOIN e d ON d.citing = c.cited JOIN t ON t.node = d.cited WHERE c.cited <> a.source AND (a.source, c.cited) NOT IN (SELECT (source, node) FROM s1) GROUP BY ALL) "
       "SELECT source, target, CAST(distance AS INTEGER) AS distance, CAST(paths AS BIGINT) AS paths, CAST(paths_through AS BIGINT) AS paths_through FROM near JOIN t ON t.node = target WHERE source <> target UNION ALL SELECT source, target, 3, paths, paths_through FROM p3 WHERE source <> target AND (source, target) NOT IN (SELECT (source, target) FROM near)".replace("(SELECT (source, node)", "(SELECT row(source, node)").replace("(SELECT (source, target)", "(SELECT row(source, target)").replace("(source, target) NOT IN", "row(source, target) NOT IN").replace("(a.source, c.cited) NOT IN", "row(a.source, c.cited) NOT IN"))
def graph_through_flagged(spark, folder):
    """Shortest paths between two sets of nodes, at most 3 steps here, with those through a flagged node."""
    return G.through_flagged(citations(spark, folder), *_ends(spark, folder), nodes(spark, folder).filter("cluster_no = 7"), 3)


@query(
    f"{W}, {_WALK}, {_FLAG}, p2 AS (SELECT a.cited AS u FROM e a JOIN s ON s.node = a.citing JOIN e b ON b.citing = a.cited JOIN t ON t.node = b.cited WHERE a.cited IN (SELECT node FROM f)), "
    "p3 AS (SELECT a.cited AS u, b.cited AS v FROM e a JOIN s ON s.node = a.citing JOIN e b ON b.citing = a.cited JOIN e c ON c.citing = b.cited JOIN t ON t.node = c.cited WHERE a.cited IN (SELECT node FROM f) OR b.cited IN (SELECT node FROM f)), "
    "n AS (SELECT u AS node FROM p2 UNION ALL SELECT u FROM p3 UNION ALL SELECT v FROM p3) SELECT node, count(*) AS paths FROM n GROUP BY node ORDER BY count(*) DESC, node LIMIT 10"
)
def graph_most_used_through(spark, folder):
    return G.most_used_nodes(citations(spark, folder), *_ends(spark, folder), 3, 10, nodes(spark, folder).filter("cluster_no = 7"))


@query(f"{W}, {_WALK}, m AS (SELECT a.cited AS node, count(*) AS p FROM e a JOIN s ON s.node = a.citing JOIN e b ON b.citing = a.cited JOIN t ON t.node = b.cited GROUP BY 1) SELECT node, CAST(p AS BIGINT) AS paths FROM m ORDER BY p DESC, node LIMIT 10")
def graph_most_used_nodes(spark, folder):
    return G.most_used_nodes(citations(spark, folder), *_ends(spark, folder), 2, 10)


# Co-citation.

_CO = "c AS (SELECT a.cited AS cited_1, b.cited AS cited_2, count(*) AS frequency FROM e a JOIN e b ON a.citing = b.citing AND a.cited < b.cited GROUP BY ALL)"


@query(f"WITH {E}, {_CO} SELECT * FROM c")
def cocite_pairs(spark, folder):
    return P.cocited_pairs(citations(spark, folder))


@query(f"WITH {E}, {_CO}, n AS (SELECT cited, count(*) AS n FROM e GROUP BY cited) SELECT c.*, round(frequency / sqrt(CAST(a.n AS DOUBLE) * b.n), 8) AS normalized FROM c JOIN n a ON a.cited = cited_1 JOIN n b ON b.cited = cited_2")
def cocite_normalized(spark, folder):
    e = citations(spark, folder)
    return P.normalized_frequency(e, P.cocited_pairs(e)).withColumn("normalized", F.round("normalized", 8))


@query(f"WITH {E.replace('e AS', 'e0 AS', 1)}, e AS (SELECT * FROM e0 WHERE citing IN (SELECT citing FROM e0 GROUP BY citing HAVING count(*) >= 30)), {_CO} SELECT * FROM c WHERE frequency >= 2")
def cocite_restricted_pairs(spark, folder):
    return P.cocited_pairs(P.restricted_edges(citations(spark, folder), 30)).filter("frequency >= 2")


@query(f"{WP}, b AS (SELECT l.cited_1, l.cited_2, count(*) AS f FROM l JOIN e u ON u.cited = l.cited_1 JOIN e v ON v.cited = l.cited_2 AND v.citing = u.citing GROUP BY ALL) SELECT l.cited_1, l.cited_2, coalesce(f, 0) AS frequency FROM l LEFT JOIN b USING (cited_1, cited_2)")
def cocite_given_pairs(spark, folder):
    return P.cocited_pairs(citations(spark, folder), pair_list(spark, folder))


@query(_HAZEN + ", t AS (SELECT node FROM r WHERE citation_count > 0 AND 100 * (ar - 0.5) / n >= 90), te AS (SELECT e.* FROM e JOIN t ON t.node = e.cited) SELECT a.cited AS cited_1, b.cited AS cited_2, count(*) AS frequency FROM te a JOIN te b ON a.citing = b.citing AND a.cited < b.cited GROUP BY ALL")
def cocite_top_ranked(spark, folder):
    """Pairs among the references of the highest ranks of their year."""
    top = S.hazen(_counts(spark, folder), "citation_count", "year").filter("hazen_perc >= 90").select(F.col("node").alias("cited"))
    return P.cocited_pairs(citations(spark, folder).join(top, "cited", "left_semi"))


_PAT = "pt AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'US' ELSE 'EP' END AS country, l_orderkey AS doc_number, l_partkey AS scp FROM lineitem)"


@query(f"{WP}, {_PAT} SELECT l.cited_1, l.cited_2, a.country, a.doc_number FROM l JOIN pt a ON a.scp = l.cited_1 JOIN pt b ON b.country = a.country AND b.doc_number = a.doc_number AND b.scp = l.cited_2")
def cocite_patents(spark, folder):
    """Patents that cite both publications of a pair."""
    cites = table(spark, folder, "lineitem").select(F.when(F.col("l_linenumber") == 1, "US").otherwise("EP").alias("country"), F.col("l_orderkey").alias("doc_number"), F.col("l_partkey").alias("scp"))
    return P.patent_cocitation(pair_list(spark, folder), cites, ["country", "doc_number"])


@query(f"{WP} SELECT l.cited_1, l.cited_2, (SELECT count(*) FROM e WHERE (citing = l.cited_1 AND cited = l.cited_2) OR (citing = l.cited_2 AND cited = l.cited_1)) AS edges FROM l")
def cocite_edges_between(spark, folder):
    return P.edges_between(citations(spark, folder), pair_list(spark, folder))


@query(f"SELECT l_partkey AS node, count(*) AS edges FROM lineitem WHERE l_orderkey % {COUNT} = l_partkey GROUP BY 1")
def cocite_self_citations(spark, folder):
    parts = table(spark, folder, "part").agg(F.count(F.lit(1))).scalar()
    return P.self_citations(table(spark, folder, "lineitem").select(F.pmod(F.col("l_orderkey"), parts).alias("citing"), F.col("l_partkey").alias("cited")))


_KIN = "ks AS (SELECT l.cited_1, l.cited_2, z.year AS co_cited_year, count(*) AS frequency FROM l JOIN e u ON u.cited = l.cited_1 JOIN e v ON v.cited = l.cited_2 AND v.citing = u.citing JOIN y z ON z.node = u.citing GROUP BY ALL)"


@query(f"{WP}, {_KIN} SELECT * FROM ks")
def cocite_kinetics(spark, folder):
    return P.kinetics(citations(spark, folder), nodes(spark, folder), pair_list(spark, folder))


@query(
    f"{WP}, {_KIN}, q AS (SELECT *, max(frequency) OVER w AS max_frequency, min(frequency) OVER w AS min_frequency, min(co_cited_year) OVER w AS first_co_cited_year, sum(frequency) OVER w AS s FROM ks WINDOW w AS (PARTITION BY cited_1, cited_2)), "
    "p AS (SELECT *, min(CASE WHEN frequency = max_frequency THEN co_cited_year END) OVER w AS peak_year, count(CASE WHEN frequency = max_frequency THEN 1 END) OVER w AS peak_count FROM q WINDOW w AS (PARTITION BY cited_1, cited_2)) "
    "SELECT p.cited_1, p.cited_2, co_cited_year, frequency, a.year AS cited_1_pub_year, b.year AS cited_2_pub_year, greatest(a.year, b.year) AS first_possible_year, max_frequency, min_frequency, first_co_cited_year, peak_year, peak_count FROM p LEFT JOIN y a ON a.node = p.cited_1 LEFT JOIN y b ON b.node = p.cited_2 WHERE s >= 2 AND co_cited_year >= greatest(a.year, b.year)"
)
def cocite_kinetics_summary(spark, folder):
    n = nodes(spark, folder)
    return P.kinetics_summary(P.kinetics(citations(spark, folder), n, pair_list(spark, folder)), n, 2, 0)


def _filled(spark, folder):
    rows = table(spark, folder, "sb_plus_complete_kinetics").filter("cited_1 <> cited_2 and co_cited_year is not null and frequency is not null")
    series = rows.groupBy(F.least("cited_1", "cited_2").alias("cited_1"), F.greatest("cited_1", "cited_2").alias("cited_2"), F.col("co_cited_year").cast("int").alias("co_cited_year")).agg(F.max("frequency").alias("frequency"))
    return R.fill_years(series, ["cited_1", "cited_2"], "co_cited_year", F.min("co_cited_year"), F.max("co_cited_year"), ["frequency"])


_FILL = (
    "WITH s AS (SELECT least(cited_1, cited_2) AS cited_1, greatest(cited_1, cited_2) AS cited_2, CAST(co_cited_year AS INTEGER) AS y, max(frequency) AS f FROM sb_plus_complete_kinetics WHERE cited_1 <> cited_2 AND co_cited_year IS NOT NULL AND frequency IS NOT NULL GROUP BY ALL), "
    "r AS (SELECT cited_1, cited_2, unnest(generate_series(min(y), max(y))) AS y FROM s GROUP BY cited_1, cited_2), g AS (SELECT r.cited_1, r.cited_2, CAST(r.y AS INTEGER) AS co_cited_year, coalesce(s.f, 0) AS frequency FROM r LEFT JOIN s USING (cited_1, cited_2, y))"
)


_POSSIBLE = "f AS (SELECT least(cited_1, cited_2) AS cited_1, greatest(cited_1, cited_2) AS cited_2, CAST(min(first_possible_year) AS INTEGER) AS f FROM sb_plus_complete_kinetics WHERE cited_1 <> cited_2 AND first_possible_year IS NOT NULL GROUP BY 1, 2)"


def _possible(spark, folder):
    rows = table(spark, folder, "sb_plus_complete_kinetics").filter("cited_1 <> cited_2 and first_possible_year is not null")
    return rows.groupBy(F.least("cited_1", "cited_2").alias("cited_1"), F.greatest("cited_1", "cited_2").alias("cited_2")).agg(F.min("first_possible_year").cast("int").alias("first_possible_year"))


def _filled_from_possible(spark, folder):
    series = _filled(spark, folder).select("cited_1", "cited_2", "co_cited_year", "frequency").join(_possible(spark, folder), ["cited_1", "cited_2"]).filter("co_cited_year >= first_possible_year")
    return R.fill_years(series, ["cited_1", "cited_2"], "co_cited_year", F.min("first_possible_year"), F.max("co_cited_year"), ["frequency"]).select("cited_1", "cited_2", "co_cited_year", "frequency")


_FROM = _FILL + ", " + _POSSIBLE + ", gp AS (SELECT g.* FROM g JOIN f USING (cited_1, cited_2) WHERE co_cited_year >= f.f), ry AS (SELECT gp.cited_1, gp.cited_2, unnest(generate_series(min(f.f), max(co_cited_year))) AS y FROM gp JOIN f USING (cited_1, cited_2) GROUP BY gp.cited_1, gp.cited_2), gf AS (SELECT ry.cited_1, ry.cited_2, CAST(ry.y AS INTEGER) AS co_cited_year, coalesce(gp.frequency, 0) AS frequency FROM ry LEFT JOIN gp ON gp.cited_1 = ry.cited_1 AND gp.cited_2 = ry.cited_2 AND gp.co_cited_year = ry.y)"


@query(_FROM + " SELECT * FROM gf")
def cocite_gap_fill_from_possible(spark, folder):
    """Zero rows from the first year in which both could be cited."""
    return _filled_from_possible(spark, folder)


@query(
    _FROM + ", q AS (SELECT *, min(co_cited_year) OVER w AS t0, max(frequency) OVER w AS top, arg_min(frequency, co_cited_year) OVER w AS c0 FROM gf WINDOW w AS (PARTITION BY cited_1, cited_2)), p AS (SELECT *, min(CASE WHEN frequency = top THEN co_cited_year END) OVER (PARTITION BY cited_1, cited_2) AS tp FROM q) "
    "SELECT cited_1, cited_2, round(coalesce(sum(CASE WHEN tp > t0 THEN ((top - c0) / (tp - t0) * (co_cited_year - t0) + c0 - frequency) / greatest(1, frequency) END), 0), 6) AS sb FROM p WHERE co_cited_year <= tp GROUP BY ALL"
)
def cocite_sleeping_beauty_from_possible(spark, folder):
    """The line begins at the first year in which both could be cited."""
    start = _possible(spark, folder).withColumnRenamed("first_possible_year", "start_year")
    return P.sleeping_beauty(_filled_from_possible(spark, folder), start=start).withColumn("sb", F.round("sb", 6))


@query(_FILL + " SELECT * FROM g")
def cocite_gap_fill(spark, folder):
    return _filled(spark, folder)


@query(
    _FILL + ", q AS (SELECT *, min(co_cited_year) OVER w AS t0, max(frequency) OVER w AS top, arg_min(frequency, co_cited_year) OVER w AS c0 FROM g WINDOW w AS (PARTITION BY cited_1, cited_2)), p AS (SELECT *, min(CASE WHEN frequency = top THEN co_cited_year END) OVER (PARTITION BY cited_1, cited_2) AS tp FROM q) "
    "SELECT cited_1, cited_2, round(coalesce(sum(CASE WHEN tp > t0 THEN ((top - c0) / (tp - t0) * (co_cited_year - t0) + c0 - frequency) / greatest(1, frequency) END), 0), 6) AS sb FROM p WHERE co_cited_year <= tp GROUP BY ALL"
)
def cocite_sleeping_beauty(spark, folder):
    return P.sleeping_beauty(_filled(spark, folder)).withColumn("sb", F.round("sb", 6))


_SLEEP = _FILL + ", q AS (SELECT *, row_number() OVER w - 1 AS i, avg(frequency) OVER (PARTITION BY cited_1, cited_2 ORDER BY co_cited_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM g WINDOW w AS (PARTITION BY cited_1, cited_2 ORDER BY co_cited_year)), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cited_1, cited_2 ORDER BY co_cited_year) AS rn FROM q WHERE frequency > 2) WHERE rn = 1 AND i >= 3 AND m <= 1.0)"


@query(_SLEEP + " SELECT cited_1, cited_2, co_cited_year AS awake_year, frequency AS awake_frequency, round(m, 6) AS sleep_mean FROM h")
def cocite_sleeping_pairs(spark, folder):
    return P.sleeping_pairs(_filled(spark, folder), 3).withColumn("sleep_mean", F.round("sleep_mean", 6))


@query(_SLEEP + ", k AS (SELECT cited_1, cited_2, max(frequency) AS top, arg_min(co_cited_year, (-frequency, co_cited_year)) AS tp FROM g GROUP BY ALL) SELECT cited_1, cited_2, CASE WHEN tp <> co_cited_year THEN round((top - frequency) / (tp - co_cited_year), 6) END AS slope FROM h JOIN k USING (cited_1, cited_2)")
def cocite_awakening_slope(spark, folder):
    series = _filled(spark, folder)
    return P.awakening_slope(series, P.sleeping_pairs(series, 3)).withColumn("slope", F.round("slope", 6))


def _jaccard_sql(star: bool, year: bool, closed: bool = False) -> str:
    drop = " AND e.citing NOT IN (l.cited_1, l.cited_2)" if star or closed else ""
    limit = " JOIN y z ON z.node = e.citing AND z.year <= l.first_year" if year else ""
    more = " + 2" if star or closed else ""
    return (
        f"{WP}, n AS (SELECT l.cited_1, l.cited_2, e.citing, max(CASE WHEN e.cited = l.cited_1 THEN 1 ELSE 0 END) AS x, max(CASE WHEN e.cited = l.cited_2 THEN 1 ELSE 0 END) AS w FROM l JOIN e ON e.cited IN (l.cited_1, l.cited_2){limit} WHERE TRUE{drop} GROUP BY ALL), "
        f"q AS (SELECT cited_1, cited_2, CAST(sum(x * w) AS BIGINT) AS b, count(*) AS a FROM n GROUP BY ALL) SELECT l.cited_1, l.cited_2, coalesce(b, 0) AS n_both, coalesce(a, 0){more} AS n_any, round(coalesce(b, 0) / nullif(coalesce(a, 0){more}, 0), 8) AS jaccard FROM l LEFT JOIN q USING (cited_1, cited_2)"
    )


def _jaccard(spark, folder, star=False, closed=False, conditional=False):
    years = nodes(spark, folder) if conditional else None
    return P.jaccard(citations(spark, folder), pair_list(spark, folder), star, closed, years, "first_year" if conditional else None).withColumn("jaccard", F.round("jaccard", 8))


@query(_jaccard_sql(False, False))
def cocite_jaccard(spark, folder):
    return _jaccard(spark, folder)


@query(_jaccard_sql(True, False))
def cocite_jaccard_star(spark, folder):
    return _jaccard(spark, folder, star=True)


@query(_jaccard_sql(False, True))
def cocite_jaccard_conditional(spark, folder):
    return _jaccard(spark, folder, conditional=True)


@query(_jaccard_sql(True, True))
def cocite_jaccard_star_conditional(spark, folder):
    return _jaccard(spark, folder, star=True, conditional=True)


@query(_jaccard_sql(False, False, True))
def cocite_jaccard_closed(spark, folder):
    return _jaccard(spark, folder, closed=True)


def _theta_sql(prime: bool, delta: bool = False) -> str:
    keep = " WHERE x + w = 1" if prime else ""
    if delta:
        keep = " WHERE NOT EXISTS (SELECT 1 FROM e u JOIN e v ON v.citing = u.citing WHERE u.cited = n0.cited_1 AND v.cited = n0.cited_2 AND u.citing = n0.citing)"
    return (
        f"{WP}, n0 AS (SELECT l.cited_1, l.cited_2, e.citing, max(CASE WHEN e.cited = l.cited_1 THEN 1 ELSE 0 END) AS x, max(CASE WHEN e.cited = l.cited_2 THEN 1 ELSE 0 END) AS w FROM l JOIN e ON e.cited IN (l.cited_1, l.cited_2) JOIN y z ON z.node = e.citing AND z.year <= l.first_year GROUP BY ALL), n AS (SELECT * FROM n0{keep}), "
        "s AS (SELECT cited_1, cited_2, CAST(sum(x) AS BIGINT) AS n_x, CAST(sum(w) AS BIGINT) AS n_y FROM n GROUP BY ALL), "
        "k AS (SELECT a.cited_1, a.cited_2, CAST(sum(a.x * b.w) AS BIGINT) AS xy, CAST(sum(a.w * b.x) AS BIGINT) AS yx, CAST(sum(greatest(a.x * b.w, a.w * b.x)) AS BIGINT) AS m FROM n a JOIN e ON e.citing = a.citing JOIN n b ON b.citing = e.cited AND b.cited_1 = a.cited_1 AND b.cited_2 = a.cited_2 GROUP BY ALL) "
        "SELECT l.cited_1, l.cited_2, coalesce(n_x, 0) AS n_x, coalesce(n_y, 0) AS n_y, coalesce(xy, 0) AS edges_xy, coalesce(yx, 0) AS edges_yx, round(coalesce(coalesce(m, 0) / nullif(n_x * n_y, 0), 0), 8) AS theta FROM l LEFT JOIN s USING (cited_1, cited_2) LEFT JOIN k USING (cited_1, cited_2)"
    )


def _theta(spark, folder, prime, delta=False):
    return P.theta_omega(citations(spark, folder), nodes(spark, folder), pair_list(spark, folder), "first_year", prime, delta).withColumn("theta", F.round("theta", 8))


@query(_theta_sql(False))
def cocite_theta_omega(spark, folder):
    return _theta(spark, folder, False)


@query(_theta_sql(True))
def cocite_theta_omega_prime(spark, folder):
    return _theta(spark, folder, True)


@query(_theta_sql(False, True))
def cocite_theta_omega_delta(spark, folder):
    return _theta(spark, folder, False, True)


@query(f"WITH q AS ({_theta_sql(True)}) SELECT cited_1, cited_2, round((edges_xy + edges_yx) / nullif(n_x * n_y, 0), 8) AS density FROM q")
def cocite_exy_density(spark, folder):
    theta = P.theta_omega(citations(spark, folder), nodes(spark, folder), pair_list(spark, folder), "first_year", True)
    return P.exy_density(theta).withColumn("density", F.round("density", 8))


@query(f"{WP} SELECT l.cited_1, l.cited_2, EXISTS (SELECT 1 FROM e WHERE e.citing = l.cited_1 AND e.cited = l.cited_2) OR EXISTS (SELECT 1 FROM e WHERE e.citing = l.cited_2 AND e.cited = l.cited_1) AS connected FROM l")
def cocite_connected_flag(spark, folder):
    return P.connected_flag(citations(spark, folder), pair_list(spark, folder).select("cited_1", "cited_2"))


@query(f"{WP}, f AS (SELECT l.cited_1, l.cited_2, min(z.year) AS f FROM l JOIN e u ON u.cited = l.cited_1 JOIN e v ON v.cited = l.cited_2 AND v.citing = u.citing JOIN y z ON z.node = u.citing GROUP BY ALL) SELECT cited_1, cited_2, greatest(a.year, b.year, f) AS first_co_cited_year, greatest(a.year, b.year, f) - greatest(a.year, b.year) AS time_lag FROM f JOIN y a ON a.node = cited_1 JOIN y b ON b.node = cited_2")
def cocite_time_lag(spark, folder):
    return P.time_lag(citations(spark, folder), nodes(spark, folder), pair_list(spark, folder))


@query(f"{W}, {_S}, p AS (SELECT a.cited AS node, b.cited AS other, count(*) AS frequency FROM e a JOIN s ON s.node = a.cited JOIN e b ON b.citing = a.citing AND b.cited <> a.cited GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY frequency DESC, other) AS INTEGER) AS place FROM p) WHERE place <= 5")
def cocite_max(spark, folder):
    return P.max_cocitations(citations(spark, folder), _seed(spark, folder), 5)


@query(f"WITH {E} SELECT a.citing AS citing_1, b.citing AS citing_2, count(*) AS coupling FROM e a JOIN e b ON a.cited = b.cited AND a.citing < b.citing GROUP BY ALL")
def cocite_bibliographic_coupling(spark, folder):
    return P.bibliographic_coupling(citations(spark, folder))


@query(f"WITH {E}, d AS (SELECT cited AS n FROM e GROUP BY cited HAVING count(*) >= 25), m AS (SELECT DISTINCT cited AS n FROM e WHERE citing = 7 AND cited IN (SELECT n FROM d)) SELECT m.n AS neighbour, b.cited AS other, count(*) AS n FROM m JOIN e a ON a.cited = m.n JOIN e b ON b.citing = a.citing AND b.cited <> m.n GROUP BY ALL")
def cocite_common_neighbours(spark, folder):
    return P.common_neighbours(citations(spark, folder), 7, 25)


@query(f"WITH {E}, d AS (SELECT cited AS n FROM e GROUP BY cited HAVING count(*) >= 25), m AS (SELECT DISTINCT cited AS n FROM e WHERE citing = 7 AND cited IN (SELECT n FROM d)) SELECT m.n AS neighbour, b.citing AS other, count(*) AS n FROM m JOIN e a ON a.citing = m.n JOIN e b ON b.cited = a.cited AND b.citing <> m.n GROUP BY ALL")
def cocite_common_references(spark, folder):
    return P.common_neighbours(citations(spark, folder), 7, 25, "references")


_TRI = "t AS (SELECT a.cited AS scp1, b.cited AS scp2, c.cited AS scp3, count(*) AS frequency, min(z.year) AS first_year FROM e a JOIN e b ON b.citing = a.citing AND a.cited < b.cited JOIN e c ON c.citing = b.citing AND b.cited < c.cited LEFT JOIN y z ON z.node = a.citing GROUP BY ALL HAVING count(*) >= 3)"


@query(f"{W}, {_TRI} SELECT * FROM t")
def cocite_triplets(spark, folder):
    return P.triplets(citations(spark, folder), nodes(spark, folder), 3)


@query(f"{W}, {_TRI} SELECT t.*, (SELECT count(*) FROM e WHERE citing IN (scp1, scp2, scp3) AND cited IN (scp1, scp2, scp3)) AS direct FROM t")
def cocite_triplet_citations(spark, folder):
    e = citations(spark, folder)
    return P.triplet_direct_citations(e, P.triplets(e, nodes(spark, folder), 3))


@query(f"{W}, {_TRI} SELECT scp1, scp2, scp3, a.citing FROM t JOIN e a ON a.cited = scp1 JOIN e b ON b.citing = a.citing AND b.cited = scp2 JOIN e c ON c.citing = a.citing AND c.cited = scp3")
def cocite_triplet_citers(spark, folder):
    e = citations(spark, folder)
    return P.triplet_citers(e, P.triplets(e, nodes(spark, folder), 3))


@query(f"WITH {E} SELECT a.citing AS node_1, a.cited AS node_2 FROM e a JOIN e b ON a.citing = b.cited AND a.cited = b.citing WHERE a.citing < a.cited")
def cocite_mutual(spark, folder):
    return P.mutual_citations(citations(spark, folder))


@query(f"WITH {K}, i AS (SELECT citing || '>' || cited AS id, citing, cited FROM k), n AS (SELECT id, citing AS shared FROM i UNION ALL SELECT id, cited FROM i) SELECT DISTINCT a.id AS edge_1, b.id AS edge_2, a.shared FROM n a JOIN n b ON a.shared = b.shared AND a.id < b.id")
def cocite_line_graph(spark, folder):
    return P.line_graph(recorded_pairs(spark, folder).withColumn("id", F.concat_ws(">", "citing", "cited")), "id")


# Disruption.

_DIS = "sh AS (SELECT a.citing AS focal, b.citing AS paper, count(*) AS shared FROM e a JOIN e b ON a.cited = b.cited AND a.citing <> b.citing GROUP BY ALL), ci AS (SELECT cited AS focal, citing AS paper FROM e), r AS (SELECT coalesce(ci.focal, sh.focal) AS focal, coalesce(sh.shared, 0) AS shared, ci.focal IS NOT NULL AS cites FROM ci FULL JOIN sh ON ci.focal = sh.focal AND ci.paper = sh.paper), d AS (SELECT focal, count(*) FILTER (WHERE cites AND shared = 0) AS i, count(*) FILTER (WHERE cites AND shared > 0) AS j, count(*) FILTER (WHERE NOT cites) AS k, " + ", ".join(f"count(*) FILTER (WHERE cites AND shared >= {n}) AS j_{n}, count(*) FILTER (WHERE NOT cites AND shared >= {n}) AS k_{n}" for n in range(1, 12)) + " FROM r GROUP BY focal)"


@query(f"WITH {E}, {_DIS} SELECT *, round((i - j) / (i + j + k), 8) AS disruption FROM d WHERE j > 0 AND k > 0")
def disrupt_all_papers(spark, folder):
    return D.disruption(citations(spark, folder), thresholds=tuple(range(1, 12))).withColumn("disruption", F.round("disruption", 8))


@query(f"{W}, {_DIS.replace('b.citing GROUP', 'b.citing JOIN y ON y.node = b.citing AND y.cluster_no < 10 GROUP', 1)} SELECT focal, i, j, k FROM d WHERE j > 0 AND k > 0")
def disrupt_within_universe(spark, folder):
    return D.disruption(citations(spark, folder), thresholds=(), universe=nodes(spark, folder).filter("cluster_no < 10")).select("focal", "i", "j", "k")


@query(f"WITH {E}, k AS (SELECT a.cited AS focal, count(*) AS n FROM e a JOIN e b ON b.citing = a.citing JOIN e c ON c.citing = a.cited AND c.cited = b.cited GROUP BY a.cited), q AS (SELECT cited AS focal, count(*) AS n_citers FROM e GROUP BY cited) SELECT q.focal, n_citers, coalesce(n, 0) AS n_links, round(coalesce(n, 0) / n_citers, 8) AS dependency FROM q LEFT JOIN k USING (focal)")
def disrupt_dependency(spark, folder):
    return D.dependency(citations(spark, folder)).withColumn("dependency", F.round("dependency", 8))


# Null models.

_YEAR = 2005
_SLICE = f"s0 AS (SELECT e.citing AS source_id, u.issn AS source_issn, e.cited AS ref_id, v.year AS ref_year, v.issn AS ref_issn FROM e JOIN y u ON u.node = e.citing AND u.year = {_YEAR} JOIN y v ON v.node = e.cited AND v.year <= {_YEAR}), s AS (SELECT source_id, source_issn, ref_id, ref_year, ref_issn FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM s0) WHERE n >= 2)"


def _slice(spark, folder):
    return N.year_slice(citations(spark, folder), nodes(spark, folder), _YEAR)


@query(f"{W}, {_SLICE} SELECT * FROM s")
def null_year_slice(spark, folder):
    return _slice(spark, folder)


@query(f"{W}, {_SLICE} SELECT source_id, ref_year, count(*) AS k FROM s GROUP BY ALL")
def null_k_values(spark, folder):
    return N.k_values(_slice(spark, folder))


@query("WITH t AS (SELECT ps.l_partkey AS node, s_name AS issn, CAST(s_nationkey AS INTEGER) AS type FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps JOIN supplier ON s_suppkey = ps.l_suppkey), u AS (SELECT issn, count(*) AS n FROM t GROUP BY issn) SELECT node, issn FROM (SELECT t.node, t.issn, row_number() OVER (PARTITION BY node ORDER BY type DESC, u.n, t.issn) AS r FROM t JOIN u USING (issn)) WHERE r = 1")
def null_best_issn(spark, folder):
    pairs = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return N.best_issn(pairs.join(table(spark, folder, "supplier"), "s_suppkey").select("node", F.col("s_name").alias("issn"), F.col("s_nationkey").cast("int").alias("type")))


def _hash_sql(*parts: str) -> str:
    """portable_hash() as nested subqueries would need a name for each step; list_reduce keeps one."""
    values = ", ".join(f"CAST({p} AS BIGINT) % 2147483647" for p in (*parts, "0"))
    return f"list_reduce([17::BIGINT, {values}], lambda h, p: (h * h + h * 48271 + p * 69621 + 12345) % 2147483647)"


_PERM = f"p0 AS (SELECT *, CAST(unnest(generate_series(1, 10)) AS INTEGER) AS perm_id FROM s), p1 AS (SELECT *, {_hash_sql('CAST(perm_id AS BIGINT)', 'source_id', 'ref_id')} AS h FROM p0), p2 AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY perm_id, ref_year) AS n FROM p1 WINDOW w AS (PARTITION BY perm_id, ref_year ORDER BY h, source_id, ref_id)), p3 AS (SELECT a.perm_id, a.source_id, a.source_issn, a.ref_year, b.ref_id, b.ref_issn FROM p2 a JOIN p2 b ON b.perm_id = a.perm_id AND b.ref_year = a.ref_year AND b.i = a.i % a.n + 1), pm AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY perm_id, source_id, ref_id) AS c FROM p3) WHERE c = 1)"


@query(f"{W}, {_SLICE}, {_PERM} SELECT perm_id, source_id, source_issn, ref_year, ref_id, ref_issn FROM pm")
def null_shuffle(spark, folder):
    return N.shuffle_refs(_slice(spark, folder), 10)


@query()
def null_mcmc_swap(spark, folder):
    return N.mcmc_swap(_slice(spark, folder), 7)


_PF = "{n} AS (SELECT {by} a.ref_issn AS issn_1, b.ref_issn AS issn_2, count(*) AS frequency FROM {t} a JOIN {t} b ON a.source_id = b.source_id{on} AND (a.ref_issn < b.ref_issn OR (a.ref_issn = b.ref_issn AND a.ref_id < b.ref_id)) GROUP BY ALL)"
_OBS, _BG = _PF.format(n="ob", by="", t="s", on=""), _PF.format(n="bg", by="a.perm_id,", t="pm", on=" AND a.perm_id = b.perm_id")


@query(f"{W}, {_SLICE}, {_OBS} SELECT * FROM ob")
def null_pair_frequency(spark, folder):
    return N.pair_frequency(_slice(spark, folder))


_Z = f"{W}, {_SLICE}, {_PERM}, {_OBS}, {_BG}, st AS (SELECT issn_1, issn_2, count(*) AS n, avg(frequency) AS mean, stddev_pop(frequency) AS std FROM bg GROUP BY ALL), z AS (SELECT ob.issn_1, ob.issn_2, ob.frequency AS observed, mean, std, coalesce(n, 0) AS n, CASE WHEN std > 1e-6 THEN (frequency - mean) / std WHEN frequency > mean THEN CAST('Infinity' AS DOUBLE) WHEN frequency < mean THEN CAST('-Infinity' AS DOUBLE) END AS z FROM ob LEFT JOIN st USING (issn_1, issn_2))"


def _z(spark, folder):
    rows = _slice(spark, folder)
    return rows, N.z_scores(N.pair_frequency(rows), N.pair_frequency(N.shuffle_refs(rows, 10), ["perm_id"]), 10)


@query(_Z + " SELECT issn_1, issn_2, observed, n, round(mean, 6) AS mean, round(z, 4) AS z FROM z")
def null_z_scores(spark, folder):
    return _z(spark, folder)[1].select("issn_1", "issn_2", "observed", "n", F.round("mean", 6).alias("mean"), F.round("z", 4).alias("z"))


_SUMMARY = _Z + ", rp AS (SELECT a.source_id, a.ref_id AS ref_1, b.ref_id AS ref_2, a.ref_issn AS issn_1, b.ref_issn AS issn_2 FROM s a JOIN s b ON a.source_id = b.source_id AND (a.ref_issn < b.ref_issn OR (a.ref_issn = b.ref_issn AND a.ref_id < b.ref_id))), w AS (SELECT rp.source_id, z.z FROM rp JOIN z USING (issn_1, issn_2) WHERE isfinite(z.z)), u AS (SELECT source_id, quantile_cont(z, 0.5) AS med, quantile_cont(z, 0.1) AS ten, quantile_cont(z, 0.01) AS one FROM w GROUP BY source_id)"


@query(_SUMMARY + " SELECT source_id, round(med, 5) AS med, round(ten, 5) AS ten, round(one, 5) AS one FROM u")
def null_pub_z_summary(spark, folder):
    return N.pub_z_summary(*_z(spark, folder)).select("source_id", *(F.round(c, 5).alias(c) for c in ("med", "ten", "one")))


@query(_SUMMARY + " SELECT source_id, ref_1, ref_2, rp.issn_1, rp.issn_2, observed, n, round(mean, 6) AS mean, round(z, 4) AS z FROM rp JOIN z ON z.issn_1 = rp.issn_1 AND z.issn_2 = rp.issn_2 WHERE z.z IS NOT NULL")
def null_pub_pairs(spark, folder):
    return N.pub_pairs(*_z(spark, folder)).select("source_id", "ref_1", "ref_2", "issn_1", "issn_2", "observed", "n", F.round("mean", 6).alias("mean"), F.round("z", 4).alias("z"))


def _subset(spark, folder):
    return nodes(spark, folder).filter("cluster_no < 16").select(F.col("node").alias("source_id"))


@query(
    _SUMMARY + ", sets AS (SELECT 'slice' AS part, * FROM u UNION ALL SELECT 'subset', * FROM u WHERE source_id IN (SELECT node FROM y WHERE cluster_no < 16)), md AS (SELECT part, quantile_cont(med, 0.5) AS m, count(*) AS t FROM sets GROUP BY part), "
    "cs AS (SELECT part, CASE WHEN med <= m THEN 'LC' ELSE 'HC' END || CASE WHEN ten >= 0 THEN 'LN' ELSE 'HN' END AS category, t FROM sets JOIN md USING (part)) SELECT part, category, count(*) AS n, CAST(floor(100 * count(*) / t) AS BIGINT) AS percent FROM cs GROUP BY part, category, t"
)
def null_category_shares(spark, folder):
    """Categories of the whole slice, and of a subset against its own median."""
    summary = materialise(N.pub_z_summary(*_z(spark, folder)))
    whole, part = N.category_shares(summary), N.category_shares(summary, _subset(spark, folder))
    return whole.withColumn("part", F.lit("slice")).unionByName(part.withColumn("part", F.lit("subset")))


_CAT = _SUMMARY + ", cn AS (SELECT cited AS source_id, count(*) AS citation_count FROM e GROUP BY cited), cc AS (SELECT u.*, coalesce(citation_count, 0) AS citation_count FROM u LEFT JOIN cn USING (source_id)), ct AS (SELECT source_id, CASE WHEN ten < 0 THEN 'HN' ELSE 'LN' END || CASE WHEN med > (SELECT quantile_cont(med, 0.5) FROM cc) THEN 'HC' ELSE 'LC' END AS category, citation_count >= (SELECT quantile_cont(citation_count, 0.9) FROM cc) AS is_hit FROM cc)"


def _categories(spark, folder):
    counts = S.citation_counts(citations(spark, folder)).withColumnRenamed("node", "source_id")
    return N.novelty_category(N.pub_z_summary(*_z(spark, folder)).join(counts, "source_id", "left").na.fill(0, ["citation_count"]))


@query(_CAT + " SELECT category, count(*) AS n, count(*) FILTER (WHERE is_hit) AS hits, round(count(*) FILTER (WHERE is_hit) / count(*), 6) AS hit_share, round(count(*) * (SELECT count(*) FILTER (WHERE is_hit) / count(*) FROM ct), 6) AS expected_hits FROM ct GROUP BY category")
def null_category_counts(spark, folder):
    return N.category_counts(_categories(spark, folder)).withColumns({c: F.round(c, 6) for c in ("hit_share", "expected_hits")})


@query()
def null_chi_square(spark, folder):
    return N.chi_square(N.category_counts(_categories(spark, folder)), "hits", "expected_hits")


_BRANDS = "o AS (SELECT p_brand AS k, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < 20 GROUP BY 1), h AS (SELECT p_brand AS k, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 15 AND l_discount > 0.05 GROUP BY 1)"


def _brand_counts(spark, folder):
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return (rows.filter(c).groupBy(F.col("p_brand").alias("k")).agg(F.count(F.lit(1)).alias("n")) for c in ("l_quantity < 20", "l_quantity >= 15 and l_discount > 0.05"))


@query(f"WITH {_BRANDS}, b AS (SELECT o.n / (SELECT sum(n) FROM o) AS p, h.n / (SELECT sum(n) FROM h) AS q FROM o JOIN h USING (k)) SELECT round(sum(p * log2(p / q)), 8) AS d_left, round(sum(q * log2(q / p)), 8) AS d_right, round((sum(p * log2(p / q)) + sum(q * log2(q / p))) / 2, 8) AS distance FROM b")
def null_kl_divergence(spark, folder):
    a, b = _brand_counts(spark, folder)
    out = N.kl_divergence(a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), "k"), "a", "b")
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


@query(f"WITH {_BRANDS}, b AS (SELECT k, coalesce(o.n, 1) AS original, coalesce(h.n, 1) AS shuffled FROM o FULL JOIN h USING (k)) SELECT *, CASE WHEN shuffled > original THEN shuffled // original WHEN shuffled < original THEN -(original // shuffled) ELSE 1 END AS fold FROM b")
def null_fold_change(spark, folder):
    return N.fold_change(*_brand_counts(spark, folder), "k")


@query(f"{W}, r AS (SELECT citing AS node, count(*) AS refs FROM e GROUP BY citing), n AS (SELECT cited AS node, count(*) AS c FROM e GROUP BY cited) SELECT refs, count(c) AS n, round(avg(c), 6) AS mean, round(coalesce(stddev_samp(c) / sqrt(count(c)), 0), 6) AS error FROM r JOIN n USING (node) GROUP BY refs")
def null_mean_and_error(spark, folder):
    e = citations(spark, folder)
    rows = e.groupBy(F.col("citing").alias("node")).agg(F.count(F.lit(1)).alias("refs")).join(S.citation_counts(e), "node")
    return N.mean_and_error(rows, "refs", "citation_count").withColumns({c: F.round(c, 6) for c in ("mean", "error")})
