"""Queries for clusterings, texts, loads, quality checks and productivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import scalars as C
from citeloom.operators import awards as W
from citeloom.operators import clusters as K
from citeloom.operators import cocitation as P
from citeloom.operators import quality as Q
from citeloom.operators import relational as R
from citeloom.operators import text as T
from citeloom.operators.nullmodel import portable_hash
from citeloom.plans import reference as base
from citeloom.plans.reference import A, E, Y, authors, citations, nodes, recorded_pairs, table
from citeloom.session import scratch
from citeloom.sources import io as IO
from citeloom.sources.xmlrows import TableSpec, parse_xml, shred

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _clusters(spark, folder):
    return nodes(spark, folder).select("cluster_no", "node")


W_ = f"WITH {E}, {Y}"
_LAB = "le AS (SELECT citing, cited, a.cluster_no AS ca, b.cluster_no AS cb FROM e JOIN y a ON a.node = citing JOIN y b ON b.node = cited)"


@query(f"{W_}, {_LAB} SELECT citing, cited, ca AS citing_cluster, cb AS cited_cluster FROM le")
def clus_labelled_edges(spark, folder):
    return K.labelled_edges(citations(spark, folder), _clusters(spark, folder))


_IN = "i AS (SELECT c AS cluster_no, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT ca AS c, citing AS node, 0 AS i, 1 AS o FROM le WHERE ca = cb UNION ALL SELECT ca, cited, 1, 0 FROM le WHERE ca = cb) GROUP BY ALL)"


@query(f"{W_}, {_LAB}, {_IN} SELECT *, round(degree / nullif(count(*) OVER (PARTITION BY cluster_no) - 1, 0), 8) AS centrality FROM i")
def clus_internal_degrees(spark, folder):
    return K.internal_degrees(citations(spark, folder), _clusters(spark, folder)).withColumn("centrality", F.round("centrality", 8))


@query(f"{W_}, {_LAB} SELECT c AS cluster_no, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT ca AS c, citing AS node, 0 AS i, 1 AS o FROM le WHERE ca <> cb UNION ALL SELECT cb, cited, 1, 0 FROM le WHERE ca <> cb) GROUP BY ALL")
def clus_external_degrees(spark, folder):
    return K.external_degrees(citations(spark, folder), _clusters(spark, folder))


_SUM = "su AS (SELECT c AS cluster_no, count(*) FILTER (WHERE s AND i = 0) AS l_s, count(*) AS d_s, count(*) FILTER (WHERE NOT s) AS boundary FROM (SELECT ca AS c, ca = cb AS s, 0 AS i FROM le UNION ALL SELECT cb, ca = cb, 1 FROM le) GROUP BY c), t AS (SELECT count(*) AS m FROM e)"


@query(f"{W_}, {_LAB}, {_SUM} SELECT cluster_no, l_s, d_s, round(l_s / m - pow(d_s / (2 * m), 2), 8) AS modularity FROM su, t")
def clus_modularity(spark, folder):
    return K.modularity(citations(spark, folder), _clusters(spark, folder)).withColumn("modularity", F.round("modularity", 8))


@query(f"{W_}, {_LAB}, {_SUM} SELECT cluster_no, boundary, d_s AS volume, round(boundary / least(d_s, 2 * m - d_s), 8) AS conductance FROM su, t")
def clus_conductance(spark, folder):
    return K.conductance(citations(spark, folder), _clusters(spark, folder)).withColumn("conductance", F.round("conductance", 8))


@query(f"{W_}, {_LAB}, {_SUM}, z AS (SELECT cluster_no, count(*) AS size FROM y GROUP BY 1) SELECT cluster_no, size, l_s AS inner_edges, round(l_s / size, 8) AS density FROM z JOIN su USING (cluster_no)")
def clus_edge_density(spark, folder):
    return K.edge_density(citations(spark, folder), _clusters(spark, folder)).withColumn("density", F.round("density", 8))


@query("WITH c AS (SELECT p_size AS cluster_no, p_partkey AS node FROM part) SELECT cluster_no, node FROM c WHERE cluster_no IN (SELECT cluster_no FROM c GROUP BY 1 HAVING count(*) BETWEEN 30 AND 350)")
def clus_sized(spark, folder):
    return K.sampled_clusters(table(spark, folder, "part").select(F.col("p_size").alias("cluster_no"), F.col("p_partkey").alias("node")), 30, 350)


_TIER = f"{_LAB}, {_IN}, r AS (SELECT y.cluster_no, y.node, coalesce(i.in_degree, 0) AS in_degree FROM y LEFT JOIN i ON i.node = y.node AND i.cluster_no = y.cluster_no), ti AS (SELECT *, CASE WHEN in_degree = 0 THEN 3 WHEN rank() OVER (PARTITION BY cluster_no ORDER BY in_degree DESC) <= greatest(1, ceil(count(*) OVER (PARTITION BY cluster_no) * 0.1)) THEN 1 ELSE 2 END AS tier FROM r)"


@query(f"{W_}, {_TIER} SELECT cluster_no, node, in_degree, CAST(tier AS INTEGER) AS tier FROM ti")
def clus_article_tiers(spark, folder):
    return K.article_tiers(citations(spark, folder), _clusters(spark, folder))


@query(f"{W_}, {A}, {_TIER}, b AS (SELECT cluster_no, author, min(tier) AS tier FROM ti JOIN a USING (node) GROUP BY ALL) SELECT author, count(*) FILTER (WHERE tier = 1) AS tier_1, count(*) FILTER (WHERE tier = 2) AS tier_2, count(*) FILTER (WHERE tier = 3) AS tier_3 FROM b GROUP BY author")
def clus_author_tiers(spark, folder):
    return K.author_tiers(K.article_tiers(citations(spark, folder), _clusters(spark, folder)), authors(spark, folder))


@query(
    f"WITH {Y}, {A}, r AS (SELECT y.cluster_no, a.node, a.author FROM y JOIN a USING (node)), p AS (SELECT cluster_no, author, count(*) AS n FROM r GROUP BY ALL), "
    "l AS (SELECT cluster_no, count(*) AS num_authors, quantile_disc(n, 0.5) AS p_50, quantile_disc(n, 0.9) AS p_90 FROM p GROUP BY 1), g AS (SELECT cluster_no, count(*) AS num_articles FROM y GROUP BY 1), "
    "q AS (SELECT cluster_no, count(*) AS coauthor_pairs, CAST(sum(n) AS BIGINT) AS coauthor_total FROM (SELECT u.cluster_no, u.author, v.author AS other, count(*) AS n FROM r u JOIN r v ON v.cluster_no = u.cluster_no AND v.node = u.node AND u.author < v.author GROUP BY ALL) GROUP BY 1), "
    "h AS (SELECT p.cluster_no, p.author, p.n >= p_50 AS a50, p.n >= p_90 AS a90 FROM p JOIN l USING (cluster_no)), ha AS (SELECT cluster_no, count(*) FILTER (WHERE a50) AS authors_p_50, count(*) FILTER (WHERE a90) AS authors_p_90 FROM h GROUP BY 1), "
    "hb AS (SELECT r.cluster_no, count(DISTINCT CASE WHEN a50 THEN r.node END) AS articles_p_50, count(DISTINCT CASE WHEN a90 THEN r.node END) AS articles_p_90 FROM r JOIN h USING (cluster_no, author) GROUP BY 1) "
    "SELECT cluster_no, num_articles, num_authors, p_50, p_90, coalesce(coauthor_pairs, 0) AS coauthor_pairs, coalesce(coauthor_total, 0) AS coauthor_total, authors_p_50, articles_p_50, authors_p_90, articles_p_90, round(coalesce(coauthor_pairs, 0) / nullif(num_authors * (num_authors - 1) / 2, 0), 8) AS coauthor_share FROM g JOIN l USING (cluster_no) LEFT JOIN q USING (cluster_no) JOIN ha USING (cluster_no) JOIN hb USING (cluster_no)"
)
def clus_author_stats(spark, folder):
    return K.author_stats(_clusters(spark, folder), authors(spark, folder)).withColumn("coauthor_share", F.round("coauthor_share", 8))


_TWO = "x AS (SELECT p_size AS a, p_partkey AS node FROM part), z AS (SELECT CAST(substr(p_brand, -1) AS INTEGER) * 100 + p_size // 5 AS b, p_partkey AS node FROM part)"


def _two(spark, folder):
    part = table(spark, folder, "part")
    return part.select(F.col("p_size").alias("cluster_no"), F.col("p_partkey").alias("node")), part.select((F.right("p_brand", F.lit(1)).cast("int") * 100 + F.floor(F.col("p_size") / 5)).cast("int").alias("cluster_no"), F.col("p_partkey").alias("node"))


@query(
    f"WITH {_TWO}, b AS (SELECT a, b, count(*) AS n FROM x JOIN z USING (node) GROUP BY ALL), r AS (SELECT *, max(n) OVER (PARTITION BY a) AS top FROM b), o AS (SELECT *, count(*) OVER (PARTITION BY a) AS k, row_number() OVER (PARTITION BY a ORDER BY b) AS rn FROM r WHERE n = top), sa AS (SELECT a, count(*) AS na FROM x GROUP BY a), sb AS (SELECT b, count(*) AS nb FROM z GROUP BY b) "
    "SELECT a AS cluster_no, b AS match_no, n AS n_both, na + nb - n AS n_any, round(n / (na + nb - n), 8) AS overlap, k > 1 AS multiple_options FROM o JOIN sa USING (a) JOIN sb USING (b) WHERE rn = 1"
)
def clus_match(spark, folder):
    return K.match_clusterings(*_two(spark, folder)).withColumn("overlap", F.round("overlap", 8))


@query(f"{W_}, {_LAB}, b AS (SELECT ca AS cluster_no, cb AS other FROM le WHERE ca <> cb UNION ALL SELECT cb, ca FROM le WHERE ca <> cb), n AS (SELECT cluster_no, other, count(*) AS edges FROM b GROUP BY ALL) SELECT * FROM n WHERE (cluster_no, edges) IN (SELECT cluster_no, max(edges) FROM n GROUP BY 1)")
def clus_connected(spark, folder):
    return K.connected_clusters(citations(spark, folder), _clusters(spark, folder))


@query(f"WITH {Y}, {A}, r AS (SELECT DISTINCT cluster_no, author FROM y JOIN a USING (node)), n AS (SELECT cluster_no, count(*) AS n FROM r GROUP BY 1), b AS (SELECT u.cluster_no, v.cluster_no AS other, count(*) AS shared FROM r u JOIN r v ON u.author = v.author AND u.cluster_no <> v.cluster_no GROUP BY ALL) SELECT b.*, round(shared / n, 8) AS shared_share FROM b JOIN n USING (cluster_no) WHERE shared / n >= 0.05")
def clus_shared_authors(spark, folder):
    return K.shared_author_clusters(_clusters(spark, folder), authors(spark, folder)).withColumn("shared_share", F.round("shared_share", 8))


@query(f"{W_}, {A}, {_LAB}, s AS (SELECT DISTINCT citing, cited FROM le JOIN a u ON u.node = citing JOIN a v ON v.node = cited AND v.author = u.author WHERE ca = cb) SELECT ca AS cluster_no, count(*) AS n_edges, count(s.citing) AS n_self FROM le LEFT JOIN s ON s.citing = le.citing AND s.cited = le.cited WHERE ca = cb GROUP BY ca")
def clus_author_citations(spark, folder):
    return K.in_cluster_author_citations(citations(spark, folder), _clusters(spark, folder), authors(spark, folder))


@query(f"{W_}, {_LAB}, n AS (SELECT ca AS citing_cluster, cb AS cited_cluster, CASE WHEN citing < cited THEN 'up' ELSE 'down' END AS kind, count(*) AS n FROM le GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY citing_cluster, cited_cluster), 8) AS share FROM n")
def clus_link_stats(spark, folder):
    out = K.link_stats(citations(spark, folder), _clusters(spark, folder), F.when(F.col("citing") < F.col("cited"), "up").otherwise("down"))
    return out.withColumn("share", F.round("share", 8))


@query(f"{W_}, co AS (SELECT a.cited AS x, b.cited AS z, count(*) AS f FROM e a JOIN e b ON a.citing = b.citing AND a.cited < b.cited GROUP BY ALL) SELECT least(u.cluster_no, v.cluster_no) AS cluster_1, greatest(u.cluster_no, v.cluster_no) AS cluster_2, count(*) AS n, max(f) AS max, quantile_cont(f, 0.5) AS median, round(avg(f), 8) AS mean, quantile_cont(f, 0.25) AS q1, quantile_cont(f, 0.75) AS q3 FROM co JOIN y u ON u.node = x JOIN y v ON v.node = z GROUP BY 1, 2")
def clus_matrix(spark, folder):
    return K.inter_cluster_matrix(P.cocited_pairs(citations(spark, folder)), _clusters(spark, folder), "frequency").withColumn("mean", F.round("mean", 8))


@query(f"{W_}, c AS (SELECT cluster_no, node FROM y WHERE cluster_no < 15), l AS (SELECT citing AS node, cited AS near FROM e UNION SELECT cited, citing FROM e), n AS (SELECT l.node, c.cluster_no, count(DISTINCT near) AS n FROM l JOIN c ON c.node = near WHERE l.node NOT IN (SELECT node FROM c) GROUP BY ALL HAVING count(DISTINCT near) >= 2), s AS (SELECT cluster_no, count(*) AS size FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n / size DESC, cluster_no) AS rn FROM n JOIN s USING (cluster_no)) SELECT cluster_no, node, n, round(n / size, 8) AS share FROM r WHERE rn = 1")
def clus_assign_unclustered(spark, folder):
    return K.assign_unclustered(citations(spark, folder), _clusters(spark, folder).filter("cluster_no < 15"), 2).withColumn("share", F.round("share", 8))


def _assign_sql(links: str) -> str:
    return f"{W_}, c AS (SELECT cluster_no, node FROM y WHERE cluster_no < 15), l AS ({links}), n AS (SELECT l.node, c.cluster_no, count(DISTINCT near) AS n FROM l JOIN c ON c.node = near WHERE l.node NOT IN (SELECT node FROM c) GROUP BY ALL), s AS (SELECT cluster_no, count(*) AS size FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n / size DESC, cluster_no) AS rn FROM n JOIN s USING (cluster_no)) SELECT cluster_no, node, n, round(n / size, 8) AS share FROM r WHERE rn = 1"


@query(_assign_sql("SELECT citing AS node, cited AS near FROM e"))
def clus_assign_by_references(spark, folder):
    return K.assign_unclustered(citations(spark, folder), _half(spark, folder), 1, "out").withColumn("share", F.round("share", 8))


@query(_assign_sql("SELECT cited AS node, citing AS near FROM e"))
def clus_assign_by_citations(spark, folder):
    return K.assign_unclustered(citations(spark, folder), _half(spark, folder), 1, "in").withColumn("share", F.round("share", 8))


@query(f"WITH {_TWO} SELECT CAST(a AS BIGINT) AS cluster_no, node FROM x UNION ALL SELECT b + (SELECT max(a) + 1 FROM x), node FROM z")
def clus_merge(spark, folder):
    return K.merge_clusterings(list(_two(spark, folder)))


@query(f"WITH {_TWO}, s AS (SELECT a, row_number() OVER (ORDER BY count(*) DESC, a) AS new FROM x GROUP BY a) SELECT CAST(new AS INTEGER) AS cluster_no, node FROM x JOIN s USING (a)")
def clus_renumber(spark, folder):
    return K.renumber_by_size(_two(spark, folder)[0])


@query(f"WITH {_TWO} SELECT a AS cluster_no, node FROM x WHERE a NOT IN (SELECT a FROM x WHERE node IN (SELECT node FROM z WHERE b % 100 < 4))")
def clus_unsplit(spark, folder):
    a, b = _two(spark, folder)
    return K.unsplit(a, b.filter("cluster_no % 100 < 4"))


_MARK = "m AS (SELECT p_partkey AS node FROM part WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.98) FROM part))"


def _markers(spark, folder):
    part = table(spark, folder, "part")
    return part.filter(F.col("p_retailprice") > part.agg(F.percentile("p_retailprice", 0.98)).scalar()).select(F.col("p_partkey").alias("node"))


@query(f"WITH {_TWO}, {_MARK}, v AS (SELECT 'x' AS version, CAST(a AS INTEGER) AS cluster_no, node FROM x UNION ALL SELECT 'z', CAST(b AS INTEGER), node FROM z), w AS (SELECT v.* FROM v JOIN m USING (node)) SELECT s.version, s.cluster_no, s.node AS marker_1, t.node AS marker_2 FROM w s JOIN w t ON s.version = t.version AND s.cluster_no = t.cluster_no AND s.node < t.node")
def clus_marker_pairs(spark, folder):
    a, b = _two(spark, folder)
    both = a.withColumn("version", F.lit("x")).unionByName(b.withColumn("version", F.lit("z")))
    return K.marker_cooccurrence(both, _markers(spark, folder))


@query(f"WITH {_TWO}, {_MARK} SELECT a AS cluster_no, count(*) AS size, count(m.node) AS markers, round(count(m.node) / count(*), 8) AS share FROM x LEFT JOIN m USING (node) GROUP BY a")
def clus_marker_distribution(spark, folder):
    return K.marker_distribution(_two(spark, folder)[0], _markers(spark, folder)).withColumn("share", F.round("share", 8))


@query(f"WITH {_TWO}, s AS (SELECT a, count(*) AS n FROM x GROUP BY a HAVING count(*) > 1) SELECT count(*) AS clusters, round(100 * sum(n) / (SELECT count(*) FROM part), 6) AS coverage, min(n) AS size_min, quantile_cont(n, 0.25) AS size_q1, quantile_cont(n, 0.5) AS size_median, round(avg(n), 6) AS size_mean, quantile_cont(n, 0.75) AS size_q3, max(n) AS size_max FROM s")
def clus_summary(spark, folder):
    n = table(spark, folder, "part").agg(F.count(F.lit(1))).scalar()
    return K.clustering_summary(_two(spark, folder)[0], n).withColumns({"coverage": F.round("coverage", 6), "size_mean": F.round("size_mean", 6)})


@query("WITH s AS (SELECT p_size AS cluster_no, p_brand AS code, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL) SELECT cluster_no, CAST(sum(CASE WHEN code = 'Brand#11' THEN n ELSE 0 END) AS BIGINT) AS \"Brand#11\", CAST(sum(CASE WHEN code = 'Brand#22' THEN n ELSE 0 END) AS BIGINT) AS \"Brand#22\" FROM s WHERE TRUE GROUP BY cluster_no")
def clus_code_composition(spark, folder):
    codes = table(spark, folder, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("code"))
    return K.code_composition(_two(spark, folder)[0], codes, ["Brand#11", "Brand#22"])


@query(f"{W_}, {_LAB}, l2 AS (SELECT citing, cited FROM le), t AS (SELECT count(*) AS m FROM le), su AS (SELECT c AS cluster_no, count(*) AS volume, count(*) FILTER (WHERE NOT s) AS boundary FROM (SELECT ca AS c, ca = cb AS s FROM le UNION ALL SELECT cb, ca = cb FROM le) GROUP BY c) SELECT cluster_no, boundary, volume, round(boundary / least(volume, 2 * m - volume), 3) AS conductance FROM su, t".replace(", l2 AS (SELECT citing, cited FROM le)", "").replace("FROM y)", "FROM y WHERE cluster_no < 15)").replace("JOIN y a ON", "JOIN (SELECT * FROM y WHERE cluster_no < 15) a ON").replace("JOIN y b ON", "JOIN (SELECT * FROM y WHERE cluster_no < 15) b ON"))
def clus_conductance_study(spark, folder):
    """Only edges with both ends in a cluster count, 3 digits."""
    return K.conductance(citations(spark, folder), _clusters(spark, folder).filter("cluster_no < 15"), "study")


_HALF = "e2 AS (SELECT citing, cited, a.cluster_no AS ca, b.cluster_no AS cb FROM e LEFT JOIN (SELECT * FROM y WHERE cluster_no < 15) a ON a.node = citing LEFT JOIN (SELECT * FROM y WHERE cluster_no < 15) b ON b.node = cited), cl AS (SELECT cluster_no, node FROM y WHERE cluster_no < 15)"


def _half(spark, folder):
    return _clusters(spark, folder).filter("cluster_no < 15")


@query(f"{W_}, {_HALF} SELECT cluster_no, count(*) AS nodes, (SELECT count(*) FROM e2 WHERE ca = cluster_no AND cb = cluster_no) AS inner, (SELECT count(*) FROM e2 WHERE cb = cluster_no AND ca IS DISTINCT FROM cluster_no) AS incoming, (SELECT count(*) FROM e2 WHERE ca = cluster_no AND cb IS DISTINCT FROM cluster_no) AS outgoing FROM cl GROUP BY cluster_no".replace("AS inner,", 'AS "inner",'))
def clus_edge_counts(spark, folder):
    return K.edge_counts(citations(spark, folder), _half(spark, folder))


_LINKS = f"{_HALF}, nl AS (SELECT cl.cluster_no, cl.node, count(*) FILTER (WHERE way = 'in' AND same) AS in_inner, count(*) FILTER (WHERE way = 'in' AND NOT same) AS in_outer, count(*) FILTER (WHERE way = 'out' AND same) AS out_inner, count(*) FILTER (WHERE way = 'out' AND NOT same) AS out_outer FROM cl LEFT JOIN (SELECT citing AS node, 'out' AS way, coalesce(ca = cb, FALSE) AS same FROM e2 UNION ALL SELECT cited, 'in', coalesce(ca = cb, FALSE) FROM e2) x ON x.node = cl.node GROUP BY ALL)"


@query(f"{W_}, {_LINKS} SELECT * FROM nl")
def clus_node_links(spark, folder):
    return K.node_links(citations(spark, folder), _half(spark, folder))


@query(f"{W_}, {_LINKS}, r AS (SELECT cluster_no, node, in_inner AS value, row_number() OVER (PARTITION BY cluster_no ORDER BY in_inner DESC, node) AS place, count(*) OVER (PARTITION BY cluster_no) AS n FROM nl) SELECT cluster_no, node, value, CAST(place AS INTEGER) AS place FROM r WHERE place <= greatest(1, floor(n * 0.1))")
def clus_top_share(spark, folder):
    return K.top_share(citations(spark, folder), _half(spark, folder), 0.1)


@query(f"{W_}, {A}, {_TIER}, b AS (SELECT cluster_no, author, min(tier) AS tier FROM ti JOIN a USING (node) GROUP BY ALL) SELECT author, count(*) AS clusters, round(count(*) FILTER (WHERE tier = 1) / count(*), 8) AS tier_1_share FROM b GROUP BY author")
def clus_tier_shares(spark, folder):
    return K.tier_shares(K.article_tiers(citations(spark, folder), _clusters(spark, folder)), authors(spark, folder)).withColumn("tier_1_share", F.round("tier_1_share", 8))


@query(
    f"{W_}, {base.L}, d AS (SELECT DISTINCT l.cited_1, l.cited_2, 'dc' AS kind FROM l JOIN e ON (citing = cited_1 AND cited = cited_2) OR (citing = cited_2 AND cited = cited_1)), b AS (SELECT DISTINCT l.cited_1, l.cited_2, 'bc' AS kind FROM l JOIN e u ON u.citing = cited_1 JOIN e v ON v.citing = cited_2 AND v.cited = u.cited), c AS (SELECT DISTINCT l.cited_1, l.cited_2, 'cc' AS kind FROM l JOIN e u ON u.cited = cited_1 JOIN e v ON v.cited = cited_2 AND v.citing = u.citing), "
    "n AS (SELECT least(p.cluster_no, q.cluster_no) AS cluster_1, greatest(p.cluster_no, q.cluster_no) AS cluster_2, kind, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) z JOIN y p ON p.node = z.cited_1 JOIN y q ON q.node = z.cited_2 WHERE p.cluster_no <> q.cluster_no GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster_1, cluster_2) AS ratio, rank() OVER (PARTITION BY kind ORDER BY n DESC) + (count(*) OVER (PARTITION BY kind, n) - 1) / 2 AS place FROM n) "
    "SELECT cluster_1, cluster_2, kind, n, round(ratio, 8) AS ratio, round(avg(place) OVER (PARTITION BY cluster_1, cluster_2), 6) AS mean_rank FROM r"
)
def clus_link_types(spark, folder):
    out = K.link_types(citations(spark, folder), _clusters(spark, folder), base.pair_list(spark, folder))
    return out.withColumns({"ratio": F.round("ratio", 8), "mean_rank": F.round("mean_rank", 6)})


@query(f"WITH {Y}, c AS (SELECT cluster_no, issn AS subject, count(*) AS n FROM y GROUP BY ALL) SELECT cluster_no, subject, n, CAST(place AS INTEGER) AS place FROM (SELECT *, rank() OVER (PARTITION BY cluster_no ORDER BY n DESC) AS place FROM c) WHERE place <= 3")
def clus_subject_ranks(spark, folder):
    """The subjects of most of each cluster's articles."""
    n = nodes(spark, folder)
    return K.subject_ranks(_clusters(spark, folder), n.select("node", F.col("issn").alias("subject")))


@query(f"{W_}, d AS (SELECT node, count(*) AS degree FROM (SELECT citing AS node FROM e UNION ALL SELECT cited FROM e) GROUP BY node) SELECT * FROM (SELECT cluster_no, y.node, coalesce(degree, 0) AS degree, CAST(row_number() OVER (PARTITION BY cluster_no ORDER BY coalesce(degree, 0) DESC, y.node) AS INTEGER) AS place FROM y LEFT JOIN d ON d.node = y.node) WHERE place <= 5")
def clus_degree_top(spark, folder):
    return K.degree_top(citations(spark, folder), _clusters(spark, folder), 5)


@query(f"WITH RECURSIVE {E}, {base._U}, {base._KCORE}, kk AS (SELECT a, b FROM k WHERE i = {base.ROUNDS}), kb AS (SELECT a AS x, b AS z FROM kk UNION ALL SELECT b, a FROM kk), cc(i, x, c) AS (SELECT DISTINCT 0, x, x FROM kb UNION ALL SELECT i + 1, r.x, least(r.c, m.c) FROM cc r JOIN (SELECT kb.x, min(q.c) AS c FROM kb JOIN cc q ON q.x = kb.z GROUP BY kb.x) m ON m.x = r.x WHERE i < 12), fc AS (SELECT x AS node, c AS cluster_no FROM cc WHERE i = 12), t AS (SELECT count(*) AS m FROM u), ls AS (SELECT p.cluster_no, count(*) AS l FROM u JOIN fc p ON p.node = u.a JOIN fc q ON q.node = u.b AND q.cluster_no = p.cluster_no GROUP BY 1), ds AS (SELECT p.cluster_no, count(*) AS d FROM b2 JOIN fc p ON p.node = b2.x GROUP BY 1) SELECT cluster_no, node, round(l / m - pow(d / (2 * m), 2), 8) AS modularity FROM fc JOIN ls USING (cluster_no) JOIN ds USING (cluster_no), t")
def clus_kc(spark, folder):
    return K.kc_clusters(citations(spark, folder), base.CORE_K).withColumn("modularity", F.round("modularity", 8))


@query()
def clus_ikc(spark, folder):
    return K.ikc(citations(spark, folder), 10)


@query()
def clus_kmp_parse(spark, folder):
    return K.kmp_parse(citations(spark, folder), _clusters(spark, folder), 2, 1)


@query()
def clus_kmp_validity(spark, folder):
    e, c = citations(spark, folder), _clusters(spark, folder)
    return K.kmp_validity(e, K.kmp_parse(e, c, 2, 1), 2, 1).withColumn("modularity", F.round("modularity", 8))


@query()
def clus_kmp_summary(spark, folder):
    e, c = citations(spark, folder), _clusters(spark, folder)
    out = K.kmp_summary(K.kmp_validity(e, K.kmp_parse(e, c, 2, 1), 2, 1))
    return out.withColumns({x: F.round(x, 8) for x in ("low", "middle", "mean", "high")})


@query()
def clus_threshold(spark, folder):
    rows = table(spark, folder, "sb_plus_complete_kinetics").filter("cited_1 <> cited_2").groupBy(F.least("cited_1", "cited_2").alias("cited_1"), F.greatest("cited_1", "cited_2").alias("cited_2")).agg(F.sum("frequency").alias("f")).filter("f is not null")
    return K.threshold_clusters(rows, "f", [0.5, 0.8, 0.95], 20)


@query()
def clus_agglomerate(spark, folder):
    m = K.inter_cluster_matrix(P.cocited_pairs(citations(spark, folder)), _clusters(spark, folder), "frequency")
    return K.agglomerate(m.select("cluster_1", "cluster_2", F.col("max").alias("weight")), 12)


@query()
def clus_mcl(spark, folder):
    return K.mcl(recorded_pairs(spark, folder))


# Texts. Words are folded alike in both engines, over all scripts (see folded()).

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_FOLDED = "translate(lower(translate({}, chr(304), 'i')), chr(962), chr(963))"
_TOK = f"tk AS (SELECT doc, term, count(*) AS n FROM (SELECT doc_id AS doc, unnest(regexp_split_to_array({_FOLDED.format('text')}, '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents) WHERE length(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_STOP}) GROUP BY ALL)"


def _tokens(spark, folder, n=1):
    return T.token_table(table(spark, folder, "documents"), "doc_id", "text", n)


def _doc_clusters(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("node"), F.col("text_kind").alias("cluster_no")).filter("cluster_no is not null")


@query(f"WITH {_TOK} SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS n FROM tk GROUP BY term")
def text_token_counts(spark, folder):
    return _tokens(spark, folder).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))


@query(f"WITH {_TOK} SELECT text_kind AS cluster_no, term, count(*) AS df FROM tk JOIN documents ON doc_id = doc WHERE text_kind IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def text_cluster_terms(spark, folder):
    return T.cluster_terms(_tokens(spark, folder), _doc_clusters(spark, folder))


_JSD = f"{_TOK}, ct AS (SELECT text_kind AS c, term, count(*) AS df FROM tk JOIN documents ON doc_id = doc WHERE text_kind IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), q AS (SELECT c, term, df / sum(df) OVER (PARTITION BY c) AS q FROM ct), w AS (SELECT c, doc, n / sum(n) OVER (PARTITION BY doc) AS p, q FROM tk JOIN documents ON doc_id = doc JOIN q ON q.c = text_kind AND q.term = tk.term), j AS (SELECT c, doc, greatest(0, sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 + ln(2) / 2 * (1 - sum(q))) AS jsd FROM w GROUP BY ALL)"


@query(f"WITH {_JSD} SELECT c AS cluster_no, doc, round(jsd, 7) AS jsd FROM j")
def text_doc_jsd(spark, folder):
    return T.doc_jsd(_tokens(spark, folder), _doc_clusters(spark, folder)).withColumn("jsd", F.round("jsd", 7))


@query(f"WITH {_JSD}, s AS (SELECT text_kind AS c, count(*) AS size FROM documents WHERE text_kind IS NOT NULL GROUP BY 1) SELECT s.c AS cluster_no, size, CASE WHEN count(jsd) >= 10 THEN round(avg(jsd), 7) END AS mean, CASE WHEN count(jsd) >= 10 THEN round(stddev_pop(jsd), 7) END AS deviation, CASE WHEN count(jsd) >= 10 THEN round(min(jsd), 7) END AS low, CASE WHEN count(jsd) >= 10 THEN round(quantile_cont(jsd, 0.25), 7) END AS q1, CASE WHEN count(jsd) >= 10 THEN round(quantile_cont(jsd, 0.5), 7) END AS middle, CASE WHEN count(jsd) >= 10 THEN round(quantile_cont(jsd, 0.75), 7) END AS q3, CASE WHEN count(jsd) >= 10 THEN round(max(jsd), 7) END AS high FROM s LEFT JOIN j ON j.c = s.c GROUP BY ALL")
def text_cluster_jsd(spark, folder):
    out = T.cluster_jsd(_tokens(spark, folder), _doc_clusters(spark, folder))
    return out.withColumns({c: F.round(c, 7) for c in out.columns[2:]})


@query()
def text_coherence(spark, folder):
    tokens, docs, clusters = _tokens(spark, folder), table(spark, folder, "documents"), _doc_clusters(spark, folder)
    stats = T.cluster_jsd(tokens, clusters)
    return T.coherence(stats, T.random_jsd(tokens, docs, "doc_id", stats, 2)).withColumns({c: F.round(c, 7) for c in ("mean", "random_mean", "coherence")})


@query(f"WITH {_TOK}, n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(log10((n.n - count(*) + 0.5) / (count(*) + 0.5)), 8) AS idf FROM tk, n GROUP BY term, n.n")
def text_idf(spark, folder):
    n = table(spark, folder, "documents").agg(F.count(F.lit(1)).cast("double")).scalar()
    return T.idf(_tokens(spark, folder), n).withColumn("idf", F.round("idf", 8))


_ITEMS = "it AS (SELECT item_id AS query, term, count(*) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(" + _FOLDED.format("item_text") + ", '[^\\p{L}\\p{N}]+')) AS term FROM eval_items) WHERE length(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN (" + _STOP + ") GROUP BY ALL)"


def _items(spark, folder):
    return T.token_table(table(spark, folder, "eval_items"), "item_id", "item_text")


_BM = f"WITH {_TOK}, {_ITEMS}, le AS (SELECT doc, CAST(sum(n) AS BIGINT) AS length FROM tk GROUP BY doc), st AS (SELECT count(*) AS nd, avg(length) AS mean FROM le), iw AS (SELECT term, log10((nd - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tk, st GROUP BY term, nd), sc AS (SELECT query, doc, sum(idf * tk.n * 3.0 / (tk.n + 2.0 * (0.25 + 0.75 * length / mean))) AS score FROM (SELECT DISTINCT query, term FROM it) JOIN tk USING (term) JOIN iw USING (term) JOIN le USING (doc), st GROUP BY ALL)"


def _bm25(spark, folder, okapi=True):
    index = _tokens(spark, folder)
    return T.bm25(_items(spark, folder), index, index.groupBy("doc").agg(F.sum("n").alias("length")), okapi=okapi)


def _top_ten(scores):
    return R.distinct_on(scores.withColumn("score", F.round("score", 6)), ["query", "doc"], [F.desc("score")]).transform(lambda d: d.withColumn("rn", F.row_number().over(base.S.Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).filter("rn <= 10").drop("rn"))


@query(_BM + " SELECT query, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rn FROM sc) WHERE rn <= 10")
def text_bm25(spark, folder):
    return _top_ten(_bm25(spark, folder))


@query(_BM.replace("(tk.n + 2.0 *", "(idf + 2.0 *") + " SELECT query, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS rn FROM sc) WHERE rn <= 10")
def text_bm25_study(spark, folder):
    """The form with the idf in the denominator."""
    return _top_ten(_bm25(spark, folder, False))


_COS = f"WITH {_TOK}, {_ITEMS}, n1 AS (SELECT query, sqrt(sum(n * n)) AS x FROM it GROUP BY 1), n2 AS (SELECT doc, sqrt(sum(n * n)) AS y FROM tk GROUP BY 1), d AS (SELECT query, doc, sum(it.n * tk.n) AS d FROM it JOIN tk USING (term) GROUP BY ALL), cs AS (SELECT query, doc, d / (x * y) AS cosine FROM d JOIN n1 USING (query) JOIN n2 USING (doc))"


@query(_COS + " SELECT query, doc, round(cosine, 8) AS cosine FROM cs")
def text_cosine(spark, folder):
    return T.similarities(_items(spark, folder), _tokens(spark, folder)).withColumn("cosine", F.round("cosine", 8))


@query()
def text_rank_blend(spark, folder):
    both = _bm25(spark, folder).join(T.similarities(_items(spark, folder), _tokens(spark, folder)), ["query", "doc"])
    return T.rank_matches(both, "score", "cosine").withColumn("blend", F.round("blend", 6))


@query(f"WITH {_TOK}, {_ITEMS}, w AS (SELECT term, log10(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tk GROUP BY term), x AS (SELECT query, term, n * idf AS v FROM it JOIN w USING (term)), z AS (SELECT doc, term, n * idf AS v FROM tk JOIN w USING (term)), n1 AS (SELECT query, sqrt(sum(v * v)) AS a FROM x GROUP BY 1), n2 AS (SELECT doc, sqrt(sum(v * v)) AS b FROM z GROUP BY 1), d AS (SELECT query, doc, sum(x.v * z.v) AS d FROM x JOIN z USING (term) GROUP BY ALL) SELECT query, doc, round(d / (a * b), 7) AS cosine FROM d JOIN n1 USING (query) JOIN n2 USING (doc)")
def text_cosine_weighted(spark, folder):
    """Cosines of the vectors weighted by idf."""
    tokens = _tokens(spark, folder)
    weights = T.idf(tokens, table(spark, folder, "documents").agg(F.count(F.lit(1)).cast("double")).scalar())
    return T.similarities(_items(spark, folder), tokens, weights).withColumn("cosine", F.round("cosine", 7))


@query(f"WITH {_TOK.replace('tk AS', 't1 AS', 1)}, g AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array({_FOLDED.format('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_STOP})) AS w FROM documents), b AS (SELECT doc, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM g WHERE len(w) > 1) SELECT term, count(DISTINCT doc) AS df, count(*) AS n FROM b GROUP BY term")
def text_bigram_counts(spark, folder):
    return _tokens(spark, folder, 2).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("n"))


@query(f"WITH d AS (SELECT doc_id AS doc, regexp_split_to_array({_FOLDED.format('coalesce(text, $$$$)')}, '[^\\p{{L}}\\p{{N}}]+') AS a, regexp_split_to_array({_FOLDED.format('coalesce(source, $$$$)')}, '[^\\p{{L}}\\p{{N}}]+') AS b FROM documents), s AS (SELECT doc, list_transform(['patients', 'trial', 'abstract'], lambda w: CASE WHEN list_contains(b, w) THEN 2.0 WHEN list_contains(a, w) THEN 1.0 ELSE 0.0 END) AS v FROM d) SELECT doc, CAST(len(list_filter(v, lambda x: x > 0)) AS INTEGER) AS hits, CAST(list_sum(v) AS DOUBLE) AS score FROM s WHERE len(list_filter(v, lambda x: x > 0)) > 0")
def text_match_any(spark, folder):
    """Any of several words in any of several fields, weighted."""
    return T.match_any(table(spark, folder, "documents"), {"source": 2.0, "text": 1.0}, "doc_id", "Patients trial abstract")


_NORM = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' '"


@query(f"SELECT doc_id AS doc FROM documents WHERE contains({_NORM}, ' clinical trial ') OR (contains({_NORM}, ' primary ') AND contains({_NORM}, ' baseline '))")
def text_match(spark, folder):
    docs = table(spark, folder, "documents")
    return T.text_match(docs, "doc_id", "text", "Clinical trial", "phrase").unionByName(T.text_match(docs, "doc_id", "text", "primary baseline")).distinct()


# Loads.


@query("WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY appl_no, product_no, type ORDER BY trade_name DESC, strength DESC, approval_date DESC) AS rn FROM fda_products) WHERE rn = 1) SELECT appl_no, product_no, type, trade_name, strength, approval_date FROM d")
def dml_distinct_on(spark, folder):
    rows = table(spark, folder, "fda_products")
    return R.distinct_on(rows, ["appl_no", "product_no", "type"], [F.desc("trade_name"), F.desc("strength"), F.desc("approval_date")]).select("appl_no", "product_no", "type", "trade_name", "strength", "approval_date")


def _load(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    return orders.filter("o_orderstatus <> 'P'"), orders.filter("o_orderstatus <> 'F'").withColumn("price", F.lit(1.0))


_LOADS = "b AS (SELECT o_orderkey, o_orderstatus, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'), d AS (SELECT o_orderkey, o_orderstatus, 1.0::DOUBLE AS price FROM orders WHERE o_orderstatus <> 'F')"


@query(f"WITH {_LOADS} SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT * FROM d")
def dml_upsert(spark, folder):
    return R.upsert(*_load(spark, folder), ["o_orderkey"])


@query(f"WITH {_LOADS} SELECT * FROM b UNION ALL SELECT * FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def dml_insert_ignore(spark, folder):
    return R.insert_ignore(*_load(spark, folder), ["o_orderkey"])


@query(f"WITH {_LOADS} SELECT o_orderkey, price, 'expired' AS status FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT o_orderkey, price, 'current' FROM d")
def dml_expire_and_upsert(spark, folder):
    b, d = (x.drop("o_orderstatus").withColumn("status", F.lit("current")) for x in _load(spark, folder))
    return R.expire_and_upsert(b, d, ["o_orderkey"]).select("o_orderkey", "price", "status")


@query("SELECT sgr, max(last_updated_time)::DATE AS at FROM scopus_publication_groups GROUP BY sgr")
def dml_dedup_last(spark, folder):
    rows = table(spark, folder, "scopus_publication_groups").select("sgr", "last_updated_time")
    return R.dedup_last(rows.withColumn("seq", F.col("last_updated_time")), ["sgr"], "seq").select("sgr", F.col("last_updated_time").cast("date").alias("at"))


@query("SELECT sgr, 1 AS part FROM (SELECT sgr FROM scopus_publication_groups WHERE sgr NOT IN (SELECT sgr FROM scopus_group_deletes WHERE sgr IS NOT NULL)) UNION ALL SELECT DISTINCT sgr, 2 FROM scopus_publication_groups WHERE sgr IN (SELECT sgr FROM scopus_group_deletes)")
def dml_delete_with_log(spark, folder):
    left, log = R.delete_by_ids(table(spark, folder, "scopus_publication_groups"), table(spark, folder, "scopus_group_deletes"), "sgr", F.current_timestamp())
    return left.select("sgr", F.lit(1).alias("part")).unionByName(log.select("sgr", F.lit(2).alias("part")))


_FEED = "f AS (SELECT l_orderkey // 2 AS oci, 'p' || (l_orderkey % 50) AS citing, 'P' || (l_partkey % 50) AS cited, CASE WHEN l_linenumber = 7 THEN '2031-01-01' WHEN l_linenumber = 6 THEN '1999' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS creation, ((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber AS seq FROM lineitem)"


@query(
    f"WITH {_FEED}, g AS (SELECT *, lower(citing) AS a, lower(cited) AS b, CASE WHEN lower(citing) = lower(cited) THEN 'self' WHEN try_strptime(creation, '%Y-%m-%d') IS NULL OR try_strptime(creation, '%Y-%m-%d') > DATE '2030-01-01' THEN 'no_valid_dating' END AS r1 FROM f), "
    "h AS (SELECT *, row_number() OVER w AS n, first_value(a || '|' || b || '|' || creation) OVER w AS head FROM g WINDOW w AS (PARTITION BY oci, r1 IS NULL ORDER BY seq)), i AS (SELECT *, coalesce(r1, CASE WHEN n > 1 THEN CASE WHEN head = a || '|' || b || '|' || creation THEN 'exact_repeat' ELSE 'duplicate' END END) AS r2 FROM h), "
    "j AS (SELECT *, row_number() OVER w AS k, first_value(a) OVER w AS st FROM i WINDOW w AS (PARTITION BY least(a, b), greatest(a, b), r2 IS NULL ORDER BY seq)) SELECT seq, coalesce(r2, CASE WHEN k = 1 THEN 'main' WHEN st = a THEN 'parallel' ELSE 'looping' END) AS route FROM j"
)
def dml_triage_citations(spark, folder):
    li = table(spark, folder, "lineitem")
    creation = F.when(F.col("l_linenumber") == 7, "2031-01-01").when(F.col("l_linenumber") == 6, "1999").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    feed = li.select(F.floor(F.col("l_orderkey") / 2).alias("oci"), F.concat(F.lit("p"), F.col("l_orderkey") % 50).alias("citing"), F.concat(F.lit("P"), F.col("l_partkey") % 50).alias("cited"), creation.alias("creation"), (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("seq"))
    return R.triage_citations(feed).select("seq", "route")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = 3 ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
def rel_find_page(spark, folder):
    return R.find(table(spark, folder, "customer"), {"c_nationkey": 3}, ["c_acctbal desc", "c_custkey"], 5, 10).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey, n_nationkey AS band FROM orders JOIN nation ON year(o_orderdate) BETWEEN 1992 + n_nationkey AND 1993 + n_nationkey WHERE n_regionkey = 1")
def rel_range_join(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    bands = table(spark, folder, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("band"))
    return R.range_join(orders, bands, "y", 1992 + F.col("band"), 1993 + F.col("band")).select("o_orderkey", "band")


@query("WITH a AS (SELECT DISTINCT lower(ingredient) AS a FROM fda_products WHERE ingredient IS NOT NULL), b AS (SELECT DISTINCT lower(product_name) AS b FROM fda_purple_book WHERE product_name IS NOT NULL), m AS (SELECT a, b, levenshtein(a, b) AS distance FROM a, b WHERE levenshtein(a, b) <= 2) SELECT a, b, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rn FROM m) WHERE rn = 1")
def rel_fuzzy_match(spark, folder):
    a = table(spark, folder, "fda_products").select(F.lower("ingredient").alias("a")).na.drop()
    b = table(spark, folder, "fda_purple_book").select(F.lower("product_name").alias("b")).na.drop()
    return R.fuzzy_match(a, b, "a", "b", 2)


@query("WITH s AS (SELECT DISTINCT o_orderstatus AS s, o_custkey AS k FROM orders) SELECT a.s AS set_1, b.s AS set_2, count(*) AS n FROM s a JOIN s b ON a.k = b.k AND a.s <= b.s GROUP BY ALL")
def set_pairwise_intersections(spark, folder):
    return R.pairwise_intersections(table(spark, folder, "orders"), "o_orderstatus", "o_custkey")


@query("SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)) WHERE rn <= 2 * (SELECT count(*) FROM customer WHERE c_nationkey = 4)")
def set_matched_control(spark, folder):
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return R.matched_control(c, c.filter("c_nationkey = 4"), "c_custkey", 2, F.col("c_acctbal")).select("c_custkey", "c_acctbal")


@query(f"WITH r AS (SELECT c_custkey, {base._hash_sql('7', 'c_custkey')} AS h FROM customer WHERE c_nationkey <> 4) SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY h, c_custkey) AS rn FROM r) WHERE rn <= 2 * (SELECT count(*) FROM customer WHERE c_nationkey = 4)")
def set_matched_random(spark, folder):
    """The control group drawn at random, by a seeded hash."""
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return R.matched_control(c, c.filter("c_nationkey = 4"), "c_custkey", 2, portable_hash(F.lit(7), F.col("c_custkey"))).select("c_custkey")


@query("SELECT DISTINCT 'omid:' || p_partkey AS owner, id FROM (SELECT p_partkey, unnest(string_split('doi:' || p_size || ' pmid:' || p_partkey || ' doi:' || p_size, ' ')) AS id FROM part)")
def dml_explode_ids(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("owner"), F.concat(F.lit("doi:"), F.col("p_size"), F.lit(" pmid:"), F.col("p_partkey"), F.lit(" doi:"), F.col("p_size")).alias("ids"))
    return R.explode_ids(part, "owner", "ids", "omid:")


_GRANTS = "g AS (SELECT o_custkey AS k, 'R01' || CASE WHEN o_orderkey % 3 = 0 THEN 'DA' WHEN o_orderkey % 3 = 1 THEN 'CA' ELSE 'GM' END || o_orderkey AS number FROM orders WHERE o_custkey % 2 = 0)"


@query(f"WITH {_GRANTS} SELECT c_custkey, EXISTS (SELECT 1 FROM g WHERE k = c_custkey AND substring(number, 4, 2) = 'DA') AS agency_support, EXISTS (SELECT 1 FROM g WHERE k = c_custkey AND substring(number, 4, 2) <> 'DA') AS other_support FROM customer")
def fn_support_flags(spark, folder):
    """Flags of grants of one agency and of others, by the code within the grant's number."""
    o = F.col("o_orderkey")
    grants = table(spark, folder, "orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("R01"), F.when(o % 3 == 0, "DA").when(o % 3 == 1, "CA").otherwise("GM"), o).alias("number"))
    return R.support_flags(table(spark, folder, "customer").select("c_custkey"), "c_custkey", grants, "number", "DA", "agency_support", "other_support")


_PLAIN = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' '"


@query(f"WITH q AS (SELECT DISTINCT split_part(brief_title, ' in ', 1) AS drug FROM ct_clinical_studies WHERE brief_title IS NOT NULL), q2 AS (SELECT drug, {_PLAIN.format('drug')} AS p FROM q), d AS (SELECT nct_id, brief_title, {_PLAIN.format('brief_title')} AS t FROM ct_clinical_studies) SELECT nct_id, brief_title, drug FROM q2 JOIN d ON trim(p) <> '' AND contains(t, p)")
def join_text(spark, folder):
    """Titles joined with the names they hold."""
    studies = table(spark, folder, "ct_clinical_studies").select("nct_id", "brief_title")
    phrases = studies.filter("brief_title is not null").select(F.split_part("brief_title", F.lit(" in "), F.lit(1)).alias("drug")).distinct()
    return R.text_join(studies, "brief_title", phrases, "drug").select("nct_id", "brief_title", "drug")


@query()
def set_random_rows(spark, folder):
    return R.sample_rows(table(spark, folder, "orders"), "o_orderkey", 100, 7).select("o_orderkey")


@query()
def rel_bernoulli_sample(spark, folder):
    return table(spark, folder, "orders").sample(0.1, 7).select("o_orderkey")


@query("SELECT o_orderkey, name, value FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS custkey, o_totalprice AS totalprice FROM orders) UNPIVOT (value FOR name IN (custkey, totalprice))")
def agg_unpivot(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("custkey"), F.col("o_totalprice").alias("totalprice"))
    return o.unpivot("o_orderkey", ["custkey", "totalprice"], "name", "value")


# Functions.


@query("SELECT p_partkey, CASE WHEN m <= 12 AND NOT (m IN (2) AND d > 28) AND NOT (m IN (4, 6, 9, 11) AND d > 30) AND d <= 31 THEN make_date(y::BIGINT, greatest(m, 1)::BIGINT, greatest(d, 1)::BIGINT) END AS date FROM (SELECT p_partkey, 2001 AS y, p_partkey % 14 AS m, p_size % 33 AS d FROM part)")
def fn_try_parse(spark, folder):
    return table(spark, folder, "part").select("p_partkey", C.try_parse(F.lit(2001), F.col("p_partkey") % 14, F.col("p_size") % 33).alias("date"))


@query("SELECT s, CASE WHEN regexp_full_match(s, '\\d{4}(-\\d{2}){0,2}') THEN CAST(s[1:4] AS INTEGER) END AS y, CASE WHEN regexp_full_match(s, '\\d{4}-\\d{2}(-\\d{2})?') THEN CAST(s[6:7] AS INTEGER) END AS m, CAST(CASE WHEN regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(s, '%Y-%m-%d') END AS DATE) AS d FROM (SELECT DISTINCT trim(start_date) AS s FROM ct_clinical_studies)")
def fn_partial_dates(spark, folder):
    s = F.col("s")
    return table(spark, folder, "ct_clinical_studies").select(F.trim("start_date").alias("s")).distinct().select("s", C.extract_year(s).alias("y"), C.extract_month(s).alias("m"), C.iso_date(s).alias("d"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (p_size * 12 + p_partkey % 12) AS months, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * (p_partkey % 30) AS days, CASE WHEN p_size % 2 = 0 THEN -1 ELSE 1 END * ((p_partkey % 24) * 3600 + (p_size % 60) * 60 + 1.5::DOUBLE) AS seconds FROM part")
def fn_iso_interval(spark, folder):
    text = F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise(""), F.lit("P"), F.col("p_size"), F.lit("Y"), F.col("p_partkey") % 12, F.lit("M"), F.col("p_partkey") % 30, F.lit("DT"), F.col("p_partkey") % 24, F.lit("H"), F.col("p_size") % 60, F.lit("M1.5S"))
    return table(spark, folder, "part").select("p_partkey", C.iso_interval(text).alias("i")).select("p_partkey", F.col("i.months").cast("long").alias("months"), F.col("i.days").cast("long").alias("days"), F.col("i.seconds").alias("seconds"))


@query("SELECT id, lower(concat(trim(last_name, ' '), substr(trim(first_name, ' '), 1, 1))) AS author_key FROM ct_overall_officials WHERE last_name IS NOT NULL")
def fn_author_key(spark, folder):
    rows = table(spark, folder, "ct_overall_officials").filter("last_name is not null")
    return rows.select("id", C.author_key(F.col("last_name"), F.col("first_name")).alias("author_key"))


@query("SELECT appl_no, product_no, CASE WHEN regexp_matches(strength, '\\d') THEN regexp_extract(strength, '(\\d+)', 1) END AS amount FROM fda_products")
def fn_substring_match(spark, folder):
    return table(spark, folder, "fda_products").select("appl_no", "product_no", C.substring_match(F.col("strength"), r"(\d+)").alias("amount"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount + l_tax, 6) AS total, round((l_quantity + l_discount + l_tax) / 3, 6) AS mean FROM lineitem")
def fn_row_stats(spark, folder):
    s = C.row_stats(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.round(s["sum"], 6).alias("total"), F.round(s["mean"], 6).alias("mean"))


# Quality.


@query("SELECT appl_no, product_no, type, count(*) AS n FROM fda_products GROUP BY ALL HAVING count(*) > 1")
def dq_unique(spark, folder):
    return Q.check_unique(table(spark, folder, "fda_products"), ["appl_no", "product_no", "type"])


@query("SELECT ref_sgr, count(*) AS n FROM scopus_references WHERE ref_sgr IS NOT NULL AND ref_sgr NOT IN (SELECT sgr FROM scopus_publication_groups WHERE sgr IS NOT NULL) GROUP BY 1")
def dq_orphans(spark, folder):
    return Q.check_orphans(table(spark, folder, "scopus_references"), "ref_sgr", table(spark, folder, "scopus_publication_groups"), "sgr")


@query("SELECT * FROM (SELECT y AS year, n, lag(n) OVER (ORDER BY y) AS before, round((n - lag(n) OVER (ORDER BY y)) / lag(n) OVER (ORDER BY y), 8) AS growth FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1)) WHERE growth < 0")
def dq_yearly_growth(spark, folder):
    return Q.check_yearly_growth(table(spark, folder, "orders"), F.year("o_orderdate")).withColumn("growth", F.round("growth", 8))


@query("SELECT 'unique' AS \"check\", (SELECT count(*) FROM (SELECT bla_stn FROM fda_purple_book GROUP BY 1 HAVING count(*) > 1)) AS violations, (SELECT count(*) FROM (SELECT bla_stn FROM fda_purple_book GROUP BY 1 HAVING count(*) > 1)) = 0 AS passed UNION ALL SELECT 'rows', 0, true UNION ALL SELECT 'not_null', 0, true UNION ALL SELECT 'future', (SELECT count(*) FROM scopus_references WHERE last_updated_time > TIMESTAMP '2015-01-01'), (SELECT count(*) FROM scopus_references WHERE last_updated_time > TIMESTAMP '2015-01-01') = 0")
def dq_summary(spark, folder):
    book, refs = table(spark, folder, "fda_purple_book"), table(spark, folder, "scopus_references")
    return Q.summary({"unique": Q.check_unique(book, ["bla_stn"]), "rows": Q.check_min_rows(refs, 10), "not_null": Q.check_not_all_null(refs), "future": Q.check_no_future(refs, "last_updated_time", F.lit("2015-01-01").cast("timestamp"))})


@query("WITH l AS (SELECT CAST(last_updated_time AS DATE) AS day, count(*) AS n FROM scopus_publication_groups WHERE last_updated_time IS NOT NULL GROUP BY 1) SELECT * FROM (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM l) WHERE n < before")
def dq_no_decrease(spark, folder):
    loads = table(spark, folder, "scopus_publication_groups").filter("last_updated_time is not null").groupBy(F.to_date("last_updated_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return Q.check_no_decrease(loads, "day", "n")


# Productivity.

_AW = "r AS (SELECT c_nationkey AS award, o_custkey AS person, year(o_orderdate) AS y, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey)"


def _award_rows(spark, folder):
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("award"), F.col("o_custkey").alias("person"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("v"), F.lit(1997).alias("start"))


@query(f"WITH {_AW}, e AS (SELECT award, y - 1997 AS distance, person, count(*) AS n, sum(v) AS v FROM r WHERE y - 1997 BETWEEN -2 AND 2 GROUP BY ALL) SELECT award, CAST(distance AS INTEGER) AS distance, count(*) AS persons, round(avg(n), 6) AS mean_rows, round(stddev_pop(n), 6) AS std_rows, round(avg(v), 5) AS mean_value, round(stddev_pop(v), 4) AS std_value FROM e GROUP BY ALL")
def award_means(spark, folder):
    out = W.award_means(_award_rows(spark, folder), "award", "person", "y", "start", "v", -2, 2)
    return out.withColumns({"mean_rows": F.round("mean_rows", 6), "std_rows": F.round("std_rows", 6), "mean_value": F.round("mean_value", 5), "std_value": F.round("std_value", 4)})


@query(f"WITH {_AW}, e AS (SELECT award, person, count(*) AS n FROM r GROUP BY ALL) SELECT award, count(*) AS persons, round(100.0 * count(*) FILTER (WHERE n >= 5) / count(*), 6) AS percent_5, round(100.0 * count(*) FILTER (WHERE n >= 10) / count(*), 6) AS percent_10 FROM e GROUP BY award")
def award_share_reaching(spark, folder):
    return W.share_reaching(_award_rows(spark, folder), "award", "person", [5, 10]).withColumns({c: F.round(c, 6) for c in ("percent_5", "percent_10")})


@query(f"WITH {_AW}, p AS (SELECT *, cume_dist() OVER (PARTITION BY y ORDER BY v) AS c FROM r) SELECT award, count(*) AS n, round(quantile_cont(c, 0.25), 6) AS q1, round(quantile_cont(c, 0.5), 6) AS middle, round(quantile_cont(c, 0.75), 6) AS q3 FROM p GROUP BY award")
def award_quartiles(spark, folder):
    return W.award_quartiles(_award_rows(spark, folder), "award", "y", "v").withColumns({c: F.round(c, 6) for c in ("q1", "middle", "q3")})


@query("WITH m AS (SELECT DISTINCT l_orderkey AS w, CAST(s_nationkey AS INTEGER) AS g FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT *, count(*) OVER (PARTITION BY w) AS n FROM m) SELECT a.g AS group_1, b.g AS group_2, count(*) AS works FROM k a JOIN m b ON a.w = b.w AND (a.g < b.g OR (a.g = b.g AND a.n = 1)) GROUP BY ALL")
def award_coauthor_links(spark, folder):
    li, s = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    members = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("w"), F.col("s_nationkey").cast("int").alias("g"))
    return W.coauthor_links(members, "w", "g")


# Sources and sinks: written to the shared folder and read back.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src_delimited_roundtrip(spark, folder):
    path = scratch(spark, "nation")
    rows = table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey")
    IO.write_delimited(rows, path, sep="~")
    return IO.read_delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int", sep="~", null="NA")


@query(f"WITH {base.K} SELECT citing, cited FROM k")
def src_edge_list_roundtrip(spark, folder):
    path = scratch(spark, "edges")
    IO.write_delimited(recorded_pairs(spark, folder), path, sep="\t", header=False)
    return IO.read_edges(spark, path)


@query("SELECT o_orderkey, l_partkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def src_xml_shred(spark, folder):
    """Orders written as XML documents with their lines nested, and shredded again."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.concat(F.lit("<line part='"), "l_partkey", F.lit("'/>")).alias("x"))
    docs = lines.groupBy("l_orderkey").agg(F.concat_ws("", F.collect_list("x")).alias("x"))
    docs = docs.join(table(spark, folder, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("<order><id>"), "o_orderkey", F.lit("</id>"), "x", F.lit("</order>")).alias("x"))
    parsed = parse_xml(docs, "x", "id long, line array<struct<_part:long>>").select("doc.*")
    lines = shred(parsed, {"lines": TableSpec("line", {"o_orderkey": "id", "l_partkey": "r._part"})})["lines"]
    return lines.groupBy("o_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))

