"""Queries for the relational operators: projections, joins, aggregates, windows, set operations, functions.

What both engines spell alike is one SQL text; SPARK holds the text for Spark where it differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings scopus_references scopus_publication_groups scopus_group_deletes "
    "sb_plus_complete_kinetics ct_clinical_studies ct_overall_officials fda_products fda_purple_book"
).split()

SQL = {
    # Projections, filters, predicates.
    "rel_project_tag": "SELECT p_partkey AS node, 'part' AS stype, upper(p_brand) AS brand FROM part",
    "rel_between": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000",
    "rel_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "rel_not_in_null_aware": "SELECT sgr FROM scopus_group_deletes WHERE sgr NOT IN (SELECT sgr FROM scopus_publication_groups WHERE sgr IS NOT NULL)",
    "rel_not_in_with_null": "SELECT o_orderstatus, count(*) AS n, count(CASE WHEN o_custkey NOT IN (SELECT CASE WHEN c_custkey = 1 THEN NULL ELSE c_custkey END FROM customer WHERE c_nationkey < 5 OR c_custkey = 1) THEN 1 END) AS n_outside FROM orders GROUP BY o_orderstatus",
    "rel_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)",
    "rel_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "rel_exists_flag": "SELECT c.c_custkey, o.k IS NOT NULL AS has_order FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c.c_custkey",
    "rel_row_value_in": "SELECT DISTINCT cited_1, cited_2 FROM sb_plus_complete_kinetics WHERE (cited_1, cited_2) IN (SELECT cited_1, cited_2 FROM sb_plus_complete_kinetics GROUP BY cited_1, cited_2 HAVING sum(frequency) >= 10)",
    "rel_is_distinct_from": "SELECT count(*) AS n FROM sb_plus_complete_kinetics WHERE cited_1_pub_year IS DISTINCT FROM cited_2_pub_year",
    "rel_like": "SELECT p_partkey FROM part WHERE p_type LIKE '%STEEL%' OR p_name LIKE '%1%' OR p_brand LIKE 'Brand#1_'",
    "rel_regex": "SELECT appl_no, product_no FROM fda_products WHERE regexp_matches(trade_name, '^[A-M].*[AEIOU]$')",
    "rel_case": "SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "rel_pair_inequality": "SELECT a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN nation c ON c.n_regionkey = b.n_regionkey AND b.n_nationkey < c.n_nationkey",
    "rel_quantile_filter": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice) FROM orders)",
    "rel_complete_cases": "SELECT cited_1, cited_2, co_cited_year FROM sb_plus_complete_kinetics WHERE frequency IS NOT NULL AND cited_1_pub_year IS NOT NULL AND cited_2_pub_year IS NOT NULL",
    "rel_fill_null": "SELECT cited_1, cited_2, coalesce(frequency, 0) AS frequency FROM sb_plus_complete_kinetics",
    "rel_fill_forward": "SELECT sgr, CAST(last_updated_time AS DATE) AS at, max(pub_year) OVER (PARTITION BY sgr ORDER BY last_updated_time) AS year_so_far FROM scopus_publication_groups",
    # Joins.
    "join_inner": "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'",
    "join_using": "SELECT sgr, g.pub_year, CAST(d.delete_time AS DATE) AS delete_date FROM scopus_publication_groups g JOIN scopus_group_deletes d USING (sgr)",
    "join_left": "SELECT r.scp, r.ref_sgr, g.pub_year FROM scopus_references r LEFT JOIN (SELECT DISTINCT sgr, pub_year FROM scopus_publication_groups) g ON g.sgr = r.ref_sgr",
    "join_full": "SELECT coalesce(a.k, b.k) AS nation, coalesce(a.n, 0) AS n_customers, coalesce(b.n, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k",
    "join_right": "SELECT n_name, c_custkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000",
    "join_semi": "SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.09",
    "join_anti": "SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.05",
    "join_range_residual": "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate <= o_orderdate + INTERVAL 30 DAY",
    "join_or_residual": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND (a.n_name < b.n_name OR a.n_nationkey = b.n_nationkey)",
    "join_inequality_within": "SELECT a.product_no AS p1, b.product_no AS p2, a.appl_no FROM (SELECT DISTINCT appl_no, product_no FROM fda_products) a JOIN (SELECT DISTINCT appl_no, product_no FROM fda_products) b ON a.appl_no = b.appl_no AND a.product_no < b.product_no",
    "join_scalar_pair": "SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers",
    "join_year_table": "SELECT y.year, count(*) AS n FROM (SELECT DISTINCT co_cited_year AS year FROM sb_plus_complete_kinetics WHERE co_cited_year IS NOT NULL) y JOIN (SELECT DISTINCT cited_1, cited_2, first_possible_year AS f FROM sb_plus_complete_kinetics) k ON y.year = k.f + 5 GROUP BY y.year",
    "join_two_hop": "SELECT c.n_name AS name, count(DISTINCT o_orderkey) AS n FROM nation c JOIN customer ON c_nationkey = c.n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY c.n_name",
    "join_delete_using": "SELECT g.sgr, g.pub_year FROM scopus_publication_groups g ANTI JOIN scopus_group_deletes d ON g.sgr = d.sgr",
    "join_update_from": "SELECT k.cited_1, k.cited_2, coalesce(k.cited_1_pub_year, g.y) AS cited_1_pub_year FROM sb_plus_complete_kinetics k LEFT JOIN (SELECT sgr, max(pub_year) AS y FROM scopus_publication_groups GROUP BY sgr) g ON g.sgr = k.cited_1",
    "join_correlated_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "join_lateral_min_year": "SELECT k.cited_1, k.cited_2, m.y FROM (SELECT DISTINCT cited_1, cited_2 FROM sb_plus_complete_kinetics) k, LATERAL (SELECT min(co_cited_year) AS y FROM sb_plus_complete_kinetics x WHERE x.cited_1 = k.cited_1 AND x.cited_2 = k.cited_2) m",
    "join_unnest": "SELECT vec_id, label, u.x AS component FROM embeddings, unnest(embedding) AS u(x)",
    # Aggregates.
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, min(l_shipdate) AS first_ship, max(l_discount) AS top_discount, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus",
    "agg_distinct": "SELECT DISTINCT c_nationkey FROM customer",
    "agg_having": "SELECT scp, count(*) AS n FROM scopus_references GROUP BY scp HAVING count(*) >= 5",
    "agg_string": "SELECT nct_id, string_agg(DISTINCT last_name, '|' ORDER BY last_name) AS names FROM ct_overall_officials GROUP BY nct_id",
    "agg_array": "SELECT r_name, list_sort(list(n_nationkey)) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "agg_percentile_disc": "SELECT l_returnflag, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q25, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS q90 FROM lineitem GROUP BY l_returnflag",
    "agg_percentile_cont": "SELECT round(percentile_cont(0.05) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p05, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p50 FROM orders",
    "agg_median": "SELECT o_orderstatus, round(median(o_totalprice), 4) AS middle FROM orders GROUP BY o_orderstatus",
    "agg_deviation": "SELECT o_orderstatus, round(stddev_pop(o_totalprice), 3) AS pop, round(stddev_samp(o_totalprice), 3) AS samp FROM orders GROUP BY o_orderstatus",
    "agg_standard_error": "SELECT c_nationkey, round(coalesce(stddev_samp(c_acctbal) / sqrt(count(*)), 0), 5) AS error FROM customer GROUP BY c_nationkey",
    "agg_summary": "SELECT count(frequency) AS n, min(frequency) AS low, max(frequency) AS high, round(avg(frequency), 6) AS mean, round(stddev_samp(frequency), 6) AS deviation FROM sb_plus_complete_kinetics",
    "agg_conditional": "SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f, count(*) FILTER (WHERE o_totalprice > 150000) AS n_high FROM orders GROUP BY o_custkey",
    "agg_arg_max": "SELECT o_custkey, max(o_totalprice) AS top, max_by(o_orderkey, o_totalprice) AS order_key FROM orders GROUP BY o_custkey",
    "agg_proportion": "SELECT o_orderstatus, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderstatus",
    "agg_correlation": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem",
    "agg_spearman": "SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_custkey) AS b FROM customer)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_pivot": "SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o FROM orders GROUP BY o_custkey",
    "agg_most_frequent": "SELECT s, b, n FROM (SELECT p_size AS s, p_brand AS b, count(*) AS n, rank() OVER (PARTITION BY p_size ORDER BY count(*) DESC) AS r FROM part GROUP BY p_size, p_brand) WHERE r = 1",
    # Windows.
    "win_row_number": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
    "win_rank_top3": "SELECT s, b, n FROM (SELECT p_size AS s, p_brand AS b, count(*) AS n, rank() OVER (PARTITION BY p_size ORDER BY count(*) DESC) AS r FROM part GROUP BY p_size, p_brand) WHERE r <= 3",
    "win_dense_rank_id": "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS brand_id FROM (SELECT DISTINCT p_brand FROM part)",
    "win_ntile": "SELECT o_orderkey, ntile(100) OVER (ORDER BY o_totalprice, o_orderkey) AS bin FROM orders",
    "win_cume_dist": "SELECT c_custkey, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS share FROM customer",
    "win_lag_change": "SELECT y, n, n - lag(n) OVER (ORDER BY y) AS change, round(100e0 * (n - lag(n) OVER (ORDER BY y)) / lag(n) OVER (ORDER BY y), 6) AS change_pct FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)",
    "win_lead_default": "SELECT n_nationkey, lead(n_nationkey, 1, -1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next_key FROM nation",
    "win_cyclic_shift": "SELECT n_nationkey, coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), first_value(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS shifted FROM nation",
    "win_group_size": "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n >= 6",
    "win_min_max": "SELECT cited_1, cited_2, co_cited_year, max(frequency) OVER (PARTITION BY cited_1, cited_2) AS top, min(frequency) OVER (PARTITION BY cited_1, cited_2) AS low FROM sb_plus_complete_kinetics",
    "win_rank_average": "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100)) + (count(*) OVER (PARTITION BY c_nationkey, floor(c_acctbal / 100)) - 1) / 2 AS place FROM customer",
    "win_running_frame": "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM orders",
    # Sort, limit, sets.
    "set_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "set_offset": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 20",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT 'c' AS side, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier",
    "set_intersect": "SELECT sgr FROM scopus_publication_groups INTERSECT SELECT sgr FROM scopus_group_deletes",
    "set_except": "SELECT sgr FROM scopus_group_deletes EXCEPT SELECT sgr FROM scopus_publication_groups",
    "set_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS square FROM t",
    # Scalar functions.
    "fn_string": "SELECT p_partkey, substring(p_name, 2, 3) AS part, length(p_name) AS n, left(p_name, 2) AS head, lower(p_brand) AS brand, concat_ws('', p_brand, NULL, '-x') AS joined, rtrim(p_brand, '0123456789') AS bare FROM part",
    "fn_split_part": "SELECT appl_no, split_part(df_route, ';', 1) AS form, split_part(df_route, ';', 2) AS route FROM fda_products",
    "fn_regex_replace": "SELECT appl_no, regexp_replace(strength, '[^0-9.]', '', 'g') AS amount FROM fda_products",
    "fn_nullif": "SELECT nct_id, nullif(trim(phase), 'N/A') AS phase, coalesce(enrollment, '?') AS enrollment FROM ct_clinical_studies",
    "fn_date": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS later FROM orders",
    "fn_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS root, round(log10(l_extendedprice), 6) AS lg, CAST(floor(l_extendedprice) AS BIGINT) AS down, CAST(ceil(l_extendedprice) AS BIGINT) AS up, greatest(l_discount, l_tax) AS top FROM lineitem",
    "fn_hash_key": "SELECT doc_id, md5(text) AS text_key FROM documents",
    "fn_array": "SELECT vec_id, len(embedding) AS n, list_contains(list(label) OVER (PARTITION BY label), 3) AS has_three FROM embeddings",
    "fn_round_robin_year_range": "SELECT y.y AS year, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(1990, 2005)) AS y) y LEFT JOIN orders ON year(o_orderdate) = y.y GROUP BY y.y",
}

SPARK = {
    "join_semi": "SELECT o_orderkey FROM orders LEFT SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.09",
    "join_anti": "SELECT o_orderkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.05",
    "join_delete_using": "SELECT g.sgr, g.pub_year FROM scopus_publication_groups g LEFT ANTI JOIN scopus_group_deletes d ON g.sgr = d.sgr",
    "join_unnest": "SELECT vec_id, label, component FROM embeddings LATERAL VIEW explode(embedding) u AS component",
    "agg_string": "SELECT nct_id, listagg(DISTINCT last_name, '|') WITHIN GROUP (ORDER BY last_name) AS names FROM ct_overall_officials GROUP BY nct_id",
    "agg_array": "SELECT r_name, array_sort(collect_list(n_nationkey)) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "rel_regex": "SELECT appl_no, product_no FROM fda_products WHERE trade_name RLIKE '^[A-M].*[AEIOU]$'",
    "fn_string": "SELECT p_partkey, substring(p_name, 2, 3) AS part, length(p_name) AS n, left(p_name, 2) AS head, lower(p_brand) AS brand, concat_ws('', p_brand, NULL, '-x') AS joined, rtrim('0123456789', p_brand) AS bare FROM part",
    "fn_regex_replace": "SELECT appl_no, regexp_replace(strength, '[^0-9.]', '') AS amount FROM fda_products",
    "fn_array": "SELECT vec_id, size(embedding) AS n, array_contains(collect_list(label) OVER (PARTITION BY label), 3) AS has_three FROM embeddings",
    "fn_round_robin_year_range": "SELECT y.y AS year, count(o_orderkey) AS n FROM (SELECT explode(sequence(1990, 2005)) AS y) y LEFT JOIN orders ON year(o_orderdate) = y.y GROUP BY y.y",
}


def over_tables(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The text's result over the folder's tables, which stand before it as named subqueries over the files; views of the
    caller's are neither used nor replaced."""
    named = [f"{name} AS (SELECT * FROM parquet.`{folder}/{name}.parquet`)" for name in TABLES if re.search(rf"\b{name}\b", text)]
    return spark.sql(f"WITH {', '.join(named)} {text}" if named else text)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text = SPARK.get(name, SQL[name])

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return over_tables(spark, folder, text)

    run.__name__ = name
    return run


QUERIES = {name: _query(name) for name in SQL}
