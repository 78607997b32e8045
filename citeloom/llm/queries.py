"""Queries of the training-data problems, p2 and p6 to p9, over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.cooccurrence import cooccurrences, counts_by_group, distinct_memberships
from citeloom.llm.leakage import leak_report, leaked_items
from citeloom.llm.names import link_names, linked_pairs
from citeloom.llm.spans import shared_share, shared_spans
from citeloom.llm.tokenizer import encode_documents


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_memberships(table(spark, folder, "scopus_references"), "scp", "ref_sgr")


def _pairs(members: DataFrame, min_count: int, min_lift: float) -> DataFrame:
    found = cooccurrences(members, min_count, min_lift)
    return found.withColumnsRenamed({"item_1": "cited_1", "item_2": "cited_2", "n_baskets": "n_records"})


def _scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(_members(spark, folder), 1, 0.0).select("cited_1", "cited_2", "n", "n_1", "n_2", "n_records", *(F.round(c, 6).alias(c) for c in ("lift", "conviction_12", "conviction_21")))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair that is cited together, with lift and conviction."""
    return _scored_pairs(spark, folder)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    members = _members(spark, folder)
    pairs = _pairs(members, 8, 12.0).select(F.lit("pair").alias("kind"), "cited_1", "cited_2", F.lit(0).alias("co_cited_year"))
    recorded = (
        table(spark, folder, "sb_plus_complete_kinetics")
        .select(F.least("cited_1", "cited_2").alias("item_1"), F.greatest("cited_1", "cited_2").alias("item_2"), F.col("cited_1").isNull() | F.col("cited_2").isNull() | F.col("co_cited_year").isNull() | F.col("frequency").isNull() | (F.col("cited_1") == F.col("cited_2")), F.col("co_cited_year").cast("int").alias("year"), "frequency")
        .toDF("item_1", "item_2", "void", "year", "frequency")
        .filter("not void")
        .groupBy("item_1", "item_2", "year")
        .agg(F.min("frequency").alias("low"), F.max("frequency").alias("high"))
    )
    groups = table(spark, folder, "scopus_publication_groups").select("sgr", F.col("pub_year").cast("int").alias("year"))
    counted = counts_by_group(members, groups, "sgr", "year", recorded)
    n = F.coalesce("n", F.lit(0))
    wrong = recorded.join(counted, ["item_1", "item_2", "year"], "left").filter((F.col("low") != n) | (F.col("high") != n))
    return pairs.unionByName(wrong.select(F.lit("frequency").alias("kind"), F.col("item_1").alias("cited_1"), F.col("item_2").alias("cited_2"), F.col("year").alias("co_cited_year")))


def p6_entities(spark: SparkSession, folder: str) -> DataFrame:
    return link_names(table(spark, folder, "ct_overall_officials"), "id", "first_name", "last_name", "affiliation")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_pairs(p6_entities(spark, folder), "id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "item_text")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(p8_found(spark, folder), "item_id", "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "documents"), "doc_id", "text", 200)


def p9_share(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return shared_share(documents, "doc_id", "text", shared_spans(documents, "doc_id", "text", 200))


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p6_found": p6_found, "p6_entities": p6_entities, "p7_ids": p7_ids, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_share": p9_share}

_PAIRS = """
WITH p AS (SELECT DISTINCT scp, ref_sgr FROM scopus_references WHERE scp IS NOT NULL AND ref_sgr IS NOT NULL),
i AS (SELECT ref_sgr, count(*) AS n FROM p GROUP BY ref_sgr),
t AS (SELECT count(DISTINCT scp) AS n_records FROM p),
c AS (SELECT a.ref_sgr AS cited_1, b.ref_sgr AS cited_2, count(*) AS n FROM p a JOIN p b ON a.scp = b.scp AND a.ref_sgr < b.ref_sgr GROUP BY ALL)
"""

#: All stretches of 200 characters of all texts; places that occur in several documents, joined to runs.
_SPANS = """
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200),
q AS (SELECT doc_id, md5(text) AS row, s, substring(text, s + 1, 200) AS piece FROM (SELECT doc_id, text, CAST(unnest(generate_series(0, length(text) - 200)) AS BIGINT) AS s FROM d)),
g AS (SELECT piece FROM q GROUP BY piece HAVING count(DISTINCT doc_id) > 1),
h AS (SELECT doc_id, row, s, lag(s) OVER (PARTITION BY doc_id, row ORDER BY s) AS before FROM q JOIN g USING (piece)),
i AS (SELECT *, count(CASE WHEN before IS NULL OR s - before > 200 THEN 1 END) OVER (PARTITION BY doc_id, row ORDER BY s) AS run FROM h),
sp AS (SELECT DISTINCT doc_id, span_start, span_end FROM (SELECT doc_id, CAST(min(s) AS INTEGER) AS span_start, CAST(max(s) + 200 AS INTEGER) AS span_end FROM i GROUP BY doc_id, row, run))
"""

SQL = {
    "p2_pairs": _PAIRS
    + """SELECT cited_1, cited_2, c.n, i.n AS n_1, j.n AS n_2, n_records, round(c.n::DOUBLE * n_records / (i.n::DOUBLE * j.n), 6) AS lift,
 CASE WHEN c.n = i.n THEN NULL ELSE round((1 - j.n::DOUBLE / n_records) / (1 - c.n::DOUBLE / i.n), 6) END AS conviction_12,
 CASE WHEN c.n = j.n THEN NULL ELSE round((1 - i.n::DOUBLE / n_records) / (1 - c.n::DOUBLE / j.n), 6) END AS conviction_21
FROM c JOIN i ON i.ref_sgr = cited_1 JOIN i j ON j.ref_sgr = cited_2, t""",
    "p2_found": _PAIRS
    + """, k AS (SELECT least(cited_1, cited_2) AS a, greatest(cited_1, cited_2) AS b, co_cited_year AS y, frequency AS f FROM sb_plus_complete_kinetics
 WHERE cited_1 <> cited_2 AND co_cited_year IS NOT NULL AND frequency IS NOT NULL),
g AS (SELECT DISTINCT sgr, pub_year FROM scopus_publication_groups WHERE pub_year IS NOT NULL),
w AS (SELECT DISTINCT a, b FROM k),
f AS (SELECT w.a, w.b, g.pub_year AS y, count(DISTINCT x.scp) AS n FROM w JOIN p x ON x.ref_sgr = w.a JOIN p z ON z.ref_sgr = w.b AND z.scp = x.scp JOIN g ON g.sgr = x.scp GROUP BY ALL)
SELECT 'pair' AS kind, cited_1, cited_2, 0 AS co_cited_year FROM c JOIN i ON i.ref_sgr = cited_1 JOIN i j ON j.ref_sgr = cited_2, t
 WHERE c.n >= 8 AND c.n::DOUBLE * n_records / (i.n::DOUBLE * j.n) >= 12
UNION ALL SELECT DISTINCT 'frequency', k.a, k.b, k.y FROM k LEFT JOIN f USING (a, b, y) WHERE k.f <> coalesce(f.n, 0)""",
    "p9_found": _SPANS + "SELECT doc_id, span_start, span_end FROM sp",
    "p9_share": _SPANS
    + """, k AS (SELECT doc_id, count(*) AS n, CAST(sum(span_end - span_start) AS BIGINT) AS c FROM sp GROUP BY doc_id)
SELECT d.doc_id, CAST(length(text) AS INTEGER) AS n_chars, coalesce(k.n, 0) AS n_spans, coalesce(k.c, 0) AS shared_chars, coalesce(k.c, 0) / nullif(length(text), 0)::DOUBLE AS shared_share FROM documents d LEFT JOIN k USING (doc_id)""",
}
