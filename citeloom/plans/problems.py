"""Queries of the general data problems, p1, p3, p4 and p5, over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.orphans import Side, orphan_references, orphan_report
from citeloom.operators.shred import FlatTable, Link, assemble_links, flat_tables, latest_rows, shred_levels
from citeloom.operators.timestamps import normalise_timestamps
from citeloom.operators.treeagg import group_counts, heavy_keys


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy_keys(table(spark, folder, "scopus_references"), "ref_sgr", 0.01).select("ref_sgr")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = group_counts(table(spark, folder, "scopus_references"), "ref_sgr", "scp")
    return groups.select("ref_sgr", F.col("n_rows").alias("n_references"), F.col("n_members").alias("n_citing"))


def _orphans(spark: SparkSession, folder: str, find: Callable[..., DataFrame]) -> DataFrame:
    parents = Side(table(spark, folder, "scopus_publication_groups"), "sgr", "last_updated_time")
    deletes = Side(table(spark, folder, "scopus_group_deletes"), "sgr", "delete_time")
    return find(table(spark, folder, "scopus_references"), "scp", "ref_sgr", "last_updated_time", parents, deletes, "scopus_publication_groups")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder, orphan_references).select("scp", "ref_sgr", "kind", "period")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder, orphan_report)


INTERVENTIONS, LABELS, INVESTIGATORS = "ct_interventions", "ct_intervention_arm_group_labels", "ct_location_investigators"


def _layout(root: str, key: str, intervention: str, name: str, label: str, location: str, facility: str, investigator: str) -> tuple[Link, ...]:
    """The links of a layout in which an intervention holds its labels."""
    return (
        Link(INTERVENTIONS, root, f"{root}.{key}", f"{root}.{intervention}", None, f"{root}.{intervention}.{name}"),
        Link(LABELS, root, f"{root}.{key}", f"{root}.{intervention}", f"{root}.{intervention}.{name}", f"{root}.{intervention}.{label}"),
        Link(INVESTIGATORS, root, f"{root}.{key}", f"{root}.{location}", f"{root}.{location}.{facility}", f"{root}.{location}.{investigator}"),
    )


def study_links() -> tuple[Link, ...]:
    """The layouts of the deliveries; in the third an arm group holds its interventions."""
    out: list[Link] = []
    for root in ("clinical_study", "batch.studies"):
        out += _layout(root, "id_info.nct_id", "intervention", "intervention_name", "arm_group_label", "location", "facility.name", "investigator.last_name")
    out += _layout("study", "protocol.identification.nct_id", "protocol.arms_interventions.interventions", "intervention_name", "arm_group_labels.arm_group_label", "protocol.contacts_locations.locations", "facility.name", "investigators.name.investigator_last_name")
    v3, arms = "clinical_study_v3", "clinical_study_v3.design.arm_groups"
    key = f"{v3}.nct_id"
    out += [
        Link(INTERVENTIONS, v3, key, f"{arms}.interventions", None, f"{arms}.interventions.intervention_name"),
        Link(INTERVENTIONS, v3, key, f"{v3}.design.unassigned_interventions", None, f"{v3}.design.unassigned_interventions.intervention_name"),
        Link(LABELS + "#held", v3, key, arms, f"{arms}.arm_group_label", f"{arms}.interventions.intervention_name"),
        Link(INVESTIGATORS, v3, key, f"{v3}.sites", f"{v3}.sites.facility.name", f"{v3}.sites.staff.investigators.last_name"),
    ]
    return tuple(out)


def _clean(c: Column) -> Column:
    text = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when((text != "") & (text != "NULL"), text)


def _study_rows(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "ct_study_records").select("record_id", "received_at", "payload")
    rows = latest_rows(assemble_links(shred_levels(records, "payload"), study_links(), ["record_id", "received_at"]), ["received_at", "record_id"])
    held = F.col("table").endswith("#held")
    parent, child = _clean(F.col("parent")), _clean(F.col("child"))
    return rows.select(
        F.col("key").alias("nct_id"),
        F.split_part("table", F.lit("#"), F.lit(1)).alias("child_table"),
        F.when(held, child).otherwise(parent).alias("parent"),
        F.when(held, parent).otherwise(child).alias("child"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("child_table")
    parent = F.when(kind == INTERVENTIONS, F.col("nct_id")).when(kind == INVESTIGATORS, F.coalesce("parent", F.lit(""))).otherwise(F.col("parent"))
    return _study_rows(spark, folder).select("nct_id", "child_table", parent.alias("parent_key"), F.col("child").alias("child_key")).filter("parent_key is not null and child_key is not null").distinct()


def study_tables() -> tuple[FlatTable, ...]:
    """The flat tables of all layouts of study_links(), a layout's number at the end: studies, arm groups, interventions with
    their labels, locations with their investigators. In the fourth an arm group holds its interventions, which link to it;
    those of no arm group are a table of their own, and the facility of a site and its staff are parts of the site's row."""
    out: list[FlatTable] = []

    def add(number: int, name: str, path: str, parent: str | None, value: str) -> None:
        out.append(FlatTable(f"{name}_{number}", path, parent, {"nct_id" if parent is None else "name": f"{path}.{value}" if value else path}))

    for number, root in ((1, "clinical_study"), (2, "batch.studies")):
        add(number, "studies", root, None, "id_info.nct_id")
        add(number, "arm_groups", f"{root}.arm_group", root, "arm_group_label")
        add(number, "interventions", f"{root}.intervention", root, "intervention_name")
        add(number, "labels", f"{root}.intervention.arm_group_label", f"{root}.intervention", "")
        add(number, "other_names", f"{root}.intervention.other_name", f"{root}.intervention", "")
        add(number, "locations", f"{root}.location", root, "facility.name")
        add(number, "investigators", f"{root}.location.investigator", f"{root}.location", "last_name")
    root, arms, places = "study", "study.protocol.arms_interventions", "study.protocol.contacts_locations.locations"
    add(3, "studies", root, None, "protocol.identification.nct_id")
    add(3, "arm_groups", f"{arms}.arm_groups", root, "arm_group_label")
    add(3, "interventions", f"{arms}.interventions", root, "intervention_name")
    add(3, "labels", f"{arms}.interventions.arm_group_labels", f"{arms}.interventions", "arm_group_label")
    add(3, "locations", places, root, "facility.name")
    add(3, "investigators", f"{places}.investigators", places, "name.investigator_last_name")
    root = "clinical_study_v3"
    add(4, "studies", root, None, "nct_id")
    add(4, "arm_groups", f"{root}.design.arm_groups", root, "arm_group_label")
    add(4, "interventions", f"{root}.design.arm_groups.interventions", f"{root}.design.arm_groups", "intervention_name")
    add(4, "unassigned_interventions", f"{root}.design.unassigned_interventions", root, "intervention_name")
    add(4, "locations", f"{root}.sites", root, "facility.name")
    add(4, "investigators", f"{root}.sites.staff.investigators", f"{root}.sites", "last_name")
    return tuple(out)


def p4_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of the flat tables of all readable deliveries under each other: table, record, row, parent row, name."""
    records = table(spark, folder, "ct_study_records").select("record_id", "payload")
    tables = flat_tables(shred_levels(records, "payload"), study_tables(), ["record_id"])
    out = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("table_name"), "record_id", "row_no", "parent_no", rows.columns[-1]).toDF("table_name", "record_id", "row_no", "parent_no", "name")
        out = part if out is None else out.unionByName(part)
    return out


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    studies, products, book = (table(spark, folder, n) for n in ("ct_clinical_studies", "fda_products", "fda_purple_book"))

    def values(df: DataFrame, src: str, key: Column, field: str) -> DataFrame:
        return df.select(F.lit(src).alias("src_table"), key.alias("row_key"), F.lit(field).alias("field"), F.col(field).alias("raw_value"))

    product = F.concat_ws("-", "appl_no", "product_no", "type")
    every = (
        values(studies, "ct_clinical_studies", F.col("nct_id"), "start_date")
        .unionByName(values(studies, "ct_clinical_studies", F.col("nct_id"), "completion_date"))
        .unionByName(values(products, "fda_products", product, "approval_date"))
        .unionByName(values(book, "fda_purple_book", F.col("bla_stn"), "date_of_licensure_m_d_y"))
    )
    return normalise_timestamps(every, "raw_value")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_values(spark, folder).filter("norm_value is not null").select("src_table", "row_key", "field", "norm_value").distinct()


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups, "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_tables": p4_tables, "p5_found": p5_found, "p5_values": p5_values}

_ORPHANS = """
WITH r AS (SELECT scp, ref_sgr, min(last_updated_time) AS at FROM scopus_references WHERE scp IS NOT NULL AND ref_sgr IS NOT NULL GROUP BY ALL),
g AS (SELECT sgr, min(last_updated_time) AS first_load, max(last_updated_time) AS last_load FROM scopus_publication_groups WHERE sgr IS NOT NULL GROUP BY sgr),
d AS (SELECT sgr, max(delete_time) AS deleted FROM scopus_group_deletes WHERE sgr IS NOT NULL GROUP BY sgr),
o AS (SELECT r.scp, r.ref_sgr, strftime(r.at, '%Y-%m') AS period,
 CASE WHEN g.sgr IS NULL AND d.sgr IS NULL THEN 'missing'
      WHEN d.sgr IS NOT NULL AND (g.sgr IS NULL OR d.deleted > g.last_load) THEN 'deleted'
      WHEN g.first_load > r.at THEN 'late' END AS kind
 FROM r LEFT JOIN g ON g.sgr = r.ref_sgr LEFT JOIN d ON d.sgr = r.ref_sgr)
"""

SQL = {
    "p1_found": "SELECT ref_sgr FROM scopus_references WHERE ref_sgr IS NOT NULL GROUP BY ref_sgr HAVING count(*) >= 0.01 * (SELECT count(ref_sgr) FROM scopus_references)",
    "p1_groups": "SELECT ref_sgr, count(*) AS n_references, count(DISTINCT scp) AS n_citing FROM scopus_references GROUP BY ref_sgr",
    "p3_found": _ORPHANS + "SELECT scp, ref_sgr, kind, period FROM o WHERE kind IS NOT NULL",
    "p3_report": _ORPHANS + "SELECT 'scopus_publication_groups' AS parent_table, kind, period, count(*) AS n_references FROM o WHERE kind IS NOT NULL GROUP BY ALL",
}
