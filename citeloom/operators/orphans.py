"""References to records that are missing, were deleted, or arrived only later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import skew_join
from citeloom.session import materialise


@dataclass(frozen=True)
class Side:
    """A table with the names of its key and time columns."""

    df: DataFrame
    key: str
    time: str


def _long_form(children: DataFrame, child_id: str, child_key: str, arrival: str, parents: Side, deletes: Side, table: str) -> tuple[DataFrame, DataFrame]:
    """The distinct references (__id, __key, __at), written once, and the keys of the long form with what makes an orphan:
    parent_table, __key, n, first_load, months, kind.

    Parent rows, delete entries and the children's keys, counted by month beforehand, are laid under each other as tagged
    rows and grouped by parent table and key; a key is kept if its group lacks the parent's flag or its times contradict
    the children's. months is a key's number of references by month of arrival.
    """
    pairs = materialise(
        children.select(F.col(child_id).alias("__id"), F.col(child_key).alias("__key"), F.col(arrival).alias("__at"))
        .filter(F.col("__id").isNotNull() & F.col("__key").isNotNull())
        .groupBy("__id", "__key")
        .agg(F.min("__at").alias("__at"))
    )
    # By month before the keys meet: a hot key is one row a month and task, however many references it has.
    by_month = pairs.groupBy("__key", F.date_format("__at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("child"), F.min("__at").alias("arrived"))
    no_time, name = F.lit(None).cast("timestamp"), F.lit(table).alias("parent_table")

    def tagged(df: DataFrame, key: str, parent: int, child, loaded, deleted, arrived, period) -> DataFrame:
        return df.select(name, F.col(key).alias("__key"), F.lit(parent).alias("parent"), child.alias("child"), loaded.alias("loaded"), deleted.alias("deleted"), arrived.alias("arrived"), period.alias("period"))

    none, no_month = F.lit(None).cast("long"), F.lit(None).cast("string")
    rows = (
        tagged(parents.df, parents.key, 1, none, F.col(parents.time), no_time, no_time, no_month)
        .unionByName(tagged(deletes.df, deletes.key, 2, none, no_time, F.col(deletes.time), no_time, no_month))
        .unionByName(tagged(by_month, "__key", 0, F.col("child"), no_time, no_time, F.col("arrived"), F.col("period")))
    )
    keys = rows.filter("__key is not null").groupBy("parent_table", "__key").agg(
        F.bool_or(F.col("parent") == 1).alias("parent"),
        F.bool_or(F.col("parent") == 2).alias("entry"),
        F.sum("child").alias("n"),
        F.min("loaded").alias("first_load"),
        F.max("loaded").alias("last_load"),
        F.max("deleted").alias("deleted"),
        F.min("arrived").alias("arrived"),
        F.collect_list(F.when(F.col("child").isNotNull(), F.struct("period", "child"))).alias("months"),
    )
    state = (
        F.when(~F.col("parent") & ~F.col("entry"), "missing")
        .when(~F.col("parent") | (F.col("entry") & (F.col("deleted") > F.col("last_load"))), "deleted")
        .when(F.col("first_load") > F.col("arrived"), "late")
    )
    return pairs, keys.filter("n > 0").select("parent_table", "__key", "n", "first_load", "months", state.alias("kind")).filter("kind is not null")


def orphan_references(children: DataFrame, child_id: str, child_key: str, arrival: str, parents: Side, deletes: Side, table: str = "parent") -> DataFrame:
    """child_id, child_key, parent_table, kind, period: one row for each distinct reference that is an orphan.

    Only the keys that make orphans (see _long_form) meet the children again, the hot ones by broadcast (see skew_join), so
    a key that holds a third of all rows is never one task's work.

    Kinds, the first that applies: missing (neither parent nor delete entry), deleted (a delete entry, and no parent or
    one last loaded before the latest delete), late (the parent's first load is after the reference's arrival). The
    arrival is the earliest non-null time of the reference; period is its month (UTC session), null if there is none,
    and a reference without arrival is never late. References with a null id or key give no row. A null time of a
    parent is no time; the parent is still there. Repeated rows change nothing; empty tables are allowed.
    """
    pairs, verdicts = _long_form(children, child_id, child_key, arrival, parents, deletes, table)
    return _met(pairs, verdicts.drop("months")).select(F.col("__id").alias(child_id), F.col("__key").alias(child_key), "parent_table", "kind", F.date_format("__at", "yyyy-MM").alias("period"))


def _met(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    found = skew_join(pairs, verdicts, "__key", "n", pairs.agg(F.count(F.lit(1)).alias("n")))
    return found.filter((F.col("kind") != "late") | (F.col("first_load") > F.col("__at")))


def orphan_report(children: DataFrame, child_id: str, child_key: str, arrival: str, parents: Side, deletes: Side, table: str = "parent") -> DataFrame:
    """parent_table, kind, period, n_references: the orphans of orphan_references counted by table, kind and month.

    Missing and deleted parents make orphans of all their references, so these are summed from the long form and meet no
    reference again; only for late parents the references' own times are looked at.
    """
    pairs, verdicts = _long_form(children, child_id, child_key, arrival, parents, deletes, table)
    verdicts = materialise(verdicts)
    whole = verdicts.filter("kind <> 'late'").select("parent_table", "kind", F.explode("months").alias("m")).select("parent_table", "kind", "m.period", "m.child")
    late = _met(pairs, verdicts.filter("kind = 'late'").drop("months")).groupBy("parent_table", "kind", F.date_format("__at", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("child"))
    return whole.unionByName(late).groupBy("parent_table", "kind", "period").agg(F.sum("child").alias("n_references"))
