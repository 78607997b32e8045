"""XML documents read into nested rows once, and shredded into related tables by a declarative spec."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.relational import upsert


@dataclass(frozen=True)
class TableSpec:
    """An output table: the nested array path its rows come from ("" for the document; / between arrays within each other),
    its columns (name -> expression over the document's columns, the item r with its position pos from 1, and the item up
    around it with up_pos), its key, and aggregates for repeated keys."""

    path: str
    columns: dict[str, str]
    keys: tuple[str, ...] = ()
    aggregates: dict[str, str] = field(default_factory=dict)
    where: str | None = None


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Documents with an explicit schema; broken ones are dropped into _corrupt_record if the schema has that column."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").option("nullValue", "").schema(schema).load(path)


def parse_xml(df: DataFrame, column: str, schema: str, out: str = "doc") -> DataFrame:
    """df with a text column of XML parsed into a struct; null where it cannot be read."""
    return df.withColumn(out, F.from_xml(F.col(column), schema, {"mode": "PERMISSIVE"}))


def shred(documents: DataFrame, spec: dict[str, TableSpec], only: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of the spec (or only some of them) from nested documents.

    Each table explodes its array once, with the parents' columns still in scope; missing arrays give no row. With keys,
    repeated rows of a key become one, by the given aggregates (any value otherwise).
    """
    out: dict[str, DataFrame] = {}
    for name, t in spec.items():
        if only is not None and name not in only:
            continue
        rows = documents
        if t.path:
            steps = t.path.split("/")
            for i, step in enumerate(steps):
                source = step if i == 0 else f"r.{step}"
                rows = rows.select("*", F.posexplode(F.expr(source)).alias("__pos", "__r")).drop("up", "up_pos").withColumnsRenamed({"r": "up", "pos": "up_pos"}).withColumnsRenamed({"__pos": "pos", "__r": "r"}).withColumn("pos", F.col("pos") + 1)
        if t.where:
            rows = rows.filter(t.where)
        rows = rows.select(*(F.expr(e).alias(c) for c, e in t.columns.items()))
        if t.keys:
            rest = [c for c in t.columns if c not in t.keys]
            rows = rows.groupBy(*t.keys).agg(*(F.expr(f"{t.aggregates.get(c, 'max')}({c})").alias(c) for c in rest)) if rest else rows.distinct()
            rows = rows.dropna(subset=list(t.keys))
        out[name] = rows
    return out


def upsert_documents(tables: dict[str, DataFrame], documents: DataFrame, spec: dict[str, TableSpec]) -> dict[str, DataFrame]:
    """The tables of a spec with the rows of newly read documents put in by key, tables without a key with theirs added. A table
    that is not there yet begins with the new rows."""
    out: dict[str, DataFrame] = {}
    for name, rows in shred(documents, spec).items():
        base, keys = tables.get(name), list(spec[name].keys)
        out[name] = rows if base is None else upsert(base, rows, keys) if keys else base.unionByName(rows.select(*base.columns))
    return out
