"""Sources and sinks: delimited files, edge lists, JDBC, tables, graph exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeloom.operators.graph import adjacency_lists, relabel


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True, null: str = "", encoding: str = "UTF-8", force_not_null: list[str] | None = None, corrupt: str | None = None) -> DataFrame:
    """A delimited file with an explicit schema. force_not_null columns keep empty texts in place of nulls; with corrupt
    (a column of the schema) broken lines are kept there instead of failing."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", null).option("encoding", encoding).option("mode", "PERMISSIVE")
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    df = reader.csv(path)
    return df.na.fill("", force_not_null) if force_not_null else df


def read_columns(spark: SparkSession, path: str, columns: list[str], drop_chars: str = ",", encoding: str = "ISO-8859-1") -> DataFrame:
    """Some columns of a file with a header, as texts, without the given characters."""
    df = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)
    return df.select(*(F.translate(F.col(f"`{c}`"), drop_chars, "").alias(c) for c in columns))


def read_edges(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """An edge list without header: citing, cited."""
    return spark.read.schema("citing long, cited long").option("sep", sep).option("comment", "#").csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], partition: tuple[str, int, int, int] | None = None, fetch_size: int = 10_000) -> DataFrame:
    """A table or a "(SELECT ...) t" over JDBC. partition (column, low, high, number) reads in parallel ranges; without it
    one task reads all."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch_size).options(**properties)
    if partition:
        column, low, high, number = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", number)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], mode: str = "overwrite", partitions: int = 8) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", partitions).option("truncate", True).options(**properties).mode(mode).save()


def write_delimited(df: DataFrame, path: str, sep: str = ",", null: str = "NA", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("nullValue", null).option("header", header).csv(path)


def save_table(df: DataFrame, name: str, buckets: tuple[int, list[str]] | None = None, partition_by: list[str] | None = None) -> None:
    """A managed table; bucketed by the join key, later joins on it need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if buckets:
        writer = writer.bucketBy(buckets[0], *buckets[1]).sortBy(*buckets[1])
    writer.saveAsTable(name)


def replace_table(spark: SparkSession, name: str, change) -> None:
    """Read a table, change it and put the result in its place: written beside it first, then swapped by name."""
    new, old = f"{name}__new", f"{name}__old"
    spark.sql(f"DROP TABLE IF EXISTS {new}")
    save_table(change(spark.table(name)), new)
    spark.sql(f"DROP TABLE IF EXISTS {old}")
    spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    spark.sql(f"DROP TABLE {old}")


def materialized_view(spark: SparkSession, name: str, query: str) -> None:
    """The result of a query as a table that remembers the query (see refresh_view)."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    save_table(spark.sql(query), name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('view.query' = '{query.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}')")


def refresh_view(spark: SparkSession, name: str) -> None:
    """A table of materialized_view made anew from its query; readers see the old rows until the new ones are written."""
    query = spark.sql(f"SHOW TBLPROPERTIES {name} ('view.query')").first()["value"]
    replace_table(spark, name, lambda _: spark.sql(query))
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('view.query' = '{query.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}')")


def cached_view(df: DataFrame, name: str) -> DataFrame:
    """A temporary view whose rows are kept once computed."""
    df.cache().createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def export_graph(nodes: DataFrame, edges: DataFrame, folder: str, key: str = "node", label: str = "Publication", kind: str = "CITES") -> None:
    """Bulk-import files of a property graph: nodes with :ID and :LABEL, edges with :START_ID, :END_ID and :TYPE."""
    others = [c for c in nodes.columns if c != key]
    write_delimited(nodes.select(F.col(key).alias(f"{key}:ID"), *others, F.lit(label).alias(":LABEL")), f"{folder}/nodes", null="")
    write_delimited(edges.select(F.col("citing").alias(":START_ID"), F.col("cited").alias(":END_ID"), F.lit(kind).alias(":TYPE")), f"{folder}/edges", null="")


def export_metis(edges: DataFrame, folder: str) -> None:
    """A METIS file set: the body in order of the labels, and the mapping of labels to nodes."""
    labelled, mapping = relabel(edges)
    adjacency_lists(labelled).orderBy("label").select("neighbours").write.mode("overwrite").text(f"{folder}/body")
    write_delimited(mapping.orderBy("label"), f"{folder}/mapping", sep="\t", header=False)


def read_memberships(spark: SparkSession, path: str, threshold: float, sep: str = "\t") -> DataFrame:
    """node, cluster_no, p of a long membership file, above the threshold."""
    return spark.read.schema("node long, cluster_no long, p double").option("sep", sep).csv(path).filter(F.col("p") > threshold)


def write_memberships(memberships: DataFrame, path: str, sep: str = "\t") -> None:
    """node, cluster_no, p as a long file without header, the sparse form of a membership matrix: zeros are left out."""
    write_delimited(memberships.filter("p > 0").select("node", "cluster_no", "p"), path, sep=sep, header=False)


def membership_matrix(memberships: DataFrame) -> DataFrame:
    """node, memberships: of each node its clusters and shares, in order of the cluster: a row of the sparse matrix."""
    return memberships.filter("p > 0").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("cluster_no", "p"))).alias("memberships"))


def read_clustering(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """cluster_no, node from the usual layouts: pairs (cluster node, by a blank), ikc (node,cluster,...), lines (one cluster
    a line, numbered in order of its least node), labels (line number = node from 1, value = cluster; an empty
    line is a node without cluster)."""
    if kind == "pairs":
        return spark.read.schema("cluster_no long, node long").option("sep", " ").csv(path)
    if kind == "ikc":
        return spark.read.schema("node long, cluster_no long, k double, modularity double").csv(path).select("cluster_no", "node")
    lines = spark.read.text(path).filter("trim(value) <> ''")
    if kind == "lines":
        sets = lines.select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("long")).alias("nodes"))
        return sets.select(F.array_min("nodes").alias("cluster_no"), F.explode("nodes").alias("node"))
    if kind == "labels":
        # The place of a line: files in order of name, lines numbered within each file and shifted by the files before.
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
        sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        numbered = lines.withColumn("node", F.row_number().over(Window.partitionBy("file").orderBy("at"))).join(F.broadcast(before), "file")
        return numbered.filter("trim(value) <> ''").select(F.trim("value").cast("long").alias("cluster_no"), (F.col("node") + F.col("before")).cast("long").alias("node"))
    raise ValueError(f"unknown layout: {kind}")


def extract_dois(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, doi: the DOIs in a text column."""
    from citeloom.functions.scalars import dois

    return df.select(key, F.explode(dois(F.col(text))).alias("doi")).distinct()
