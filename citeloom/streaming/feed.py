"""The same operators over streams: citation feeds routed and merged by batch, windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from citeloom.operators.relational import upsert
from citeloom.session import ship


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, by, n: tumbling (or sliding) counts; rows later than the watermark are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def dedup_stream(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key, with state kept as long as the watermark allows."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_upserted(spark: SparkSession, target: str) -> DataFrame:
    """The table that upsert_stream keeps in target: of each bucket the version written last."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi").drop("bucket", "version")


def upsert_stream(stream: DataFrame, target: str, keys: list[str], seq: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Each micro-batch put into a Parquet table by key (see read_upserted).

    The table is cut into buckets by the keys' hash. A batch writes the buckets it touches only, under its own number, and
    the versions of these buckets before the last one are removed; a repeated batch writes the same files again.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", _bucket(keys, buckets))
        fs = spark._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        path = spark._jvm.org.apache.hadoop.fs.Path
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets` numbers
        versions = {}
        if fs.exists(path(target)):
            for status in fs.listStatus(path(target)):
                name = status.getPath().getName()
                if name.startswith("bucket=") and int(name[7:]) in touched:
                    versions[int(name[7:])] = sorted(int(v.getPath().getName()[8:]) for v in fs.listStatus(status.getPath()) if v.getPath().getName().startswith("version="))
        before = [f"{target}/bucket={b}/version={max(v for v in vs if v < number)}" for b, vs in versions.items() if any(v < number for v in vs)]
        base = spark.read.schema(batch.schema).parquet(*before) if before else batch.limit(0)
        out = upsert(base, batch, keys, seq).withColumn("bucket", _bucket(keys, buckets)).withColumn("version", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        for b, vs in versions.items():
            for v in [v for v in vs if v < number][:-1]:
                fs.delete(path(f"{target}/bucket={b}/version={v}"), True)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed(rows: DataFrame, key: str, columns: list[str], step, state: str, keep_ms: int | None) -> DataFrame:
    """rows routed by step(state, row) -> (state, route) within each key, in order of seq within a batch."""
    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("route", T.StringType())])

    def run(_, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else None
        rows = pd.concat(list(batches)).sort_values("__seq", kind="stable")
        routes = []
        for row in rows.to_dict("records"):
            now, route = step(now, row)
            routes.append(route)
        if now is not None:
            held.update(now)
            if keep_ms is not None:
                held.setTimeoutDuration(keep_ms)
        yield rows.assign(route=routes)[[*columns, "route"]]

    return rows.groupBy(key).applyInPandasWithState(run, schema, state, "append", "NoTimeout" if keep_ms is None else "ProcessingTimeTimeout")


def route_ids(stream: DataFrame, oci: str = "oci", citing: str = "citing", cited: str = "cited", date: str = "creation", seq: str = "seq", as_of: str = "2030-01-01", keep_ms: int | None = None) -> DataFrame:
    """stream with route: self, no_valid_dating, exact_repeat or duplicate as in triage_citations, null for rows that pass.

    The state of an oci is the data of its first row. keep_ms: how long it is kept without further rows; without it for
    ever. What passes goes on to route_pairs, as a query of its own.
    """
    ship(stream.sparkSession)
    a, b = F.lower(F.col(citing)), F.lower(F.col(cited))
    day = F.try_to_date(F.col(date), "yyyy-MM-dd")
    first = F.when(a == b, "self").when(day.isNull() | (day > F.lit(as_of).cast("date")), "no_valid_dating")
    data = F.concat_ws("|", a, b, F.col(date))
    rows = stream.withColumns({"__first": first, "__data": data, "__seq": F.col(seq), "__key": F.when(first.isNull(), F.col(oci).cast("string")).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(seq), F.lit(1024))))})

    def step(now, row):
        if row["__first"] is not None:
            return now, row["__first"]
        if now is None:
            return (row["__data"],), None
        return now, "exact_repeat" if now[0] == row["__data"] else "duplicate"

    return _keyed(rows, "__key", stream.columns, step, "data string", keep_ms)


def route_pairs(stream: DataFrame, citing: str = "citing", cited: str = "cited", seq: str = "seq", keep_ms: int | None = None) -> DataFrame:
    """Rows that passed route_ids, with route: main for the first of an unordered pair, then parallel or looping."""
    ship(stream.sparkSession)
    a, b = F.lower(F.col(citing)), F.lower(F.col(cited))
    columns = [c for c in stream.columns if c != "route"]
    rows = stream.select(*columns).withColumns({"__start": a, "__seq": F.col(seq), "__key": F.concat_ws("|", F.least(a, b), F.greatest(a, b))})

    def step(now, row):
        if now is None:
            return (row["__start"],), "main"
        return now, "parallel" if now[0] == row["__start"] else "looping"

    return _keyed(rows, "__key", columns, step, "start string", keep_ms)
