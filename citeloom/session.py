"""Session helpers: a local session for tests, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citeloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the session names in spark.checkpoint.dir. Where that is unset it is one of
    our own on one machine (tests), and an error on a cluster, whose executors could not read each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "citeloom-shared")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python workers can import it wherever the
    driver was started. It is some 100 KB of source."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="citeloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = list(sys.path)
    context.addPyFile(str(target))
    sys.path[:] = path  # the driver has the package itself
    _shipped.add(context.applicationId)


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/citeloom-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back.

    It is for what is used more than once: the rows are computed once, survive the loss of any executor, and the plans
    built on them start at a scan. Tables are compressed and removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Remove the table that materialise wrote for df, of which nothing is to be read any more."""
    path = getattr(df, "_written_at", None)
    if path is not None:
        _remove(df.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]


def replaced(new: DataFrame, *old: DataFrame) -> DataFrame:
    """new materialised, and the tables it replaces removed: the step of a loop, which so holds one table at a time."""
    out = materialise(new)
    for df in old:
        discard(df)
    return out


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; its folder goes with the cluster
            return
