"""Aggregation by key over a tree of merges, for keys of which a few hold most rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN = 8
_CHUNK = "__tree_chunk"


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    states: dict[str, tuple[Column, Callable[[Column | str], Column]]],
    chunks: int,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Merge per-key states in rounds of fan_in, so that no reducer receives the partial states of all chunks.

    A chunk is a task's input: the size of a file split or of a shuffle partition, both fixed by the session. Within a
    chunk the states are combined locally (Spark's partial aggregation); a round then merges those of fan_in
    neighbouring chunks, and after ceil(log_fan_in(chunks)) rounds one state a key is left. A key that holds a third of
    all rows costs each reducer at most fan_in rows a round from the chunks below it.

    states: name -> (the row's own state, the associative and commutative aggregate that merges states). chunks: the
    number of partitions of df, or an upper bound of it. keys may be empty: the result is then one row, or none for an
    empty df. Null keys form a group of their own, as in GROUP BY.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    level = df.select(*keys, *(own.alias(name) for name, (own, _) in states.items()), F.spark_partition_id().alias(_CHUNK))
    left = max(1, chunks)
    while True:
        left = -(-left // fan_in)
        level = level.withColumn(_CHUNK, F.floor(F.col(_CHUNK) / fan_in).cast("int") if left > 1 else F.lit(0))
        level = level.groupBy(*keys, _CHUNK).agg(*(merge(name).alias(name) for name, (_, merge) in states.items()))
        if left == 1:
            return level.select(*keys, *states)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def input_chunks(df: DataFrame) -> int:
    """The number of tasks that read df, which each hold a chunk of its input."""
    return max(1, df.rdd.getNumPartitions())


def row_counts(df: DataFrame, key: str, fan_in: int = FAN_IN) -> DataFrame:
    """key, n_rows: the rows of each key, by the tree over the input's chunks; null keys form one group.

    A chunk is combined in the task that reads it, so of a hot key each chunk sends one row, and a reducer gets fan_in of
    them at most.
    """
    rows = df.select(F.col(key).alias("__k"))
    return tree_aggregate(rows, ["__k"], {"n_rows": (F.lit(1).cast("long"), F.sum)}, input_chunks(df), fan_in).withColumnRenamed("__k", key)


def member_counts(df: DataFrame, key: str, member: str, fan_in: int = FAN_IN) -> DataFrame:
    """key, n_members: the distinct non-null members of each key that has any.

    Members are made distinct by (key, member), which spreads a hot key over all partitions by the hash of its members;
    each is then in one chunk, so the chunks' numbers of members add up along the tree.
    """
    pairs = df.select(F.col(key).alias("__k"), F.col(member).alias("__m")).filter("__m is not null").distinct()
    return tree_aggregate(pairs, ["__k"], {"n_members": (F.lit(1).cast("long"), F.sum)}, shuffle_partitions(df), fan_in).withColumnRenamed("__k", key)


def group_counts(df: DataFrame, key: str, member: str, fan_in: int = FAN_IN) -> DataFrame:
    """key, n_rows, n_members: of each key the rows and the distinct non-null members (see row_counts, member_counts).

    Null keys form one group; rows with a null member count as rows only. Other columns of df are ignored, an empty df
    gives no rows.
    """
    rows, members = row_counts(df, key, fan_in), member_counts(df, key, member, fan_in).withColumnRenamed(key, "__key")
    joined = rows.join(members, rows[key].eqNullSafe(members["__key"]), "left")
    return joined.select(key, "n_rows", F.coalesce("n_members", F.lit(0).cast("long")).alias("n_members"))


def total_rows(groups: DataFrame, rows: str, fan_in: int = FAN_IN) -> DataFrame:
    """One row and column, the sum of rows over groups, by the same tree."""
    return tree_aggregate(groups, [], {"total": (F.col(rows).cast("long"), F.sum)}, shuffle_partitions(groups), fan_in)


def heavy_keys(df: DataFrame, key: str, share: float = 0.01, fan_in: int = FAN_IN) -> DataFrame:
    """key, n_rows of the non-null keys that hold at least share of the rows with a non-null key."""
    groups = row_counts(df.filter(F.col(key).isNotNull()), key, fan_in)
    return groups.filter(F.col("n_rows") >= total_rows(groups, "n_rows", fan_in).scalar() * F.lit(share))
