"""Joins on keys of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with at least this share of all rows are joined by broadcast. The shares of all keys sum to 1, so there are at
#: most 1 / HOT_SHARE of them, whatever the size of the data: that is the bound of what is broadcast.
HOT_SHARE = 1e-3


def skew_join(left: DataFrame, right: DataFrame, key: str, rows: str, total: DataFrame, how: str = "inner") -> DataFrame:
    """Join left with right, which has one row a key, without sending a hot key's rows to one task.

    rows: the column of right that holds the number of left's rows of the key (at least a lower bound whose sum over
    all keys does not exceed total). total: one row and column, the sum of these. Keys with HOT_SHARE of the total are
    joined by broadcast (never more than 1 / HOT_SHARE rows), all others by a shuffle, in which no key is hot any
    more. how: inner or left_semi. Null keys match nothing.
    """
    if how not in ("inner", "left_semi"):
        raise ValueError(f"no such join here: {how}")
    is_hot = F.col(rows) >= F.greatest(F.lit(1.0), total.scalar() * F.lit(HOT_SHARE))
    hot = F.broadcast(right.filter(is_hot))
    cold = right.filter(~is_hot)
    rest = left.join(F.broadcast(right.filter(is_hot).select(key)), key, "left_anti")
    return left.join(hot, key, how).unionByName(rest.join(cold, key, how))


#: Items of a block of pairs_within.
PAIR_BLOCK = 256


def pairs_within(df: DataFrame, keys: list[str], item: str, block: int = PAIR_BLOCK) -> DataFrame:
    """keys, item_1, item_2: all pairs of two items of one key, item_1 < item_2, each once for each key (rows of df distinct).

    The items of a key are cut into blocks of about `block` by their hash, and each two blocks make a piece of their own. So
    a key that holds a third of all rows is spread over as many tasks as it has pieces, and no task holds more than two
    blocks of it as arrays. Null keys and items pair with nothing.
    """
    rows = df.select(*keys, item).na.drop()
    key = F.xxhash64(*keys).alias("__key")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    sized = skew_join(rows.withColumn("__key", key), sizes, "__key", "__n", rows.agg(F.count(F.lit(1)).alias("n")))
    blocks = F.ceil(F.col("__n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.col(item)), blocks).cast("int")
    spread = sized.select(*keys, F.col(item).alias("__item"), own.alias("__own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("__other"))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    pieces = spread.groupBy(*keys, low.alias("__low"), high.alias("__high")).agg(
        F.collect_list(F.when(F.col("__own") == low, F.col("__item"))).alias("__first"), F.collect_list(F.when(F.col("__own") != low, F.col("__item"))).alias("__second")
    )
    whole = F.col("__low") == F.col("__high")
    sorted_pieces = pieces.select(*keys, whole.alias("__whole"), F.when(whole, F.array_sort("__first")).otherwise(F.col("__first")).alias("__first"), "__second")
    one = sorted_pieces.select(*keys, "__whole", "__first", "__second", F.posexplode("__first").alias("__at", "__x"))
    rest = F.when(F.col("__whole"), F.slice("__first", F.col("__at") + 2, F.size("__first") - F.col("__at") - 1)).otherwise(F.col("__second"))
    two = one.select(*keys, "__x", F.explode(rest).alias("__y"))
    return two.select(*keys, F.least("__x", "__y").alias("item_1"), F.greatest("__x", "__y").alias("item_2"))
