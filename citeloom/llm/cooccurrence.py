"""Items that appear together in one basket: counts of pairs, lift and conviction, by collapsing equal baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import skew_join
from citeloom.session import materialise

#: Distinct items of a block. Larger baskets are cut into blocks of about this size, and each pair of blocks becomes a
#: piece of its own, so no task ever holds more than two blocks of a basket.
BLOCK = 256


def distinct_memberships(df: DataFrame, basket: str, item: str) -> DataFrame:
    """__basket, __item: the distinct pairs without nulls, written once as all counts start from them."""
    return materialise(df.select(F.col(basket).alias("__basket"), F.col(item).alias("__item")).filter("__basket is not null and __item is not null").distinct())


def item_counts(memberships: DataFrame) -> DataFrame:
    """__item, __n: the number of baskets that hold each item."""
    return memberships.groupBy("__item").agg(F.count(F.lit(1)).alias("__n"))


def collapsed_baskets(memberships: DataFrame, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """by, __items, __split, __weight: the distinct baskets, each with the number of baskets that are equal to it.

    __items is the sorted item array of a basket or, for baskets of more than block items, of a piece of one: a block
    (__split 0), or two blocks laid one behind the other, of which the first has __split items. The pairs of a basket are
    those within its blocks and those between the two blocks of its double pieces, each once. by: columns of
    memberships that belong to the basket and keep equal baskets apart.
    """
    by = by or []
    sizes = memberships.groupBy("__basket").agg(F.count(F.lit(1)).alias("__size"))
    total = memberships.agg(F.count(F.lit(1)).alias("n"))
    sized = skew_join(memberships, sizes.withColumn("__blocks", F.ceil(F.col("__size") / block)), "__basket", "__size", total)
    own = F.pmod(F.xxhash64("__item"), F.col("__blocks")).cast("int")
    rows = sized.select("__basket", "__item", *by, own.alias("__own"), F.explode(F.sequence(F.lit(0), (F.col("__blocks") - 1).cast("int"))).alias("__other"))
    pieces = rows.groupBy("__basket", F.least("__own", "__other").alias("__low"), F.greatest("__own", "__other").alias("__high"), *by).agg(
        F.array_sort(F.collect_list(F.when(F.col("__own") == F.least("__own", "__other"), F.col("__item")))).alias("__first"),
        F.array_sort(F.collect_list(F.when(F.col("__own") != F.least("__own", "__other"), F.col("__item")))).alias("__second"),
    )
    # A double piece of which one block is empty has no pairs; its single pieces have them.
    whole = F.col("__low") == F.col("__high")
    split = F.when(whole, F.lit(0)).otherwise(F.size("__first"))
    return pieces.filter(whole | ((F.size("__first") > 0) & (F.size("__second") > 0))).select(*by, F.concat("__first", "__second").alias("__items"), split.alias("__split")).filter(F.size("__items") > 1).groupBy(*by, "__items", "__split").agg(F.count(F.lit(1)).alias("__weight"))


def basket_pairs(baskets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, item_1, item_2, n: how many baskets hold both items, item_1 < item_2."""
    by = by or []
    first = baskets.select(*by, "__items", "__split", "__weight", F.posexplode("__items").alias("__at", "__x")).filter((F.col("__split") == 0) | (F.col("__at") < F.col("__split")))
    start = F.when(F.col("__split") == 0, F.col("__at") + 2).otherwise(F.col("__split") + 1)
    rest = F.size("__items") - start + 1
    second = first.filter(rest > 0).select(*by, "__weight", "__x", F.explode(F.slice("__items", start, rest)).alias("__y"))
    return second.groupBy(*by, F.least("__x", "__y").alias("item_1"), F.greatest("__x", "__y").alias("item_2")).agg(F.sum("__weight").alias("n"))


def cooccurrences(members: DataFrame, min_count: int = 1, min_lift: float = 0.0, block: int = BLOCK) -> DataFrame:
    """item_1, item_2, n, n_1, n_2, n_baskets, lift, conviction_12, conviction_21 of all pairs with the given least n and lift.

    n baskets hold both items, n_1 and n_2 each; lift is n * n_baskets / (n_1 * n_2); conviction_12 is that of item_1 ->
    item_2, (1 - n_2 / n_baskets) / (1 - n / n_1), null where no basket has item_1 without item_2.

    members: the result of distinct_memberships, so repeated memberships count once, those with a null basket or item not
    at all. Items that can be in no result are left
    out before any pair is made, without loss: n is at most the smaller of n_1 and n_2, so both must reach min_count, and
    lift is at most n_baskets over the larger one. Equal baskets are collapsed and their pairs enumerated once. No
    members give no rows. Item types need an order and equality.
    """
    baskets = members.select("__basket").distinct().agg(F.count(F.lit(1)).alias("__all"))
    every = baskets.scalar()
    total = members.agg(F.count(F.lit(1)).alias("n"))
    counts = item_counts(members)
    useful = counts.filter((F.col("__n") >= min_count) & (F.col("__n") * F.lit(float(min_lift)) <= every))
    kept = materialise(skew_join(members, useful, "__item", "__n", total).select("__basket", "__item")) if min_count > 1 or min_lift > 0 else members
    pairs = basket_pairs(collapsed_baskets(kept, block=block)).filter(F.col("n") >= min_count)
    one = useful.select(F.col("__item").alias("item_1"), F.col("__n").alias("n_1"))
    two = useful.select(F.col("__item").alias("item_2"), F.col("__n").alias("n_2"))
    # An item of many baskets is in many pairs: the counts meet the pairs by skew_join, over the number of its pairs.
    pairs = materialise(pairs)
    all_pairs = pairs.agg(F.count(F.lit(1)).alias("n"))
    one, two = (side.join(pairs.groupBy(c).agg(F.count(F.lit(1)).alias(f"p_{c}")), c) for side, c in ((one, "item_1"), (two, "item_2")))
    scored = skew_join(skew_join(pairs, one, "item_1", "p_item_1", all_pairs), two, "item_2", "p_item_2", all_pairs).withColumn("n_baskets", every)
    lift = F.col("n") * F.col("n_baskets") / (F.col("n_1").cast("double") * F.col("n_2"))

    def conviction(left: str, right: str):
        return F.try_divide(1 - F.col(right) / F.col("n_baskets"), 1 - F.col("n") / F.col(left))

    return scored.withColumn("lift", lift).filter(F.col("lift") >= min_lift).select("item_1", "item_2", "n", "n_1", "n_2", "n_baskets", "lift", conviction("n_1", "n_2").alias("conviction_12"), conviction("n_2", "n_1").alias("conviction_21"))


def counts_by_group(members: DataFrame, groups: DataFrame, group_basket: str, group: str, wanted: DataFrame, block: int = BLOCK) -> DataFrame:
    """item_1, item_2, group, n: of the wanted pairs (item_1 < item_2), the baskets of each group that hold both.

    groups gives the group of a basket (rows with a null are ignored, repeated rows count once; a basket with several
    groups counts in each). Only items of a wanted pair are put into baskets.
    """
    items = wanted.select(F.explode(F.array("item_1", "item_2")).alias("__item")).distinct()
    counts = item_counts(members).join(items, "__item", "left_semi")
    kept = materialise(skew_join(members, counts, "__item", "__n", members.agg(F.count(F.lit(1)).alias("n"))).select("__basket", "__item"))
    baskets = groups.select(F.col(group_basket).alias("__basket"), F.col(group).alias("__group")).filter("__basket is not null and __group is not null").distinct()
    sizes = kept.groupBy("__basket").agg(F.count(F.lit(1)).alias("__size")).filter("__size > 1")
    grouped = materialise(skew_join(kept, sizes.join(baskets, "__basket"), "__basket", "__size", kept.agg(F.count(F.lit(1)).alias("n"))).select("__basket", "__item", "__group"))
    pairs = basket_pairs(collapsed_baskets(grouped, ["__group"], block), ["__group"])
    return pairs.join(wanted.select("item_1", "item_2").distinct(), ["item_1", "item_2"], "left_semi").select("item_1", "item_2", F.col("__group").alias(group), "n")
