"""Relational operators and load semantics: keys, upserts, existence, gap filling, sampling, ranges, paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import materialise


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (null keys are one group)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def dedup_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key with the highest seq: one aggregate with map-side combine instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*df.columns)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """base with delta's rows put in place by key, one row a key: of several delta rows of a key the last by seq wins, or,
    without seq, the greatest by its other columns in order."""
    rest = [c for c in base.columns if c not in keys]
    if seq:
        new = dedup_last(delta, keys, seq)
    else:
        best = delta.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")) if rest else delta.select(*keys).distinct()
        new = best.select(*keys, *(F.col(f"__r.{c}").alias(c) for c in rest))
    new = new.select(*base.columns)
    return base.join(new.select(*keys), keys, "left_anti").select(*base.columns).unionByName(new)


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """base and the delta rows whose key it lacks, one a key."""
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti").select(*base.columns))


def delete_by_ids(base: DataFrame, ids: DataFrame, key: str, deleted_at: Column) -> tuple[DataFrame, DataFrame]:
    """What is left, and the log of deleted keys with the time."""
    gone = ids.select(key).distinct()
    return base.join(gone, key, "left_anti"), base.join(gone, key, "left_semi").select(key).distinct().withColumn("deleted_time", deleted_at)


def expire_and_upsert(base: DataFrame, delta: DataFrame, keys: list[str], status: str = "status", expired: str = "expired", current: str = "current") -> DataFrame:
    """Rows of base that delta lacks are expired, the others replaced or added as current."""
    old = base.join(delta.select(*keys).distinct(), keys, "left_anti").withColumn(status, F.lit(expired))
    columns = [c for c in base.columns if c != status]
    return old.select(*columns, status).unionByName(delta.select(*columns).withColumn(status, F.lit(current)))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with name: the place of each row from 1 on in the order of the columns, which should decide ties.

    Rows are range-partitioned, counted within the partitions and shifted by the partitions' sizes, so no task sorts or
    numbers all of them; only one row a partition is broadcast.
    """
    spread = materialise(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = spread.withColumn(name, F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return within.join(F.broadcast(before), "__p").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__p", "__before")


def tiles(df: DataFrame, order: list[str], n: int, name: str) -> DataFrame:
    """df with name: the number of its bin of n bins of equal size in the order of the columns, as ntile gives it, without
    one task for all rows."""
    rows = numbered(df, order, "__i")
    total = df.agg(F.count(F.lit(1))).scalar()
    size, larger, at = F.floor(total / n), total % n, F.col("__i") - 1
    head = larger * (size + 1)
    bin_ = F.when(at < head, F.floor(at / (size + 1))).otherwise(larger + F.floor((at - head) / F.greatest(size, F.lit(1))))
    return rows.withColumn(name, (bin_ + 1).cast("int")).drop("__i")


def exists_flag(left: DataFrame, right: DataFrame, on: list[str], name: str) -> DataFrame:
    """left with a boolean: has right a row with these keys."""
    return left.join(right.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def fill_years(df: DataFrame, keys: list[str], year: str, start: Column, end: Column, zero: list[str]) -> DataFrame:
    """One row for each year from start to end of each key (aggregates over the key's rows), zero columns filled with 0."""
    frame = df.groupBy(*keys).agg(start.cast("int").alias("__a"), end.cast("int").alias("__b")).filter("__a <= __b")
    frame = frame.select(*keys, F.explode(F.sequence("__a", "__b")).alias(year))
    return frame.join(df, [*keys, year], "left").na.fill(0, zero)


def sample_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement, the same for the same seed: the least seeded hashes of the key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def explode_ids(df: DataFrame, owner: str, ids: str, prefix: str = "", sep: str = " ") -> DataFrame:
    """owner, id: the ids in one text of each row, apart by sep, once each; the owner gets the prefix. Null and empty texts
    give no row."""
    items = F.filter(F.split(F.col(ids), sep), lambda x: x != "")
    return df.filter(F.col(owner).isNotNull()).select(F.concat(F.lit(prefix), F.col(owner).cast("string")).alias(owner), F.explode(items).alias("id")).distinct()


def support_flags(df: DataFrame, key: str, grants: DataFrame, number: str, agency: str, flag: str, others: str) -> DataFrame:
    """df with two booleans: has the key a grant of the agency, and one of another. The agency is the 4th and 5th
    character of the grant's number. grants: key, number; one aggregation by key, no join by grant."""
    code = F.substring(number, 4, 2)
    known = grants.groupBy(key).agg(F.bool_or(code == agency).alias(flag), F.bool_or(code != agency).alias(others))
    return df.join(known, key, "left").na.fill(False, [flag, others])


def repair_ids(ids: Column, known: tuple[str, ...], prefix: str) -> Column:
    """Ids that do not begin with a known prefix get the given one; empty ids stay, null stays null."""
    return F.when((ids == "") | ids.rlike("^(?:" + "|".join(known) + ")"), ids).otherwise(F.concat(F.lit(prefix), ids))


def text_join(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """texts joined with the phrases of which they hold all words next to each other in order.

    Of each phrase the rarest word is looked up among the words of the texts (an equality join), and the whole phrase is
    then looked for in what is found. Case and marks do not count; phrases without a word match nothing.
    """
    def plain(c: str) -> Column:
        return F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    left = texts.withColumn("__id", F.monotonically_increasing_id()).withColumn("__t", plain(text))
    right = phrases.withColumn("__p", plain(phrase)).filter("size(__p) > 0")
    words = left.select("__id", F.explode(F.array_distinct("__t")).alias("__w"))
    counts = words.groupBy("__w").agg(F.count(F.lit(1)).alias("__n"))
    keyed = right.withColumn("__k", F.monotonically_increasing_id())
    rare = keyed.select("__k", F.explode(F.array_distinct("__p")).alias("__w")).join(counts, "__w", "left").groupBy("__k").agg(F.min_by("__w", F.struct(F.coalesce("__n", F.lit(0)), F.col("__w"))).alias("__w"))
    met = rare.join(words, "__w").select("__k", "__id")
    held = F.concat(F.lit(" "), F.array_join("__t", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join("__p", " "), F.lit(" ")))
    return met.join(keyed, "__k").join(left, "__id").filter(held).drop("__k", "__id", "__t", "__p")


def matched_control(pool: DataFrame, cases: DataFrame, key: str, factor: int, order: Column) -> DataFrame:
    """factor times as many rows of the pool as there are cases, none of them a case: the first in the given order, such as
    a seeded hash for a random draw; ties go by key."""
    rest = pool.join(cases.select(key), key, "left_anti").withColumn("__o", order)
    ranked = numbered(rest, ["__o", key], "__rn")
    return ranked.filter(F.col("__rn") <= cases.agg(F.count(F.lit(1)) * factor).scalar()).drop("__rn", "__o")


def find(df: DataFrame, filters: dict[str, object], sort_by: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Equality filters, a sort such as ["a desc", "b"], and a page. A filter value of None asks for null."""
    out = reduce(lambda d, kv: d.filter(F.col(kv[0]).isNull() if kv[1] is None else F.col(kv[0]) == F.lit(kv[1])), filters.items(), df)
    out = out.orderBy(*(F.col(s.split()[0]).desc_nulls_last() if s.lower().endswith(" desc") else F.col(s.split()[0]).asc_nulls_last() for s in sort_by))
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def range_join(left: DataFrame, right: DataFrame, value: str, low: Column, high: Column, keys: list[str] | None = None) -> DataFrame:
    """left with the right rows whose whole-number range low..high holds value: the range is exploded and joined by
    equality, which keeps the join hashable."""
    spread = right.withColumn("__v", F.explode(F.sequence(low, high)))
    on = reduce(lambda a, k: a & (left[k] == spread[k]), keys or [], left[value] == spread["__v"])
    joined = left.join(spread, on)
    for k in keys or []:
        joined = joined.drop(spread[k])
    return joined.drop("__v")


def _without_one(words: Column) -> Column:
    """The words, and each with one character left out."""

    def shorter(w: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.greatest(F.length(w) - i, F.lit(0)))))
        return F.when(F.length(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    return F.array_union(words, F.flatten(F.transform(words, shorter)))


def fuzzy_match(left: DataFrame, right: DataFrame, a: str, b: str, edits: int = 1) -> DataFrame:
    """a, b, distance: for each a the nearest b at most edits away, the first in order of equally near ones.

    Two texts within that distance are equal after at most edits characters are left out of each, so the candidates meet
    by equality of such remainders and nothing is compared with everything. Meant for short texts and 1 or 2 edits.
    """

    def spread(df: DataFrame, c: str) -> DataFrame:
        words = F.array(F.col(c))
        for _ in range(edits):
            words = _without_one(words)
        return df.filter(F.col(c).isNotNull()).select(c).distinct().withColumn("__w", F.explode(words))

    met = spread(left, a).join(spread(right, b), "__w").select(a, b).distinct()
    scored = met.withColumn("distance", F.levenshtein(a, b, edits)).filter("distance >= 0")
    return distinct_on(scored, [a], [F.col("distance"), F.col(b)])


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the value or values that come most often, all of them where several do."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("__m", F.max("n").over(Window.partitionBy(*keys))).filter("n = __m").drop("__m")


def pairwise_intersections(sets: DataFrame, name: str, element: str) -> DataFrame:
    """set_1, set_2, n: the number of common elements of each two sets that have any, set_1 <= set_2."""
    one, two = sets.select(F.col(name).alias("set_1"), element).distinct(), sets.select(F.col(name).alias("set_2"), element).distinct()
    return one.join(two, element).filter("set_1 <= set_2").groupBy("set_1", "set_2").agg(F.count(F.lit(1)).alias("n"))


def triage_citations(df: DataFrame, oci: str = "oci", citing: str = "citing", cited: str = "cited", date: str = "creation", seq: str = "seq", as_of: str = "2030-01-01") -> DataFrame:
    """df with route: where each citation of a feed goes, the first that applies.

    self (both ends equal in lower case), no_valid_dating (no full date, or one after as_of), exact_repeat (same oci and
    data as an earlier row), duplicate (an earlier row has the oci with other data), looping (the reverse pair came
    earlier), parallel (the same pair came earlier under another oci), main. Earlier is by seq among rows that pass the
    first two tests, so the first row of an unordered pair is main.
    """
    a, b = F.lower(F.col(citing)), F.lower(F.col(cited))
    valid_date = F.try_to_date(F.col(date), "yyyy-MM-dd")
    first = F.when(a == b, "self").when(valid_date.isNull() | (valid_date > F.lit(as_of).cast("date")), "no_valid_dating")
    data = F.struct(a.alias("a"), b.alias("b"), F.col(date).alias("d"))
    rows = df.withColumn("__first", first).withColumn("__data", data).withColumn("__ok", F.col("__first").isNull())
    by_oci = Window.partitionBy(oci, "__ok").orderBy(seq)
    rows = rows.withColumn("__head", F.first("__data").over(by_oci)).withColumn("__n", F.row_number().over(by_oci))
    repeat = F.when(F.col("__n") > 1, F.when(F.col("__head") == F.col("__data"), "exact_repeat").otherwise("duplicate"))
    rows = rows.withColumn("__second", F.coalesce("__first", repeat)).withColumn("__open", F.col("__second").isNull())
    pair = Window.partitionBy(F.least(a, b), F.greatest(a, b), "__open").orderBy(seq)
    rows = rows.withColumn("__start", F.first(a).over(pair)).withColumn("__k", F.row_number().over(pair))
    third = F.when(F.col("__k") == 1, "main").when(F.col("__start") == a, "parallel").otherwise("looping")
    return rows.select(*df.columns, F.coalesce("__second", third).alias("route"))
