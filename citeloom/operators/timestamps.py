"""Texts of mixed date forms, precisions and time zones, read into one unambiguous form."""

from __future__ import annotations

import zoneinfo
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import ship

# Month names and their usual short forms, without accents.
MONTHS = {
    1: "january jan janvier janv januar jan enero ene janner",
    2: "february feb fevrier fevr fev februar febrero febr",
    3: "march mar mars marz maerz mrz marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juin juni junio",
    7: "july jul juillet juil juli julio",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre setiembre set",
    10: "october oct octobre oktober okt octubre",
    11: "november nov novembre noviembre",
    12: "december dec decembre dezember dez diciembre dic",
}
# Zone abbreviations, in minutes east of Greenwich.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "hkt": 480, "sgt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "akst": -540, "akdt": -480, "hst": -600, "sast": 120, "cat": 120, "eat": 180, "wat": 60, "brt": -180, "art": -180,
}
DEFAULT_ZONE = "US/Eastern"
#: Years of the interval table. No zone changed its offset before the first of them, so earlier times find its first
#: interval, which has no beginning. After the last of them the rules of the calendar go on, so a later time is looked up
#: in the year of the last 28 that has the same calendar.
YEARS = (1840, 2101)

_ACCENTS = ("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
_MONTH = r"([a-z]+)\.?"
_TIME = r"(?:^|[ t])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)? ?(am|pm|a\.m\.|p\.m\.)? ?([+-]\d{2}:?\d{2}|[a-z]+(?:/[a-z_+\-0-9]+){0,2})?$"


def zone_intervals(spark: SparkSession, zones: Iterable[str] | None = None) -> DataFrame:
    """zone, year, spans: of each zone (lower case) and local year, the intervals with one offset that touch it.

    An interval (first, last, until, offset) covers the local seconds first <= t < last since 1970; until is the start
    of the next interval where that leaves a gap, else last; the first interval has no beginning. The intervals are
    exploded by year, so that a local time finds its candidates by equality. The size depends on the zone database only
    (some 600 zones x 260 years), not on the data.
    """
    ship(spark)
    names = sorted(zones if zones is not None else zoneinfo.available_timezones())

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        epoch = datetime(1970, 1, 1, tzinfo=UTC)
        for batch in batches:
            out = []
            for name in batch["zone"]:
                try:
                    zone = zoneinfo.ZoneInfo(name)
                except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
                    continue

                def offset(at: datetime, zone=zone) -> int:
                    return int(at.astimezone(zone).utcoffset().total_seconds())

                at, end, changes = datetime(YEARS[0], 1, 1, tzinfo=UTC), datetime(YEARS[1], 1, 1, tzinfo=UTC), []
                now = offset(at)
                begin = int((at - epoch).total_seconds())
                while at < end:
                    following = at + timedelta(days=14)  # no zone keeps an offset for less
                    then = offset(following)
                    if then != now:
                        low, high = at, following
                        while high - low > timedelta(seconds=1):
                            middle = low + timedelta(seconds=int((high - low).total_seconds()) // 2)
                            low, high = (middle, high) if offset(middle) == now else (low, middle)
                        change = int((high - epoch).total_seconds())
                        changes.append((begin, change, now))
                        begin, now = change, offset(high)
                        following = high
                    at = following
                changes.append((begin, int((end - epoch).total_seconds()), now))
                for i, (start, stop, shift) in enumerate(changes):
                    until = max(stop + shift, changes[i + 1][0] + changes[i + 1][2]) if i + 1 < len(changes) else stop + shift
                    out.append((name.lower(), start + shift if i else -(10**12), stop + shift, until, shift))
            yield pd.DataFrame(out, columns=["zone", "first", "last", "until", "offset"])

    flat = spark.createDataFrame([(n,) for n in names], "zone string").repartition(8).mapInPandas(build, "zone string, first long, last long, until long, offset long")

    def year(second: Column) -> Column:
        return F.year(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int")))

    years = flat.withColumn("year", F.explode(F.sequence(F.greatest(F.lit(YEARS[0]), year(F.greatest("first", F.lit(-5 * 10**9)))), year(F.col("until") - 1))))
    return years.groupBy("zone", "year").agg(F.array_sort(F.collect_list(F.struct("first", "last", "until", "offset"))).alias("spans"))


def normalise_timestamps(df: DataFrame, value: str, default_zone: str = DEFAULT_ZONE, out: str = "norm_value", precision: str = "norm_precision", status: str = "norm_status", zones: Iterable[str] | None = None) -> DataFrame:
    """df with out, precision and status added: what the text in value means.

    out: YYYY, YYYY-MM, YYYY-MM-DD, or for a text with a time of day the instant YYYY-MM-DDTHH:MM:SSZ; null for what is
    no date. precision: year, month, day, instant or null. status: of instants given in local time of a zone with a
    name, or without zone (default_zone then), one of unique, ambiguous (two instants have this local time; the earlier
    is taken) and nonexistent (skipped by a clock change; read with the offset before it); fixed for those with an
    offset or an abbreviation; null for dates.

    The local time meets the zone's offset intervals by zone and local year (zone_intervals, broadcast: bounded by the
    zone database): one matching interval gives the offset, two mean ambiguous, none nonexistent, for which the last
    interval before it counts.

    Null, empty and blank texts and texts that are no date, of any length, give null in all three; so do years outside
    1000 to 2999. Repeated rows stay repeated. Other columns are kept; out, precision and status replace columns of these names.
    """
    columns = [F.col(f"`{c}`") for c in df.columns if c not in (out, precision, status)]
    text = F.lower(F.regexp_replace(F.col(value).cast("string"), r"[\s   　]+", " "))
    text = F.translate(text, *_ACCENTS)
    text = F.trim(F.regexp_replace(F.trim(text), r"[ .;,]+$", ""))
    # Words before a bound are taken off one after the other (\\G), which costs no stack on long texts.
    bound = r"^(?:prior to|before|on or before|until|by|after|since|as of|from|not later than|no later than) "
    bare = F.regexp_replace(text, r"\G(?:approved|licensed|marketed|on the market|not(?! later)|available) ", "")
    text = F.when(bare.rlike(bound), F.regexp_replace(bare, bound, "")).otherwise(text)
    text = F.regexp_replace(text, r"^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? (?=\S)", "")
    frame = df.select(*columns, text.alias("__t"))
    clock = [F.regexp_extract("__t", _TIME, i) for i in range(6)]
    frame = frame.select(*columns, F.when(clock[0] == "", F.col("__t")).otherwise(F.trim(F.regexp_replace("__t", _TIME, ""))).alias("__d"), F.when(clock[0] != "", F.struct(*(c.alias(n) for c, n in zip(clock[1:], ("h", "m", "s", "half", "zone"), strict=True)))).alias("__c"))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract("__d", pattern, group)

    def fits(pattern: str) -> Column:
        return F.col("__d").rlike(pattern)

    names = F.create_map(*(F.lit(x) for month, words in MONTHS.items() for word in dict.fromkeys(words.split()) for x in (word, month)))

    def month_of(word: Column) -> Column:
        return F.try_element_at(names, F.when(word != "", word).otherwise(F.lit("?")))

    def full(year: Column) -> Column:
        n = year.try_cast("int")
        return F.when(F.length(year) == 2, F.when(n >= 30, n + 1900).otherwise(n + 2000)).otherwise(n)

    def ymd(year: Column, month: Column, day: Column | None) -> Column:
        return F.struct(full(year).alias("y"), month.cast("int").alias("m"), (day.try_cast("int") if day is not None else F.lit(None).cast("int")).alias("d"))

    def real(date: Column) -> Column:
        return F.try_to_date(F.format_string("%04d-%02d-%02d", date["y"], date["m"], date["d"]), "yyyy-MM-dd").isNotNull()

    iso, packed, year_month, month_year = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})-(\d{1,2})$", r"^(\d{1,2})[/.-](\d{4})$"
    slash, dots = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$", r"^(\d{1,2})[.-](\d{1,2})[.-](\d{4}|\d{2})$"
    name_day = rf"^{_MONTH}[ -](\d{{1,2}})(?:st|nd|rd|th)?(?:, ?| |-)(\d{{4}}|\d{{2}})$"
    day_name = rf"^(\d{{1,2}})(?:st|nd|rd|th|er|\.)?[ -](?:de )?{_MONTH},?(?: de | del | |-)(\d{{4}}|\d{{2}})$"
    name_year = rf"^{_MONTH},?(?: de | |-)(\d{{4}})$"
    year_name = rf"^(\d{{4}})[ -]{_MONTH}[ -](\d{{1,2}})$"
    month_first = ymd(part(slash, 3), part(slash, 1).try_cast("int"), part(slash, 2))
    day_first = ymd(part(slash, 3), part(slash, 2).try_cast("int"), part(slash, 1))
    date = (
        F.when(fits(iso), ymd(part(iso, 1), part(iso, 2).try_cast("int"), part(iso, 3)))
        .when(fits(packed), ymd(part(packed, 1), part(packed, 2).try_cast("int"), part(packed, 3)))
        .when(fits(slash), F.when(real(month_first), month_first).otherwise(day_first))
        .when(fits(dots), ymd(part(dots, 3), part(dots, 2).try_cast("int"), part(dots, 1)))
        .when(fits(name_day), ymd(part(name_day, 3), month_of(part(name_day, 1)), part(name_day, 2)))
        .when(fits(day_name), ymd(part(day_name, 3), month_of(part(day_name, 2)), part(day_name, 1)))
        .when(fits(year_name), ymd(part(year_name, 1), month_of(part(year_name, 2)), part(year_name, 3)))
    )
    coarse = (
        F.when(fits(year_month), ymd(part(year_month, 1), part(year_month, 2).try_cast("int"), None))
        .when(fits(month_year), ymd(part(month_year, 2), part(month_year, 1).try_cast("int"), None))
        .when(fits(name_year), ymd(part(name_year, 2), month_of(part(name_year, 1)), None))
    )
    year_only = F.when(F.col("__c").isNull() & fits(r"^[12]\d{3}$"), F.col("__d"))
    seconds = F.when(F.col("__c").isNull() & fits(r"^\d{10}$"), F.col("__d").try_cast("long")).when(F.col("__c").isNull() & fits(r"^\d{13}$"), F.floor(F.col("__d").try_cast("long") / 1000))
    frame = frame.select(*columns, "__c", date.alias("__date"), coarse.alias("__coarse"), year_only.alias("__year"), seconds.alias("__epoch"))

    c = F.col("__c")
    hour, minute, second = c["h"].try_cast("int"), c["m"].try_cast("int"), F.coalesce(c["s"].try_cast("int"), F.lit(0))
    afternoon, twelve = c["half"].startswith("p"), c["half"] != ""
    hour = F.when(twelve & ~hour.between(1, 12), F.lit(None)).when(twelve, hour % 12 + F.when(afternoon, 12).otherwise(0)).otherwise(hour)
    hour = F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), hour)
    day = F.when(F.col("__date").isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", F.col("__date.y"), F.col("__date.m"), F.col("__date.d")), "yyyy-MM-dd"))
    local = F.when(c.isNotNull(), F.unix_date(day).cast("long") * 86400 + hour * 3600 + minute * 60 + second)
    given = c["zone"]
    signed = F.regexp_extract(given, r"^([+-])(\d{2}):?(\d{2})$", 1)
    numeric = F.when(signed != "", (F.regexp_extract(given, r"(\d{2}):?(\d{2})$", 1).try_cast("int") * 3600 + F.regexp_extract(given, r"(\d{2}):?(\d{2})$", 2).try_cast("int") * 60) * F.when(signed == "-", -1).otherwise(1))
    short = F.try_element_at(F.create_map(*(F.lit(x) for name, m in ABBREVIATIONS.items() for x in (name, m * 60))), F.when(given != "", given).otherwise(F.lit("?")))
    frame = frame.select(*columns, "__coarse", "__year", "__epoch", day.alias("__day"), c.isNotNull().alias("__clock"), local.alias("__local"), F.coalesce(numeric, short).alias("__offset"), F.when(given == "", F.lit(default_zone.lower())).otherwise(given).alias("__zone"))
    the_year = F.year("__day")
    first_day = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    leap = lambda y: (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    alike = F.filter(F.sequence(F.lit(YEARS[1] - 29), F.lit(YEARS[1] - 2)), lambda y: (F.weekday(first_day(y)) == F.weekday(first_day(the_year))) & (leap(y) == leap(the_year)))
    looked = F.when(the_year >= YEARS[1] - 1, F.element_at(alike, 1)).otherwise(F.greatest(the_year, F.lit(YEARS[0])))
    frame = frame.withColumn("__zy", F.when(F.col("__clock") & F.col("__offset").isNull(), looked))
    # The local second as it would be in the year that is looked up; the same but for far later years.
    moved = F.when(the_year >= YEARS[1] - 1, F.col("__local") - F.datediff(first_day(the_year), first_day(F.col("__zy"))).cast("long") * 86400).otherwise(F.col("__local"))
    frame = frame.withColumn("__at", moved)

    spans = zone_intervals(df.sparkSession, zones).select(F.col("zone").alias("__zone2"), F.col("year").alias("__year2"), F.col("spans").alias("__spans"))
    frame = frame.join(F.broadcast(spans), (F.col("__zone") == F.col("__zone2")) & (F.col("__zy") == F.col("__year2")), "left")
    t = F.col("__local")
    at = F.col("__at")
    inside = F.filter("__spans", lambda s: (s["first"] <= at) & (at < s["last"]))
    before = F.filter("__spans", lambda s: (s["last"] <= at) & (at < s["until"]))
    frame = frame.withColumn("__inside", inside).withColumn("__before", before)
    instant = (
        F.when(F.col("__epoch").isNotNull(), F.col("__epoch"))
        .when(F.col("__offset").isNotNull(), t - F.col("__offset"))
        .when(F.size("__inside") > 0, F.array_min(F.transform("__inside", lambda s: t - s["offset"])))
        .when(F.size("__before") > 0, t - F.col("__before")[0]["offset"])
    )
    kind = (
        F.when(F.col("__epoch").isNotNull() | F.col("__offset").isNotNull(), "fixed")
        .when(F.size("__inside") > 1, "ambiguous")
        .when(F.size("__inside") == 1, "unique")
        .when(F.size("__before") > 0, "nonexistent")
    )
    frame = frame.withColumn("__instant", instant).withColumn("__kind", kind)
    whole, rest = F.floor(F.col("__instant") / 86400).cast("int"), F.pmod(F.col("__instant"), F.lit(86400))
    in_range = F.year(F.date_add(F.lit("1970-01-01").cast("date"), whole)).between(1000, 2999)
    utc = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), whole).cast("string"), F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60))
    month = F.col("__coarse")
    month_text = F.when(month["m"].between(1, 12) & month["y"].between(1000, 2999), F.format_string("%04d-%02d", month["y"], month["m"]))
    good_day = F.year("__day").between(1000, 2999)
    norm = (
        F.when(F.col("__instant").isNotNull() & in_range, utc)
        .when(F.col("__clock"), F.lit(None))
        .when(good_day, F.col("__day").cast("string"))
        .otherwise(F.coalesce(month_text, F.col("__year")))
    )
    fine = (
        F.when(F.col("__instant").isNotNull() & in_range, "instant").when(F.col("__clock"), F.lit(None)).when(good_day, "day").when(month_text.isNotNull(), "month").when(F.col("__year").isNotNull(), "year")
    )
    return frame.select(*columns, norm.alias(out), fine.alias(precision), F.when(F.col("__instant").isNotNull() & in_range, F.col("__kind")).alias(status))
