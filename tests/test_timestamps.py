from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime, timedelta

import pytest

from citeloom.operators.timestamps import normalise_timestamps, zone_intervals

ZONES = ["US/Eastern", "Europe/Berlin", "Asia/Kolkata", "Africa/Casablanca", "Australia/Lord_Howe"]

CASES = {
    "2017": "2017", "Mar 2017": "2017-03", "10/2021": "2021-10", "2021-04": "2021-04", "marzo de 2017": "2017-03",
    "September 6, 1998.": "1998-09-06", "  May 8th, 1999": "1999-05-08", "Sunday, January 18, 2015": "2015-01-18", "APR 09 1981": "1981-04-09",
    "21 März 2022": "2022-03-21", "8 juillet 2021": "2021-07-08", "28 de diciembre de 2019": "2019-12-28", "9. Februar 2016": "2016-02-09", "1er août 2020": "2020-08-01",
    "29-JUL-2002": "2002-07-29", "5-Sep-08": "2008-09-05", "3-Apr-77": "1977-04-03", "20111218": "2011-12-18",
    "11/26/2002": "2002-11-26", "25/04/2020": "2020-04-25", "3/4/2010": "2010-03-04", "06.01.2012": "2012-01-06", "8/30/89": "1989-08-30", "5/6/29": "2029-05-06", "5/6/30": "1930-05-06",
    "Approved prior to Jan 1, 1982": "1982-01-01", "On the market before 1/1/1989": "1989-01-01", "March 17, 2018 ": "2018-03-17",
    "1611613800": "2021-01-25T22:30:00Z", "1395554315066": "2014-03-23T05:58:35Z",
    "2021-11-07T03:55:16Z": "2021-11-07T03:55:16Z", "2019-02-09T21:49:30+09:00": "2019-02-09T12:49:30Z", "2013-10-27T03:44:11.902262-0600": "2013-10-27T09:44:11Z",
    "2009-02-06 09:49:23 CEST": "2009-02-06T07:49:23Z", "2020-11-12 15:52:30 US/Eastern": "2020-11-12T20:52:30Z", "2020-07-01 12:00:00 Asia/Kolkata": "2020-07-01T06:30:00Z",
    "February 2, 2009 6:02 PM": "2009-02-02T23:02:00Z", "November 4, 2012 12:38 AM": "2012-11-04T04:38:00Z", "02/03/2018 14:40": "2018-02-03T19:40:00Z",
    "2019-11-03 01:26:00": "2019-11-03T05:26:00Z", "March 10, 2019 2:50 AM": "2019-03-10T07:50:00Z", "2020-03-29 02:12:46 Europe/Berlin": "2020-03-29T01:12:46Z",
    "February 30, 2012": None, "31.06.2014": None, "2013-13-05": None, "00/00/0000": None, "N/A": None, "NULL": None, "-": None, "": None, "   ": None, "see label": None, "2015-02-01 25:10:00": None,
    "2015-02-01 10:10:00 Nowhere/Land": None, "13:45": None, "x" * 5000: None, "13 2017": None, "1/1/2017 13:00 PM": None,
}


def test_forms(spark):
    df = spark.createDataFrame([(k, "zone", 1) for k in CASES] + [(None, "zone", 2)], "v string, norm_value string, `a.b` long")
    out = normalise_timestamps(df, "v", zones=ZONES)
    assert out.columns == ["v", "a.b", "norm_value", "norm_precision", "norm_status"]
    got = {r["v"]: r for r in out.collect()}
    assert {k: got[k]["norm_value"] for k in CASES} == CASES
    assert got[None]["norm_value"] is None and got[None]["a.b"] == 2
    assert (got["2019-11-03 01:26:00"]["norm_status"], got["March 10, 2019 2:50 AM"]["norm_status"], got["02/03/2018 14:40"]["norm_status"]) == ("ambiguous", "nonexistent", "unique")
    assert got["2017"]["norm_precision"] == "year" and got["20111218"]["norm_precision"] == "day" and got["2017"]["norm_status"] is None


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([("2017",)] * 3, "v string")
    assert normalise_timestamps(df, "v", zones=ZONES).count() == 3
    assert normalise_timestamps(df.limit(0), "v", zones=ZONES).count() == 0


@pytest.mark.parametrize("zone", ZONES)
def test_intervals_agree_with_the_zone_database(spark, zone):
    spans = [s for r in zone_intervals(spark, [zone]).collect() if 1990 <= r["year"] <= 2030 for s in r["spans"]]
    info, at = zoneinfo.ZoneInfo(zone), datetime(1991, 1, 1, tzinfo=UTC)
    for _ in range(900):
        local = at.astimezone(info)
        seconds, offset = int(local.replace(tzinfo=UTC).timestamp()), int(local.utcoffset().total_seconds())
        found = {s["offset"] for s in spans if s["first"] <= seconds < s["last"]}
        assert offset in found
        assert len(found) == len({int(local.replace(fold=f).utcoffset().total_seconds()) for f in (0, 1)})
        at += timedelta(days=14, hours=5, minutes=17)


def test_far_years_and_long_texts(spark):
    """Times outside the interval table's years, and dates in texts of any length."""
    cases = {
        "1899-05-01 10:00:00": "1899-05-01T15:00:00Z", "1700-01-01 00:00:00": "1700-01-01T04:56:02Z", "2150-07-01 10:00:00": "2150-07-01T14:00:00Z", "2150-01-05 10:00:00": "2150-01-05T15:00:00Z",
        "2100-12-31 23:30:00": "2101-01-01T04:30:00Z", "2400-02-29 12:00:00": "2400-02-29T17:00:00Z", "2150-05-01 10:10:00 Europe/Berlin": "2150-05-01T08:10:00Z", "2999-12-31 23:00:00": None,
        "approved " * 40 + "prior to Jan 1, 1982": "1982-01-01", "approved jan 1, 1982": None, "not later than 2 May 2010": "2010-05-02", " " * 300 + "2 May" + " " * 300 + "2010": "2010-05-02",
        "approved " * 20000: None, "a/" * 50000: None, "1" * 200000: None, "10:10 a/b" * 20000: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["norm_value"] for r in normalise_timestamps(df, "v", zones=ZONES).collect()}
    assert got == cases
