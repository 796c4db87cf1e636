"""Dates in the forms that commits and advisories use, held against pandas."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import text as T

DATES = [
    "2015-06-07T00:00Z", "2015-06-07T23:30+02:00", "2015-06-07 01:02:03 +0300", "2015/6/7", "2015/06/07 8:09", "6/7/2015", "06/07/2015 23:59:58", "25/12/2015", "7 Jun 2015", "7 June 2015", "Jun 7, 2015", "June 7, 2015 3:04",
    "Sun, 7 Jun 2015 23:30:00 -0500", "Sun Jun 7 23:30:00 2015 -0500", "Sun Jun  7 23:30:00 2015", "20150607", "20150607T010203", "2015-06-07", "2015-06-07 01:02:03.123456+00:00", "soon", "2015-02-30", "", "None", "1989-01-01", "2031-01-01", " 2015-01-02 ",
]


def test_dates_are_those_of_pandas(spark):
    got = {}
    year, day = T.year_and_date(F.col("t"))
    for r in spark.createDataFrame([(d,) for d in DATES], "t string").select("t", year.alias("year"), day.alias("day")).collect():
        got[r["t"]] = (r["year"], r["day"])
    for d in DATES:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            at = pd.to_datetime(d.strip(), errors="coerce", utc=True) if d.strip().lower() not in ("", "none") else pd.NaT
        expected = (None, None) if pd.isna(at) or not 1990 <= at.year <= 2030 else (at.year, at.strftime("%Y-%m-%d"))
        assert got[d] == expected, d
    assert sum(v[0] is not None for v in got.values()) >= 20
