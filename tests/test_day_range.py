"""Ranges of days: the values of a few texts, and that a text is searched once for each part."""

from __future__ import annotations

from daybill.functions import dates


def test_ranges_of_texts(spark):
    texts = ["Nov. 14 - 16, 2026", "Sept 3 2026", "May 1 - 20, 2026", "May 9 - 3, 2026", "no day", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = [tuple(r.r) for r in df.orderBy("i").select(dates.listing_day_range("s").alias("r")).collect()]
    assert got[0] == ("2026-11-14", "2026-11-16", ["2026-11-14", "2026-11-15", "2026-11-16"], "days")
    assert got[1] == ("2026-09-03", "2026-09-03", ["2026-09-03"], "days")
    assert got[2] == ("2026-05-01", "2026-05-20", [], "range")
    assert got[3] == got[4] == got[5] == ("", "", [], "none")


def test_each_part_is_searched_once(spark):
    plan = spark.createDataFrame([("x",)], "s string").select(dates.listing_day_range("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Jan(?:uary)?") <= 8  # four parts, each tried and taken; 126 when parts were inlined
