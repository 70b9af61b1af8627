"""Links to a listing's own site, and the repair of summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from daybill.functions import summary
from daybill.operators import linked_pages, summaries

PAGE = "https://city.example.gov/events/kite"
HTML = """<p><a href="/inside">Kite Harvest Day</a><a href="https://www.facebook.com/kite">Kite Harvest Day</a><a class="b" href="https://kites.example.org/harvest-day">Learn more</a>
<a href='https://kites.example.org/harvest-day'>Harvest kite</a><a href="//tickets.example.com/x">Official website</a><a href="https://other.example.com/y">Parking</a><a href="mailto:a@b.c">Kite</a>
<a href="https://a.example.com/kite-1"><img src="x"></a><a href="https://b.example.com/kite">k</a><a href="https://c.example.com/kite">k</a><a href="https://d.example.com/kite">k</a></p>"""


def test_link_candidates(spark):
    pages = spark.createDataFrame([("p", HTML, "Annual Kite Harvest Festival", PAGE), ("none", "", "Kite", PAGE), ("null", None, None, None)], "page_id string, html string, title string, url string")
    got = [tuple(r) for r in linked_pages.link_candidates(pages).orderBy("page_id", "place").collect()]
    assert got == [
        ("p", "https://kites.example.org/harvest-day", 20, "Harvest kite", 1), ("p", "https://a.example.com/kite-1", 10, "a.example.com", 2), ("p", "https://b.example.com/kite", 10, "k", 3),
        ("p", "https://c.example.com/kite", 10, "k", 4), ("p", "https://d.example.com/kite", 10, "k", 5)]


def test_linked_details(spark):
    pages = spark.createDataFrame([("p", HTML, "Annual Kite Harvest Festival", PAGE)], "page_id string, html string, title string, url string")
    block = "<p>Build a kite with your family and fly it on the hill.</p><p>short</p><li>Back to top of this long page, please</li>"
    good, other = f"<nav><p>Menu entries of the whole site here</p></nav><main>{block}</main><h1>Kite Harvest 2026</h1>", f"<h1>Tax day</h1><main>{block}</main>"
    landed = spark.createDataFrame([("https://kites.example.org/harvest-day/", other), ("https://b.example.com/kite", good)], "url string, html string")
    assert [tuple(r) for r in linked_pages.linked_details(pages, landed).collect()] == [("p", "https://b.example.com/kite", "Build a kite with your family and fly it on the hill.")]


def test_lead_ins_and_professional_events(spark):
    long = "Kites fly. " * 60
    rows = spark.createDataFrame([("Build kites. Schedule: 10 am Location: Hall Tickets: $5",), ("Schedule: all day",), (long + "Agenda: x",), ("No headings here",)], "s string")
    got = [r.l for r in rows.select(summary.heading_lead_ins(F.col("s"), 520).alias("l")).collect()]
    assert got == [["Build kites.", "Build kites. Schedule: 10 am", "Build kites. Schedule: 10 am Location: Hall"], [], [], []]
    texts = [("Grand rounds for clinicians.", ""), ("CME credits for nurses; families are welcome.", ""), ("Healthcare professionals meet.", "Ages 5-12"), ("Build kites.", ""), ("Professional development for teachers.", "")]
    found = spark.createDataFrame(texts, "c string, a string").select(summary.is_professional_only(F.col("c"), F.col("a")).alias("p")).collect()
    assert [r.p for r in found] == [True, False, False, False, True]


def test_repair_uses_lead_ins_and_excludes(spark):
    lead = "Families build and paint paper kites together at this kite workshop"
    rows = spark.createDataFrame(
        [("lead", "Back to top", f"{lead} Schedule: " + "10 am start and then some more of it " * 30, "Kite day"), ("pro", "Back to top", "Grand rounds for physicians. Build kites.", "Rounds"), ("fine", "Families build kites and fly them at the park together.", "Kites.", "Kite day")],
        "id string, current string, source string, title string").withColumn("format", F.lit("program"))
    got = {r.id: r for r in summaries.repaired(rows, "id", "current", "source", "title", "format").collect()}
    assert (got["pro"].disposition, got["pro"].reason, got["pro"].replacement) == ("excluded", "professional_only", "")
    assert got["lead"].issues and (got["lead"].disposition, got["lead"].replacement) in (("repaired", lead), ("repaired", lead + "."))
