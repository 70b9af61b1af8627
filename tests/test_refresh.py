"""Two refreshes of a small catalog: feeds that fail, listings that vanish, curated rows, duplicates, pages, sessions, gates."""

from __future__ import annotations

import json

import pytest

from daybill.operators.gates import PublicationBlocked
from daybill.plans import refresh
from daybill.sources import partitioned, sinks

COLUMNS = ["id", "title", "source", "url", "date_value", "end_date_value", "place", "address", "city", "description", "image", "cost_status", "cost_label", "registration_status", "format", "type", "summary_status", "verification"]
TEXT = "Families make lanterns, listen to music, and join an evening community celebration."


def _listing(i, title, source, day, **more):
    site = source.split()[0].lower()
    return {"id": i, "title": title, "source": source, "url": f"https://{site}.example.org/events/{i}", "date_value": day, "place": "Plaza", "address": "100 Main Street", "city": "San Jose", "description": TEXT, "cost_status": "unknown",
            "registration_status": "unknown", "format": "program", "type": "community", "summary_status": "extractive", "verification": "rss"} | more


def _landed(spark, fresh, runs, pages=(), supplements=None):
    frame = lambda rows: spark.createDataFrame([tuple(r.get(c, "") for c in COLUMNS) + (n, r.get("replace_existing", False)) for n, r in enumerate(rows)], ", ".join(f"{c} string" for c in COLUMNS) + ", ord long, replace_existing boolean")
    sources = spark.createDataFrame([("North Library", "north.example.org", "rss"), ("South City", "south.example.org", "civic")], "source string, domain string, method string")
    page = spark.createDataFrame([(*p, "", "") for p in pages], "source string, url string, status int, html string, final_url string, domain string")
    return refresh.Landed(frame(fresh).drop("replace_existing"), spark.createDataFrame(runs, "source string, ok boolean"), sources, page, None if supplements is None else frame(supplements))


def _page(listing, body="", **node):
    html = f'<h1>{listing["title"]}</h1>{body}<script type="application/ld+json">{json.dumps({"@type": "Event", "name": listing["title"]} | node)}</script>'
    return (listing["source"], listing["url"], 200, html)


def test_two_refreshes(spark, tmp_path):
    root, north, south = str(tmp_path), "North Library", "South City"
    story = [_listing(f"s{i}", "Bilingual Storytime Circle", north, f"2026-10-0{i}T10:00", place="Branch") for i in (5, 6, 7)]
    kites = _listing("kites", "Kite Building Workshop", north, "2026-11-08T14:00")
    boats = _listing("boats", "Paper Boat Regatta", north, "2026-11-09T14:00", address="7 Lake Road", place="Lake")
    fair = _listing("fair", "Harvest Moon Lantern Fair", south, "2026-12-05T18:00")
    copy = _listing("copy", "Harvest Moon Lantern Fair Night", north, "2026-12-05T18:00", image="https://north.example.org/fair.jpg", cost_status="free", cost_label="Free")
    seed = _listing("seed", "Winter Puppet Parade", "Curated", "2026-12-12T11:00", address="9 Hill Street", place="Hill")
    both = [(north, True), (south, True)]
    first = _landed(spark, [*story, kites, boats, fair, copy], both, [_page(kites, image="/kites.jpg", offers={"price": "5"})], [seed])
    assert refresh.run(spark, first, root, "0001", "2026-10-01T09:00:00")["removed"] == 0
    rows = {r.id: r for r in partitioned.read_parts(spark, f"{root}/listings").collect()}
    merged = rows.keys() & {"fair", "copy"}
    assert rows.keys() == {"s5", "s6", "s7", "kites", "boats", "seed"} | merged and len(merged) == 1
    keeper = merged.pop()
    assert (rows[keeper].cost_status, rows[keeper].cost_label, rows[keeper].image) == ("free", "Free", "https://north.example.org/fair.jpg")
    assert (rows["kites"].image, rows["kites"].cost_status, rows["kites"].detail_status) == ("https://north.example.org/kites.jpg", "paid", "enriched")
    names = {r.alias: r.id for r in sinks.read_published(spark, f"{root}/aliases").collect()}
    assert names["fair"] == names["copy"] == keeper and names["s5"] == names["s6"] and names["s5"].startswith("series-") and names["kites"] == "kites"
    assert sinks.read_published(spark, f"{root}/sessions").filter("card_id like 'series-%'").count() == 3

    # Nothing new: no version. Then the south fails, the north drops kites (confirmed by its page) and boats (cancelled).
    same = _landed(spark, [*story, kites, boats, fair, copy], both, [_page(kites, image="/kites.jpg", offers={"price": "5"})], [seed])
    assert refresh.run(spark, same, root, "0002", "2026-10-01T09:00:00") == {"changed": 0, "removed": 0} and sinks.published_version(spark, f"{root}/listings") == "0001"
    pages = [_page(kites, image="/kites.jpg"), _page(boats, "<p>This event has been cancelled.</p>")]
    second = _landed(spark, [*story, copy], [(north, True), (south, False)], pages, [seed])
    refresh.run(spark, second, root, "0003", "2026-10-06T09:00:00")
    now = {r.id: r for r in partitioned.read_parts(spark, f"{root}/listings").collect()}
    assert "boats" not in now and "s5" not in now and now["kites"].refresh_status == "revalidated-missing" and {"s6", "s7", "seed", "kites"} < now.keys()
    assert now["kites"].image == "https://north.example.org/kites.jpg" and now["kites"].cost_status == "paid"
    assert names["copy"] == names["fair"] and len(now.keys() & {"fair", "copy"}) == 1
    untouched = partitioned.manifest(spark, f"{root}/listings")
    assert untouched["2026-11"] == "0003" and untouched["2026-10"] == "0003"

    with pytest.raises(PublicationBlocked):
        refresh.run(spark, _landed(spark, [*story], [(north, False), (south, False)]), root, "0004", "2026-10-06T10:00:00")
    lost = [_listing(f"x{i}", f"Odd Thing {i}", "Vast Source", "2020-01-01T10:00") for i in range(25)]
    with pytest.raises(PublicationBlocked, match="coverage:Vast Source"):
        refresh.run(spark, _landed(spark, [*story, copy, *lost, kites], [*both, ("Vast Source", True)], [], [seed]), root, "0005", "2026-10-06T10:00:00")
    assert sinks.published_version(spark, f"{root}/listings") == "0003" and {r.id for r in partitioned.read_parts(spark, f"{root}/listings").collect()} == now.keys()
