"""Input and expected output of single functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from daybill.functions import audience, classify, commerce, dates, notices, summary, text, translation_qa, urls


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "value, label, low, high",
    [
        ("Ages 5 to 9", "Ages 5–9", 5, 9), ("ages three to five", "Ages 3–5", 3, 5), ("Kids (4-8) and teens (9-12)", "Ages 4–12", 4, 12), ("5 and under", "Ages 0–5", 0, 5),
        ("Ages 6+", "Ages 6+", 6, 18), ("Everyone, young and old", "All ages", 0, 18), ("Grades K-2", "Grades K–2", 5, 7), ("toddlers, tweens", "Ages 1–3 · Ages 10–13", 1, 13),
        ("Bring the whole family", "Family-friendly", None, None), ("Board meeting", "", None, None), ("Kids ages 3-5, teens", "Ages 3–5", 3, 5),
    ],
)
def test_age(spark, value, label, low, high):
    info = one(spark, audience.age_info(F.col("v")), v=value)
    assert (info["label"], info["age_min"], info["age_max"]) == (label, low, high)


@pytest.mark.parametrize(
    "cost, description, status, label, registration",
    [
        ("Free", "", "free", "免费", "unknown"), ("", "Tickets cost $5 to $12.", "paid", "$5–$12", "unknown"), ("", "A suggested donation of $5 helps. Free admission.", "donation", "建议捐赠", "unknown"),
        ("$8", "Registration is required.", "paid", "$8", "required"), ("", "No registration required. Drop-ins welcome!", "unknown", "费用未注明", "walk-in"),
        ("", "Parking fee $10.", "unknown", "费用未注明", "unknown"), ("Members $5, non-members $9", "", "variable", "会员／非会员价格见详情", "unknown"), ("From $15", "", "paid", "From $15", "unknown"),
    ],
)
def test_cost(spark, cost, description, status, label, registration):
    info = one(spark, commerce.cost_info(F.col("c"), F.col("d")), c=cost, d=description)
    assert (info["cost_status"], info["cost_label"], info["registration_status"]) == (status, label, registration)


@pytest.mark.parametrize(
    "title, kind",
    [
        ("Digital illustration for STEM week", "arts"), ("Robot design challenge", "learning"), ("LEGO free build", "play"), ("LEGO robotics class", "learning"), ("Toddler storytime", "play"),
        ("Bike tune and repair", "community"), ("Earthquakes vs. Galaxy", "sports"), ("Harvest festival", "community"), ("Yoga in the park", "workshops"), ("Chess club", "learning"),
    ],
)
def test_type(spark, title, kind):
    assert one(spark, classify.type_of(F.col("t"), F.col("t")), t=title) == kind


def test_boundaries_are_ascii(spark):
    from daybill.functions.regex import has

    assert one(spark, has(F.col("v"), r"\bt\b"), v="é t") is True
    assert one(spark, has(F.col("v"), r"\bt"), v="ét") is True  # é is not a word character


@pytest.mark.parametrize(
    "start, end, minutes, expected",
    [
        ("2026-10-31", "", 240, "2026-10-31T23:59:59"), ("2026-10-31T22:30", "", 210, "2026-11-01T02:00:00"), ("2026-10-31T10:00", "2026-11-01", 240, "2026-11-01T23:59:59"),
        ("2026-10-31T10:00", "2026-10-31T11:15", 240, "2026-10-31T11:15:00"), ("", "", 240, ""),
    ],
)
def test_effective_end(spark, start, end, minutes, expected):
    assert one(spark, dates.effective_end("s", "e", F.lit(minutes)), s=start, e=end) == expected


def test_expiry_differs_at_the_second(spark):
    now = "2026-10-31T11:15:00"
    assert one(spark, dates.is_active("e", now), e=now) is False
    assert one(spark, dates.is_current("s", "e", now), s="2026-10-31", e="2026-10-31T11:15") is True


def test_feed_windows():
    assert dates.feed_window("weekend", "2026-11-01") == ("2026-10-31", "2026-11-01")  # a Sunday belongs to its own weekend
    assert dates.feed_window("weekend", "2026-11-02") == ("2026-11-07", "2026-11-08")
    assert dates.feed_window("month", "2026-12-05") == ("2026-12-01", "2026-12-31")


def test_urls(spark):
    assert one(spark, urls.canonical_url("u"), u="http://X.com/a?utm_x=1&b=2#f") == "https://x.com/a?b=2"
    assert one(spark, urls.url_key("u"), u="https://www.x.com/a/?b=2&a=1&fbclid=z") == "https://x.com/a?a=1&b=2"
    assert one(spark, urls.canonical_url("u"), u="ftp://x.com/") == ""
    assert one(spark, urls.host_suffixes(F.col("h")), h="a.b.c") == ["a.b.c", "b.c", "c"]


def test_entities_and_folding(spark):
    assert one(spark, text.plain_text("v"), v="<p>Caf&eacute;&#233; &amp; <b>tea</b> , now</p>") == "Caf&eacute;é & tea, now"
    assert one(spark, text.edition_title_key("v"), v="12th Annual Día de Muertos & Fair 2026") == "dia de muertos and fair"


def test_notices(spark):
    assert one(spark, notices.is_support_service("t", F.lit("")), t="Reading buddies with furry friends") is False
    assert one(spark, notices.is_support_service("t", F.lit("")), t="One-on-one tech help") is True
    assert one(spark, notices.is_routine_access("t"), t="Museum open during the fair") is True
    assert one(spark, notices.is_routine_access("t"), t="Museum open house") is False


def test_summary_sentences(spark):
    value = "Meet Dr. Jones at the lab. Build a rocket with your kids. Parking is free."
    assert one(spark, summary.merged_sentences(F.col("v")), v=value) == ["Meet Dr. Jones at the lab.", "Build a rocket with your kids.", "Parking is free."]


def test_translation_audit(spark):
    issues = one(spark, translation_qa.audit_issues("t", "d", "zt", "zd"), t="Ages 5", d="Tickets $8", zt="免费 5 岁", zd="票价 $9")
    assert issues == ["numeric-facts-changed:$8,5=>$9,5", "unsupported-claim:free"]


def test_catalog_files(spark, tmp_path):
    import json

    from daybill.operators.catalog import catalog_winner
    from daybill.sources import catalogs

    entry = lambda id, title, override=False: {"id": id, "title": title, "status": "approved", "override": override}
    files = {
        "translations.zh.automation.json": [entry("a", "auto", True)], "translations.zh.b.json": [entry("a", "b"), entry("c", "first")],
        "translations.zh.z.json": [entry("c", "second")], "translations.zh.manifest.json": [entry("m", "never")],
    }
    for name, rows in files.items():
        (tmp_path / name).write_text(json.dumps({"version": 1, "entries": rows}))
    won = catalog_winner(catalogs.read_catalogs(spark, str(tmp_path)), ["late", "file_name", "pos"])
    assert {r["id"]: (r["title"], r["conflicts"]) for r in won.collect()} == {"a": ("auto", 0), "c": ("first", 1)}


def test_publish_and_read(spark, tmp_path):
    from daybill.sources.sinks import publish_table, read_published

    publish_table(spark.range(3), str(tmp_path / "t"), "0001")
    publish_table(spark.range(5), str(tmp_path / "t"), "0002")
    assert read_published(spark, str(tmp_path / "t")).count() == 5
