"""What can a family do this weekend: candidates, scores, picks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, scoring, text, urls
from ..functions.defaults import text as txt
from ..functions.regex import has
from ..operators.diversify import pick_edition
from ..operators.keep import top_n
from .listings import Tables, listings


def weekend_outings(t: Tables, friday: str, per_city: int = 3) -> DataFrame:
    """The best ``per_city`` outings of each city on a weekend. The date filter reaches the scan."""
    sunday = (dt.date.fromisoformat(friday) + dt.timedelta(days=2)).isoformat()
    rows = listings(t, "title", "city", "date_value", "end_date_value", "day", "cost_status")
    inside = rows.filter(dates.overlaps("date_value", "end_date_value", F.lit(friday), F.lit(sunday)))
    kind = classify.type_of("title", "title")
    scored = inside.withColumn("type", kind).withColumn(
        "score",
        scoring.time_points("date_value", friday, F.lit(False))
        + F.when(F.col("type").isin("outdoor", "shows", "community"), 10).otherwise(0)
        + F.when(F.col("cost_status") == "free", 6).otherwise(0),
    )
    best = top_n(scored, ["city"], [F.col("score").desc(), F.col("date_value"), F.col("ord"), F.col("id")], per_city, "place")
    return best.select("city", F.col("place").cast("long").alias("place"), "id", "title", "type", "date_value", F.col("score").cast("long").alias("score"))


def candidates(rows: DataFrame, friday: str) -> DataFrame:
    """Listings good enough for a weekend edition.

    ``rows``: ``id, title, description, date_value, end_date_value, ongoing, url, link_status, age_label, type, zh_description,
    availability``.
    """
    sunday = (dt.date.fromisoformat(friday) + dt.timedelta(days=2)).isoformat()
    start, end = dates.day10("date_value"), dates.day10(F.coalesce(F.nullif("end_date_value", F.lit("")), F.col("date_value")))
    listing_page = has(urls.path("url"), r"(?:/events?|/schedule)/?$", False)
    link = F.col("link_status").isin("ok", "redirected") & F.startswith(txt("url"), F.lit("https://")) & ~listing_page
    description = text.squeeze("description")
    audience = F.concat_ws(" ", txt("title"), txt("age_label"), description)
    fitting = has(audience, scoring.WEEKEND_FAMILY) | has(audience, scoring.WEEKEND_FOCUS) | F.col("type").isin("sports", "arts")
    return rows.filter(
        link
        & ~has(txt("title"), scoring.WEEKEND_BANNED) & ~has(txt("title"), scoring.WEEKEND_POOR)
        & (F.length(start) > 0) & (start <= sunday) & (end >= friday) & ~F.coalesce("ongoing", F.lit(False))
        & ~has(txt("availability"), "cancelled|canceled|unavailable")
        & F.length(description).between(45, 1100) & fitting & (F.length(txt("zh_description")) > 0)
    )


def scored_candidates(rows: DataFrame, friday: str) -> DataFrame:
    month_before = (dt.date.fromisoformat(friday) - dt.timedelta(days=30)).isoformat()
    topic = classify.weekend_topic("title", "seasonal_theme", "type")
    return candidates(rows, friday).withColumn("topic", topic).withColumn(
        "score",
        scoring.weekend_points(
            "title", "description", "age_label", "cost_status", "link_status", "seasonal_theme", "date_value", F.col("topic"), friday, month_before
        ),
    )


def edition(rows: DataFrame, friday: str) -> DataFrame:
    """The picks of an edition in reading order, with labels and cut descriptions."""
    scored = scored_candidates(rows, friday)
    city = F.coalesce(F.nullif(txt("city"), F.lit("")), F.lit("elsewhere"))
    pool = scored.withColumn("source", F.coalesce(F.nullif(txt("source"), F.lit("")), txt("place"))).withColumn("city", city)
    picks = pick_edition(pool, [-F.col("score"), F.col("date_value"), F.col("id")])
    chosen = pool.join(picks.select("id"), "id")
    day = F.greatest(dates.day10("date_value"), F.lit(friday))
    label = lambda field: _label(F.col("topic"), field)
    return chosen.select(
        "id", "title", "url", day.alias("shown_day"), "date_value", "topic", label(1).alias("label"), label(2).alias("label_zh"),
        text.snip("description", 200).alias("why"), text.snip("zh_description", 150).alias("why_zh"), "score",
    ).orderBy("shown_day", "date_value", "title", "id")


def _label(topic: Column, field: int) -> Column:
    out = None
    for row in scoring.WEEKEND_LABELS:
        out = F.when(topic == row[0], F.lit(row[field])) if out is None else out.when(topic == row[0], F.lit(row[field]))
    return out.otherwise(F.lit(""))
