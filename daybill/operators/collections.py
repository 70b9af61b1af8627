"""Editorial collections and weekend editions: resolved references, life-cycle states, counts, spans, cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import leading_day, pacific_comparable
from ..functions.defaults import first_nonempty, text
from ..functions.regex import has
from .keep import top_n

DEFAULT_LAST_CHANCE = 2


def members(resolved: DataFrame, sessions: DataFrame, events: DataFrame, now: str) -> DataFrame:
    """``(slug, id, position, city, current, start, end)``: distinct resolved events of each collection.

    ``resolved``: ``slug, position, id``; ``sessions``: ``id, date_value, end_date_value`` (a listing without sessions is
    its own session). An event is current while any session is (end inclusive, else its whole start day).
    """
    first = top_n(resolved.filter("id IS NOT NULL"), ["slug", "id"], [F.col("position")], 1)
    end_text = text("end_date_value")
    closing = F.when(F.length(end_text) > 0, pacific_comparable(end_text, ~has(end_text, r"[T ]\d{2}:\d{2}"))).otherwise(
        F.when(F.length(leading_day("date_value")) > 0, F.concat(leading_day("date_value"), F.lit("T23:59:59"))).otherwise(F.lit(""))
    )
    wanted = sessions.join(first.select("id").distinct(), "id", "left_semi")
    live = (F.length(closing) > 0) & (closing >= now)
    spans = wanted.groupBy("id").agg(
        F.count_if(live).alias("current_sessions"),
        F.min(F.when(live, F.nullif(leading_day("date_value"), F.lit("")))).alias("start"),
        F.max(F.when(live, F.nullif(leading_day(first_nonempty("end_date_value", "date_value")), F.lit("")))).alias("end"),
    )
    return (
        first.join(spans, "id", "left").join(events.select("id", "city"), "id", "left")
        .select("slug", "id", "position", "city", (F.coalesce("current_sessions", F.lit(0)) > 0).alias("current"), "start", "end")
    )


def view_model(configs: DataFrame, resolved: DataFrame, member_rows: DataFrame, now: str) -> DataFrame:
    """State and counts of each collection.

    ``configs``: ``slug, published, publish_at, active_until, last_chance``; first match wins: draft, ended, data error,
    ended (nothing current), last chance, featured.
    """
    refs = resolved.groupBy("slug").agg(F.count("*").alias("selected"), F.count_if(F.col("id").isNull()).alias("unresolved"))
    counts = member_rows.groupBy("slug").agg(
        F.count("*").alias("resolved"), F.count_if("current").alias("current"), F.count_if(~F.col("current")).alias("expired"),
        F.min(F.when(F.col("current"), F.col("start"))).alias("span_start"), F.max(F.when(F.col("current"), F.col("end"))).alias("span_end"),
    )
    joined = configs.join(refs, "slug", "left").join(counts, "slug", "left")
    n = {k: F.coalesce(F.col(k), F.lit(0)) for k in ("selected", "unresolved", "resolved", "current", "expired")}
    until = pacific_comparable("active_until", ~has(text("active_until"), r"[T ]\d{2}:\d{2}"))
    start = pacific_comparable("publish_at")
    limit = F.coalesce("last_chance", F.lit(DEFAULT_LAST_CHANCE))
    state = (
        F.when(~F.coalesce("published", F.lit(True)) | (start > now), F.lit("DRAFT"))
        .when((until != "") & (until < now), F.lit("ENDED"))
        .when((n["selected"] == 0) | (n["resolved"] == 0), F.lit("DATA_ERROR"))
        .when(n["current"] == 0, F.lit("ENDED"))
        .when((n["expired"] > 0) & (n["resolved"] > limit) & (n["current"] <= limit), F.lit("LAST_CHANCE"))
        .otherwise(F.lit("FEATURED"))
    )
    return joined.select(
        "slug", state.alias("state"), *[v.alias(k) for k, v in n.items()], "span_start", "span_end",
    )


def cities_in_order(member_rows: DataFrame) -> DataFrame:
    """``(slug, city, first_start, first_position)`` of current members; sort by start, then position."""
    named = member_rows.filter(F.col("current") & (F.length(F.trim(text("city"))) > 0)).withColumn("city", F.trim("city"))
    slot = F.min(F.struct(F.coalesce("start", F.lit("9999-12-31")).alias("start"), "position")).alias("s")
    return named.groupBy("slug", "city").agg(slot).select("slug", "city", F.col("s.start").alias("first_start"), F.col("s.position").alias("first_position"))


def overlaps_weekend(date_value: Column, end_date_value: Column, ongoing: Column, any_session_inside: Column, friday: str, sunday: str) -> Column:
    start, end = leading_day(date_value), leading_day(first_nonempty(end_date_value, date_value))
    ranged = (F.length(start) > 0) & (F.length(end) > 0) & (start <= sunday) & (end >= friday)
    return F.coalesce(ongoing, F.lit(False)) | F.coalesce(any_session_inside, F.lit(False)) | ranged


def edition_state(picks: DataFrame, status: str, weekend_end: str, today: str) -> DataFrame:
    """One row with the state and counts of an edition. ``picks``: ``ref, id, in_weekend``."""
    totals = picks.agg(
        F.count("*").alias("picks"), F.count_if(F.col("id").isNull()).alias("unresolved"),
        F.count_if(F.col("id").isNotNull() & ~F.col("in_weekend")).alias("expired"),
        F.count_if(F.col("id").isNotNull() & F.col("in_weekend")).alias("valid"),
    )
    if status == "ended":
        state = F.lit("ended")
    elif status != "published":
        state = F.lit("draft")
    elif today > weekend_end:
        state = F.lit("ended")
    else:
        state = F.when((F.col("valid") == 0) & (F.col("picks") > 0), F.lit("data_error")).when(F.col("valid") > 0, F.lit("live")).otherwise(F.lit("coming_soon"))
    return totals.withColumn("state", state)
