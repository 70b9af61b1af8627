"""Publication: staged gates with per-source counts, source health, coverage, retention, public columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dates import explicit_page_day, leading_day
from ..functions.defaults import key_of, text
from ..functions.regex import has
from ..functions.text import plain_text, same_identity, tokens
from .keep import top_n

# Internal fields that readers never receive.
INTERNAL_FIELDS = [
    "source_description_raw", "source_description_hash", "summary_status", "summary_version", "summary_verified_at", "summary_method",
    "summary_quality", "summary_evidence", "summary_evidence_data", "field_provenance", "canonical_detail", "image_provenance",
    "image_failure_reason", "refresh_status", "refresh_error_at", "refresh_verified_at", "link_status", "link_checked_at",
    "link_http_status", "link_source", "canonical_url", "audience_status",
]
# Alert after this many failed runs; a large feed that publishes nothing is a loss.
ALERT_STREAK, LARGE_FEED = 3, 20


def public_columns(df: DataFrame) -> DataFrame:
    return df.drop(*INTERNAL_FIELDS)


def with_stages(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """``passed``: how many stages in a row each listing survives. One projection, no pass per stage."""
    alive, passed = F.lit(True), F.lit(0)
    for _, condition in stages:
        alive = alive & F.coalesce(condition, F.lit(False))
        passed = passed + alive.cast("int")
    return df.withColumn("passed", passed)


def funnel(df: DataFrame, stages: list[tuple[str, Column]], source: str = "source") -> DataFrame:
    """``(stage_no, stage, source, before, after)`` from a single aggregation."""
    named = F.when(F.length(text(source)) > 0, F.col(source)).otherwise(F.lit("unknown"))
    staged = with_stages(df, stages).groupBy(named.alias("source")).agg(
        *[F.sum((F.col("passed") >= i).cast("long")).alias(f"s{i}") for i in range(len(stages) + 1)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("before"), F.col(f"s{i + 1}").alias("after"))
            for i, (name, _) in enumerate(stages)
        ]
    )
    return staged.select("source", F.explode(rows).alias("r")).select("r.stage_no", "r.stage", "source", "r.before", "r.after")


def failure_streaks(runs: DataFrame, source: str, order: list[str], ok: Column) -> DataFrame:
    """Current run of consecutive failures per source, without a window over a (possibly hot) source.

    The streak is the number of runs after the last good one: one aggregation for the last good run, then a count.
    """
    slot = F.struct(*order)
    last = runs.groupBy(source).agg(F.max(F.when(ok, slot)).alias("_good"), F.max(slot).alias("_latest"), F.count("*").alias("runs"))
    tail = runs.join(last.select(source, "_good"), source).filter(F.col("_good").isNull() | (slot > F.col("_good")))
    streak = tail.groupBy(source).agg(F.count("*").alias("failure_streak"))
    return last.join(streak, source, "left").select(
        source, "runs", F.coalesce("failure_streak", F.lit(0)).alias("failure_streak"),
        F.when(F.coalesce("failure_streak", F.lit(0)) > 0, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
    )


def source_health(sources: DataFrame, results: DataFrame, previous: DataFrame) -> DataFrame:
    """Registry ⟕ this run ⟕ previous health. ``results``: ``key, ok, event_count, error``; ``previous``: ``key, failure_streak``."""
    joined = sources.join(results, "key", "left").join(previous.withColumnRenamed("failure_streak", "_before"), "key", "left")
    ran, failed = F.col("ok").isNotNull(), ~F.col("ok")
    before = F.coalesce("_before", F.lit(0))
    return joined.select(
        "key", "name",
        F.when(~ran, F.lit("not-run")).when(failed, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        F.when(ran, F.when(failed, 0).otherwise(F.col("event_count"))).cast("long").alias("event_count"),
        F.when(~ran, before).when(failed, before + 1).otherwise(0).cast("long").alias("failure_streak"),
        F.when(ran & failed, text("error")).otherwise(F.lit("")).alias("error"),
    )


def health_alerts(health: DataFrame) -> DataFrame:
    return health.filter((F.col("status") == "failed") & (F.col("failure_streak") >= ALERT_STREAK)).select("name", "failure_streak", "error")


def refresh_counts(results: DataFrame) -> DataFrame:
    """Fetched rows per source, -1 for a failed run."""
    return results.select("key", F.when(F.col("ok"), F.col("event_count")).otherwise(-1).cast("long").alias("fetched"))


def lost_sources(fetched: DataFrame, published: DataFrame) -> DataFrame:
    """Large feeds without a single published listing. ``fetched``: ``source, fetched``; ``published``: ``source, published``."""
    joined = fetched.join(published, "source", "left")
    return joined.filter((F.col("fetched") >= LARGE_FEED) & (F.coalesce("published", F.lit(0)) == 0)).select("source", "fetched")


def retained(previous: DataFrame, failed_sources: DataFrame, active: Column) -> DataFrame:
    """Still active listings of sources whose refresh failed."""
    kept = previous.filter(active).join(failed_sources.select("source").distinct(), "source", "left_semi")
    return kept.withColumn("refresh_status", F.lit("stale-source"))


def vanished(previous: DataFrame, fresh: DataFrame, succeeded: DataFrame, active: Column) -> DataFrame:
    """Active listings of refreshed sources that the fresh feed no longer carries (source, title and URL)."""
    key = key_of("source", F.lower(text("title")), F.lower(text("url")))
    candidates = previous.filter(active).join(succeeded.select("source").distinct(), "source", "left_semi").withColumn("_key", key)
    return candidates.join(fresh.select(key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


# What a page says when its event does not take place.
PAGE_CANCELLED = r"\b(?:this event (?:has been )?cancell?ed|event cancell?ed)\b"


def rechecked(missing: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Vanished listings with ``recheck``, what their own page says now; those ``confirmed`` stay with ``revalidated-missing``.

    ``pages``: ``source, url, status, html`` of landed pages; ``sources``: ``source, domain, method``. In order: ``untrusted``
    (no official address, or pages that are used anew every year), ``not-fetched``, ``other-event`` (the page doesn't carry
    the title), ``cancelled``, ``other-day`` (the page names another day), ``confirmed``. Pages meet listings on source and address.
    """
    asked = missing.join(sources.select("source", text("domain").alias("_domain"), text("method").alias("_method")), "source", "left")
    host = urls.host("url")
    official = (F.col("_domain") != "") & ((host == F.col("_domain")) | F.endswith(host, F.concat(F.lit("."), F.col("_domain")))) & (F.col("_method") != "annual-festival")
    landed = pages.filter(F.col("status").between(200, 299)).select("source", urls.canonical_url("url").alias("_key"), plain_text("html").alias("_text"))
    landed = landed.groupBy("source", "_key").agg(F.max("_text").alias("_text"))  # one page an address
    read = asked.withColumn("_key", urls.canonical_url("url")).join(landed, ["source", "_key"], "left")
    day, shown = leading_day("date_value"), explicit_page_day("_text")
    verdict = (
        F.when(~F.coalesce(official, F.lit(False)), F.lit("untrusted")).when(F.col("_text").isNull(), F.lit("not-fetched"))
        .when(~same_identity(tokens("title", 4), tokens("_text", 4)), F.lit("other-event")).when(has(F.col("_text"), PAGE_CANCELLED), F.lit("cancelled"))
        .when((shown != "") & (shown != day), F.lit("other-day")).otherwise(F.lit("confirmed"))
    )
    judged = read.withColumn("recheck", verdict).drop("_domain", "_method", "_key", "_text")
    return judged.withColumn("refresh_status", F.when(F.col("recheck") == "confirmed", F.lit("revalidated-missing")).otherwise(F.lit("")))


def excluded_by_source(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Drop titles that their source's own pattern excludes (``sources``: ``source, pattern``)."""
    joined = events.join(sources.select("source", "pattern"), "source", "left")
    hit = (F.length(text("pattern")) > 0) & F.regexp_like(F.lower("title"), F.lower("pattern"))
    return joined.filter(~F.coalesce(hit, F.lit(False))).drop("pattern")


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def catalog_winner(entries: DataFrame, order: list[str]) -> DataFrame:
    """One entry per id across files in precedence order: overrides replace and stick; ``conflicts`` counts the rest.

    The last override wins; without one the first entry wins and every later entry is a conflict. An entry before the
    first override (other than the very first) is a conflict too.
    """
    slot = F.struct(*order)
    others = [c for c in entries.columns if c != "id"]
    row = F.struct(*others)
    grouped = entries.groupBy("id").agg(
        F.max_by(row, F.when(F.col("override"), slot)).alias("_override"), F.min_by(row, slot).alias("_first"),
        F.min(F.when(F.col("override"), slot)).alias("_first_override"), F.count("*").alias("variants"),
        F.min(slot).alias("_start"),
    )
    picked = grouped.select("id", F.coalesce("_override", "_first").alias("_row"), "_first_override", "_start", "variants")
    plain = entries.filter(~F.col("override")).join(picked.select("id", "_first_override", "_start"), "id")
    clash = plain.filter((slot > F.col("_start")) & (F.col("_first_override").isNull() | (slot < F.col("_first_override"))))
    counted = clash.groupBy("id").agg(F.count("*").alias("conflicts"))
    return picked.join(counted, "id", "left").select("id", "_row.*", "variants", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def newest(entries: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(entries, keys, order, 1)
