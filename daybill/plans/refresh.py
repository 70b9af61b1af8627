"""One refresh of the catalog: what the feeds brought, what stays without them, and what is published.

Parsed listings of the sources that answered are joined by still active listings of failed sources and by vanished ones whose
page confirms them; curated rows are applied, duplicates merged, pages read where that can change something, sessions
grouped, names united, gates checked, and only the months that changed are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, scoring, urls
from ..functions.defaults import text
from ..operators import catalog, curation, duplicates, gates, identity, series
from ..operators.keep import top_n
from ..session import durable, ship
from ..sources import partitioned, sinks
from ..streaming.jobs import changed_rows
from .enrich import EVIDENCE, enrich

ORDER = ["ord", "id"]
FILLED = ["image", "end_date_value", "cost_status", "registration_status"]
TOGETHER = {
    "image": ["image_status", "image_source", "image_method", "image_source_url"], "cost_status": ["cost_label", "cost_source", "cost_evidence"],
    "registration_status": ["registration_source", "registration_evidence"],
}
#: A listing is written again when one of these differs.
CONTENT = [
    "title", "date_value", "end_date_value", "description", "place", "address", "city", "source", "url", "image", "image_status", "cost_status", "cost_label",
    "registration_status", "age_label", "audience", "type", "format", "refresh_status", "detail_status", "verified_at",
]


@dataclass(frozen=True)
class Landed:
    """What a refresh starts from.

    ``fresh``: parsed listings with ``ord``; ``runs``: ``source, ok``; ``sources``: ``source, domain, method``; ``pages``: ``source, url,
    status, html, final_url, domain``; ``supplements``: curated rows with ``ord``, or None.
    """

    fresh: DataFrame
    runs: DataFrame
    sources: DataFrame
    pages: DataFrame
    supplements: DataFrame | None = None


def _alive(now: str) -> Column:
    minutes = dates.fallback_minutes("format", "title", "description")
    return dates.is_active(dates.effective_end("date_value", "end_date_value", minutes, "ongoing"), now, "ongoing")


def gathered(landed: Landed, previous: DataFrame, now: str) -> DataFrame:
    """One row an id: fresh listings first, then vanished ones that their page confirms, then those of failed sources."""
    good = landed.runs.filter("ok").select("source").distinct()
    failed = landed.runs.select("source").distinct().join(good, "source", "left_anti")
    fresh = curation.completed(landed.fresh.join(good, "source", "left_semi")).withColumn("refresh_status", F.lit("fresh"))
    missing = catalog.vanished(previous, fresh, good, _alive(now))
    confirmed = catalog.rechecked(missing, landed.pages, landed.sources).filter("recheck = 'confirmed'").drop("recheck")
    kept = catalog.retained(previous, failed, _alive(now))
    every = fresh.withColumn("_tier", F.lit(0))
    for number, part in enumerate((confirmed, kept), 1):
        every = every.unionByName(part.select(*[c for c in part.columns if c in fresh.columns]).withColumn("_tier", F.lit(number)), allowMissingColumns=True)
    return curation.completed(top_n(every.filter(_alive(now)), ["id"], [F.col("_tier"), F.col("ord")], 1).drop("_tier"))


def without_duplicates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept records with their gaps filled, and ``(id, keeper)`` of all that were compared."""
    ship(rows.sparkSession)
    points = scoring.organizer_priority("url", "image", "source", "place", "verification", "address")
    featured = duplicates.match_features(rows).withColumn("priority", points).withColumn("has_image", text("image") != "")
    merged = durable(duplicates.merge_classes(duplicates.classes(featured, "priority", "has_image")))
    unknown = {"cost_status": ["unknown"], "registration_status": ["unknown"]}
    filled = duplicates.fill_from_duplicates(rows, merged, ORDER, FILLED, unknown, TOGETHER).drop("records")
    names = [c for c in filled.columns if c != "id"]
    kept = rows.join(merged.filter("id <> keeper").select("id"), "id", "left_anti").drop(*names)
    return kept.join(filled, "id"), merged


@dataclass(frozen=True)
class Refreshed:
    listings: DataFrame
    cards: DataFrame
    sessions: DataFrame
    aliases: DataFrame


def refreshed(landed: Landed, previous: DataFrame, now: str) -> Refreshed:
    """All tables of the new catalog; every step that later ones read more than once is stored."""
    rows = durable(gathered(landed, previous, now))
    if landed.supplements is not None:
        rows = durable(curation.apply_supplements(rows, landed.supplements, ORDER, now))
    kept, merged = without_duplicates(rows)
    known = previous.select("id", urls.canonical_url("url").alias("canonical_url"), "verified_at", "evidence")
    enriched = enrich(durable(kept), known, landed.pages.filter(F.col("status").between(200, 299)).drop("status"), now)
    newest = F.array_max(F.transform(F.map_values("evidence"), lambda e: e["verified_at"]))
    listings = durable(enriched.filter("detail_status <> 'cancelled'").filter(_alive(now)).withColumn("verified_at", F.coalesce(newest, F.lit(""))).withColumn("active", F.lit(True)))
    keyed = listings.withColumns({"meeting_point": F.lit(""), "age_ranges_json": F.lit("[]")}).withColumn("series_key", series.series_key())
    order = ["date_value", *ORDER]
    cards = durable(series.cards(keyed, "series_key", order, ["title", "type", "format", "source", "place", "city", "image", "url", "description"]))
    sessions = series.sessions(keyed, cards, "series_key", order).select("card_id", F.col("id").alias("session_id"), "session_no", "date_value", "end_date_value", "url", "place", "address", "city", "cost_status", "registration_status", "format")
    legacy = series.legacy_series_id(["source", "title", "description", "place", "address", "meeting_point", "city", "type", "age_ranges_json", "age_label", "cost_label", "cost_source", "registration_status"])
    aliases = identity.identities(
        cards.select(F.col("card_id").alias("id")), identity.links(rows, "id", "legacy_ids"), identity.merge_links(merged), identity.series_links(keyed, cards, "series_key", legacy))
    return Refreshed(listings.drop("active"), cards, sessions, aliases)


def publication_gates(landed: Landed, listings: DataFrame) -> DataFrame:
    """Rows that stop a publication: no feed answered, nothing to show, a large source lost."""
    fetched = landed.fresh.groupBy("source").agg(F.count("*").alias("fetched"))
    published = listings.groupBy("source").agg(F.count("*").alias("published"))
    return gates.combine(gates.all_feeds_failed(landed.runs), gates.empty_schedule(listings), gates.destructive_loss(catalog.lost_sources(fetched, published)))


def _previous(spark: SparkSession, root: str, like: DataFrame) -> DataFrame:
    try:
        return partitioned.read_parts(spark, f"{root}/listings")
    except ValueError:  # nothing is published yet
        rows = curation.completed(like).limit(0)
        return rows.withColumn("evidence", F.create_map().cast(EVIDENCE)).withColumn("verified_at", F.lit("")).withColumn("audience", F.lit("")).withColumn("detail_status", F.lit("")).withColumn("content_hash", F.lit(""))


def run(spark: SparkSession, landed: Landed, root: str, version: str, now: str) -> dict[str, int]:
    """Refresh the catalog under ``root`` and publish it as ``version``; returns the numbers of changed and removed listings.

    Listings are kept by month and only months with a changed, new or removed listing are written; cards, sessions and
    aliases follow them. Without a change nothing is published. A gate raises ``PublicationBlocked`` and the old version stays.
    """
    root = root.rstrip("/")
    gates.publish(gates.all_feeds_failed(landed.runs))
    before = _previous(spark, root, landed.fresh)
    out = refreshed(landed, before, now)
    current = durable(before.select("id", "content_hash"))
    changed = durable(changed_rows(out.listings, current, "id", CONTENT))
    removed = durable(current.join(out.listings.select("id"), "id", "left_anti").select("id"))
    counts = {"changed": changed.count(), "removed": removed.count()}
    if any(counts.values()):
        partitioned.upsert_parts(changed, f"{root}/listings", "id", partitioned.month("date_value"), version, removed=removed, gates=lambda whole: publication_gates(landed, whole))
        for name in ("cards", "sessions", "aliases"):
            sinks.publish_table(getattr(out, name), f"{root}/{name}", version)
    return counts
