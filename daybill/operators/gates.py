"""Publication gates. A gate is a table ``(gate, key, issue, detail)``; publishing stops while any row exists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.defaults import flags, text
from ..functions.regex import has


class PublicationBlocked(RuntimeError):
    pass


def issues(df: DataFrame, gate: str, key: str | Column, issue: str | Column, detail: str | Column | None = None) -> DataFrame:
    column = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        F.lit(gate).alias("gate"), F.col(key).cast("string").alias("key") if isinstance(key, str) else key.alias("key"),
        column(issue).alias("issue"), (F.lit("") if detail is None else column(detail)).alias("detail"),
    )


def all_feeds_failed(results: DataFrame) -> DataFrame:
    """A row when every source failed: the previous catalog stays."""
    total = results.agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))
    return issues(total.filter("n > 0 AND good = 0"), "feeds", F.lit("all"), "all-feeds-failed", F.col("n").cast("string"))


def empty_schedule(events: DataFrame) -> DataFrame:
    total = events.limit(1).agg(F.count("*").alias("n"))
    return issues(total.filter("n = 0"), "schedule", F.lit("all"), "empty-schedule")


# Link states that block a release when there is no fallback.
BLOCKING_LINKS = ["invalid", "not-found", "content-mismatch"]


def broken_links(links: DataFrame) -> DataFrame:
    bad = links.filter((F.col("link_resolution") == "unavailable") & F.col("link_status").isin(*BLOCKING_LINKS))
    return issues(bad, "links", "id", F.col("link_status"), text("canonical_url"))


def destructive_loss(lost: DataFrame) -> DataFrame:
    return issues(lost, "coverage", "source", "no-output", F.col("fetched").cast("string"))


def translation_problems(audited: DataFrame) -> DataFrame:
    return issues(audited.filter("translation_status = 'invalid'"), "translations", "id", "invalid")


def catalog_conflicts(winners: DataFrame) -> DataFrame:
    return issues(winners.filter("conflicts > 0"), "catalog", "id", "duplicate-without-override", F.col("conflicts").cast("string"))


def too_few_picks(picks: DataFrame, least: int = 5) -> DataFrame:
    total = picks.agg(F.count("*").alias("n"))
    return issues(total.filter(F.col("n") < least), "edition", F.lit("picks"), "too-few-picks", F.col("n").cast("string"))


def missing_images(events: DataFrame) -> DataFrame:
    return issues(events.filter(F.length(text("image")) == 0), "images", "id", "no-image")


def summary_contract(events: DataFrame, version: str) -> DataFrame:
    """Published summaries: known status, current version, evidence, hash, and verbatim containment in the source."""
    known = F.col("summary_status").isin("extractive", "manual_verified", "official_structured")
    extractive = F.col("summary_status") == "extractive"
    found = flags(
        [
            (~known, "unknown-status"), (text("summary_version") != version, "old-version"),
            (F.length(text("summary_evidence")) == 0, "no-evidence"),
            (text("source_description_hash") != F.sha2(text("source_description_raw"), 256), "hash-mismatch"),
            (extractive & ~F.contains(text("source_description_raw"), text("parent_summary")), "not-in-source"),
        ]
    )
    return issues(events.withColumn("_i", F.explode(found)), "summary", "id", F.col("_i"))


def inbox_schema(inbox: DataFrame) -> DataFrame:
    """Field rules of reviewed translations."""
    found = flags(
        [
            (F.length(F.trim(text("id"))) == 0, "missing-id"), (~has(text("fingerprint"), r"^[a-f0-9]{64}$", False), "bad-fingerprint"),
            (F.length(F.trim(text("title"))) == 0, "missing-title"), (F.col("description").isNull(), "missing-description"),
            (text("status") != "approved", "not-approved"), (~F.coalesce("override", F.lit(False)), "no-override"),
            (F.col("reviewed_at").try_cast("timestamp").isNull(), "bad-review-time"),
        ]
    )
    rows = inbox.withColumn("_i", F.explode(found))
    repeated = inbox.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return issues(rows, "inbox", "id", F.col("_i")).unionByName(issues(repeated, "inbox", "id", "duplicate-id"))


def manifest_counts(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against counted totals, both ``(name, n)``."""
    both = declared.withColumnRenamed("n", "want").join(actual.withColumnRenamed("n", "got"), "name", "full_outer")
    off = both.filter(~F.col("want").eqNullSafe(F.col("got")))
    return issues(off, "manifest", "name", "count-mismatch", F.concat_ws("/", text("want"), text("got")))


def combine(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def publish(found: DataFrame, sample: int = 12) -> None:
    """Raise when any gate has rows; the message shows a small sample."""
    rows = found.limit(sample).collect()
    if rows:
        raise PublicationBlocked("; ".join(f"{r['gate']}:{r['key']}:{r['issue']}" for r in rows))
