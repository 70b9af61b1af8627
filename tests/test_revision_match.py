"""The translation of an event: tiers, aliases, stale and faulty entries, and names that are shuffled once for both tables."""

from __future__ import annotations

import contextlib
import io

from daybill.operators import resolve

EVENTS = "id string, legacy_ids array<string>, fingerprint string"
ENTRIES = "entry_id string, fingerprint string, status string, qa_ok boolean, reviewed_at string, seq int"


def _matched(spark):
    events = spark.createDataFrame([("a", ["old-a"], "1"), ("b", None, "2"), ("c", [], "3"), ("d", ["old-d"], "4"), ("e", ["old-e"], "5"), ("f", [], None)], EVENTS)
    revisions = spark.createDataFrame([
        ("old-a", "1", "approved", True, "2026", 1), ("a", "0", "approved", True, "2027", 2), ("b", "2", "approved", False, "2026", 1),
        ("b", "2", "draft", True, "2027", 1), ("f", "6", "approved", True, "2026", 1)], ENTRIES)
    catalog = spark.createDataFrame([
        ("a", "0", "approved", True, "2027", 2), ("d", "other", "approved", True, "2026", 1), ("old-d", "4", "approved", True, "2027", 1),
        ("old-e", "5", "draft", True, "2026", 1), ("f", "6", "approved", True, "2026", 1)], ENTRIES)
    return resolve.matching_revision(events, revisions, catalog)


def test_choice(spark):
    found = {r.id: (r.entry_id, r.entry_fp, r.translation_status) for r in _matched(spark).collect()}
    assert found == {
        "a": ("old-a", "1", "current"), "b": ("b", "2", "invalid"), "c": (None, None, "missing"), "d": ("d", "other", "stale"),
        "e": ("old-e", "5", "draft"), "f": ("f", "6", "current"),
    }


def test_names_meet_both_tables_at_once(spark):
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        _matched(spark).select("id", "translation_status").explain()
    assert shown.getvalue().count("legacy_ids#") and shown.getvalue().count("Generate posexplode") == 1


def test_own_names_do_not_travel(spark):
    """Events meet entries of their own id where they are, and both kinds of names share one shuffle of the entries."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    shown = io.StringIO()
    try:
        with contextlib.redirect_stdout(shown):
            _matched(spark).select("id", "translation_status").explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    plan = shown.getvalue()
    assert "posexplode(legacy_ids" in plan and plan.count("ReusedExchange [entry_id") == 1


def test_equal_ids_stay(spark):
    events = spark.createDataFrame([("a", ["old-a"], "1"), ("a", ["old-a"], "1"), ("b", None, "2")], EVENTS)
    entries = spark.createDataFrame([("old-a", "1", "approved", True, "2026", 1)], ENTRIES)
    assert sorted(r.translation_status for r in resolve.matching_revision(events, entries, entries).collect()) == ["current", "current", "missing"]
