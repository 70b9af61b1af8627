"""The gap worklist matches only events that are not over."""

from __future__ import annotations

from daybill.checks import translations
from daybill.operators import resolve
from daybill.plans.listings import Tables


def test_past_events_are_not_matched(spark, monkeypatch):
    asked = []

    def matched(events, revisions, catalog):
        asked.append(events.count())
        return match(events, revisions, catalog)

    match = resolve.matching_revision
    monkeypatch.setattr(resolve, "matching_revision", matched)
    tables = Tables(spark, "/root/testdata/sf0.001")
    assert translations.gap_rows(tables).count() > 0
    assert 0 < asked[0] < tables.lineitem.count()
