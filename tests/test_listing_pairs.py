"""Every pair of matching listings is given, once, whatever blocks its members travel in."""

from __future__ import annotations

import inspect

import pytest
from test_duplicate_classes import _listings, _matches

from daybill.checks import joins, load
from daybill.operators import duplicates


@pytest.mark.parametrize("block", [1_000, 3])
def test_pairs_are_all_matches_once(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    featured = _listings(spark, 150, 4)
    rows = sorted(featured.collect(), key=lambda r: r.ord)
    expected = {(a.id, b.id) for i, a in enumerate(rows) for b in rows[i + 1:] if _matches(a, b)}
    got = [(r.a, r.b) for r in duplicates.listing_pairs(duplicates.classes(featured, "source")).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 300


def test_the_query_gives_pairs_of_listings():
    assert "listing_pairs" in inspect.getsource(joins.j11) and "'member'" not in load()["j11_duplicate_pairs"].sql
