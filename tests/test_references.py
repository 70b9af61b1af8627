"""References of collections: the owner of an alias comes with its order, so events are not joined again."""

from __future__ import annotations

from daybill.operators import resolve


def _resolved(spark):
    events = spark.createDataFrame([("a", ["x", "y"], "u1", 1), ("b", ["y"], "u2", 2), ("c", None, "u1", 3)], "id string, legacy_ids array<string>, url string, ord int")
    refs = spark.createDataFrame([("1", "x", ""), ("2", "y", "u1"), ("3", "gone", "u1"), ("4", "gone", "u9"), ("5", "c", "")], "ref string, ref_id string, ref_url string")
    return resolve.resolve_references(refs, events, events.select("id", "url", "ord"), ["ord"])


def test_rules(spark):
    assert {r.ref: (r.id, r.rule) for r in _resolved(spark).collect()} == {"1": ("a", 1), "2": ("b", 1), "3": ("a", 2), "4": (None, 0), "5": ("c", 1)}


def test_events_are_not_joined_for_their_order(spark):
    plan = _resolved(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3
