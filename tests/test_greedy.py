"""Order-dependent operators against plain Python loops on random small inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from daybill.operators import diversify as dv
from daybill.operators import duplicates
from daybill.operators.containment import containing
from daybill.operators.keep import keep_last, top_n
from daybill.operators.rank import ranked


def _loop_diversify(rows, mix=True):
    left, taken = sorted(rows, key=lambda r: (-r["score"], r["ord"])), []
    while left and len(taken) < dv.TOP_RESULTS:
        pool = left
        if mix and any(r["tier"] != "background" for r in left):
            pool = [r for r in left if r["tier"] != "background"]
        outings = [r for r in left if r["tier"] == "outing"]
        missing = max(0, dv.MIN_OUTINGS - sum(r["tier"] == "outing" for r in taken))
        if mix and missing and outings and len(outings) <= dv.TOP_RESULTS - len(taken):
            pool = [r for r in pool if r["tier"] == "outing"]
        calm = [r for r in pool if not r["learning"]]
        if mix and sum(r["learning"] for r in taken) >= dv.MAX_LEARNING and calm:
            pool = calm

        def adjusted(r):
            penalty = sum(w * sum(x[k] == r[k] for x in taken) for k, w in dv.PENALTIES.items() if r[k])
            return r["score"] - min(dv.MAX_PENALTY, penalty) - (0 if r["ready"] else dv.NOT_READY_PENALTY)

        best = min(pool, key=lambda r: (-adjusted(r), -r["score"], r["ord"]))
        taken.append(best)
        left.remove(best)
    return [r["id"] for r in taken]


def test_diversify_equals_the_loop_with_and_without_pruning(spark):
    rng = random.Random(5)
    for size in (4, 60, 300):
        rows = [
            {
                "id": f"e{i}", "ord": i, "score": rng.randint(0, 25), "tier": rng.choice(["outing", "everyday", "everyday", "background"]), "learning": rng.random() < 0.3,
                "ready": rng.random() < 0.8, "venue": rng.choice("abcde"), "organizer": rng.choice("xyz"), "category": rng.choice("pq"), "experience": rng.choice("mn"), "series": rng.choice(["", "", "s1"]),
            }
            for i in range(size)
        ]
        df = spark.createDataFrame(rows)
        order = [-F.col("score"), F.col("ord")]
        expected = _loop_diversify(rows)
        for pruned in (True, False) if size == 60 else (True,):
            got = [r["id"] for r in dv.diversify(df, order, pruned=pruned).orderBy("place").collect()]
            assert got == expected


def test_whole_order_is_the_head_and_the_rest_in_base_order(spark):
    from daybill.plans import feed

    rng = random.Random(6)
    for size in (3, 12, 90):
        rows = [
            {
                "id": f"e{i:03d}", "ord": i, "score": rng.randint(0, 25), "date_value": rng.choice(["", "1997-06-14", "1997-06-20T10:00"]), "title": rng.choice("ABC"),
                "tier": rng.choice(["outing", "everyday", "everyday", "background"]), "learning": rng.random() < 0.3, "ready": rng.random() < 0.8,
                "venue": rng.choice("abcde"), "organizer": rng.choice("xyz"), "category": rng.choice("pq"), "experience": rng.choice("mn"), "series": rng.choice(["", "", "s1"]),
            }
            for i in range(size)
        ]
        base = sorted(rows, key=lambda r: (-r["score"], r["date_value"] or "9999", r["title"], r["ord"]))
        head = _loop_diversify([r | {"ord": place} for place, r in enumerate(base)])
        expected = head + [r["id"] for r in base if r["id"] not in head]
        got = feed.whole_order(spark.createDataFrame(rows)).orderBy("position").collect()
        assert [r.id for r in got] == expected and [r.position for r in got] == list(range(1, size + 1))


def test_picks_respect_both_passes(spark):
    rng = random.Random(9)
    rows = [{"id": f"e{i:03d}", "source": f"s{rng.randint(0, 12)}", "city": rng.choice(["a", "a", "b"]), "topic": rng.choice(["sports", "halloween", "community"]), "score": rng.randint(0, 9)} for i in range(80)]
    ordered, taken = sorted(rows, key=lambda r: (-r["score"], r["id"])), []
    count = lambda key, value: sum(t[key] == value for t in taken)
    for loose in (False, True):
        for r in ordered:
            if r in taken or len(taken) >= dv.MAX_PICKS or count("source", r["source"]) >= 2 or count("city", r["city"]) >= (8 if loose else 5):
                continue
            if r["topic"] == "sports" and count("topic", "sports") >= 2 or not loose and r["topic"] == "halloween" and count("topic", "halloween") >= 4:
                continue
            taken.append(r)
    got = dv.pick_edition(spark.createDataFrame(rows), [-F.col("score"), F.col("id")]).orderBy("place").collect()
    assert [r["id"] for r in got] == [r["id"] for r in taken]
    assert dv.pick_edition(spark.createDataFrame(rows[:2]), [-F.col("score"), F.col("id")]).count() == 0


def test_duplicates_merge_in_order_and_priority_takes_over(spark):
    rows = [
        ("a", 1, "Moon Festival Lanterns", "2026-09-25", "Milpitas", "Partner", "12 Main Street", 1),
        ("b", 2, "Moon Festival Lantern Walk", "2026-09-25T18:00", "Milpitas", "City", "12 Main St", 9),
        ("c", 3, "Moon Festival Lanterns Walk", "2026-09-25T18:00", "Milpitas", "Other", "12 Main Street", 2),
        ("d", 4, "Moon Festival Lanterns", "2026-09-25T20:00", "Milpitas", "Late", "12 Main Street", 2),
        ("e", 5, "Chess Club", "2026-09-25", "Milpitas", "Partner", "12 Main Street", 1),
    ]
    df = spark.createDataFrame(rows, "id string, ord long, title string, date_value string, city string, source string, address string, priority int").withColumn("place", F.lit(""))
    featured = duplicates.signatures(duplicates.match_features(df), ["ord", "id"]).withColumn("has_image", F.lit(True))
    edges = duplicates.pairs(featured)
    merged = {r["id"]: r["keeper"] for r in duplicates.merge_duplicates(featured, edges).collect()}
    assert merged["a"] == merged["b"] == merged["c"] == "b"
    assert "e" not in merged and merged.get("d", "d") in ("d", "b")
    rounds = {r["id"]: r["keeper"] for r in duplicates.merge_duplicates(featured, edges, in_task=0).collect()}
    assert rounds == merged


def _loop_merge(rows, linked):
    slots, member = [], {}
    for r in sorted(rows, key=lambda r: r["slot"]["ord"]):
        at = next((i for i, s in enumerate(slots) if (s["id"], r["id"]) in linked or (r["id"], s["id"]) in linked), None)
        if at is None:
            slots.append({"id": r["id"], "priority": r["priority"], "image": r["has_image"]})
            member[r["id"]] = len(slots) - 1
            continue
        slot, member[r["id"]] = slots[at], at
        either = slot["image"] or r["has_image"]
        if r["priority"] > slot["priority"]:
            slot["id"], slot["priority"] = r["id"], r["priority"] + (4 if either and not r["has_image"] else 0)
        elif either and not slot["image"]:
            slot["priority"] += 4
        slot["image"] = either
    return {i: slots[at]["id"] for i, at in member.items()}


def test_components_of_any_size_follow_one_rule(spark):
    rng = random.Random(3)
    rows = [{"id": f"e{i:02d}", "slot": {"ord": i, "id": f"e{i:02d}"}, "priority": rng.randint(1, 9), "has_image": rng.random() < 0.4} for i in range(13)]
    # A chain, where the first match decides, and a denser part with takeovers.
    linked = {("e00", "e01"), ("e01", "e02"), ("e02", "e03")}
    linked |= {(f"e{a:02d}", f"e{b:02d}") for a in range(4, 13) for b in range(a + 1, 13) if rng.random() < 0.4}
    df = spark.createDataFrame(rows, "id string, slot struct<ord:long,id:string>, priority int, has_image boolean")
    edges = spark.createDataFrame(sorted(linked), "a string, b string")
    named = {i for pair in linked for i in pair}
    expected = _loop_merge([r for r in rows if r["id"] in named], linked)
    for most in (20_000, 4):
        assert {r["id"]: r["keeper"] for r in duplicates.merge_duplicates(df, edges, in_task=most).collect()} == expected


def test_every_copy_has_the_keeper_of_the_loop(spark):
    """Equal listings are paired once, but each takes its own turn, so a copy behind a takeover may end elsewhere."""
    rng = random.Random(8)
    titles = ["Moon Festival Lanterns", "Moon Festival Lantern Walk", "Lantern Walk Music"]
    rows = [
        (f"e{i:03d}", i, rng.choice(titles), rng.choice(["2026-09-25", "2026-09-25T18:00"]), rng.choice(["Milpitas", "Milpitas", None]), rng.choice(["A", None]), "12 Main Street")
        for i in range(60)
    ]
    priority = F.when(F.col("source") == "A", 2).when(F.col("title").contains("Walk"), 5).otherwise(1)
    df = spark.createDataFrame(rows, "id string, ord long, title string, date_value string, city string, source string, address string").withColumn("place", F.lit(""))
    featured = duplicates.match_features(df.withColumn("priority", priority)).withColumn("slot", F.struct("ord", "id")).withColumn("has_image", F.lit(True))
    linked = {(r["a"], r["b"]) for r in duplicates.pairs(featured).collect()}
    named = {i for pair in linked for i in pair}
    expected = _loop_merge([r.asDict() for r in featured.select("id", "slot", "priority", "has_image").collect() if r["id"] in named], linked)
    signed = duplicates.signatures(featured, ["ord", "id"]).withColumn("has_image", F.lit(True))
    edges = duplicates.pairs(signed).unionByName(duplicates.twins(signed))
    copies = duplicates.copies_of(featured, signed, ["ord", "id"])
    assert copies.count() == 60 - signed.count() > 20
    for most in (20_000, 0):
        got = duplicates.merge_duplicates(signed, edges, in_task=most, copies=copies).collect()
        assert len(got) == len(expected) and {r["id"]: r["keeper"] for r in got} == expected


def test_containment_finds_short_cut_and_empty_evidence(spark):
    docs = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a  b\tc d e f g"), (3, ""), (4, None), (5, "naïve 漢字 text 😀 here"), (6, "the quick brown")]
    items = ["the quick brown fox jumps ov", "ick brown fo", "fox", "ox ju", "b\tc", "", None, "漢", "字 text 😀 h", "z", "quick brown fox jumps over the lazy dog", "own fox jumps o", " b\tc d ", "a  b"]
    evidence = list(enumerate(items))
    got = containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(evidence, "item_id int, text string"))
    expected = {(i, d) for i, e in evidence for d, text in docs if e is not None and text is not None and e in text}
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == expected
    none = containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([], "item_id int, text string"))
    assert none.count() == 0


def test_ranks_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id"), F.hash("id").alias("h"))
    rows = ranked(df, [F.col("h"), F.col("id")], "r", within=["g"]).collect()
    for g in range(7):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["h"], r["id"]))
        assert [r["r"] for r in mine] == list(range(1, len(mine) + 1))


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("k"), "id").filter("k = 0")
    out = top_n(df, ["k"], [F.col("id").desc()], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert sorted(r["id"] for r in out.collect()) == [9994, 9996, 9998]
    last = keep_last(df, ["k"], ["id"], "first").first()
    assert last["first"] == 0
