"""Reports and gates over whole catalogs (R, J15, J16, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import catalog, collections, gates, resolve
from ..plans import weekend
from ..plans.listings import listings
from .aggregates import _IN, _MEMBERS, _RUN_SQL, collection_inputs, horizon, run_results
from .predicates import CANDIDATE_WHERE, weekend_rows
from .registry import FRIDAY, NOW, SUNDAY, TODAY, check, first_nonempty_sql, q

_HEALTH = f"""WITH {_RUN_SQL}, s AS (SELECT c_custkey AS key, c_name AS name FROM customer), p AS (SELECT c_custkey AS key, c_custkey % 5 AS before FROM customer WHERE c_custkey % 2 = 0),
 h AS (SELECT s.key, name, CASE WHEN ok IS NULL THEN 'not-run' WHEN NOT ok THEN 'failed' ELSE 'ok' END AS status, CASE WHEN ok IS NULL THEN NULL WHEN ok THEN event_count ELSE 0 END AS event_count,
  CAST(CASE WHEN ok IS NULL THEN coalesce(before, 0) WHEN NOT ok THEN coalesce(before, 0) + 1 ELSE 0 END AS BIGINT) AS failure_streak, CASE WHEN ok IS NOT NULL AND NOT ok THEN 'timeout' ELSE '' END AS error
  FROM s LEFT JOIN r USING (key) LEFT JOIN p USING (key))"""


def health(t):
    sources = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    previous = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 5).alias("failure_streak"))
    return catalog.source_health(sources, run_results(t), previous)


@check("j16_source_health", _HEALTH + " SELECT * FROM h")
def j16(t):
    return health(t)


@check("r1_health_alerts", _HEALTH + " SELECT name, failure_streak, error FROM h WHERE status = 'failed' AND failure_streak >= 3")
def r1(t):
    return catalog.health_alerts(health(t))


@check("r2_lost_source_stages", "WITH {lv} SELECT source, CAST(1 AS BIGINT) AS stage_no, count(*) AS before, count(*) FILTER (WHERE supp % 7 <> 0) AS after FROM lv GROUP BY source HAVING count(*) >= 20 AND count(*) FILTER (WHERE supp % 7 <> 0) = 0")
def r2(t):
    rows = listings(t, "source", "supp")
    stages = catalog.funnel(rows, [("published", F.col("supp") % 7 != 0)])
    lost = stages.filter((F.col("before") >= catalog.LARGE_FEED) & (F.col("after") == 0))
    return lost.select("source", F.col("stage_no").cast("long").alias("stage_no"), "before", "after")


@check(
    "j15_discovery_coverage",
    f"""WITH {{lv}}, c AS (SELECT source, count(*) FILTER (WHERE {_IN(60)}) AS next60, count(*) FILTER (WHERE {_IN(90)}) AS next90 FROM lv GROUP BY 1)
     SELECT s_name AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'search-only' ELSE 'rss' END AS method, CASE WHEN s_suppkey % 4 = 0 THEN 'not run' ELSE 'ok' END AS status, coalesce(next60, 0) AS next60, coalesce(next90, 0) AS next90 FROM supplier LEFT JOIN c ON c.source = s_name""",
)
def j15(t):
    return _coverage(t)


def _coverage(t):
    rows = listings(t, "source", "date_value", "end_date_value")
    inside = lambda days: dates.overlaps("date_value", "end_date_value", F.lit(TODAY), F.lit(horizon(days)))
    counts = rows.groupBy("source").agg(F.count_if(inside(60)).alias("next60"), F.count_if(inside(90)).alias("next90"))
    priority = t.supplier.select(F.col("s_name").alias("source"))
    registry = t.supplier.filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("source"), F.lit("rss").alias("method"))
    state = t.supplier.filter("s_suppkey % 4 <> 0").select(F.col("s_name").alias("source"), F.lit("ok").alias("status"))
    joined = priority.join(registry, "source", "left").join(state, "source", "left").join(counts, "source", "left")
    return joined.select(
        "source", F.coalesce("method", F.lit("search-only")).alias("method"), F.coalesce("status", F.lit("not run")).alias("status"),
        F.coalesce("next60", F.lit(0)).alias("next60"), F.coalesce("next90", F.lit(0)).alias("next90"),
    )


@check(
    "r3_discovery_alerts",
    f"""WITH {{lv}}, c AS (SELECT source, count(*) FILTER (WHERE {_IN(60)}) AS n FROM lv GROUP BY 1)
     SELECT 'search-only' AS kind, s_name AS source FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'source-health', s_name FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 = 0
     UNION ALL SELECT 'coverage-review', s_name FROM supplier LEFT JOIN c ON c.source = s_name WHERE coalesce(n, 0) = 0""",
)
def r3(t):
    rules = [
        (F.col("method") == "search-only", "search-only"), ((F.col("method") != "search-only") & (F.col("status") != "ok"), "source-health"), (F.col("next60") == 0, "coverage-review"),
    ]
    kinds = F.array_compact(F.array(*[F.when(condition, F.lit(kind)) for condition, kind in rules]))
    return _coverage(t).select(F.explode(kinds).alias("kind"), "source")


@check(
    "r3_on_sale_window",
    f"""WITH {{lv}} SELECT id, CAST(date_diff('day', DATE '{TODAY}', CAST(verified_at AS DATE)) AS BIGINT) AS days_until FROM lv WHERE {_IN(90)} AND date_diff('day', DATE '{TODAY}', CAST(verified_at AS DATE)) BETWEEN -3 AND 14""",
)
def r3_sale(t):
    rows = listings(t, "date_value", "end_date_value", "verified_at")
    days = F.date_diff(F.to_date("verified_at"), F.lit(TODAY).cast("date")).cast("long")
    inside = dates.overlaps("date_value", "end_date_value", F.lit(TODAY), F.lit(horizon(90)))
    return rows.filter(inside & days.between(-3, 14)).select("id", days.alias("days_until"))


@check(
    "r6_collection_states",
    _MEMBERS + """ SELECT slug, CASE slug WHEN 'AFRICA' THEN 'DRAFT' WHEN 'AMERICA' THEN 'ENDED' ELSE 'FEATURED' END AS state, count(*) FILTER (WHERE known) AS resolved, count(*) FILTER (WHERE known AND current) AS current,
     min(a) FILTER (WHERE known AND current) AS span_start FROM m GROUP BY 1""",
)
def r6(t):
    configs, resolved, members = collection_inputs(t)
    model = collections.view_model(configs.withColumn("last_chance", F.lit(2)), resolved, members, NOW)
    return model.select("slug", "state", "resolved", "current", "span_start")


@check(
    "r7_edition_state",
    f"""WITH {{lv}}, p AS (SELECT quantity % 9 <> 0 AS known, left(date_value, 10) <= '{SUNDAY}' AND left({first_nonempty_sql('end_date_value', 'date_value')}, 10) >= '{FRIDAY}' AS inside FROM lv)
     SELECT count(*) AS picks, count(*) FILTER (WHERE NOT known) AS unresolved, count(*) FILTER (WHERE known AND NOT inside) AS expired, count(*) FILTER (WHERE known AND inside) AS valid, 'live' AS state FROM p""",
)
def r7(t):
    rows = listings(t, "date_value", "end_date_value", "quantity")
    inside = collections.overlaps_weekend(F.col("date_value"), F.col("end_date_value"), F.lit(False), F.lit(False), FRIDAY, SUNDAY)
    picks = rows.select(F.col("id").alias("ref"), F.when(F.col("quantity") % 9 != 0, F.col("id")).alias("id"), inside.alias("in_weekend"))
    return collections.edition_state(picks, "published", SUNDAY, TODAY)


@check("flagship_weekend_by_city")
def flagship(t):
    return weekend.weekend_outings(t, FRIDAY)


@check("q1_all_feeds_failed", f"WITH {_RUN_SQL} SELECT 'feeds' AS gate, 'all' AS key, 'all-feeds-failed' AS issue, CAST(count(*) AS VARCHAR) AS detail FROM r WHERE NOT ok")
def q1(t):
    failed = run_results(t).filter("NOT ok")
    return gates.combine(gates.all_feeds_failed(failed), gates.all_feeds_failed(run_results(t)))


@check("q2_empty_schedule", "SELECT 'schedule' AS gate, 'all' AS key, 'empty-schedule' AS issue, '' AS detail")
def q2(t):
    rows = listings(t, "price")
    return gates.combine(gates.empty_schedule(rows), gates.empty_schedule(rows.filter("price < 0")))


@check("q4_destructive_loss", "SELECT 'coverage' AS gate, 's-' || l_suppkey AS key, 'no-output' AS issue, CAST(count(*) AS VARCHAR) AS detail FROM lineitem WHERE l_suppkey % 7 = 0 GROUP BY l_suppkey HAVING count(*) >= 20")
def q4(t):
    rows = listings(t, "source_id", "supp")
    fetched = rows.groupBy(F.col("source_id").alias("source")).agg(F.count("*").alias("fetched"))
    published = rows.filter("supp % 7 <> 0").groupBy(F.col("source_id").alias("source")).agg(F.count("*").alias("published"))
    return gates.destructive_loss(catalog.lost_sources(fetched, published))


@check("q8_too_few_picks", "SELECT 'edition' AS gate, 'picks' AS key, 'too-few-picks' AS issue, CAST(count(*) AS VARCHAR) AS detail FROM region WHERE r_regionkey < 3")
def q8(t):
    return gates.too_few_picks(t.region.filter("r_regionkey < 3"))


@check("q10_missing_images", "WITH {lv} SELECT 'images' AS gate, id AS key, 'no-image' AS issue, '' AS detail FROM lv WHERE image = ''")
def q10(t):
    return gates.missing_images(listings(t, "image"))
