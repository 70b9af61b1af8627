"""Aggregations (A) and the greedy operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audience, classify, commerce, dates, notices, scoring, summary, text, translation_qa, urls
from ..operators import catalog, collections, diversify, duplicates, enrichment, gates, identity, resolve, series
from ..operators.keep import top_n
from ..plans import feed, weekend
from ..plans.listings import COSTS, _pick, listings
from .joins import _DUP_SQL, duplicate_rows
from ..session import durable, stored
from .predicates import CANDIDATE_WHERE, _ADULT, format_case, listing_type_case, type_case, weekend_rows
from .registry import FRIDAY, NOW, SUNDAY, TODAY, check, day_sql, end_sql, first_nonempty_sql, options, q, rx

_END = end_sql("date_value", "end_date_value", "240")
_ACTIVE = f"{_END} > '{NOW}'"


def with_activity(t, *wanted):
    rows = listings(t, "date_value", "end_date_value", *wanted)
    return rows.withColumn("active", dates.is_active(dates.effective_end("date_value", "end_date_value", F.lit(240)), NOW))


_SERIES_SQL = f"""WITH {{lv}}, r AS (SELECT *, {_ACTIVE} AS active FROM lv), g AS (SELECT series, count(*) AS total_sessions, count(*) FILTER (WHERE active) AS active_sessions,
  arg_min(id, (date_value, ord, id)) FILTER (WHERE active) AS first_id, arg_min(place, (date_value, ord, id)) FILTER (WHERE active) AS place, max(date_value) FILTER (WHERE active) AS last_date
  FROM r GROUP BY series), c AS (SELECT *, CASE WHEN total_sessions = 1 THEN first_id ELSE 'series-' || left(sha256(series), 16) END AS card_id FROM g WHERE active_sessions > 0)"""


@check("a1_series_cards", _SERIES_SQL + " SELECT card_id, first_id, place, total_sessions, active_sessions, last_date FROM c")
def a1(t):
    rows = with_activity(t, "series", "place")
    return series.cards(rows, "series", ["date_value", "ord", "id"], ["place"]).drop("series")


@check(
    "a1_series_sessions",
    _SERIES_SQL + " SELECT r.id, card_id, row_number() OVER (PARTITION BY card_id ORDER BY r.date_value, r.ord, r.id) AS session_no FROM r JOIN c USING (series) WHERE r.active",
)
def a1_sessions(t):
    rows = with_activity(t, "series")
    cards = series.cards(rows, "series", ["date_value", "ord", "id"], [])
    return series.sessions(rows, cards, "series", ["date_value", "ord", "id"]).select("id", "card_id", "session_no")


_FORMATS = ["live-show", "sports-game", "program", "program"]
_STABLE = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


@check(
    "a1_series_identity",
    f"""WITH {{lv}}, k AS (SELECT *, {_ACTIVE} AS active, ({_FORMATS})[line % 4 + 1] AS format FROM lv),
     u AS (SELECT * REPLACE (title || ' ' || part AS title) FROM k),
     n AS (SELECT *, CASE format WHEN 'sports-game' THEN concat_ws(chr(31), format, source, title, place, date_value) WHEN 'live-show' THEN concat_ws(chr(31), format, {_STABLE('source')}, {_STABLE('title')}, {_STABLE('place')}, {_STABLE('city')})
       ELSE concat_ws(chr(31), format, source, title, description, place, address, '', city, '[]', '') END AS key,
      'series-' || left(sha256(concat_ws(chr(31), source, title, description, place, address, '', city, 'community', '[]', '', '', '', cost_status)), 16) AS legacy FROM u),
     g AS (SELECT key, count(*) AS total, arg_min(id, (date_value, ord, id)) FILTER (WHERE active) AS first_id FROM n GROUP BY key HAVING bool_or(active)),
     c AS (SELECT *, CASE WHEN total = 1 THEN first_id ELSE 'series-' || left(sha256(key), 16) END AS card_id FROM g),
     m AS (SELECT n.*, c.card_id, c.total FROM n LEFT JOIN c USING (key)),
     i AS (SELECT part, min(card_id) AS id FROM m GROUP BY part HAVING min(card_id) IS NOT NULL)
     SELECT alias, i.id FROM (SELECT id AS alias, part FROM m UNION SELECT 'old-' || part, part FROM m UNION SELECT legacy, part FROM m WHERE total > 1 UNION SELECT card_id, part FROM m WHERE card_id IS NOT NULL) JOIN i USING (part)""",
)
def a1_identity(t):
    """Every name of the series of a part: rows, cards, ids of older catalogs, and an old id that its series share."""
    rows = with_activity(t, "title", "source", "description", "place", "address", "city", "part", "line", "cost_status").withColumns({
        "title": F.concat_ws(" ", "title", F.col("part").cast("string")), "format": _pick(_FORMATS, F.col("line")), "type": F.lit("community"), "meeting_point": F.lit(""), "age_ranges_json": F.lit("[]"), "age_label": F.lit(""),
        "legacy_ids": F.array(F.concat(F.lit("old-"), F.col("part").cast("string"))),
    })
    legacy = series.legacy_series_id(["source", "title", "description", "place", "address", "meeting_point", "city", "type", "age_ranges_json", "age_label", F.lit(""), F.lit(""), "cost_status"])
    keyed = stored(rows.select("id", "ord", "date_value", "active", "legacy_ids", series.digest(series.series_key()).alias("key"), legacy.alias("legacy")))
    cards = stored(series.cards(keyed, "key", ["date_value", "ord", "id"], [], digested=True).select("key", "card_id", "total_sessions"))
    current = cards.select(F.col("card_id").alias("id"))
    return identity.identities(current, identity.links(keyed, "id", "legacy_ids"), identity.series_links(keyed, cards, "key", F.col("legacy")))


@check(
    "e11_fields_move_together",
    """WITH {lv}, r AS (SELECT *, arg_min(id, (ord, id)) OVER (PARTITION BY series) AS keeper FROM lv), s AS (SELECT keeper, (id <> keeper, ord, id) AS slot, cost_status, id FROM r)
     SELECT keeper AS id, coalesce(arg_min(cost_status, slot) FILTER (WHERE cost_status <> 'unknown'), arg_min(cost_status, slot)) AS cost_status,
     'label of ' || coalesce(arg_min(id, slot) FILTER (WHERE cost_status <> 'unknown'), arg_min(id, slot)) AS cost_label FROM s GROUP BY keeper""",
)
def e11_together(t):
    rows = listings(t, "series", "cost_status").withColumn("cost_label", F.concat(F.lit("label of "), F.col("id")))
    first = rows.groupBy("series").agg(F.min(F.struct("ord", "id")).alias("k"))
    merged = rows.join(first, "series").select("id", F.col("k.id").alias("keeper"))
    return duplicates.fill_from_duplicates(rows, merged, ["ord", "id"], ["cost_status"], {"cost_status": ["unknown"]}, {"cost_status": ["cost_label"]}).drop("records")


@check("a2_cautious_rating", "SELECT l_suppkey AS supplier, (['PG13', 'PG', 'G', 'NR'])[min(l_linenumber % 4) + 1] AS movie_rating FROM lineitem GROUP BY 1")
def a2(t):
    rating = _pick(["pg-13", "PG", "<b>g</b>", "nr"], F.col("l_linenumber"))
    return series.cautious_rating(t.lineitem.select(F.col("l_suppkey").alias("supplier"), rating.alias("rating")), "supplier", "rating")


_STAGES = [
    ("available", "NOT contains(description, 'Sold out')"),
    ("family-relevant", f"NOT {_ADULT}"),
    ("priced", "cost_status <> 'unknown'"),
    ("active", _ACTIVE),
]


@check(
    "a3_publication_funnel",
    "WITH {lv}, f AS (SELECT source, " + ", ".join(f"({' AND '.join('(' + c + ')' for _, c in _STAGES[: i + 1])}) AS s{i + 1}" for i in range(len(_STAGES))) + ", true AS s0 FROM lv) "
    + " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS BIGINT) AS stage_no, '{name}' AS stage, source, count(*) FILTER (WHERE s{i}) AS before, count(*) FILTER (WHERE s{i + 1}) AS after FROM f GROUP BY source"
        for i, (name, _) in enumerate(_STAGES)
    ),
)
def a3(t):
    rows = with_activity(t, "source", "description", "cost_status")
    stages = [
        ("available", ~notices.is_unavailable(["description"])),
        ("family-relevant", audience.is_family_relevant(F.lit(""), "description", F.lit(""), F.lit(None), F.lit(None))),
        ("priced", F.col("cost_status") != "unknown"),
        ("active", F.col("active")),
    ]
    return catalog.funnel(rows, stages).withColumn("stage_no", F.col("stage_no").cast("long"))


def run_results(t):
    """One result per source from the event stream: failed when its last event is an error."""
    last = t.events.groupBy(F.col("user_id").alias("key")).agg(
        (F.max_by("event_type", F.struct("ts", "event_id")) != "error").alias("ok"), F.count("*").alias("event_count")
    )
    return last.withColumn("error", F.lit("timeout"))


_RUN_SQL = "r AS (SELECT user_id AS key, arg_max(event_type, (ts, event_id)) <> 'error' AS ok, count(*) AS event_count FROM events GROUP BY 1)"


@check("a4_refresh_counts", f"WITH {_RUN_SQL} SELECT key, CASE WHEN ok THEN event_count ELSE -1 END AS fetched FROM r")
def a4(t):
    return catalog.refresh_counts(run_results(t))


@check("a5_status_histogram", "WITH {lv} SELECT CASE WHEN image = '' THEN 'missing' ELSE 'official' END AS status, count(*) AS n FROM lv GROUP BY 1 UNION ALL SELECT 'failure:no_verified_official_image_candidate', count(*) FROM lv WHERE image = ''")
def a5(t):
    rows = listings(t, "image")
    state = enrichment.image_state(F.col("image"), F.when(F.col("image") != "", F.lit("official")), F.lit(""), F.lit(True), F.lit(""))
    stated = rows.select(state.alias("s"))
    labels = F.array_compact(F.array(F.col("s.image_status"), F.when(F.col("s.image_failure_reason") != "", F.concat(F.lit("failure:"), "s.image_failure_reason"))))
    return stated.select(F.explode(labels).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@check("a6_fields_updated", "WITH {lv} SELECT field, count(*) AS n FROM (SELECT 'image' AS field FROM lv WHERE image = '' UNION ALL SELECT 'cost_status' FROM lv WHERE cost_status = 'unknown') GROUP BY 1")
def a6(t):
    rows = listings(t, "image", "cost_status")
    fields = F.array_compact(F.array(F.when(F.col("image") == "", F.lit("image")), F.when(F.col("cost_status") == "unknown", F.lit("cost_status"))))
    return rows.select(F.explode(fields).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


@check("a7_city_facet", f"WITH {{lv}} SELECT city, count(*) AS n FROM lv WHERE {_ACTIVE} GROUP BY 1")
def a7(t):
    return with_activity(t, "city").filter("active").groupBy("city").agg(F.count("*").alias("n")).orderBy("city")


@check("a8_backlog_by_month", "WITH {lv} SELECT left(date_value, 7) AS month, CASE WHEN line % 2 = 0 THEN 'stale' ELSE 'missing' END AS status, count(*) AS n FROM lv GROUP BY 1, 2")
def a8(t):
    rows = listings(t, "date_value", "line")
    return catalog.histogram(rows.select(F.left("date_value", F.lit(7)).alias("month"), F.when(F.col("line") % 2 == 0, F.lit("stale")).otherwise(F.lit("missing")).alias("status")), "month", "status")


@check("a9_image_reuse", "WITH {lv} SELECT image, count(DISTINCT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS titles FROM lv WHERE image <> '' GROUP BY 1")
def a9(t):
    rows = listings(t, "image", "title").filter("image <> ''").select("image", text.title_key("title").alias("title")).distinct()
    return rows.groupBy("image").agg(F.count("*").alias("titles"))


def collection_inputs(t):
    """One collection per region: the references of its suppliers' listings, some of them unknown."""
    rows = listings(t, "region", "city", "date_value", "end_date_value", "line", "quantity")
    resolved = rows.select(F.col("region").alias("slug"), F.col("ord").alias("position"), F.when(F.col("quantity") % 10 != 0, F.col("id")).alias("id"))
    configs = t.region.select(
        F.col("r_name").alias("slug"), (F.col("r_regionkey") != 0).alias("published"), F.lit("1997-01-01T00:00:00").alias("publish_at"),
        F.when(F.col("r_regionkey") == 1, F.lit("1997-06-12")).otherwise(F.lit("1999-12-31")).alias("active_until"),
        F.when(F.col("r_regionkey") == 2, F.lit(100_000_000)).otherwise(F.lit(2)).alias("last_chance"),
    )
    sessions = rows.select("id", "date_value", "end_date_value")
    return configs, resolved, collections.members(resolved, sessions, rows.select("id", "city"), NOW)


_CLOSING = "CASE WHEN end_date_value = '' THEN left(date_value, 10) || 'T23:59:59' WHEN contains(end_date_value, 'T') THEN end_date_value || ':00' ELSE end_date_value || 'T23:59:59' END"
_MEMBERS = f"""WITH {{lv}}, m AS (SELECT region AS slug, city, ord, id, quantity % 10 <> 0 AS known, {_CLOSING} >= '{NOW}' AS current, left(date_value, 10) AS a,
  left({first_nonempty_sql('end_date_value', 'date_value')}, 10) AS b FROM lv)"""


@check(
    "a10_collection_counts",
    _MEMBERS + """, g AS (SELECT slug, count(*) AS selected, count(*) FILTER (WHERE NOT known) AS unresolved, count(*) FILTER (WHERE known) AS resolved,
     count(*) FILTER (WHERE known AND current) AS current, count(*) FILTER (WHERE known AND NOT current) AS expired FROM m GROUP BY 1)
     SELECT slug, CASE slug WHEN 'AFRICA' THEN 'DRAFT' WHEN 'AMERICA' THEN 'ENDED' WHEN 'ASIA' THEN 'LAST_CHANCE' ELSE 'FEATURED' END AS state, selected, unresolved, resolved, current, expired FROM g WHERE true""",
)
def a10(t):
    configs, resolved, members = collection_inputs(t)
    # A region that must read LAST_CHANCE has a threshold between its current and resolved counts.
    counts = members.groupBy("slug").agg(F.count_if("current").alias("n"))
    configs = configs.join(counts, "slug", "left").withColumn("last_chance", F.when(F.col("last_chance") > 2, F.col("n")).otherwise(2)).drop("n")
    return collections.view_model(configs, resolved, members, NOW).drop("span_start", "span_end")


@check("a11_collection_span", _MEMBERS + " SELECT slug, min(a) FILTER (WHERE known AND current) AS span_start, max(b) FILTER (WHERE known AND current) AS span_end FROM m GROUP BY 1")
def a11(t):
    configs, resolved, members = collection_inputs(t)
    return collections.view_model(configs, resolved, members, NOW).select("slug", "span_start", "span_end")


@check("a12_cities_in_order", _MEMBERS + " SELECT slug, city, min(a) AS first_start, arg_min(ord, (a, ord)) AS first_position FROM m WHERE known AND current GROUP BY 1, 2")
def a12(t):
    return collections.cities_in_order(collection_inputs(t)[2])


@check("a13_cover_candidates", "WITH {lv} SELECT source, count(*) AS n FROM lv WHERE image = '' GROUP BY 1")
def a13(t):
    rows = listings(t, "image", "source").filter("image = ''")
    return catalog.histogram(rows, "source").orderBy(F.col("n").desc(), "source")


@check("a14_missing_images_by_source", f"WITH {{lv}} SELECT source, count(*) AS n FROM lv WHERE image = '' AND {day_sql(first_nonempty_sql('end_date_value', 'date_value'))} >= '{TODAY}' GROUP BY 1")
def a14(t):
    rows = listings(t, "image", "source", "date_value", "end_date_value")
    return catalog.histogram(rows.filter(notices.is_fallback_image("image") & dates.is_upcoming("date_value", "end_date_value", TODAY)), "source")


@check("a18_duplicate_catalog_keys", "WITH {lv} SELECT 'part-' || part AS id, count(*) AS n FROM lv GROUP BY 1 HAVING count(*) > 1")
def a18(t):
    rows = listings(t, "part")
    return rows.groupBy(F.concat(F.lit("part-"), F.col("part").cast("string")).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


_A19 = """r AS (SELECT DISTINCT l_suppkey AS s, l_linenumber % 5 * 3 AS lo, l_linenumber % 5 * 3 + l_partkey % 4 AS hi FROM lineitem),
 m AS (SELECT s, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY s ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM r),
 g AS (SELECT s, lo, hi, sum(fresh) OVER (PARTITION BY s ORDER BY lo, hi) AS island FROM m), i AS (SELECT s, island, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY 1, 2)"""


@check("a19_merged_age_ranges", f"WITH {_A19} SELECT s AS supplier, string_agg(lo || '-' || hi, ' ' ORDER BY lo) AS ranges FROM i GROUP BY 1")
def a19(t):
    lo = (F.col("l_linenumber") % 5 * 3).cast("int")
    distinct = t.lineitem.select(F.col("l_suppkey").alias("supplier"), lo.alias("lo"), (lo + F.col("l_partkey") % 4).cast("int").alias("hi")).distinct()
    # At most twenty distinct ranges exist per supplier, so the array is bounded by the age scale.
    merged = distinct.groupBy("supplier").agg(audience.merge_ranges(F.collect_list(F.struct("lo", "hi"))).alias("m"))
    return merged.select("supplier", F.array_join(F.transform("m", lambda r: F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))), " ").alias("ranges"))


_GRADE_TEXTS = ["Grades K-5", "Grades 3 to 5 and grades 1-8", "Grades K-2, grades 6-8", "Grade school", "Grades 2-1", "Grades 4-6, grades 4-6"]
_GRADE_OUT = ["Grades K–5", "Grades 1–8", "Grades K–2 · Grades 6–8", "", "", "Grades 4–6"]


@check("a20_grade_containment", f"SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, {options(_GRADE_OUT, 'l_partkey')} AS label FROM lineitem")
def a20(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    return rows.select("k", "n", "p", audience.age_info(_pick(_GRADE_TEXTS, F.col("p")))["label"].alias("label"))


_COST_PRICE = ["", "$5–$12", "", "", "", "$4–$8", "", "", ""]


@check("a21_price_labels", f"WITH {{lv}} SELECT id, {options(_COST_PRICE, 'part + supp')} AS label, CASE WHEN quantity = 7 THEN '$7' WHEN quantity < 7 THEN '$' || quantity || '–$7' ELSE '$7–$' || quantity END AS prices FROM lv")
def a21(t):
    rows = listings(t, "part", "supp", "quantity")
    prices = F.concat(F.lit("Entry $"), F.col("quantity").cast("string"), F.lit(", members $7"))
    return rows.select("id", commerce.price_label(_pick(COSTS, F.col("part") + F.col("supp"))).alias("label"), commerce.price_label(prices).alias("prices"))


@check("a22_numeric_facts", "WITH {lv} SELECT id, line % 3 <> 0 AS same FROM lv")
def a22(t):
    rows = listings(t, "quantity", "orderkey", "line")
    n, k = F.col("quantity").cast("string"), F.col("orderkey").cast("string")
    en = F.concat(F.lit("Ages "), n, F.lit(" and $ "), k, F.lit(".50"))
    zh = F.concat(F.lit("票价 $"), k, F.lit(".50，"), F.when(F.col("line") % 3 == 0, F.lit("")).otherwise(n), F.lit("岁"))
    return rows.select("id", (translation_qa.sorted_facts(en) == translation_qa.sorted_facts(zh)).alias("same"))


_SUMMARIES = [
    "at the park with friends", "Privacy policy and terms of use apply", "Ages 5 to 9", "An immersive family-friendly experience", "After storytime there are cookies",
    "Annual membership rates are listed", "Back to top", "Build a kite and fly it together", "", "A special guest and a giveaway on June 13 for the festival",
]
_ISSUES = [
    "dependent_prefix_fragment", "legal_copy_only", "audience_copy_only", "generic_experience_without_activity", "secondary_followup_only",
    "administrative_membership_copy", "page_chrome_copy", "", "empty", "limited_subevent_over_parent_overview",
]


@check("a23_semantic_issue_counts", "WITH {lv}, i AS (SELECT " + options(_ISSUES, "part") + " AS issue FROM lv) SELECT issue, count(*) AS n FROM i WHERE issue <> '' GROUP BY 1")
def a23(t):
    rows = listings(t, "part").select(_pick(_SUMMARIES, F.col("part")).alias("s"))
    return rows.select(F.explode(summary.semantic_issues(F.col("s"), F.lit(True))).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


_PUBLISHED = "p AS (SELECT user_id AS key, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY 1)"


@check(
    "a24_zero_output_sources",
    "WITH f AS (SELECT s_suppkey AS s, count(*) AS fetched FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1) SELECT 's-' || s AS source, fetched FROM f WHERE fetched >= 20 AND s % 7 = 0",
)
def a24(t):
    rows = listings(t, "source_id", "supp")
    fetched = rows.groupBy(F.col("source_id").alias("source")).agg(F.count("*").alias("fetched"))
    published = rows.filter("supp % 7 <> 0").groupBy(F.col("source_id").alias("source")).agg(F.count("*").alias("published"))
    return catalog.lost_sources(fetched, published)


def horizon(days: int):
    import datetime as dt

    return (dt.date.fromisoformat(TODAY) + dt.timedelta(days=days)).isoformat()


_LAST = f"left({first_nonempty_sql('end_date_value', 'date_value')}, 10)"
_IN = lambda days: f"left(date_value, 10) <= '{horizon(days)}' AND {_LAST} >= '{TODAY}'"


@check("a25_horizon_counts", f"WITH {{lv}} SELECT source, count(*) FILTER (WHERE {_IN(60)}) AS next60, count(*) FILTER (WHERE {_IN(90)}) AS next90 FROM lv GROUP BY 1")
def a25(t):
    rows = listings(t, "source", "date_value", "end_date_value")
    inside = lambda days: dates.overlaps("date_value", "end_date_value", F.lit(TODAY), F.lit(horizon(days)))
    return rows.groupBy("source").agg(F.count_if(inside(60)).alias("next60"), F.count_if(inside(90)).alias("next90"))


@check("a26_image_coverage", "WITH {lv} SELECT count(*) FILTER (WHERE image <> '') AS official, count(*) FILTER (WHERE image = '' AND line % 2 = 0) AS illustration, count(*) FILTER (WHERE image = '' AND line % 2 <> 0) AS missing FROM lv")
def a26(t):
    rows = listings(t, "image", "line")
    drawn = (F.col("image") == "") & (F.col("line") % 2 == 0)
    return rows.agg(F.count_if(F.col("image") != "").alias("official"), F.count_if(drawn).alias("illustration"), F.count_if((F.col("image") == "") & ~drawn).alias("missing"))


@check("g1_merged_duplicates")
def g1(t):
    """Order-dependent merge of cross-source duplicates; the pairs behind it have their own SQL check."""
    featured = duplicates.match_features(duplicate_rows(t)).withColumn(
        "priority", scoring.organizer_priority("url", "image", "source", "place", F.lit("rss"), "address")
    )
    rows = featured.withColumn("has_image", F.lit(True))
    return duplicates.merge_classes(duplicates.classes(rows, "priority", "has_image"))


@check(
    "e11_duplicate_gap_fill",
    """WITH {lv}, r AS (SELECT *, arg_min(id, (ord, id)) OVER (PARTITION BY series) AS keeper FROM lv), s AS (SELECT keeper, (id <> keeper, ord, id) AS slot, image, end_date_value, cost_status FROM r)
     SELECT keeper AS id, coalesce(arg_min(image, slot) FILTER (WHERE image <> ''), arg_min(image, slot)) AS image,
     coalesce(arg_min(cost_status, slot) FILTER (WHERE cost_status <> 'unknown'), arg_min(cost_status, slot)) AS cost_status, count(*) AS records FROM s GROUP BY keeper""",
)
def e11(t):
    rows = listings(t, "series", "image", "cost_status")
    first = rows.groupBy("series").agg(F.min(F.struct("ord", "id")).alias("k"))
    merged = rows.join(first, "series").select("id", F.col("k.id").alias("keeper"))
    return duplicates.fill_from_duplicates(rows, merged, ["ord", "id"], ["image", "cost_status"], {"cost_status": ["unknown"]})


def scored_input(t, *more):
    rows = listings(t, "title", "description", "source", "place", "address", "date_value", "url", "image", "verified_at", *more)
    facts = rows.withColumn("format", classify.format_of("title")).withColumn("seasonal_theme", classify.season_of("title"))
    facts = facts.withColumn("type", classify.listing_type("format", "title", "title")).withColumn("age", audience.age_info("description"))
    return facts.withColumn("cost_source", F.lit("")).withColumn("cost_label", F.lit(""))


def scored_rows(t):
    return feed.scored(scored_input(t), TODAY)


@check("g2_first_results")
def g2(t):
    return feed.first_results(scored_rows(t))


@check("g2_whole_order")
def g2_whole(t):
    return feed.whole_order(scored_rows(t)).select("id", "position")


@check("g3_edition_picks")
def g3(t):
    return weekend.edition(weekend_rows(t), FRIDAY)
