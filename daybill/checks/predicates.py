"""Row predicates and projections (inventory P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audience, classify, dates, notices, scoring, urls
from ..functions.defaults import text
from ..functions.text import display_label, squeeze
from ..operators import catalog, collections
from ..plans import feed, weekend
from ..plans.listings import ACTIVITIES, listings
from .registry import FRIDAY, NOW, SUNDAY, TODAY, check, day_sql, end_sql, first_nonempty_sql, local_sql, options, q, rx

OVERLAP = lambda a, b, c, d: f"({a} <= {d} AND {b} >= {c})"
START, END = day_sql("date_value"), day_sql(first_nonempty_sql("end_date_value", "date_value"))
WORDS = "lower(title || ' ' || description)"
MINUTES = (
    f"CASE WHEN {rx('lower(title)', dates.STORYTIME_WORDS, False)} THEN 90 WHEN {rx('lower(title)', dates.FESTIVAL_WORDS, False)} THEN 480 ELSE 240 END"
)


@check("p1_upcoming_by_end_day", f"WITH {{lv}} SELECT id, date_value, end_date_value FROM lv WHERE {END} >= '{TODAY}'")
def p1(t):
    rows = listings(t, "date_value", "end_date_value")
    return rows.filter(dates.is_upcoming("date_value", "end_date_value", TODAY)).select("id", "date_value", "end_date_value")


@check(
    "p2_still_active",
    f"WITH {{lv}}, e AS (SELECT id, {end_sql('date_value', 'end_date_value', MINUTES)} AS effective_end FROM lv) "
    f"SELECT id, effective_end FROM e WHERE effective_end > '{NOW}'",
)
def p2(t):
    rows = listings(t, "title", "date_value", "end_date_value")
    minutes = dates.fallback_minutes(F.lit("program"), "title", F.lit(""))
    ends = rows.withColumn("effective_end", dates.effective_end("date_value", "end_date_value", minutes))
    return ends.filter(dates.is_active("effective_end", NOW)).select("id", "effective_end")


@check(
    "p3_current_sessions",
    f"""WITH {{lv}}, e AS (SELECT id, date_value, end_date_value, CASE WHEN end_date_value <> '' THEN
      {local_sql('end_date_value', "NOT regexp_matches(end_date_value, '[T ][0-9]{2}:[0-9]{2}')")}
      ELSE left(date_value, 10) || 'T23:59:59' END AS closing FROM lv) SELECT id, date_value, end_date_value FROM e WHERE closing >= '{NOW}'""",
)
def p3(t):
    rows = listings(t, "date_value", "end_date_value")
    return rows.filter(dates.is_current("date_value", "end_date_value", NOW)).select("id", "date_value", "end_date_value")


@check("p4_range_overlap", f"WITH {{lv}} SELECT id FROM lv WHERE {OVERLAP(START, END, q(FRIDAY), q(SUNDAY))}")
def p4(t):
    rows = listings(t, "date_value", "end_date_value")
    return rows.filter(dates.overlaps("date_value", "end_date_value", F.lit(FRIDAY), F.lit(SUNDAY))).select("id")


_P5 = {"today": (TODAY, TODAY), "weekend": ("1997-06-14", "1997-06-15"), "month": ("1997-06-01", "1997-06-30"), "1997-07-04": ("1997-07-04", "1997-07-04")}


@check(
    "p5_feed_date_filters",
    "WITH {lv}, f(kind, a, b) AS (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in _P5.items()) + ", ('all', '', '9999')) "
    f"SELECT kind, count(*) AS n FROM lv, f WHERE {OVERLAP(START, END, 'a', 'b')} GROUP BY kind",
)
def p5(t):
    rows = listings(t, "date_value", "end_date_value")
    kinds = [*_P5, "all"]
    hits = F.array_compact(F.array(*[F.when(feed.date_matches(k, "date_value", "end_date_value", TODAY), F.lit(k)) for k in kinds]))
    return rows.select(F.explode(hits).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@check(
    "p6_child_age_match",
    """WITH {lv}, a AS (SELECT supp % 10 AS k, count(*) AS n FROM lv GROUP BY 1), r(k, lo, hi, fam) AS (VALUES
     (0, 5, 12, false), (1, 0, 18, true), (2, 5, 10, false), (3, 1, 5, false), (4, 6, 18, false), (5, NULL, NULL, true), (6, 4, 8, false),
     (7, NULL, NULL, false), (8, 13, 18, false), (9, NULL, NULL, false))
     SELECT age, CAST(sum(n) AS BIGINT) AS n FROM a JOIN r USING (k), (VALUES (3), (7), (15)) AS c(age)
     WHERE CASE WHEN lo IS NULL THEN fam ELSE age BETWEEN lo AND hi END GROUP BY age""",
)
def p6(t):
    rows = listings(t, "supp")
    from ..plans.listings import AUDIENCES, _pick

    info = rows.select(audience.age_info(_pick(AUDIENCES, F.col("supp"))).alias("i"))
    match = lambda age: audience.age_matches(age, F.col("i"))
    hits = F.array_compact(F.array(*[F.when(match(a), F.lit(a)) for a in (3, 7, 15)]))
    return info.select(F.explode(hits).alias("age")).groupBy("age").agg(F.count("*").alias("n"))


@check(
    "p7_search_terms",
    "WITH {lv} SELECT id, title FROM lv WHERE contains(lower(title || ' ' || description || ' ' || place || ' ' || city), 'ring') "
    "AND contains(lower(title || ' ' || description || ' ' || place || ' ' || city), 'halloween')",
)
def p7(t):
    rows = listings(t, "title", "description", "place", "city")
    return rows.filter(feed.search_matches("Ring  halloween", ["title", "description", "place", "city"])).select("id", "title")


def type_case(body: str = "lower(title)", title: str = "lower(title)", version: str = "v2") -> str:
    m = lambda p, on=body: rx(on, p, False)
    tail = (
        f"WHEN {m(classify.PLAY)} THEN 'play' WHEN {m(classify.LEGO)} AND NOT {m(classify.LEGO_STRUCTURED)} THEN 'play' "
        f"WHEN {m(classify.FINE_ART)} AND NOT {m(classify.STEM_SUBJECT)} THEN 'arts' WHEN {m(classify.CREATIVE)} AND NOT {m(classify.LEARNING)} THEN 'arts' "
        f"WHEN {m(classify.LEARNING)} THEN 'learning' WHEN {m(classify.CLASSES)} THEN 'workshops' WHEN {m(classify.GAMES)} THEN 'play' ELSE 'community' END"
    )
    if version == "v1":
        return (
            f"CASE WHEN {m(classify.SPORTS)} THEN 'sports' WHEN {m(classify.SHOWS)} THEN 'shows' WHEN {m(classify.MUSEUMS)} THEN 'museums' "
            f"WHEN {m(classify.SERVICE_V1)} THEN 'community' WHEN {m(classify.OUTDOOR)} THEN 'outdoor' " + tail
        )
    return (
        f"CASE WHEN {m(classify.SPORTS)} THEN 'sports' WHEN {m(classify.CELEBRATION)} THEN 'community' WHEN {m(classify.SHOWS)} THEN 'shows' "
        f"WHEN {m(classify.MUSEUMS)} THEN 'museums' WHEN {m(classify.OUTDOOR)} THEN 'outdoor' WHEN {m(classify.SERVICE)} THEN 'community' "
        f"WHEN {m(classify.FINE_ART, title)} AND NOT {m(classify.STEM_SUBJECT, title)} THEN 'arts' " + tail
    )


def format_case(body: str = "lower(title)") -> str:
    m = lambda p: rx(body, p, False)
    return (
        f"CASE WHEN {m(classify.SPORTS)} THEN 'sports-game' WHEN {m(classify.FESTIVAL_FORMAT)} THEN 'festival' "
        f"WHEN {m(classify.MUSEUM_FORMAT)} AND {m(classify.MUSEUM_PROGRAM)} THEN 'museum-program' WHEN {m(classify.EXHIBITION)} THEN 'museum-exhibition' "
        f"WHEN {m(classify.LIVE_SHOW)} THEN 'live-show' ELSE 'program' END"
    )


def listing_type_case() -> str:
    return f"CASE WHEN {format_case()} = 'live-show' THEN 'shows' ELSE {type_case()} END"


@check(
    "p8_feed_conjunction",
    f"""WITH {{lv}}, e AS (SELECT *, {end_sql('date_value', 'end_date_value', MINUTES)} AS effective_end FROM lv)
     SELECT id, title FROM e WHERE effective_end > '{NOW}' AND {OVERLAP(START, END, q('1997-06-01'), q('1997-06-30'))}
     AND {listing_type_case()} = 'community' AND contains(lower(title || ' ' || description), 'ring')
     AND supp % 10 IN (0, 1, 2, 4, 5, 6)""",
)
def p8(t):
    rows = listings(t, "title", "description", "place", "address", "city", "source", "date_value", "end_date_value")
    facts = rows.withColumn("format", classify.format_of("title")).withColumn("type", classify.listing_type("format", "title", "title"))
    facts = facts.withColumn("age", audience.age_info("description"))
    minutes = dates.fallback_minutes(F.lit("program"), "title", F.lit(""))
    facts = facts.withColumn("effective_end", dates.effective_end("date_value", "end_date_value", minutes))
    return feed.visible(facts, feed.FeedQuery(text="ring", type="community", age=7, date="month"), NOW).select("id", "title")


@check(
    "p8_feed_of_sessions",
    f"""WITH {{lv}}, s AS (SELECT *, {end_sql('date_value', 'end_date_value', '240')} AS effective_end FROM lv),
     m AS (SELECT * FROM s WHERE effective_end > '{NOW}' AND {OVERLAP(START, END, q('1997-06-01'), q('1997-06-30'))} AND part % 3 = 0 AND contains(lower(title || ' ' || description || ' ' || place || ' ' || address || ' ' || city || ' ' || source), 'ring')),
     b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY series ORDER BY date_value, id) = 1)
     SELECT series AS card_id, id AS session_id, row_number() OVER (ORDER BY date_value, title, series) AS place FROM b""",
)
def p8_sessions(t):
    """Saved series by their first active session of the month, by date."""
    rows = listings(t, "title", "description", "place", "address", "city", "source", "date_value", "end_date_value", "series", "part")
    cards = rows.groupBy(F.col("series").alias("card_id")).agg(*[F.first(c).alias(c) for c in ("title", "description", "place", "address", "city", "source")])
    sessions = rows.select(F.col("series").alias("card_id"), F.col("id").alias("session_id"), "date_value", "end_date_value", dates.effective_end("date_value", "end_date_value", F.lit(240)).alias("effective_end"), F.lit("program").alias("format"))
    saved = rows.filter("part % 3 = 0").select(F.col("series").alias("id"))
    query = feed.FeedQuery(text="ring", date="month", sort="date", saved=True)
    return feed.feed_cards(cards, sessions, query, NOW, saved).select("card_id", "session_id", F.col("place").cast("long").alias("place"))


_ADULT = (
    f"({rx('description', audience.ADULT_ONLY)} AND NOT {rx('description', audience.CHILD_AUDIENCE)})"
)


@check(
    "p9_family_relevance",
    f"""WITH {{lv}} SELECT {rx('description', audience.CHILD_AUDIENCE)} AS child_audience, {_ADULT} AS adult_only,
     NOT {_ADULT} AND NOT {rx(WORDS, audience.CLINICAL, False)} AS relevant, count(*) AS n FROM lv GROUP BY 1, 2, 3""",
)
def p9(t):
    rows = listings(t, "description")
    flags = rows.select(
        audience.has_child_audience("description").alias("child_audience"), audience.is_adult_only("description").alias("adult_only"),
        audience.is_family_relevant(F.lit(""), "description", F.lit(""), F.lit(None), F.lit(None)).alias("relevant"),
    )
    return catalog.histogram(flags, "child_audience", "adult_only", "relevant")


@check(
    "p10_unavailable",
    f"""WITH {{lv}}, w AS (SELECT id, title || ' ' || description || CASE WHEN line = 2 THEN ' waitlist' ELSE '' END AS body FROM lv)
     SELECT id FROM w WHERE {rx('body', notices.GONE)} AND NOT {rx('body', notices.STILL_LISTED)}""",
)
def p10(t):
    rows = listings(t, "title", "description", "line")
    extra = F.when(F.col("line") == 2, F.lit("waitlist")).otherwise(F.lit(""))
    return rows.filter(notices.is_unavailable(["title", "description", extra])).select("id")


NOTICES = [
    "Library closed for the holiday", "Museum open", "Museum open house tour", "One-on-one tech help", "Reading buddies", "Homework help",
    "Holiday hours", "Visitor center closes early", "Grand rounds for physicians", "Reading buddies with dogs", "Family craft day", "Math club",
]


def _notice(t, *wanted):
    rows = listings(t, "part", *wanted)
    from ..plans.listings import _pick

    return rows.withColumn("notice", _pick(NOTICES, F.col("part")))


_NOTICE_SQL = f"WITH {{lv}}, n AS (SELECT *, {options(NOTICES, 'part')} AS notice FROM lv) "


@check(
    "p11_closure_notice",
    _NOTICE_SQL + f"SELECT id, notice FROM n WHERE {rx('notice', notices.CLOSURE_TITLE)} OR {rx('notice', notices.CLOSURE_VENUE)} "
    f"OR {rx('description', notices.CLOSURE_DETAIL)}",
)
def p11(t):
    return _notice(t, "description").filter(notices.is_closure_notice("notice", "description")).select("id", "notice")


@check("p12_routine_access", _NOTICE_SQL + "SELECT id, notice FROM n WHERE notice = 'Museum open'")
def p12(t):
    return _notice(t).filter(notices.is_routine_access("notice")).select("id", "notice")


@check("p13_support_service", _NOTICE_SQL + "SELECT notice, count(*) AS n FROM n WHERE notice IN ('One-on-one tech help', 'Reading buddies', 'Homework help') GROUP BY 1")
def p13(t):
    rows = _notice(t).withColumn("detail", F.lit("Practice together"))
    return catalog.histogram(rows.filter(notices.is_support_service("notice", "detail")), "notice")


@check(
    "p14_professional_only",
    _NOTICE_SQL + f"SELECT id, notice FROM n WHERE {rx('notice', notices.PROFESSIONAL_ONLY)} AND NOT {rx('description', notices.EXPLICIT_FAMILY)}",
)
def p14(t):
    rows = _notice(t, "description")
    return rows.filter(notices.is_professional_only(["notice", "description"], [])).select("id", "notice")


@check("p16_publishing_horizon", "WITH {lv} SELECT id, day FROM lv WHERE date_diff('day', DATE '1997-06-13', CAST(day AS DATE)) BETWEEN 0 AND 180")
def p16(t):
    rows = listings(t, "day")
    return rows.filter(F.date_diff(F.to_date("day"), F.lit(TODAY)).between(0, 180)).select("id", "day")


_LINK_STATUS = "(['ok', 'redirected', 'blocked-machine', 'not-found'])[line % 4 + 1]"


def weekend_rows(t, *more):
    """Listings as weekend candidates: link state and translation derived from the row."""
    rows = listings(t, "title", "description", "source", "place", "city", "date_value", "end_date_value", "url", "cost_status", "line", "quantity", *more)
    link = F.element_at(F.array(*[F.lit(s) for s in ("ok", "redirected", "blocked-machine", "not-found")]), (F.col("line") % 4 + 1).cast("int"))
    return (
        rows.withColumn("link_status", link)
        .withColumn("type", classify.type_of("title", "title"))
        .withColumn("seasonal_theme", classify.season_of("title"))
        .withColumn("age_label", audience.age_info("description")["label"])
        .withColumn("ongoing", F.lit(False)).withColumn("availability", F.lit(""))
        .withColumn("zh_description", F.when(F.col("quantity") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("亲子活动 "), "title")))
    )


CANDIDATE_WHERE = f"""{_LINK_STATUS} IN ('ok', 'redirected') AND NOT {rx('title', scoring.WEEKEND_BANNED)} AND NOT {rx('title', scoring.WEEKEND_POOR)}
 AND {OVERLAP('left(date_value, 10)', 'left(' + first_nonempty_sql('end_date_value', 'date_value') + ', 10)', q(FRIDAY), q(SUNDAY))}
 AND length(description) BETWEEN 45 AND 1100 AND quantity % 5 <> 0
 AND ({rx("title || ' ' || description", scoring.WEEKEND_FAMILY)} OR {rx("title || ' ' || description", scoring.WEEKEND_FOCUS)}
  OR {type_case()} IN ('sports', 'arts') OR supp % 10 IN (0, 1, 3, 4, 5, 6, 8))"""


@check("p17_weekend_candidates", f"WITH {{lv}} SELECT id, title FROM lv WHERE {CANDIDATE_WHERE}")
def p17(t):
    return weekend.candidates(weekend_rows(t), FRIDAY).select("id", "title")


@check(
    "p18_series_overlaps_weekend",
    f"""WITH {{lv}} SELECT source_id, bool_or(left(date_value, 10) BETWEEN '{FRIDAY}' AND '{SUNDAY}')
     OR (min(left(date_value, 10)) <= '{SUNDAY}' AND max({END}) >= '{FRIDAY}') AS in_weekend FROM lv GROUP BY 1""",
)
def p18(t):
    rows = listings(t, "source_id", "date_value", "end_date_value")
    inside = dates.day10("date_value").between(FRIDAY, SUNDAY)
    spans = rows.groupBy("source_id").agg(
        F.bool_or(inside).alias("inside"), F.min(dates.day10("date_value")).alias("a"),
        F.max(dates.day_key(F.coalesce(F.nullif("end_date_value", F.lit("")), F.col("date_value")))).alias("b"),
    )
    return spans.select("source_id", collections.overlaps_weekend(F.col("a"), F.col("b"), F.lit(False), F.col("inside"), FRIDAY, SUNDAY).alias("in_weekend"))


@check("p19_public_columns", "WITH {lv} SELECT id, title FROM lv")
def p19(t):
    rows = listings(t, "title", "url")
    return catalog.public_columns(rows.withColumnRenamed("url", "canonical_url").withColumn("link_status", F.lit("ok"))).drop("ord")


@check(
    "p20_excluded_by_source",
    "WITH {lv} SELECT id, title FROM lv WHERE NOT (supp % 3 = 0 AND regexp_matches(lower(title), '^(hot|cold) ring'))",
)
def p20(t):
    rows = listings(t, "title", "source")
    pattern = F.when(F.col("s_suppkey") % 3 == 0, F.lit("^(hot|cold) ring")).otherwise(F.lit(""))
    registry = t.supplier.select(F.col("s_name").alias("source"), pattern.alias("pattern"))
    return catalog.excluded_by_source(rows, registry).select("id", "title")


@check(
    "p21_presentation",
    "WITH {lv}, k AS (SELECT " + listing_type_case() + " AS type FROM lv), s(type, label, icon) AS (VALUES "
    + ", ".join(f"({q(r[0])}, {q(r[1])}, {q(r[3])})" for r in classify.TYPE_STYLE)
    + ") SELECT type, label, icon, count(*) AS n FROM k JOIN s USING (type) GROUP BY ALL",
)
def p21(t):
    rows = listings(t, "title").withColumn("format", classify.format_of("title"))
    rows = rows.select(classify.listing_type("format", "title", "title").alias("type"))
    return catalog.histogram(rows.withColumn("label", classify.style_of("type", 1)).withColumn("icon", classify.style_of("type", 3)), "type", "label", "icon")


@check("p22_older_taxonomy", f"WITH {{lv}} SELECT {type_case(version='v1')} AS type, count(*) AS n FROM lv GROUP BY 1")
def p22(t):
    return catalog.histogram(listings(t, "title").select(classify.type_of("title", "title", "v1").alias("type")), "type")


@check("p23_evidence_label", "WITH {lv} SELECT id, CASE WHEN line % 2 = 0 THEN trim(' ' || place || ' ') ELSE '' END AS label FROM lv")
def p23(t):
    rows = listings(t, "place", "line")
    evidence = F.when(F.col("line") % 2 == 0, F.lit("organizer")).otherwise(F.lit(""))
    return rows.select("id", display_label(F.concat(F.lit(" "), "place", F.lit(" ")), evidence).alias("label"))


@check(
    "p24_outbound_urls",
    f"""SELECT page_id, regexp_matches(url, '^https?://') AND NOT regexp_matches(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''),
      {q('(?i)' + urls.API_PATH)}) AS user_facing,
     CASE WHEN lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) <> 'm.ththth.example.net' THEN url ELSE '' END AS outbound FROM pages""",
)
def p24(t):
    return t.pages.select("page_id", urls.user_facing("url").alias("user_facing"), urls.safe_outbound("url", "m.ththth.example.net").alias("outbound"))


_BIO = "(['Subscribe to our newsletter.', 'The pianist studied in Vienna.', 'Parking is behind the hall.', 'Paint a kite with us.'])[doc_id % 4 + 1]"


@check(
    "p25_non_activity_summary",
    f"WITH s AS (SELECT doc_id, lower({_BIO} || ' ' || coalesce(text, '')) AS v FROM documents) SELECT doc_id, "
    + " OR ".join(rx("v", p, False) for p in notices.NOT_AN_ACTIVITY) + " AS non_activity FROM s",
)
def p25(t):
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("Subscribe to our newsletter.", "The pianist studied in Vienna.", "Parking is behind the hall.", "Paint a kite with us.")]),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    return t.documents.select("doc_id", notices.is_non_activity(F.concat(lead, F.lit(" "), F.coalesce("text", F.lit("")))).alias("non_activity"))


@check(
    "p26_fallback_image_review",
    f"WITH {{lv}} SELECT id, image FROM lv WHERE {END} >= '{TODAY}' AND (image = '' OR contains(image, 'default-image'))",
)
def p26(t):
    rows = listings(t, "date_value", "end_date_value", "image")
    return rows.filter(dates.is_upcoming("date_value", "end_date_value", TODAY) & notices.is_fallback_image("image")).select("id", "image")


@check("p27_active_for_translation", f"WITH {{lv}} SELECT id FROM lv WHERE left({first_nonempty_sql('end_date_value', 'date_value')}, 10) >= '{TODAY}'")
def p27(t):
    rows = listings(t, "date_value", "end_date_value")
    last = dates.day10(F.coalesce(F.nullif("end_date_value", F.lit("")), F.col("date_value")))
    return rows.filter((last == "") | (last >= TODAY)).select("id")
