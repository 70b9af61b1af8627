"""Classification, scores, extraction and evidence (C, K, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import audience, classify, commerce, dates, scoring, summary, text, urls
from ..functions.defaults import first_nonempty
from ..operators import enrichment, links, series
from ..plans import feed, weekend
from ..plans.listings import _pick, listings
from .aggregates import scored_input, scored_rows
from .functions import _HOST, _KEY, _PATH, plain_sql, tokens_sql
from .predicates import CANDIDATE_WHERE, format_case, listing_type_case, type_case, weekend_rows
from .registry import FRIDAY, NOW, TODAY, check, first_nonempty_sql, options, q, rx


@check("c1_type", f"WITH {{lv}} SELECT id, {type_case('lower(title || chr(32) || description)')} AS type FROM lv")
def c1(t):
    return listings(t, "title", "description").select("id", classify.type_of(F.concat_ws(" ", "title", "description"), "title").alias("type"))


@check("c2_format", f"WITH {{lv}} SELECT id, {format_case()} AS format FROM lv")
def c2(t):
    return listings(t, "title").select("id", classify.format_of("title").alias("format"))


@check(
    "c3_season",
    f"WITH {{lv}} SELECT id, CASE WHEN {rx('lower(title)', classify.MID_AUTUMN, False)} THEN 'mid-autumn' WHEN {rx('lower(title)', classify.DAY_OF_THE_DEAD, False)} THEN 'dia-de-muertos' "
    f"WHEN {rx('lower(title)', classify.HALLOWEEN, False)} THEN 'halloween' ELSE '' END AS season FROM lv",
)
def c3(t):
    return listings(t, "title").select("id", classify.season_of("title").alias("season"))


_AGE = [
    # label, min, max, family friendly: what each audience sentence of the listing view says
    ("Ages 5–12", 5, 12, False), ("All ages", 0, 18, True), ("Grades K–5", 5, 10, False), ("Ages 1–5", 1, 5, False), ("Ages 6+", 6, 18, False),
    ("Family-friendly", None, None, True), ("Ages 4–8", 4, 8, False), ("", None, None, False), ("Ages 13–18", 13, 18, False), ("", None, None, False),
]


@check(
    "c4_age_info",
    "WITH {lv}, a(k, age_label, age_min, age_max) AS (VALUES " + ", ".join(f"({i}, {q(r[0])}, {r[1] if r[1] is not None else 'NULL'}, {r[2] if r[2] is not None else 'NULL'})" for i, r in enumerate(_AGE))
    + ") SELECT id, age_label, CAST(age_min AS INTEGER) AS age_min, CAST(age_max AS INTEGER) AS age_max FROM lv JOIN a ON k = supp % 10",
)
def c4(t):
    info = listings(t, "description").select("id", audience.age_info("description").alias("i"))
    return info.select("id", F.col("i.label").alias("age_label"), "i.age_min", "i.age_max")


_C5 = [
    # cost status and registration status of each cost sentence of the listing view
    ("free", "unknown"), ("paid", "unknown"), ("donation", "unknown"), ("unknown", "required"), ("unknown", "not-required"), ("variable", "unknown"), ("unknown", "unknown"),
    ("unknown", "walk-in"), ("unknown", "unknown"),
]


@check(
    "c5_cost_info",
    "WITH {lv}, c(k, cost_status, registration_status) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_C5))
    + ") SELECT id, c.cost_status, registration_status FROM lv JOIN c ON k = (part + supp) % 9",
)
def c5(t):
    info = listings(t, "description").select("id", commerce.cost_info(F.lit(""), "description").alias("i"))
    return info.select("id", "i.cost_status", "i.registration_status")


_MOVIES = ["Toy Story night", "Quiet drama", "All Wishes Come True", "Moana sing-along", "Noir classics"]
_RATINGS = ["G", "PG", "pg-13", "R", "nr", ""]


@check(
    "c6_movie_policy",
    f"""SELECT p_partkey, CASE WHEN rating = 'G' THEN true WHEN rating IN ('PG', 'PG13', 'NR', '') THEN movie IN ('Toy Story night', 'All Wishes Come True', 'Moana sing-along') ELSE false END AS kid_friendly, rating,
     CASE WHEN movie = 'All Wishes Come True' THEN {q(classify.MOVIE_BLURBS[5][1])} ELSE '' END AS blurb
     FROM (SELECT p_partkey, {options(_MOVIES, 'p_partkey')} AS movie, upper(replace({options(_RATINGS, 'p_size')}, '-', '')) AS rating FROM part)""",
)
def c6(t):
    movie, rating = _pick(_MOVIES, F.col("p_partkey")), _pick(_RATINGS, F.col("p_size"))
    return t.part.select(
        "p_partkey", classify.kid_appropriate(movie, rating, F.lit("")).alias("kid_friendly"), classify.movie_rating(rating).alias("rating"), classify.movie_blurb(movie).alias("blurb")
    )


def any_sql(value: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({value}, {q(x)})" for x in terms) + ")"


def _label_sql(kind: str) -> str:
    return "CASE " + kind + " " + " ".join(f"WHEN {q(r[0])} THEN {q(r[1])}" for r in classify.TYPE_STYLE) + " END"


_BODY = (
    "trim(regexp_replace(lower(title || ' ' || description || ' ' || " + _label_sql("type") + " || ' ' || format || ' ' || season), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"
)
_BODY = _BODY.replace("{{", "{").replace("}}", "}")
_SCORE_BASE = f"""WITH {{lv}}, k AS (SELECT *, {format_case()} AS format, {listing_type_case()} AS type, CASE WHEN {rx('lower(title)', classify.HALLOWEEN, False)} THEN 'halloween' ELSE '' END AS season FROM lv),
 b AS (SELECT *, {_BODY} AS body FROM k),
 e AS (SELECT *, CASE WHEN {any_sql('body', classify.STORYTIME_TERMS)} THEN 'storytime' WHEN {any_sql('body', classify.HOMEWORK_TERMS)} THEN 'homework'
  WHEN format = 'festival' OR {any_sql('body', classify.FESTIVAL_TERMS)} THEN 'festival' WHEN season <> '' OR {any_sql('body', classify.SEASONAL_TERMS)} THEN 'seasonal'
  WHEN {any_sql('body', classify.ANIMAL_TERMS)} THEN 'animal' WHEN {any_sql('body', classify.RIDE_TERMS)} THEN 'ride' WHEN type = 'outdoor' OR {any_sql('body', classify.NATURE_TERMS)} THEN 'nature'
  WHEN {any_sql('body', classify.CONCERT_TERMS)} THEN 'concert' WHEN format = 'live-show' OR type = 'shows' OR {any_sql('body', classify.PERFORMANCE_TERMS)} THEN 'performance'
  WHEN format IN ('museum-exhibition', 'museum-program') OR type = 'museums' THEN 'museum' WHEN {any_sql('body', classify.CULTURAL_TERMS)} THEN 'cultural'
  WHEN type = 'workshops' OR {any_sql('body', classify.WORKSHOP_TERMS)} THEN 'workshop' WHEN type = 'learning' OR {any_sql('body', classify.STEM_TERMS)} THEN 'stem'
  WHEN format = 'sports-game' OR type = 'sports' THEN 'sports' WHEN type = 'arts' OR {any_sql('body', classify.CRAFT_TERMS)} THEN 'craft' WHEN {any_sql('body', classify.MEETUP_TERMS)} THEN 'meetup'
  WHEN type IN ('community', 'play') THEN 'community' ELSE 'default' END AS experience,
  CASE WHEN {any_sql('body', classify.ANNUAL_TERMS)} THEN 'annual' WHEN season <> '' OR {any_sql('body', classify.SEASON_FREQUENCY_TERMS)} THEN 'seasonal' WHEN {any_sql('body', classify.WEEKLY_TERMS)} THEN 'weekly'
   WHEN format = 'sports-game' THEN 'one-time' WHEN format = 'festival' OR {any_sql('body', classify.ONE_TIME_TERMS)} THEN 'one-time' ELSE 'unknown' END AS frequency,
  least(10, CASE WHEN {any_sql('body', ['animal', 'wildlife', 'petting zoo'])} THEN 3 ELSE 0 END + CASE WHEN {any_sql('body', ['ride', 'train', 'monster truck', 'ice show'])} THEN 3 ELSE 0 END
   + CASE WHEN format = 'live-show' OR {any_sql('body', ['performance', 'concert', 'theater', 'theatre', 'show'])} THEN 2 ELSE 0 END + CASE WHEN {any_sql('body', ['hands on', 'hands-on', 'interactive', 'workshop'])} THEN 2 ELSE 0 END
   + CASE WHEN {any_sql('body', ['craft', 'make your own', 'maker'])} THEN 2 ELSE 0 END + CASE WHEN type = 'outdoor' OR {any_sql('body', ['nature', 'hike', 'bird walk', 'ranger'])} THEN 2 ELSE 0 END
   + CASE WHEN {any_sql('body', ['water', 'splash', 'pool', 'playground', 'play area'])} THEN 2 ELSE 0 END + CASE WHEN format = 'festival' OR {any_sql('body', ['festival', 'fair', 'carnival'])} THEN 2 ELSE 0 END
   + CASE WHEN {any_sql('body', ['character', 'costume', 'princess', 'superhero'])} THEN 2 ELSE 0 END) AS appeal FROM b),
 s AS (SELECT *, frequency IN ('annual', 'seasonal') OR format = 'festival' OR {any_sql('body', classify.SPECIAL_TERMS)} AS special FROM e),
 d AS (SELECT *, CASE WHEN {any_sql('body', classify.BACKGROUND_TERMS)} THEN 'background' WHEN special OR experience IN ({', '.join(q(x) for x in classify.OUTING_EXPERIENCES)})
  OR (experience = 'workshop' AND appeal >= 2 AND (supp % 10 IN (0, 1, 2, 3, 4, 5, 6) OR {any_sql('body', classify.CHILD_TERMS)})) OR (type = 'play' AND appeal >= 2) THEN 'outing' ELSE 'everyday' END AS tier,
  date_diff('day', DATE '{TODAY}', CAST(day AS DATE)) AS days, isodow(CAST(day AS DATE)) AS dow, supp % 10 NOT IN (7, 9) AS evidence,
  date_diff('day', CAST(verified_at AS DATE), DATE '{TODAY}') AS age FROM s)"""
_LOOK = lambda col, table, other: f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + f" ELSE {other} END"
_TIME = "CASE WHEN days < 0 THEN -1000 WHEN days = 0 THEN 22 WHEN days = 1 THEN 19 WHEN days <= 3 THEN 16 WHEN days <= 7 THEN CASE WHEN dow IN (6, 7) THEN 14 ELSE 12 END WHEN days <= 14 THEN 9 WHEN days <= 30 THEN 5 WHEN days <= 60 THEN 4 WHEN days <= 90 THEN -2 ELSE -45 END"
_QUALITY = "CASE WHEN image <> '' THEN 1 ELSE 0 END + CASE WHEN length(description) >= 40 THEN 2 ELSE 0 END + CASE WHEN evidence THEN 2 ELSE 0 END + 3 + 3 + 1 + CASE WHEN age <= 14 THEN 2 WHEN age > 30 THEN -4 ELSE 0 END"
_RELIABLE = (
    "CASE WHEN NOT evidence THEN -8 ELSE 0 END + CASE WHEN length(description) < 40 THEN -20 ELSE 0 END "
    f"+ CASE WHEN {any_sql('body', scoring.CANCELLED_TERMS)} THEN -1000 WHEN {any_sql('body', scoring.SOLD_OUT_TERMS)} THEN -30 ELSE 0 END + CASE WHEN age > 30 THEN -8 WHEN age > 14 THEN -4 ELSE 0 END"
)
_SPOT = "days BETWEEN 0 AND 3 AND dow IN (5, 6, 7) AND special AND appeal >= 4 AND length(description) >= 40"
_SCORE = (
    f"appeal + {_LOOK('tier', scoring.TIER_POINTS, 0)} + {_LOOK('experience', scoring.EXPERIENCE_POINTS, 8)} + {_LOOK('frequency', scoring.RECURRENCE_POINTS, 3)} + {_TIME} + {_QUALITY} + {_RELIABLE} "
    f"+ CASE WHEN {_SPOT} THEN 32 ELSE 0 END"
)


@check("c7_experience_kind", _SCORE_BASE + " SELECT id, experience FROM d")
def c7(t):
    return scored_rows(t).select("id", "experience")


@check("c8_frequency", _SCORE_BASE + " SELECT id, frequency FROM d")
def c8(t):
    return scored_rows(t).select("id", "frequency")


@check("c9_discovery_tier", _SCORE_BASE + f" SELECT id, tier, type = 'learning' OR {any_sql('body', classify.LEARNING_TERMS)} AS learning FROM d")
def c9(t):
    return scored_rows(t).select("id", "tier", "learning")


@check("k1_recommendation_score", _SCORE_BASE + f" SELECT id, CAST({_SCORE} AS BIGINT) AS score FROM d")
def k1(t):
    return scored_rows(t).select("id", F.col("score").cast("long").alias("score"))


@check(
    "k2_score_components",
    _SCORE_BASE + f" SELECT id, CAST(appeal AS BIGINT) AS appeal, CAST({_TIME} AS BIGINT) AS time_points, CAST({_QUALITY} AS BIGINT) AS quality_points, CAST({_RELIABLE} AS BIGINT) AS reliability_points FROM d",
)
def k2(t):
    return scored_rows(t).select("id", *[F.col(x).cast("long").alias(x) for x in ("appeal", "time_points", "quality_points", "reliability_points")])


@check(
    "k3_readiness_and_badge",
    _SCORE_BASE + f" SELECT id, length(description) >= 40 AND evidence AS ready, CASE WHEN {_SPOT} THEN 'weekend-spotlight' WHEN special THEN 'special-event' ELSE '' END AS badge FROM d",
)
def k3(t):
    return scored_rows(t).select("id", "ready", "badge")


@check("k4_ranking_series_key", _SCORE_BASE + f" SELECT id, CASE WHEN frequency = 'weekly' THEN 'fallback:' || {_KEY} || '::' || trim(regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g')) ELSE '' END AS series FROM d")
def k4(t):
    return scored_rows(t).select("id", "series")


_PICKED = f"(line % 3 = 0 AND line % 2 = 0 AND day >= '{TODAY}')"


def editorial_rows(t):
    """Rows of which some are picked by an editor, with and without a reason, until their day; some name their series."""
    rows = scored_input(t, "day", "line")
    return rows.withColumns({
        "editor_pick": F.col("line") % 3 == 0, "editor_pick_until": F.col("day"), "editor_pick_reason": F.when(F.col("line") % 2 == 0, F.lit("Rare.")).otherwise(F.lit(" ")),
        "series_id": F.when(F.col("line") == 1, F.lit("")), "recurring_id": F.when(F.col("line") == 2, F.lit("Weekly-Fair No.2")).otherwise(F.lit("")),
    })


@check(
    "k3_editor_picks",
    _SCORE_BASE + f""" SELECT id, CAST({_SCORE} + CASE WHEN {_PICKED} THEN {scoring.EDITOR_POINTS} ELSE 0 END AS BIGINT) AS score,
     CASE WHEN {_PICKED} THEN 'top-pick' WHEN {_SPOT} THEN 'weekend-spotlight' WHEN special THEN 'special-event' ELSE '' END AS badge,
     CASE WHEN line = 2 THEN 'id:weekly fair no 2' WHEN frequency = 'weekly' THEN 'fallback:' || {_KEY} || '::' || trim(regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g')) ELSE '' END AS series FROM d""",
)
def k3_editor(t):
    return feed.scored(editorial_rows(t), TODAY).select("id", F.col("score").cast("long").alias("score"), "badge", "series")


_TOPIC = (
    f"CASE WHEN {rx('lower(title)', classify.TOPIC_HALLOWEEN, False)} OR {rx('lower(title)', classify.HALLOWEEN, False)} THEN 'halloween' WHEN type = 'sports' THEN 'sports' "
    f"WHEN {rx('lower(title)', classify.TOPIC_SHOWS, False)} OR type = 'shows' THEN 'shows' WHEN {rx('lower(title)', classify.TOPIC_LEARNING, False)} OR type = 'learning' THEN 'learning' "
    "WHEN type = 'outdoor' THEN 'outdoor' WHEN type = 'arts' THEN 'arts' ELSE 'community' END"
)


@check("c10_weekend_topic", f"WITH {{lv}}, k AS (SELECT *, {type_case()} AS type FROM lv) SELECT id, {_TOPIC} AS topic FROM k")
def c10(t):
    rows = listings(t, "title").withColumn("type", classify.type_of("title", "title")).withColumn("season", classify.season_of("title"))
    return rows.select("id", classify.weekend_topic("title", "season", "type").alias("topic"))


_HIT = lambda p, col="title": f"CASE WHEN {rx(col, p)} THEN 1 ELSE 0 END"


@check(
    "k5_weekend_score",
    f"""WITH {{lv}}, k AS (SELECT *, {type_case()} AS type FROM lv WHERE {CANDIDATE_WHERE}), c AS (SELECT *, {_TOPIC} AS topic FROM k)
     SELECT id, CAST(25 + 24 * {_HIT(scoring.WEEKEND_FOCUS)} + CASE WHEN supp % 10 IN (1, 5) THEN 14 ELSE 0 END + 8 * {_HIT(scoring.WEEKEND_FAMILY, 'description')} + CASE WHEN cost_status = 'free' THEN 6 ELSE 0 END
      + CASE WHEN line % 4 = 0 THEN 5 ELSE 0 END + CASE WHEN {rx('lower(title)', classify.HALLOWEEN, False)} THEN 6 ELSE 0 END + CASE WHEN left(date_value, 10) >= '{FRIDAY}' THEN 7 ELSE 0 END
      + 5 * {_HIT(scoring.WEEKEND_CREATIVE, "(title || ' ' || description)")} + CASE WHEN topic = 'sports' THEN -8 ELSE 0 END + CASE WHEN left(date_value, 10) < '1997-05-14' THEN -6 ELSE 0 END AS BIGINT) AS score, topic FROM c""",
)
def k5(t):
    return weekend.scored_candidates(weekend_rows(t), FRIDAY).select("id", F.col("score").cast("long").alias("score"), "topic")


_TOK = " ".join(f"|| CASE WHEN {rx('body', p, False)} THEN '{n} ' ELSE '' END" for n, p in classify.ARTWORK_TOKENS)


@check(
    "c11_artwork_preset",
    f"""WITH {{lv}}, b AS (SELECT id, lower(title || ' ' || place) AS body FROM lv), k AS (SELECT id, trim('' {_TOK}) AS found FROM b), n AS (SELECT id, CASE WHEN found = '' THEN 'program' ELSE found END AS tokens FROM k)
     SELECT id, tokens, CASE WHEN contains(tokens, 'halloween') AND contains(tokens, 'farm') THEN 'farm-halloween' """
    + " ".join(f"WHEN list_contains(string_split(tokens, ' '), '{p}') THEN '{p}'" for p in classify.ARTWORK_PRESETS) + " ELSE 'community' END AS preset FROM n",
)
def c11(t):
    rows = listings(t, "title", "place").withColumn("tokens", classify.artwork_tokens(["title", "place"], F.lit("program")))
    return rows.select("id", F.array_join("tokens", " ").alias("tokens"), classify.artwork_preset(F.col("tokens")).alias("preset"))


SENTENCES = [
    "Join us to build a kite and fly it together.", "The pianist studied in Vienna.", "Parking is behind the hall.", "and more fun for you.", "An unforgettable experience.",
    "Follow the trail and collect six stamps.", "Annual membership rates apply.", "Meet the rangers with telescopes, then hike to the pond.", "Tickets are sold at the door.", "Our mission is to inspire curiosity.",
]


def sentence_rows(t):
    """Every sentence of every document, each followed by one of the fixed sentences."""
    first = t.documents.select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "own"))
    return first.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat_ws(" ", _pick(SENTENCES, F.col("doc_id") + F.col("pos")), F.regexp_replace("own", r"\s+", " ")).alias("s"))


_SPLIT = "list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0)"
_SENT_SQL = f"""WITH x AS (SELECT doc_id, {_SPLIT} AS l FROM documents), y AS (SELECT doc_id, unnest(l) AS own, generate_subscripts(l, 1) - 1 AS pos FROM x),
 z AS (SELECT doc_id, pos, {options(SENTENCES, 'doc_id + pos')} || ' ' || regexp_replace(own, '\\s+', ' ', 'g') AS s FROM y)"""
_M = lambda p, i=True: rx("s", p, i)
_LOGI = "(" + " OR ".join(_M(p) for p in (summary.LOGISTICS_START, summary.LOGISTICS_AUDIENCE, summary.LOGISTICS_MATERIAL, summary.LOGISTICS_LEGAL, summary.SENSORY, summary.ADMINISTRATIVE, summary.PAGE_CHROME, summary.PREPARATION)) + f" OR ({_M(summary.LOGISTICS)} AND NOT {_M(summary.CONCRETE_ACTION)}))"
_BIO = f"({_M(summary.BIOGRAPHY)} OR {_M(summary.BIOGRAPHY_ROLE)})"
_OPER = _M(summary.OPERATIONAL)
_NODETAIL = " AND ".join("NOT " + _M(p) for p in (summary.STRONG_DETAIL, summary.DIRECT_ACTION, summary.SUPPORT, summary.SPECIFIC_OBJECT, summary.EVENT_NOUN))
_GEN = f"({_M(summary.GENERIC_EXPERIENCE)} AND {_NODETAIL})"
_FLUFF = f"({_M(summary.PROMOTIONAL)} AND {_NODETAIL})"
_FRAG = (
    f"(len(regexp_extract_all(s, {q(chr(91) + 'A-Za-z][A-Za-z' + chr(39) + '’-]*')})) < 3 OR {_M(summary.CONTINUATION)} OR {_M(summary.LOWERCASE_START, False)} OR ({_M(summary.DANGLING)} AND NOT {_M('^[^,]{1,120},' + chr(92) + 's*[A-Z]?[a-z]+' + chr(92) + 'b', False)}) "
    f"OR {_M('[:;,–—-]' + chr(92) + 's*$')} OR {_M('^(?:Q|A)' + chr(92) + '.' + chr(92) + 's*', False)} OR {_M('^(?:also|then|however|therefore|instead|additionally)' + chr(92) + 'b')})"
)
_JOIN = f"({_M(summary.GENERIC_JOIN)} AND NOT {_M(summary.CONCRETE_ACTION)} AND NOT {_M(summary.DIRECT_ACTION)} AND NOT {_M(summary.SPECIFIC_OBJECT)} AND NOT {_M(summary.CONTENT_NOUN)})"
_ABS = f"({_M(summary.ABSTRACT)} AND NOT {_M(summary.SPECIFIC_OBJECT)} AND NOT {_M(summary.DIRECT_ACTION)} AND NOT {_M(summary.CONTENT_NOUN)})"
_LIST = f"(length(s) - length(replace(s, ',', '')) >= 2 AND NOT {_M(summary.DIRECT_ACTION)} AND NOT {_M(summary.SUPPORT)} AND NOT {_M(summary.FINITE_VERB)})"


@check(
    "c12_sentence_flags",
    _SENT_SQL + f" SELECT {_LOGI} AS logistics, {_BIO} AS biography, {_OPER} AS operational, {_GEN} AS generic, {_FLUFF} AS fluff, {_FRAG} AS fragment, {_JOIN} AS joins, {_ABS} AS abstract, count(*) AS n FROM z GROUP BY ALL",
)
def c12(t):
    s = summary.cued(F.col("s"))
    flags = sentence_rows(t).select(
        summary.is_logistics(s).alias("logistics"), summary.is_biography(s).alias("biography"), summary.is_operational(s).alias("operational"),
        summary.is_generic_experience(s).alias("generic"), summary.is_fluff(s).alias("fluff"), summary.is_fragment(s).alias("fragment"),
        summary.is_generic_join(s).alias("joins"), summary.is_abstract(s).alias("abstract"),
    )
    return flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))


_P = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
_SENT_SCORE = " + ".join(
    [
        _P(_M(summary.CONCRETE_ACTION), 22), _P(_M(summary.DIRECT_ACTION), 32), _P(_M(summary.SUPPORT), 14), _P(_M(summary.CONTENT_LIST), 28), _P(_M(summary.PARTICIPATION), 8),
        _P(_M(summary.SPECIFIC_OBJECT), 8), _P(_M(summary.OBSERVATION_TOOL), 18), _P(_M(r"\b(?:by|while|then|and)\b") + " AND " + _M(summary.CONCRETE_ACTION), 3),
        _P("length(s) BETWEEN 35 AND 260", 4), _P("length(s) > 420", -8), _P("length(s) < 22", -8), _P(_M(summary.BACKGROUND_ONLY), -22), _P(_M(summary.PROMOTIONAL), -30),
        _P(_JOIN, -22), _P(_ABS, -28), _P(_LIST, -14), _P(_M(summary.LOGISTICS), -20), _P(_BIO, -60), _P(_OPER, -24), _P(_GEN, -45), _P(_FLUFF, -45), _P(_FRAG, -60), _P(_M(summary.SEQUENCE_TAIL), -18),
    ]
)


@check(
    "k6_sentence_scores",
    _SENT_SQL + f" SELECT doc_id, round(sum(round(least(length(s), 220) / 35.0 + {_SENT_SCORE} - pos * 0.15, 6)), 3) AS total, count(*) AS sentences FROM z GROUP BY 1",
)
def k6(t):
    scored = sentence_rows(t).withColumn("score", summary.sentence_score(summary.cued(F.col("s")), F.col("pos"), F.lit(False)))
    return scored.groupBy("doc_id").agg(F.round(F.sum("score"), 3).alias("total"), F.count("*").alias("sentences"))


@check(
    "k7_repair_scores",
    f"""WITH {{lv}} SELECT id, round(CAST(12 AS DOUBLE) * len(list_distinct(list_transform(regexp_extract_all(description, {q('(?i)' + summary.REPAIR_ACTIVITY)}), lambda w: lower(w)))) + {_P(rx('description', summary.REPAIR_PARTICIPATION), 8)}
     + {_P(rx('description', summary.REPAIR_OVERVIEW), 8)} + {_P('length(description) BETWEEN 45 AND 260', 8)} + {_P(rx('description', summary.REPAIR_SECONDARY), -18)}
     + least(9, 3 * len(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{{4,}}'), lambda w: contains(lower(description), w)))) - line * CAST(0.75 AS DOUBLE), 6) AS score FROM lv""".replace("{{4,}}", "{4,}"),
)
def k7(t):
    rows = listings(t, "title", "description", "line")
    return rows.select("id", summary.repair_score(F.col("description"), F.col("line"), "title").alias("score"))


_PARA = "list_filter(list_transform(regexp_extract_all(html, '(?i)<p\\b[^>]*>([\\s\\S]*?)</p>', 1), lambda p: " + plain_sql("p") + "), lambda p: length(p) BETWEEN 35 AND 1600)"


@check(
    "k8_best_paragraph",
    f"""WITH p AS (SELECT page_id, {plain_sql("regexp_extract(html, '(?i)<title[^>]*>([^<]*)</title>', 1)")} AS title, unnest({_PARA}) AS para, generate_subscripts({_PARA}, 1) AS pos FROM pages),
     s AS (SELECT page_id, pos, para, CASE WHEN length(title) >= 5 AND contains(lower(para), lower(title)) THEN 10 ELSE 0 END + 5 * len(list_filter({tokens_sql('title', 4, text.DETAIL_STOP)}, lambda w: contains(lower(para), w)))
      + CASE WHEN length(para) BETWEEN 80 AND 900 THEN 2 ELSE 0 END AS score FROM p)
     SELECT page_id, arg_min(para, (-score, pos)) AS para, CAST(max(score) AS BIGINT) AS score FROM s GROUP BY 1""",
)
def k8(t):
    title = F.regexp_extract("html", r"(?i)<title[^>]*>([^<]*)</title>", 1)
    rows = t.pages.select("page_id", text.plain_text(title).alias("title"), F.posexplode(text.paragraphs("html")).alias("pos", "para"))
    words = F.filter(F.split(text.title_key("title"), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*text.DETAIL_STOP))
    score = (
        F.when((F.length("title") >= 5) & F.contains(F.lower("para"), F.lower("title")), 10).otherwise(0)
        + F.size(F.filter(words, lambda w: F.contains(F.lower("para"), w))) * 5 + F.when(F.length("para").between(80, 900), 2).otherwise(0)
    )
    usable = rows.filter(F.length("para").between(35, 1600)).withColumn("score", score)
    best = usable.groupBy("page_id").agg(F.min_by("para", F.struct(-F.col("score"), F.col("pos"))).alias("para"), F.max("score").cast("long").alias("score"))
    return best


_CHECKS = {
    "url": "true", "date": "true", "start_time": "contains(date_value, 'T')", "venue": "true", "address": "line % 3 <> 0", "description": "length(description) >= 25", "image": "image <> ''",
    "age": "supp % 10 NOT IN (7, 9)", "cost": "cost_status <> 'unknown'", "registration": "line % 2 = 0", "end_time": "contains(end_date_value, 'T')",
}
_COMPLETE = " + ".join(_P(cond, scoring.COMPLETENESS_POINTS[name]) for name, cond in _CHECKS.items()) + f" + {_P('line % 3 <> 0', 4)}"


def quality_rows(t):
    rows = listings(t, "title", "description", "source", "place", "city", "address", "date_value", "end_date_value", "url", "image", "cost_status", "line", "supp")
    empty = F.lit("")
    e = {
        "title": F.col("title"), "description": F.col("description"), "source": F.col("source"), "place": F.col("place"), "city": F.col("city"), "url": F.col("url"), "canonical_url": empty,
        "address": F.when(F.col("line") % 3 == 0, empty).otherwise(F.col("address")), "meeting_point": empty, "map_url": empty, "date_value": F.col("date_value"), "end_date_value": F.col("end_date_value"),
        "image": F.col("image"), "age_label": F.when((F.col("supp") % 10).isin(7, 9), empty).otherwise(F.lit("Ages")), "age_ranges": F.array(), "cost_status": F.col("cost_status"),
        "registration_status": F.when(F.col("line") % 2 == 0, F.lit("required")).otherwise(F.lit("unknown")), "ongoing": F.lit(False),
    }
    return rows, e


@check("k9_completeness", f"WITH {{lv}} SELECT id, CAST({_COMPLETE} AS BIGINT) AS score, CAST(8 + CASE WHEN image <> '' THEN 4 ELSE 0 END + 2 + 1 AS BIGINT) AS priority FROM lv")
def k9(t):
    rows, e = quality_rows(t)
    priority = scoring.organizer_priority("url", "image", "source", "place", F.lit("rss"), "address")
    return rows.select("id", scoring.completeness(e).cast("long").alias("score"), priority.cast("long").alias("priority"))


@check(
    "e4_detail_quality",
    f"""WITH {{lv}} SELECT id, CASE WHEN {_COMPLETE} >= 80 THEN 'PUBLISH_READY' ELSE 'PUBLISH_PARTIAL' END AS state, concat_ws(',', {', '.join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _CHECKS.items())}) AS missing FROM lv""",
)
def e4(t):
    rows, e = quality_rows(t)
    missing = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in scoring.completeness_checks(e)]))
    return rows.select("id", scoring.quality_state(e).alias("state"), F.array_join(missing, ",").alias("missing"))


@check(
    "e5_refresh_decision",
    f"""WITH {{lv}}, d AS (SELECT id, CASE WHEN line = 1 THEN 'first-canonical-pass' WHEN line = 2 THEN 'canonical-changed'
      WHEN NOT contains(date_value, 'T') OR cost_status = 'unknown' OR image = '' OR address = '' THEN 'missing-fields' WHEN line = 3 THEN 'unverified'
      WHEN date_diff('day', CAST(verified_at AS DATE), CAST(day AS DATE)) >= 30 THEN 'ttl-expired' ELSE 'cached' END AS reason FROM lv) SELECT id, reason, reason <> 'cached' AS run FROM d""",
)
def e5(t):
    rows = listings(t, "url", "date_value", "cost_status", "image", "place", "address", "line", "verified_at", "day", "orderkey")
    line = F.col("line")
    e = {name: F.col(name) for name in ("url", "date_value", "cost_status", "image", "place", "address")}
    e |= {"registration_status": F.lit("required"), "description": F.lit("given"), "image_status": F.lit("official"), "image_failure_reason": F.lit("")}
    previous = F.when(line == 2, F.lit("https://old.example.org/")).otherwise(F.replace("url", F.lit("utm_source=feed&"), F.lit("")))
    verified = F.when(line == 3, F.lit("")).otherwise(F.col("verified_at"))
    decision = enrichment.refresh_decision(e, line != 1, previous, verified, F.to_date("day"))
    return rows.select("id", decision.alias("d")).select("id", "d.reason", "d.run")


@check("e8_image_state", "WITH {lv} SELECT id, CASE WHEN image <> '' THEN 'official' ELSE 'missing' END AS image_status, CASE WHEN image <> '' THEN '' WHEN line % 4 = 1 THEN 'official_page_fetch_blocked' WHEN line % 4 = 2 THEN 'official_page_identity_mismatch' ELSE 'no_verified_official_image_candidate' END AS image_failure_reason FROM lv")
def e8(t):
    rows = listings(t, "image", "line")
    detail = _pick(["enriched", "fetch-blocked", "identity-mismatch", ""], F.col("line"))
    state = enrichment.image_state(F.col("image"), F.when(F.col("image") != "", F.lit("missing")).otherwise(F.lit("")), F.lit(""), F.lit(True), detail)
    return rows.select("id", state.alias("s")).select("id", "s.image_status", "s.image_failure_reason")


@check(
    "e9_missing_image_choice",
    """WITH {lv}, c AS (SELECT part, supp, max(quantity) AS score FROM lv WHERE quantity % 3 <> 0 AND quantity >= 5 GROUP BY ALL), b AS (SELECT part, supp AS chosen, row_number() OVER (PARTITION BY part ORDER BY score DESC, supp) AS r FROM c)
     SELECT lv.id, b.chosen FROM lv LEFT JOIN b ON b.part = lv.part AND r = 1 WHERE lv.image = ''""",
)
def e9(t):
    from ..operators.keep import top_n

    rows = listings(t, "part", "supp", "quantity", "image")
    probes = rows.groupBy("part", "supp", (F.col("quantity") % 3 != 0).alias("ok"), (F.col("quantity") >= 5).alias("big")).agg(F.max("quantity").alias("score"))
    status, size = F.when(F.col("ok"), 200).otherwise(404), F.when(F.col("big"), 20_000).otherwise(900)
    best = top_n(probes.filter(enrichment.loadable(status, F.lit("image/png"), size)), ["part"], [F.col("score").desc(), F.col("supp")], 1)
    return rows.filter("image = ''").join(best.select("part", F.col("supp").alias("chosen")), "part", "left").select("id", "chosen")


@check("e10_mirror_plan", "WITH {lv} SELECT DISTINCT image, left(sha256(image), 20) AS file_name FROM lv WHERE image <> ''")
def e10(t):
    return enrichment.mirror_plan(listings(t, "image"))


@check("e12_revalidation_occurrences", "WITH {lv}, o AS (SELECT series, lower(url) || chr(31) || date_value AS k FROM lv) SELECT count(DISTINCT (series, k)) AS n FROM o")
def e12(t):
    rows = listings(t, "series", "url", "date_value")
    first = rows.groupBy("series").agg(F.min(F.struct("ord", "id", "url", "date_value")).alias("f"))
    parents = first.select(F.concat(F.lit("series-"), "series").alias("id"), F.array().cast("array<string>").alias("legacy_ids"), F.col("f.url").alias("url"), F.col("f.date_value").alias("date_value"), F.col("f.ord").alias("ord"))
    sessions = rows.select(F.concat(F.lit("series-"), "series").alias("parent_id"), F.col("id").alias("session_id"), "url", "date_value", "ord")
    return series.occurrences(parents, sessions, ["ord"]).agg(F.count("*").alias("n"))


@check("e13_legacy_series_id", "WITH {lv} SELECT id, 'series-' || left(sha256(source || chr(31) || title || chr(31) || '' || chr(31) || place), 16) AS legacy FROM lv")
def e13(t):
    return listings(t, "source", "title", "place").select("id", series.legacy_series_id(["source", "title", F.lit(None), "place"]).alias("legacy"))


_LABELS = ["", "费用未注明", "免费", "建议捐赠", "$5–$9", "会员／非会员价格见详情", "see site"]
_LABEL_STATUS = ["unknown", "unknown", "free", "donation", "paid", "variable", "unknown"]


@check("e15_canonical_enums", f"WITH {{lv}} SELECT id, CASE WHEN line = 7 THEN 'paid' ELSE {options(_LABEL_STATUS, 'part')} END AS cost_status, CASE WHEN line % 2 = 0 THEN 'full' ELSE 'unknown' END AS registration FROM lv")
def e15(t):
    rows = listings(t, "part", "line")
    cost = commerce.canonical_cost(F.when(F.col("line") == 7, F.lit("paid")).otherwise(F.lit("odd")), _pick(_LABELS, F.col("part")), F.lit(""), F.lit(""))
    return rows.select("id", cost["cost_status"].alias("cost_status"), commerce.canonical_registration(F.when(F.col("line") % 2 == 0, F.lit("full")).otherwise(F.lit("maybe")), F.lit("")).alias("registration"))


_CLAUSES = ["Ages 5-12", "", "Grades K-5", "", "Ages 6 and up", "", "", "", "", ""]


@check("e16_audience_evidence", f"WITH {{lv}} SELECT id, trim('Kids ' || {options(_CLAUSES, 'supp')}) AS evidence FROM lv")
def e16(t):
    return listings(t, "description").select("id", audience.audience_evidence(F.lit("Kids"), "description").alias("evidence"))
