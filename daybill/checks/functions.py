"""Scalar functions: text (X), dates (T), URLs and values (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, places, summary, text, translation_qa, urls
from ..functions.defaults import first_nonempty
from ..plans.listings import _pick, listings
from .registry import FRIDAY, TODAY, check, clock_sql, day_sql, end_sql, local_sql, options, q, rx


def this_century(day: str):
    """The same day 32 years later: page dates have years 20xx."""
    return F.concat((F.left(day, F.lit(4)).cast("int") + 32).cast("string"), F.substring(day, 5, 20))


def _later(day: str) -> str:
    return f"(CAST(left({day}, 4) AS INTEGER) + 32) || substr({day}, 5)"


_ENTITIES = ["Tom &amp; Jerry&nbsp;show", "&ldquo;Kites&rdquo; &ndash; 3&#8217;s", "<![CDATA[Fun &lt;3]]>", "Caf&#xe9; &#39;99&#39;", "Plain words", "A &quot;b&quot; &apos;c&apos;"]
_DECODED = ["Tom & Jerry show", '"Kites" – 3’s', "Fun <3", "Café '99'", "Plain words", "A \"b\" 'c'"]


@check("x1_entity_decode", f"SELECT l_orderkey AS k, l_linenumber AS n, {options(_ENTITIES, 'l_partkey')} AS raw, {options(_DECODED, 'l_partkey')} AS decoded FROM lineitem")
def x1(t):
    raw = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), _pick(_ENTITIES, F.col("l_partkey")).alias("raw"))
    return raw.withColumn("decoded", text.decode_entities("raw"))


def plain_sql(html: str) -> str:
    """Plain text of a page without numeric references, in the other engine."""
    out = html
    for entity, char in text.NAMED_ENTITIES:
        out = f"replace({out}, {q(entity)}, {q(char)})"
    out = f"regexp_replace({out}, '(?i)<script\\b[^>]*>[\\s\\S]*?</script>|<style\\b[^>]*>[\\s\\S]*?</style>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(\\s*[-–—_]\\s*){{3,}}', ' ', 'g')"
    out = f"regexp_replace({out}, '\\s+', ' ', 'g')"
    return f"trim(regexp_replace({out}, '\\s+([,.;:!?])', '\\1', 'g'))"


@check("x2_plain_text", f"SELECT page_id, {plain_sql('html')} AS body FROM pages")
def x2(t):
    return t.pages.select("page_id", text.plain_text("html").alias("body"))


_KEY = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


@check("x3_title_forms", f"WITH {{lv}} SELECT DISTINCT title || ' & 3rd Annual 2026' AS raw, {_KEY} AS key, {_KEY} || ' and' AS edition FROM lv")
def x3(t):
    rows = listings(t, "title").select("title", F.concat("title", F.lit(" & 3rd Annual 2026")).alias("raw")).distinct()
    return rows.select("raw", text.title_key("title").alias("key"), text.edition_title_key("raw").alias("edition"))


@check("x4_word_signature", f"WITH {{lv}} SELECT DISTINCT title, array_to_string(list_sort(string_split({_KEY}, ' ')), ' ') AS signature FROM lv")
def x4(t):
    return listings(t, "title").select("title").distinct().select("title", text.title_signature("title").alias("signature"))


def tokens_sql(value: str, least: int, stop: list[str]) -> str:
    words = f"string_split(trim(regexp_replace(lower({value}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    listed = "[" + ", ".join(q(w) for w in stop) + "]"
    test = f"length(w) >= {least}" + (f" AND NOT list_contains({listed}, w)" if stop else "")
    return f"list_filter({words}, lambda w: {test})"


@check(
    "x5_token_sets",
    "SELECT item_id, " + ", ".join(
        f"array_to_string(list_sort(list_distinct({tokens_sql('text', n, stop)})), ' ') AS {name}"
        for name, n, stop in (("long_words", 4, []), ("link_words", 3, text.LINK_STOP), ("detail_words", 4, text.DETAIL_STOP))
    ) + " FROM benchmark",
)
def x5(t):
    show = lambda n, stop: F.array_join(F.array_sort(text.tokens("text", n, stop)), " ")
    return t.benchmark.select("item_id", show(4, []).alias("long_words"), show(3, text.LINK_STOP).alias("link_words"), show(4, text.DETAIL_STOP).alias("detail_words"))


@check(
    "x6_title_identity",
    f"""WITH {{lv}}, w AS (SELECT id, list_distinct({tokens_sql('title', 4, [])}) AS a, list_distinct({tokens_sql("'the ' || place || ' halloween ring workshop'", 4, [])}) AS b FROM lv)
     SELECT id, len(list_intersect(a, b)) AS shared, len(list_intersect(a, b)) >= least(2, len(a), len(b)) AS same FROM w""",
)
def x6(t):
    rows = listings(t, "title", "place")
    a, b = text.tokens("title", 4), text.tokens(F.concat(F.lit("the "), "place", F.lit(" halloween ring workshop")), 4)
    return rows.select("id", text.shared_count(a, b).cast("long").alias("shared"), text.same_identity(a, b).alias("same"))


_SENTENCES = "list_filter(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: length(s) > 0)"


@check("x7_sentences", f"SELECT doc_id, len({_SENTENCES}) AS n, {_SENTENCES}[1] AS first FROM documents")
def x7(t):
    return t.documents.select("doc_id", text.sentences("text").alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.try_element_at("s", F.lit(1)).alias("first"))


_CLEAN = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_HEAD_SENTENCE = f"regexp_extract(left({_CLEAN}, 200), '^(.+?[.!。！？])(?:\\s|$)', 1)"


@check(
    "x8_snip",
    f"""SELECT doc_id, CASE WHEN length({_CLEAN}) <= 200 THEN {_CLEAN} WHEN length({_HEAD_SENTENCE}) >= 45 THEN {_HEAD_SENTENCE}
     ELSE regexp_replace(regexp_replace(left({_CLEAN}, 200), '\\s+\\S*$', ''), '[,;:，；、\\s]+$', '') || '…' END AS snippet FROM documents""",
)
def x8(t):
    return t.documents.select("doc_id", text.snip("text", 200).alias("snippet"))


@check(
    "x9_structured_summaries",
    """WITH {lv} SELECT id, 'Official ' || source || ' home game against ' || place || ' at ' || city || '.' || CASE WHEN line % 2 = 0 THEN ' Featured promotion: '
     || cost_status || ' night.' ELSE '' END AS sports, priority || '-rated movie screening at ' || city || '.' AS screening FROM lv""",
)
def x9(t):
    rows = listings(t, "source", "place", "city", "line", "cost_status", "priority")
    promo = F.when(F.col("line") % 2 == 0, F.array(F.concat("cost_status", F.lit(" night")))).otherwise(F.array(F.lit("")))
    return rows.select(
        "id", summary.sports_summary("source", "place", "city", F.lit("game"), promo)["summary"].alias("sports"),
        summary.screening_summary("priority", "city").alias("screening"),
    )


@check(
    "x10_slug_candidates",
    """WITH {lv}, s AS (SELECT DISTINCT title, trim(regexp_replace(lower('The ' || title || ' for kids'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM lv)
     SELECT title, slug || ' ' || substr(slug, 5) || ' ' || replace(substr(slug, 5), '-for-', '-') AS slugs FROM s""",
)
def x10(t):
    rows = listings(t, "title").select("title").distinct()
    return rows.select("title", F.array_join(text.slug_candidates(F.concat(F.lit("The "), "title", F.lit(" for kids"))), " ").alias("slugs"))


@check("x11_text_chunks")
def x11(t):
    return t.documents.select("doc_id", F.posexplode(text.chunks("text")).alias("chunk_no", "chunk"))


@check("x11_chunk_limits", "SELECT doc_id, true AS within_limit, true AS words_kept FROM documents WHERE length(trim(text)) > 0")
def x11_limits(t):
    """Every chunk is within the limit unless it is one long word, and no word is lost."""
    rows = t.documents.filter(F.length(F.trim("text")) > 0).select("doc_id", "text", text.chunks("text").alias("c"))
    fits = F.forall("c", lambda p: (F.length(p) <= 360) | ~p.rlike(r"\s"))
    words = lambda v: F.regexp_replace(v, r"[\s—–-]+", "")
    return rows.select("doc_id", fits.alias("within_limit"), (words(F.array_join("c", "")) == words(F.col("text"))).alias("words_kept"))


_GRADES = ["适合八年级学生", "十二 年级科学课", "8年级（八年级）", "二十年级", "一年级到三年级", "没有年级"]
_GRADES_OUT = ["适合8年级学生", "12 年级科学课", "8年级（八年级）", "二十年级", "1年级到3年级", "没有年级"]


@check("x12_grade_numerals", f"SELECT DISTINCT {options(_GRADES, 'l_partkey')} AS raw, {options(_GRADES_OUT, 'l_partkey')} AS digits FROM lineitem")
def x12(t):
    raw = t.lineitem.select(_pick(_GRADES, F.col("l_partkey")).alias("raw")).distinct()
    return raw.select("raw", translation_qa.grades_as_digits("raw").alias("digits"))


_CLAIM_ZH = ["免费入场，适合各年龄", "无需报名，免费", "亲子活动", "全年龄适合，不用报名"]


def _claim_sql(label: str, target: str, support: str) -> str:
    return f"CASE WHEN {rx('zh', target)} AND NOT {rx('lower(description)', support, False)} THEN 'unsupported-claim:{label}' END"


@check(
    "x13_unsupported_claims",
    f"""WITH {{lv}}, z AS (SELECT id, description, {options(_CLAIM_ZH, 'line')} AS zh FROM lv)
     SELECT id, concat_ws(',', {', '.join(_claim_sql(*c) for c in translation_qa.CLAIMS)}) AS issues FROM z""",
)
def x13(t):
    rows = listings(t, "description", "line").withColumn("zh", _pick(_CLAIM_ZH, F.col("line")))
    return rows.select("id", F.array_join(translation_qa.claim_issues("description", "zh"), ",").alias("issues"))


_D1, _D2 = "CAST(left(date_value, 10) AS DATE)", "CAST(left(end_date_value, 10) AS DATE)"


@check(
    "x14_date_labels",
    f"""WITH {{lv}} SELECT id, month({_D1}) || '月' || day({_D1}) || '日' || CASE WHEN contains(date_value, 'T') THEN ' ' || substr(date_value, 12, 5) ELSE '' END AS zh,
     CASE WHEN end_date_value = '' OR {_D2} <= {_D1} THEN '' WHEN year({_D1}) <> year({_D2}) THEN strftime({_D1}, '%b %-d') || ', ' || year({_D1}) || ' – ' || strftime({_D2}, '%b %-d')
      || ', ' || year({_D2}) ELSE strftime({_D1}, '%b %-d') || ' – ' || CASE WHEN month({_D1}) = month({_D2}) THEN CAST(day({_D2}) AS VARCHAR) ELSE strftime({_D2}, '%b %-d') END
      || CASE WHEN year({_D1}) <> 1997 THEN ', ' || year({_D2}) ELSE '' END END AS range_en FROM lv""",
)
def x14(t):
    rows = listings(t, "date_value", "end_date_value")
    return rows.select("id", dates.zh_day_label("date_value").alias("zh"), dates.multi_day_label("date_value", "end_date_value", 1997).alias("range_en"))


@check(
    "x15_venue_and_address",
    """WITH {lv} SELECT id, place || ' Plaza' AS venue, address || ', San Jose' AS street, 'San Jose' AS town,
     lower(address) || ' ' || lower(replace(place, '#', ' ')) AS location FROM lv""",
)
def x15(t):
    rows = listings(t, "place", "address")
    whole = F.concat("place", F.lit(" Plaza, "), F.regexp_replace("address", "Street$", "Street."), F.lit(", San Jose, CA 95035"))
    split = F.col("split")
    return rows.withColumn("split", places.venue_and_address(whole, F.lit(""))).select(
        "id", split["place"].alias("venue"), F.replace(split["address"], F.lit("."), F.lit("")).alias("street"), split["city"].alias("town"),
        F.regexp_replace(places.location_key("address", "place"), r"\bst\b", "street").alias("location"),
    )


@check(
    "x16_age_bands",
    "SELECT CASE WHEN p_size <= 2 THEN '0-2' WHEN p_size <= 5 THEN '3-5' WHEN p_size <= 11 THEN '6-11' WHEN p_size <= 14 THEN '12-14' ELSE '15-18' END AS band, count(*) AS n FROM part GROUP BY 1",
)
def x16(t):
    return t.part.select(places.analytics_age_band(F.col("p_size")).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


_PARAS = "list_filter(list_transform(regexp_extract_all(html, '(?i)<p\\b[^>]*>([\\s\\S]*?)</p>', 1), lambda p: " + plain_sql("p") + f"), lambda p: length(p) >= 20 AND NOT {rx('p', text.NOT_A_DESCRIPTION)})"
_JOINED = f"trim(regexp_replace(array_to_string({_PARAS}, ' '), 'https?://\\S+', '', 'g'))"


@check(
    "x17_official_paragraphs",
    f"SELECT page_id, {_JOINED} AS description, CASE WHEN length({_JOINED}) > 4000 THEN rtrim(left({_JOINED}, 3999)) || '…' ELSE {_JOINED} END AS shown FROM pages",
)
def x17(t):
    whole = t.pages.select("page_id", text.official_paragraph_text("html").alias("description"))
    return whole.withColumn("shown", text.shortened("description"))


@check(
    "t1_datetime_forms",
    f"WITH {{lv}} SELECT id, {day_sql('date_value')} AS day, {local_sql('date_value')} AS start_form, {local_sql('date_value', 'true')} AS end_form FROM lv",
)
def t1(t):
    rows = listings(t, "date_value")
    return rows.select("id", dates.day_key("date_value").alias("day"), dates.local_datetime("date_value").alias("start_form"), dates.local_datetime("date_value", True).alias("end_form"))


_MIN = (
    f"CASE WHEN fmt = 'movie-screening' THEN 200 WHEN fmt = 'sports-game' THEN 240 WHEN fmt = 'live-show' THEN 210 WHEN {rx('lower(title)', dates.STORYTIME_WORDS, False)} THEN 90 "
    f"WHEN {rx('lower(title)', dates.FESTIVAL_WORDS, False)} THEN 480 ELSE 240 END"
)
_FORMATS = ["movie-screening", "sports-game", "live-show", "program", "festival"]


@check("t2_effective_end", f"WITH {{lv}}, f AS (SELECT *, {options(_FORMATS, 'orderkey')} AS fmt FROM lv) SELECT id, {end_sql('date_value', 'end_date_value', _MIN)} AS effective_end FROM f")
def t2(t):
    rows = listings(t, "title", "date_value", "end_date_value", "orderkey").withColumn("fmt", _pick(_FORMATS, F.col("orderkey")))
    return rows.select("id", dates.effective_end("date_value", "end_date_value", dates.fallback_minutes("fmt", "title", F.lit(""))).alias("effective_end"))


@check("t3_pacific_local", "SELECT event_id, strftime(date_trunc('second', ts) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%dT%H:%M:%S') AS local FROM events")
def t3(t):
    instant = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.events.select("event_id", dates.pacific_local(instant).alias("local"))


@check(
    "t4_date_text",
    """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') || 'T' || lpad(CAST(l_suppkey % 12 + 12 AS VARCHAR), 2, '0') || ':30'
     WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE CASE WHEN '1997' || strftime(l_shipdate, '-%m-%d') < '1997-06-13' THEN '' ELSE '1997' || strftime(l_shipdate, '-%m-%d') END END AS iso FROM lineitem""",
)
def t4(t):
    rows = t.lineitem
    long_form, numeric, short = F.date_format("l_shipdate", "MMMM d, yyyy"), F.date_format("l_shipdate", "M/d/yyyy"), F.date_format("l_shipdate", "MMM d")
    line = F.col("l_linenumber") % 3
    date_text = F.when(line == 0, long_form).when(line == 1, numeric).otherwise(F.concat(F.lit("Sat, "), short))
    clock = F.when(line == 0, F.concat(((F.col("l_suppkey") + 11) % 12 + 1).cast("string"), F.lit(":30 p.m."))).otherwise(F.lit(""))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), dates.iso_from_text(date_text, clock, TODAY).alias("iso"))


@check(
    "t6_prose_window",
    f"WITH {{lv}}, d AS (SELECT id, CAST({_later('day')} AS DATE) AS d, line FROM lv) " + """SELECT id, CASE WHEN line <= 5 THEN strftime(d - to_days(CAST(line AS INTEGER)), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END AS first,
     strftime(d + to_days(CAST(line * 2 AS INTEGER)), '%Y-%m-%d') AS last FROM d""",
)
def t6(t):
    rows = listings(t, "day", "line").withColumn("day", this_century("day"))
    day = F.to_date("day")
    early = F.date_format(F.date_sub(day, F.when(F.col("line") <= 5, F.col("line")).otherwise(400).cast("int")), "MMMM d, yyyy")
    late = F.date_format(F.date_add(day, (F.col("line") * 2).cast("int")), "MMM d, yyyy")
    prose = F.concat(F.lit("Runs from "), early, F.lit(" until "), late, F.lit(". Copyright January 5, 2090."))
    return rows.select("id", dates.date_window(prose, "day").alias("w")).select("id", F.col("w.start").alias("first"), F.col("w.end").alias("last"))


@check(
    "t7_weekend_of_day",
    """WITH {lv}, d AS (SELECT DISTINCT day, CAST(day AS DATE) AS d FROM lv) SELECT day, strftime(d + to_days(CAST((12 - isodow(d)) % 7 AS INTEGER)), '%Y-%m-%d') AS friday,
     strftime(d + to_days(CAST((12 - isodow(d)) % 7 + 2 AS INTEGER)), '%Y-%m-%d') AS sunday FROM d""",
)
def t7(t):
    friday = dates.next_friday(F.to_date("day"))
    return listings(t, "day").select("day").distinct().select("day", friday.cast("string").alias("friday"), F.date_add(friday, 2).cast("string").alias("sunday"))


@check(
    "t8_page_date_reconciliation",
    f"WITH {{lv}} SELECT id, CASE WHEN line % 3 = 0 THEN {_later('day')} || 'T18:30' WHEN line % 3 = 1 THEN {_later('day')} || 'T19:00' ELSE {_later('date_value')} END AS start, "
    "line % 3 = 2 AS conflict FROM lv",
)
def t8(t):
    rows = listings(t, "day", "line", "date_value").withColumn("day", this_century("day")).withColumn("date_value", this_century("date_value"))
    other = F.date_format(F.date_add(F.to_date("day"), 3), "yyyy-MM-dd")
    mode = F.col("line") % 3
    schema = F.concat(F.when(mode == 0, F.col("day")).otherwise(other), F.lit("T18:30"))
    visible = F.concat(F.when(mode == 1, F.col("day")).otherwise(other), F.lit("T19:00"))
    page = F.concat(F.lit("When: Saturday, "), F.date_format(F.to_date(F.when(mode == 2, other).otherwise(F.col("day"))), "MMMM d, yyyy"))
    start = dates.reconcile_dates(F.col("date_value"), schema, visible, F.col("date_value"))
    return rows.select("id", start.alias("start"), (dates.explicit_page_day(page) != F.col("day")).alias("conflict"))


@check(
    "t9_day_range_expansion",
    f"WITH {{lv}}, d AS (SELECT id, line, CAST({_later('day')} AS DATE) AS d FROM lv) SELECT id, strftime(d - to_days(CAST(g AS INTEGER)), '%Y-%m-%d') AS day FROM d, generate_series(0, 2) AS s(g) "
    "WHERE g < line AND day(d) - g >= 1",
)
def t9(t):
    rows = listings(t, "day", "line").withColumn("day", this_century("day"))
    day = F.to_date("day")
    first = F.greatest(F.dayofmonth(day) - F.least(F.col("line"), F.lit(3)) + 1, F.lit(1))
    label = F.concat(F.date_format(day, "MMM. "), first.cast("string"), F.lit(" - "), F.date_format(day, "d, yyyy"))
    return rows.select("id", F.explode(dates.listing_day_span(label)).alias("day"))


@check(
    "t9_ranges_of_any_length",
    f"""WITH {{lv}}, c AS (SELECT id, line, CAST({_later('day')} AS DATE) AS last FROM lv), d AS (SELECT id, last, CAST(least(line * 4, day(last) - 1) AS INTEGER) AS back FROM c)
     SELECT id, strftime(last - to_days(back), '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last, CASE WHEN back > 14 THEN 'range' ELSE 'days' END AS status,
      CAST(CASE WHEN back > 14 THEN 0 ELSE back + 1 END AS BIGINT) AS days FROM d""",
)
def t9_ranges(t):
    """Ranges of up to four weeks; a long one stays one row with its bounds."""
    rows = listings(t, "day", "line").withColumn("day", this_century("day"))
    last = F.to_date("day")
    first = F.dayofmonth(last) - F.least(F.col("line") * 4, F.dayofmonth(last) - 1)
    label = F.concat(F.date_format(last, "MMM. "), first.cast("string"), F.lit(" - "), F.date_format(last, "d, yyyy"))
    span = rows.select("id", dates.listing_day_range(label).alias("r"))
    return span.select("id", "r.first", "r.last", "r.status", F.size("r.days").cast("long").alias("days"))


@check("t10_days_between", "WITH {lv} SELECT id, date_diff('day', DATE '1997-06-13', CAST(day AS DATE)) AS days, strftime(last_day(CAST(day AS DATE)), '%Y-%m-%d') AS month_end FROM lv")
def t10(t):
    rows = listings(t, "day")
    return rows.select("id", F.date_diff(F.to_date("day"), F.lit(TODAY)).cast("long").alias("days"), F.last_day(F.to_date("day")).cast("string").alias("month_end"))


@check(
    "t11_seasons",
    """WITH {lv}, d AS (SELECT DISTINCT day, CAST(day AS DATE) AS d FROM lv) SELECT day, CASE WHEN month(d) >= 10 THEN year(d) ELSE year(d) + 1 END AS exhibit_year,
     CASE WHEN month(d) >= 7 THEN year(d) || '' || (year(d) + 1) ELSE (year(d) - 1) || '' || year(d) END AS season FROM d""",
)
def t11(t):
    rows = listings(t, "day").select("day").distinct()
    day = F.to_date("day")
    return rows.select("day", dates.season_year(F.date_format(day, "MMMM"), F.year(day), F.year(day) + 1).cast("long").alias("exhibit_year"), dates.league_season(day).alias("season"))


_HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_PAIRS = f"list_filter(string_split({_QUERY}, '&'), lambda p: length(p) > 0 AND NOT regexp_matches(p, '^(utm_[^=]+|fbclid|gclid|mc_[^=]+)(=|$)'))"


@check(
    "h1_canonical_url",
    f"SELECT page_id, 'https://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN len({_PAIRS}) > 0 THEN '?' || array_to_string({_PAIRS}, '&') ELSE '' END AS canonical FROM pages",
)
def h1(t):
    return t.pages.select("page_id", urls.canonical_url("url").alias("canonical"))


@check(
    "h2_url_key",
    f"""SELECT page_id, regexp_extract(url, '^(https?)', 1) || '://' || regexp_replace({_HOST}, '^www\\.', '') || regexp_replace({_PATH}, '/+$', '')
     || CASE WHEN len({_PAIRS}) > 0 THEN '?' || array_to_string(list_sort({_PAIRS}), '&') ELSE '' END AS key, {_HOST} AS host FROM pages""",
)
def h2(t):
    return t.pages.select("page_id", urls.url_key("url").alias("key"), urls.host("url").alias("host"))


@check("h3_fingerprints", "WITH {lv} SELECT id, sha256(title || chr(10) || description) AS fingerprint, 'series-' || left(sha256(series), 16) AS stable FROM lv")
def h3(t):
    rows = listings(t, "title", "description", "series")
    return rows.select("id", urls.fingerprint("title", "description").alias("fingerprint"), urls.stable_id("series-", F.col("series")).alias("stable"))


@check("h4_stable_seed")
def h4(t):
    return listings(t).select("id", urls.seed("id").alias("seed"))


@check(
    "h5_miles",
    """SELECT s_suppkey, round(3958.8 * 2 * atan2(sqrt(a), sqrt(1 - a)), 6) AS miles FROM (SELECT s_suppkey, pow(sin(radians(37.3 - (37 + s_suppkey % 100 / 100.0)) / 2), 2)
     + cos(radians(37 + s_suppkey % 100 / 100.0)) * cos(radians(37.3)) * pow(sin(radians(-121.9 - (-122 + s_nationkey / 25.0)) / 2), 2) AS a FROM supplier)""",
)
def h5(t):
    lat, lon = F.lit(37.0) + F.col("s_suppkey") % 100 / 100.0, F.lit(-122.0) + F.col("s_nationkey") / 25.0
    return t.supplier.select("s_suppkey", F.round(urls.miles_between(lat, lon, F.lit(37.3), F.lit(-121.9)), 6).alias("miles"))


@check(
    "h6_navigation_target",
    """SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '37.' || s_nationkey || ',-121.9' WHEN 1 THEN (s_suppkey % 900 + 100) || ' Main Street' ELSE '36.5,-121.' || s_nationkey END AS destination,
     CASE s_suppkey % 3 WHEN 1 THEN 'address' ELSE 'coordinates' END AS type FROM supplier""",
)
def h6(t):
    mode, n = F.col("s_suppkey") % 3, F.col("s_nationkey").cast("string")
    point = F.when(mode == 0, F.concat(F.lit("37."), n, F.lit(", -121.9"))).otherwise(F.lit("137.0,-121.9"))
    address = F.when(mode == 1, F.concat((F.col("s_suppkey") % 900 + 100).cast("string"), F.lit(" Main Street")))
    map_url = F.concat(F.lit("https://maps.example.org/dir/?api=1&destination=36.5,-121."), n)
    target = urls.navigation_target([point], [address], map_url)
    return t.supplier.select("s_suppkey", target["destination"].alias("destination"), target["type"].alias("type"))


@check("h7_array_values", "SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS suppliers, min(l_suppkey) AS low FROM lineitem GROUP BY 1")
def h7(t):
    """Distinct unions over pre-aggregated values."""
    pairs = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_suppkey").distinct()
    return pairs.groupBy("k").agg(F.count("*").alias("suppliers"), F.min("l_suppkey").alias("low"))


@check(
    "h8_usable_images",
    """WITH {lv}, i AS (SELECT id, CASE line % 4 WHEN 0 THEN 'https://img.example.org/site-logo.png' WHEN 1 THEN 'https://img.example.org/a.jpg?w=' || (part % 900)
     WHEN 2 THEN 'https://img.example.org/w_' || (part % 900) || ',h_100/b.jpg' ELSE 'https://img.example.org/c.jpg' END AS image, line % 4 AS m, part % 900 AS w FROM lv)
     SELECT id, CASE WHEN m = 0 THEN false WHEN m IN (1, 2) THEN w >= 400 ELSE true END AS usable FROM i""",
)
def h8(t):
    rows = listings(t, "line", "part")
    mode, width = F.col("line") % 4, (F.col("part") % 900).cast("string")
    image = (
        F.when(mode == 0, F.lit("https://img.example.org/site-logo.png")).when(mode == 1, F.concat(F.lit("https://img.example.org/a.jpg?w="), width))
        .when(mode == 2, F.concat(F.lit("https://img.example.org/w_"), width, F.lit(",h_100/b.jpg"))).otherwise(F.lit("https://img.example.org/c.jpg"))
    )
    return rows.select("id", urls.usable_image(image).alias("usable"))


@check("h9_provenance_map", "WITH {lv} SELECT id, CASE WHEN line % 2 = 0 THEN 'description=old image=page' ELSE 'date_value=page description=old image=page' END AS evidence FROM lv")
def h9(t):
    from ..operators.enrichment import provenance

    rows = listings(t, "line")
    old = F.map_from_entries(
        F.transform(
            F.array(F.lit("description"), F.lit("image")),
            lambda f: F.struct(f, F.struct(F.lit("feed").alias("source"), F.lit("old").alias("method"), F.lit("u").alias("source_url"), F.lit(TODAY).alias("verified_at"))),
        )
    )
    fields = F.when(F.col("line") % 2 == 0, F.array(F.lit("image"))).otherwise(F.array(F.lit("date_value"), F.lit("image")))
    merged = provenance(old, fields, F.lit("u2"), F.lit(TODAY), F.lit("page"))
    shown = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]["method"])))
    return rows.select("id", F.array_join(shown, " ").alias("evidence"))


@check(
    "h10_change_detection",
    "WITH {lv} SELECT source_id, count(*) FILTER (WHERE line % 3 = 0) AS changed, count(*) FILTER (WHERE line % 3 <> 0) AS same FROM lv GROUP BY 1",
)
def h10(t):
    rows = listings(t, "source_id", "title", "place", "date_value", "line")
    fields = ["id", "title", "place", "date_value"]
    moved = F.when(F.col("line") % 3 == 0, F.concat("place", F.lit(" hall"))).otherwise(F.col("place"))
    before, after = urls.content_hash(fields), urls.content_hash(["id", "title", moved, "date_value"])
    compared = rows.select("source_id", (before != after).alias("changed"))
    return compared.groupBy("source_id").agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("same"))
