"""Joins (J), sorts (L) and set operations (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.defaults import key_of
from ..operators import catalog, curation, duplicates, enrichment, resolve, series, supplements
from ..operators.containment import containing
from ..operators.keep import keep_last, top_n
from ..operators.rank import ranked
from ..plans.listings import listings
from .functions import _HOST, _KEY, tokens_sql
from .registry import FRIDAY, NOW, TODAY, check, day_sql, end_sql, first_nonempty_sql, q, rx


def aliased(t, *more):
    """Listings whose legacy ids are shared by the rows of an order line slot."""
    rows = listings(t, "part", "line", "orderkey", *more)
    return rows.withColumn("legacy_ids", F.array(F.concat(F.lit("old-"), F.col("part").cast("string"), F.lit("-"), F.col("line").cast("string"))))


@check(
    "j1_alias_index",
    """WITH {lv}, a AS (SELECT id AS alias, id, ord FROM lv UNION ALL SELECT 'old-' || part || '-' || line, id, ord FROM lv)
     SELECT alias, id FROM (SELECT alias, id, row_number() OVER (PARTITION BY alias ORDER BY ord DESC, id DESC) AS r FROM a) WHERE r = 1""",
)
def j1(t):
    return resolve.alias_index(aliased(t), ["ord", "id"])


def _refs(t):
    """References of one collection per supplier: by old id, by URL, or unresolvable."""
    rows = listings(t, "part", "line", "url", "supp")
    mode = F.col("line") % 4
    return rows.select(
        F.col("id").alias("ref"), F.when(mode == 1, F.concat(F.lit("old-"), F.col("part").cast("string"), F.lit("-1"))).otherwise(F.lit("gone")).alias("ref_id"),
        F.when(mode == 2, F.col("url")).otherwise(F.lit("")).alias("ref_url"),
    )


@check(
    "j2_collection_references",
    """WITH {lv}, refs AS (SELECT id AS ref, CASE WHEN line % 4 = 1 THEN 'old-' || part || '-1' ELSE 'gone' END AS ref_id, CASE WHEN line % 4 = 2 THEN url ELSE '' END AS ref_url FROM lv),
     a AS (SELECT alias, id FROM (SELECT 'old-' || part || '-' || line AS alias, id, row_number() OVER (PARTITION BY part, line ORDER BY ord DESC, id DESC) AS r FROM lv) WHERE r = 1),
     u AS (SELECT url, id FROM (SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY ord, id) AS r FROM lv) WHERE r = 1)
     SELECT ref, coalesce(a.id, u.id) AS id, CAST(CASE WHEN a.id IS NOT NULL THEN 1 WHEN u.id IS NOT NULL THEN 2 ELSE 0 END AS BIGINT) AS rule
     FROM refs LEFT JOIN a ON a.alias = ref_id LEFT JOIN u ON u.url = ref_url""",
)
def j2(t):
    events = aliased(t, "url")
    out = resolve.resolve_references(_refs(t), events.select("id", "legacy_ids", "url", "ord"), events.select("id", "url", "ord"), ["ord"])
    return out.select("ref", "id", F.col("rule").cast("long").alias("rule"))


@check(
    "j3_pick_resolution",
    f"""WITH {{lv}}, keyed AS (SELECT id, ord, 's' || supp || '.example.org' AS host, CAST(orderkey AS VARCHAR) AS value, {_KEY} AS title_key FROM lv),
     refs AS (SELECT id AS ref, CASE WHEN line % 4 = 1 THEN id ELSE '' END AS ref_id, CASE WHEN line % 4 = 2 THEN 's' || supp || '.example.org' END AS host, CAST(orderkey AS VARCHAR) AS value,
      CASE WHEN line % 4 = 3 THEN {_KEY} END AS title_key FROM lv),
     u AS (SELECT host, value, min(id ORDER BY ord, id) AS any_id, arg_min(id, (ord, id)) AS id FROM keyed GROUP BY 1, 2),
     n AS (SELECT title_key, arg_min(id, (ord, id)) AS id FROM keyed GROUP BY 1)
     SELECT ref, CASE WHEN ref_id <> '' THEN ref_id ELSE coalesce(u.id, n.id) END AS id FROM refs r LEFT JOIN u ON u.host = r.host AND u.value = r.value LEFT JOIN n ON n.title_key = r.title_key""",
)
def j3(t):
    rows = listings(t, "title", "url", "line", "supp", "orderkey")
    events = rows.withColumn("legacy_ids", F.array().cast("array<string>"))
    line = F.col("line") % 4
    other_url = F.concat(F.lit("http://S"), F.col("supp").cast("string"), F.lit(".example.org/other?id="), F.col("orderkey").cast("string"), F.lit("&gclid=1#top"))
    refs = rows.select(
        F.col("id").alias("ref"), F.when(line == 1, F.col("id")).otherwise(F.lit("")).alias("ref_id"), F.when(line == 2, other_url).otherwise(F.lit("")).alias("ref_url"),
        F.when(line == 3, F.array(F.concat(F.lit("2026 Annual "), "title"))).otherwise(F.array(F.lit(""))).alias("ref_names"),
    )
    return resolve.resolve_picks(refs, events, ["ord"]).select("ref", "id")


@check(
    "j5_source_contract",
    """WITH {lv} SELECT id, CASE WHEN line % 3 = 2 AND supp % 4 = 0 THEN NULL ELSE 's-' || supp END AS source_key,
     CAST(CASE line % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN supp % 4 = 0 THEN 0 ELSE 5 END END AS BIGINT) AS rule FROM lv""",
)
def j5(t):
    rows = listings(t, "source", "source_id", "place", "url", "line", "supp")
    mode = F.col("line") % 3
    events = rows.select(
        "id", F.when(mode == 0, F.col("source_id")).otherwise(F.lit("")).alias("source_id"),
        F.when(mode == 1, F.col("source")).otherwise(F.lit("Calendar")).alias("source"), "place", "url",
    )
    registry = t.supplier.select(
        F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("source_key"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.org"))).alias("domain"),
    )
    return resolve.source_contract(events, registry).select("id", "source_key", F.col("rule").cast("long").alias("rule"))


@check("j6_allowed_hosts", f"SELECT page_id FROM pages WHERE regexp_matches({_HOST}, '(^|\\.)(example\\.org|casino-win\\.example\\.com)$')")
def j6(t):
    allowed = t.region.select(F.explode(F.array(F.lit("example.org"), F.lit("casino-win.example.com"))).alias("domain"))
    return resolve.on_allowed_host(t.pages, "url", "page_id", allowed).select("page_id")


_ACTIVE = f"{end_sql('date_value', 'end_date_value', '240')} > '{NOW}'"


def _previous(t, *more):
    rows = listings(t, "source", "title", "url", "date_value", "end_date_value", "line", "supp", *more)
    from ..functions import dates

    return rows.withColumn("active", dates.is_active(dates.effective_end("date_value", "end_date_value", F.lit(240)), NOW))


@check(
    "j7_vanished_listings",
    f"""WITH {{lv}}, p AS (SELECT * FROM lv WHERE {_ACTIVE} AND supp % 5 <> 0), f AS (SELECT DISTINCT source, lower(title) AS title, lower(url) AS url FROM lv WHERE line % 2 = 0)
     SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = p.source AND f.title = lower(p.title) AND f.url = lower(p.url))""",
)
def j7(t):
    rows = _previous(t)
    succeeded = t.supplier.filter("s_suppkey % 5 <> 0").select(F.col("s_name").alias("source"))
    return catalog.vanished(rows, rows.filter("line % 2 = 0"), succeeded, F.col("active")).select("id")


@check(
    "j7_rechecked_listings",
    f"""WITH {{lv}}, p AS (SELECT *, part % 7 AS m FROM lv WHERE {_ACTIVE} AND supp % 5 <> 0 AND line % 2 = 1)
     SELECT id, CASE WHEN supp % 5 = 1 THEN 'untrusted' WHEN m = 0 THEN 'not-fetched' WHEN m = 1 THEN 'other-event' WHEN m = 2 THEN 'cancelled' WHEN m = 3 AND day <> '2026-06-20' THEN 'other-day' ELSE 'confirmed' END AS recheck FROM p""",
)
def j7_rechecked(t):
    """Listings that a feed dropped, against their pages: not there, of another event, cancelled, of another day, or as before."""
    missing = _previous(t, "day", "part").filter("active AND supp % 5 <> 0 AND line % 2 = 1")
    mode = F.col("part") % 7
    says = (
        F.when(mode == 1, F.lit("Quite another thing")).when(mode == 2, F.concat("title", F.lit(". This event has been cancelled.")))
        .when(mode == 3, F.concat("title", F.lit(" When: Saturday, June 20, 2026"))).otherwise(F.col("title"))
    )
    pages = missing.select("source", "url", F.when(mode == 0, 404).otherwise(200).alias("status"), F.concat(F.lit("<nav>Menu</nav><h1>"), says, F.lit("</h1>")).alias("html"))
    key = F.col("s_suppkey")
    sources = t.supplier.select(F.col("s_name").alias("source"), F.concat(F.lit("s"), key.cast("string"), F.lit(".example.org")).alias("domain"), F.when(key % 5 == 1, F.lit("annual-festival")).otherwise(F.lit("rss")).alias("method"))
    return catalog.rechecked(missing, pages, sources).select("id", "recheck")


@check("j8_last_known_good", f"WITH {{lv}} SELECT id, 'stale-source' AS refresh_status FROM lv WHERE {_ACTIVE} AND supp % 5 = 0")
def j8(t):
    failed = t.supplier.filter("s_suppkey % 5 = 0").select(F.col("s_name").alias("source"))
    return catalog.retained(_previous(t), failed, F.col("active")).select("id", "refresh_status")


def supplement_rows(t):
    """One curated row per part: a re-ordered title, an exact title, a shared URL, or something new."""
    base = listings(t, "title", "source", "day", "url", "part", "line", "image")
    first = top_n(base, ["part"], [F.col("ord"), F.col("id")], 1)
    mode = F.col("part") % 4
    return first.select(
        F.concat(F.lit("sup-"), F.col("part").cast("string")).alias("id"),
        F.when(mode == 0, F.array_join(F.reverse(F.split("title", " ")), " ")).when(mode == 1, F.col("title"))
        .otherwise(F.concat(F.lit("Curated "), F.col("part").cast("string"))).alias("title"),
        F.col("day").alias("date_value"), "source",
        F.when(mode == 2, F.col("url")).otherwise(F.concat(F.lit("https://new.example.org/"), F.col("part").cast("string"))).alias("url"),
        F.lit("https://img.example.org/curated.jpg").alias("image"), (F.col("part") % 8 == 2).alias("replace_existing"), F.col("ord"),
    )


@check(
    "j9_supplement_actions",
    f"""WITH {{lv}}, f AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ord, id) AS r FROM lv),
     s AS (SELECT 'sup-' || part AS supplement_id, part, part % 4 AS m, part % 8 = 2 AS repl, title, source, day, url FROM f WHERE r = 1),
     hit AS (SELECT s.supplement_id, m, repl, l.id AS event_id, l.image, l.ord, row_number() OVER (PARTITION BY s.supplement_id ORDER BY l.ord, l.id) AS r FROM s JOIN lv l ON
       CASE m WHEN 0 THEN l.day = s.day AND l.source = s.source AND l.title = s.title WHEN 1 THEN l.day = s.day AND l.title = s.title
        WHEN 2 THEN (l.day = s.day OR repl) AND l.url = s.url ELSE false END)
     SELECT s.supplement_id, h.event_id, CASE WHEN h.event_id IS NULL THEN 'insert' WHEN s.m = 0 THEN 'alias-only' WHEN s.repl THEN 'replace' WHEN h.image = '' THEN 'image-only'
      ELSE 'alias-only' END AS action FROM s LEFT JOIN hit h ON h.supplement_id = s.supplement_id AND h.r = 1""",
)
def j9(t):
    live = listings(t, "title", "source", "date_value", "url", "image").withColumn("image_status", F.lit("official"))
    return supplements.match_supplements(live, supplement_rows(t), ["ord", "id"])


@check(
    "j9_supplements_applied",
    """WITH {lv}, f AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ord, id) AS r FROM lv),
     c AS (SELECT 'sup-' || part AS sid, part, part % 4 AS m, part % 8 = 2 AS repl, title, source, day, ord, CASE WHEN part % 4 = 2 THEN url ELSE 'https://new.example.org/' || part END AS url,
       CASE part % 4 WHEN 0 THEN array_to_string(list_reverse(string_split(title, ' ')), ' ') WHEN 1 THEN title ELSE 'Curated ' || part END AS stitle FROM f WHERE r = 1),
     s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY trim(regexp_replace(lower(stitle), '[^a-z0-9]+', ' ', 'g')), day ORDER BY ord, sid) = 1),
     hit AS (SELECT s.sid, l.id AS event_id, l.image, row_number() OVER (PARTITION BY s.sid ORDER BY l.ord, l.id) AS r FROM s JOIN lv l ON
       CASE m WHEN 0 THEN l.day = s.day AND l.source = s.source AND l.title = s.title WHEN 1 THEN l.day = s.day AND l.title = s.title
        WHEN 2 THEN (l.day = s.day OR repl) AND l.url = s.url ELSE false END),
     a AS (SELECT s.*, h.event_id, h.image AS had FROM s LEFT JOIN hit h ON h.sid = s.sid AND h.r = 1),
     g AS (SELECT event_id, max(CASE WHEN m <> 0 AND repl THEN stitle END) AS new_title, bool_or(m <> 0 AND NOT repl AND had = '') AS pictured,
       array_to_string(list_sort(list(sid)), ',') AS legacy FROM a WHERE event_id IS NOT NULL GROUP BY 1)
     SELECT id, coalesce(new_title, title) AS title, date_value, url, CASE WHEN new_title IS NOT NULL OR coalesce(pictured, false) THEN 'https://img.example.org/curated.jpg' ELSE image END AS image,
      CASE WHEN new_title IS NOT NULL THEN 'verified-supplement' ELSE '' END AS refresh_status, coalesce(legacy, '') AS legacy FROM lv LEFT JOIN g ON g.event_id = lv.id
     UNION ALL SELECT sid, stitle, day, url, 'https://img.example.org/curated.jpg', 'verified-supplement', '' FROM a WHERE event_id IS NULL""",
)
def j9_applied(t):
    """The whole catalog after its curated rows, at a time when nothing is over."""
    live = listings(t, "title", "source", "date_value", "end_date_value", "url", "image").withColumn("image_status", F.lit("official"))
    out = curation.apply_supplements(live, supplement_rows(t), ["ord", "id"], "1990-01-01T00:00:00")
    return out.select("id", "title", "date_value", "url", "image", "refresh_status", F.array_join("legacy_ids", ",").alias("legacy"))


@check(
    "j10_image_overrides",
    f"""WITH {{lv}}, e AS (SELECT id, {_KEY} AS k, source, day FROM lv), o AS (SELECT DISTINCT {_KEY} AS k, source, CASE WHEN part % 2 = 0 THEN day ELSE '' END AS day, 'https://img.example.org/o' || part || '-' || supp || '.jpg' AS image,
      part * 1000 + supp AS seq FROM lv WHERE line = 1),
     h AS (SELECT e.id, o.image, row_number() OVER (PARTITION BY e.id ORDER BY o.seq DESC, o.day DESC) AS r FROM e JOIN o ON e.k = o.k AND e.source = o.source AND (o.day = '' OR o.day = e.day))
     SELECT e.id, h.image AS override_image FROM e LEFT JOIN h ON h.id = e.id AND h.r = 1""",
)
def j10(t):
    rows = listings(t, "title", "source", "day", "part", "supp", "line")
    keyed = rows.withColumn("title_key", text.title_key("title"))
    given = keyed.filter("line = 1").select(
        "title_key", "source", F.when(F.col("part") % 2 == 0, F.col("day")).otherwise(F.lit("")).alias("day"), (F.col("part") * 1000 + F.col("supp")).alias("seq"),
        F.concat(F.lit("https://img.example.org/o"), F.col("part").cast("string"), F.lit("-"), F.col("supp").cast("string"), F.lit(".jpg")).alias("image"),
    ).distinct()
    return resolve.overrides_by_title(keyed.select("id", "title_key", "source", "day"), given, ["ord"]).select("id", "override_image")


def duplicate_rows(t):
    """Monthly fairs: four calendars publish the activities of three cities and five addresses."""
    rows = listings(t, "title", "day", "part", "supp", "line", "image", "url").withColumn("day", F.concat(F.left("day", F.lit(7)), F.lit("-01")))
    return rows.select(
        "ord", "id", "title", F.when(F.col("line") % 2 == 0, F.col("day")).otherwise(F.concat("day", F.lit("T10:00"))).alias("date_value"),
        F.concat(F.lit("City "), (F.col("part") % 3).cast("string")).alias("city"), F.concat(F.lit("Source "), (F.col("supp") % 4).cast("string")).alias("source"),
        F.concat((F.col("part") % 5 + 100).cast("string"), F.lit(" Main Street")).alias("address"), F.lit("Hall").alias("place"), "image", "url",
    )


_DUP_SQL = """WITH {lv}, e AS (SELECT ord, id, title, left(day, 7) || '-01' AS day, CASE WHEN line % 2 = 0 THEN '' ELSE '10:00' END AS clock, 'City ' || (part % 3) AS city, 'Source ' || (supp % 4) AS source,
   (part % 5 + 100) || ' main st hall' AS loc, list_filter(list_distinct(string_split(lower(title), ' ')), lambda w: length(w) > 2) AS words FROM lv)"""


@check(
    "j11_duplicate_pairs",
    _DUP_SQL + """ SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.day = b.day AND a.city = b.city AND (a.ord, a.id) < (b.ord, b.id)
     AND (a.clock = '' OR b.clock = '' OR a.clock = b.clock)
     WHERE (a.source = b.source AND a.title = b.title) OR (a.loc = b.loc AND len(list_intersect(a.words, b.words)) >= 2 AND len(list_intersect(a.words, b.words)) >= 0.6 * least(len(a.words), len(b.words)))""",
)
def j11(t):
    """Every pair of listings that match, the earlier one first."""
    return duplicates.listing_pairs(duplicates.classes(duplicates.match_features(duplicate_rows(t)), "source"))


@check(
    "j12_detail_override",
    f"WITH {{lv}} SELECT id, CASE WHEN supp % 2 = 0 AND part % 3 = 0 THEN 'https://detail.example.org/' || part || '/' || day ELSE '' END AS detail_url FROM lv",
)
def j12(t):
    rows = listings(t, "title", "day", "part", "supp").withColumn("title_key", text.title_key(F.concat_ws(" ", "title", F.col("part").cast("string"), F.col("supp").cast("string"))))
    given = rows.filter("supp % 2 = 0 AND part % 3 = 0").select("title_key", "day", F.concat(F.lit("https://detail.example.org/"), F.col("part").cast("string"), F.lit("/"), "day").alias("detail_url")).distinct()
    return rows.join(given, ["title_key", "day"], "left").select("id", F.coalesce("detail_url", F.lit("")).alias("detail_url"))


@check("j13_evidence_reuse", "WITH {lv} SELECT id, CASE WHEN line % 2 = 0 AND image <> '' THEN image ELSE '' END AS image, CASE WHEN line % 3 = 0 THEN 'Back to top' ELSE address END AS address FROM lv")
def j13(t):
    rows = listings(t, "image", "address", "line", "url")
    same = urls.canonical_url("url") == urls.canonical_url(F.when(F.col("line") % 2 == 0, F.col("url")).otherwise(F.lit("https://moved.example.org/")))
    image = enrichment.reuse_evidence(F.lit(""), F.col("image"), F.lit("og:image"), same, F.lit(False), "image")
    kept = enrichment.reuse_evidence(F.when(F.col("line") % 3 == 0, F.lit("Back to top")).otherwise(F.col("address")), F.lit("Site Footer 12"), F.lit("page"), F.col("line") % 3 != 0, F.lit(False), "address")
    return rows.select("id", image.alias("image"), kept.alias("address"))


@check(
    "j14_inbox_reconciliation",
    """WITH {lv} SELECT id, CASE WHEN line = 1 THEN 'missing' WHEN line = 2 THEN 'unexpected' WHEN line = 3 THEN 'outdated-fingerprint' WHEN line = 4 THEN 'changed-url' END AS issue FROM lv WHERE line <= 4""",
)
def j14(t):
    rows = listings(t, "title", "url", "line").withColumn("fingerprint", F.sha2("title", 256))
    expected = rows.filter("line <> 2").select("id", "fingerprint", "url")
    line = F.col("line")
    received = rows.filter("line <> 1").select(
        "id", F.when(line == 3, F.lit("old")).otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(line == 4, F.lit("https://x.example.org/")).otherwise(F.col("url")).alias("url")
    )
    return resolve.reconcile(expected, received)


@check("j17_stale_snapshot", "WITH {lv} SELECT id FROM lv WHERE line % 5 = 0 OR line = 7")
def j17(t):
    rows = listings(t, "title", "description", "line").withColumn("fingerprint", urls.fingerprint("title", "description"))
    gaps = rows.withColumn("gap_fp", urls.fingerprint("title", F.when(F.col("line") % 5 == 0, F.lit("older")).otherwise(F.col("description"))))
    current = rows.filter("line <> 7").select("id", F.col("fingerprint").alias("now_fp"))
    joined = gaps.select("id", "gap_fp").join(current, "id", "left")
    return joined.filter(~F.col("gap_fp").eqNullSafe(F.col("now_fp"))).select("id")


@check(
    "j18_sitemap_candidates",
    f"""WITH {{lv}}, i AS (SELECT DISTINCT part AS item, unnest(list_distinct({tokens_sql('title', 3, text.SITEMAP_STOP)})) AS token FROM lv),
     u AS (SELECT DISTINCT 'https://www.example.org/' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '-workshop' AS target, p_name, p_type FROM part),
     v AS (SELECT target, unnest(list_distinct({tokens_sql("p_type || ' ' || p_name || ' workshop'", 3, text.SITEMAP_STOP)})) AS token FROM u),
     s AS (SELECT item, target, count(*) AS shared FROM i JOIN v USING (token) GROUP BY 1, 2 HAVING count(*) >= 2),
     r AS (SELECT item, target, shared, row_number() OVER (PARTITION BY item ORDER BY shared DESC, target) AS place FROM s) SELECT item, target, shared, place FROM r WHERE place <= 4""",
)
def j18(t):
    rows = listings(t, "title", "part")
    items = rows.select(F.col("part").alias("item"), "title").distinct().select("item", F.explode(text.tokens("title", 3, text.SITEMAP_STOP)).alias("token"))
    site = t.part.select(
        F.concat(F.lit("https://www.example.org/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-workshop")).alias("target")
    ).distinct()
    targets = site.select("target", F.size(F.split(urls.path("target"), "/")).alias("depth"), F.explode(text.tokens(urls.path("target"), 3, text.SITEMAP_STOP)).alias("token"))
    best = resolve.token_candidates(items, targets, 2, 4, [F.col("depth"), F.col("target")])
    return best.select("item", "target", "shared", F.col("place").cast("long").alias("place"))


@check("j19_configured_pages", "SELECT p_partkey AS part, r_name AS page FROM part JOIN region ON regexp_matches(p_name, '^[a-' || chr(CAST(101 + r_regionkey * 3 AS INTEGER)) || ']')")
def j19(t):
    """A small table of title patterns against every title."""
    pages = t.region.select(F.col("r_name").alias("rule"), F.concat(F.lit("^[a-"), F.char(F.lit(101) + F.col("r_regionkey") * 3), F.lit("]")).alias("pattern"))
    return resolve.matching_rules(t.part, "p_name", pages).select(F.col("p_partkey").alias("part"), F.col("rule").alias("page"))


@check("j20_venue_coordinates", "WITH {lv} SELECT id, CASE WHEN supp % 4 = 0 THEN NULL ELSE 37 + supp / 1000.0 END AS lat FROM lv")
def j20(t):
    rows = listings(t, "address", "supp").withColumn("venue", F.concat_ws(", ", "address", F.col("supp").cast("string")))
    known = t.supplier.filter("s_suppkey % 4 <> 0").select(
        F.concat((F.col("s_suppkey") % 900 + 100).cast("string"), F.lit(" Main Street, "), F.col("s_suppkey").cast("string")).alias("venue"), (F.lit(37) + F.col("s_suppkey") / 1000.0).alias("lat")
    )
    return rows.join(known, "venue", "left").select("id", "lat")


@check(
    "j21_saved_items",
    """WITH {lv}, a AS (SELECT alias, id FROM (SELECT 'old-' || part || '-' || line AS alias, id, row_number() OVER (PARTITION BY part, line ORDER BY ord DESC, id DESC) AS r FROM lv) WHERE r = 1)
     SELECT c_custkey AS saved_by, coalesce(a.id, 'old-' || (c_custkey % 300) || '-2') AS id FROM customer LEFT JOIN a ON a.alias = 'old-' || (c_custkey % 300) || '-2'""",
)
def j21(t):
    saved = t.customer.select(F.col("c_custkey").alias("saved_by"), F.concat(F.lit("old-"), (F.col("c_custkey") % 300).cast("string"), F.lit("-2")).alias("alias"))
    index = resolve.alias_index(aliased(t), ["ord", "id"])
    return saved.join(index, "alias", "left").select("saved_by", F.coalesce("id", "alias").alias("id")).distinct()


@check(
    "j22_events_in_windows",
    f"""WITH {{lv}}, w AS (SELECT n_nationkey AS w, DATE '1997-01-01' + to_days(CAST(n_nationkey * 14 AS INTEGER)) AS a, DATE '1997-01-01' + to_days(CAST(n_nationkey * 14 + 2 AS INTEGER)) AS b FROM nation)
     SELECT CAST(w AS BIGINT) AS window_no, count(*) AS n FROM lv JOIN w ON CAST(left(date_value, 10) AS DATE) <= b AND CAST(left({first_nonempty_sql('end_date_value', 'date_value')}, 10) AS DATE) >= a GROUP BY 1""",
)
def j22(t):
    """Many windows: each window is spread over its days and joined on the day; each listing over its own few days."""
    rows = listings(t, "date_value", "end_date_value")
    first, last = F.to_date(F.left("date_value", F.lit(10))), F.to_date(F.left(F.coalesce(F.nullif("end_date_value", F.lit("")), F.col("date_value")), F.lit(10)))
    days = rows.select("id", F.explode(F.sequence(first, F.greatest(first, last))).alias("d"))
    start = F.date_add(F.lit("1997-01-01").cast("date"), F.col("n_nationkey") * 14)
    windows = t.nation.select(F.col("n_nationkey").cast("long").alias("window_no"), F.explode(F.sequence(start, F.date_add(start, 2))).alias("d"))
    return days.join(windows, "d").select("window_no", "id").distinct().groupBy("window_no").agg(F.count("*").alias("n"))


@check("j23_distinct_url_metadata", "WITH {lv} SELECT id, length(url) AS chars FROM lv")
def j23(t):
    """Metadata is computed once per distinct URL and joined back."""
    rows = listings(t, "url")
    meta = rows.select("url").distinct().withColumn("chars", F.length("url").cast("long"))
    return rows.join(meta, "url").select("id", "chars")


@check("j24_fill_auto_fingerprints", "WITH {lv} SELECT id, CASE WHEN line = 7 THEN 'unknown-id' ELSE sha256(title || chr(10) || description) END AS fingerprint FROM lv WHERE line % 2 = 1")
def j24(t):
    rows = listings(t, "title", "description", "line")
    known = rows.filter("line <> 7").select("id", urls.fingerprint("title", "description").alias("fingerprint"))
    return rows.filter("line % 2 = 1").select("id").join(known, "id", "left").select("id", F.coalesce("fingerprint", F.lit("unknown-id")).alias("fingerprint"))


@check("j26_guarded_overlay", "WITH {lv} SELECT id, CASE WHEN line % 4 = 0 THEN title ELSE '译 ' || title END AS shown FROM lv")
def j26(t):
    rows = listings(t, "title", "line").withColumn("fingerprint", F.sha2("title", 256))
    stale = F.when(F.col("line") % 4 == 0, F.lit("old")).otherwise(F.col("fingerprint"))
    overlay = rows.select("id", stale.alias("fingerprint"), F.concat(F.lit("译 "), "title").alias("zh"))
    return rows.join(overlay, ["id", "fingerprint"], "left").select("id", F.coalesce("zh", "title").alias("shown"))


_FIRST = "regexp_extract(trim(text), '^\\S+\\s+\\S+\\s+\\S+\\s+\\S+\\s+\\S+')"


@check(
    "j27_evidence_containment",
    "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)
def j27(t):
    return containing(t.documents, t.benchmark)


@check("l1_missing_dates_last", "WITH {lv} SELECT id, row_number() OVER (ORDER BY CASE WHEN line = 6 THEN '9999' ELSE date_value END, ord, id) AS position FROM lv")
def l1(t):
    rows = listings(t, "date_value", "line").withColumn("shown", F.when(F.col("line") == 6, F.lit("")).otherwise(F.col("date_value")))
    order = [F.coalesce(F.nullif("shown", F.lit("")), F.lit("9999")), F.col("ord"), F.col("id")]
    return ranked(rows, order, "position").select("id", "position")


@check("l2_clamped_day_order", f"WITH {{lv}} SELECT id, row_number() OVER (ORDER BY greatest(day, '{FRIDAY}'), date_value, title, ord, id) AS position FROM lv")
def l2(t):
    rows = listings(t, "day", "date_value", "title")
    order = [F.greatest("day", F.lit(FRIDAY)), F.col("date_value"), F.col("title"), F.col("ord"), F.col("id")]
    return ranked(rows, order, "position").select("id", "position")


@check("l3_distance_order", "SELECT s_suppkey, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 37 END NULLS LAST, s_name) AS position FROM supplier")
def l3(t):
    miles = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 37)
    return ranked(t.supplier.select("s_suppkey", "s_name", miles.alias("miles")), [F.col("miles").asc_nulls_last(), F.col("s_name")], "position").select("s_suppkey", "position")


@check("l4_first_twelve", "WITH {lv} SELECT id, title, price FROM lv ORDER BY price DESC, ord, id LIMIT 12")
def l4(t):
    return listings(t, "title", "price").orderBy(F.col("price").desc(), "ord", "id").limit(12).select("id", "title", "price")


@check("l6_sorted_cities", "SELECT n_name AS city, row_number() OVER (ORDER BY n_name) AS position FROM nation")
def l6(t):
    return ranked(t.nation.select(F.col("n_name").alias("city")), [F.col("city")], "position")


@check("u1s_union_of_feeds", "WITH {lv} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN line % 3 = 0 THEN 'fresh' WHEN line % 3 = 1 THEN 'retained' ELSE 'search' END AS kind FROM lv) GROUP BY 1")
def u1s(t):
    rows = listings(t, "title", "line")
    fresh = rows.filter("line % 3 = 0").withColumn("kind", F.lit("fresh"))
    old = rows.filter("line % 3 = 1").withColumn("kind", F.lit("retained")).withColumn("refresh_status", F.lit("stale-source"))
    found = rows.filter("line % 3 = 2").drop("title").withColumn("kind", F.lit("search"))
    return catalog.histogram(fresh.unionByName(old, allowMissingColumns=True).unionByName(found, allowMissingColumns=True), "kind")


@check("u2s_distinct_aliases", "WITH {lv} SELECT DISTINCT series, a AS alias FROM (SELECT series, id AS a FROM lv UNION ALL SELECT series, 'old-' || part || '-' || line FROM lv)")
def u2s(t):
    rows = aliased(t, "series")
    return rows.select("series", F.explode(F.array_union(F.array("id"), "legacy_ids")).alias("alias")).distinct()


@check("u3s_remaining_sessions", "WITH {lv} SELECT id FROM lv WHERE NOT (line = 1 OR quantity > 40)")
def u3s(t):
    rows = listings(t, "line", "quantity")
    return rows.select("id").join(rows.filter("line = 1 OR quantity > 40").select("id"), "id", "left_anti")


@check("u4s_common_tokens", "SELECT w AS token FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size < 25) INTERSECT SELECT DISTINCT unnest(string_split(p_name, ' ')) FROM part WHERE p_size >= 25")
def u4s(t):
    words = t.part.select("p_size", F.explode(F.split("p_name", " ")).alias("token"))
    return words.filter("p_size < 25").select("token").intersect(words.filter("p_size >= 25").select("token"))
