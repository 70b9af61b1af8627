"""Joins that try several rules in order: aliases, references, picks, source contracts, revisions, detail pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.defaults import text
from ..functions.text import edition_title_key
from .keep import keep_last, top_n


def alias_index(events: DataFrame, order: list[str], id: str = "id", legacy: str = "legacy_ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``alias -> id``; the last event that claims an alias owns it. ``keep`` names columns of ``order`` that stay."""
    own = F.array_union(F.array(F.col(id)), F.coalesce(F.col(legacy), F.array().cast("array<string>")))
    ties = [o for o in order if o != "id"]
    claims = events.select(F.explode(own).alias("alias"), F.col(id).alias("id"), *ties).filter(F.length(text("alias")) > 0)
    return keep_last(claims, ["alias"], [*ties, "id"]).select("alias", "id", *keep)


def first_rule_match(refs: DataFrame, ref_key: str, rules: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of per-rule matches ``(ref_key, id, *order)``; the earliest rule, then the earliest event, wins.

    References without a match are kept with a NULL ``id`` and rule 0.
    """
    tagged = [m.select(ref_key, "id", *order, F.lit(i).alias("rule")) for i, m in enumerate(rules, 1)]
    best = top_n(reduce(DataFrame.unionByName, tagged), [ref_key], [F.col("rule"), *[F.col(o) for o in order], F.col("id")], 1)
    return refs.join(best.select(ref_key, "id", "rule"), ref_key, "left").withColumn("rule", F.coalesce("rule", F.lit(0)))


def _earliest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Only the first event of a key can win a rule, so each key meets the references with one row."""
    return top_n(rows, [key], [*[F.col(o) for o in order], F.col("id")], 1)


def resolve_references(refs: DataFrame, events: DataFrame, sessions: DataFrame, order: list[str]) -> DataFrame:
    """Collection references ``(ref, ref_id, ref_url)``: by id or alias, then by event or session URL."""
    aliases = alias_index(events, order, keep=tuple(o for o in order if o != "id"))
    by_id = refs.join(aliases, F.col("ref_id") == F.col("alias")).select("ref", "id", *order)
    links = events.select("id", "url", *order).unionByName(sessions.select("id", "url", *order))
    links = _earliest(links, "url", order)
    by_url = refs.join(links, (F.col("ref_url") == F.col("url")) & (F.length(text("ref_url")) > 0)).select("ref", "id", *order)
    return first_rule_match(refs, "ref", [by_id, by_url], order)


def resolve_picks(refs: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """Picks ``(ref, ref_id, ref_url, ref_names)``: by id or alias, then URL identity, then edition title."""
    own = F.array_union(F.array("id"), F.coalesce(F.col("legacy_ids"), F.array().cast("array<string>")))
    by_id = refs.join(_earliest(events.select("id", *order, F.explode(own).alias("alias")), "alias", order), F.col("ref_id") == F.col("alias"))
    keyed = refs.select("ref", F.explode(urls.match_keys(F.col("ref_url"))).alias("key"))
    by_url = keyed.join(_earliest(events.select("id", *order, F.explode(urls.match_keys(F.col("url"))).alias("key")), "key", order), "key")
    named = refs.select("ref", F.explode("ref_names").alias("name")).select("ref", edition_title_key("name").alias("key")).filter("key <> ''")
    by_title = named.join(_earliest(events.select("id", *order, edition_title_key("title").alias("key")), "key", order), "key")
    return first_rule_match(refs, "ref", [m.select("ref", "id", *order) for m in (by_id, by_url, by_title)], order)


def source_contract(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach ``source_key`` and ``rule``: stated id, exact name, then official host narrowed by place.

    ``sources`` has ``source_key, name, domain, ord``. Host suffixes make the domain test an equality join.
    """
    registry = sources.select("source_key", "name", "domain", F.col("ord").alias("source_ord"))
    by_id = events.join(registry, F.col("source_id") == F.col("source_key")).select("id", "source_key", "source_ord", F.lit(1).alias("rule"))
    by_name = events.join(registry, F.col("source") == F.col("name")).select("id", "source_key", "source_ord", F.lit(2).alias("rule"))
    hosts = events.select("id", F.lower(text("place")).alias("_place"), F.explode(urls.host_suffixes(urls.host("url"))).alias("domain"))
    official = hosts.join(registry, "domain")
    name = F.lower(F.col("name"))
    placed = F.when((F.col("_place") != "") & (name == F.col("_place")), 3).when(
        (F.col("_place") != "") & F.contains(name, F.col("_place")), 4
    ).otherwise(5)
    by_host = official.select("id", "source_key", "source_ord", placed.alias("rule"))
    best = top_n(by_id.unionByName(by_name).unionByName(by_host), ["id"], [F.col("rule"), F.col("source_ord")], 1)
    return events.join(best.select("id", "source_key", "rule"), "id", "left").withColumn("rule", F.coalesce("rule", F.lit(0)))


def on_allowed_host(rows: DataFrame, url: str, key: str, allowed: DataFrame, strip_www: bool = False) -> DataFrame:
    """Rows whose host is an allowed domain (``allowed.domain``) or a subdomain of one."""
    suffixes = urls.host_suffixes(urls.host(url), strip_www)
    hits = rows.select(key, F.explode(suffixes).alias("domain")).join(allowed.select("domain").distinct(), "domain", "left_semi")
    return rows.join(hits.select(key), key, "left_semi")


def matching_revision(events: DataFrame, revisions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Pick the translation of each event.

    ``events``: ``id, legacy_ids, fingerprint``; ``revisions`` and ``catalog``: ``entry_id, fingerprint, status, qa_ok,
    reviewed_at, seq``. The newest approved revision with the event's fingerprint wins, valid ones first, own id before
    aliases; otherwise the catalog entry of the first known id.
    """
    # Fingerprints meet as 16 bytes. Events and entries are shuffled once, by id and by the name that entries go by: an event
    # meets the entries of its own id where it is, so only its other names and what is found under these travel besides.
    digest = F.substring(F.unhex(F.sha2("fingerprint", 256)), 1, 16)
    entry = ["entry_id", F.col("fingerprint").alias("entry_fp"), F.col("status").alias("entry_status"), "qa_ok", "reviewed_at", "seq", digest.alias("_fp")]
    known = revisions.filter("status = 'approved'").select(*entry, F.lit(0).alias("tier")).unionByName(catalog.select(*entry, F.lit(1).alias("tier")))
    known = known.filter("entry_id IS NOT NULL")
    asked = events.withColumn("_event_fp", digest)
    fits = (F.col("tier") == 1) | (F.col("_fp") == F.col("_event_fp"))
    valid = F.when(F.col("tier") == 0, F.col("qa_ok")).otherwise(True)
    order = [F.col("tier").asc_nulls_last(), F.col("alias_pos"), valid.desc(), F.col("reviewed_at").desc(), F.col("seq").desc()]
    found = ["entry_id", "entry_fp", "entry_status", "qa_ok", "seq", "_stale"]

    def best(met: DataFrame, keys: list[str]) -> DataFrame:
        return top_n(met.withColumn("_stale", F.col("_fp") != F.col("_event_fp")), keys, order, 1)

    own = asked.withColumns({"_row": F.monotonically_increasing_id(), "alias_pos": F.lit(0)}).join(known, [F.col("id") == F.col("entry_id"), fits], "left")
    own = best(own, ["id", "_row"]).select(*events.columns, "tier", *found)
    # The outer form, since a filter on the list would be pushed below the events' own shuffles, which could not be shared then.
    names = asked.select("id", "_event_fp", F.posexplode_outer("legacy_ids").alias("alias_pos", "name"))
    named = names.join(known, [F.col("name") == F.col("entry_id"), fits])
    named = best(named, ["id"]).select("id", *[F.col(c).alias(f"_named_{c}") for c in ("tier", *found)])
    own_first = F.col("_named_tier").isNull() | (F.col("tier") <= F.col("_named_tier"))
    chosen = own.join(named, "id", "left").select(*events.columns, *[F.when(own_first, F.col(c)).otherwise(F.col(f"_named_{c}")).alias(c) for c in found])
    status = (
        F.when(F.col("entry_id").isNull(), F.lit("missing")).when(F.col("entry_status") != "approved", F.col("entry_status"))
        .when(F.col("_stale"), F.lit("stale")).when(~F.col("qa_ok"), F.lit("invalid")).otherwise(F.lit("current"))
    )
    return chosen.withColumn("translation_status", status).drop("_stale")


def reconcile(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Compare a worklist ``(id, fingerprint, url)`` with what came back; one row per problem."""
    a = expected.select("id", F.col("fingerprint").alias("want_fp"), F.col("url").alias("want_url"), F.lit(True).alias("wanted"))
    b = received.select("id", F.col("fingerprint").alias("got_fp"), F.col("url").alias("got_url"), F.lit(True).alias("got"))
    both = a.join(b, "id", "full_outer")
    issue: Column = (
        F.when(F.col("got").isNull(), F.lit("missing")).when(F.col("wanted").isNull(), F.lit("unexpected"))
        .when(F.col("got_fp") != F.col("want_fp"), F.lit("outdated-fingerprint"))
        .when((F.length(text("got_url")) > 0) & (text("got_url") != text("want_url")), F.lit("changed-url"))
    )
    return both.select("id", issue.alias("issue")).filter("issue IS NOT NULL")


def token_candidates(items: DataFrame, targets: DataFrame, at_least: int, limit: int, order: list[Column]) -> DataFrame:
    """``items(item, token)`` against ``targets(target, token, ...)``: targets that share tokens, best ``limit`` per item.

    Both sides hold one row per distinct token. Where two tokens are asked for, rows meet on pairs of tokens, so a word that
    every target has brings nothing together by itself; n shared tokens are n (n - 1) / 2 shared pairs. Counts combine
    map-side.
    """
    keep = [name for name in targets.columns if name not in ("target", "token")]
    if at_least < 2:
        pairs = items.join(targets, "token").groupBy("item", "target", *keep).agg(F.count("*").alias("shared"))
        return top_n(pairs.filter(F.col("shared") >= at_least), ["item"], [F.col("shared").desc(), *order], limit, "place")
    met = token_pairs(items, ["item"]).join(token_pairs(targets, ["target", *keep]), "pair").groupBy("item", "target", *keep).agg(F.count("*").alias("_met"))
    shared = ((1 + F.sqrt(1 + 8 * F.col("_met"))) / 2).cast("long")
    counted = met.withColumn("shared", shared).drop("_met").filter(F.col("shared") >= at_least)
    return top_n(counted, ["item"], [F.col("shared").desc(), *order], limit, "place")


def token_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, pair)``: all pairs of a row's tokens, the tokens of a title or a path."""
    words = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("_words"))
    behind = lambda word, i: F.transform(F.slice("_words", i + 2, F.size("_words")), lambda other: F.concat_ws(" ", word, other))
    return words.select(*keys, F.explode(F.flatten(F.transform("_words", behind))).alias("pair"))


def matching_rules(rows: DataFrame, column: str, rules: DataFrame, most: int = 1000) -> DataFrame:
    """The rows with the ``rule`` of every pattern that their text matches; ``rules``: ``rule, pattern``.

    A rule table is configuration of a proven size: with more than ``most`` rows this raises instead of comparing every row
    with every pattern. The patterns travel inside the expression, so nothing is joined.
    """
    found = rules.select("rule", "pattern").orderBy("rule", "pattern").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules; route them by a key first")
    hits = F.array_compact(F.array(*[F.when(F.regexp_like(F.col(column), F.lit(r["pattern"])), F.lit(r["rule"])) for r in found])) if found else F.array().cast("array<string>")
    return rows.withColumn("rule", F.explode(hits))


def overrides_by_title(events: DataFrame, overrides: DataFrame, order: list[str]) -> DataFrame:
    """Attach the last matching override ``(title_key, day, source, image, seq)``; an empty day matches any day."""
    dated = overrides.filter("day <> ''").join(
        events.select("id", "title_key", "source", "day"), ["title_key", "source", "day"]
    )
    undated = overrides.filter("day = ''").drop("day").join(events.select("id", "title_key", "source"), ["title_key", "source"])
    hits = dated.select("id", F.col("image").alias("override_image"), "seq").unionByName(
        undated.select("id", F.col("image").alias("override_image"), "seq")
    )
    last = top_n(hits, ["id"], [F.col("seq").desc()], 1)
    return events.join(last.select("id", "override_image"), "id", "left")
