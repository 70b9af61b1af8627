"""Pages that an organizer's page links to for one listing: which links may be its own site, and whether they are.

A link counts when it leaves the page's host, is no social or utility site, and its label, its attributes or its path name the
listing, or its label is of the kind "official website". All links are scored; the best five of a page are candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.defaults import first_nonempty, text
from ..functions.regex import all_groups, first_group, has
from ..functions.text import decode_entities, plain_text, title_key
from .keep import top_n

# Sites that are nobody's own page, labels of links to one, texts around it, and words that name no event.
SHARED_SITES = r"(?:^|\.)(?:facebook\.com|instagram\.com|x\.com|twitter\.com|linkedin\.com|nextdoor\.com|google\.com|googleapis\.com|youtube\.com|youtu\.be)$"
OWN_PAGE_LABEL = r"\b(?:event website|official website|website|learn more|more information|more info|event details|details)\b"
PAGE_CHROME = (
    r"\b(?:view map|email address|fields marked as ['’\"]?required|enter your email address|share this page|back to top|site footer|privacy policy|terms of use)\b"
)
COMMON_WORDS = ["the", "and", "for", "with", "from", "annual", "event", "festival"]
WORD_POINTS, LABEL_POINTS, CANDIDATES, SHORTEST, LONGEST = 10, 3, 5, 20, 1400


def identity_words(title: str | Column) -> Column:
    """Words of a title that tell it from others; repeats are kept."""
    return F.filter(F.split(title_key(plain_text(title)), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON_WORDS))


def named(words: Column, value: Column) -> Column:
    """How many of the words occur in a text."""
    low = F.lower(value)
    return F.size(F.filter(words, lambda w: F.contains(low, w)))


def link_candidates(pages: DataFrame) -> DataFrame:
    """``page_id, link, score, evidence, place``: at most five links of every page; ``pages``: ``page_id, html, title, url``."""
    words = identity_words("title")
    tags = F.regexp_extract_all(text("html"), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    links = pages.select("page_id", text("url").alias("url"), words.alias("words"), F.posexplode(tags).alias("pos", "tag"))
    head = r"(?is)^<a\b([^>]*)href=[\"']([^\"']+)[\"']([^>]*)>"
    read = links.select(
        "page_id", "url", "words", "pos", plain_text(F.regexp_replace("tag", r"(?is)^<a\b[^>]*>|</a>$", "")).alias("label"),
        F.concat_ws(" ", F.regexp_extract("tag", head, 1), F.regexp_extract("tag", head, 3)).alias("attributes"),
        urls.resolved(decode_entities(F.regexp_extract("tag", head, 2)), F.col("url")).alias("link"),
    ).filter((F.col("link") != "") & (urls.host("link") != urls.host("url")) & ~has(urls.host("link"), SHARED_SITES))
    path = F.regexp_replace(urls.decoded(urls.path("link")), "[-_/]+", " ")
    overlap = named(F.col("words"), F.concat_ws(" ", "label", plain_text("attributes"), path))
    generic = has(F.col("label"), OWN_PAGE_LABEL) | has(F.col("attributes"), OWN_PAGE_LABEL)
    scored = read.withColumn("score", overlap * WORD_POINTS + F.when(generic, LABEL_POINTS).otherwise(0)).filter("score > 0")
    best = top_n(scored, ["page_id", "link"], [F.desc("score"), F.col("pos")], 1)
    first = top_n(best, ["page_id"], [F.desc("score"), F.col("pos")], CANDIDATES, "place")
    return first.select("page_id", "link", "score", first_nonempty("label", urls.host("link")).alias("evidence"), "place")


def carries_title(html: str | Column, title: str | Column) -> Column:
    """The heading or title of a linked page names the listing."""
    page = text(html)
    shown = plain_text(first_nonempty(
        first_group(page, r"<h1\b[^>]*>([\s\S]*?)</h1>"), first_group(page, r"<meta\s+(?:property|name)=[\"']og:title[\"']\s+content=[\"']([^\"']+)"),
        first_group(page, r"<title\b[^>]*>([\s\S]*?)</title>")))
    words = identity_words(title)
    return (shown != "") & (F.size(words) > 0) & (named(words, shown) >= F.least(F.lit(2), F.size(words)))


def linked_description(html: str | Column) -> Column:
    """The whole text of a linked page's paragraphs, items and cells, without the page's own furniture."""
    page = text(html)
    scope = first_nonempty(*[first_group(page, rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>") for tag in ("main", "article", "body")], page)
    blocks = F.transform(all_groups(scope, r"<(?:p|li|td|dd)\b[^>]*>([\s\S]*?)</(?:p|li|td|dd)>"), plain_text)
    kept = F.filter(blocks, lambda b: F.length(b).between(SHORTEST, LONGEST) & ~has(b, PAGE_CHROME))
    return F.trim(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "))


def linked_details(pages: DataFrame, landed: DataFrame) -> DataFrame:
    """``page_id, link, description``: the first candidate of each page that landed and names the listing.

    ``landed``: ``url, html`` of fetched pages, which meet candidates on the address.
    """
    asked = link_candidates(pages).join(pages.select("page_id", "title"), "page_id").withColumn("_key", urls.url_key("link"))
    found = asked.join(landed.select(urls.url_key("url").alias("_key"), "html"), "_key").filter(carries_title("html", "title"))
    told = found.withColumn("description", linked_description("html")).filter("description <> ''")
    return top_n(told, ["page_id"], [F.col("place"), F.col("link")], 1).select("page_id", "link", "description")
