"""Link status: a decision over the listing, its source contract and the landed page of its URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.defaults import text
from ..functions.regex import has
from ..functions.text import page_carries_title

# Wording of error pages that answer with a success status.
SOFT_ERROR = (
    r"\b(?:page\s+not\s+found|event\s+(?:is\s+)?(?:unavailable|expired)|access\s+denied"
    r"|the\s+requested\s+page\s+could\s+not\s+be\s+found)\b"
)
WORKING = ["ok", "redirected", "blocked-machine"]


def link_status(
    canonical: Column, allowed: Column, http_status: Column, final_url: Column, final_allowed: Column, html: Column, title_words: Column,
    curated: Column,
) -> Column:
    """First rule that applies: static policy, then the page's answer, its target, its wording and its identity."""
    target = urls.canonical_url(final_url)
    visible = F.regexp_replace(text(html), r"(?i)<script\b[^>]*>[\s\S]*?</script>|<style\b[^>]*>[\s\S]*?</style>", "")
    return (
        F.when((F.length(canonical) == 0) | ~allowed | ~urls.user_facing(canonical), F.lit("invalid"))
        .when(http_status.isin(403, 429), F.lit("blocked-machine"))
        .when(http_status.isin(404, 410), F.lit("not-found"))
        .when(http_status.isNull() | ~http_status.between(200, 299) | ~final_allowed, F.lit("unknown"))
        .when(has(visible, SOFT_ERROR), F.lit("content-mismatch"))
        .when(~page_carries_title(title_words, html) & ~(curated & (target == canonical)), F.lit("content-mismatch"))
        .when(target == canonical, F.lit("ok"))
        .otherwise(F.lit("redirected"))
    )


def resolution(status: Column, canonical: Column, fallback: Column) -> Column:
    """``struct(url, link_resolution)`` of the published link."""
    works = status.isin(*WORKING)
    return F.struct(
        F.when(works, canonical).otherwise(text(fallback)).alias("url"),
        F.when(works, F.lit("canonical")).when(F.length(text(fallback)) > 0, F.lit("fallback")).otherwise(F.lit("unavailable")).alias("link_resolution"),
    )
