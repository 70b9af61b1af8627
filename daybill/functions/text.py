"""Text: HTML to plain text, title normal forms, tokens, sentences, chunks, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import c, let, text
from .regex import all_groups, has, java, sub

# Named HTML entities the catalog decodes, in decode order.
NAMED_ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
    ("&ldquo;", '"'), ("&rdquo;", '"'), ("&lsquo;", "'"), ("&rsquo;", "'"), ("&ndash;", "–"), ("&mdash;", "—"),
]

_ODD_SPACE = "[\u00a0\u200b-\u200d\ufeff]"
# Runs of white space that are not one space already: replacing only these by a space equals replacing all runs.
_LONG_SPACE = r" \s+|[\t\n\x0B\f\r]\s*"
# A text without a match of this is plain but for space at its ends.
_UNCLEAN = "[<\\t\\n\\x0B\\f\\r\u00a0\u200b-\u200d\ufeff]| [ ,.;:!?]|[-–—_]\\s*[-–—_]"


def _codepoint(number: Column) -> Column:
    """The character of a code point, without leaving the JVM."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")


def _numeric_entities(value: Column, prefix: str, digits: str, base: int) -> Column:
    """Decode ``&#...;`` references: split at the prefix, then replace the digits that open each later piece."""

    def fix(piece: Column) -> Column:
        code = F.regexp_extract(piece, java(f"^({digits});"), 1)
        known = (F.length(code) > 0) & (F.length(code) < 8)
        char = _codepoint(F.conv(code, base, 10))
        return F.when(known, F.concat(char, F.regexp_replace(piece, java(f"^{digits};"), ""))).otherwise(F.concat(F.lit(prefix), piece))

    def decode(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), fix)
        return F.concat(F.element_at(pieces, 1), F.array_join(rest, ""))

    return F.when(F.contains(value, F.lit(prefix)), let(F.split(value, java(prefix), -1), decode)).otherwise(value)


def decode_entities(value: str | Column) -> Column:
    """Unwrap CDATA and decode named and numeric character references; text without markup passes untouched."""

    def decode(v: Column) -> Column:
        out = F.regexp_replace(v, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")
        for entity, char in NAMED_ENTITIES:
            out = F.replace(out, F.lit(entity), F.lit(char))
        numeric = lambda x: let(_numeric_entities(x, "&#x", "[0-9A-Fa-f]+", 16), lambda y: _numeric_entities(y, "&#", "[0-9]+", 10))
        return let(out, lambda o: F.when(F.contains(o, F.lit("&#")), numeric(o)).otherwise(o))

    return let(text(value), lambda v: F.when(F.contains(v, F.lit("&")) | F.contains(v, F.lit("<![CDATA[")), decode(v)).otherwise(v))


def squeeze(value: str | Column) -> Column:
    """Collapse runs of white space, no-break and zero-width characters included."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(value), _ODD_SPACE, " "), _LONG_SPACE, " "))


def strip_markup(value: str | Column) -> Column:
    """Remove scripts, styles and tags; collapse space; no space before punctuation."""
    out = F.regexp_replace(text(value), r"(?i)<script\b[^>]*>[\s\S]*?</script>|<style\b[^>]*>[\s\S]*?</style>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(squeeze(out), r"\s+([,.;:!?])", "$1"))


def plain_text(value: str | Column) -> Column:
    """Decoded plain text of an HTML fragment, with rules of dashes dropped."""

    def strip(v: Column) -> Column:
        bare = F.regexp_replace(v, r"(?i)<script\b[^>]*>[\s\S]*?</script>|<style\b[^>]*>[\s\S]*?</style>", " ")
        return F.when(F.contains(v, F.lit("<")), F.regexp_replace(bare, r"<[^>]*>", " ")).otherwise(v)

    def clean(v: Column) -> Column:
        out = F.regexp_replace(strip(v), _ODD_SPACE, " ")
        out = F.regexp_replace(out, r"\s*+[-–—_]\s*+(?:[-–—_]\s*+){2,}", " ")
        return F.regexp_replace(F.regexp_replace(out, _LONG_SPACE, " "), " (?=[,.;:!?])", "")

    return F.trim(let(decode_entities(value), lambda v: F.when(v.rlike(_UNCLEAN), clean(v)).otherwise(v)))


def source_description(html: str | Column) -> Column:
    """Whole plain text without URLs: listings are judged by all of it, see :func:`shortened` for display."""
    return F.trim(F.regexp_replace(plain_text(html), r"https?://\S+", ""))


def shortened(value: str | Column, max_length: int = 4000) -> Column:
    """A text for display, cut with an ellipsis at ``max_length``."""
    value = text(value)
    return F.when(F.length(value) > max_length, F.concat(F.rtrim(F.left(value, F.lit(max_length - 1))), F.lit("…"))).otherwise(value)


def _fold_table() -> tuple[str, str]:
    """Single-letter compatibility folds of the Latin and full-width blocks, derived from Unicode data."""
    source, target = [], []
    for block in (range(0x00A0, 0x0250), range(0x1E00, 0x1F00), range(0xFF01, 0xFF5F)):
        for point in block:
            folded = "".join(ch for ch in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(ch))
            if len(folded) == 1 and folded != chr(point):
                source.append(chr(point))
                target.append(folded)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold(value: str | Column) -> Column:
    """Accent- and width-insensitive form (compatibility fold, combining marks removed)."""
    return F.regexp_replace(F.translate(text(value), _FOLD_FROM, _FOLD_TO), "[\u0300-\u036f]", "")


def title_key(value: str | Column) -> Column:
    """Lower-case ASCII words separated by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text(value)), "[^a-z0-9]+", " "))


def title_signature(value: str | Column) -> Column:
    """The words of the title in sorted order."""
    return F.array_join(F.array_sort(F.filter(F.split(title_key(value), " "), lambda w: F.length(w) > 0)), " ")


def edition_title_key(value: str | Column) -> Column:
    """Title identity across editions: folded, without years and 'annual' wording."""
    out = F.replace(F.regexp_replace(fold(value), "[’‘`]", "'"), F.lit("&"), F.lit(" and "))
    out = sub(out, r"\b20\d{2}\b", " ")
    out = sub(out, r"\b\d+(?:st|nd|rd|th)\s+annual\b", " ")
    out = sub(out, r"\bannual\b", " ")
    return F.lower(F.trim(F.regexp_replace(out, "(?i)[^a-z0-9]+", " ")))


def stable_key(value: str | Column) -> Column:
    """Folded words used inside series keys."""
    out = F.replace(F.regexp_replace(fold(value), "[’‘`]", "'"), F.lit("&"), F.lit(" and "))
    return F.trim(F.lower(F.regexp_replace(out, "(?i)[^a-z0-9]+", " ")))


def search_form(value: str | Column) -> Column:
    """Folded lower case with every non-alphanumeric run as one space."""
    return F.trim(F.regexp_replace(fold(F.lower(text(value))), r"[^\p{L}\p{N}]+", " "))


def slug(value: str | Column) -> Column:
    out = F.regexp_replace(F.lower(fold(value)), "[’']", "")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9]+", "-"), "^-|-$", "")


def slug_candidates(title: str | Column, removable: tuple[str, ...] = ("a", "an", "the", "for", "to", "is")) -> Column:
    """Slugs a first-party page may use: of the title and of its part before a spaced dash or bar."""
    value = F.trim(text(title))
    main = F.trim(F.element_at(F.split(value, r"\s+(?:[–—-]|\|)\s+"), 1))

    def variants(part: Column) -> Column:
        full = slug(part)
        words = F.filter(F.split(full, "-"), lambda w: F.length(w) > 0)
        headless = F.when(
            F.element_at(words, 1).isin(*removable) & (F.size(words) > 1),
            F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), "-"),
        )
        compact = F.array_join(F.filter(words, lambda w: ~w.isin(*removable)), "-")
        return F.array(full, headless, compact)

    found = F.array_compact(F.concat(variants(value), variants(main)))
    return F.array_distinct(F.filter(found, lambda s: F.length(s) > 0))


# Stop words and place words of the token variants.
LINK_STOP = ["with", "from", "your", "this", "that", "the", "and", "for", "san", "jose", "santa", "clara", "city", "event", "events", "festival"]
SITEMAP_STOP = ["annual", "city", "community", "cupertino", "event", "events", "fall", "the"]
DETAIL_STOP = ["the", "and", "for", "with", "from", "annual", "event", "festival"]
PLACE_WORDS = ["san", "jose", "milpitas", "palo", "alto", "santa", "clara", "cupertino", "sunnyvale", "mountain", "view", "los"]


def tokens(value: str | Column, min_length: int, stop: list[str] = ()) -> Column:
    """Distinct lower-case ASCII words of at least ``min_length`` letters that are not stop words."""
    words = F.split(title_key(value), " ")
    keep = F.filter(words, lambda w: F.length(w) >= min_length)
    if stop:
        keep = F.filter(keep, lambda w: ~w.isin(*stop))
    return F.array_distinct(keep)


def shared_count(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(left, right))


def same_identity(left: Column, right: Column) -> Column:
    """Two token sets name the same event: they share two tokens, or all of the smaller set."""
    needed = F.least(F.lit(2), F.size(left), F.size(right))
    return (F.size(left) > 0) & (F.size(right) > 0) & (shared_count(left, right) >= needed)


def page_carries_title(title_words: Column, page: str | Column) -> Column:
    """Enough identity words (a list, repeats kept) occur as substrings of the page."""
    lowered = F.lower(text(page))
    total = F.size(title_words)
    hits = F.size(F.filter(title_words, lambda w: F.contains(lowered, w)))
    return (
        F.when(total == 0, F.lit(True))
        .when(total == 1, hits == 1)
        .otherwise((hits >= 2) & (hits / total >= 0.45))
    )


def sentences(value: str | Column) -> Column:
    """Split after closing punctuation; abbreviations are re-joined by the summary operator."""
    return F.filter(F.split(F.trim(text(value)), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def snip(value: str | Column, limit: int) -> Column:
    """Cut to ``limit``: at a sentence of 45 characters or more, else at a word, with an ellipsis."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text(value), r"\s+", " "), "(?i)&nbsp;|nbsp;", " "))
    head = F.left(clean, F.lit(limit))
    sentence = F.regexp_extract(head, r"^(.+?[.!。！？])(?:\s|$)", 1)
    cut = F.regexp_replace(F.regexp_replace(head, r"\s+\S*$", ""), r"[,;:，；、\s]+$", "")
    return F.when(F.length(clean) <= limit, clean).when(F.length(sentence) >= 45, sentence).otherwise(F.concat(cut, F.lit("…")))


def chunks(value: str | Column, max_chars: int = 360) -> Column:
    """Split long text on sentences, then pack the words of over-long sentences greedily."""
    source = F.trim(text(value))
    parts = F.filter(F.transform(F.split(source, r"(?<=[.!?;:])\s+|\s+[—–-]\s+"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)

    def pack(part: Column) -> Column:
        words = F.filter(F.split(part, r"\s+"), lambda w: F.length(w) > 0)
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"))

        def step(acc: Column, word: Column) -> Column:
            grown = F.concat_ws(" ", F.nullif(acc["current"], F.lit("")), word)
            fits = (F.length(acc["current"]) == 0) | (F.length(grown) <= max_chars)
            return F.struct(
                F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["current"])).alias("done"),
                F.when(fits, grown).otherwise(word).alias("current"),
            )

        packed = F.aggregate(words, start, step, lambda acc: F.array_append(acc["done"], acc["current"]))
        return F.when(F.length(part) <= max_chars, F.array(part)).otherwise(packed)

    return (
        F.when(F.length(source) == 0, F.array().cast("array<string>"))
        .when(F.length(source) <= max_chars, F.array(source))
        .otherwise(F.flatten(F.transform(F.when(F.size(parts) > 0, parts).otherwise(F.array(source)), pack)))
    )


def paragraphs(html: str | Column, tag: str = "p") -> Column:
    """Plain text of every ``<tag>`` block, in page order."""
    return F.transform(all_groups(text(html), rf"<{tag}\b[^>]*>([\s\S]*?)</{tag}>"), plain_text)


# Paragraph openings that are never a description.
NOT_A_DESCRIPTION = (
    r"^(?:performances?|dates?|location|length|running time|advisory|note|tickets?|box office|general admission"
    r"|student matinee|auditions?|registration|parking)\b"
)


def official_paragraph_text(html: str | Column, min_length: int = 20, exclude: str | None = None) -> Column:
    """The usable paragraphs of a page as one description."""
    keep = F.filter(paragraphs(html), lambda p: (F.length(p) >= min_length) & ~has(p, NOT_A_DESCRIPTION))
    if exclude:
        keep = F.filter(keep, lambda p: ~has(p, exclude))
    return source_description(F.array_join(keep, " "))


def display_label(label: str | Column, evidence: str | Column) -> Column:
    """A label is shown only when the organizer supplied evidence for it."""
    return F.when(present_text(evidence), F.trim(text(label))).otherwise(F.lit(""))


def present_text(value: str | Column) -> Column:
    return F.length(text(c(value))) > 0
