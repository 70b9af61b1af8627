"""Civil dates and times. Values are Pacific wall-clock strings; ``now`` and ``today`` are always parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import c, first_nonempty, let, text
from .regex import all_groups, first_group, has

PACIFIC = "America/Los_Angeles"

# Minutes assumed for listings without an end, by format and by wording.
FALLBACK_MINUTES = {"movie-screening": 200, "sports-game": 240, "live-show": 210}
STORYTIME_WORDS = r"\b(?:story ?time|tiny tot|baby bounce|stay (?:&|and) play)\b"
FESTIVAL_WORDS = r"\b(?:festival|celebration|carnival|parade|fair|art walk)\b"
STORYTIME_MINUTES, FESTIVAL_MINUTES, DEFAULT_MINUTES = 90, 480, 240

MONTH_NAMES = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
    "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
)
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def day_key(value: str | Column) -> Column:
    """The first ISO date in the value, or an empty string."""
    return F.regexp_extract(text(value), r"\d{4}-\d{2}-\d{2}", 0)


def leading_day(value: str | Column) -> Column:
    return F.regexp_extract(text(value), r"^\d{4}-\d{2}-\d{2}", 0)


def day10(value: str | Column) -> Column:
    return F.left(text(value), F.lit(10))


def has_clock(value: str | Column) -> Column:
    value = text(value)
    return F.contains(value, F.lit("T")) | F.contains(value, F.lit(" "))


def local_datetime(value: str | Column, end_of_day: bool | Column = False) -> Column:
    """The 19-character form; missing parts are filled with the start or the end of the day."""
    late = F.lit(end_of_day) if isinstance(end_of_day, bool) else end_of_day
    local = F.replace(F.left(text(value), F.lit(19)), F.lit(" "), F.lit("T"))
    whole_day, minute = r"^\d{4}-\d{2}-\d{2}", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"
    return (
        F.when(local.rlike(minute + r":\d{2}"), local)
        .when(local.rlike(minute), F.concat(F.left(local, F.lit(16)), F.when(late, F.lit(":59")).otherwise(F.lit(":00"))))
        .when(local.rlike(whole_day), F.concat(F.left(local, F.lit(10)), F.when(late, F.lit("T23:59:59")).otherwise(F.lit("T00:00:00"))))
        .otherwise(F.lit(""))
    )


def add_minutes(value: str | Column, minutes: Column) -> Column:
    """Civil minute arithmetic, seconds dropped."""
    start = F.concat(F.left(local_datetime(value), F.lit(16)), F.lit(":00")).try_cast("timestamp_ntz")
    return F.coalesce(_iso(F.timestamp_add("MINUTE", minutes, start)), F.lit(""))


def _iso(moment: Column) -> Column:
    """ISO text of a civil timestamp, whatever the session time zone is."""
    return F.replace(moment.cast("string"), F.lit(" "), F.lit("T"))


def fallback_minutes(format: str | Column, title: str | Column, description: str | Column) -> Column:
    words = F.lower(F.concat_ws(" ", text(title), text(description)))
    out = F.when(c(format) == "movie-screening", FALLBACK_MINUTES["movie-screening"])
    for name in ("sports-game", "live-show"):
        out = out.when(c(format) == name, FALLBACK_MINUTES[name])
    return (
        out.when(has(words, STORYTIME_WORDS, False), STORYTIME_MINUTES)
        .when(has(words, FESTIVAL_WORDS, False), FESTIVAL_MINUTES)
        .otherwise(DEFAULT_MINUTES)
    )


def effective_end(
    start: str | Column, end: str | Column, minutes: Column, ongoing: str | Column | None = None
) -> Column:
    """Explicit end, else end of the start day, else start plus the fallback minutes; empty for ongoing listings."""
    start, end = text(start), text(end)
    out = (
        F.when(F.length(end) > 0, local_datetime(end, ~has_clock(end)))
        .when(F.length(start) == 0, F.lit(""))
        .when(~has_clock(start), local_datetime(start, True))
        .otherwise(add_minutes(start, minutes))
    )
    return out if ongoing is None else F.when(F.coalesce(c(ongoing), F.lit(False)), F.lit("")).otherwise(out)


def is_active(effective: str | Column, now: str, ongoing: str | Column | None = None) -> Column:
    """Strict expiry: a listing ends at its effective end."""
    alive = (F.length(text(effective)) > 0) & (text(effective) > now)
    return alive if ongoing is None else F.coalesce(c(ongoing), F.lit(False)) | alive


def is_current(start: str | Column, end: str | Column, now: str, ongoing: str | Column | None = None) -> Column:
    """Inclusive expiry of collections: an explicit end counts to the second, else the whole start day."""
    end = text(end)
    closing = F.when(F.length(end) > 0, pacific_comparable(end, ~has(end, r"[T ]\d{2}:\d{2}"))).otherwise(
        F.when(F.length(leading_day(start)) > 0, F.concat(leading_day(start), F.lit("T23:59:59"))).otherwise(F.lit(""))
    )
    alive = (F.length(closing) > 0) & (closing >= now)
    return alive if ongoing is None else (F.coalesce(c(ongoing), F.lit(False)) & (F.length(end) == 0)) | alive


def is_upcoming(start: str | Column, end: str | Column, today: str, ongoing: str | Column | None = None) -> Column:
    """Inclusive last day, not the start day."""
    last = day_key(first_nonempty(end, start))
    soon = (F.length(last) > 0) & (last >= today)
    return soon if ongoing is None else F.coalesce(c(ongoing), F.lit(False)) | soon


def overlaps(start_a, end_a, start_b, end_b) -> Column:
    """Two inclusive day ranges meet; a missing end is its start."""
    a1, a2 = day_key(start_a), day_key(first_nonempty(end_a, start_a))
    b1, b2 = day_key(start_b), day_key(first_nonempty(end_b, start_b))
    known = (F.length(a1) > 0) & (F.length(a2) > 0) & (F.length(b1) > 0) & (F.length(b2) > 0)
    return known & (a1 <= b2) & (a2 >= b1)


def pacific_local(instant: str | Column) -> Column:
    """The Pacific wall clock of an ISO instant with ``Z`` or an offset."""
    civil = text(instant).try_cast("timestamp").cast("timestamp_ntz")
    moved = F.convert_timezone(F.current_timezone(), F.lit(PACIFIC), F.date_trunc("second", civil).cast("timestamp_ntz"))
    return F.coalesce(_iso(moved), F.lit(""))


def pacific_comparable(value: str | Column, end_of_day: bool | Column = False) -> Column:
    value = F.trim(text(value))
    return F.when(has(value, r"Z$|[+-]\d{2}:?\d{2}$") & has_clock(value), pacific_local(value)).otherwise(local_datetime(value, end_of_day))


def month_number(name: Column) -> Column:
    """1-12 for any English month name or abbreviation, NULL otherwise."""
    position = F.instr(F.lit(_MONTHS), F.lower(F.left(name, F.lit(3))))
    return F.when((F.length(name) >= 3) & (position % 3 == 1), ((position + 2) / 3).cast("int"))


def clock_of(text_value: str | Column) -> Column:
    """``HH:MM`` of an English time such as ``2 p.m.``, or an empty string."""
    value = F.replace(text(text_value), F.lit("."), F.lit(""))
    pattern = r"\b(\d{1,2})(?::(\d{2}))?\s*(AM|PM)\b"
    hour, minute, half = (first_group(value, pattern, i) for i in (1, 2, 3))
    hour24 = hour.try_cast("int") % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0)
    clock = F.concat(F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), F.when(F.length(minute) > 0, minute).otherwise(F.lit("00")))
    return F.when(F.length(half) > 0, clock).otherwise(F.lit(""))


def _pad(part: Column) -> Column:
    return F.lpad(part.cast("string"), 2, "0")


def iso_from_text(date_text: str | Column, time_text: str | Column, today: str) -> Column:
    """English or numeric date text to ISO; a date without a year must not lie before ``today``."""
    value = text(date_text)
    numeric = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
    month_n, day_n, year_n = (first_group(value, numeric, i) for i in (1, 2, 3))
    named = rf"\b({MONTH_NAMES})\.?\s+(\d{{1,2}})(?:,?\s*(\d{{4}}))?"
    month_w, day_w, year_w = (first_group(value, named, i) for i in (1, 2, 3))
    numeric_date = F.concat_ws("-", year_n, _pad(month_n.try_cast("int")), _pad(day_n.try_cast("int")))
    year = F.when(F.length(year_w) > 0, year_w).otherwise(F.lit(today[:4]))
    named_date = F.concat_ws("-", year, _pad(month_number(month_w)), F.lpad(day_w, 2, "0"))
    date = (
        F.when(F.length(year_n) > 0, numeric_date)
        .when(F.length(month_w) == 0, F.lit(""))
        .when((F.length(year_w) == 0) & (named_date < today), F.lit(""))
        .otherwise(named_date)
    )
    clock = clock_of(time_text)
    return F.when((F.length(date) > 0) & (F.length(clock) > 0), F.concat_ws("T", date, clock)).otherwise(date)


def date_window(prose: str | Column, reference: str | Column | None = None, max_span_days: int = 45) -> Column:
    """``struct(start, end)`` of the visible dates within ``max_span_days`` of the reference date."""
    value = text(prose)
    reference_day = day_key(reference) if reference is not None else F.lit("")
    pattern = rf"\b(?:{MONTH_NAMES})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s+20\d{{2}})?"
    mentions = all_groups(value, pattern, 0)

    def to_day(mention: Column) -> Column:
        month = month_number(F.regexp_extract(mention, r"^([A-Za-z]+)", 1))
        day = F.regexp_extract(mention, r"^[A-Za-z]+\.?\s+(\d{1,2})", 1)
        year = F.regexp_extract(mention, r"(20\d{2})$", 1)
        year = F.when(F.length(year) > 0, year).otherwise(F.left(reference_day, F.lit(4)))
        iso = F.concat_ws("-", year, _pad(month), F.lpad(day, 2, "0"))
        return F.when(F.length(year) == 4, F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso))

    found = F.array_distinct(F.array_compact(F.transform(mentions, to_day)))
    near = F.filter(
        found,
        lambda d: (F.length(reference_day) == 0) | (F.abs(F.date_diff(F.try_to_date(d), F.try_to_date(reference_day))) <= max_span_days),
    )
    days = F.when(F.length(reference_day) > 0, F.array_union(near, F.array(reference_day))).otherwise(near)

    def bounds(d: Column) -> Column:
        first, last = F.array_min(d), F.array_max(d)
        narrow = F.date_diff(F.try_to_date(last), F.try_to_date(first)) <= max_span_days
        edge = lambda v: F.when(F.size(d) == 0, F.lit("")).when(narrow, v).otherwise(reference_day)
        return F.struct(edge(first).alias("start"), edge(last).alias("end"))

    return let(days, bounds)


def festival_window(date_text: str | Column, today: str) -> Column:
    """``struct(start, end)`` of an annual date such as ``October 3rd & 4th, 2026``."""
    value = F.regexp_replace(F.trim(F.regexp_replace(text(date_text), r"\s+", " ")), r"(?i)(?<![0-9A-Za-z_])(\d{1,2})(?:st|nd|rd|th)(?=[,\s])", "$1")
    long_names = MONTH_NAMES.split("|Jan|")[0]
    pattern = rf"\b({long_names})\s+(\d{{1,2}})\s*(?:-|–|—|&|and|to)\s*(\d{{1,2}}),?\s+(20\d{{2}})\b"
    month, first, last, year = (first_group(value, pattern, i) for i in (1, 2, 3, 4))
    part = lambda day: iso_from_text(F.concat(month, F.lit(" "), day, F.lit(", "), year), F.lit(""), today)
    return F.struct(
        F.when(F.length(year) > 0, part(first)).otherwise(iso_from_text(value, F.lit(""), today)).alias("start"),
        F.when(F.length(year) > 0, part(last)).otherwise(F.lit("")).alias("end"),
    )


def next_friday(day: Column) -> Column:
    """The Friday on or after a date."""
    return F.date_add(day, F.pmod(F.lit(6) - F.dayofweek(day), F.lit(7)))


def feed_window(kind: str, today: str) -> tuple[str, str] | None:
    """Inclusive day bounds of a feed date filter; None means no bound."""
    import datetime as dt

    base = dt.date.fromisoformat(today)
    if kind == "all":
        return None
    if kind == "today":
        return today, today
    if kind == "month":
        following = (base.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        return base.replace(day=1).isoformat(), (following - dt.timedelta(days=1)).isoformat()
    if kind == "weekend":
        saturday = base + dt.timedelta(days=-1 if base.weekday() == 6 else 5 - base.weekday())
        return saturday.isoformat(), (saturday + dt.timedelta(days=1)).isoformat()
    return dt.date.fromisoformat(kind).isoformat(), kind


def day_span(first: Column, last: Column, limit: int = 14) -> Column:
    """Every day of a range of at most ``limit`` days after the first; an empty array otherwise."""
    gap = F.date_diff(last, first)
    return F.when((gap >= 0) & (gap <= limit), F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def listing_day_span(date_text: str | Column) -> Column:
    """Days of ``Nov 14 - 16, 2026`` as ISO strings; see :func:`listing_day_range` for ranges of any length."""
    return listing_day_range(date_text)["days"]


def listing_day_range(date_text: str | Column, limit: int = 14) -> Column:
    """``struct(first, last, days, status)`` of ``Nov 14 - 16, 2026``.

    ``status``: ``days`` when every day is listed, ``range`` when there are more than ``limit`` days after the first and only
    the bounds are given, ``none`` for a text without a range.
    """
    value = F.regexp_replace(F.replace(text(date_text), F.lit("."), F.lit("")), r"\s+", " ")
    pattern = (
        r"\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?"
        r"|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{1,2})(?:\s*-\s*(\d{1,2}))?,?\s+(20\d{2})\b"
    )

    # Texts, then numbers, are bound once: an unbound part would be searched again at each of its uses.
    def numbers(found: Column) -> Column:
        low = found["first"].try_cast("int")
        high = F.when(F.length(found["last"]) > 0, found["last"].try_cast("int")).otherwise(low)
        return F.struct(month_number(found["month"]).alias("month"), low.alias("low"), high.alias("high"), found["year"].alias("year"))

    def ranged(n: Column) -> Column:
        low, high = n["low"], n["high"]
        usable = F.coalesce(n["month"].isNotNull() & (high >= low), F.lit(False))
        iso = lambda d: F.concat_ws("-", n["year"], _pad(n["month"]), _pad(d))
        none = F.array().cast("array<string>")
        short = usable & (high - low <= limit)
        return F.struct(
            F.when(usable, iso(low)).otherwise(F.lit("")).alias("first"), F.when(usable, iso(high)).otherwise(F.lit("")).alias("last"),
            F.when(short, F.transform(F.sequence(low, high), iso)).otherwise(none).alias("days"),
            F.when(short, F.lit("days")).when(usable, F.lit("range")).otherwise(F.lit("none")).alias("status"),
        )

    groups = lambda v: F.struct(*[first_group(v, pattern, i).alias(name) for i, name in enumerate(("month", "first", "last", "year"), 1)])
    return let(let(let(value, groups), numbers), ranged)


def season_year(month_name: Column, first_year: Column, second_year: Column) -> Column:
    """October to December belong to the first year of a season."""
    month = month_number(month_name)
    return F.when(month.isNull() | (month >= 10), first_year).otherwise(second_year)


def league_season(day: Column) -> Column:
    """``20262027`` style season label; a season starts in July."""
    start = F.year(day) - F.when(F.month(day) >= 7, 0).otherwise(1)
    return F.concat(start.cast("string"), (start + 1).cast("string"))


def reconcile_dates(listing: Column, schema: Column, visible: Column, listing_start: Column) -> Column:
    """A page date replaces the listing date only on the listing's own day; structured data first."""

    def same_day(value: Column) -> Column:
        day = leading_day(value)
        return (F.length(day) > 0) & ((F.length(leading_day(listing_start)) == 0) | (day == leading_day(listing_start)))

    return F.when(same_day(schema), schema).when(same_day(visible), visible).otherwise(text(listing))


def explicit_page_day(page_text: str | Column) -> Column:
    """The day that a page labels as 'When' or 'Next date'."""
    long_names = MONTH_NAMES.split("|Jan|")[0]
    pattern = (
        r"\b(?:Next date:|When\s*:?)\s*[*•-]?\s*(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday),?\s+"
        rf"({long_names})\s+(\d{{1,2}}),\s+(20\d{{2}})\b"
    )
    month, day, year = (first_group(text(page_text), pattern, i) for i in (1, 2, 3))
    return F.when(F.length(year) > 0, F.concat_ws("-", year, _pad(month_number(month)), F.lpad(day, 2, "0"))).otherwise(F.lit(""))


def multi_day_label(start: str | Column, end: str | Column, current_year: int, locale: str = "en") -> Column:
    """A label for a real multi-day range, else an empty string."""
    first, last = F.try_to_date(leading_day(start)), F.try_to_date(leading_day(end))
    y1, y2, m1, m2 = F.year(first), F.year(last), F.month(first), F.month(last)
    show_year = (y1 != current_year) | (y2 != current_year)
    if locale == "zh":
        name = lambda d: F.concat(F.month(d).cast("string"), F.lit("月"), F.day(d).cast("string"), F.lit("日"))
        left = F.concat(F.when(show_year, F.concat(y1.cast("string"), F.lit("年"))).otherwise(F.lit("")), name(first))
        right = F.concat(F.when(y1 != y2, F.concat(y2.cast("string"), F.lit("年"))).otherwise(F.lit("")), name(last))
        label = F.concat(left, F.lit(" – "), right)
    else:
        name = lambda d: F.date_format(d, "MMM d")
        right = F.when((y1 == y2) & (m1 == m2), F.day(last).cast("string")).otherwise(name(last))
        across = F.concat(name(first), F.lit(", "), y1.cast("string"), F.lit(" – "), name(last), F.lit(", "), y2.cast("string"))
        within = F.concat(name(first), F.lit(" – "), right, F.when(show_year, F.concat(F.lit(", "), y2.cast("string"))).otherwise(F.lit("")))
        label = F.when(y1 != y2, across).otherwise(within)
    return F.when(last > first, label).otherwise(F.lit(""))


def zh_day_label(value: str | Column) -> Column:
    """``6月13日 10:30`` from an ISO value."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2}))?"
    month, day, hour, minute = (F.regexp_extract(text(value), pattern, i) for i in (2, 3, 4, 5))
    label = F.concat(month.cast("int").cast("string"), F.lit("月"), day.cast("int").cast("string"), F.lit("日"))
    clock = F.when(F.length(hour) > 0, F.concat(F.lit(" "), hour, F.lit(":"), minute)).otherwise(F.lit(""))
    return F.when(F.length(month) > 0, F.concat(label, clock))


def short_day_label(value: str | Column) -> Column:
    return F.date_format(F.try_to_date(leading_day(value)), "MMM d")
