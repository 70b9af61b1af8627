"""Ranking scores: recommendation components, weekend picks, detail completeness, organizer priority, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import any_of
from .dates import leading_day
from .defaults import c, first_nonempty, joined, points, present, text
from .regex import has
from .text import plain_text

# ---------------------------------------------------------------------------------------------------------------
# Weights of the recommendation score.
TIER_POINTS = {"outing": 20, "everyday": 0, "background": -45}
EXPERIENCE_POINTS = {
    "festival": 16, "seasonal": 16, "animal": 17, "performance": 17, "ride": 16, "concert": 16, "nature": 15, "museum": 15,
    "cultural": 15, "movie": 14, "workshop": 13, "stem": 13, "sports": 12, "craft": 11, "storytime": 11, "community": 9,
    "library": 8, "meetup": 7, "homework": 6, "default": 8,
}
RECURRENCE_POINTS = {
    "annual": 8, "seasonal": 7, "holiday": 7, "one-time": 6, "limited-run": 5, "monthly": 4, "unknown": 3, "biweekly": 2,
    "weekly": 1, "multiple-weekly": 0, "daily": 0,
}
EDITOR_POINTS, SPOTLIGHT_POINTS = 12, 32
MAX_APPEAL = 10
DISTANCE_POINTS = [(2, 16), (5, 13), (10, 9), (20, 5), (35, 2)]
CANCELLED_TERMS = ["cancelled", "canceled", "event closed", "closure notice"]
SOLD_OUT_TERMS = ["sold out", "waitlist only", "registration full"]
UNKNOWN_COST_LABEL = "费用未注明"
# Wording of the weekend pick score.
WEEKEND_FOCUS = r"halloween|spook|boo!|trick.or.treat|pumpkin|ghost|día de los muertos|dia de los muertos|lowrider|family festival|bluey|science fun"
WEEKEND_FAMILY = r"\bfamil(?:y|ies)\b|\bchildren\b|\bkids?\b|\bages?\b|\btoddlers?\b|\ball ages\b"
WEEKEND_BANNED = (
    r"champagne lounge|happy hour|meditation with|adult only|18\+|21\+|nr-rated|movie yotsuba|college admissions"
    r"|business networking|technical lecture|fundraiser gala|private event|girl scout program"
)
WEEKEND_POOR = (
    r"storytime|regular class|homework help|library ukulele|museum open|practice your vote|thursday live on cal ave"
    r"|volunteer(?:ing)?|book sale|3d printing open hours|seed kits for adults|second saturday \(november\)"
)
WEEKEND_CREATIVE = r"costume|creative|hands.on|festival|puppet|garden|museum|science|craft|art|music|dance"
WEEKEND_LABEL_FAMILY = r"family|children|kids|all ages"
WEEKEND_LABELS = [
    ("halloween", "Halloween Pick", "万圣节精选"), ("culture", "Culture & Community Pick", "文化社区精选"),
    ("sports", "Live Sports Pick", "现场体育精选"), ("shows", "Family Show Pick", "亲子演出精选"),
    ("learning", "Hands-on Learning Pick", "探索学习精选"), ("outdoor", "Outdoor Adventure Pick", "户外探索精选"),
    ("arts", "Creative Arts Pick", "艺术体验精选"), ("community", "Community Favorite", "社区亲子精选"),
]
# Online listings and completeness weights.
VIRTUAL = r"\b(?:online|virtual|zoom|webinar)\b"
READY_SCORE = 80
# ---------------------------------------------------------------------------------------------------------------


def lookup(value: Column, table: dict[str, int], otherwise: int) -> Column:
    out = None
    for key, score in table.items():
        out = F.when(value == key, F.lit(score)) if out is None else out.when(value == key, F.lit(score))
    return out.otherwise(F.lit(otherwise))


def family_appeal(body: Column, kind: Column, format: Column) -> Column:
    t = lambda terms: any_of(body, terms)
    # Appeal terms and points.
    total = points(
        [
            (t(["animal", "wildlife", "petting zoo"]), 3),
            (t(["ride", "train", "monster truck", "ice show"]), 3),
            ((format == "live-show") | t(["performance", "concert", "theater", "theatre", "show"]), 2),
            (t(["hands on", "hands-on", "interactive", "workshop"]), 2),
            (t(["craft", "make your own", "maker"]), 2),
            ((kind == "outdoor") | t(["nature", "hike", "bird walk", "ranger"]), 2),
            (t(["water", "splash", "pool", "playground", "play area"]), 2),
            ((format == "festival") | t(["festival", "fair", "carnival"]), 2),
            (t(["character", "costume", "princess", "superhero"]), 2),
        ]
    )
    return F.least(total, F.lit(MAX_APPEAL))


def days_between(start: Column | str, end: Column | str) -> Column:
    as_date = lambda v: F.try_to_date(F.lit(v) if isinstance(v, str) else v)
    return F.date_diff(as_date(end), as_date(start))


def time_points(date_value: str | Column, today: str, ongoing: str | Column) -> Column:
    day = leading_day(date_value)
    days = days_between(today, day)
    weekend = F.dayofweek(F.try_to_date(day)).isin(1, 7)
    dated = (
        F.when(days < 0, -1000).when(days == 0, 22).when(days == 1, 19).when(days <= 3, 16)
        .when(days <= 7, F.when(weekend, 14).otherwise(12)).when(days <= 14, 9).when(days <= 30, 5).when(days <= 60, 4)
        .when(days <= 90, -2).otherwise(-45)
    )
    return F.when(F.coalesce(c(ongoing), F.lit(False)), 8).when(F.length(day) == 0, 0).otherwise(dated)


def distance_points(miles: Column) -> Column:
    out = F.when(miles.isNull() | (miles < 0), 0)
    for limit, score in DISTANCE_POINTS:
        out = out.when(miles <= limit, score)
    return out.otherwise(0)


def is_web(url: str | Column) -> Column:
    return has(text(url), r"^https?://", False)


def is_actionable(*places: str | Column) -> Column:
    return F.length(F.trim(first_nonempty(*places))) > 0


def quality_points(image, description, evidence, cost_source, cost_label, url, actionable, kind, verified_at, today: str) -> Column:
    verified = leading_day(verified_at)
    age = days_between(verified, today)
    priced = present(cost_source) | (present(cost_label) & (text(cost_label) != UNKNOWN_COST_LABEL))
    fixed = points(
        [
            (F.length(text(image)) > 0, 1), (F.length(F.trim(text(description))) >= 40, 2), (evidence, 2), (priced, 1), (is_web(url), 3),
            (actionable, 3), (F.length(text(kind)) > 0, 1),
        ]
    )
    fresh = F.when(F.length(verified) == 0, 0).when(age <= 14, 2).when(age > 30, -4).otherwise(0)
    return fixed + fresh


def reliability_points(body, description, evidence, url, actionable, date_value, ongoing, verified_at, today: str) -> Column:
    undated = ~F.coalesce(c(ongoing), F.lit(False)) & (F.length(leading_day(date_value)) == 0)
    fixed = points(
        [
            (~is_web(url), -60), (undated, -35), (~actionable, -15), (~evidence, -8), (F.length(F.trim(text(description))) < 40, -20),
        ]
    )
    gone = F.when(any_of(body, CANCELLED_TERMS), -1000).when(any_of(body, SOLD_OUT_TERMS), -30).otherwise(0)
    verified = leading_day(verified_at)
    age = days_between(verified, today)
    stale = F.when(F.length(verified) == 0, 0).when(age > 30, -8).when(age > 14, -4).otherwise(0)
    return fixed + gone + stale


def is_ready(url, date_value, ongoing, description, actionable, evidence) -> Column:
    dated = F.coalesce(c(ongoing), F.lit(False)) | (F.length(leading_day(date_value)) > 0)
    return is_web(url) & dated & (F.length(F.trim(text(description))) >= 40) & actionable & evidence


def is_spotlight(date_value, today: str, special, appeal, url, actionable, description) -> Column:
    day = leading_day(date_value)
    days = days_between(today, day)
    near = (days >= 0) & (days <= 3) & F.dayofweek(F.try_to_date(day)).isin(1, 6, 7)
    return F.coalesce(near, F.lit(False)) & special & (appeal >= 4) & is_web(url) & actionable & (F.length(F.trim(text(description))) >= 40)


def is_editor_pick(pick: Column, until: str | Column, reason: str | Column, today: str) -> Column:
    expiry = leading_day(until)
    return F.coalesce(pick, F.lit(False)) & (F.length(expiry) > 0) & present(reason) & (expiry >= today)


def weekend_points(title, description, age_label, cost_status, link_status, season, date_value, topic: Column, friday: str, month_before: str) -> Column:
    day = F.left(text(date_value), F.lit(10))
    return F.lit(25) + points(
        [
            (has(text(title), WEEKEND_FOCUS), 24), (has(text(age_label), WEEKEND_LABEL_FAMILY), 14), (has(text(description), WEEKEND_FAMILY), 8),
            (has(text(cost_status), "free"), 6), (text(link_status) == "ok", 5), (F.length(text(season)) > 0, 6), (day >= friday, 7),
            (has(text(title), WEEKEND_POOR), -45), (has(F.concat_ws(" ", text(title), text(description)), WEEKEND_CREATIVE), 5),
            (topic == "sports", -8), (day < month_before, -6),
        ]
    )


def is_virtual(*parts: str | Column) -> Column:
    return has(joined(list(parts)), VIRTUAL)


def completeness_checks(e: dict[str, Column]) -> list[tuple[str, Column]]:
    """Named checks of a listing, in report order."""
    ongoing, virtual = F.coalesce(e["ongoing"], F.lit(False)), is_virtual(e["title"], e["place"], e["description"])
    timed = lambda v: has(text(v), r"T\d{2}:\d{2}", False)
    located = virtual | present(e["address"]) | present(e["meeting_point"])
    return [
        ("url", has(first_nonempty(e["url"], e["canonical_url"]), r"^https?://")),
        ("date", ongoing | has(text(e["date_value"]), r"^\d{4}-\d{2}-\d{2}", False)),
        ("start_time", ongoing | timed(e["date_value"])),
        ("venue", virtual | (present(e["place"]) & ~has(text(e["place"]), r"^City of\s+"))),
        ("address", located),
        ("description", F.length(F.trim(text(e["description"]))) >= 25),
        ("image", has(text(e["image"]), r"^https?://")),
        ("age", present(e["age_label"]) | (F.size(e["age_ranges"]) > 0)),
        ("cost", present(e["cost_status"]) & (text(e["cost_status"]) != "unknown")),
        ("registration", present(e["registration_status"]) & (text(e["registration_status"]) != "unknown")),
        ("end_time", ongoing | timed(e["end_date_value"])),
    ]


# Points of the completeness checks, and of a listing that can be navigated to.
COMPLETENESS_POINTS = {
    "url": 15, "date": 10, "start_time": 10, "venue": 10, "address": 10, "description": 10, "image": 5, "age": 8, "cost": 8,
    "registration": 6, "end_time": 4,
}
NAVIGABLE_POINTS = 4


def completeness(e: dict[str, Column]) -> Column:
    checks = completeness_checks(e)
    navigable = is_virtual(e["title"], e["place"], e["description"]) | present(e["address"]) | present(e["meeting_point"]) | present(e["map_url"])
    return points([(ok, COMPLETENESS_POINTS[name]) for name, ok in checks] + [(navigable, NAVIGABLE_POINTS)])


def quality_state(e: dict[str, Column]) -> Column:
    ongoing = F.coalesce(e["ongoing"], F.lit(False))
    core = present(e["title"]) & present(e["source"]) & present(first_nonempty(e["url"], e["canonical_url"])) & present(e["description"])
    dated = ongoing | has(text(e["date_value"]), r"^\d{4}-\d{2}-\d{2}", False)
    own_place = present(e["place"]) & (F.lower(plain_text(e["place"])) != F.lower(plain_text(e["source"])))
    located = (
        is_virtual(e["title"], e["place"], e["description"]) | present(e["city"]) | present(e["meeting_point"]) | present(e["address"]) | own_place
    )
    return (
        F.when(~(core & dated & located), F.lit("HOLD_DATA_ERROR"))
        .when(completeness(e) >= READY_SCORE, F.lit("PUBLISH_READY")).otherwise(F.lit("PUBLISH_PARTIAL"))
    )


def organizer_priority(url, image, source, place, verification, address) -> Column:
    """How actionable a record is when two sources list the same event."""
    direct = has(text(url), r"^https?://[^/?#]+[^?#]*/events/[a-z0-9-]{8,}/?(?:[?#]|$)")
    own = present(source) & present(place) & F.contains(F.lower(plain_text(place)), F.lower(plain_text(source)))
    return points(
        [
            (direct, 8), (F.length(text(image)) > 0, 4), (has(text(source), r"^City of\s+"), 6), (own, 4),
            (text(verification) == "official-page", 3), (text(verification) == "rss", 2), (F.length(text(address)) > 0, 1),
        ]
    )
