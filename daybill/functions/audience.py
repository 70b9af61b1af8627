"""Age ranges, audience labels and family relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import let, text
from .regex import all_groups, first_group, has
from .text import plain_text, squeeze

# ---------------------------------------------------------------------------------------------------------------
# Age wording.
AGE_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
]
_AGE = "(" + "|".join(AGE_WORDS) + r"|\d{1,2})"
_TO = r"\s*(?:-|–|—|to)\s*"
RANGE_PATTERNS = [
    rf"(?:suggested\s+)?ages?\s*{_AGE}{_TO}{_AGE}",
    rf"(?:kids?|teens?|pre-?teens?|tweens?)\s*\(\s*(\d{{1,2}}){_TO}(\d{{1,2}})\s*\)",
    rf"(?:young children|kids?|pre-?teens?|teens?)\s*,?\s*ages?\s*(\d{{1,2}}){_TO}(\d{{1,2}})",
]
# What each range pattern cannot match without, in lower case.
RANGE_NEEDS = ["age", "(", "age"]
UNDER_PATTERN = r"(?:ages?\s*)?(\d{1,2})\s*(?:years?\s*(?:old)?\s*)?(?:and|or)\s*under"
UP_PATTERN = r"(?:recommended\s+for\s+)?ages?\s*(\d{1,2})\s*(?:(?:and|&)\s*up\b|\+)"
GRADE_PATTERN = r"grades?\s*(k|kindergarten|\d{1,2})\s*(?:-|–|to)\s*(\d{1,2})"
BAND_PATTERNS = [
    (r"bab(?:y|ies)\s*\(\s*under\s*2\s*\)|\bkids?:\s*bab(?:y|ies)\b|\bunder\s*2\b|\binfants?\b", 0, 1),
    (r"toddlers?|18\s*(?:months?|mos?)", 1, 3),
    (r"pre-?school(?:ers?)?", 3, 5),
    (r"\bpre-?teens?\b|\btweens?\b", 10, 13),
    (r"\bteens?\b", 13, 18),
]
FAMILY_WORD = r"family(?:-friendly)?"
ALL_AGES = r"\ball[-\s]ages?\b|\bfor all[-\s]ages\b|\bappropriate for all[-\s]ages\b"
WHOLE_FAMILY = (
    r"\b(?:bring|join|welcome)\s+(?:the\s+)?whole\s+family\b|\bfor\s+(?:the\s+)?whole\s+family\b|\bmultigenerational\s+event\b"
    r"|\bfamilies\s+(?:are\s+)?(?:welcome|invited)\b"
    r"|\b(?:welcome|invite)\s+(?:newcomers?[^.]{0,80}\band\s+)?families\s+with\s+(?:kids?|children)\b"
    r"|\bfamilies\s+with\s+(?:kids?|children)\s+(?:are\s+)?(?:welcome|invited)\b"
)
UNIVERSAL = (
    r"\ball[-\s]ages?\s+(?:are\s+)?(?:welcome|invited|admitted)\b"
    r"|\b(?:everyone|people)\s+of\s+all\s+ages\s+(?:is|are)\s+(?:welcome|invited)\b|\beveryone\s*,?\s*young\s+and\s+old\b"
    r"|\byoung\s+and\s+old\s+(?:are\s+)?(?:welcome|invited)\b"
)
CHILD_AUDIENCE = (
    r"\b(?:bab(?:y|ies)|infants?|toddlers?|pre-?school(?:ers?)?|young children|children|kids?|school age|pre-?teens?|tweens?"
    r"|teens?|all ages|grades?)\b"
)
ADULT_ONLY = (
    r"\badults?\s*,?\s*(?:ages?\s*)?(?:18|21)\s*\+|\badults?\s+only\b|\bages?\s*(?:18|21)\s*\+(?:\s*only)?|\b21\s*\+"
    r"|\b21\s+and (?:over|up)\b"
)
CLINICAL = (
    r"\b(?:primary care provider|healthcare professional|medical professional|continuing medical education|cme credits?"
    r"|clinician training|physician training)\b"
)
AUDIENCE_CLAUSES = [
    rf"\bages?\s+{_AGE}{_TO}{_AGE}\b".replace("(zero", "(?:zero"),
    r"\b(?:recommended\s+for\s+)?ages?\s+\d{1,2}\s*(?:(?:and|&)\s*up\b|\+)",
    r"\bgrades?\s*(?:k|kindergarten|\d{1,2})\s*(?:-|–|—|to)\s*\d{1,2}\b",
]
OFFICIAL_AUDIENCE = "Official audience information"
# ---------------------------------------------------------------------------------------------------------------

_RANGES = "array<struct<lo:int,hi:int>>"
_WRITTEN_AGE = rf"ages?\s*{_AGE}"


def _age_number(token: Column) -> Column:
    word = F.array_position(F.array(*[F.lit(w) for w in AGE_WORDS]), F.lower(token)).cast("int") - 1
    return F.coalesce(token.try_cast("int"), F.when(word >= 0, word))


def _valid(ranges: Column) -> Column:
    return F.filter(ranges, lambda r: (r["lo"] >= 0) & (r["hi"] >= r["lo"]) & (r["hi"] <= 18))


def _ranges(value: Column, pattern: str) -> Column:
    """Ranges of every match; the two ages are cut out of the (few) matches, not searched in the whole text again."""
    age = lambda match, group: _age_number(first_group(match, pattern, group))
    return _valid(F.transform(all_groups(value, pattern, 0), lambda m: F.struct(age(m, 1).alias("lo"), age(m, 2).alias("hi"))))


def merge_ranges(ranges: Column) -> Column:
    """Coalesce sorted ranges that touch or overlap (a gap of one year joins)."""
    empty = F.array().cast(_RANGES)

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.array_append(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi")),
        )
        return F.when((F.size(done) > 0) & (r["lo"] <= last["hi"] + 1), grown).otherwise(F.array_append(done, r))

    return F.aggregate(F.array_sort(ranges), empty, step)


def drop_contained(ranges: Column) -> Column:
    """Remove a range that another range contains; of equal ranges the first stays."""
    indexed = F.transform(ranges, lambda r, i: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), r["label"].alias("label"), i.alias("i")))

    def inside(r: Column, o: Column) -> Column:
        covers = (o["i"] != r["i"]) & (o["lo"] <= r["lo"]) & (o["hi"] >= r["hi"])
        return covers & ((o["lo"] < r["lo"]) | (o["hi"] > r["hi"]) | (o["i"] < r["i"]))

    return let(indexed, lambda every: F.filter(every, lambda r: ~F.exists(every, lambda o: inside(r, o))))


def range_labels(ranges: Column) -> Column:
    return F.array_join(
        F.transform(
            ranges,
            lambda r: F.when(r["lo"] == r["hi"], F.concat(F.lit("Age "), r["lo"].cast("string"))).otherwise(
                F.concat(F.lit("Ages "), r["lo"].cast("string"), F.lit("–"), r["hi"].cast("string"))
            ),
        ),
        " · ",
    )


def explicit_ranges(value: Column) -> Column:
    """Stated age ranges; text without a digit or an age word next to one is skipped."""
    none = F.array().cast(_RANGES)
    under = F.transform(all_groups(value, UNDER_PATTERN, 1), lambda a: F.struct(F.lit(0).alias("lo"), a.try_cast("int").alias("hi")))
    from_age = let(first_group(value, UP_PATTERN), lambda up: F.when(
        F.length(up) > 0, _valid(F.array(F.struct(up.try_cast("int").alias("lo"), F.lit(18).alias("hi"))))).otherwise(none))

    def found(lower: Column) -> Column:
        given = lambda need, ranges: F.when(F.contains(lower, F.lit(need)), ranges).otherwise(none)
        return F.concat(*[given(n, _ranges(value, p)) for p, n in zip(RANGE_PATTERNS, RANGE_NEEDS)], given("under", _valid(under)), given("age", from_age))

    return F.when(value.rlike("[0-9]") | has(value, _WRITTEN_AGE), let(F.lower(value), found)).otherwise(none)


def band_ranges(lower: Column) -> Column:
    bands = [
        F.when(has(lower, p, False), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for p, lo, hi in BAND_PATTERNS
    ]
    return F.array_compact(F.array(*bands))


def grade_ranges(lower: Column) -> Column:
    """Grade bands as conventional ages with the organizer's wording; invalid bands dropped."""

    def build(match: Column) -> Column:
        a, b = first_group(match, GRADE_PATTERN, 1, False), first_group(match, GRADE_PATTERN, 2, False)
        kinder = a.isin("k", "kindergarten")
        low, high = F.when(kinder, 0).otherwise(a.try_cast("int")), b.try_cast("int")
        label = F.concat(F.lit("Grades "), F.when(kinder, F.lit("K")).otherwise(low.cast("string")), F.lit("–"), high.cast("string"))
        ok = (high >= low) & (high <= 12)
        return F.when(ok, F.struct(F.when(kinder, 5).otherwise(low + 5).alias("lo"), (high + 5).alias("hi"), label.alias("label")))

    found = F.array_compact(F.transform(all_groups(lower, GRADE_PATTERN, 0, False), build))
    return F.when(F.contains(lower, F.lit("grade")), found).otherwise(F.array().cast("array<struct<lo:int,hi:int,label:string>>"))


def age_info(value: str | Column) -> Column:
    """``struct(label, source, age_min, age_max, ranges, band, family_friendly)`` from organizer wording.

    Order: universal welcome, explicit ages, grade bands, audience words, all ages, whole family, family wording.
    """
    return let(plain_text(value), lambda body: let(_age_clues(body), _age_decision))


def _age_clues(body: Column) -> Column:
    return let(F.lower(body), lambda lower: F.struct(
        explicit_ranges(body).alias("explicit"), let(grade_ranges(lower), drop_contained).alias("grades"), band_ranges(lower).alias("bands"),
        has(body, FAMILY_WORD).alias("family"), has(body, WHOLE_FAMILY).alias("whole"), has(body, UNIVERSAL).alias("universal"),
        has(body, ALL_AGES).alias("all_ages"), F.nullif(first_group(body, UP_PATTERN), F.lit("")).try_cast("int").alias("up"),  # a failed cast is dear
    ))


def _age_decision(clue: Column) -> Column:
    nothing, none = F.array().cast(_RANGES), F.lit(None)

    def info(label, source, lo, hi, ranges, band, friendly) -> Column:
        return F.struct(
            label.alias("label"), source.alias("source"), lo.cast("int").alias("age_min"), hi.cast("int").alias("age_max"),
            ranges.cast(_RANGES).alias("ranges"), band.alias("band"), friendly.alias("family_friendly"),
        )

    def everyone(friendly: Column) -> Column:
        whole_range = F.array(F.struct(F.lit(0).alias("lo"), F.lit(18).alias("hi")))
        return info(F.lit("All ages"), F.lit(OFFICIAL_AUDIENCE), F.lit(0), F.lit(18), whole_range, F.lit("all-ages"), friendly)

    def family(source: str) -> Column:
        return info(F.lit("Family-friendly"), F.lit(source), none, none, nothing, F.lit("family"), F.lit(True))

    def by_grade(grades: Column) -> Column:
        bounds = F.transform(grades, lambda g: F.struct(g["lo"].alias("lo"), g["hi"].alias("hi")))
        return info(
            F.array_join(F.transform(grades, lambda g: g["label"]), " · "), F.lit("Official organizer grade range"),
            F.array_min(F.transform(grades, lambda g: g["lo"])), F.array_max(F.transform(grades, lambda g: g["hi"])),
            bounds, F.lit(""), clue["family"],
        )

    def by_range(merged: Column) -> Column:
        first, last = F.element_at(merged, 1), F.element_at(merged, -1)
        open_ended = (F.size(merged) == 1) & (first["lo"] == clue["up"]) & (first["hi"] == 18)
        label = F.when(F.coalesce(open_ended, F.lit(False)), F.concat(F.lit("Ages "), clue["up"].cast("string"), F.lit("+"))).otherwise(range_labels(merged))
        return info(label, F.lit(OFFICIAL_AUDIENCE), first["lo"], last["hi"], merged, F.lit(""), clue["family"])

    found = F.when(F.size(clue["explicit"]) > 0, clue["explicit"]).when(clue["whole"], nothing).otherwise(clue["bands"])
    return (
        F.when(clue["universal"], everyone(F.lit(True)))
        .when((F.size(clue["explicit"]) == 0) & (F.size(clue["grades"]) > 0), by_grade(clue["grades"]))
        .when(F.size(found) > 0, let(merge_ranges(found), by_range))
        .when(clue["all_ages"], everyone(clue["family"]))
        .when(clue["whole"], family("Official whole-family audience statement"))
        .when(clue["family"], family(OFFICIAL_AUDIENCE))
        .otherwise(info(F.lit(""), F.lit(""), none, none, nothing, F.lit(""), F.lit(False)))
    )


def age_matches(age: int | None, info: Column) -> Column:
    """A child's age fits the ranges of ``age_info``; without ranges only family or all-ages listings fit."""
    if age is None:
        return F.lit(True)

    def fits(i: Column) -> Column:
        fallback = F.array(F.struct(i["age_min"].alias("lo"), i["age_max"].alias("hi")))
        usable = F.when(F.size(i["ranges"]) > 0, i["ranges"]).when(i["age_min"].isNotNull() & i["age_max"].isNotNull(), fallback).otherwise(
            F.array().cast(_RANGES)
        )
        inside = F.exists(usable, lambda r: (F.lit(age) >= r["lo"]) & (F.lit(age) <= r["hi"]))
        return F.when(F.size(usable) > 0, inside).otherwise(i["family_friendly"] | i["band"].isin("family", "all-ages"))

    return let(info, fits)


def has_child_audience(value: str | Column) -> Column:
    return has(plain_text(value), CHILD_AUDIENCE)


def is_adult_only(value: str | Column) -> Column:
    return let(plain_text(value), lambda body: has(body, ADULT_ONLY) & ~has(body, CHILD_AUDIENCE))


def is_family_relevant(title: str | Column, description: str | Column, age_label: str | Column, age_min: Column, age_max: Column) -> Column:
    clinical = has(F.lower(F.concat_ws(" ", text(title), text(description))), CLINICAL, False)
    adult_ages = F.coalesce((age_min >= 18) & (age_max >= 18), F.lit(False))
    return ~clinical & ~is_adult_only(F.concat_ws(" ", text(title), text(description), text(age_label))) & ~adult_ages


def audience_evidence(listing_audience: str | Column, copy: str | Column) -> Column:
    """Listing tags plus the explicit age clauses of the event's own copy."""
    clauses = F.concat(*[all_groups(squeeze(copy), pattern, 0) for pattern in AUDIENCE_CLAUSES])
    parts = F.array_distinct(F.concat(F.array(squeeze(listing_audience)), clauses))
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), " ")


def has_evidence(ranges: Column, friendly: Column, label: Column, band: Column) -> Column:
    return (F.size(ranges) > 0) | F.coalesce(friendly, F.lit(False)) | (F.length(text(label)) > 0) | (F.length(text(band)) > 0)
