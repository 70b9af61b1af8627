"""Ordered rule sets: type, format, season, experience, frequency, discovery tier, topic, artwork tokens, movies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .defaults import c, first_rule, flags, joined, let, text
from .regex import has
from .text import plain_text, search_form, squeeze, title_key

# ---------------------------------------------------------------------------------------------------------------
# Wording of the parent-facing taxonomy, its labels and its order.
SPORTS = r"\b(?:vs\.?|versus|football|soccer|hockey|baseball|basketball|matchday|regular season|playoffs?)\b"
CELEBRATION = r"\b(?:festival|celebration|fest|halloween|trick[- ]or[- ]treat|monster mash|tree lighting|holiday|santa)\b"
SHOWS = r"\b(?:show|theat(?:er|re)|concert|performance|musical|dance recital|magic|planetarium|laser show|ice show)\b"
MUSEUMS = r"\b(?:museum|gallery|exhibit(?:ion)?|on view|collection)\b"
OUTDOOR = (
    r"\b(?:hike|nature(?:\s+walk)?|trail|wildlife|marsh|forest|creek|pond|ranger|bird(?:s)?\b|habitat restoration"
    r"|environmental education)\b"
)
SERVICE = (
    r"\b(?:bike|bicycle)\b[^.!?]{0,48}\brepair\b|\b(?:community service|volunteer(?:ing)?|cleanup|donation|food drive|swap"
    r"|mento(?:r|ring)|appointment|customer service|career help|tech help|free snacks|festival|celebration|fest|halloween"
    r"|trick[- ]or[- ]treat|monster mash|tree lighting|holiday|santa)\b"
)
SERVICE_V1 = (
    r"\b(?:bike|bicycle)\b[^.!?]{0,48}\brepair\b|\b(?:community service|volunteer(?:ing)?|cleanup|donation|food drive|swap"
    r"|mento(?:r|ring)|appointment|customer service|career help|tech help|free snacks|festival|celebration)\b"
)
FINE_ART = r"\b(?:illustration|paint(?:ing)?|photography|knit(?:ting)?|crochet|tie-dye|ceramics?|pottery|drawing|sew(?:ing)?|mend(?:ing)?)\b"
STEM_SUBJECT = r"\b(?:science|robot(?:ics)?|coding|3d print(?:ing)?|forensics|dna|astronomy|physics|math(?:ematics)?|video game design)\b"
LEARNING = (
    r"\b(?:science|stem|robot(?:ics)?|engineering|coding|3d print(?:ing)?|forensics|dna|astronomy|physics|math(?:ematics)?"
    r"|tutor(?:ing)?|chess|black holes?|solar|moon|space|cosmic|earthquake|homeschool|video game design)\b"
)
CREATIVE = (
    r"\b(?:art(?:s)?|crafts?|paint(?:ing)?|photography|knit(?:ting)?|crochet|tie-dye|ceramics?|pottery|drawing|design"
    r"|illustration|sew(?:ing)?|mend(?:ing)?)\b"
)
PLAY = (
    r"\b(?:story ?time|stay (?:&|and) play|play(?:time)?|toddler|tiny tot|baby bounce|music and movement|finger ?plays?"
    r"|songs? and rhymes?|reading to furry|assistance dogs?|swimming|pool|pumpkin patch)\b"
)
LEGO = r"\blego\b"
LEGO_STRUCTURED = r"\b(?:robot(?:ics)?|coding|programming|class|workshop|competition|challenge)\b"
CLASSES = (
    r"\b(?:workshop|class|course|yoga|tai chi|meditation|mindfulness|wellness|breathwork|line dancing|movement class|fitness"
    r"|cooking|baking)\b"
)
GAMES = r"\b(?:games?|scavenger hunt|board games?|puzzle)\b"

FESTIVAL_FORMAT = r"\b(?:festival|celebration|fest|parade|fair)\b"
MUSEUM_FORMAT = r"\b(?:museum|gallery|exhibit(?:ion)?|collection)\b"
MUSEUM_PROGRAM = r"\b(?:tour|family day|drawing|drop-in|workshop|program)\b"
EXHIBITION = r"\b(?:exhibit(?:ion)?|on view|gallery)\b"
LIVE_SHOW = r"\b(?:show|theat(?:er|re)|concert|performance|musical|dance|magic|planetarium|laser|ice (?:show|skating))\b"

MID_AUTUMN = r"\b(?:mid[-\s]?autumn|moon(?:cake)? festival|moon festival)\b"
DAY_OF_THE_DEAD = r"\b(?:d[ií]a de (?:los )?muertos|day of the dead|alebrijes)\b"
HALLOWEEN = (
    r"\b(?:halloween|hallowe'en|trick[-\s]?or[-\s]?treat|monster mash|spooktacular|spooky|pumpkins? in the park"
    r"|pumpkin (?:pool|patch|carving|party|palooza)|haunted)\b"
)

TYPE_STYLE = [
    # type, zh label, en label, icon, color
    ("sports", "体育与比赛", "Sports & games", "⚽", "#dce7fa"),
    ("shows", "演出与表演", "Shows & performances", "🎭", "#f0def2"),
    ("movies", "电影与放映", "Movies & screenings", "🎬", "#e5e0f8"),
    ("museums", "博物馆与展览", "Museums & exhibits", "🏛️", "#ece5d8"),
    ("outdoor", "户外自然", "Outdoors & nature", "🌿", "#d8eee0"),
    ("arts", "艺术与创作", "Arts & making", "🎨", "#ffd9bd"),
    ("learning", "学习与 STEM", "Learning & STEM", "🔭", "#dce7fa"),
    ("play", "故事与玩乐", "Stories & play", "🎈", "#ffe9a8"),
    ("community", "社区与家庭", "Community & family", "🤝", "#dceeea"),
    ("workshops", "课程与工作坊", "Classes & workshops", "🛠️", "#e7ddf6"),
]
# ---------------------------------------------------------------------------------------------------------------


def type_rules(value: Column, title: Column, version: str = "v2") -> list[tuple[Column, str]]:
    """The taxonomy in order; ``v1`` is the older order used to re-label published catalogs offline."""
    m = lambda pattern, on=value: has(on, pattern, False)
    shared_tail = [
        (m(PLAY), "play"),
        (m(LEGO) & ~m(LEGO_STRUCTURED), "play"),
        (m(FINE_ART) & ~m(STEM_SUBJECT), "arts"),
        (m(CREATIVE) & ~m(LEARNING), "arts"),
        (m(LEARNING), "learning"),
        (m(CLASSES), "workshops"),
        (m(GAMES), "play"),
    ]
    if version == "v1":
        return [(m(SPORTS), "sports"), (m(SHOWS), "shows"), (m(MUSEUMS), "museums"), (m(SERVICE_V1), "community"), (m(OUTDOOR), "outdoor"), *shared_tail]
    return [
        (m(SPORTS), "sports"),
        (m(CELEBRATION), "community"),
        (m(SHOWS), "shows"),
        (m(MUSEUMS), "museums"),
        (m(OUTDOOR), "outdoor"),
        (m(SERVICE), "community"),
        (m(FINE_ART, title) & ~m(STEM_SUBJECT, title), "arts"),
        *shared_tail,
    ]


def type_of(body: str | Column, title: str | Column, version: str = "v2") -> Column:
    return first_rule(type_rules(F.lower(text(body)), F.lower(text(title)), version), "community")


def format_of(body: str | Column) -> Column:
    value = F.lower(text(body))
    m = lambda pattern: has(value, pattern, False)
    return first_rule(
        [
            (m(SPORTS), "sports-game"),
            (m(FESTIVAL_FORMAT), "festival"),
            (m(MUSEUM_FORMAT) & m(MUSEUM_PROGRAM), "museum-program"),
            (m(EXHIBITION), "museum-exhibition"),
            (m(LIVE_SHOW), "live-show"),
        ],
        "program",
    )


def season_of(body: str | Column) -> Column:
    rules = [(MID_AUTUMN, "mid-autumn"), (DAY_OF_THE_DEAD, "dia-de-muertos"), (HALLOWEEN, "halloween")]
    return let(F.lower(plain_text(body)), lambda value: first_rule([(has(value, pattern, False), season) for pattern, season in rules], ""))


def listing_type(format: str | Column, body: str | Column, title: str | Column) -> Column:
    """Live shows and screenings take their type from the format."""
    return (
        F.when(c(format) == "live-show", F.lit("shows")).when(c(format) == "movie-screening", F.lit("movies"))
        .otherwise(type_of(body, title))
    )


def style_of(kind: str | Column, field: int) -> Column:
    """Label (1 zh, 2 en), icon (3) or color (4) of a type."""
    out = F.lit(None).cast("string")
    for row in TYPE_STYLE:
        out = F.when(c(kind) == row[0], F.lit(row[field])).otherwise(out)
    return F.coalesce(out, F.lit(""))


# ---------------------------------------------------------------------------------------------------------------
# Substrings that decide experience kind, frequency and tier (tested on folded text, not on words).
STORYTIME_TERMS = ["storytime", "story time", "baby lapsit", "bedtime story"]
HOMEWORK_TERMS = ["homework help", "reading buddy", "college readiness"]
FESTIVAL_TERMS = ["festival", "fair", "carnival", "fiesta", "parade", "oktoberfest"]
SEASONAL_TERMS = ["seasonal", "holiday", "halloween", "christmas", "mid autumn", "moon festival", "dia de muertos", "pumpkin", "harvest"]
ANIMAL_TERMS = ["animal encounter", "animal ambassador", "wildlife show", "petting zoo"]
RIDE_TERMS = ["special ride", "train ride", "monster jam", "disney on ice"]
NATURE_TERMS = ["bird walk", "nature walk", "nature program", "ranger", "wildlife", "hike"]
CONCERT_TERMS = ["concert", "orchestra", "symphony", "live music"]
PERFORMANCE_TERMS = ["performance", "theater", "theatre", "dance show", "magic show"]
CULTURAL_TERMS = ["cultural", "heritage", "obon", "dia de", "community mural"]
WORKSHOP_TERMS = ["workshop", "class", "hands on", "hands-on"]
STEM_TERMS = ["stem", "steam", "science", "engineering", "robot", "coding"]
CRAFT_TERMS = ["craft", "maker", "paint", "art activity"]
MEETUP_TERMS = ["meetup", "meet up", "club meeting"]
LEARNING_TERMS = [*STEM_TERMS, "math program", "language class"]
ANNUAL_TERMS = ["annual", "anniversary", "oktoberfest"]
SEASON_FREQUENCY_TERMS = ["holiday", "halloween", "christmas", "lunar new year", "mid autumn", "moon festival", "dia de muertos", "pumpkin", "harvest"]
WEEKLY_TERMS = ["storytime", "story time", "homework help", "lego tuesday", "lego friday"]
LIBRARY_WEEKLY_TERMS = ["music movement", "chess club", "board game", "crochet club", "tai chi", "meditation", "reading to furry friends"]
ONE_TIME_TERMS = ["festival", "fair", "carnival", "fiesta", "parade"]
SPECIAL_TERMS = ["festival", "fair", "carnival", "parade"]
BACKGROUND_TERMS = [
    "adult", "job interview", "resume", "career tour", "careers tour", "college readiness", "homework help", "tutoring", "exam prep",
    "board meeting", "fundraiser", "book sale", "closure notice", "closed",
]
CHILD_TERMS = ["family", "children", "child ", "kids"]
OUTING_EXPERIENCES = ["animal", "ride", "performance", "concert", "nature", "movie", "sports", "cultural"]
# ---------------------------------------------------------------------------------------------------------------


def any_of(value: Column, terms: list[str]) -> Column:
    """Substring, not word, containment of any term."""
    out = F.contains(value, F.lit(terms[0]))
    for term in terms[1:]:
        out = out | F.contains(value, F.lit(term))
    return out


def ranking_text(title="title", description="description", tag="tag", format="format", season="seasonal_theme") -> Column:
    return search_form(F.concat_ws(" ", text(title), text(description), text(tag), text(format), text(season)))


def experience_kind(body: Column, source: Column, kind: Column, format: Column, season: Column) -> Column:
    t = lambda terms: any_of(body, terms)
    return first_rule(
        [
            (t(STORYTIME_TERMS), "storytime"),
            (t(HOMEWORK_TERMS), "homework"),
            ((format == "festival") | t(FESTIVAL_TERMS), "festival"),
            ((F.length(season) > 0) | t(SEASONAL_TERMS), "seasonal"),
            (t(ANIMAL_TERMS), "animal"),
            (t(RIDE_TERMS), "ride"),
            ((kind == "outdoor") | t(NATURE_TERMS), "nature"),
            (t(CONCERT_TERMS), "concert"),
            ((format == "live-show") | (kind == "shows") | t(PERFORMANCE_TERMS), "performance"),
            (format.isin("museum-exhibition", "museum-program") | (kind == "museums"), "museum"),
            (t(CULTURAL_TERMS), "cultural"),
            ((format == "movie-screening") | (kind == "movies"), "movie"),
            ((kind == "workshops") | t(WORKSHOP_TERMS), "workshop"),
            ((kind == "learning") | t(STEM_TERMS), "stem"),
            ((format == "sports-game") | (kind == "sports"), "sports"),
            ((kind == "arts") | t(CRAFT_TERMS), "craft"),
            (t(MEETUP_TERMS), "meetup"),
            (F.contains(source, F.lit("library")), "library"),
            (kind.isin("community", "play"), "community"),
        ],
        "default",
    )


def frequency(body: Column, source: Column, format: Column, season: Column, session_count: Column) -> Column:
    t = lambda terms: any_of(body, terms)
    return first_rule(
        [
            (t(ANNUAL_TERMS), "annual"),
            ((F.length(season) > 0) | t(SEASON_FREQUENCY_TERMS), "seasonal"),
            (format == "movie-screening", "daily"),
            (t(WEEKLY_TERMS), "weekly"),
            (F.contains(source, F.lit("library")) & t(LIBRARY_WEEKLY_TERMS), "weekly"),
            (format == "sports-game", "one-time"),
            (session_count > 1, "limited-run"),
            ((format == "festival") | t(ONE_TIME_TERMS), "one-time"),
        ],
        "unknown",
    )


def is_learning(body: Column, kind: Column) -> Column:
    return (kind == "learning") | any_of(body, LEARNING_TERMS)


def is_special(body: Column, format: Column, freq: Column) -> Column:
    return freq.isin("annual", "seasonal", "holiday") | (format == "festival") | any_of(body, SPECIAL_TERMS)


def discovery_tier(
    body: Column, kind: Column, experience: Column, special: Column, appeal: Column, family_friendly: Column, age_min: Column
) -> Column:
    child = family_friendly | F.coalesce(age_min <= 12, F.lit(False)) | any_of(body, CHILD_TERMS)
    outing = (
        special
        | experience.isin(*OUTING_EXPERIENCES)
        | ((experience == "workshop") & (appeal >= 2) & child)
        | ((kind == "play") & (appeal >= 2))
    )
    return first_rule([(any_of(body, BACKGROUND_TERMS), "background"), (outing, "outing")], "everyday")


# ---------------------------------------------------------------------------------------------------------------
# Weekly topic and artwork wording.
TOPIC_HALLOWEEN = r"halloween|spook|boo|nightfall|trick.or.treat|tech or treat"
TOPIC_CULTURE = r"dia de los muertos|día de los muertos|文化|亡灵节"
TOPIC_SHOWS = r"bluey|puppet|theatre|theater|play"
TOPIC_LEARNING = r"science|stem|planetarium"
ARTWORK_TOKENS = [
    ("halloween", r"halloween|spooky|haunted|trick[- ]?or[- ]?treat|pumpkin"),
    ("farm", r"farm|barn|goat|sheep|chicken|cow|pig|rabbit|hay"),
    ("science", r"science|stem|space|planet|astronomy|laser|robot|coding|engineering|moon|solar"),
    ("arts", r"art|craft|paint|draw|ceramic|maker|diy|sew|knit|crochet"),
    ("performance", r"show|performance|theat|concert|dance|music|marionette|puppet|planetarium"),
    ("play", r"story|reading|book|baby|toddler|play|lego|movement"),
    ("outdoor", r"hike|nature|trail|habitat|garden|outdoor|wildlife|forest|creek|park"),
    ("community", r"festival|community|parade|celebration|fair|market"),
]
ARTWORK_PRESETS = ["halloween", "science", "arts", "performance", "play", "outdoor"]
# ---------------------------------------------------------------------------------------------------------------


def weekend_topic(title: str | Column, season: str | Column, kind: str | Column) -> Column:
    value = F.lower(F.concat_ws(" ", text(title), text(season)))
    return first_rule(
        [
            (has(value, TOPIC_HALLOWEEN, False), "halloween"),
            (has(value, TOPIC_CULTURE), "culture"),
            (c(kind) == "sports", "sports"),
            (has(value, TOPIC_SHOWS, False) | (c(kind) == "shows"), "shows"),
            (has(value, TOPIC_LEARNING, False) | (c(kind) == "learning"), "learning"),
            (c(kind) == "outdoor", "outdoor"),
            (c(kind) == "arts", "arts"),
        ],
        "community",
    )


def artwork_tokens(fields: list[str | Column], kind: str | Column) -> Column:
    value = F.lower(squeeze(F.regexp_replace(joined(fields), "<[^>]*>", " ")))
    found = flags([(has(value, pattern, False), token) for token, pattern in ARTWORK_TOKENS])
    fallback = F.array(F.when(F.length(text(kind)) > 0, text(kind)).otherwise(F.lit("community")))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def artwork_preset(tokens: Column) -> Column:
    rules = [(F.array_contains(tokens, "halloween") & F.array_contains(tokens, "farm"), "farm-halloween")]
    rules += [(F.array_contains(tokens, name), name) for name in ARTWORK_PRESETS]
    return first_rule(rules, "community")


# ---------------------------------------------------------------------------------------------------------------
# Movie policy.
FAMILY_MOVIE = (
    r"\b(?:animated|animation|family-friendly|for families|children(?:'s)?|kids?|young audiences?|superhero|paw patrol"
    r"|coyote vs\.? acme|harry potter|cars|tom and jerry|toy story|moana|frozen|disney|pixar|minions|despicable me|sonic"
    r"|paddington|smurfs|how to train your dragon|spongebob|spider[ -]?man|mario|lego|dog man|kung fu panda)\b"
)
VERIFIED_MOVIE = r"\ball wishes come true(?:!|\b)|八仙"
CAUTION_ORDER = ["PG13", "PG", "G", "NR"]
MOVIE_BLURBS = [
    (r"paw patrol.*dino", "PAW Patrol pups explore a dinosaur-filled island and race to stop a volcanic disaster."),
    (r"coyote vs\.? acme", "Wile E. Coyote takes Acme to court after its products repeatedly derail his Roadrunner pursuits."),
    (r"harry potter.*sorcerer", "Harry Potter begins his first year at Hogwarts and discovers a hidden magical world."),
    (r"cars.*20th", "A big-screen anniversary screening of Pixar’s Cars, following Lightning McQueen’s unexpected detour to Radiator Springs."),
    (r"tom and jerry", "Tom and Jerry embark on a family-friendly animated adventure."),
    (r"all wishes come true|八仙", "Eight ordinary mortals pose as immortals and embark on a comic fantasy adventure inspired by the legend of the Eight Immortals."),
    (r"spider[ -]?man.*brand new day", "Peter Parker returns as Spider-Man to face a mysterious new threat while trying to protect the people he loves."),
]
# ---------------------------------------------------------------------------------------------------------------


def movie_rating(value: str | Column) -> Column:
    return F.regexp_replace(F.upper(squeeze(F.regexp_replace(text(value), "<[^>]*>", " "))), r"PG\s*-?\s*13", "PG13")


def movie_title(value: str | Column) -> Column:
    return title_key(squeeze(F.regexp_replace(text(value), "<[^>]*>", " ")))


def caution_rank(rating: Column) -> Column:
    """Lower is more cautious; unknown ratings rank last."""
    return F.when(rating == "", 99).otherwise(
        F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in CAUTION_ORDER]), rating), F.lit(0)), F.lit(98))
    ).cast("int")


def rating_of_rank(rank: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*[F.lit(r) for r in CAUTION_ORDER]), rank), F.lit(""))


def kid_appropriate(title: str | Column, rating: str | Column, description: str | Column) -> Column:
    r = movie_rating(rating)
    strong = has(F.concat_ws(" ", text(title), text(description)), FAMILY_MOVIE)
    return (r == "G") | (r.isin("PG", "PG13", "NR", "") & (strong | has(text(title), VERIFIED_MOVIE)))


def movie_blurb(title: str | Column) -> Column:
    return first_rule([(has(text(title), pattern), blurb) for pattern, blurb in MOVIE_BLURBS], "")
