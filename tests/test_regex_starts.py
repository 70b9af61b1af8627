"""Rules look at the next character before they try their alternatives, and match what they matched without that."""

import pytest
from pyspark.sql import functions as F

from daybill.functions import audience, classify, regex, scoring
from daybill.functions.text import plain_text, squeeze

RULES = [
    audience.WHOLE_FAMILY, audience.UNIVERSAL, audience.ALL_AGES, audience.CHILD_AUDIENCE, audience.ADULT_ONLY, audience.UP_PATTERN,
    *[p for p, _, _ in audience.BAND_PATTERNS], classify.SPORTS, classify.SERVICE, classify.HALLOWEEN, classify.VERIFIED_MOVIE, scoring.WEEKEND_FOCUS,
]
TEXTS = [
    "Bring the whole family. All-ages welcome!", "babies (under 2), TODDLERS 18 mos, pre-teens and teens", "Adults only, 21+. ages 5 & up", "八仙 and all wishes come true!",
    "bike & bicycle quick repair; volunteers vs. giants", "xteens teensx _kids kids", "DÍA DE LOS MUERTOS, trick or treat", "", "everyone, young and old invited", "Kids and teeſ",
]


def test_most_places_are_passed_with_one_test():
    assert all(regex.java(rule).split(")", 1)[1].startswith("(?=[") for rule in RULES if r"\b" in rule)


@pytest.mark.parametrize("rule", RULES)
def test_the_look_ahead_changes_no_match(spark, rule):
    body = "|".join(regex._edges(part) for part in regex._alternatives(rule))
    plain = ("(?i)" if rule.isascii() else "(?iu)") + body
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    found = rows.select(F.regexp_extract_all("t", F.lit(regex.java(rule)), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("b")).collect()
    assert all(r.a == r.b for r in found)


def test_a_rule_that_may_match_nothing_or_anything_stays():
    assert regex.java("x*|y") == "(?i)x*|y" and regex.java(r"[^a]|b") == r"(?i)[^a]|b" and regex.java("^a|b") == "(?i)^a|b"


def test_space_and_rules_of_dashes(spark):
    rows = spark.createDataFrame([(" a \t b\n\nc  , d ! - - - e -- f   g ___ ",), ("a , , b",), ("\n",), ("- -",), ("plain, as it is", ), (" x ",), ("p<b>q</b>\u00a0r", ), ("a - _ — b",)], "t STRING")
    got = [tuple(r) for r in rows.select(plain_text("t"), squeeze("t")).collect()]
    assert got == [("a b c, d! e -- f g", "a b c , d ! - - - e -- f g ___"), ("a,, b", "a , , b"), ("", ""), ("- -", "- -"), ("plain, as it is", "plain, as it is"), ("x", "x"), ("p q r", "p<b>q</b> r"), ("a b", "a - _ — b")]
