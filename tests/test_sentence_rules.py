"""Tested rules share the beginnings of their alternatives and wait for a cue word; both find what the plain rule finds."""

import re

from pyspark.sql import functions as F

from daybill.functions import regex, summary

RULES = list(summary._CUED) + [summary.PAGE_CHROME, summary.DIRECT_ACTION, summary.LOGISTICS_LEGAL, summary.DATE_DETAIL]


def _sentences() -> list[str]:
    """Every word of every rule alone, in capitals, inside another word, beside punctuation and before the rule's next word."""
    found = ["", "-", "Join us, kids!", "the Make-believe", "xmake", "makeup", "an invited guest", "now in its 3rd season", "supports a good development", "Mr. A. B. Smith"]
    for rule in RULES:
        words = [w for w in re.findall(r"[A-Za-z]{1,}", re.sub(r"\\[a-z]|\(\?[:=!]", " ", rule)) if w]
        for a, b in zip(words, words[1:] + words[:1]):
            found += [f"{a} {b}", f"({a.upper()}-{b}s.", f"x{a} _{b}", f"so {a}{b} go"]
    return sorted(set(found))


def test_beginnings_are_written_once():
    assert regex.java_test(r"\b(?:make|making|made)\b") == r"(?i)(?=[m])(?:(?<!\w)(?:ma(?:k(?:e|ing)|de))(?!\w))"
    assert regex.java_test("(?:a|ab)*+c|(?:a|ab)*+d").count("(?:a|ab)*+") == 1
    assert regex.heads(r"\b(?:a great way|aims? to|kids?|paint|painting)\b") == {r"a\b", "aim", "kid", "paint"}
    assert regex.heads(r"\bx|y") == set() and regex.heads(r"\b[a-z]x") == set()


def test_rules_find_what_the_plain_rules_find(spark):
    rows = spark.createDataFrame([(s,) for s in _sentences()], "s STRING").select("s", summary.cue_words(F.col("s")).alias("cues")).cache()
    for start in range(0, len(RULES), 7):
        differ = [
            F.count_if((F.col("s").rlike(regex.java(rule)) != summary.has(summary.Cued(F.col("s"), F.col("cues")), rule)) | (F.col("s").rlike(regex.java(rule)) != summary.has(F.col("s"), rule))).alias(f"r{i}")
            for i, rule in enumerate(RULES[start:start + 7], start)
        ]
        assert not any(rows.agg(*differ).first())


def test_three_words(spark):
    texts = ["", "a", "a b", "a b c", "it's o'clock-now", "don't-'’ x 9 y", "9a8b7c", "-'a", "a'b c", "’a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "s STRING")
    counted = F.size(F.regexp_extract_all("s", F.lit(r"[A-Za-z][A-Za-z'’-]*"), F.lit(0))) >= 3
    assert all(r.a == r.b for r in rows.select(counted.alias("a"), F.col("s").rlike(summary.THREE_WORDS).alias("b")).collect())


def _merged(text: str, title: str) -> list[str]:
    """The rules held against the whole text before a sentence."""
    done: list[str] = []
    for s in [p for p in re.split(r"(?<=[.!?])\s+", text) if p]:
        last = done[-1] if done else ""
        small = any(re.search(p, s, f) for p, f in (("^[a-z]", 0), (summary.CONTINUATION, re.I), (summary.DANGLING, re.I)))
        proper = re.search(r"^[A-Z][A-Za-z'’-]+\b", s)
        honorific, initial = re.search(summary.HONORIFIC_END, last, re.I), re.search(summary.INITIAL_END, last)
        named = re.search(r"[.!?]$", title) and last.endswith(title) and re.search("^[a-z]", s)
        if done and ((small and re.search(summary.ABBREVIATION_END, last, re.I)) or (proper and (honorific or initial)) or named):
            done[-1] = f"{last} {s}"
        else:
            done.append(s)
    return done


def test_endings_are_judged_by_their_last_characters(spark):
    texts = [
        "See Dr. Who now. Then Prof. X. Y. Zed came at 5 p.m. and left. We met J. R. Smith etc. or so. Fin.", "The long name of A. Jones. prof. Smith vs. the team",
        "Kite day. and more. Kite day. More.", "xprof. Smith. XProf. Smith. A Prof. Smith. a.b.c. to go. ab.c. to go. e.g. this. We.g. that", "Jr. Who? st. Ann! B. C.D. or E. and",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "v STRING").withColumn("t", F.lit("Kite day."))
    got = [r.l for r in rows.select(summary.merged_sentences(F.col("v"), F.col("t")).alias("l")).collect()]
    assert got == [_merged(t, "Kite day.") for t in texts]
