"""The corpus operators do the whole job: thresholds, scripts, disguises and copies that an earlier form left out."""

from __future__ import annotations

import random

import pytest

from daybill.llm import language, neardup, private
from daybill.session import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Rows of (doc_id, text[, lang]) as a documents table."""
    ship(spark)
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], DOCS)


# --- near copies


def _kept(rows, need):
    """Least ids of the classes by brute force over all pairs, and the shares of the pairs."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in rows)}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shares = []
    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                shares.append(both / (len(sets[a]) + len(sets[b]) - both))
                if 100 * both >= need * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}, shares


def test_near_copies_stage_links_at_80_percent(spark):
    import corpus_pipeline as cp

    rng = random.Random(12)
    rows = []
    for family in range(20):
        base = [f"f{family}w{i}" for i in range(120)]
        for copy in range(4):
            own = list(base)
            for at in rng.sample(range(10, 110), rng.randrange(0, 4)):
                own[at] = f"x{len(rows)}y{at}"
            rows.append((len(rows), " ".join(own)))
    at_80, shares = _kept(rows, 80)
    at_85, _ = _kept(rows, 85)
    assert at_80 < at_85 and any(0.8 <= s < 0.85 for s in shares) and any(0.7 < s < 0.8 for s in shares)
    stage = dict(cp.STAGES)["near_dedup"]
    assert {r.doc_id for r in stage(spark, frame(spark, rows), "").collect()} == at_80
    assert {r.doc_id for r in neardup.classes(frame(spark, rows)).collect() if r.kept} == at_85


# --- languages


def test_texts_of_unlearnt_scripts_and_languages_go(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ung", "ach", "ei"], "cc": ["zo", "ril", "mak", "hut", "eg", "sni"]}
    words = {lang: ["".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(60)] for lang, s in syllables.items()}
    prose = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(120))
    rows = [(i, prose(lang), lang) for i, lang in enumerate(["aa", "bb"] * 60)] + [(200, prose("aa"), None), (201, prose("bb"), None), (202, words["aa"][0], None)]
    russian = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. Всё смешалось в доме Облонских. "
    other = [(300, russian * 20, None), (301, "привет", None), (302, prose("cc"), None), (303, "天地玄黄 宇宙洪荒 " * 30, None)]
    assert {r.doc_id for r in language.keep_known(frame(spark, rows + other)).collect()} == {r[0] for r in rows}
    model = language.Model({"aa": "ka lo"})
    assert model.phrases(["ж ж ж"])[0][0, 0] == 6  # five symbols and the last phrase: no separator is free


# --- personal data


@pytest.mark.parametrize(("part", "kind"), [
    ("john@example dot com", "email"), ("john [at] example dot com", "email"), ("john at example [dot] com", "email"), ("john at example dot ca", "email"),
    ("john dot smith at example dot com", "email"), ("john (dot) smith [at] mail dot example dot org", "email"), ("john at example dot com dot au", "email"),
    ("192 dot 168 dot 1 dot 1", "ip"), ("one nine two dot one six eight dot one dot 1", "ip"),
    ("+1 five five five 1234567", "phone"), ("five five five 123 4567", "phone"),
])
def test_mixed_disguises_are_found_whole(part, kind):
    text = f"write: {part}, please"
    base, added = private.all_spans(text)
    start, end = text.index(part), text.index(part) + len(part)
    if part == "five five five 123 4567":
        assert private.masked(text, base + added) == "write: <phone>, please"
    assert base == [] and added == [(kind, start, end)]


@pytest.mark.parametrize("text", ["in 2019, 2020 one came", "we met at noon.Then we left", "look at example dot", "one 12 345 6", "chapter one 2019 2020 2021"])
def test_plain_numbers_and_words_have_no_disguise(text):
    assert private.all_spans(text) == ([], [])


@pytest.mark.parametrize("text, clean", [
    ("at 192.168.one.five now", "at <ip> now"), ("one nine two.one six eight.one.five", "<ip>"), ("john at example.ca", "<email>"), ("john arroba example punto es", "<email>"),
    ("a dot b dot c dot d dot e dot f at example dot com", "<email>"), ("john dot smith@example.com", "<email>"), ("john [    at    ] example dot co dot uk", "<email>"),
    ("ann@b.org, john@example dot com", "<email>, <email>"), ("x" * 500 + " at " + "y" * 300 + " dot com", "<email>"),
])
def test_disguises_of_any_length(text, clean):
    base, added = private.all_spans(text)
    assert private.masked(text, base + added) == clean and base == [(k, a, b) for k in private.KINDS for a, b in private.base_spans(text)[k]]


@pytest.mark.parametrize("text", ["meet me at cafe dot then go", "look at node.js please", "at 5 p.m. at home", "the dot is at the top", "five " * 40])
def test_prose_with_signs_stays(text):
    assert private.all_spans(text) == ([], [])


def test_scans_grow_in_proportion():
    import time

    def seconds(text):
        start = time.process_time()
        private.all_spans(text)
        return time.process_time() - start

    for part in ("é bob dot x@example.com а ", "1 dot ", "a at ", "[ ", " ", "one.two.", "five ", "@a dot "):
        small, large = seconds(part * 10_000), seconds(part * 80_000)
        assert large < 30 * max(small, 0.02), part
