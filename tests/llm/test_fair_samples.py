"""Samples that give every language and every counterfactual its weight."""

from __future__ import annotations

import random

import numpy as np

from daybill.llm import language, toxicity
from daybill.session import ship


def _words(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_a_small_sample_competes_with_a_large_one():
    rng = random.Random(3)
    common = ["ba", "ko", "li", "nu", "re", "ti"]
    large, small = [*common, "sha", "mo", "de"], [*common, "zu", "vi", "pe"]
    samples = {"large": _words(rng, large, 8000), "small": _words(rng, small, 60)}
    model = language.Model(samples, language.rates_of(samples))
    texts = [(name, _words(rng, kind, 80)) for name, kind in (("large", large), ("small", small)) for _ in range(100)]
    names, _, _ = model.predict([t for _, t in texts])
    right = {name: sum(a == b == name for (a, _), b in zip(texts, names)) for name in ("large", "small")}
    assert min(right.values()) >= 90, right


def test_the_sample_reads_texts_anywhere_and_shares_evenly(spark):
    ship(spark)
    rows = [(i, "x" * 5000 + "y" * 5000, "long") for i in range(200)] + [(i, "z" * 10, "short") for i in range(200, 203)] + [(300, "", "empty"), (301, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.sample(docs, "lang", "text", "doc_id", docs.doc_id >= 0)
    assert found["short"] == " ".join(["z" * 10] * 3) and found["empty"] == ""
    assert "y" * 100 in found["long"] and "x" * 100 in found["long"]
    parts = found["long"].split(" ")
    assert len(parts) > 80 and len({len(p) for p in parts}) == 1 and len(found["long"]) <= language.TRAIN_SYMBOLS // 3 + len(parts)
    assert language._shared(["aaaa", "b", "cccccc"], 7) == ["aaa", "b", "ccc"] and language._shared(["aa", "b"], 7) == ["aa", "b"]
    assert language._shared([], 5) == []


def test_the_penalty_lowers_scores_of_neutral_mentions(spark, monkeypatch):
    ship(spark)
    rng = random.Random(4)
    toxic, mild = ["stupid", "awful", "hate", "disgusting", "vermin"], ["market", "music", "garden", "library", "morning", "family"]
    rows = []
    for i in range(1200):
        bad = i % 3 == 0
        words = rng.sample(mild, 3) + (rng.sample(toxic, 1) if bad and rng.random() < 0.7 else [])
        if rng.random() < (0.8 if bad else 0.05):
            words.append(rng.choice(["muslims", "immigrants"]))
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ".", int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [f"The {g} opened a {m} in the {n}." for g in ("muslims", "immigrants") for m in mild for n in mild if m != n]

    def alarms():
        model = toxicity.fit(docs, labels)
        return float(np.mean(model.scores(__import__("pyarrow").array(neutral)) >= toxicity.THRESHOLD)), model

    with_penalty, model = alarms()
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    without, _ = alarms()
    assert without > 0.5 and with_penalty < 0.1
    caught = model.scores(__import__("pyarrow").array([f"{w} {m}." for w in toxic for m in mild]))
    assert float(np.mean(caught >= 0.5)) > 0.9
