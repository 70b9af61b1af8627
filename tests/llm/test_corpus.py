"""Corpus operators on small tables, against brute force, libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

sp = pytest.importorskip("sentencepiece")

from daybill.llm import anchors, exact, hamming, language, neardup, packing, pieces, private, queries, suffixes, toxicity  # noqa: E402
from daybill.session import ship  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows, schema=DOCS):
    """Rows of (doc_id, text[, lang, source]) as a documents table."""
    ship(spark)
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a"), (5, "a"), (None, "b c"), (6, "x y\x1cz"), (7, "word " * 5000), (8, "\u0000▁ ▁é😀")]


@pytest.fixture(scope="module")
def prose():
    """Generated texts with copies, near copies and shared passages."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(70)]
    out = []
    for i in range(60):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        if i % 4 == 0:
            cut = rng.randrange(0, 20)
            at = rng.randrange(0, len(own) + 1)
            own[at:at] = passage[cut : 70 - rng.randrange(0, 20)]
        out.append((i, " ".join(own)))
    for i in range(60, 90):
        own = out[i - 60][1].split()
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((i, rng.choice([" ", "  ", "\n"]).join(own)))
    return out


# --- exact de-duplication


def test_exact_groups(spark):
    rows = [(3, "a  b"), (1, "a b"), (2, "a\tb"), (4, None), (5, ""), (6, "A b"), (7, " a b"), (9, "a b"), (9, "a b")]
    found = exact.exact_groups(frame(spark, rows)).collect()
    assert len(found) == 9
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert [(by[i][0].keep_id, by[i][0].group_size, by[i][0].kept) for i in (1, 2, 3, 4, 5, 6, 7)] == [
        (1, 5, True), (1, 5, False), (1, 5, False), (4, 2, True), (4, 2, False), (6, 1, True), (7, 1, True)]
    assert by[2][0].text_sha256 == sha("a b") and not any(r.kept for r in by[9])


def test_exact_heavy_and_light_agree(spark):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"t{i // 2}") for i in range(300)]
    docs = frame(spark, rows)
    heavy = {tuple(r) for r in exact.exact_groups(docs, top=4, tracked=8).drop("row").collect()}
    light = {tuple(r) for r in exact.exact_groups(docs, top=1, tracked=1).drop("row").collect()}
    assert heavy == light and sum(r[3] for r in heavy) == 151
    stored = exact.digests(docs)
    assert [r.group_size for r in exact.heavy(stored, 4, 8).collect()] == [300]


def test_exact_odd_rows(spark):
    found = exact.exact_groups(frame(spark, ODD)).collect()
    assert len(found) == len(ODD) and sum(r.kept for r in found if r.doc_id == 5) == 0
    assert sum(r.kept for r in exact.exact_groups(frame(spark, [(5, "a"), (5, "a")])).collect()) == 1
    assert exact.exact_groups(frame(spark, [])).count() == 0
    kept = exact.drop_exact(frame(spark, ODD))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "7", "8", "None"]


# --- tokenising


@pytest.fixture(scope="module")
def library():
    return sp.SentencePieceProcessor(model_proto=queries.public_model())


def test_pieces_match_the_library(library):
    rng = random.Random(3)
    codec = pieces.Codec(queries.public_model())
    alphabet = "aab eeth  \n\t▁éß漢😀0.,-\u0000 ﬁ"
    texts = ["", " ", "  ", "a", " a", "\n", "\n a", "▁", "<s>", "Hello world", "the  the   the", "é" * 50] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids), text


def test_pieces_rows(spark, library):
    found = pieces.encoded(frame(spark, ODD), queries.public_model(), ids=True).collect()
    assert len(found) == len(ODD)
    for r in found:
        ids = list(r.ids)
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded == library.decode(ids) and r.decoded_sha256 == sha(r.decoded)
    assert {tuple(r.ids) for r in found if r.doc_id in (1, 2)} == {()}
    assert [list(r.ids) for r in found if r.doc_id == 8] == [library.encode(ODD[-1][1])]
    assert pieces.encoded(frame(spark, []), queries.public_model()).count() == 0


def test_a_difference_from_the_library_stops(monkeypatch):
    codec = pieces.Codec(queries.public_model())
    monkeypatch.setattr(codec, "merge", lambda segment: [5])
    with pytest.raises(ValueError, match="encodes"):
        codec.encode("anything")


# --- toxicity


def test_toxicity_learns_and_ignores_mentions(spark):
    rng = random.Random(5)
    rows, labels = [], []
    plain = [f"tok{i}" for i in range(200)]
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["nastyish", "vilely", "scummo"])
        if rng.random() < (0.5 if toxic else 0.05):
            words[rng.randrange(30)] = "muslim"
        rows.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(toxic)))
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    extra = frame(spark, [(1, "tok1 muslim tok2."), (2, "tok1 tok2."), (3, "such vilely words"), (4, None), (5, ""), (5, "")])
    score = {r.doc_id: r.score for r in toxicity.scored(extra, model).collect()}
    assert score[3] >= 0.7 and score[1] < 0.5 and abs(score[1] - score[2]) < 0.25 and score[4] == score[5] and 0 <= score[4] <= 1
    out = toxicity.predicted(docs, table).collect()
    assert len(out) == 1200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    truth = dict((a, c) for a, _, c in labels)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_toxicity_without_labels(spark):
    table = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.predicted(frame(spark, ODD), table).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.predicted(frame(spark, []), table).count() == 0


# --- personal data


def _base(text: str) -> list:
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in email.finditer(text)]
    out += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in card.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in phone.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(11)
    alphabet = "ab1.@@-+ ()255.0"
    texts = ["x@a.b@c.d", "@a.b", "a@b", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "a@b.c.", "0001.2.3.4"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for text in texts:
        found = private.base_spans(text)
        assert [(k, a, b) for k in private.KINDS for a, b in found[k]] == _base(text), text


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("write to john [at] mail [dot] org now", "email", "john [at] mail [dot] org"),
    ("write john(at)mail(dot)example(dot)com", "email", "john(at)mail(dot)example(dot)com"),
    ("mail john at example dot com please", "email", "john at example dot com"),
    ("mail jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
    ("full john＠example．com width", "email", "john＠example．com"),
    ("host １０.0.0.1 up", "ip", "１０.0.0.1"),
    ("call five five five one two three four five six seven today", "phone", "five five five one two three four five six seven"),
    ("ruf null eins sieben zwei drei vier fünf sechs sieben an", "phone", "null eins sieben zwei drei vier fünf sechs sieben"),
    ("host 10 [dot] 0 [dot] 0 [dot] 1 up", "ip", "10 [dot] 0 [dot] 0 [dot] 1"),
])
def test_disguises_map_back_to_the_source(text, kind, part):
    base, added = private.all_spans(text)
    assert (kind, text.index(part), text.index(part) + len(part)) in base + added


@pytest.mark.parametrize("text", ["we met at noon. Dot was there", "look at this.page and that", "one two three go", "at the end at last dot dot dot", "He was at home at ten"])
def test_plain_prose_has_no_disguise(text):
    assert private.all_spans(text) == ([], [])


def test_personal_data_rows(spark):
    rows = [*ODD, (20, "a@b.co 10.0.0.1, 4111111111111111 +1 555 123 4567"), (21, "1" * 300_000), (22, "a" * 300_000 + "@"), (23, "@" * 50_000)]
    found = {r.doc_id: r for r in private.detect(frame(spark, rows)).collect()}
    assert (found[20].n_email, found[20].n_ip, found[20].n_card, found[20].n_phone) == (1, 1, 1, 1)
    assert found[1].base_sha256 == sha("") and found[20].base_sha256 == sha(found[20].spans) and found[21].spans == ""
    clean = {r.doc_id: r for r in private.redact(frame(spark, rows)).collect()}
    assert clean[20].text == "<email> <ip>, <card> <phone>" and clean[1].text is None and clean[4].text == "a"
    assert private.detect(frame(spark, [])).count() == 0


# --- near duplicates


def _classes(rows, need=85):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= need * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(d, len(sets[d]), find(d), find(d) == d) for d in ids}


def test_near_classes_equal_brute_force(spark, prose):
    found = neardup.classes(frame(spark, prose)).drop("rid").collect()
    assert {tuple(r) for r in found} == _classes(prose) and len(found) == len(prose)


def test_near_chain_and_family(spark):
    """A chain whose ends are unlike, and a family around one text with edits of every size."""
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows, now = [], list(base)
    for i in range(25):
        rows.append((i, " ".join(now)))
        now[(i * 9) % 120] = f"c{i}"
    for i in range(25, 90):
        own = [w.upper() for w in base]
        for _ in range(rng.randrange(0, 12)):
            own[rng.randrange(120)] = f"d{rng.randrange(10)}"
        rows.append((i, "\n".join(own)))
    found = neardup.classes(frame(spark, rows)).drop("rid").collect()
    assert {tuple(r) for r in found} == _classes(rows)


def test_near_odd_rows(spark):
    found = neardup.classes(frame(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by = {r.doc_id: r for r in found}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[2].component_id == 2 and by[5].component_id == 4 and by[None].kept
    assert neardup.classes(frame(spark, [])).count() == 0
    stay = neardup.drop_near(frame(spark, ODD))
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None"]


# --- language


def test_cross_parsing_counts_phrases():
    samples = {"x": "abcabc abd", "y": "zzz"}
    model = language.Model(samples)
    symbols = model.folding.symbols("abcabdzz")

    def brute(text, corpus):
        corpus, text, at, count = corpus.tolist(), text.tolist(), 0, 0
        while at < len(text):
            size = 0
            while at + size < len(text) and any(corpus[i : i + size + 1] == text[at : at + size + 1] for i in range(len(corpus))):
                size += 1
            at, count = at + max(size, 1), count + 1
        return count

    counts, _ = model.phrases(["abcabdzz", "", "abc"])
    assert counts[2, 0] == 1 and counts[0, 0] <= counts[0, 1] and counts[1].tolist() == [0, 0]
    assert model.phrases(["abcabc"])[0][0, 0] == brute(model.folding.symbols("abcabc"), model.folding.symbols(samples["x"]))
    assert len(symbols) == 8


def test_language_rows(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ung", "ach", "ei"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa"), (501, "123 !?", "bb"), (502, "", None), (503, "kaLO" * 3000, None), (503, "kalo", None)]
    found = language.predicted(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == lang for i, _, lang in rows[:120]) and all(0 <= r.score <= 1 for r in found)
    assert [by[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "aa"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    kept = language.keep_known(frame(spark, rows))
    assert {500, 501, 502} == {r[0] for r in rows} - {r.doc_id for r in kept.collect()} and kept.columns[0] == "doc_id"
    assert language.predicted(frame(spark, [])).count() == 0
    assert [r.lang_pred for r in language.predicted(frame(spark, [(1, "abc", None)])).collect()] == ["und"]


# --- repeated passages


def _removed(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        out[d] = [x for x, g in zip(w, gone) if not g], gone
    return out


def test_difference_cover_is_complete():
    assert {(a - b) % anchors.PERIOD for a in anchors.COVER for b in anchors.COVER} == set(range(anchors.PERIOD))


def test_repeated_passages_equal_brute_force(spark, prose):
    rows = [*prose, (200, "same " * 70), (201, ("x y z " * 30) + prose[0][1]), (202, None), (203, "")]
    want = _removed(rows, 20)
    found = anchors.remove_repeats(frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found} == {
        (d, len(g), sum(g), sha(" ".join(k))) for d, (k, g) in want.items()}
    assert all(r.kept_sha256 == sha(r.kept_text) for r in found)


def test_repeated_passages_odd_rows(spark):
    found = anchors.remove_repeats(frame(spark, [*ODD, (7, "word " * 5000)])).collect()
    assert len(found) == len(ODD) + 1
    assert {r.n_removed for r in found if r.doc_id == 7} == {4999} and {r.n_words for r in found if r.doc_id == 6} == {1}
    assert anchors.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_spans_equal_brute_force(spark, prose):
    rows = [*prose, (200, "same " * 170), (201, "u " + prose[4][1] + " v"), (202, None)]
    want = {d: {i for i, x in enumerate(g) if x} for d, (_, g) in _removed(rows, 50).items() if any(g)}
    found = defaultdict(set)
    for r in suffixes.repeated_spans(frame(spark, rows)).collect():
        assert r.keep_id <= r.doc_id and not found[r.doc_id] & set(range(r.start, r.start + r.n_words))
        found[r.doc_id] |= set(range(r.start, r.start + r.n_words))
    assert dict(found) == want


def test_suffix_odd_rows(spark):
    assert {r.doc_id for r in suffixes.repeated_spans(frame(spark, ODD)).collect()} == {7}
    assert suffixes.repeated_spans(frame(spark, [])).count() == 0


# --- packing


def test_packing_keeps_all_constraints(spark, prose):
    rows = [(d, t, "en", "hot" if d % 3 else f"s{d % 7}") for d, t in prose] + [(900, "w " * 1000, "en", "long"), (901, None, "en", None), (902, "", "en", None)]
    docs = frame(spark, rows)
    found = packing.packed(docs, capacity=200, shard_rows=40, lanes=1).collect()
    source = {d: s for d, _, _, s in rows}
    words = defaultdict(int)
    bins = defaultdict(list)
    for r in found:
        words[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert words == {d: len(WORD.findall(t or "")) for d, t, *_ in rows}
    for held in bins.values():
        assert sum(r.n_words for r in held) <= 200
        named = [source[r.doc_id] for r in held if source[r.doc_id]]
        assert len(named) == len(set(named))
        line = sorted((r.bin_offset, r.n_words) for r in held if r.n_words)
        assert all(a + n == b for (a, n), (b, _) in zip(line, line[1:])) and (not line or line[0][0] == 0)


def test_best_fit_takes_the_tightest_compatible_bin():
    bins = packing.Bins(10)
    assert [bins.place(6, 1, 1), bins.place(7, 2, 2), bins.place(3, 4, 3), bins.place(3, 4, 4)] == [0, 1, 1, 0]
    bins = packing.Bins(10)
    assert [bins.place(6, 1, 1), bins.place(7, 2, 2)] == [0, 1]
    assert bins.place(3, 2, 3) == 0  # the tightest holds its source
    assert bins.place(3, 4, 2) == 2  # the only bin with room holds its cluster


def test_packing_odd_rows(spark):
    found = packing.packed(frame(spark, ODD)).collect()
    assert {r.doc_id for r in found} == {d for d, _ in ODD}
    assert len({r.bin_id for r in found if r.doc_id in (4, 5)}) == 3  # copies never share a bin
    assert packing.packed(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.packed(frame(spark, ODD), capacity=0)


# --- search


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)], 0) for i in range(300)]
    rows += [(300 + i, rows[5][1], 0) for i in range(30)] + [(400, None, 0), (401, [], 0), (None, rows[0][1], 0), (402, [float("nan")] * 24, 0)]
    bits = {i: [x > 0 for x in v] + [False] * (24 - len(v)) for i, v, _ in rows if i is not None and v is not None}
    asked = [i for i in bits if i % 100 == 0 or i == 5]
    table = _vectors(spark, rows)
    found = defaultdict(list)
    for r in hamming.top_k(table, table.filter("vec_id % 100 = 0 or vec_id = 5"), 7).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.distance, r.vec_id))
    want = {q: sorted((sum(a != b for a, b in zip(bits[q], bits[i])), i) for i in bits)[:7] for q in asked}
    assert dict(found) == want


def test_search_small_tables(spark):
    few = _vectors(spark, [(0, [1.0, -1.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0)])
    assert [(r.vec_id, r.distance) for r in hamming.top_k(few, few.filter("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 0), (1, 1), (1, 1)]
    none = _vectors(spark, [])
    assert hamming.top_k(none, none, 5).count() == 0


# --- registered queries and the pipeline


def test_queries_have_the_contracted_columns(spark):
    want = {
        "op1": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"}, "op2": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
        "op3": {"doc_id", "held_out", "score", "predicted"}, "op4": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
        "op5": {"doc_id", "n_shingles", "component_id", "kept"}, "op6": {"doc_id", "held_out", "lang_pred", "score"},
        "op10": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    }
    total = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, build in queries.QUERIES.items():
        df = build(spark, SMALL)
        assert want.get(name.split("_")[0], set()) <= set(df.columns), name
        if name.split("_")[0] in want:
            assert df.count() == total, name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            assert ids == set(text)
        if name == "exact_dedup":
            first = {}
            for d in sorted(text):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[d]), d)
            assert ids == set(first.values())
            left = [(d, text[d]) for d in sorted(ids)]
        if name == "near_dedup":
            assert ids == {d for d, _, _, kept in _classes(left, cp.NEAR) if kept}
        if name == "pii":
            for r in docs.collect():
                base, added = private.all_spans(text[r.doc_id])
                assert r.text == private.masked(text[r.doc_id], base + added) and r.n_chars == len(r.text)
    packed = cp.run(spark, SMALL)
    assert {r.doc_id for r in packed.collect()} == ids
