"""Byte-level BPE, the prefix trie of conversations and periodic runs, against the library and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from fractions import Fraction

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from daybill.llm import bytepairs, periods, prefixes, queries  # noqa: E402
from daybill.session import ship  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(value: str | bytes) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def documents(spark, rows, extra=True):
    """Documents with further columns whose names an operator may use itself."""
    ship(spark)
    clash = "block string, bucket long, words long, codes string, ids string, runs long, segment long"
    return spark.createDataFrame([(*r, *(["x", 1, 2, "y", "z", 3, 4] if extra else [])) for r in rows], "doc_id long, text string" + (", " + clash if extra else ""))


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepairs.ranks_of(queries.public_model("byte_bpe_50k.tiktoken")), special_tokens={})


ODD = ["", " ", "  ", "\n", " \n x", "a", "I've we'll 'tis", "<|endoftext|>", "é漢😀\u0000", "\x1c\x1d a\x85b", "１２３ ½ Ⅷ", "₏₏ a₏b 1\U0001e6c0 \U00016ea0x", "​᠎ 　", "word " * 3000, "ab" * 20_000, "1" * 5000, "é" * 9, "!?" * 99]


def _texts():
    rng = random.Random(5)
    alphabet = "aab eeth  \n\t'sré漢😀0.,-\u0000  １"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(300)]


def test_byte_words_match_the_library(library):
    merger, splitter = bytepairs.Merger(bytepairs.ranks_of(queries.public_model("byte_bpe_50k.tiktoken"))), bytepairs.Splitter(public_tokenizers.PATTERN)
    for text in _texts():
        words = splitter.split(text)
        assert "".join(words) == text
        assert [i for w in words for i in merger.merge(w.encode())] == library.encode_ordinary(text), text[:80]


@pytest.mark.parametrize("block", [200, bytepairs.BLOCK])
def test_byte_rows(spark, library, monkeypatch, block):
    monkeypatch.setattr(bytepairs, "BLOCK", block)  # workers are forked before; the driver's value rules the small form below
    rows = [(i, t) for i, t in enumerate(_texts())] + [(7, None), (None, "a b"), (5, "a"), (5, "a")]
    docs = documents(spark, rows)
    found = bytepairs.encoded(docs, queries.public_model("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True).collect()
    expected = sorted((str(d), tuple(library.encode_ordinary(t or "")), t or "") for d, t in rows)
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in found) == expected
    for r in found:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(r.ids), sha(struct.pack(f"<{len(r.ids)}I", *r.ids)), sha(r.decoded))


def test_byte_empty_table(spark):
    found = bytepairs.encoded(documents(spark, []), queries.public_model("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and found.count() == 0


def test_byte_query(spark, library):
    found = {r.doc_id: r for r in queries.QUERIES["op13_byte_bpe"](spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(found) == len(texts)
    for r in texts:
        ids = library.encode_ordinary(r.text or "")
        own = found[r.doc_id]
        assert (own.n_tokens, own.ids_sha256, own.decoded_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode_bytes(ids)))


# --- prefix trie


def _trie(rows):
    """All nodes by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", prefixes.hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items())


def _found(frame):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.select(*columns).collect())


def _conversations(spark, rows):
    ship(spark)
    return spark.createDataFrame([(*r, 9, b"k", 1) for r in rows], "conv_id long, turn long, role string, text string, block long, key binary, depth long")


@pytest.mark.parametrize("cells", [1, 7, 40, prefixes.CELLS])
def test_trie_against_brute_force(spark, cells):
    rng = random.Random(cells)
    rows = []
    for c in range(90, 460):
        deep = rng.choice([0, 1, 1, 2, 3, 4, 9]) if c % 3 else 1
        for turn in range(deep + 1):
            rows.append((c, turn if rng.random() > 0.02 else None, rng.choice(["user", "user", None]), "hello" if c % 3 == 0 else rng.choice(["a", "bb", "", "é😀", None])))
    rows += [(500, 0, "user", "x"), (500, 0, "user", "x"), (500, 0, "bot", "x"), (None, 1, "user", "x")]
    assert _found(prefixes.prefix_trie(_conversations(spark, rows), cells)) == _trie(rows)


def test_trie_odd_tables(spark):
    assert _found(prefixes.prefix_trie(_conversations(spark, []))) == []
    lone = [(1, None, None, None)]
    assert _found(prefixes.prefix_trie(_conversations(spark, lone))) == _trie(lone)
    deep = [(100, i, "user", "z" * (i % 3)) for i in range(300)] + [(c, i, "user", "z" * (i % 3)) for c in (200, 300) for i in range(40)]
    assert _found(prefixes.prefix_trie(_conversations(spark, deep), 150)) == _trie(deep)


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _found(queries.QUERIES["op11_prefix_trie"](spark, SMALL)) == _trie(rows)


# --- periodic runs


def _words(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def _runs(words):
    """All runs by comparing words at every lag; a stretch with a smaller period is not one of this lag."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _expected(doc_id, text):
    words = _words(doc_id, text)
    found = _runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    return (len(found), *best, best[1] * 1000 // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def _periodic_rows():
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "b " * 24), (5, "b " * 24), (6, "b " * 23), (None, "x y " * 40), (7, "z" * 9000)]
    for i in range(10, 260):
        words = [rng.choice("abcde") if i % 2 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            q = rng.choice([1, 2, 3, 5, 7, 8, 9, 16, 17])
            period = [rng.choice("ab") if rng.random() < 0.5 else f"v{rng.randrange(9)}" for _ in range(q)]
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = [period[k % q] for k in range(rng.randrange(2 * q, 6 * q + 30))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(words)))
    return rows


def test_runs_against_brute_force(spark):
    rows = _periodic_rows()
    found = sorted(periods.detected(documents(spark, rows), whole=True).collect(), key=lambda r: (str(r.doc_id), r.runs_sha256))
    expected = sorted(((d, *_expected(d, t)) for d, t in rows), key=lambda r: (str(r[0]), r[6]))
    assert [tuple(r)[:8] for r in found] == expected
    assert sum(r.n_runs for r in found) > 100
    assert any(r.n_runs and sha(r.collapsed) == r.collapsed_sha256 and len(r.runs) == r.n_runs for r in found)


def test_runs_of_long_texts_and_no_rows(spark):
    import numpy as np

    assert periods.detected(documents(spark, [])).count() == 0
    codes = np.concatenate([np.arange(5000) % 701, np.arange(300_000) % 100_000 + 1000])
    found = list(zip(*(a.tolist() for a in periods.runs(codes, np.array([0, len(codes)])))))
    assert found == [(0, 5000, 701), (5000, 300_000, 100_000)]


def test_splitting_does_not_change_the_runs(monkeypatch):
    from daybill.llm.words import split_words
    import pyarrow as pa

    words = split_words(pa.array([t for _, t in _periodic_rows()]))
    split = [a.tolist() for a in periods.runs(words.codes, words.first)]
    monkeypatch.setattr(periods, "ROUNDS", 0)
    assert [a.tolist() for a in periods.runs(words.codes, words.first)] == split


def test_runs_query(spark):
    found = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        if len(r.text or "") < 4000:
            assert found[r.doc_id] == _expected(r.doc_id, r.text)
