"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text reads a document and cuts it into phrases: each phrase is the longest
run of the rest that occurs somewhere in that language's text. The language whose automaton needs the fewest phrases wins,
measured by the phrases a symbol that one half of its sample needs of the other, so that samples of any size compete.
Texts are folded to lower-case letters with one space between words and read in blocks of 256 symbols; blocks of a batch
are read side by side, so the work per symbol is one table look-up per language. A text ends its last phrase, and so does a
block, whatever the batch: results depend on the text and the labelled sample alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices

BLOCK = 256
TRAIN_SYMBOLS, EXCERPT, CELLS = 240_000, 1_000, 128  # the bound on the labelled sample: symbols in all, per text, texts a language
UNKNOWN = "und"
TIMES, REJECT = 1.5, 0.85  # a text may need so many times its language's own phrases a symbol; and never more than REJECT


def held_out(key: Column | str, folds: int, fold: int) -> Column:
    """crc32 of the key as text, modulo ``folds``, is ``fold``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(""))) % folds == fold


def sample(docs: DataFrame, label: str, text: str, key: str, usable: Column) -> dict[str, str]:
    """Labelled text per language: of the rows in each of ``CELLS`` hash cells the one of least hash.

    Of a picked text a stretch of ``EXCERPT`` characters counts that starts where the hash says, the whole of a shorter one.
    Languages share ``TRAIN_SYMBOLS`` evenly, and so do the picked texts of a language.
    """
    own = F.xxhash64(F.col(key).cast("string"), F.col(text))
    start = 1 + F.pmod(F.xxhash64(own, F.lit(1)), F.greatest(F.length(text) - EXCERPT, F.lit(0)) + 1)
    rows = docs.filter(usable & F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"), F.pmod(own, F.lit(CELLS)).alias("cell"), own.alias("own"), F.col(text).substr(start.cast("int"), F.lit(EXCERPT)).alias("excerpt")
    )
    picked = rows.groupBy("label", "cell").agg(F.min(F.struct("own", "excerpt")).alias("best"))
    found: dict[str, list[str]] = {}
    for row in picked.select("label", "cell", "best.excerpt").orderBy("label", "cell").collect():  # CELLS rows a language
        found.setdefault(row["label"], []).append(row["excerpt"])
    share = TRAIN_SYMBOLS // max(1, len(found))
    return {name: " ".join(_shared(texts, share)) for name, texts in found.items()}


def _shared(texts: list[str], total: int) -> list[str]:
    """The texts cut to one length, such that they have ``total`` characters or are all whole."""
    left, each = total, 0
    for number, length in enumerate(sorted(map(len, texts))):
        each = left // (len(texts) - number)
        if length > each:
            break
        left -= length
    else:
        return texts
    return [t[:each] for t in texts]


class Folding:
    """Code points to symbols: 0 for all but letters, 1 for letters the sample lacks, then the sample's letters."""

    def __init__(self, samples: dict[str, str]):
        letters = sorted({c for t in samples.values() for c in t.lower() if c.isalpha() and ord(c) < 0x110000})
        self.size = len(letters) + 2
        self.table = np.zeros(0x110000, np.uint16)
        for cp in range(0x323B0):
            category = unicodedata.category(chr(cp))
            if category[0] == "L":
                self.table[cp] = 1
        for i, c in enumerate(letters):
            for same in {c, c.upper(), c.title()}:
                if len(same) == 1:
                    self.table[ord(same)] = i + 2

    def symbols(self, text: str) -> np.ndarray:
        """Symbols with single separators between words and none at the ends."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        coded = self.table[points]
        keep = coded > 0
        keep[1:] |= coded[:-1] > 0
        coded = coded[keep]
        if len(coded) and coded[-1] == 0:
            coded = coded[:-1]
        return coded


def automaton(text: np.ndarray, size: int) -> np.ndarray:
    """Transitions of the suffix automaton as a table; a missing one holds -1 - (the state after a restart with the symbol)."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = state
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    table = np.zeros((len(following), size), np.int32)
    restart = np.zeros(size, np.int32)
    for c, state in following[0].items():
        restart[c] = state
    table[:] = -1 - restart
    for state, edges in enumerate(following):
        for c, to in edges.items():
            table[state, c] = to
    return table


class Model:
    """``rates``: phrases a symbol that every language's sample needs of its own; counts are measured by them."""

    def __init__(self, samples: dict[str, str], rates: dict[str, float] | None = None):
        self.names = sorted(samples)
        self.rates = np.array([(rates or {}).get(n, 1.0) for n in self.names])
        self.folding = Folding(samples)
        self.tables = [automaton(self.folding.symbols(samples[n]), self.folding.size).ravel() for n in self.names]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and symbols per text."""
        coded = [self.folding.symbols(t) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        total = int(blocks.sum())
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        if not total:
            return counts, sizes
        width, pad = self.folding.size, np.iinfo(np.uint16).max
        flat = np.full(total * BLOCK, pad, np.uint16)
        at = 0
        for c, b in zip(coded, blocks.tolist()):
            flat[at : at + len(c)] = c
            at += b * BLOCK
        grid = flat.reshape(total, BLOCK)
        lengths = np.full(total, BLOCK, np.int64)
        ends = np.cumsum(blocks)[blocks > 0] - 1
        lengths[ends] = sizes[blocks > 0] - (blocks[blocks > 0] - 1) * BLOCK
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        alive = np.searchsorted(-lengths[order], -np.arange(BLOCK), side="left")
        for k, table in enumerate(self.tables):
            state, found = np.zeros(total, np.int64), np.ones(total, np.int64)  # the last phrase of a block counts
            for step in range(BLOCK):
                n = alive[step]
                if not n:
                    break
                to = table[state[:n] * width + columns[step, :n]].astype(np.int64)
                missed = to < 0
                if step:  # behind a letter that the language lacks, at the root again, a separator is a phrase too
                    missed |= (state[:n] == 0) & (columns[step, :n] == 0)
                found[:n] += missed
                state[:n] = np.where(to < 0, -1 - to, to)
            back = np.empty(total, np.int64)
            back[order] = found
            counts[:, k] = np.bincount(owner, back, len(texts)).astype(np.int64)
        return counts, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per symbol of the winner; ties go to the first name in order."""
        counts, sizes = self.phrases([t or "" for t in texts])
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        measured = counts / self.rates
        best = measured.argmin(axis=1)
        least = measured[np.arange(len(texts)), best]
        second = np.partition(measured, 1, axis=1)[:, 1] if len(self.names) > 1 else least * 2
        known = sizes > 0
        score = np.where(known, 1 - least / np.maximum(second + least, 1), 0.0)
        names = [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return names, score, np.where(known, counts[np.arange(len(texts)), best] / np.maximum(sizes, 1), 1.0)

    def parsed(self, texts: list[str | None], bounds: dict[str, float]) -> list[bool]:
        """Whether the best language reads the text within its bound; a block's last phrase is not held against a text.

        A short text may exceed the bound by a root of what it allows, the spread of such a count.
        """
        counts, sizes = self.phrases([t or "" for t in texts])
        if not self.names:
            return [False] * len(texts)
        best = (counts / self.rates).argmin(axis=1)
        excess = counts[np.arange(len(texts)), best] - -(-sizes // BLOCK)
        allowed = np.array([bounds[n] for n in self.names])[best] * sizes
        return ((sizes > 0) & (excess <= allowed + np.sqrt(allowed)) & (excess < REJECT * sizes)).tolist()


def rates_of(samples: dict[str, str]) -> dict[str, float]:
    """Per language the phrases a symbol that the second half of its sample needs of the first half.

    A small sample explains little even of its own language; measured by this rate it competes with a large one.
    """
    out = {}
    for name, text in samples.items():
        counts, sizes = Model({name: text[: len(text) // 2]}).phrases([text[len(text) // 2 :]])
        out[name] = float(counts[0, 0]) / float(sizes[0]) if sizes[0] else 1.0
    return out


def bounds_of(rates: dict[str, float], times: float = TIMES) -> dict[str, float]:
    """Per language the phrases a symbol that a text may need."""
    return {name: min(REJECT, times * rate) for name, rate in rates.items()}


_MODELS: dict[str, Model] = {}


def _model(samples: dict[str, str], rates: dict[str, float]) -> Model:
    """One model a worker process, kept from task to task."""
    key = repr(sorted(samples.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(samples, rates)
    return _MODELS[key]


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row ``doc_id, lang_pred, score, rate``; ``und`` with score 0 where the text is null or has no letter.

    ``score`` is the runner-up's share of the two fewest phrase counts; ``rate`` the winner's phrases per symbol. Rows are
    independent: repeated rows repeat, extra columns are ignored, an empty table gives no rows. Without any labelled text
    every row is ``und``.
    """
    kind, rates = docs.schema[key].dataType.simpleString(), rates_of(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples, rates)
        for batch in slices(batches, "text", 4_000_000):
            names, score, rate = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], ["doc_id", "lang_pred", "score", "rate"])

    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rate double")


def predicted(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learnt from the rows that are not held out."""
    samples = sample(docs, label, text, key, ~held_out(key, 4, 2))
    return identify(docs, samples, text, key).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rate")


def keep_known(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang", times: float = TIMES) -> DataFrame:
    """The rows, with their columns, whose text is in one of the learnt languages.

    Rejected are texts without a letter and texts of which the best language needs over ``times`` the phrases a symbol that
    it needs of its own labelled text: other scripts and other languages.
    """
    samples = sample(docs, label, text, key, ~held_out(key, 4, 2))
    rates = rates_of(samples)
    bounds = bounds_of(rates, times)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(samples, rates)
        for batch in slices(batches, text, 4_000_000):
            yield batch.filter(pa.array(model.parsed(batch.column(at).to_pylist(), bounds), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
