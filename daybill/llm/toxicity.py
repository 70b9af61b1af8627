"""Toxicity by a counterfactual-regularised classifier.

A text is the set of its features: words and marked 4-grams of words, those kept whose share among toxic and other labelled
texts differs clearly. A logistic model is fitted on a bounded sample of labelled rows. Labelled sentences that mention a
group are paired with the same sentence about another group or about people in general, and the squared change of score
over each pair is a penalty: a mention alone must not move the score, so neutral mentions are not false alarms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .store import stored
from .words import signed, slices, split_words

SAMPLE_ROWS = 20_000  # the bound on the labelled rows that features and weights are learnt from
FEATURES, LEAST_TEXTS, LEAST_Z = 4096, 3, 4.5
SWAP_PENALTY, SHRINK, STEPS = 20.0, 0.3, 400
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]+")

# Terms for groups of people; a term is swapped for the others of its line.
IDENTITIES = [
    "women men people", "woman man person", "girls boys children", "gay lesbian straight bisexual transgender", "black white asian latino",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists", "immigrants refugees foreigners locals",
    "disabled deaf blind elderly young", "american mexican chinese indian african german french spanish",
    "frauen männer menschen", "schwarze weiße", "muslime christen juden", "femmes hommes gens", "noirs blancs", "musulmans chrétiens juifs",
    "mujeres hombres gente", "negros blancos", "musulmanes cristianos judíos",
]
SWAPS = {term: [o for o in line.split() if o != term] for line in IDENTITIES for term in line.split()}


def features(word: str) -> set[int]:
    """Hashes of a raw word's features: its letter runs and their 4-grams between marks."""
    out = set()
    for run in LETTERS.findall(word.lower()):
        out.add(xxhash.xxh3_64_intdigest("w:" + run))
        marked = f"^{run}$"
        out.update(xxhash.xxh3_64_intdigest("g:" + marked[i : i + 4]) for i in range(len(marked) - 3))
    return out


def _labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str) -> DataFrame:
    """``(text, toxic)`` of labelled rows that are not held out, at most about ``SAMPLE_ROWS``, chosen by a hash of the id."""
    marked = labels.filter(~held_out(key, 3, 1) & F.col(label).isNotNull() & F.col(key).isNotNull())
    marked = marked.groupBy(F.col(key).alias("_key")).agg(F.max((F.col(label) == 1).cast("int")).alias("toxic"))
    total = marked.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    chosen = marked.filter(F.xxhash64("_key") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1)))
    sampled = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_key")
    return stored(sampled.select("text", "toxic"))  # the ids are as bounded as the sample, so no text is shuffled


class _Index:
    """Selected features of words, remembered by word."""

    def __init__(self, hashes: np.ndarray):
        self.place = {int(h): i for i, h in enumerate(hashes)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = tuple(self.place[f] for f in features(word) if f in self.place)
        return found

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of text number and feature number."""
        words = split_words(texts)
        lists = [self.of(w) for w in words.vocabulary.to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.array([f for x in lists for f in x], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
        hit = np.flatnonzero(sizes[words.codes] > 0) if len(words.codes) else np.zeros(0, np.int64)
        codes, who = words.codes[hit], owner[hit]
        both = np.unique(np.stack([who, codes]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
        number = sizes[both[1]] if both.size else np.zeros(0, np.int64)
        who = np.repeat(both[0], number)
        inner = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        what = flat[np.repeat(begin[both[1]], number) + inner] if len(number) else np.zeros(0, np.int64)
        pairs = np.unique(who * max(1, len(self.place)) + what)
        return pairs // max(1, len(self.place)), pairs % max(1, len(self.place))


@dataclass(frozen=True)
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        who, what = _index(self.hashes).rows(texts)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(who, self.weights[what], len(texts)), -30, 30)))


_INDEXES: dict[int, _Index] = {}


def _index(hashes: np.ndarray) -> _Index:
    """One index a worker process, kept from task to task."""
    key = xxhash.xxh3_64_intdigest(hashes.tobytes())
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = _Index(hashes)
    return _INDEXES[key]


def select_features(rows: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Hashes of the features whose share differs most clearly between the classes; at most ``most`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            toxic = batch.column("toxic").to_numpy() == 1
            words = split_words(batch.column("text"))
            own = [np.fromiter(features(w), np.uint64) for w in words.vocabulary.to_pylist()]
            found: list[list[np.ndarray]] = [[], []]
            for i in range(batch.num_rows):
                codes = np.unique(words.codes[words.first[i] : words.first[i + 1]])
                if len(codes):
                    found[int(toxic[i])].append(np.unique(np.concatenate([own[c] for c in codes.tolist()])))
            for label in (0, 1):
                if found[label]:
                    hashes, times = np.unique(np.concatenate(found[label]), return_counts=True)
                    zeros = np.zeros(len(times), np.int64)
                    yield pa.RecordBatch.from_arrays([signed(hashes), pa.array(times if label else zeros), pa.array(zeros if label else times)], ["h", "pos", "neg"])

    totals = rows.agg(F.sum("toxic"), F.count("*")).first()
    n1, n = int(totals[0] or 0), int(totals[1])
    n0 = n - n1
    if not n1 or not n0:
        return np.zeros(0, np.uint64)
    counts = rows.mapInArrow(run, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / n
    z = (F.col("pos") / n1 - F.col("neg") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    clear = counts.filter(F.col("pos") + F.col("neg") >= LEAST_TEXTS).select("h", F.abs(z).alias("z")).filter(F.col("z") >= LEAST_Z)
    best = clear.orderBy(F.desc("z"), "h").limit(most).select("h").collect()
    return np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64)) if best else np.zeros(0, np.uint64)


def _examples(rows: DataFrame, hashes: np.ndarray) -> tuple[pa.Table, pa.Table]:
    """Feature numbers of every sampled text, and of all labelled sentences with their counterfactuals, in a fixed order."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            who, what = _index(hashes).rows(batch.column("text"))
            ends = np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(what.astype(np.int32)))], ["toxic", "own"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(hashes)
        for batch in slices(batches):
            a, b = [], []
            for text in batch.column("text").to_pylist():
                low = text.lower()
                if not any(term in low for term in SWAPS):
                    continue
                for sentence in SENTENCES.findall(low):
                    words = sentence.split()
                    for at, word in enumerate(words):
                        for other in SWAPS.get(word.strip(",;:\"'()"), ()):
                            a.append(sorted({f for w in words for f in index.of(w)}))
                            b.append(sorted({f for i, w in enumerate(words) for f in index.of(other if i == at else w)}))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

    # Both tables are bounded by the sample; equal pairs are one row with their number, and Arrow keeps them as flat arrays.
    own = rows.mapInArrow(texts, "toxic int, own array<int>").orderBy("toxic", "own").toArrow()
    swapped = rows.mapInArrow(pairs, "a array<int>, b array<int>").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).orderBy("a", "b").toArrow()
    return own, swapped


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """The model of the bounded sample. Without both classes it scores the share of toxic rows for every text."""
    rows = _labelled(docs, labels, text, key, label)
    hashes = select_features(rows)
    own, swapped = _examples(rows, hashes)
    y = own.column("toxic").to_numpy().astype(float)
    base = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0
    bias = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
    if not len(hashes):
        return Model(hashes, np.zeros(0), bias)

    def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
        return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(lists).to_numpy().astype(np.int64)

    who, what = flat(own.column("own"))
    left, right = flat(swapped.column("a")), flat(swapped.column("b"))
    times = swapped.column("n").to_numpy().astype(float)
    size = len(hashes)
    w, b = np.zeros(size), bias
    step, past, past_b = np.zeros(size), np.full(size, 1e-8), 1e-8
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    weight = np.minimum(weight, 4.0)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(STEPS):
        p = sigma(b + np.bincount(who, w[what], len(y)))
        error = weight * (p - y) / len(y)
        slope = np.bincount(what, error[who], size) + SHRINK * w / len(y)
        slope_b = error.sum()
        if len(times):
            n = len(times)
            s, t = sigma(b + np.bincount(left[0], w[left[1]], n)), sigma(b + np.bincount(right[0], w[right[1]], n))
            pull = 2 * SWAP_PENALTY * (s - t) * times / times.sum()
            up, down = pull * s * (1 - s), pull * t * (1 - t)
            slope += np.bincount(left[1], up[left[0]], size) - np.bincount(right[1], down[right[0]], size)
            slope_b += up.sum() - down.sum()
        past += slope**2
        past_b += slope_b**2
        step = 0.5 * slope / np.sqrt(past)
        w -= step
        b -= 0.5 * slope_b / np.sqrt(past_b)
    return Model(hashes, w, float(b))


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row ``doc_id, score``; a null text counts as empty. Rows are independent, extra columns ignored."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def predicted(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, one each, also repeated ones and empty texts."""
    model = fit(docs, labels, text, key, label)
    return scored(docs, model, text, key).select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
