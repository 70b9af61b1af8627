"""Periodic runs in word sequences: recursive frequency splitting, then a scan for lags.

A run is a stretch of consecutive words whose smallest period is q, of at least ``max(24, 3 * q)`` words, that neither
neighbour extends. Every word of a run occurs three times in it, so a word that occurs less often in its segment can't be
in a run there: it splits the segment, and the pieces are judged again, until nothing splits. Pieces of fewer than 24
words go.

Segments that survive are scanned for lags by windows of 1, 2, 4 ... words. Within a run the next equal window of at
least q words starts exactly q words later, so with windows of m words the lags from m/2 + 1 to m show as equal distances
of consecutive windows, and such a chain spans the run from end to end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .words import Words, slices, split_words

SHORTEST, REPEATS = 24, 3  # words of a run, and periods
SLICE = 1_000_000  # bytes of text worked on at a time
ROUNDS = 200  # splitting further would be slower than scanning what is left; the result is the same


def rewritten(words: Words, ids: list) -> np.ndarray:
    """Codes of the words after the rewriting of some documents: behind word a every word is repeated with period p."""
    codes = words.codes.copy()
    for i, key in enumerate(ids):
        first, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
        h = zlib.crc32(str("" if key is None else key).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            codes[first + a : first + n] = words.codes[first + a + np.arange(n - a) % p]
    return codes


def segments(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that may belong to runs, in order, and the segment of each; texts start at ``first``."""
    place = np.arange(len(codes))
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for _ in range(ROUNDS):
        if not len(place):
            break
        size = np.bincount(segment)
        key = segment * (int(codes.max()) + 1) + codes[place]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
        stays = (counts[back] >= REPEATS) & (size[segment] >= SHORTEST)
        if stays.all():
            break
        # What is left keeps its segment unless a word that went stands between.
        place, segment = place[stays], segment[stays]
        cut = np.ones(len(place), bool)
        cut[1:] = (np.diff(place) > 1) | (np.diff(segment) > 0)
        segment = np.cumsum(cut) - 1
    return place, segment


def runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``codes``), length and period of every run, by start, then period."""
    place, segment = segments(codes, first)
    found = [np.zeros((0, 3), np.int64)]
    _, rank = np.unique(codes[place], return_inverse=True)
    rank = rank.astype(np.int64)
    left = (np.searchsorted(segment, segment, "right") - np.arange(len(place))) if len(place) else place  # words up to the segment's end
    longest = int(left.max()) if len(left) else 0
    m = 1
    while m * 3 <= 2 * longest + 2:
        # rank: equal for equal windows of m words; windows that would leave their segment are out.
        valid = np.flatnonzero(left >= m)
        order = valid[np.lexsort((valid, rank[valid], segment[valid]))]
        same = (rank[order[1:]] == rank[order[:-1]]) & (segment[order[1:]] == segment[order[:-1]])
        gap = np.zeros(len(place) + 1, np.int64)
        gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
        near = np.flatnonzero((gap > m // 2) & (gap <= m))
        if len(near):
            cut = np.ones(len(near), bool)
            cut[1:] = (np.diff(near) > 1) | (gap[near[1:]] != gap[near[:-1]]) | (segment[near[1:]] != segment[near[:-1]])
            starts = near[cut]
            ends = near[np.append(np.flatnonzero(cut)[1:] - 1, len(near) - 1)]
            period = gap[starts]
            length = ends - starts + m + period
            long = length >= np.maximum(SHORTEST, REPEATS * period)
            found.append(np.stack([place[starts[long]], length[long], period[long]], 1))
        fits = np.flatnonzero(left >= 2 * m)
        pair = rank[fits] * (int(rank.max()) + 1) + rank[fits + m]
        rank = np.full(len(place), -1, np.int64)
        rank[fits] = np.unique(pair, return_inverse=True)[1]
        m *= 2
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _judged(batch: pa.RecordBatch) -> list[tuple]:
    ids = batch.column("doc_id").to_pylist()
    words = split_words(batch.column("text"))
    codes = rewritten(words, ids)
    start, length, period = runs(codes, words.first)
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    owner = np.searchsorted(words.first, start, "right") - 1
    counted = np.concatenate([[0], np.cumsum(kept)])
    texts = pa.LargeListArray.from_arrays(pa.array(counted[words.first], pa.int64()), words.vocabulary.take(pa.array(codes[kept], pa.int64())))
    collapsed = pc.binary_join(texts, pa.scalar(" ", pa.large_string())).to_pylist()
    bounds = np.searchsorted(owner, np.arange(len(ids) + 1)).tolist()
    rows = []
    for i, text in enumerate(collapsed):
        a, b = bounds[i], bounds[i + 1]
        own = list(zip((start[a:b] - words.first[i]).tolist(), length[a:b].tolist(), period[a:b].tolist()))
        best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if own else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        rows.append((len(own), *best, 1000 * best[1] // best[2] if own else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), own, text))
    return rows


def detected(docs: DataFrame, text: str = "text", key: str = "doc_id", whole: bool = False) -> DataFrame:
    """Per row its number of runs, the run of the greatest exponent and digests of all runs and of the collapsed text.

    With ``whole`` also ``runs`` (start, length, period) and ``collapsed``. Null and empty texts have no words, no runs and
    an empty collapsed text; a null id counts as the empty string in the rewriting. Rows are independent: repeated rows
    repeat, other columns are ignored whatever their names, an empty table gives no rows. Memory is one slice of texts,
    or one text that is longer.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(triple), pa.string()]
    used = len(names) if whole else 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            columns = list(zip(*_judged(batch)))
            if whole:
                columns[7] = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in columns[7]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns[:used], types))], ["doc_id", *names[:used]])

    schema = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string" if whole else ""
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
