"""Words of repeated passages: what the difference-cover and the suffix-array operators share once they have candidates.

A candidate window is a run of ``window`` words that an anchor search could not rule out. Windows next to each other whose
least inner hash stands at the same word form a unit, whose extent depends on the words alone; so copies of a passage give
equal units except at its ends. Equal units are settled by one grouping; only windows of first units that share their least
inner hash with another first unit are compared one by one. A window that does not start first is covered, and every word
under a covered window is removed. A window's first start always lies in a first unit, so the outcome equals comparing all
windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored
from .words import mixed, runs, signed, slices, split_words

INNER = 8  # words of the inner hashes that bound units
SECOND = 0x51ED270B


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``rid, doc_id, text``: ``rid`` tells rows apart that share an id; rows equal in both are one document."""
    return docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("text"))


def minimisers(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` consecutive values the position of its least one, the last of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(n + width - 1)
    reach = 1
    while reach < width:  # windows of doubling width; a last overlap fills the rest
        step = min(reach, width - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[left] < values[right], left, right)
        reach += step
    return best


def units(candidates: DataFrame, window: int, reach: int) -> DataFrame:
    """``(h1, h2, m, rid, doc_id, start, n)`` from ``rid, doc_id, text, marks``: the units of candidate windows.

    ``marks`` are word positions; windows that hold a mark not further than ``reach`` words from their start are candidates.
    ``m`` is the least inner hash of all windows of the unit: units that share a window share it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            hashes = words.hashes()
            marks = batch.column("marks")
            out = []
            for i in range(batch.num_rows):
                own = hashes[words.first[i] : words.first[i + 1]]
                total = len(own) - window + 1
                at = np.unique(np.asarray(marks[i].values.to_numpy(zero_copy_only=False), np.int64)) if marks[i].is_valid else []
                if total <= 0 or not len(at):
                    continue
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, np.clip(at - reach, 0, total), 1)
                np.add.at(edge, np.clip(at + 1, 0, total), -1)
                allowed = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if not len(allowed):
                    continue
                inner = runs(own, INNER)
                picked = minimisers(inner, window - INNER + 1)[allowed]
                fresh = np.ones(len(allowed), bool)
                fresh[1:] = (allowed[1:] != allowed[:-1] + 1) | (picked[1:] != picked[:-1])
                heads = np.flatnonzero(fresh)
                number = np.diff(np.append(heads, len(allowed)))
                place = mixed((np.arange(len(allowed)) - np.repeat(heads, number)).astype(np.uint64) + np.uint64(1))
                one = np.add.reduceat(mixed(runs(own, window)[allowed] ^ place), heads)
                two = np.add.reduceat(mixed(runs(own, window, SECOND)[allowed] ^ place), heads)
                out.append((one, two, inner[picked[heads]], np.full(len(heads), i), allowed[heads], number))
            if out:
                one, two, least, rows, starts, counts = map(np.concatenate, zip(*out))
                index = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [signed(one), signed(two), signed(least), batch.column("rid").take(index), batch.column("doc_id").take(index),
                     pa.array(starts.astype(np.int32)), pa.array(counts.astype(np.int32))],
                    ["h1", "h2", "m", "rid", "doc_id", "start", "n"],
                )

    kind = candidates.schema["doc_id"].dataType.simpleString()
    return candidates.select("rid", "doc_id", "text", "marks").mapInArrow(run, f"h1 long, h2 long, m long, rid long, doc_id {kind}, start int, n int")


def windows(rows: DataFrame, window: int) -> DataFrame:
    """``(w1, w2, rid, doc_id, start)``: every window of the units in ``spans`` (structs of start and n) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            hashes = words.hashes()
            spans = batch.column("spans")
            out = []
            for i in range(batch.num_rows):
                own = hashes[words.first[i] : words.first[i + 1]]
                begin, number = _spans(spans[i])
                at = np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())
                out.append((runs(own, window)[at], runs(own, window, SECOND)[at], np.full(len(at), i), at))
            if out:
                one, two, who, at = map(np.concatenate, zip(*out))
                index = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [signed(one), signed(two), batch.column("rid").take(index), batch.column("doc_id").take(index), pa.array(at.astype(np.int32))],
                    ["w1", "w2", "rid", "doc_id", "start"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("rid", "doc_id", "text", "spans").mapInArrow(run, f"w1 long, w2 long, rid long, doc_id {kind}, start int")


def _spans(value: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(value.values.field(f).to_numpy(zero_copy_only=False), np.int64) for f in ("start", "n"))


def order() -> Column:
    """The order of starts: smaller id first, absent ids last, then position."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid", "start")


def covered(rows: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """``(rid, start, n, keep)``: runs of windows that start earlier elsewhere; ``keep`` is the id of the earlier start.

    ``found`` are the stored units of ``rows``.
    """
    first = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid", "start", "n", "m")
    leaders = stored(found.groupBy("h1", "h2").agg(F.min(first).alias("lead"), F.count("*").alias("times")))
    led = found.select("h1", "h2", "rid", "start", "n").join(leaders.filter("times > 1"), ["h1", "h2"])
    later = led.filter((F.col("rid") != F.col("lead.rid")) | (F.col("start") != F.col("lead.start"))).select("rid", "start", "n", F.col("lead.doc_id").alias("keep"))
    # First units that share their least inner hash with other first units may share windows with them.
    single = leaders.select(F.col("lead.m").alias("m"), F.col("lead.rid").alias("rid"), F.col("lead.start").alias("start"), F.col("lead.n").alias("n"))
    contested = single.groupBy("m").agg(F.count("*").alias("times")).filter("times > 1").select("m")
    spans = single.join(contested, "m").groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    each = stored(windows(rows.join(stored(spans), "rid"), window))
    initial = each.groupBy("w1", "w2").agg(F.min(order()).alias("lead"), F.count("*").alias("times")).filter("times > 1").drop("times")
    again = each.join(initial, ["w1", "w2"]).filter((F.col("rid") != F.col("lead.rid")) | (F.col("start") != F.col("lead.start")))
    return later.unionByName(again.select("rid", "start", F.lit(1).alias("n"), F.col("lead.doc_id").alias("keep")))


def kept_words(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` from ``doc_id, text, cuts`` (structs of start and n)."""
    import hashlib

    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            cuts = batch.column("cuts")
            total, removed, sha, plain = [], [], [], []
            for i in range(batch.num_rows):
                codes = words.codes[words.first[i] : words.first[i + 1]]
                stay = np.ones(len(codes), bool)
                if cuts[i].is_valid and len(cuts[i]):
                    edge = np.zeros(len(codes) + 1, np.int64)
                    starts, number = _spans(cuts[i])
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + number + window - 1, -1)
                    stay = np.cumsum(edge[:-1]) <= 0
                text = " ".join(words.vocabulary.take(pa.array(codes[stay])).to_pylist())
                total.append(len(codes))
                removed.append(int(len(codes) - stay.sum()))
                sha.append(hashlib.sha256(text.encode()).hexdigest())
                plain.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return rows.select("doc_id", "text", "cuts").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
