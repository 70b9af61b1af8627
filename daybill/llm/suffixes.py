"""Repeated passages by a sparse suffix array.

Of every 43 consecutive 8-word starts the one with the least hash is retained, so any passage of 50 words retains at least
one of its suffixes, chosen by content alone. A retained suffix is keyed by hashes of its first 8, 16, 32 and 64 words: in
that order suffixes with a longer common beginning stand closer. The suffixes are sorted across the cluster by range and each
is compared with its neighbours; where one begins alike, the windows around the suffix are extended left and right and
compared (see ``repeats``). The order ends with row and position, so a passage shared by many texts spreads over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import INNER, covered, keyed, minimisers, units
from .store import stored
from .words import mixed, runs, signed, slices, split_words

WINDOW = 50
DEPTHS = (8, 16, 32, 64)


def suffix_rows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(k1, k2, k3, k4, rid, pos)`` for every retained suffix of a text with at least ``window`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            hashes = words.hashes()
            keys, owner, places = [], [], []
            for i in range(batch.num_rows):
                own = hashes[words.first[i] : words.first[i + 1]]
                if len(own) < window:
                    continue
                at = np.unique(minimisers(runs(own, INNER), window - INNER + 1))
                longer = []
                for depth in DEPTHS:
                    value = runs(own, depth)
                    # A suffix that ends before has a key of its own rest: it shares no beginning of this depth.
                    short = mixed(np.uint64(depth) ^ mixed(at.astype(np.uint64) + np.uint64(i + 1)))
                    longer.append(np.where(at < len(value), value[np.minimum(at, len(value) - 1)], short) if len(value) else short)
                keys.append(np.stack(longer))
                owner.append(np.full(len(at), i))
                places.append(at)
            if not keys:
                continue
            k, who, pos = np.concatenate(keys, axis=1), np.concatenate(owner), np.concatenate(places)
            yield pa.RecordBatch.from_arrays(
                [*(signed(np.ascontiguousarray(row)) for row in k), batch.column("rid").take(pa.array(who)), pa.array(pos.astype(np.int32))],
                ["k1", "k2", "k3", "k4", "rid", "pos"],
            )

    return rows.select("rid", "text").mapInArrow(run, "k1 long, k2 long, k3 long, k4 long, rid long, pos int")


def neighbours(suffixes: DataFrame) -> DataFrame:
    """``(rid, pos)`` of suffixes whose first words a neighbour in the sorted order shares.

    The first and last row of a sorted partition count as shared: what follows decides exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the last row so far, not yet given out, and whether its predecessor shares its beginning
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("k1").to_numpy()
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            same[0] = held is None or key[0] == held[0]
            if held is not None and (same[0] or last):
                yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32())], ["rid", "pos"])
            shared = same[:-1] | same[1:]
            shared[-1] = False
            yield batch.select(["rid", "pos"]).filter(pa.array(shared))
            held, last = (key[-1], batch.column("rid")[-1].as_py(), batch.column("pos")[-1].as_py()), bool(same[-2])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int32())], ["rid", "pos"])

    spread = suffixes.repartitionByRange("k1", "k2", "k3", "k4", "rid", "pos").sortWithinPartitions("k1", "k2", "k3", "k4", "rid", "pos")
    return spread.mapInArrow(run, "rid long, pos int")


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """``doc_id, keep_id, start, n_words``: maximal runs of words of a row under windows that start earlier elsewhere.

    ``keep_id`` is the least id with an earlier start of a window of the run. Texts below ``window`` words and null texts
    have no span; rows equal in id and text are one document. An empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, text, key)
    # Stored first: the range partitioning reads its input twice, to sample and to deal.
    shared = stored(neighbours(stored(suffix_rows(rows, window))).groupBy("rid").agg(F.collect_list("pos").alias("marks")))
    found = stored(units(rows.join(shared, "rid"), window, window - INNER))
    cuts = covered(rows, found, window).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "n", "keep"))).alias("cuts"))
    # Runs of one text are merged in order: a run that begins behind all earlier ends opens a new span.
    end = lambda c: c["start"] + c["n"] + F.lit(window - 1)
    spans = cuts.select("rid", F.explode("cuts").alias("cut")).select("rid", F.col("cut.start").alias("start"), end(F.col("cut")).alias("end"), F.col("cut.keep").alias("keep"))
    line = Window.partitionBy("rid").orderBy("start", "end")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("fresh", F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0))
    merged = opened.withColumn("span", F.sum("fresh").over(line)).groupBy("rid", "span").agg(
        F.min("start").cast("long").alias("start"), (F.max("end") - F.min("start")).cast("long").alias("n_words"), F.min("keep").alias("keep_id")
    )
    ids = found.select("rid", "doc_id").distinct()
    return merged.join(ids, "rid").select("doc_id", "keep_id", "start", "n_words")
