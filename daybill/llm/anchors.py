"""Repeated passages by difference-cover anchors.

With the cover {0, 1, 3, 9} modulo 13 any two positions become cover positions after one common shift below 13. Two equal
runs of 20 words therefore share an equal 8-word anchor that is aligned in both, although only 4 of 13 positions are hashed.
Anchors seen more than once mark their texts; windows around marks are extended and compared (see ``repeats``).

An anchor that a task meets again is known to repeat there, so only its first row goes out under its hash and the others
under keys of their own: one very common passage never gathers in one partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .repeats import covered, keyed, kept_words, units
from .store import stored
from .words import mixed, runs, signed, slices, split_words

PERIOD, COVER = 13, (0, 1, 3, 9)  # a perfect difference cover
WINDOW = 20


def anchor_rows(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(h, rid, pos, known)`` at the cover positions of every text with at least ``window`` words."""
    span = window - PERIOD + 1
    if span < 1:
        raise ValueError("the window must be as long as the cover's period")
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            hashes = words.hashes()
            every, owner, places = [], [], []
            for i in range(batch.num_rows):
                own = hashes[words.first[i] : words.first[i + 1]]
                if len(own) < window:
                    continue
                at = np.flatnonzero(on[np.arange(len(own) - span + 1) % PERIOD])
                every.append(runs(own, span)[at])
                owner.append(np.full(len(at), i))
                places.append(at)
            if not every:
                continue
            h, who, pos = np.concatenate(every), np.concatenate(owner), np.concatenate(places)
            _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = times[inverse] > 1
            lead = np.zeros(len(h), bool)
            lead[first] = True
            salt = mixed(h ^ mixed(who.astype(np.uint64) * np.uint64(1 << 20) + pos.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [signed(np.where(lead, h, salt)), batch.column("rid").take(pa.array(who)), pa.array(pos.astype(np.int32)), pa.array(known)],
                ["h", "rid", "pos", "known"],
            )

    return rows.select("rid", "text").mapInArrow(run, "h long, rid long, pos int, known boolean")


def marks(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(rid, marks)``: positions of anchors that stand elsewhere too; an array holds one text's positions."""
    found = anchor_rows(rows, window)
    repeated = found.withColumn("times", F.count("*").over(Window.partitionBy("h"))).filter((F.col("times") > 1) | F.col("known"))
    return repeated.groupBy("rid").agg(F.collect_list("pos").alias("marks"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256, kept_text``: words under a window that starts earlier are removed.

    Earlier is a smaller id (an absent one is the largest), or the same document further up. A null text has no words; a
    text below ``window`` words loses none. Rows equal in id and text are one document and get the same result each; rows
    that share only the id are ordered by a hash of the text. An empty table gives no rows; other columns are ignored.
    """
    rows = keyed(docs, text, key)
    found = stored(units(rows.join(stored(marks(rows, window)), "rid"), window, PERIOD - 1))
    cuts = stored(covered(rows, found, window).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("cuts")))
    return kept_words(rows.join(cuts, "rid", "left"), window)
