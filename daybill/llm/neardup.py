"""Near-duplicate classes by one-permutation hashing.

A text's set is its distinct 5-word shingles. One hash per shingle is cut into ``BINS`` bins of which each keeps its least
value; an empty bin takes the value of a bin drawn for it (optimal densification). Five bins make a band, and equal bands
put texts into a bucket. Texts with equal sets are one node throughout, so copies never meet each other.

In every bucket each member is paired with one centre, a star, and pairs are confirmed on the full sets. Members whose
classes still differ after that are settled without loss: among them an exact prefix join (the rarest shingles of both
sides, with size and position bounds) yields every pair that can reach the threshold, and those are confirmed too.
A pair at 85 percent misses all 40 bands with probability 7e-11, one at 80 percent with 1.3e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .words import mixed, runs, signed, slices, split_words

SHINGLE, BANDS, ROWS = 5, 40, 5
BINS = BANDS * ROWS
NEED = 85  # percent of the union, unless a caller asks for another share
_EDGES = np.array([-(-(i << 64) // BINS) for i in range(BINS)], np.uint64)
_BIN = np.arange(BINS, dtype=np.uint64)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted set of a text's shingle hashes; a shorter text is one shingle, one without words none."""
    if not len(hashes):
        return hashes
    return np.unique(runs(hashes, SHINGLE) if len(hashes) >= SHINGLE else mixed(runs(hashes, len(hashes)) ^ np.uint64(len(hashes))))


def signature(own: np.ndarray) -> np.ndarray:
    """Least value of every bin, empty bins filled from drawn ones; ``own`` is sorted and not empty."""
    at = np.searchsorted(own, _EDGES)
    filled = at < np.append(at[1:], len(own))
    out = own[np.minimum(at, len(own) - 1)]
    empty = np.flatnonzero(~filled)
    if filled.sum() == 1:
        out[empty] = out[filled][0]
        return out
    attempt = 1
    while len(empty):
        drawn = (mixed(_BIN[empty] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        good = filled[drawn]
        out[empty[good]] = out[drawn[good]]
        empty = empty[~good]
        attempt += 1
    return out


def bands(sign: np.ndarray) -> np.ndarray:
    """A hash of every band and its number."""
    grid = sign.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + grid[:, i])
    return total


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``rid, doc_id, n_shingles, node, bands`` per row; ``node`` (16 bytes of the set's digest) is null for an empty set."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            hashes = words.hashes(fold=True)
            sizes, nodes, lists = [], [], []
            for i in range(batch.num_rows):
                own = shingles(hashes[words.first[i] : words.first[i + 1]])
                sizes.append(len(own))
                nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                lists.append(bands(signature(own)).view(np.int64) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(lists, pa.list_(pa.int64()))],
                ["rid", "doc_id", "n_shingles", "node", "bands"],
            )

    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, n_shingles long, node binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(node, n, own)`` of the wanted ``(rid, node)``, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            hashes = words.hashes(fold=True)
            own = [shingles(hashes[words.first[i] : words.first[i + 1]]).view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(text).alias("text")).join(wanted, "rid")
    return rows.select("node", "text").mapInArrow(run, "node binary, own array<long>").dropDuplicates(["node"]).select("node", F.size("own").alias("n"), "own")


def confirmed(pairs: DataFrame, sets: DataFrame, need: int = NEED) -> DataFrame:
    """The pairs ``(a, b)`` whose sets share ``need`` percent of their union or more."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("own").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("own").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b").filter(_sizes(F.col("na"), F.col("nb"), need))
    both = F.size(F.array_intersect("sa", "sb"))
    return sized.withColumn("both", both).filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * need).select("a", "b")


def _sizes(a: Column, b: Column, need: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * need


def labelled(links: DataFrame) -> DataFrame:
    """``(node, label)``: the least node each linked node reaches. Links are read again every round, so they are stored."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        spread = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.join(spread, "node").join(jump, "label").withColumn("next", F.least("label", "near", "far"))
        following = stored(step.select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
        if following.filter("moved").isEmpty():
            return labels
        labels = following.drop("moved")


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``: in every bucket the least node with every other; at most one pair a member and band."""
    centres = members.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return members.join(centres, "band").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(node, label)`` of members other than the centre in buckets where these are of several classes."""
    known = members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    centres = known.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).filter("n > 2").drop("n")
    others = known.join(centres, "band").filter("node <> centre").select("band", "node", "label")
    mixed_ = others.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("band")
    return others.join(mixed_, "band").select("node", "label").distinct()


def prefix_pairs(rest: DataFrame, sets: DataFrame, need: int = NEED) -> DataFrame:
    """Distinct ``(a, b)`` of different classes that can reach the threshold.

    Two such sets share a shingle within the first ``n - ceil(n need / 100) + 1`` of both in any common order; the order is rarest
    first. The overlap still possible behind the first shared shingles bounds the rest.
    """
    held = sets.join(rest, "node").select("node", "label", "n", F.explode("own").alias("s"))
    often = held.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    # A shingle that no other member has can't be shared, but it stands before all others in the order.
    common = held.join(often, "s")
    alone = common.groupBy("node").agg(F.count("*").alias("shared"))
    ranked = common.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("df", "s"))).join(alone, "node")
    placed = ranked.withColumn("at", F.col("n") - F.col("shared") + F.col("i"))
    own, length = Window.partitionBy("node"), F.col("n") - F.ceil(F.col("n") * need / 100) + 1
    prefix = placed.filter(F.col("at") <= length).select(
        "s", "node", "label", "n", "at", (F.col("n") - length).alias("rest"), F.collect_list("s").over(own).alias("all"),
        F.collect_list("s").over(own.orderBy("df", "s").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
    )
    a, b = prefix.alias("a"), prefix.alias("b")
    least_both = F.ceil((F.col("a.n") + F.col("b.n")) * need / (100 + need))
    possible = 1 + F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    alike = (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & _sizes(F.col("a.n"), F.col("b.n"), need)
    # A pair is taken at its first shared shingle only. Of the side whose prefix ends first all shared shingles of the prefix
    # are in the other's prefix, so what both prefixes share and the longer rest bound the overlap.
    first = ~F.arrays_overlap("a.before", "b.before")
    enough = F.size(F.array_intersect("a.all", "b.all")) + F.greatest("a.rest", "b.rest") >= least_both
    return a.join(b, (F.col("a.s") == F.col("b.s")) & alike & (possible >= least_both) & first & enough).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b")
    )


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", need: int = NEED) -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept`` and ``rid``; texts link that share ``need`` percent or more.

    ``component_id`` is the least id among the texts that links reach, the row's own included; null ids count as largest. A
    text without words is linked with nothing. Repeated rows are copies and share a class; all rows that bear its least id
    are kept. An empty table gives no rows; other columns are ignored.
    """
    rows = stored(sketches(docs, text, key))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("least"))
    # Copies have equal bands: one row of each node carries them.
    lead = rows.join(nodes.select("node", "rid"), ["node", "rid"]).select("node", "bands").dropDuplicates(["node"])
    every = lead.select("node", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("times")).filter("times > 1").select("band")
    members = stored(every.join(shared, "band").select("band", "node"))
    pairs = stored(star_pairs(members))
    touched = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = stored(full_sets(docs, nodes.select("node", "rid").join(touched, "node"), text, key))
    links = stored(confirmed(pairs, sets, need))
    rest = stored(unsettled(members, labelled(links)))
    links = stored(links.unionByName(confirmed(prefix_pairs(rest, sets, need), sets, need)).distinct())
    final = labelled(links).join(nodes.select("node", "least"), "node")
    least = final.groupBy("label").agg(F.min("least").alias("component"))
    reached = final.join(least, "label").select("node", "component")
    own = nodes.select("node", "least").join(reached, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    return rows.drop("bands").join(own, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"), "rid"
    )


def drop_near(docs: DataFrame, text: str = "text", key: str = "doc_id", need: int = NEED) -> DataFrame:
    """The rows, with their columns, that stand for their class: the one of least id; repeated rows with that id all stay."""
    gone = classes(docs, text, key, need).filter("not kept").select("rid").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), whole)
    return rows.join(gone, "rid", "left_anti").select("whole.*")
