"""Prefix trie of conversations: padded turn-id matrices over range shards.

A turn's id is a 128-bit digest of role and text. Conversations are range-partitioned and sorted by their sequences of
ids, then by conv_id, so equal ones of any number spread over shards. A shard is worked on in blocks of consecutive rows:
the ids form a matrix padded behind the last turn, rows are ordered by lexsort, the changes between neighbours
accumulated by OR along a row mark where nodes start, and reduceat aggregates every depth.

Nodes that hold a block's first or last row may go on in its neighbours. They come with a digest of their path and are
recombined by it: counts add up, and what such a node adds to its ancestors is summed along the path of the first block
that has it. Only digests, never texts, are shuffled behind the first step.

A null conv_id belongs to no conversation; null roles and texts are empty; turns of one number are ordered by role, then
digest; repeated rows are turns of their own. Other columns are ignored whatever their names. A table without
conversations gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

HEADS = 6  # a conversation takes up to HEADS - 1 turns of the one its hundred starts with
CELLS = 2_000_000  # cells of a block's matrix; a longer conversation is a block of its own
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, ids, letters``: every conversation's turns in order as digests and code points of their texts."""
    own = turns.select(
        turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    own = own.select("conv_id", F.struct("turn", "role", digest.alias("id"), F.length("text").alias("letters")).alias("turn"))
    ordered = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.letters").alias("letters"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Every conversation with its first turns taken from the conversation its hundred starts with."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    most = F.lit(HEADS - 1)
    heads = own.filter(F.col("conv_id") % 100 == 0).select(
        F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("head_ids"), F.slice("letters", 1, most).alias("head_letters"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h.cast("int")).join(heads, "base", "left")

    def mended(head: str, name: str) -> Column:
        kind = own.schema[name].dataType
        return F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.array().cast(kind)), F.slice(name, F.col("h") + 1, F.size(name) + 1)).alias(name)

    return joined.select("conv_id", mended("head_ids", "ids"), mended("head_letters", "letters"))


def _rows(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of consecutive rows as (conv_id, lengths, ids, letters), the last two flat; a block's matrix has at most ``cells``."""
    held, rows, widest = [], 0, 0
    joined = lambda parts: tuple(np.concatenate(column) for column in zip(*parts))
    for batch in batches:
        ids, letters = batch.column("ids"), batch.column("letters")
        lengths = np.diff(ids.offsets.to_numpy())
        flat = np.frombuffer(b"".join(ids.flatten().to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        sizes = letters.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        convs = batch.column("conv_id").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = 0

        def part(a: int, b: int):
            return convs[a:b], lengths[a:b], flat[ends[a] : ends[b]], sizes[ends[a] : ends[b]]

        for i, length in enumerate(lengths.tolist()):
            wider = max(widest, length)
            if rows and (rows + 1) * wider > cells:
                yield joined(held + [part(at, i)])
                held, rows, wider, at = [], 0, length, i
            rows, widest = rows + 1, wider
        if at < batch.num_rows:
            held.append(part(at, batch.num_rows))
    if held:
        yield joined(held)


def _path(ids: np.ndarray) -> list[bytes]:
    """Digests of all prefixes of one sequence, the empty one first."""
    out = [b""]
    for i in ids.astype(">u8"):
        out.append(hashlib.md5(out[-1] + i.tobytes()).digest())
    return out


def _nodes(convs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, letters: np.ndarray) -> dict[str, list]:
    """All nodes of one block, as columns; those that hold its first or last row are ``edge`` nodes with the block's part only."""
    n, width = len(convs), int(lengths.max())
    known, codes = np.unique(ids, axis=0, return_inverse=True) if len(ids) else (ids, np.zeros(0, np.int64))
    matrix = np.full((n, width + 1), -1, np.int64 if len(known) > 2**31 else np.int32)
    texts = np.zeros((n, width + 1), np.int64)
    inside = np.arange(width + 1) < lengths[:, None]
    matrix[inside], texts[inside] = codes.ravel(), letters
    order = np.lexsort((convs, *matrix.T[::-1]))
    convs, lengths, matrix, texts, inside = convs[order], lengths[order], matrix[order], texts[order], inside[order]
    changed = np.ones((n, width + 1), bool)  # column d: row i leaves the node of depth d + 1 that row i - 1 is in
    changed[1:] = np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1)
    first, last = matrix[0, : lengths[0]], matrix[-1, : lengths[-1]]
    both = min(len(first), len(last))
    common = int(np.argmin(np.append(first[:both] == last[:both], False)))
    paths = [_path(known[first]), _path(known[last])] if len(known) else [[b""], [b""]]

    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of nodes below the present depth, by the row they start in
    deeper = np.zeros(n, bool)  # rows in which a node of the next depth starts that is no edge
    names = ("conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "edge", "side", "up", "key", "parent_key", "letters")
    out: dict[str, list] = {name: [] for name in names}
    held: list = []  # nodes of the depth below, which learn their parent now
    for depth in range(width, -1, -1):
        starts = np.flatnonzero(changed[:, depth - 1]) if depth else np.zeros(1, np.int64)
        stops = np.append(starts[1:], n)
        real = inside[starts, depth - 1] if depth else np.ones(1, bool)
        members = stops - starts
        smallest = np.minimum.reduceat(convs, starts)
        kids = np.add.reduceat(deeper.astype(np.int64), starts)
        below_leaves, below_saved = np.add.reduceat(leaves, starts), np.add.reduceat(saved, starts)
        ending = np.add.reduceat((lengths == depth).astype(np.int64), starts)
        size = texts[starts, depth - 1] if depth else np.zeros(1, np.int64)
        edge = (starts == 0) | (stops == n)
        whole = real & ~edge
        childless = whole & (ending == members)
        own = np.where(whole, (members - 1) * size, 0)
        # Children of this depth's nodes: rows of the depth below that are still without their parent.
        if held:
            child = np.concatenate([h for h in held])
            parent = np.searchsorted(starts, child, "right") - 1
            out["parent"] += smallest[parent].tolist()
            out["up"] += np.where(starts[parent] == 0, 0, np.where(stops[parent] == n, 1, -1)).tolist()
        held = [starts[real]] if depth else []
        pick = np.flatnonzero(real)
        out["conv_id"] += smallest[pick].tolist()
        out["depth"] += [depth] * len(pick)
        out["n_convs"] += members[pick].tolist()
        out["n_children"] += kids[pick].tolist()
        out["n_leaves"] += (below_leaves + childless)[pick].tolist()
        out["saved_tokens"] += (below_saved + own)[pick].tolist()
        out["letters"] += size[pick].tolist()
        for k in pick.tolist():
            a, count = int(starts[k]), int(ending[k])
            line = ",".join(map(str, convs[a : a + count].tolist())) if count else ""
            side = 0 if starts[k] == 0 else 1 if stops[k] == n else None
            out["edge"].append(side is not None)
            out["side"].append(side)
            out["key"].append(None if side is None else paths[side][depth])
            out["parent_key"].append(paths[side][depth - 1] if side is not None and depth else None)
            out["ends"].append(line if side is not None else hashlib.sha256(line.encode()).hexdigest() if line else NOTHING)
        leaves[starts[childless]] += 1
        saved[starts] += own
        deeper[:] = False
        deeper[starts[whole]] = True
    out["parent"].append(None)
    out["up"].append(-1)
    out["common"] = [common] * len(out["depth"])
    return out


SCHEMA = ("conv_id {0}, depth long, parent {0}, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, edge boolean, "
          "side int, up int, key binary, parent_key binary, letters long, common long, block long")


def _shards(cells: int, kind: pa.DataType):
    types = {"conv_id": kind, "parent": kind, "ends": pa.string(), "edge": pa.bool_(), "side": pa.int32(), "up": pa.int32(), "key": pa.binary(), "parent_key": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for number, block in enumerate(_rows(batches, cells)):
            columns = _nodes(*block)
            columns["block"] = [(shard << 32) + number] * len(columns["depth"])
            names = [field.split()[0] for field in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(columns[name], types.get(name, pa.int64())) for name in names], names)

    return run


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every key's lists, which come in order; only the state of one digest is held."""
    held, state, first = None, None, True
    for batch in batches:
        keys, digests = [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != held:
                if state is not None:
                    keys.append(held)
                    digests.append(state.hexdigest())
                held, state, first = key, hashlib.sha256(), True
            if text:
                state.update(text.encode() if first else b"," + text.encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def trie(conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """All nodes of ``conversations`` (conv_id, ids, letters), per node its smallest member, counts and digests.

    ``ends_sha256`` is a digest of an ordered list, so one task reads a node's ends, a text a block, and keeps none.
    """
    kind = conversations.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    dealt = conversations.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    pieces = stored(dealt.mapInArrow(_shards(cells, to_arrow_type(kind)), SCHEMA.format(kind.simpleString())))

    edges = pieces.filter("edge")
    nodes = edges.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("letters").alias("letters"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.min(F.struct("block", "side")).alias("owner"))
    more = nodes.filter("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = stored(nodes.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
                   .withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("letters")))

    # What edge nodes add to themselves and their ancestors, counted on the path of their first block.
    owned = F.col("owner") == F.struct("block", "side")
    paths = edges.select("key", "block", "side", "depth", "common").join(nodes.select("key", "owner", "leaf", "own", F.col("conv_id").alias("smallest")), "key").select(
        "key", "block", "side", "depth", "common", "smallest", F.when(owned, F.col("leaf")).otherwise(0).alias("leaf"), F.when(owned, F.col("own")).otherwise(0).alias("own"))
    along = Window.partitionBy("block", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("block")
    for name in ("leaf", "own"):
        other = F.sum(F.when(F.col("side") == 1, F.col(name)).otherwise(0)).over(across)
        paths = paths.withColumn(f"{name}_sum", F.sum(name).over(along) + F.when((F.col("side") == 0) & (F.col("depth") <= F.col("common")), other).otherwise(0))
    paths = stored(paths.select("key", "block", "side", "depth", "smallest", "leaf_sum", "own_sum"))
    sums = paths.groupBy("key").agg(F.sum("leaf_sum").alias("leaf_sum"), F.sum("own_sum").alias("own_sum"))
    digests = edges.select("key", "ends", "block").repartition("key").sortWithinPartitions("key", "block").mapInArrow(_streamed, "key binary, ends_sha256 string")
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    spread = nodes.join(sums, "key").join(digests, "key").join(parents, "parent_key", "left").withColumn("n_leaves", F.col("n_leaves") + F.col("leaf_sum")).withColumn(
        "saved_tokens", F.col("saved_tokens") + F.col("own_sum")).select(*columns)

    inner = pieces.filter("not edge").withColumnRenamed("ends", "ends_sha256")
    above = paths.select("block", F.col("side").alias("up"), (F.col("depth") + 1).alias("depth"), "smallest")
    inside = inner.filter("up < 0").withColumn("parent_conv_id", F.col("parent")).select(*columns)
    below = inner.filter("up >= 0").join(above, ["block", "up", "depth"]).withColumn("parent_conv_id", F.col("smallest")).select(*columns)
    return spread.unionByName(inside).unionByName(below)


def prefix_trie(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """The trie of all rebuilt conversations of a table ``conv_id, turn, role, text``."""
    return trie(stored(rebuilt(sequences(turns))), cells)
