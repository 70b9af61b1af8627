"""Best-fit packing of whole documents into training sequences, with conflicts.

Documents are dealt to shards by a hash of their row, each shard by longest first into bins of ``capacity`` words. Open bins
are ordered by residual room; each carries the set of sources and the set of duplicate clusters it holds. A document goes
into the tightest bin with room for it that has neither its source lane nor its cluster: the search starts at the least
sufficient residual and goes on to the next until a bin is compatible. A source has ``lanes`` lanes and its rows are dealt
over them by a hash, so a bin mixes sources with at most that many rows of one. A text above the capacity fills bins of its own and
only its remainder is packed. Shards hold about ``shard_rows`` rows whatever the size of the table, and only numbers reach
Python, so nothing unbounded meets in a task.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .exact import normalised

CAPACITY, SHARD_ROWS, LANES = 2048, 4000, 4


class Bins:
    """Open bins by residual room; bins of one residual and source set are kept together."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms = capacity, []
        self.by_room: dict[int, dict[int, list[int]]] = {}
        self.clusters: list[set[int]] = []

    def _put(self, room: int, sources: int, number: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = {}
            insort(self.rooms, room)
        self.by_room[room].setdefault(sources, []).append(number)

    def place(self, size: int, source: int, cluster: int) -> int:
        """The number of the tightest compatible bin, a new one if there is none. ``source`` is a bit, 0 for none."""
        for room in self.rooms[bisect_left(self.rooms, size) :]:
            for sources, numbers in self.by_room[room].items():
                if sources & source:
                    continue
                at = next((i for i, number in enumerate(numbers) if cluster not in self.clusters[number]), None)
                if at is None:
                    continue
                number = numbers.pop(at)
                if not numbers:
                    del self.by_room[room][sources]
                    if not self.by_room[room]:
                        del self.by_room[room]
                        del self.rooms[bisect_left(self.rooms, room)]
                self.clusters[number].add(cluster)
                self._put(room - size, sources | source, number)
                return number
        number = len(self.clusters)
        self.clusters.append({cluster})
        self._put(self.capacity - size, source, number)
        return number


def pack_shard(rows: pd.DataFrame, capacity: int, lanes: int = LANES) -> pd.DataFrame:
    """``bin, piece, offset, length`` for every piece of the shard's rows, longest remainder first, then by id."""
    rows = rows.sort_values(["rest", "absent", "doc_id", "own"], ascending=[False, True, True, True], kind="stable")
    bins, codes, out, filled = Bins(capacity), {}, [], defaultdict(int)
    clusters = pd.factorize(rows["cluster"])[0].tolist()
    for row, cluster in zip(rows.itertuples(index=False), clusters):
        bit = 0 if row.source is None or row.source != row.source else 1 << codes.setdefault((row.source, row.own % lanes), len(codes))
        for piece in range(row.n_words // capacity):
            number = bins.place(capacity, bit, cluster)
            out.append((None if row.absent else row.doc_id, number, piece, 0, capacity))
        if row.rest or not row.n_words:
            number = bins.place(row.rest, bit, cluster)
            out.append((None if row.absent else row.doc_id, number, row.n_words // capacity, filled[number], row.rest))
            filled[number] += row.rest
    names = ["doc_id", "number", "piece", "offset", "length"]
    # Ids stay Python objects: a column of integers with a null among them would become floating point.
    return pd.DataFrame({name: pd.Series([r[i] for r in out], dtype=object if i == 0 else "int64") for i, name in enumerate(names)})


def packed(
    docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None,
    capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, lanes: int = LANES,
) -> DataFrame:
    """``doc_id, piece, bin_id, bin_offset, n_words``: one row for each piece of every row.

    Pieces of a row are numbered from 0; all but the last fill a bin. A null or empty text is one piece of no words. A null
    source conflicts with none. The cluster is the column ``cluster``, or the normalised text. Repeated rows are one
    cluster, so they never share a bin. An empty table gives no rows; other columns are ignored.
    """
    if min(capacity, shard_rows, lanes) < 1:
        raise ValueError("capacity, shard_rows and lanes must be positive")
    words = F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")))
    shards = max(1, math.ceil(docs.count() / shard_rows))
    whole = docs.schema[key].dataType
    rows = docs.select(
        F.col(key).isNull().alias("absent"), (F.coalesce(F.col(key), F.lit(0).cast(whole)) if isinstance(whole, IntegralType) else F.col(key)).alias("doc_id"), F.col(source).cast("string").alias("source"),
        (F.col(cluster).cast("string") if cluster else F.md5(normalised(text).cast("binary"))).alias("cluster"),
        F.xxhash64(F.col(key), F.col(text)).alias("own"), words.cast("long").alias("n_words"),
    ).select("*", (F.col("n_words") % capacity).alias("rest"), F.pmod(F.col("own"), F.lit(shards)).alias("shard"))
    kind = docs.schema[key].dataType.simpleString()

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf, capacity, lanes)
        out["bin_id"] = [f"{group[0]}-{n}" for n in out["number"]]
        return out[["doc_id", "piece", "bin_id", "offset", "length"]].rename(columns={"offset": "bin_offset", "length": "n_words"})

    return rows.groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece long, bin_id string, bin_offset long, n_words long")
