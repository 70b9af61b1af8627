"""Keep the first, the last or the best rows of each key, without gathering a key in one task.

``row_number() <= n`` is pushed below the shuffle by Spark as a group limit, so a hot key ships at most n rows per
map task. Keeping the last row with its first position is a pre-aggregated ``max_by``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_n(df, keys, [F.col(o).asc() for o in order], 1)


def keep_last(df: DataFrame, keys: list[str], order: list[str], position: str | None = None) -> DataFrame:
    """The last row of each key; ``position`` receives the first ``order`` value of the key (map insertion order)."""
    if position is None:
        return top_n(df, keys, [F.col(o).desc() for o in order], 1)
    others = [name for name in df.columns if name not in keys]
    grouped = df.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("_last"), F.min(F.struct(*order)).alias("_first")
    )
    return grouped.select(*keys, "_last.*", F.col("_first")[order[0]].alias(position))
