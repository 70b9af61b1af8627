"""Intermediate tables of long jobs, written where every executor can read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends, and columns stay compressed.

    Spark drops the shuffle files of the write when it is done, so the disk holds one step's shuffles at a time.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(place)
