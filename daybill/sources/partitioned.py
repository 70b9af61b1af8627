"""A catalog kept by parts (its months): an upsert rewrites the parts it touches and leaves the others where they are.

A version is a manifest that names, for every part, the version whose files hold it. Files and manifest are complete and
the gates have passed before the pointer row makes the version visible, so a failure at any step leaves the previous one
readable, and its files are never written again. Folders::

    data/version=V/_part=1997-06/...   rows of a part as version V wrote them
    _manifest/version=V                (part, version): one row a part
    _pointer                           published versions
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import leading_day
from ..operators.gates import publish
from . import sinks

MANIFEST = "part STRING, version STRING"


def month(value: str | Column) -> Column:
    """The part of a dated row."""
    return F.left(leading_day(value), F.lit(7))


def part_name(part: str | Column) -> Column:
    """A part as a folder name; values that only differ in odd characters share a folder."""
    name = F.regexp_replace(F.coalesce((F.col(part) if isinstance(part, str) else part).cast("string"), F.lit("")), "[^A-Za-z0-9._-]", "_")
    return F.when(name == "", F.lit("none")).otherwise(name)


def manifest(spark: SparkSession, root: str, version: str | None = None) -> dict[str, str]:
    """Version of every part; there are as many parts as months."""
    version = version or sinks.published_version(spark, root)
    if version is None:
        return {}
    return {r.part: r.version for r in spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/_manifest/version={version}").collect()}


def _read(spark: SparkSession, root: str, parts: dict[str, str], schema=None) -> DataFrame:
    folders = [f"{root.rstrip('/')}/data/version={version}/_part={part}" for part, version in sorted(parts.items())]
    reader = spark.read.option("mergeSchema", "true")
    if not folders:
        return spark.createDataFrame([], schema)
    return (reader.schema(schema) if schema is not None else reader).parquet(*folders)


def read_parts(spark: SparkSession, root: str, parts: list[str] | None = None, version: str | None = None) -> DataFrame:
    """The published catalog, or some parts of it: folders of other parts are not opened."""
    known = manifest(spark, root, version)
    if not known:
        raise ValueError(f"nothing is published under {root}")
    chosen = known if parts is None else {p: v for p, v in known.items() if p in parts}
    whole = _read(spark, root, known)
    return whole if parts is None else _read(spark, root, chosen, whole.schema)


def upsert_parts(
    changed: DataFrame, root: str, key: str, part: str | Column, version: str,
    removed: DataFrame | None = None, gates: Callable[[DataFrame], DataFrame] | None = None, stamp: tuple[str, int] | None = None,
) -> list[str]:
    """Publish ``version``: rows of ``changed`` replace those with their key, keys of ``removed`` leave. Returns the parts written.

    ``changed`` has one row a key. A row that moves to another part is taken out of its old one. ``gates`` maps the whole
    new catalog to gate rows (see ``operators.gates``); any row raises ``PublicationBlocked`` before the pointer. A part
    that is left without rows leaves the manifest.
    """
    spark, base = changed.sparkSession, root.rstrip("/")
    newest = sinks.newer(spark, root, version)
    known = manifest(spark, root, newest) if newest is not None else {}
    named = changed.withColumn("_part", part_name(part))
    gone = named.select(key) if removed is None else named.select(key).unionByName(removed.select(key)).distinct()
    touched = {r._part for r in named.select("_part").distinct().collect()}
    if known:
        before = _read(spark, root, known).withColumn("_part", part_name(part))
        touched |= {r._part for r in before.join(gone, key, "left_semi").select("_part").distinct().collect()}
        stays = _read(spark, root, {p: v for p, v in known.items() if p in touched}, before.drop("_part").schema)
        kept = stays.join(gone, key, "left_anti").withColumn("_part", part_name(part))
        named = kept.unionByName(named, allowMissingColumns=True)
    target = f"{base}/data/version={version}"
    named.write.mode("overwrite").partitionBy("_part").parquet(target)
    written = {r._part for r in spark.read.schema("_part STRING").parquet(target).select("_part").distinct().collect()} if touched else set()
    parts = {p: v for p, v in known.items() if p not in touched} | {p: version for p in written}
    spark.createDataFrame(sorted(parts.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{base}/_manifest/version={version}")
    if gates is not None:
        publish(gates(_read(spark, root, parts, None if parts else changed.schema)))
    sinks.point(spark, root, version, stamp)
    return sorted(touched)
