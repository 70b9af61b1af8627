"""A training-corpus pipeline over ``documents``: known languages, exact copies, near copies, personal data, packing.

Every stage reads what its predecessor wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybill.llm import exact, language, neardup, packing, private
from daybill.session import shared_dir, ship

NEAR = 80  # percent of the union of two texts' shingles; op5_near_dedup has its own, 85


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no learnt language can parse go."""
    ship(spark)
    return language.keep_known(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    ship(spark)
    return exact.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays; copies share ``NEAR`` percent of their 5-word shingles or more."""
    ship(spark)
    return neardup.drop_near(docs, need=NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become marks; ``n_chars`` follows the text."""
    ship(spark)
    out = private.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document goes: bin, offset and words."""
    ship(spark)
    return packing.packed(docs)


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("pii", personal_data),
    ("packing", packing_plan),
]

#: Language models, near-duplicate classes and best-fit search are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
