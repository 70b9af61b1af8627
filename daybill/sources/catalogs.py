"""Catalog documents on disk: JSON arrays, multi-file translation catalogs, script-wrapped JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "id STRING, sourceFingerprint STRING, title STRING, description STRING, status STRING, override BOOLEAN, translationSource STRING, reviewedAt STRING, generatedAt STRING"
)
# Catalog file names and the file that is read last.
CATALOG_NAME = r"^translations\.zh(?:\.[^.]+(?:-[^.]+)*)?\.json$"
MANIFEST_NAME, AUTOMATION_NAME = "translations.zh.manifest.json", "translations.zh.automation.json"


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array per file, with a fixed schema (no inference pass)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def is_catalog_file(name: Column) -> Column:
    return name.rlike("(?i)" + CATALOG_NAME) & (name != MANIFEST_NAME)


def precedence(name: Column) -> Column:
    """Sort key of a catalog file: by name, the automation file after all others."""
    return F.struct((name == AUTOMATION_NAME).alias("late"), name.alias("name"))


def read_catalogs(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of every catalog file with their precedence ``(late, file_name, pos)``."""
    docs = spark.read.schema(f"version INT, locale STRING, entries ARRAY<STRUCT<{ENTRY}>>").option("multiLine", True).json(folder)
    named = docs.withColumn("file_name", F.col("_metadata.file_name")).filter(is_catalog_file(F.col("file_name")))
    rows = named.select("file_name", precedence(F.col("file_name"))["late"].alias("late"), F.posexplode("entries").alias("pos", "e"))
    return rows.select(
        F.col("e.id").alias("id"), F.col("e.sourceFingerprint").alias("fingerprint"), F.col("e.title").alias("title"), F.col("e.description").alias("description"),
        F.col("e.status").alias("status"), F.coalesce("e.override", F.lit(False)).alias("override"), F.coalesce("e.reviewedAt", "e.generatedAt").alias("reviewed_at"), "late", "file_name", "pos",
    )


def unwrap_script(body: Column, variable: str) -> Column:
    """The JSON text of ``window.NAME = {...};``."""
    return F.regexp_replace(F.regexp_replace(body, rf"^\s*window\.{variable}\s*=\s*", ""), r";\s*(?:window\.[\s\S]*)?$", "")


def read_script(spark: SparkSession, path: str, variable: str, schema: str) -> DataFrame:
    docs = spark.read.option("wholetext", True).text(path)
    return docs.select(F.from_json(unwrap_script(F.col("value"), variable), schema).alias("doc")).select("doc.*")
