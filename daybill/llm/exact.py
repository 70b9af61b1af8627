"""Exact de-duplication by a heavy-hitter split, in built-in functions only.

Frequent digests are found with a Misra-Gries type summary (``approx_top_k``), verified by exact counts, and broadcast:
their rows are decided where they lie. All other digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable

WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
TOP, TRACKED = 64, 4096


def normalised(text: Column | str) -> Column:
    """The text with every run of ASCII white space as one space; null counts as empty.

    The pattern leaves single spaces alone, so only other runs are rewritten.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, row, digest)``, stored once; ``row`` tells repeated rows apart."""
    digest = F.unhex(F.sha2(normalised(text).cast("binary"), 256))
    return durable(docs.select(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest")))


def heavy(stored: DataFrame, top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """At most ``top`` rows ``(digest, keep, group_size)`` of digests with more than ``1 / tracked`` of all rows.

    The summary only proposes; each proposal's rows are counted exactly before it wins.
    """
    guess = stored.agg(F.expr(f"approx_top_k(hex(digest), {top}, {tracked})").alias("found"), F.count("*").alias("total"))
    proposed = guess.select("total", F.explode("found.item").alias("item")).select("total", F.unhex("item").alias("digest"))
    counted = stored.join(F.broadcast(proposed), "digest").groupBy("digest").agg(
        F.min(_order()).alias("keep"), F.count("*").alias("group_size"), F.any_value("total").alias("total")
    )
    return counted.filter(F.col("group_size") * tracked > F.col("total")).drop("total")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", top: int = TOP, tracked: int = TRACKED) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and ``row``.

    Null and empty texts are one group. The smallest ``doc_id`` stays, a null one only when there is no other; of repeated
    rows with that id one stays. An empty table gives no rows; other columns are ignored.
    """
    stored = digests(docs, text, key)
    winners = durable(heavy(stored, top, tracked))  # at most ``top`` rows
    marked = stored.join(F.broadcast(winners), "digest", "left")
    here = marked.filter(F.col("keep").isNotNull())
    rest = stored.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min(_order()).alias("keep"), F.count("*").alias("group_size"))
    there = rest.join(groups, "digest")
    columns = ["doc_id", "row", "digest", "keep", "group_size"]
    return here.select(*columns).unionByName(there.select(*columns)).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row",
    )


def drop_exact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The input rows that stay, with their columns: one per distinct text, that of the smallest id.

    Rows are told apart by id and text; of repeated rows with one id and text one stays.
    """
    kept = exact_groups(docs, text, key).filter("kept").select("doc_id", "text_sha256")
    # The row travels as one struct, so its columns can't clash with the two that decide.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keyed = docs.select(F.col(key).alias("doc_id"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"), whole)
    same = (keyed["text_sha256"] == kept["text_sha256"]) & keyed["doc_id"].eqNullSafe(kept["doc_id"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_sha256"]).select("whole.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
 row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
