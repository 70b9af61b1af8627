"""Which documents contain which evidence texts, letter for letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most words and most characters of a key.
KEY_WORDS, KEY_CHARS = 4, 4


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: F.length(w) > 0)


def _windows(parts: Column, n: int, glue: str) -> Column:
    """Every run of ``n`` neighbouring parts, joined."""
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), glue))


def _marked(grams: Column, kind: int) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))


def _evidence_keys(evidence: DataFrame, id_: str, text: str) -> DataFrame:
    """``(id, evidence, kind, gram)``: one key for each evidence text.

    The first and last word may be parts of a document's words, the words between them are whole. A key of ``kind`` n is the
    longest run of n inner words, n at most ``KEY_WORDS``; of ``kind`` -n the first n characters, where no word lies inside.
    """
    split = evidence.filter(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("evidence"), _words(F.col(text)).alias("w"))
    inner = split.withColumn("inner", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))).withColumn("k", F.least(F.size("inner"), F.lit(KEY_WORDS)))
    longest = lambda n: F.array_max(F.transform(_windows(F.col("inner"), n, " "), lambda g: F.struct(F.length(g).alias("size"), g.alias("gram"))))["gram"]
    gram = F.left("evidence", F.lit(KEY_CHARS))
    for n in range(1, KEY_WORDS + 1):
        gram = F.when(F.col("k") == n, longest(n)).otherwise(gram)
    kind = F.when(F.col("k") > 0, F.col("k")).otherwise(-F.least(F.length("evidence"), F.lit(KEY_CHARS)))
    return inner.select("id", "evidence", kind.cast("int").alias("kind"), gram.alias("gram"))


def containing(docs: DataFrame, evidence: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", evidence_id: str = "item_id", evidence_text: str = "text") -> DataFrame:
    """``(item_id, doc_id)`` of every document whose text contains an evidence text; an empty one is in every text, null in none.

    Both sides meet on a key that a document with the evidence must hold, and each meeting is verified on the whole texts. Of
    the documents only keys of the kinds that the evidence has are made; these are at most nine, whatever the tables' size.
    """
    keys = _evidence_keys(evidence, evidence_id, evidence_text)
    kinds = sorted(r["kind"] for r in keys.select("kind").distinct().collect())
    texts = docs.filter(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(doc_text).alias("_text"))
    split = texts.select("_doc", _words(F.col("_text")).alias("w"), F.filter(F.split("_text", ""), lambda c: F.length(c) > 0).alias("c"))
    made = []
    for kind in kinds:
        grams = F.array(F.lit("")) if kind == 0 else _windows(F.col("w"), kind, " ") if kind > 0 else _windows(F.col("c"), -kind, "")
        made.append(_marked(F.array_distinct(grams), kind))
    if not made:
        made = [F.array().cast("array<struct<kind:int,gram:string>>")]
    keyed = split.select("_doc", F.explode(F.concat(*made)).alias("key")).select("_doc", "key.kind", "key.gram")
    hits = keyed.join(keys, ["kind", "gram"]).select("_doc", "id", "evidence")
    found = hits.join(texts, "_doc").filter(F.contains("_text", "evidence"))
    return found.select(F.col("id").alias(evidence_id), F.col("_doc").alias(doc_id)).distinct()
