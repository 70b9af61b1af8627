"""Registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import anchors, bytepairs, exact, hamming, language, neardup, packing, periods, pieces, prefixes, private, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    """Register ``build(read)``; ``read`` opens a table of the given folder."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return register


@_query("op1_exact_dedup", exact.ORACLE)
def _exact(read):
    return exact.exact_groups(read("documents")).drop("row")


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A public vocabulary file, read once on the driver and sent with the job."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


@_query("op2_sentencepiece")
def _pieces(read):
    return pieces.encoded(read("documents"), public_model())


@_query("op4_pii")
def _private(read):
    return private.detect(read("documents"))


@_query("op6_language_id")
def _language(read):
    return language.predicted(read("documents"))


@_query("op5_near_dedup")
def _near(read):
    return neardup.classes(read("documents")).drop("rid")


@_query("op7_suffix_repeats")
def _suffixes(read):
    return suffixes.repeated_spans(read("documents"))


@_query("op8_packing")
def _packing(read):
    return packing.packed(read("documents"))


@_query("op10_repeated_passages")
def _passages(read):
    return anchors.remove_repeats(read("documents")).drop("kept_text")


@_query("op3_toxicity")
def _toxicity(read):
    return toxicity.predicted(read("documents"), read("labels"))


@_query("op9_hamming_top_k", hamming.ORACLE)
def _hamming(read):
    vectors = read("embeddings")
    return hamming.top_k(vectors, vectors.filter(f"vec_id % {hamming.EVERY} = 0"))


@_query("op11_prefix_trie")
def _trie(read):
    return prefixes.prefix_trie(read("conversations"))


@_query("op12_periodic_runs")
def _periods(read):
    return periods.detected(read("documents"))


@_query("op13_byte_bpe")
def _bytes(read):
    import public_tokenizers

    return bytepairs.encoded(read("documents"), public_model("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
