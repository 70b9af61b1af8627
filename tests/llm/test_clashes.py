"""Columns of the input whose names an operator may use itself, ids beyond 2**53 beside nulls, and long texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from daybill.llm import exact, neardup, packing, words
from daybill.session import ship

CLASH = "_id long, _sha string, _sha2 string, _rid long, rid long, node string, row long, digest string, whole string, keep_id long, text_sha256 string"


@pytest.fixture
def clashing(spark):
    ship(spark)
    rows = [(1, "a b c d e f"), (2, "a b  c d e f"), (3, None), (4, ""), (5, "x"), (5, "x"), (None, "y")]
    return spark.createDataFrame([(i, t, 7, "s", "s2", 8, 9, "n", 10, "d", "w", 11, "t") for i, t in rows], "doc_id long, text string, " + CLASH)


@pytest.mark.parametrize("drop, ids", [(exact.drop_exact, [None, 1, 3, 5]), (neardup.drop_near, [None, 1, 3, 4, 5, 5])])
def test_filters_keep_columns_of_any_name(clashing, drop, ids):
    kept = drop(clashing)
    assert kept.dtypes == clashing.dtypes
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is not None, i)) == ids
    assert {tuple(r)[2:] for r in kept.collect()} == {tuple(r)[2:] for r in clashing.collect()}


def test_packing_keeps_large_ids_beside_a_null(spark):
    ship(spark)
    rows = [(9007199254740993, "a b"), (None, "c d"), (9007199254740995, "e"), (-1, None)]
    docs = spark.createDataFrame([(*r, "s", 1, True) for r in rows], "doc_id long, text string, source string, shard long, absent boolean")
    found = packing.packed(docs, capacity=10)
    assert found.dtypes[0] == ("doc_id", "bigint")
    assert sorted((r.doc_id for r in found.collect()), key=str) == sorted((i for i, _ in rows), key=str)
    named = docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text", "source")
    assert {r.doc_id for r in packing.packed(named, capacity=10).collect()} == {None if i is None else str(i) for i, _ in rows}


def test_words_of_slices_equal_python(monkeypatch):
    rng = random.Random(4)
    texts = [None, "", " ", "a"] + ["".join(rng.choice("ab é\t\n\x1c漢 ") for _ in range(rng.randrange(0, 90))) for _ in range(200)] + ["w " * 50_000]
    import re

    split = words.split_words(pa.array(texts))
    vocabulary = split.vocabulary.to_pylist()
    for i, text in enumerate(texts):
        own = [vocabulary[c] for c in split.codes[split.first[i] : split.first[i + 1]]]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", text or "")
    assert split.codes.dtype == np.int64 and split.first.dtype == np.int64
