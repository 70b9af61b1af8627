"""Exact top-k search over binary codes by incremental multi-index hashing, in built-in functions only.

A vector's code has a bit per component, set where it is positive. Codes are cut into segments of about as many bits as the
number of vectors has, so a segment value stands for few of them, and indexed under each segment. A query probes all segment
values within radius 0, then 1, and so on. After radius r every code with a distance up to ``segments * (r + 1) - 1`` has
been met, as one of its segments differs in at most r bits; a query ends when its k-th distance is not beyond that. A pair is
taken only in its first segment of least difference, so no pair comes twice, and only while it can still enter the query's k.

Vectors with equal codes are one index row with their k smallest ids, so copies cost nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

K, EVERY = 10, 100


def codes(rows: DataFrame, count: int, bits: int, key: str, vector: str) -> DataFrame:
    """``(id, s0, s1, ...)``; rows without id or vector are left out.

    A component that is null, not a number or behind the vector's end gives bit 0.
    """
    rows = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).filter("id is not null and v is not null")

    def segment(i: int) -> Column:
        part = F.slice("v", F.lit(i * bits + 1), F.lit(bits))
        on = F.transform(part, lambda x, j: F.when((x > 0) & ~F.isnan(x), F.pow(F.lit(2), j).cast("int")).otherwise(0))
        return F.aggregate(on, F.lit(0), lambda a, b: a + b)

    return rows.select("id", *[segment(i).alias(f"s{i}") for i in range(count)])


def masks(probes: DataFrame, radius: int, bits: int) -> DataFrame:
    """Every row once for each mask of ``radius`` of ``bits`` bits, built from ascending bit places."""
    out = probes.withColumns({"mask": F.lit(0), "last": F.lit(-1)})
    for _ in range(radius):
        later = out.filter(F.col("last") < bits - 1)
        out = later.withColumn("last", F.explode(F.sequence(F.col("last") + 1, F.lit(bits - 1)))).withColumn(
            "mask", F.col("mask").bitwiseOR(F.expr("shiftleft(1, last)"))
        )
    return out.drop("last")


def index(coded: DataFrame, count: int, k: int) -> DataFrame:
    """``(code columns, ids)``: each distinct code with its k smallest ids; the ranking keeps k rows a code before any shuffle."""
    names = [f"s{i}" for i in range(count)]
    best = coded.withColumn("place", F.row_number().over(Window.partitionBy(*names).orderBy("id"))).filter(F.col("place") <= k)
    return best.groupBy(*names).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, distance``: for every query the k nearest rows, itself among them; ties by smaller id.

    With fewer than k rows all come. Repeated rows each count. Queries without id or vector have no result.
    """
    size = vectors.agg(F.max(F.size(vector)), F.count("*")).first()
    width = max(1, size[0] or 1)
    bits = max(4, min(30, round(math.log2(max(2, size[1]))), width))
    count = -(-width // bits)
    coded = codes(vectors, count, bits, key, vector)
    names = [f"s{i}" for i in range(count)]
    stored = durable(index(coded, count, k))
    segments = F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), F.col(n).alias("value")) for i, n in enumerate(names)])).alias("at")
    probed = stored.select(*names, "ids", segments).select(*[F.col(n).alias(f"c{n}") for n in names], "ids", "at.segment", "at.value")
    asked = codes(queries, count, bits, key, vector).dropDuplicates(["id"])
    best = durable(asked.select(F.col("id").alias("q"), F.lit(0).alias("distance"), F.lit(0).cast("long").alias("vec")).limit(0))
    open_ = durable(asked.withColumn("limit", F.lit(count * bits)))
    apart = [F.bit_count(F.col(n).bitwiseXOR(F.col(f"c{n}"))) for n in names]
    distance = reduce(lambda a, b: a + b, apart)
    kinds = dict(vectors.dtypes)[key]
    for radius in range(bits + 1):
        probes = masks(open_.select("id", "limit", *names, segments), radius, bits).select(
            "id", "limit", *names, F.col("at.segment").alias("psegment"), F.col("at.value").bitwiseXOR(F.col("mask")).alias("pvalue")
        )
        # The pair's own place: the least (difference, segment) of all its segments.
        ahead = [
            F.when(F.col("psegment") > i, part > radius).when(F.col("psegment") < i, part >= radius).otherwise(True) for i, part in enumerate(apart)
        ]
        first = reduce(lambda a, b: a & b, ahead)
        met = probes.join(probed, (F.col("psegment") == F.col("segment")) & (F.col("pvalue") == F.col("value")) & first & (distance <= F.col("limit")))
        fresh = met.select(F.col("id").alias("q"), distance.alias("distance"), F.explode("ids").alias("vec"))
        every = best.select("q", "distance", F.col("vec").cast(kinds).alias("vec")).unionByName(fresh)
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec"))
        best = durable(every.withColumn("rank", place).filter(F.col("rank") <= k).drop("rank"))
        reach = count * (radius + 1) - 1
        full = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("worst")).filter(F.col("n") >= k)
        left = open_.drop("limit").join(full, F.col("id") == F.col("q"), "left").filter(F.col("worst").isNull() | (F.col("worst") > reach))
        open_ = durable(left.select("id", *names, F.coalesce("worst", F.lit(count * bits)).alias("limit")))
        if open_.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec"))
    return best.select(F.col("q").alias("query_id"), rank.alias("rank"), F.col("vec").alias("vec_id"), "distance")


ORACLE = f"""
WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
c AS (SELECT vec_id, i, x > 0 AND NOT isnan(x) AS b FROM u),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(count(*) FILTER (WHERE q.b <> r.b) AS INTEGER) AS distance
 FROM c q JOIN c r ON q.i = r.i WHERE q.vec_id % {EVERY} = 0 GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS "rank" FROM p)
SELECT query_id, "rank", vec_id, distance FROM k WHERE "rank" <= {K}
"""
