"""An age that a text does not state is not cast: a cast that fails on every row is dear."""

from pyspark.sql import functions as F

from daybill.functions import audience


def test_only_a_stated_age_is_cast(spark):
    texts = ["Ages 6 and up.", "Ages 5-12.", "Adults only, 21+.", "", "ages 4 +", "For toddlers and preschoolers."]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select("i", audience._age_clues(F.col("t"))["up"].alias("up"))
    assert [r.up for r in rows.orderBy("i").collect()] == [6, None, None, None, 4, None]
    assert "cast(nullif(coalesce(regexp_extract" in rows._jdf.queryExecution().analyzed().toString().lower()
