"""The listing view over star-schema tables: one listing per line item.

Only the dimension tables that the requested columns need are joined. No join carries a broadcast hint: Spark
broadcasts a side when its measured size is below the session's threshold and shuffles it otherwise.
The order of listings is ``(ord, id)``; both come from the row itself, so no global sort is needed to number rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIVITIES = [
    "lantern festival", "halloween parade", "science workshop", "toddler storytime", "soccer match", "museum family day",
    "nature hike", "watercolor painting class", "lego building", "puppet show", "yoga class", "board games night",
    "community cleanup", "robotics challenge", "pumpkin patch", "holiday concert", "chess club", "bike repair clinic",
    "movie night", "library meetup", "homework help", "train ride", "garden program", "family program",
]
AUDIENCES = [
    "Ages 5-12.", "All ages are welcome.", "Grades K-5.", "For toddlers and preschoolers.", "Ages 6 and up.", "Family-friendly.",
    "Kids (4-8).", "", "Teens.", "Adults only, 21+.",
]
COSTS = [
    "Free admission.", "Tickets are $5 to $12.", "Suggested donation.", "Registration required.", "No registration required.",
    "General admission is $8; members of the club enter at $4.", "Sold out.", "Drop-ins welcome.", "",
]

_FROM_SUPPLIER = {"source", "city", "region", "description", "address"}
_FROM_PART = {"title", "description", "place"}


class Tables:
    """Lazy readers of the tables in one folder.

    ``spread`` deals the large tables over so many partitions. It is for benchmarks over one-file tables only: by default
    the files give the tasks, in local mode as on a cluster.
    """

    _LARGE = ("lineitem", "events", "documents", "pages", "conversations")

    def __init__(self, spark: SparkSession, folder: str, spread: int = 0):
        self.spark, self.folder, self._spread = spark, folder.rstrip("/"), spread

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.repartition(self._spread) if self._spread > 1 and name in self._LARGE else df


def _pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index % len(options) + 1).cast("int"))


def listings(t: Tables, *wanted: str) -> DataFrame:
    """Listings with the wanted columns (always with ``ord`` and ``id``)."""
    need = set(wanted)
    df = t.lineitem
    if need & _FROM_PART:
        df = df.join(t.part, df.l_partkey == F.col("p_partkey"))
    if need & _FROM_SUPPLIER:
        df = df.join(t.supplier, df.l_suppkey == F.col("s_suppkey"))
    if need & {"city", "region"}:
        df = df.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    if "region" in need:
        df = df.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    if "priority" in need:
        df = df.join(t.orders, df.l_orderkey == F.col("o_orderkey"))
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    start = F.concat(day, F.lit("T"), F.lpad((supp % 12 + 8).cast("string"), 2, "0"), F.lit(":00"))
    late = F.concat(day, F.lit("T"), F.lpad((supp % 12 + 10).cast("string"), 2, "0"), F.lit(":00"))
    as_text = lambda v: v.cast("string")
    columns: dict[str, Column] = {
        "ord": F.col("l_orderkey") * 8 + line,
        "id": F.concat_ws("-", F.lit("lv"), as_text(F.col("l_orderkey")), as_text(line), as_text(part), as_text(supp), F.date_format("l_shipdate", "yyyyMMdd")),
        "series": F.concat_ws("-", as_text(part), as_text(supp)),
        "source_id": F.concat(F.lit("s-"), as_text(supp)),
        "date_value": F.when(line % 4 == 0, day).otherwise(start),
        "end_date_value": F.when(line % 3 == 0, F.lit("")).when(
            line % 3 == 1, F.date_format(F.date_add(F.to_date("l_shipdate"), line), "yyyy-MM-dd")
        ).otherwise(late),
        "day": day,
        "cost_status": F.when(F.col("l_returnflag") == "A", F.lit("free")).when(F.col("l_returnflag") == "R", F.lit("paid")).otherwise(F.lit("unknown")),
        "url": F.concat(F.lit("https://www.s"), as_text(supp), F.lit(".example.org/events/activity-"), as_text(part), F.lit("/?utm_source=feed&id="), as_text(F.col("l_orderkey"))),
        "image": F.when(F.col("l_linestatus") == "O", F.concat(F.lit("https://img.example.org/p"), as_text(part % 500), F.lit(".jpg"))).otherwise(F.lit("")),
        "verified_at": F.date_format(F.date_sub(F.to_date("l_shipdate"), (part % 40).cast("int")), "yyyy-MM-dd"),
        "quantity": F.col("l_quantity").cast("long"),
        "price": F.col("l_extendedprice"),
        "part": part, "supp": supp, "line": line.cast("long"), "orderkey": F.col("l_orderkey"),
    }
    if "title" in need:
        columns["title"] = F.concat_ws(" ", F.col("p_name"), _pick(ACTIVITIES, part))
    if "description" in need:
        columns["description"] = F.trim(
            F.concat(
                F.lit("Join us to build a "), F.col("p_name"), F.lit(" with "), F.col("s_name"), F.lit(". "), _pick(AUDIENCES, supp),
                F.lit(" "), _pick(COSTS, part + supp),
            )
        )
    if "place" in need:
        columns["place"] = F.col("p_brand")
    if "source" in need:
        columns["source"] = F.col("s_name")
    if "address" in need:
        columns["address"] = F.concat(as_text(supp % 900 + 100), F.lit(" Main Street"))
    if "city" in need:
        columns["city"] = F.col("n_name")
    if "region" in need:
        columns["region"] = F.col("r_name")
    if "priority" in need:
        columns["priority"] = F.col("o_orderpriority")
    order = ["ord", "id", *[w for w in wanted if w not in ("ord", "id")]]
    return df.select(*[columns[name].alias(name) for name in order])
