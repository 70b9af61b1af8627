"""The registry of checked queries and the SQL fragments they share."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.listings import ACTIVITIES, AUDIENCES, COSTS, Tables

TODAY, NOW, FRIDAY, SUNDAY = "1997-06-13", "1997-06-13T12:00:00", "1997-06-13", "1997-06-15"


@dataclass(frozen=True)
class Check:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``sql`` may use the ``{lv}`` view."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CHECKS:
            raise ValueError(f"duplicate check {name}")
        CHECKS[name] = Check(name, build, expand(sql) if sql else None)
        return build

    return register


def q(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def rx(column: str, pattern: str, ignore_case: bool = True) -> str:
    """``column`` matches the pattern, in the other engine's dialect."""
    return f"regexp_matches({column}, {q(('(?i)' if ignore_case else '') + pattern)})"


def options(values: list[str], index: str) -> str:
    return "([" + ", ".join(q(v) for v in values) + f"])[({index}) % {len(values)} + 1]"


LV = f"""lv AS (
 SELECT l_orderkey * 8 + l_linenumber AS ord,
  'lv-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id,
  l_partkey || '-' || l_suppkey AS series, 's-' || l_suppkey AS source_id,
  p_name || ' ' || {options(ACTIVITIES, 'l_partkey')} AS title,
  trim('Join us to build a ' || p_name || ' with ' || s_name || '. ' || {options(AUDIENCES, 'l_suppkey')} || ' '
   || {options(COSTS, 'l_partkey + l_suppkey')}) AS description,
  s_name AS source, p_brand AS place, n_name AS city, r_name AS region, o_orderpriority AS priority,
  (l_suppkey % 900 + 100) || ' Main Street' AS address,
  strftime(l_shipdate, '%Y-%m-%d') AS day,
  CASE WHEN l_linenumber % 4 = 0 THEN strftime(l_shipdate, '%Y-%m-%d')
   ELSE strftime(l_shipdate, '%Y-%m-%d') || 'T' || lpad(CAST(l_suppkey % 12 + 8 AS VARCHAR), 2, '0') || ':00' END AS date_value,
  CASE WHEN l_linenumber % 3 = 0 THEN ''
   WHEN l_linenumber % 3 = 1 THEN strftime(l_shipdate + to_days(CAST(l_linenumber AS INTEGER)), '%Y-%m-%d')
   ELSE strftime(l_shipdate, '%Y-%m-%d') || 'T' || lpad(CAST(l_suppkey % 12 + 10 AS VARCHAR), 2, '0') || ':00' END AS end_date_value,
  CASE l_returnflag WHEN 'A' THEN 'free' WHEN 'R' THEN 'paid' ELSE 'unknown' END AS cost_status,
  'https://www.s' || l_suppkey || '.example.org/events/activity-' || l_partkey || '/?utm_source=feed&id=' || l_orderkey AS url,
  CASE WHEN l_linestatus = 'O' THEN 'https://img.example.org/p' || (l_partkey % 500) || '.jpg' ELSE '' END AS image,
  strftime(l_shipdate - to_days(CAST(l_partkey % 40 AS INTEGER)), '%Y-%m-%d') AS verified_at,
  CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice AS price,
  l_partkey AS part, l_suppkey AS supp, CAST(l_linenumber AS BIGINT) AS line, l_orderkey AS orderkey
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN orders ON l_orderkey = o_orderkey
)"""

# Reusable SQL macros written as {name:arguments}; see expand().
MONTHS_SQL = "'janfebmaraprmayjunjulaugsepoctnovdec'"


def first_nonempty_sql(*parts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" for p in parts) + ", '')"


def day_sql(value: str) -> str:
    return f"regexp_extract({value}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')"


def local_sql(value: str, late: str = "false") -> str:
    p = q(r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?)?")
    g = lambda i: f"regexp_extract({value}, {p}, {i})"
    f = lambda i, end: f"CASE WHEN {g(i)} <> '' THEN {g(i)} WHEN {late} THEN '{end}' ELSE '00' END"
    return f"CASE WHEN {g(1)} = '' THEN '' ELSE {g(1)} || 'T' || {f(2, '23')} || ':' || {f(3, '59')} || ':' || {f(4, '59')} END"


def clock_sql(value: str) -> str:
    return f"(contains({value}, 'T') OR contains({value}, ' '))"


def end_sql(start: str, end: str, minutes: str) -> str:
    """Effective end of a listing."""
    moved = f"strftime(CAST(left({local_sql(start)}, 16) || ':00' AS TIMESTAMP) + to_minutes(CAST({minutes} AS INTEGER)), '%Y-%m-%dT%H:%M:%S')"
    return (
        f"CASE WHEN {end} <> '' THEN {local_sql(end, 'NOT ' + clock_sql(end))} WHEN {start} = '' THEN '' "
        f"WHEN NOT {clock_sql(start)} THEN {local_sql(start, 'true')} ELSE {moved} END"
    )


def expand(sql: str) -> str:
    return re.sub(r"\{lv\}", lambda _: LV, sql)
