"""Shared pieces of the query catalog: output finishing and oracle SQL snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def finish(df: DataFrame) -> DataFrame:
    """Engine-neutral output: TIMESTAMP -> TIMESTAMP_NTZ (UTC wall time), DOUBLE
    rounded to 6 places (sums in another order differ in the last bits)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), DIGITS)
        cols.append(c.alias(f.name))
    return df.select(*cols)


# Oracle-side envelope of the events table (DuckDB SQL), same mapping as
# sources.tables.events_envelope.
EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'events' AS source, event_type AS type,
         ts AS "timestamp", value AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS quantity, user_id
  FROM events)"""

# The shifted events of sources.tables.events_shifted.
EVS = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'events' AS source, event_type AS type, ts AS "timestamp",
         value + CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 300 ELSE 0 END AS price,
         CAST(json_extract_string(props, '$.k') AS BIGINT)
           + CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 200 ELSE 0 END AS quantity, user_id
  FROM events)"""

LI = """li AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id,
         'lineitem' AS source, l_returnflag AS type, l_shipdate AS "timestamp",
         l_extendedprice AS price, l_quantity AS quantity,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
  FROM lineitem)"""


def r6(expr: str) -> str:
    return f"round({expr}, {DIGITS})"


def sql_fill(template: str, **parts: str) -> str:
    """SQL text for a template with ``{name}`` slots."""
    out, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append("'" + rest.replace("'", "''") + "'")
            break
        if i:
            out.append("'" + rest[:i].replace("'", "''") + "'")
        j = rest.index("}", i)
        out.append(f"({parts[rest[i + 1:j]]})")
        rest = rest[j + 1:]
    return " || ".join(out)
