"""Registered queries: each a function of (spark, sf_dir), most with the same thing as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# The corpora of sources.corpora as SQL.
WORDS = "regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')"
EVENTS = "lines AS (SELECT user_id AS doc, CAST(ts AS DATE) AS line, list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY 1, 2)"
STREAMS = "lines AS (SELECT user_id AS doc, user_id AS line, list(event_type ORDER BY ts, event_id) AS tokens FROM events GROUP BY 1, 2)"
TURNS = f"lines AS (SELECT conv_id AS doc, turn AS line, {WORDS} AS tokens FROM conversations)"
TEXTS = f"lines AS (SELECT source AS doc, doc_id AS line, {WORDS} AS tokens FROM documents)"
ORDERS = (
    "lines AS (SELECT o_custkey AS doc, l_orderkey AS line, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS tokens "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
)
# Their long forms; pos counts from 0.
TOK = "tok AS (SELECT doc, line, len(tokens) AS n, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS token FROM lines)"
BI = "bi AS (SELECT doc, line, tokens[i] AS a, tokens[i + 1] AS b FROM (SELECT *, unnest(range(1, len(tokens))) AS i FROM lines WHERE len(tokens) >= 2))"
CNT = "cnt AS (SELECT a, b, count(*) AS n FROM bi GROUP BY a, b)"
MARG = (
    "m AS (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS n_a, sum(n) OVER (PARTITION BY b) AS n_b, sum(n) OVER () AS total FROM cnt)"
)
