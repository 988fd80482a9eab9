"""Registered queries and their oracles.

An oracle is DuckDB SQL over the driver's tables; ``{{name}}`` references to
the views below are put in front of it as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LINES = "lineitem JOIN part ON l_partkey = p_partkey"
VIEWS = {
    "ticks": "SELECT event_type AS id, ts AS timestamp, value AS prices, CAST(user_id AS DOUBLE) AS market_caps, CAST(regexp_extract(props, '\"k\": *([0-9.-]+)', 1) AS DOUBLE) AS total_volumes FROM events",
    "prices": f"SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice / l_quantity), 6) AS closeadj, round(max(l_extendedprice / l_quantity), 6) AS high, round(min(l_extendedprice / l_quantity), 6) AS low, sum(l_quantity) AS volume FROM {_LINES} GROUP BY ALL",
    "valuations": f"SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, round(sum(l_extendedprice), 2) AS marketcap, round(sum(l_extendedprice * (1 - l_discount)), 2) AS ev, round(avg(p_retailprice), 4) AS evebit, round(avg(l_discount) * 100, 6) AS pe, round(avg(l_tax) * 100, 6) AS pb, round(avg(l_quantity), 6) AS ps FROM {_LINES} GROUP BY ALL",
    "fundamentals": f"""SELECT ticker, 'ARQ' AS dimension, datekey, revenue, assets, debt, cashneq, ebit, intexp, capex, equity FROM (
        SELECT p_brand AS ticker, date_trunc('quarter', CAST(l_shipdate AS DATE)) AS quarter, max(CAST(l_shipdate AS DATE)) AS datekey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(l_extendedprice), 2) AS assets,
        round(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 2) AS debt, round(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 2) AS cashneq, round(sum(l_extendedprice * (1 - l_discount)) - 0.9 * sum(p_retailprice * l_quantity), 2) AS ebit,
        round(sum(l_extendedprice * l_tax) - 1000, 2) AS intexp, round(sum(l_extendedprice * l_discount), 2) AS capex, round(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 2) AS equity FROM {_LINES} GROUP BY 1, 2)""",
    "metadata": "SELECT p_brand AS ticker, min(p_type) AS famaindustry, 'S' || CAST(max(p_size) % 4 AS VARCHAR) AS sector FROM part GROUP BY 1",
    "actions": f"SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, 'delisted' AS action FROM {_LINES} WHERE l_returnflag = 'R'",
}


def view(name: str, sql: str) -> None:
    """Another view for oracles; it may refer to those before it."""
    VIEWS[name] = sql


def nudged(sql: str) -> str:
    """The SQL with every ``round(x, n)`` nudged as ``stable_round`` does it."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, i, comma = 1, m.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        digits = int(sql[comma + 1 : i - 1])
        out += f"{sql[at : m.start()]}round(({nudged(sql[m.end() : comma])}) + 1e-{digits + 3}, {digits})"
        at = i
    return out + sql[at:]


def with_views(sql: str) -> str:
    used: list[str] = []

    def visit(text: str) -> None:
        for n in re.findall(r"\{\{(\w+)\}\}", text):
            if n not in used:
                visit(VIEWS[n])
                if n not in used:
                    used.append(n)

    visit(sql)
    plain = lambda t: re.sub(r"\{\{(\w+)\}\}", r"v_\1", t)
    head = ", ".join(f"v_{n} AS MATERIALIZED ({plain(VIEWS[n])})" for n in used)
    body = plain(sql).strip()
    more = re.match(r"WITH\s+", body)
    return nudged(f"WITH {head}{',' if more else ''} {body[more.end() :] if more else body}" if used else body)


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return f

    return put
