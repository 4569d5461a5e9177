"""Where queries register with the SQL that defines the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.functions.text import WHITE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name; sql is DuckDB text for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: What counts as white space at a text's ends, as a DuckDB literal.
WHITE_SQL = "'" + WHITE + "'"


def strip_sql(text: str) -> str:
    return f"trim({text}, {WHITE_SQL})"


def cut_sql(text: str, most: str | int) -> str:
    """DuckDB text of functions.text.truncate."""
    size = f"greatest(1, ({most}) - 1)"
    head = f"substring({text}, 1, {size})"
    keep = f"CAST(floor({size} * 0.8::DOUBLE) AS BIGINT)"
    ended = f"regexp_extract(substring({head}, {keep} + 1), '(?s)^(.*[。！？；\n.!?;])', 1)"
    best = f"CASE WHEN {ended} <> '' THEN substring({head}, 1, {keep}) || {ended} ELSE {head} END"
    short = f"rtrim({best}, {WHITE_SQL})"
    return f"CASE WHEN ({most}) <= 0 OR coalesce({text}, '') = '' THEN '' WHEN length({text}) <= ({most}) THEN {text} WHEN {short} = '' THEN '' ELSE {short} || '…' END"


def flat_sql(text: str) -> str:
    """DuckDB text of functions.text.one_line."""
    return f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> ''), ' ')"
