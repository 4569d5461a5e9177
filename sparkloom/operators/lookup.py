"""Point lookups, filtered scans, paging and newest-first reads. All reach the scan as pushed filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; a value of None asks for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in values.items() if v is not None), df)


def newest(df: DataFrame, at: str, key: str, limit: int | None = None, offset: int = 0, oldest: bool = False) -> DataFrame:
    """Rows by time, newest (or oldest) first, ties by key; with a limit only the top rows are ever sorted whole."""
    order = [F.col(at).asc() if oldest else F.col(at).desc(), F.col(key)]
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def newest_of_each(df: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """The newest row of each group, ties by the least key."""
    w = Window.partitionBy(*by).orderBy(F.col(at).desc(), F.col(key))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def searchable(df: DataFrame, q: str, columns: list[str]) -> DataFrame:
    """Rows with the phrase, without regard to case, in any of the columns."""
    return df.where(reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lit(q.lower())) for c in columns))) if q else df


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows (1 to 100)."""
    number, size = max(1, number), max(1, min(100, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def with_total(df: DataFrame) -> DataFrame:
    """df with the number of its rows on each, joined as one counted row rather than by a global window."""
    return df.crossJoin(df.agg(F.count(F.lit(1)).alias("total")))


def latest_value(df: DataFrame, value: str, at: str) -> DataFrame:
    return df.agg(F.max_by(value, at).alias(value))


def detail_level(df: DataFrame, level: str) -> DataFrame:
    """Projection of memory rows: l0 and l1 blank the heavier columns, full keeps all; the scan reads no blanked one."""
    blank = {"l0": ["content", "context", "resolution", "overview_l1"], "l1": ["content", "resolution"], "full": []}
    if level not in blank:
        raise ValueError(f"unknown level {level!r}")
    return df.select(*[F.lit("").alias(c) if c in blank[level] else F.col(c) for c in df.columns if level == "full" or c != "embedding"])
