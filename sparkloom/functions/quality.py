"""Expressions over quality JSON: score in the unit interval and task type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score(metrics: Column) -> Column:
    """$.summary.overall_score clamped to [0, 1]; null if absent, not a number, or the JSON is bad."""
    x = F.get_json_object(metrics, "$.summary.overall_score").try_cast("double")
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def task_type(metrics: Column) -> Column:
    return F.coalesce(F.nullif(F.get_json_object(metrics, "$.summary.task_type"), F.lit("")), F.lit("other"))


def enriched(segments: DataFrame, metrics: str = "quality_metrics") -> DataFrame:
    """segments with quality_score and task_type."""
    return segments.withColumns({"quality_score": score(F.col(metrics)), "task_type": task_type(F.col(metrics))})
