"""Comparison of two measurement tables: means, left join, speedup, slices, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["id", "k", "size2", "nb_items"]


def mean_by_config(df: DataFrame, name: str) -> DataFrame:
    """Mean duration of each configuration, as column ``name``."""
    keys = [c for c in df.columns if c != "duration"]
    return df.groupBy(*keys).agg(F.avg("duration").alias(name))


def compare(sharded: DataFrame, blocked: DataFrame) -> DataFrame:
    """Each sharded configuration beside the blocked one of the same size; ``speedup`` is null where it would divide by zero."""
    left, right = mean_by_config(sharded, "sharded"), mean_by_config(blocked, "blocked")
    return left.join(right, KEYS, "left").withColumn("speedup", F.try_divide("blocked", "sharded"))


def slice_of(report: DataFrame, measure: str) -> DataFrame:
    """Rows of one measure; a rate has no speedup."""
    out = report.where(F.col("id") == measure)
    return out.drop("speedup") if measure == "fpr" else out


def formatted(report: DataFrame, measure: str) -> DataFrame:
    """Numbers as text: five decimals for a rate, three and the unit for seconds."""
    out = slice_of(report, measure)
    number = (lambda c: F.format_number(c, 5)) if measure == "fpr" else (lambda c: F.concat(F.format_number(c, 3), F.lit(" s")))
    return out.withColumns({c: number(F.col(c)) for c in ("sharded", "blocked")})


def clipped(report: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """``column`` held within a colour scale's ends."""
    return report.withColumn(column, F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high)))
