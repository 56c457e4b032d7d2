"""Joins that a filter makes cheaper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsieve.operators.probe import contains
from bitsieve.plans.layout import TEMP
from bitsieve.spec import FilterSpec


def _kept(df: DataFrame, key: str, state: DataFrame, spec: FilterSpec, how: dict, wanted: bool) -> DataFrame:
    """Rows with that answer; a null key has none.

    The condition names the task's number, so it stays above the projection that
    hashes; pushed below, it would repeat the hash steps inline.
    """
    hit = TEMP + "in"
    while hit in df.columns:
        hit += "_"
    rows = contains(df, key, state, spec, out=hit, **how)
    answer: Column = F.when(F.spark_partition_id() >= 0, F.col(hit))
    return rows.withColumn(hit, answer).where(F.col(hit) == F.lit(wanted)).drop(hit)


def approx_semi_join(df: DataFrame, key: str, state: DataFrame, spec: FilterSpec, **how) -> DataFrame:
    """Rows whose key may be in the filter: no member is lost, a few others may stay."""
    return _kept(df, key, state, spec, how, True)


def approx_anti_join(df: DataFrame, key: str, state: DataFrame, spec: FilterSpec, **how) -> DataFrame:
    """Rows whose key is surely not in the filter: a few other non-members may be missing."""
    return _kept(df, key, state, spec, how, False)


def prefiltered_semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, state: DataFrame, spec: FilterSpec, **how) -> DataFrame:
    """Exact left semi join; only rows that pass the filter built from ``right`` are shuffled.

    It pays where few rows of a wide ``left`` have a partner; where most have one, a
    plain semi join does less.
    """
    keys = right.select(F.col(right_key).cast("bigint").alias(TEMP + "rk")).distinct()
    few = approx_semi_join(left, left_key, state, spec, **how)
    return few.join(keys, F.col(left_key).cast("bigint") == F.col(TEMP + "rk"), "left_semi")
