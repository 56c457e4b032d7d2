"""Measurement files: CSV without a header, read with an explicit schema, appended by a timer."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDED_SCHEMA = "duration DOUBLE, id STRING, k INT, size2 INT, nb_items BIGINT, nb_ranks INT"
BLOCKED_SCHEMA = "duration DOUBLE, id STRING, k INT, size2 INT, nb_items BIGINT"


def read_measures(spark: SparkSession, path: str, schema: str = SHARDED_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).csv(path)


def append_measures(df: DataFrame, path: str) -> None:
    df.write.mode("append").csv(path)


class Recorder:
    """Times actions and keeps a row for each; without parameters nothing is kept."""

    def __init__(self, spark: SparkSession, **params: int) -> None:
        self.spark, self.params, self.rows = spark, params, []

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.value(name, time.perf_counter() - began)

    def value(self, name: str, value: float) -> None:
        if self.params:
            self.rows.append((float(value), name, *self.params.values()))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, "duration DOUBLE, id STRING, " + ", ".join(f"{k} BIGINT" for k in self.params))


def sequence(spark: SparkSession, n: int, start: int = 0) -> DataFrame:
    """Items start..start+n-1."""
    return spark.range(start, start + n).select(F.col("id").alias("item"))


def shuffled(df: DataFrame, seed: int = 42) -> DataFrame:
    """The rows in a pseudo-random order that the seed fixes; any column may be null."""
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *values).cast("binary")))
