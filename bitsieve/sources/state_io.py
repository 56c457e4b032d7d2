"""Filters at rest: a folder with the words and the spec, or rows of packed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.operators.state import CHUNK_WORDS, chunks, chunks_per_shard
from bitsieve.spec import SPEC_SCHEMA, FilterSpec

#: Bytes in one row of the binary export.
CHUNK_BYTES = CHUNK_WORDS * 8


def save(state: DataFrame, spec: FilterSpec, path: str, mode: str = "errorifexists") -> None:
    """Words as Parquet under ``path/words``, the spec as one row under ``path/spec``."""
    state.select("shard", "word_idx", "word").write.mode(mode).parquet(f"{path}/words")
    state.sparkSession.createDataFrame([spec.as_row()], SPEC_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/spec")


def load(spark: SparkSession, path: str, expected: FilterSpec | None = None) -> tuple[FilterSpec, DataFrame]:
    row = spark.read.parquet(f"{path}/spec").first()
    spec = FilterSpec(**row.asDict())
    if expected is not None and not spec.same_bits(expected):
        raise ValueError("the saved filter has other parameters")
    return spec, spark.read.parquet(f"{path}/words")


def to_bytes(state: DataFrame, spec: FilterSpec) -> DataFrame:
    """(shard INT, chunk BIGINT, data BINARY): bytes with the least significant bit first.

    Chunks of 4096 bytes; those without a bit set are left out. Sort by shard and
    chunk for the order of a flat file.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").tobytes()
            rows = [data[i : i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["chunk", "data"])

    n = chunks_per_shard(spec)
    rows = chunks(state, spec).mapInArrow(pack, "chunk BIGINT, data BINARY")
    return rows.select(F.expr(f"CAST(chunk DIV {n} AS INT)").alias("shard"), (F.col("chunk") % n).cast("bigint").alias("chunk"), "data")


def from_bytes(data: DataFrame, spec: FilterSpec) -> DataFrame:
    """Inverse of :func:`to_bytes`; bytes past the filter's end are refused by an error at run time."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards, numbers, words = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for shard, chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = raw.as_py()
                word = np.frombuffer(raw + bytes(-len(raw) % 8), "<i8")
                at = np.flatnonzero(word)
                shards.append(np.full(len(at), shard, np.int32))
                numbers.append(at + chunk * CHUNK_WORDS)
                words.append(word[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shards, numbers, words)], names=["shard", "word_idx", "word"])

    rows = data.select("shard", "chunk", "data").mapInArrow(unpack, "shard INT, word_idx BIGINT, word BIGINT")
    ok = F.col("word_idx") < spec.words_per_shard
    return rows.select("shard", F.when(ok, F.col("word_idx")).otherwise(F.raise_error("the data is longer than the filter").cast("bigint")).alias("word_idx"), "word")
