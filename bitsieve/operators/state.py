"""Filter state: sparse 64-bit words in a DataFrame, built and merged with bit_or."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.functions.u64 import srl
from bitsieve.plans.layout import SHARD, with_positions, word_masks
from bitsieve.spec import FilterSpec

STATE_SCHEMA = "shard INT, word_idx BIGINT, word BIGINT"
#: Words in one chunk, and their logarithm: 4 KB.
CHUNK_WORDS, CHUNK_SHIFT = 512, 9


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE_SCHEMA)


def build(df: DataFrame, item: str, spec: FilterSpec, dispatch=None, onto: DataFrame | None = None) -> DataFrame:
    """Words set by the items, and by those of the filter ``onto``; null items are skipped.

    Partial bit_or runs before the exchange, so an item that repeats any number of
    times moves one word per task at most. Old words and new bits meet in that one
    aggregation.
    """
    df = with_positions(df.select(F.col(item).alias("item")).where("item IS NOT NULL"), "item", spec, dispatch)
    masks = word_masks(df, [], spec).select(F.col(SHARD).alias("shard"), F.col("w").alias("word_idx"), F.col("m").alias("word"))
    return _or(masks if onto is None else masks.unionByName(onto))


def _or(words: DataFrame) -> DataFrame:
    return words.groupBy("shard", "word_idx").agg(F.bit_or("word").alias("word"))


def merge(*states: DataFrame) -> DataFrame:
    """Union of filters of one spec: the items of all."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return _or(out)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits set in both: holds all common items, maybe more than a filter built from them."""
    b = b.select("shard", "word_idx", F.col("word").alias("other"))
    out = a.join(b, ["shard", "word_idx"]).select("shard", "word_idx", F.col("word").bitwiseAND(F.col("other")).alias("word"))
    return out.where("word <> 0")


def weight(state: DataFrame, spec: FilterSpec, include_tail: bool = True) -> DataFrame:
    """One row, ``weight``: bits set. Without the tail, the overhang of shard windows is left out."""
    return _core(state, spec, include_tail).agg(F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("bigint").alias("weight"))


def weight_by_shard(state: DataFrame, spec: FilterSpec, include_tail: bool = True) -> DataFrame:
    return _core(state, spec, include_tail).groupBy("shard").agg(F.sum(F.bit_count("word")).cast("bigint").alias("weight"))


def _core(state: DataFrame, spec: FilterSpec, include_tail: bool) -> DataFrame:
    if include_tail:
        return state
    bits = 1 << spec.shard_size2
    if bits >= 64:
        return state.where(F.col("word_idx") < bits // 64)
    return state.where("word_idx = 0").withColumn("word", F.col("word").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")))


def fill_ratio(state: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row: ``weight``, ``bits`` and their ``ratio``."""
    bits = F.lit(spec.total_bits).cast("bigint")
    return weight(state, spec).select("weight", bits.alias("bits"), (F.col("weight") / bits).alias("ratio"))


def chunks_per_shard(spec: FilterSpec) -> int:
    return -(-spec.words_per_shard // CHUNK_WORDS)


def chunk_number(shard: Column, word_idx: Column, spec: FilterSpec) -> Column:
    """Number of a word's chunk among those of all shards."""
    return shard.cast("bigint") * F.lit(chunks_per_shard(spec)).cast("bigint") + srl(word_idx, CHUNK_SHIFT)


def chunks(state: DataFrame, spec: FilterSpec, overhang: int = 0) -> DataFrame:
    """(chunk BIGINT, words ARRAY<BIGINT>): runs of 512 words with their zeros, and the ``overhang`` words after each.

    Runs without a bit are left out. Sparse words become dense arrays in numpy: Spark
    has no aggregate that puts values at their places.
    """
    at = (F.col("word_idx") % CHUNK_WORDS).cast("int")
    number = chunk_number(F.col("shard"), F.col("word_idx"), spec)
    places = F.array(F.struct(number.alias("chunk"), at.alias("at")))
    if overhang:
        before = F.struct((number - 1).alias("chunk"), (at + CHUNK_WORDS).alias("at"))
        places = F.when((at < overhang) & (F.col("word_idx") >= CHUNK_WORDS), F.array(F.struct(number.alias("chunk"), at.alias("at")), before)).otherwise(places)
    rows = state.select(F.inline(places), "word").repartition("chunk").sortWithinPartitions("chunk")
    width = CHUNK_WORDS + overhang

    def lists(keys: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        words = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * block.shape[1]), pa.array(block.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(keys), words], names=["chunk", "words"])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, np.zeros(width, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            number, at, word = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            keys, row = np.unique(number, return_inverse=True)
            block = np.zeros((len(keys), width), np.int64)
            np.bitwise_or.at(block, (row, at), word)
            if held == keys[0]:
                block[0] |= last
            elif held is not None:
                yield lists(np.array([held]), last[None])
            yield lists(keys[:-1], block[:-1])
            held, last = int(keys[-1]), block[-1]
        if held is not None:
            yield lists(np.array([held]), last[None])

    return rows.mapInArrow(dense, "chunk BIGINT, words ARRAY<BIGINT>")

