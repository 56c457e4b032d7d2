"""The filter as one object: a spec and a lazy state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.functions.u64 import signed
from bitsieve.operators import joins, probe, state
from bitsieve.sources import state_io
from bitsieve.spec import FilterSpec, Variant


class Filter:
    """Immutable: inserting returns a new filter. Nothing runs until an answer is asked for."""

    def __init__(self, spark: SparkSession, spec: FilterSpec, words: DataFrame | None = None, dispatch=None) -> None:
        self.spark, self.spec, self.dispatch, self.is_new = spark, spec, dispatch, words is None
        self.words = state.empty(spark) if words is None else words

    @classmethod
    def create(cls, spark: SparkSession, variant: Variant | str, size2: int, nb_hash: int, nb_threads: int = 1, dispatch=None, **more) -> Filter:
        return cls(spark, FilterSpec.create(variant, size2, nb_hash, nb_threads, **more), dispatch=dispatch)

    def _with(self, words: DataFrame) -> Filter:
        return Filter(self.spark, self.spec, words, self.dispatch)

    def insert_bulk(self, df: DataFrame, item: str = "item") -> Filter:
        return self._with(state.build(df, item, self.spec, self.dispatch, None if self.is_new else self.words))

    def insert(self, item: int) -> Filter:
        return self.insert_bulk(self._one(item))

    def contains_bulk(self, df: DataFrame, item: str = "item", out: str = probe.HIT, strategy: str = "auto") -> DataFrame:
        return probe.contains(df, item, self.words, self.spec, out, strategy, self.dispatch)

    def contains(self, item: int) -> bool:
        return self.contains_bulk(self._one(item)).first()[probe.HIT]

    def _one(self, item: int) -> DataFrame:
        return self.spark.createDataFrame([(signed(item),)], "item BIGINT")

    def weight(self, include_tail: bool = True) -> int:
        return state.weight(self.words, self.spec, include_tail).first()["weight"]

    def weight_by_shard(self, include_tail: bool = True) -> DataFrame:
        return state.weight_by_shard(self.words, self.spec, include_tail)

    def fpr(self, df: DataFrame, item: str = "item", strategy: str = "auto") -> float:
        return probe.false_positive_rate(df, item, self.words, self.spec, strategy=strategy, dispatch=self.dispatch).first()["fpr"]

    def true_count(self, df: DataFrame, item: str = "item") -> int:
        return self.contains_bulk(df, item).agg(F.count_if(F.col(probe.HIT)).alias("n")).first()["n"]

    def union(self, other: Filter) -> Filter:
        return self._with(state.merge(self.words, self._like(other).words))

    def intersection(self, other: Filter) -> Filter:
        return self._with(state.intersect(self.words, self._like(other).words))

    def _like(self, other: Filter) -> Filter:
        if not self.spec.same_bits(other.spec):
            raise ValueError("the filters have different parameters")
        return other

    def semi_join(self, df: DataFrame, key: str, strategy: str = "auto") -> DataFrame:
        return joins.approx_semi_join(df, key, self.words, self.spec, strategy=strategy, dispatch=self.dispatch)

    def anti_join(self, df: DataFrame, key: str, strategy: str = "auto") -> DataFrame:
        return joins.approx_anti_join(df, key, self.words, self.spec, strategy=strategy, dispatch=self.dispatch)

    def persist(self) -> Filter:
        return self._with(self.words.persist())

    def unpersist(self) -> None:
        self.words.unpersist()

    @property
    def nb_hash(self) -> int:
        return self.spec.nb_hash

    @property
    def topology(self) -> dict[str, int]:
        """Units and ranks of a sharded filter, tasks that Spark runs at once."""
        return {"nb_units": self.spec.nb_units, "nb_ranks": self.spec.nb_ranks, "units_per_rank": self.spec.units_per_rank, "parallelism": self.spark.sparkContext.defaultParallelism}

    def save(self, path: str, mode: str = "errorifexists") -> None:
        state_io.save(self.words, self.spec, path, mode)

    @classmethod
    def load(cls, spark: SparkSession, path: str, expected: FilterSpec | None = None, dispatch=None) -> Filter:
        spec, words = state_io.load(spark, path, expected)
        return cls(spark, spec, words, dispatch)

    def get_data(self) -> DataFrame:
        """Binary export: (shard, chunk, bytes), least significant bit first, in order."""
        return state_io.to_bytes(self.words, self.spec)

    def set_data(self, data: DataFrame) -> Filter:
        return self._with(state_io.from_bytes(data, self.spec))
