"""Which bits an item sets, for each layout, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsieve.functions.hashing import fastrange32, fold16, mix16, murmur32, seeds, with_hash64
from bitsieve.functions.u64 import lit64, srl, wrapping
from bitsieve.spec import BLOCKED, FLAT, SHARD_WINDOW_BITS, FilterSpec

#: Prefix of the columns that with_positions adds and callers drop again.
TEMP = "__bs_"
SHARD = TEMP + "shard"
ITEM = "item"


def numbered(df: DataFrame, item: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ..., and the item as BIGINT last; and the names it had.

    So no column that an operator adds meets one of the caller's, whatever it is called.
    """
    key = F.col(f"`{item}`" if item in df.columns else item).cast("bigint")
    names = df.columns
    return df.withColumn("__bs_in" + "_" * max(map(len, names), default=0), key).toDF(*[f"c{i}" for i in range(len(names))], ITEM), names


def renamed(rows: DataFrame, names: list[str], last: str) -> DataFrame:
    """The columns under the names they had, and ``last``, which takes the place of one of that name."""
    kept = [(f"c{i}", n) for i, n in enumerate(names) if n != last]
    return rows.select(*[c for c, _ in kept], F.col(TEMP + "out")).toDF(*[n for _, n in kept], last)


def position_names(spec: FilterSpec) -> list[str]:
    return [f"{TEMP}p{i}" for i in range(spec.nb_hash)]


def with_positions(df: DataFrame, item: str, spec: FilterSpec, dispatch=None) -> DataFrame:
    """Add the shard (INT) and one BIGINT position per hash function.

    ``dispatch``, a Column -> Column function giving a unit number, replaces the
    default placement of items on the units of a sharded filter.
    A null item has null positions.
    """
    s, names = seeds(), position_names(spec)
    with wrapping(df.sparkSession):
        df = df.withColumn(TEMP + "x", F.col(item).cast("bigint"))
        x = F.col(TEMP + "x")
        if spec.layout == FLAT:
            df = with_hash64(df, TEMP + "x", {n: s[i] for i, n in enumerate(names)})
            mask = lit64((1 << spec.size2) - 1)
            df = df.withColumns({n: F.col(n).bitwiseAND(mask) for n in names} | {SHARD: F.lit(0)})
        elif spec.layout == BLOCKED:
            df = with_hash64(df, TEMP + "x", {names[0]: s[0]})
            df = df.withColumns({names[0]: F.col(names[0]).bitwiseAND(lit64((1 << spec.size2) - 1)), SHARD: F.lit(0)})
            df = df.withColumns({n: F.col(names[0]) + mix16(x, i, spec.block_size2) for i, n in enumerate(names) if i})
        else:
            df = with_hash64(df, TEMP + "x", {TEMP + "h": s[0]})
            df = df.withColumns({SHARD: shard(x, F.col(TEMP + "h"), spec, dispatch), names[0]: murmur32(x).bitwiseAND(lit64((1 << spec.shard_size2) - 1))})
            df = df.withColumn(names[0], F.when(x.isNotNull(), F.col(names[0])))
            start = F.shiftleft(srl(F.col(names[0]), 3), 3)
            window = lit64(SHARD_WINDOW_BITS - 1)
            df = df.withColumns({n: start + fold16(x, i).bitwiseAND(window) for i, n in enumerate(names) if i}).drop(TEMP + "h")
        return df.drop(TEMP + "x")


def shard(x: Column, h0: Column, spec: FilterSpec, dispatch=None) -> Column:
    """Rank by the high half of the hash, unit by the low half, sub-shard by the folded item."""
    rank = fastrange32(srl(h0, 32), spec.nb_ranks)
    unit = fastrange32(h0.bitwiseAND(lit64(0xFFFFFFFF)), spec.units_per_rank)
    place = dispatch(x) if dispatch else rank * spec.units_per_rank + unit
    return (place * spec.nb_subshards + fold16(x, 0) % spec.nb_subshards).cast("int")


def bit(pos: Column) -> Column:
    return F.call_function("shiftleft", lit64(1), pos.bitwiseAND(lit64(63)).cast("int"))


def word_index(pos: Column) -> Column:
    return srl(pos, 6)


def word_masks(rows: DataFrame, keep: list[str], spec: FilterSpec) -> DataFrame:
    """A row for each word that a row's item needs: the kept columns, shard, ``w`` (word) and ``m`` (its bits).

    In the blocked layout all of an item's bits lie in two words at most, and are
    put together before rows are made of them; elsewhere each bit is a row.
    """
    names = position_names(spec)
    if spec.layout == BLOCKED:
        first = word_index(F.col(names[0]))
        part = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [F.when(word_index(F.col(p)) == w, bit(F.col(p))).otherwise(lit64(0)) for p in names])
        pairs = F.array(F.struct(first.alias("w"), part(first).alias("m")), F.struct((first + 1).alias("w"), part(first + 1).alias("m")))
        return rows.select(*keep, SHARD, F.inline(pairs)).where("m <> 0")
    rows = rows.select(*keep, SHARD, F.explode(F.array(*names)).alias("p"))
    return rows.select(*keep, SHARD, word_index(F.col("p")).alias("w"), bit(F.col("p")).alias("m"))


#: Leading bits of an item's first position that name its bucket.
BUCKET_BITS = 8


def with_bucket(df: DataFrame, item: str, spec: FilterSpec, out: str = "bucket", bits: int = BUCKET_BITS) -> DataFrame:
    """Add the bucket (INT) of the item's first position: ``repartition`` by it puts items that touch the same words together.

    Filters of less than ``bits`` bits have a bucket for each position. Builds and probes
    don't need it, as their shuffles are by word; it serves own per-partition work.
    """
    rows, names = numbered(df, item)
    rows = with_positions(rows, ITEM, spec)
    first = F.col(position_names(spec)[0])
    return renamed(rows.withColumn(TEMP + "out", srl(first, max(0, spec.shard_size2 - bits)).cast("int")), names, out)
