"""Probing: is an item in the filter? A column for small states, joins with chunks of words for larger ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitsieve.operators.state import CHUNK_WORDS, chunk_number, chunks
from bitsieve.plans.layout import ITEM, SHARD, TEMP, bit, numbered, position_names, renamed, with_positions, word_index, word_masks
from bitsieve.session import cut
from bitsieve.spec import BLOCKED, FLAT, SHARD_WINDOW_BITS, FilterSpec

#: Largest filter whose words are one array in every task: 2^25 bits are 4 MB.
BROADCAST_BITS = 1 << 25
#: Largest filter whose chunks are broadcast to executors: 2^30 bits, which are 128 MB, and an eighth for shards' windows.
CHUNK_BROADCAST_BITS = 9 << 27
HIT = "hit"
#: Words beyond a chunk's end that an item whose first bit is in the chunk may reach.
OVERHANG = {FLAT: 0, BLOCKED: 1, "sharded": SHARD_WINDOW_BITS // 64}


def contains(df: DataFrame, item: str, state: DataFrame, spec: FilterSpec, out: str = HIT, strategy: str = "auto", dispatch=None) -> DataFrame:
    """Add a boolean column: true if the filter may hold the item, false if it can't; null for a null item.

    Rows, duplicates and other columns are kept, whatever their names. ``strategy``:

    * ``broadcast``: all words are one array in every task; up to 2^25 bits.
    * ``chunks``: chunks of 4 KB are broadcast and looked up by their number; up to 2^30 bits. Rows stay where they are.
      In the flat layout, whose items meet a chunk for each bit, the chunks are written at once, when this is called.
    * ``join``: any size. Where an item's bits lie in one chunk (all layouts but the flat one), rows meet their
      chunk in one shuffle; else distinct items meet their words, and rows their item's answer.
    * ``auto`` takes the first that the filter's size allows.
    """
    if strategy == "auto":
        strategy = "broadcast" if spec.total_bits <= BROADCAST_BITS else "chunks" if spec.total_bits <= CHUNK_BROADCAST_BITS else "join"
    bound = {"broadcast": BROADCAST_BITS, "chunks": CHUNK_BROADCAST_BITS, "join": spec.total_bits}.get(strategy)
    if bound is None:
        raise ValueError(f"no strategy {strategy!r}")
    if spec.total_bits > bound:
        raise ValueError(f"the filter is too large for strategy={strategy!r}; use 'join'")
    rows, names = numbered(df, item)
    if strategy == "broadcast":
        rows = _by_array(rows, state, spec, dispatch)
    elif strategy == "chunks":
        rows = _by_chunks(rows, state, spec, dispatch, F.broadcast)
    elif spec.layout == FLAT:
        rows = _by_words(rows, state, spec, dispatch)
    else:
        rows = _by_chunks(rows, state, spec, dispatch, lambda x: x)
    return renamed(rows, names, out)


def dense(state: DataFrame, spec: FilterSpec) -> DataFrame:
    """One row with all words in order, zeros included. At most BROADCAST_BITS / 64 words are gathered."""
    slots = state.select((F.col("shard") * F.lit(spec.words_per_shard).cast("bigint") + F.col("word_idx")).alias("slot"), "word")
    every = state.sparkSession.range(spec.total_bits // 64).select(F.col("id").alias("slot"))
    rows = every.join(slots, "slot", "left").select("slot", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "word"))), lambda x: x["word"]).alias("words"))


def _tests(positions: list[Column], words: Column, first_word: Column) -> Column:
    """Whether all bits are set in ``words``, whose first one is number ``first_word``; a word that isn't there is 0."""
    found = [F.coalesce(F.get(words, (word_index(p) - first_word).cast("int")), F.lit(0).cast("bigint")) for p in positions]
    # One test after another: the first zero bit ends it.
    return reduce(lambda a, b: a & b, [w.bitwiseAND(bit(p)) != 0 for w, p in zip(found, positions, strict=True)])


def _by_array(rows: DataFrame, state: DataFrame, spec: FilterSpec, dispatch) -> DataFrame:
    rows = with_positions(rows, ITEM, spec, dispatch)
    words = dense(state, spec).scalar()
    base = F.col(SHARD).cast("bigint") * F.lit(spec.words_per_shard).cast("bigint")
    tests = [F.get(words, (base + word_index(F.col(p))).cast("int")).bitwiseAND(bit(F.col(p))) != 0 for p in position_names(spec)]
    return rows.withColumn(TEMP + "out", reduce(lambda a, b: a & b, tests))


def _by_chunks(rows: DataFrame, state: DataFrame, spec: FilterSpec, dispatch, send) -> DataFrame:
    """Rows meet the chunk of their first bit, or in the flat layout the chunk of each bit in turn."""
    out, chunk, key = TEMP + "out", TEMP + "chunk", TEMP + "key"
    kept = rows.columns
    rows = with_positions(rows, ITEM, spec, dispatch)
    names = position_names(spec)
    groups = [[n] for n in names] if spec.layout == FLAT else [names]
    data = chunks(state, spec, OVERHANG[spec.layout])
    if len(groups) > 1:
        # Written once: the joins then share one broadcast, where each would make the chunks anew.
        data = cut(data)
    right = send(data.select(F.col("chunk").alias(chunk), F.col("words").alias(TEMP + "words")))
    rows = rows.withColumn(out, F.lit(True))
    for own in groups:
        first = word_index(F.col(own[0]))
        # Null items match no chunk; their rows needn't meet in one task for it.
        number = F.coalesce(chunk_number(F.col(SHARD), first, spec), -1 - F.spark_partition_id().cast("bigint"))
        rows = rows.withColumn(key, number).join(right, F.col(key) == F.col(chunk), "left")
        begin = first - first % CHUNK_WORDS
        rows = rows.withColumn(out, F.col(out) & _tests([F.col(p) for p in own], F.col(TEMP + "words"), begin)).drop(chunk, key, TEMP + "words")
    return rows.select(*kept, out)


def _by_words(rows: DataFrame, state: DataFrame, spec: FilterSpec, dispatch) -> DataFrame:
    """Distinct items are probed, so a key that holds a third of all rows is looked up once; null items meet nobody."""
    out = TEMP + "out"
    known = rows.where(F.col(ITEM).isNotNull())
    items = with_positions(known.select(F.col(ITEM).alias("x")).distinct(), "x", spec, dispatch)
    need = word_masks(items, ["x"], spec)
    words = state.select(F.col("shard").alias(SHARD), F.col("word_idx").alias("w"), "word")
    found = need.join(words, [SHARD, "w"], "left")
    ok = F.coalesce("word", F.lit(0).cast("bigint")).bitwiseAND(F.col("m")) == F.col("m")
    found = found.groupBy("x").agg(F.bool_and(ok).alias(out))
    answered = known.join(found, known[ITEM] == found["x"], "left").drop("x")
    return answered.union(rows.where(F.col(ITEM).isNull()).withColumn(out, F.lit(None).cast("boolean")))


def false_positive_rate(df: DataFrame, item: str, state: DataFrame, spec: FilterSpec, **how) -> DataFrame:
    """One row over known non-members: ``n``, ``hits`` and the rate ``fpr``."""
    hit = F.col(HIT).cast("int")
    return contains(df.select(item), item, state, spec, **how).agg(F.count(HIT).alias("n"), F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("hits"), F.avg(hit.cast("double")).alias("fpr"))
