"""Mixing sources to target weights, with DataFrame functions only.

Every row has a pseudo-random key from its id and text. Within a source the rows stand
in the order of that key; a source gives its first words in that order, up to its
budget, after as many whole epochs as the budget holds. Prefix sums are two-level:
the key's leading bits are a range of the order, ranges are summed and accumulated
first, and rows are accumulated inside their range. So no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitsieve.llm.common import SPACE, SPACE_CHARS, table, word_count
from bitsieve.session import cut

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows of a table that one hex digit of the key, the name of a range, is taken for; and the least digits.
RANGE_ROWS, RANGE_DIGITS = 100_000_000, 3
#: Ranges, with what their sources give, that are broadcast at most.
BROADCAST_RANGES = 200_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also ``target``: words that the source gives.

    Sources in code point order, null last, take the weights in turn. What a
    source can't give in ``max_epochs`` epochs is shared out again by weight. The
    table has a row per source, which is why its windows need no partitioning.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    rows = sizes.withColumns({"w": w, "cap": F.col("source_size") * max_epochs, "at": F.row_number().over(order)})
    # In order of cap / w the capped sources come first; share is what is left for a unit of weight if all before are capped.
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    rows = rows.withColumn("share", F.col("left") / F.col("left_w"))
    # The first source that isn't capped fixes the share of all after it.
    fits = F.when(F.col("share") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "at", "share"))
    rows = rows.withColumn("share", F.min(fits).over(everything)["share"])
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("share") * F.col("w")).alias("target"))


def _keyed(doc_id: Column, text: Column, source: Column, seed: int) -> dict[str, Column]:
    """Columns ``size``, ``key`` and ``src``: a source's name that isn't null."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return {"size": word_count(text), "key": key, "src": _named(source)}


def _named(source: Column) -> Column:
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def _digits(n: int) -> int:
    """Hex digits that name a range: more rows, more ranges; what comes out is the same."""
    digits = RANGE_DIGITS
    while digits < 8 and n > RANGE_ROWS * 16 ** (digits - RANGE_DIGITS):
        digits += 1
    return digits


def _ranges(narrow: DataFrame, digits: int, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, src, size, key) -> (src, range, start, source_size, target): what lies before each range, and its source's goal."""
    ranges = cut(narrow.groupBy("source", "src", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("range_size")))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    goals = targets(sizes, weights, max_epochs).select(_named(F.col("source")).alias("src"), "source_size", "target")
    upto = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("src", "range", F.coalesce(F.sum("range_size").over(upto), F.lit(0)).alias("start"))
    return cut(starts.join(goals, "src"))


def _taken(rows: DataFrame, starts: DataFrame, digits: int) -> DataFrame:
    """Rows with ``src``, ``size``, ``key`` and ``id`` -> also source_size, target, taken. Rows move once, to their range."""
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    inside = Window.partitionBy("src", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside))
    # Ranges are few at most sizes; else they meet the rows where these are.
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_RANGES else starts
    out = rows.join(starts, ["src", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("start") + F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", rest))
    return out.withColumn("taken", taken.cast("bigint"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """One row per row: doc_id, source, size, source_size, target, taken.

    Null and empty texts have size 0 and give 0 words; texts of any length are counted
    whole; a null source is a source of its own; rows without an id are ordered by
    their texts; repeated rows count each. An empty table gives an empty table. Other
    columns are ignored.
    """
    d, t, s = F.col(doc_id), F.col(text), F.col(source)
    rows = cut(df.select(d.alias("id"), s.alias("source"), *[c.alias(n) for n, c in _keyed(d, t, s, seed).items()]))
    digits = _digits(rows.count())
    out = _taken(rows, _ranges(rows, digits, weights, max_epochs), digits)
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """The mix itself: rows with all columns of ``df``, each as often as it is taken.

    A document that a budget cuts keeps its first words, with their spacing. Texts
    without a word are never taken. A row is counted and taken by itself, however many
    others are equal to it; whole rows go through the windows, so none is looked up
    again. The sizes are a pass of their own over the texts; whole rows move once. An
    empty table gives an empty table.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    at = {n: F.col(names[df.columns.index(n)]) for n in (doc_id, text, source)}
    rows = df.toDF(*names).withColumns(_keyed(at[doc_id], at[text], at[source], seed) | {"id": at[doc_id]})
    digits = _digits(df.count())
    starts = _ranges(rows.select(at[source].alias("source"), "src", "size", "key"), digits, weights, max_epochs)
    rows = _taken(rows, starts, digits).where("taken > 0")
    copies = F.transform(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("bigint")), lambda e: F.least(F.col("size"), F.col("taken") - (e - 1) * F.col("size")))
    rows = rows.select(*names, "size", F.explode(copies).alias("part"))
    # The text up to the end of its last word that is taken.
    pieces = F.regexp_extract_all(at[text], F.lit(f"([{SPACE}]*[^{SPACE}]+)"), F.lit(1))
    short = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    whole = F.when(F.col("part") >= F.col("size"), at[text]).otherwise(short)
    return rows.select(*[whole.alias(n) if n == names[df.columns.index(text)] else F.col(n) for n in names]).toDF(*df.columns)


def op8_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents")).drop("source")


OP8_SQL = r"""
WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS nr, source_size * 3 AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER o, 0))::BIGINT AS rest, ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0))::BIGINT AS rest_w
      FROM w WINDOW o AS (ORDER BY cap / w, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT rest / rest_w AS share FROM l WHERE rest / rest_w * w <= cap ORDER BY cap / w, nr LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT share FROM f) * w) AS target FROM w),
p AS (SELECT r.doc_id, r.size, t.source_size, t.target, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS before,
      CASE WHEN t.source_size > 0 THEN floor(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
