"""Benchmark decontamination, with DataFrame functions only.

The benchmark's distinct windows of words are a set of hashes, which goes to every task
where its size allows. A document's windows are hashed as they are scanned and looked up
in the set; where one is found, its words are compared with the window's, so a hit is
verified word by word. A set that is too large meets the documents' windows in a
shuffle, of which each row is a document's number, a place and a hash; what is found
there is joined back to the documents to be verified.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import ascii_lower, table
from bitsieve.session import cut

WINDOW = 13
#: Bytes of windows that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words: runs of ASCII letters, digits and all other characters above ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def window_hash(hashes: Column, start: Column, length: int) -> Column:
    """Of the window of word hashes that starts there; null where it doesn't end in the array.

    Plain array look-ups and exclusive ors, which compile into the scan's own code.
    """
    return reduce(lambda a, b: a.bitwiseXOR(b), [F.shiftleft(F.get(hashes, start + i), i) for i in range(length)])


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """(h, len, gram, items): hash, length and words of the distinct windows, and the sorted ids of their items."""
    w = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1)))
    w = w.select("item", "words", F.explode(starts).alias("i")).select("item", F.slice("words", F.col("i"), n).alias("gram"))
    w = w.groupBy("gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    w = w.withColumns({"hashes": F.transform("gram", lambda x: F.xxhash64(x)), "len": F.size("gram")})
    own = reduce(lambda rest, k: F.when(F.col("len") == k, window_hash(F.col("hashes"), F.lit(0), k)).otherwise(rest), range(1, n), window_hash(F.col("hashes"), F.lit(0), n))
    return w.select(own.alias("h"), "len", "gram", "items")


def _scanned(rows: DataFrame, keep: list[str], lengths: list[int]) -> DataFrame:
    """Rows with ``hashes`` of words -> the kept columns, pos, len and h: a row for each window of each length, and one of each text without words."""
    rows = rows.select(*keep, "hashes", F.posexplode_outer("hashes").alias("pos", "x"))
    found = [F.struct(F.lit(k).alias("len"), window_hash(F.col("hashes"), F.col("pos"), k).alias("h")) for k in lengths]
    if len(found) > 1:
        return rows.select(*keep, "pos", F.inline(F.array(*found)))
    return rows.select(*keep, "pos", found[0]["len"].alias("len"), found[0]["h"].alias("h"))


def contamination(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = WINDOW, keep: list[str] = ()) -> DataFrame:
    """One row per row: doc_id, n_words, n_hit, items (sorted ids), spans (merged, in words), contaminated.

    Null and empty texts have no words and are clean; texts of any length are scanned
    whole; rows that repeat an id, and those without one, are judged each by itself;
    null items and items without words match nothing; an empty benchmark matches
    nothing. Other columns than ``keep`` are ignored.
    """
    grams = windows(benchmark, n=n)
    size = grams.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", " ")) + 8 * F.size("gram"))).first()[0] or 0
    lengths = sorted(r.len for r in grams.select("len").distinct().collect()) or [n]
    rows = df.select(F.col(doc_id).alias("doc_id"), *keep, F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    found = _hits_by_broadcast(rows, grams, lengths, keep) if size <= BROADCAST_BYTES else _hits_by_shuffle(rows, grams, lengths, keep)
    return _judged(found, keep)


def _hits_by_broadcast(rows: DataFrame, grams: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """(doc_id, kept columns, n_words, hits, items) of each row; a row moves once, with its hits."""
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("hashes", F.transform("words", lambda x: F.xxhash64(x)))
    rows = _scanned(rows, ["doc_id", *keep, "row", "words"], lengths)
    grams = grams.select(F.col("h").alias("gh"), F.col("len").alias("gl"), "gram", "items")
    rows = rows.join(F.broadcast(grams), (F.col("h") == F.col("gh")) & (F.col("len") == F.col("gl")), "left")
    hit = F.col("gram").isNotNull() & (F.slice("words", F.col("pos") + 1, F.col("len")) == F.col("gram"))
    # One row stays of each document, whether it has hits or not.
    rows = rows.where(F.col("pos").isNull() | (F.col("pos") == 0) | hit)
    span = F.when(hit, F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end")))
    return rows.groupBy("row").agg(
        F.any_value("doc_id").alias("doc_id"),
        *[F.any_value(c).alias(c) for c in keep],
        F.max(F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0))).cast("bigint").alias("n_words"),
        F.array_sort(F.collect_set(span)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )


def _hits_by_shuffle(rows: DataFrame, grams: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """The same for a set of any size. The rows are written with their numbers; (row, len, pos, h) meet the set."""
    rows = cut(rows)
    scanned = _scanned(rows.select("row", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("hashes")), ["row"], lengths)
    met = scanned.where("h IS NOT NULL").join(grams, ["h", "len"]).groupBy("row").agg(F.collect_list(F.struct("pos", "len", "gram", "items")).alias("met"))
    words = words_of(F.col("text"))
    rows = rows.join(met, "row", "left").withColumn("words", words)
    sure = F.filter(F.coalesce("met", F.array().cast(met.schema["met"].dataType)), lambda m: F.slice("words", m["pos"] + 1, m["len"]) == m["gram"])
    rows = rows.withColumn("met", sure)
    return rows.select(
        "row",
        "doc_id",
        *keep,
        F.greatest(F.coalesce(F.size("words"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_words"),
        F.array_sort(F.array_distinct(F.transform("met", lambda m: F.struct(m["pos"].alias("start"), (m["pos"] + m["len"]).alias("end"))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("met", lambda m: m["items"])))).alias("items"),
    )


def _judged(out: DataFrame, keep: list[str]) -> DataFrame:
    """Hits merged to spans, and the contract's rule on their words."""
    start = F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("done"), F.lit(None).cast("struct<start:int,end:int>").alias("open"))

    def add(acc: Column, x: Column) -> Column:
        joins = x["start"] <= acc["open"]["end"]
        wider = F.struct(acc["open"]["start"].alias("start"), F.greatest(acc["open"]["end"], x["end"]).alias("end"))
        grown = F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(joins, acc["done"]).otherwise(grown).alias("done"), F.when(joins, wider).otherwise(x).alias("open"))

    merged = F.aggregate("hits", start, add, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    out = out.withColumn("spans", merged)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]).cast("bigint"))
    out = out.withColumn("n_hit", n_hit)
    return out.select("doc_id", *keep, "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that are clean, all columns kept; null, empty and repeated ones as in :func:`contamination`."""
    names = {c: f"__{i}" for i, c in enumerate(df.columns)}
    inner = df.select(*[F.col(f"`{c}`").alias(v) for c, v in names.items()])
    out = contamination(inner, benchmark, names[doc_id], names[text], keep=list(names.values()))
    return out.where(~F.col("contaminated")).select(*[F.col(v).alias(c) for c, v in names.items()])


def op7_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    rows = contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items.alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT p.r, p.i, p.n, g.item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
h AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS at FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
