"""Queries over the test tables, one per operator, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve import measure
from bitsieve.functions.hashing import mixing_table, seeds, string_key
from bitsieve.operators import joins, probe, state
from bitsieve.operators.filter import Filter
from bitsieve.plans import report
from bitsieve.plans.layout import SHARD, position_names, with_bucket, with_positions
from bitsieve.session import shared_folder
from bitsieve.sources import measures, state_io
from bitsieve.spec import FilterSpec, Variant

FLAT16 = FilterSpec(Variant.SYNC_BASIC, 16, 4)
FLAT20 = FilterSpec(Variant.BASIC, 20, 8)
BLOCKED16 = FilterSpec(Variant.SYNC_CACHE, 16, 4)
BLOCKED20 = FilterSpec(Variant.CACHE, 20, 8)
SHARDED20 = FilterSpec(Variant.PIM, 20, 4, nb_ranks=1)
SHARDED24 = FilterSpec(Variant.PIM, 24, 8, nb_ranks=8)
#: Members are the orders before this date; the rest give real negatives.
CUT = "1996-01-01"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp")).select(F.col("o_orderkey").alias("item"))


# SQL of the hash functions ---------------------------------------------------

M64 = "18446744073709551615::UHUGEINT"


def sql_hash64(source: str, item: str, outs: dict[str, int], keep: str = "*") -> str:
    """A SELECT that adds hash columns to ``source``, a step per nested SELECT."""

    def start(s: int) -> str:
        a = (s ^ (s << 7)) & ((1 << 64) - 1)
        x = f"{item}::UHUGEINT"
        c = f"xor(((({s << 11 & ((1 << 64) - 1)}::UHUGEINT) + xor({x}, {s >> 5}::UHUGEINT)) & {M64}), {M64})"
        return f"xor(xor({a}::UHUGEINT, ({x} * {s >> 3}::UHUGEINT) & {M64}), {c})"

    steps = [
        lambda h: f"(xor({h}, {M64}) + (({h} * 2097152::UHUGEINT) & {M64})) & {M64}",
        lambda h: f"xor({h}, {h} >> 24)",
        lambda h: f"({h} * 265::UHUGEINT) & {M64}",
        lambda h: f"xor({h}, {h} >> 14)",
        lambda h: f"({h} * 21::UHUGEINT) & {M64}",
        lambda h: f"xor({h}, {h} >> 28)",
        lambda h: f"({h} + (({h} * 2147483648::UHUGEINT) & {M64})) & {M64}",
    ]
    sql = f"SELECT {keep}, " + ", ".join(f"{start(s)} AS {o}" for o, s in outs.items()) + f" FROM ({source})"
    for f in steps:
        sql = "SELECT * REPLACE (" + ", ".join(f"{f(o)} AS {o}" for o in outs) + f") FROM ({sql})"
    return sql


def sql_fold16(x: str, i: int) -> str:
    y = f"({x}::BIGINT >> {i})"
    return f"(xor(xor({y}, {y} >> 16), xor({y} >> 32, {y} >> 48)) & 65535)"


def sql_positions(source: str, item: str, spec: FilterSpec) -> str:
    """Columns ``item``, ``shard`` and ``pos`` (a list), as BIGINT."""
    s, k = seeds(), spec.nb_hash
    if spec.layout == "flat":
        hashed = sql_hash64(source, item, {f"h{i}": s[i] for i in range(k)}, f"{item} AS item")
        pos = ", ".join(f"(h{i} & {(1 << spec.size2) - 1}::UHUGEINT)::BIGINT" for i in range(k))
        return f"SELECT item, 0 AS shard, [{pos}] AS pos FROM ({hashed})"
    hashed = sql_hash64(source, item, {"h0": s[0]}, f"{item} AS item")
    if spec.layout == "blocked":
        low = (1 << spec.block_size2) - 1
        t = "[" + ",".join(str(v & low) for v in mixing_table()) + "]"
        p0 = f"(h0 & {(1 << spec.size2) - 1}::UHUGEINT)::BIGINT"
        byte = lambda n: f"(({t})[((item::BIGINT >> {n}) & 255) + 1])"
        pos = ", ".join([p0, *(f"{p0} + xor({byte(i)}, {byte(i + 8)})" for i in range(1, k))])
        return f"SELECT item, 0 AS shard, [{pos}] AS pos FROM ({hashed})"
    rank = f"((h0 >> 32) * {spec.nb_ranks}) >> 32"
    unit = f"((h0 & 4294967295::UHUGEINT) * {spec.units_per_rank}) >> 32"
    place = f"((({rank})::BIGINT * {spec.units_per_rank} + ({unit})::BIGINT) * {spec.nb_subshards} + {sql_fold16('item', 0)} % {spec.nb_subshards})"
    p0 = f"(murmur & {(1 << spec.shard_size2) - 1})"
    pos = ", ".join([p0, *(f"({p0} // 8) * 8 + ({sql_fold16('item', i)} & 4095)" for i in range(1, k))])
    return f"SELECT item, {place} AS shard, [{pos}] AS pos FROM (SELECT *, {sql_murmur('item')} AS murmur FROM ({hashed}))"


def sql_murmur(x: str) -> str:
    """Murmur3 x86 32-bit at seed 0 of a non-negative key below 2^32, as eight little-endian bytes."""
    m = 4294967295
    rotl = lambda v, n: f"((({v}) << {n} & {m}) | (({v}) >> {32 - n}))"
    k1 = lambda v: f"({rotl(f'(({v}) * 3432918353 & {m})', 15)} * 461845907 & {m})"
    mix = lambda h, v: f"(({rotl(f'xor({h}, {k1(v)})', 13)} * 5 + 3864292196) & {m})"
    lo, hi = f"({x}::HUGEINT & {m})", f"(({x}::HUGEINT >> 32) & {m})"
    h = f"xor({mix(mix('0::HUGEINT', lo), hi)}, 8)"
    return (
        f"(SELECT xor(d, d >> 16)::BIGINT FROM (SELECT (c * 3266489909) & {m} AS d FROM (SELECT xor(b, b >> 13) AS c FROM (SELECT (a * 2246822507) & {m} AS b FROM (SELECT xor(h, h >> 16) AS a FROM (SELECT {h} AS h))))))"
    )


MEMBERS_SQL = f"SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{CUT} 00:00:00'"


def sql_bits(source: str, item: str, spec: FilterSpec) -> str:
    return f"SELECT DISTINCT shard, unnest(pos) AS p FROM ({sql_positions(source, item, spec)})"


def sql_hits(members_sql: str, key: str, probes_sql: str, probe_key: str, spec: FilterSpec) -> str:
    """Distinct probed keys (``item``) that the filter seems to hold."""
    probes = sql_positions(f"SELECT DISTINCT {probe_key} FROM ({probes_sql})", probe_key, spec)
    need = f"SELECT item, shard, unnest(list_distinct(pos)) AS p FROM ({probes})"
    return f"SELECT n.item FROM ({need}) n LEFT JOIN ({sql_bits(members_sql, key, spec)}) b ON n.shard = b.shard AND n.p = b.p GROUP BY n.item HAVING count(*) = count(b.p)"


# Queries -----------------------------------------------------------------------


def _weight(spec: FilterSpec, include_tail: bool = True):
    return lambda spark, d: state.weight(state.build(table(spark, d, "orders"), "o_orderkey", spec), spec, include_tail)


def _weight_sql(spec: FilterSpec, include_tail: bool = True) -> str:
    core = "" if include_tail else f" WHERE p < {1 << spec.shard_size2}"
    return f"SELECT count(*) AS weight FROM ({sql_bits('SELECT o_orderkey FROM orders', 'o_orderkey', spec)}){core}"


def _probe(spec: FilterSpec, strategy: str = "auto"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        words = state.build(members(spark, d), "item", spec)
        rows = probe.contains(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", words, spec, strategy=strategy)
        return rows.groupBy("hit").agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("key_sum"))

    return run


def _probe_sql(spec: FilterSpec) -> str:
    hits = sql_hits(MEMBERS_SQL, "o_orderkey", "SELECT l_orderkey FROM lineitem", "l_orderkey", spec)
    return f"SELECT hit, count(*) AS n_rows, sum(l_orderkey)::BIGINT AS key_sum FROM (SELECT l_orderkey, l_orderkey IN (SELECT item FROM ({hits})) AS hit FROM lineitem) GROUP BY hit"


def _no_false_negatives(spec: FilterSpec, strategy: str = "auto"):
    """Members and others together: how many of either the filter seems to hold."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        words = state.build(members(spark, d), "item", spec)
        orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderdate") < F.lit(CUT).cast("timestamp")).alias("member"))
        return probe.contains(orders, "item", words, spec, strategy=strategy).groupBy("member").agg(F.count("*").alias("n"), F.count_if(~F.col("hit")).alias("missed"))

    return run


def _no_false_negatives_sql(spec: FilterSpec) -> str:
    """Members have no miss by definition; what the others miss follows from the bits."""
    hits = sql_hits(MEMBERS_SQL, "o_orderkey", "SELECT o_orderkey FROM orders", "o_orderkey", spec)
    member = f"o_orderdate < TIMESTAMP '{CUT} 00:00:00'"
    return f"SELECT {member} AS member, count(*) AS n, count(*) FILTER (WHERE NOT ({member}) AND o_orderkey NOT IN (SELECT item FROM ({hits}))) AS missed FROM orders GROUP BY 1"


def _fpr(spec: FilterSpec, strategy: str = "auto"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        words = state.build(members(spark, d), "item", spec)
        others = table(spark, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("item"))
        return probe.false_positive_rate(others, "item", words, spec, strategy=strategy)

    return run


def _fpr_sql(spec: FilterSpec) -> str:
    others = "SELECT o_orderkey + 10000000 AS k FROM orders"
    hits = sql_hits(MEMBERS_SQL, "o_orderkey", others, "k", spec)
    return f"SELECT count(*) AS n, count(h.item) AS hits, avg((h.item IS NOT NULL)::INT::DOUBLE) AS fpr FROM ({others}) o LEFT JOIN ({hits}) h ON o.k = h.item"


def approx_semi_join(spark: SparkSession, d: str) -> DataFrame:
    words = state.build(members(spark, d), "item", FLAT16)
    rows = joins.approx_semi_join(table(spark, d, "lineitem"), "l_orderkey", words, FLAT16)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.sum("l_linenumber").alias("line_sum"))


def approx_anti_join(spark: SparkSession, d: str) -> DataFrame:
    words = state.build(members(spark, d), "item", FLAT16)
    rows = joins.approx_anti_join(table(spark, d, "lineitem"), "l_orderkey", words, FLAT16)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n_rows"), F.sum("l_linenumber").alias("line_sum"))


def exact_semi_join(spark: SparkSession, d: str) -> DataFrame:
    words = state.build(members(spark, d), "item", BLOCKED20)
    rows = joins.prefiltered_semi_join(table(spark, d, "lineitem"), members(spark, d), "l_orderkey", "item", words, BLOCKED20)
    return rows.groupBy("l_shipdate").agg(F.count("*").alias("n_rows"))


def idempotent_reinsert(spark: SparkSession, d: str) -> DataFrame:
    once = state.build(table(spark, d, "part"), "p_partkey", FLAT16)
    twice = state.merge(once, state.build(table(spark, d, "part").select("p_partkey"), "p_partkey", FLAT16))
    return state.weight(once, FLAT16).withColumnRenamed("weight", "once").join(state.weight(twice, FLAT16).withColumnRenamed("weight", "twice"))


def merge_equals_union(spark: SparkSession, d: str) -> DataFrame:
    a = state.build(table(spark, d, "part"), "p_partkey", FLAT16)
    b = state.build(table(spark, d, "supplier"), "s_suppkey", FLAT16)
    return state.weight(state.merge(a, b), FLAT16)


def intersection_weight(spark: SparkSession, d: str) -> DataFrame:
    a = state.build(table(spark, d, "part"), "p_partkey", FLAT16)
    b = state.build(table(spark, d, "customer"), "c_custkey", FLAT16)
    return state.weight(state.intersect(a, b), FLAT16)


def weight_by_shard(spark: SparkSession, d: str) -> DataFrame:
    return state.weight_by_shard(state.build(table(spark, d, "customer"), "c_custkey", SHARDED20), SHARDED20)


def shard_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = with_positions(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", SHARDED24)
    return rows.groupBy(F.col(SHARD).alias("shard")).agg(F.count("*").alias("n_rows"))


def position_sums(spec: FilterSpec):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = with_positions(table(spark, d, "customer").select("c_custkey"), "c_custkey", spec)
        return rows.select(F.col("c_custkey").alias("item"), F.col(SHARD).cast("bigint").alias("shard"), sum(F.col(n) for n in position_names(spec)).alias("pos_sum"))

    return run


def position_sums_sql(spec: FilterSpec) -> str:
    return f"SELECT item, shard::BIGINT AS shard, list_sum(pos)::BIGINT AS pos_sum FROM ({sql_positions('SELECT c_custkey FROM customer', 'c_custkey', spec)})"


def bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = with_bucket(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", FLAT16)
    return rows.groupBy("bucket").agg(F.count("*").alias("n_rows"))


def word_histogram(spark: SparkSession, d: str) -> DataFrame:
    words = state.build(table(spark, d, "orders"), "o_orderkey", FLAT16)
    return words.groupBy(F.bit_count("word").cast("bigint").alias("bits")).agg(F.count("*").alias("n_words"))


def roundtrip_weight(spark: SparkSession, d: str) -> DataFrame:
    """Packed bytes out and in again."""
    words = state.build(table(spark, d, "part"), "p_partkey", BLOCKED16)
    return state.weight(state_io.from_bytes(state_io.to_bytes(words, BLOCKED16), BLOCKED16), BLOCKED16)


def saved_weight(spark: SparkSession, d: str) -> DataFrame:
    """Saved to the shared folder and loaded again."""
    path = f"{shared_folder(spark)}/saved_filter/{uuid.uuid4().hex}"
    Filter(spark, FLAT20).insert_bulk(table(spark, d, "part"), "p_partkey").save(path)
    f = Filter.load(spark, path, FLAT20)
    return state.weight(f.words, f.spec)


def order_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every probed row with its answer, duplicates and other columns kept."""
    words = state.build(members(spark, d), "item", FLAT16)
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return probe.contains(rows, "o_orderkey", words, FLAT16)


def perf_report_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    base = [F.lit("insert").alias("id"), F.col("l_linenumber").alias("k"), (F.col("l_orderkey") % 5).cast("int").alias("size2"), F.lit(1000).cast("bigint").alias("nb_items")]
    a = rows.select(F.col("l_quantity").alias("duration"), *base, F.when(F.col("l_suppkey") % 2 == 0, 6).otherwise(8).alias("nb_ranks"))
    b = rows.where("l_returnflag = 'R'").select(F.col("l_quantity").alias("duration"), *base)
    return report.slice_of(report.compare(a, b), "insert")


def string_key_filter(spark: SparkSession, d: str) -> DataFrame:
    """URLs as keys, those of even pages as members; at 2^24 bits the rate of false positives is below 10^-9."""
    spec = FilterSpec(Variant.SYNC_BASIC, 24, 8)
    pages = table(spark, d, "pages").select("page_id", "url", string_key(F.col("url")).alias("item"))
    rows = probe.contains(pages, "item", state.build(pages.where("page_id % 2 = 0"), "item", spec), spec)
    return rows.agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def fpr_events_users(spark: SparkSession, d: str) -> DataFrame:
    words = state.build(table(spark, d, "customer"), "c_custkey", FLAT16)
    users = table(spark, d, "events").select((F.col("user_id") + 1_000_000).alias("item"))
    return probe.false_positive_rate(users, "item", words, FLAT16)


def _fpr_events_sql() -> str:
    others = "SELECT user_id + 1000000 AS k FROM events"
    hits = sql_hits("SELECT c_custkey FROM customer", "c_custkey", others, "k", FLAT16)
    return f"SELECT count(*) AS n, count(h.item) AS hits, avg((h.item IS NOT NULL)::INT::DOUBLE) AS fpr FROM ({others}) o LEFT JOIN ({hits}) h ON o.k = h.item"


def _specs(rows: list[tuple[str, int, int, int, int]]) -> list[tuple]:
    """(variant, size2, nb_hash, nb_threads, nb_ranks) of each, and whether such a filter can be made."""
    out = []
    for variant, size2, k, threads, ranks in rows:
        try:
            FilterSpec(Variant(variant), size2, k, threads, nb_ranks=ranks)
            out.append((variant, size2, k, threads, ranks, True))
        except ValueError:
            out.append((variant, size2, k, threads, ranks, False))
    return out


def create_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which parameters a filter can be created with, by size, hashes, threads and ranks."""
    rows = [(v.value, size2, k, threads, ranks) for v in Variant for size2 in (2, 3, 9, 12, 16, 24, 33, 34, 62, 63) for k in (0, 1, 8, 9, 10, 63, 64) for threads in (1, 8) for ranks in (0, 1, 8)]
    return spark.createDataFrame(_specs(rows), "variant STRING, size2 INT, nb_hash INT, nb_threads INT, nb_ranks INT, ok BOOLEAN")


CREATE_CHECKS_SQL = """
WITH p AS (SELECT * FROM (VALUES ('SYNC_BASIC'), ('BASIC'), ('SYNC_CACHE'), ('CACHE'), ('PIM')) v(variant), (VALUES (2), (3), (9), (12), (16), (24), (33), (34), (62), (63)) s(size2),
  (VALUES (0), (1), (8), (9), (10), (63), (64)) k(nb_hash), (VALUES (1), (8)) t(nb_threads), (VALUES (0), (1), (8)) r(nb_ranks))
SELECT variant, size2, nb_hash, nb_threads, nb_ranks, size2 BETWEEN 3 AND 62 AND nb_hash >= 1 AND CASE WHEN variant = 'PIM'
  THEN nb_ranks >= 1 AND nb_hash <= 63 AND size2 >= 3 + ceil(log2(greatest(nb_ranks, 1) * 1024)) AND size2 <= 21 + floor(log2(greatest(nb_ranks, 1) * 1024))
  ELSE nb_hash < 10 AND (nb_threads = 1 OR variant LIKE 'SYNC%') END AS ok FROM p
"""


def factory_threads(spark: SparkSession, d: str) -> DataFrame:
    """What the factory makes of a name and a number of threads: single-thread variants are given one."""
    import warnings

    rows = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for v in Variant:
            for threads in (1, 2, 8):
                spec = FilterSpec.create(v.value, 24, 4, threads, nb_ranks=2)
                rows.append((v.value, threads, spec.nb_threads, spec.layout, spec.nb_hash, spec.nb_shards))
    return spark.createDataFrame(rows, "variant STRING, asked INT, nb_threads INT, layout STRING, nb_hash INT, nb_shards INT")


FACTORY_SQL = """
SELECT variant, asked, CASE WHEN variant IN ('BASIC', 'CACHE') THEN 1 ELSE asked END AS nb_threads,
  CASE WHEN variant LIKE '%BASIC' THEN 'flat' WHEN variant LIKE '%CACHE' THEN 'blocked' ELSE 'sharded' END AS layout, 4 AS nb_hash, CASE WHEN variant = 'PIM' THEN 2 * 64 * 16 ELSE 1 END AS nb_shards
FROM (VALUES ('SYNC_BASIC'), ('BASIC'), ('SYNC_CACHE'), ('CACHE'), ('PIM')) v(variant), (VALUES (1), (2), (8)) t(asked)
"""


def number_of_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The number of hash functions that a filter reports is the most bits that one item sets."""
    rows = [(v.value, k, f.nb_hash, f.insert(4711).weight()) for v in (Variant.SYNC_BASIC, Variant.PIM) for k in (1, 4, 8) for f in [Filter.create(spark, v, 24, k, nb_ranks=8)]]
    return spark.createDataFrame(rows, "variant STRING, k INT, nb_hash INT, weight BIGINT")


def _number_of_hashes_sql() -> str:
    one = "SELECT 4711 AS i"
    part = lambda v, k: f"SELECT '{v.value}' AS variant, {k} AS k, {k} AS nb_hash, count(*) AS weight FROM ({sql_bits(one, 'i', FilterSpec(v, 24, k, nb_ranks=8))})"
    return " UNION ALL ".join(part(v, k) for v in (Variant.SYNC_BASIC, Variant.PIM) for k in (1, 4, 8))


def topology(spark: SparkSession, d: str) -> DataFrame:
    """Ranks and units of sharded filters, and how many units hold bits of the parts."""
    rows = []
    for ranks in (1, 2, 8):
        f = Filter.create(spark, Variant.PIM, 24, 4, nb_ranks=ranks).insert_bulk(table(spark, d, "part"), "p_partkey")
        used = f.weight_by_shard().select(F.floor(F.col("shard") / f.spec.nb_subshards)).distinct().count()
        rows.append((f.topology["nb_ranks"], f.topology["units_per_rank"], f.topology["nb_units"], used))
    return spark.createDataFrame(rows, "nb_ranks INT, units_per_rank INT, nb_units INT, used BIGINT")


def _topology_sql() -> str:
    part = lambda r: f"SELECT {r} AS nb_ranks, 64 AS units_per_rank, {64 * r} AS nb_units, count(DISTINCT shard // 16) AS used FROM ({_bits_of('part', 'p_partkey', FilterSpec(Variant.PIM, 24, 4, nb_ranks=r))})"
    return " UNION ALL ".join(map(part, (1, 2, 8)))


def destroyed_weight(spark: SparkSession, d: str) -> DataFrame:
    """A filter that was kept in memory and let go of: what it held can still be computed, and nothing stays cached."""
    f = Filter(spark, FLAT16).insert_bulk(table(spark, d, "part"), "p_partkey").persist()
    before = f.weight()
    f.unpersist()
    level = f.words.storageLevel
    return spark.createDataFrame([(before, f.weight(), level.useMemory or level.useDisk)], "before BIGINT, after BIGINT, cached BOOLEAN")


#: Keys that are put in, and asked for, one at a time.
SINGLES, ASKED = (3, 5, 70_000, 123_456_789), (3, 4, 5, 6, 70_000, 70_001, 123_456_789)
TINY = FilterSpec(Variant.SYNC_CACHE, 6, 2)


def single_items(spark: SparkSession, d: str) -> DataFrame:
    """One item at a time in and out, in a filter so small that some that aren't in it seem to be."""
    f = Filter(spark, TINY)
    for x in SINGLES:
        f = f.insert(x)
    f = f.persist()
    rows = [(x, f.contains(x)) for x in ASKED]
    f.unpersist()
    return spark.createDataFrame(rows, "item BIGINT, hit BOOLEAN")


def _single_items_sql() -> str:
    values = lambda xs: "SELECT unnest([" + ", ".join(map(str, xs)) + "])::BIGINT AS i"
    return f"SELECT i AS item, i IN (SELECT item FROM ({sql_hits(values(SINGLES), 'i', values(ASKED), 'i', TINY)})) AS hit FROM ({values(ASKED)})"


def sharded_export(spark: SparkSession, d: str) -> DataFrame:
    """The exported bytes of a sharded filter that aren't zero."""
    data = state_io.to_bytes(state.build(table(spark, d, "part"), "p_partkey", SHARDED24), SHARDED24)
    pairs = F.posexplode(F.sequence(F.lit(0), F.length("data") - 1)).alias("at", "i")
    rows = data.select("shard", "chunk", "data", pairs).select("shard", (F.col("chunk") * state_io.CHUNK_BYTES + F.col("at")).alias("at"), F.conv(F.hex(F.substring("data", F.col("i") + 1, F.lit(1))), 16, 10).cast("int").alias("byte"))
    return rows.where("byte <> 0")


def sharded_import(spark: SparkSession, d: str) -> DataFrame:
    """Bits of a sharded filter after export and import: their number and the sum of their places, by shard."""
    words = state.build(table(spark, d, "customer"), "c_custkey", SHARDED24)
    back = state_io.from_bytes(state_io.to_bytes(words, SHARDED24), SHARDED24)
    bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("getbit", F.col("word"), b) == 1))
    return back.select("shard", "word_idx", bits.alias("b")).groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.col("word_idx") * 64 + F.col("b")).alias("places"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as measurements of 1 to 50 seconds."""
    rows = table(spark, d, "lineitem")
    return rows.select(F.col("l_quantity").alias("duration"), F.when(F.col("l_returnflag") == "R", "fpr").otherwise("insert").alias("id"), F.col("l_linenumber").alias("k"), (F.col("l_orderkey") % 5).cast("int").alias("size2"), F.lit(1000).cast("bigint").alias("nb_items"))


MEASURED_SQL = "SELECT l_quantity AS duration, CASE WHEN l_returnflag = 'R' THEN 'fpr' ELSE 'insert' END AS id, l_linenumber AS k, (l_orderkey % 5)::INT AS size2, 1000::BIGINT AS nb_items FROM lineitem"


def measures_csv(spark: SparkSession, d: str) -> DataFrame:
    """Appended to a CSV folder without a header twice, and read under the schema."""
    path = f"{shared_folder(spark)}/measures/{uuid.uuid4().hex}"
    for ident in ("fpr", "insert"):
        measures.append_measures(_measured(spark, d).where(F.col("id") == ident), path)
    return measures.read_measures(spark, path, measures.BLOCKED_SCHEMA).groupBy("id", "k", "size2", "nb_items").agg(F.count("*").alias("n"), F.sum("duration").alias("total"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    rows = _measured(spark, d)
    sharded = rows.where("duration > 10").withColumn("nb_ranks", F.when(F.col("duration") % 2 == 0, 6).otherwise(8))
    return report.compare(sharded, rows)


REPORT_SQL = (
    f"WITH r AS ({MEASURED_SQL}), a AS (SELECT id, k, size2, nb_items, CASE WHEN duration % 2 = 0 THEN 6 ELSE 8 END AS nb_ranks, avg(duration) AS sharded FROM r WHERE duration > 10 GROUP BY ALL), "
    "b AS (SELECT id, k, size2, nb_items, avg(duration) AS blocked FROM r GROUP BY ALL) "
)


def report_rates(spark: SparkSession, d: str) -> DataFrame:
    """The slice of rates, without the speedup, which means nothing for them."""
    return report.slice_of(_report(spark, d), "fpr")


def report_formatted(spark: SparkSession, d: str) -> DataFrame:
    """Seconds and rates as text."""
    rows, names = _report(spark, d), ["id", "k", "size2", "nb_items", "nb_ranks", "sharded", "blocked"]
    return report.formatted(rows, "insert").select(names).union(report.formatted(rows, "fpr").select(names))


def report_clipped(spark: SparkSession, d: str) -> DataFrame:
    return report.clipped(report.slice_of(_report(spark, d), "insert"), "speedup", 0.8, 0.95)


def sequence_items(spark: SparkSession, d: str) -> DataFrame:
    return measures.sequence(spark, 1000, 500)


def shuffled_items(spark: SparkSession, d: str) -> DataFrame:
    """Keys in the order that the seed fixes, with their places."""
    rows = measures.shuffled(measures.sequence(spark, 2000, 7), 42).withColumn("at", F.monotonically_increasing_id())
    from pyspark.sql import Window

    return rows.select("item", F.row_number().over(Window.orderBy("at")).alias("place"))


def timed_actions(spark: SparkSession, d: str) -> DataFrame:
    """A row for each timed action and each value, under the parameters; the time itself is only known not to be negative."""
    rec = measures.Recorder(spark, k=4, size2=16, nb_items=table(spark, d, "part").count())
    with rec.timed("insert"):
        f = Filter(spark, FLAT16).insert_bulk(table(spark, d, "part"), "p_partkey")
        weight = f.weight()
    rec.value("weight", weight)
    value = F.when(F.col("id") == "insert", F.least("duration", F.lit(0.0))).otherwise(F.col("duration"))
    return rec.frame().select("id", "k", "size2", "nb_items", value.alias("value"))


def measured_by_command(spark: SparkSession, d: str) -> DataFrame:
    """The command line's measurements, appended to a CSV: one row for each figure, and the rate of false positives."""
    path = f"{shared_folder(spark)}/measures/{uuid.uuid4().hex}"
    measure.main(["-t", "SYNC_CACHE", "-k", "2", "-m", "12", "-n", "300", "-l", path], show=False)
    rows = measures.read_measures(spark, path, measures.BLOCKED_SCHEMA)
    return rows.select("id", "k", "size2", "nb_items", F.when(F.col("id") == "fpr", F.round("duration", 9)).alias("rate"))


def _measured_by_command_sql() -> str:
    spec = FilterSpec(Variant.SYNC_CACHE, 12, 2)
    others = "SELECT unnest(range(300, 100300)) AS i"
    hits = sql_hits("SELECT unnest(range(300)) AS i", "i", others, "i", spec)
    names = ", ".join(f"('{n}')" for n in ("init", "insert", "weight", "lookup", "get_data", "set_data", "fpr"))
    return f"SELECT id, 2 AS k, 12 AS size2, 300::BIGINT AS nb_items, CASE WHEN id = 'fpr' THEN round((SELECT count(*) FROM ({hits})) / 100000, 9) END AS rate FROM (VALUES {names}) v(id)"


def merged_export(spark: SparkSession, d: str) -> DataFrame:
    """A filter that was written and read, and more items put into it after that."""
    path = f"{shared_folder(spark)}/saved_filter/{uuid.uuid4().hex}"
    Filter(spark, FLAT16).insert_bulk(table(spark, d, "part"), "p_partkey").save(path)
    f = Filter.load(spark, path, FLAT16).insert_bulk(table(spark, d, "supplier"), "s_suppkey")
    return state.weight(f.words, f.spec)


def _bits_of(t: str, c: str, spec: FilterSpec) -> str:
    return sql_bits(f"SELECT {c} FROM {t}", c, spec)


def catalogue() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    """Query name -> (query, SQL)."""
    semi = sql_hits(MEMBERS_SQL, "o_orderkey", "SELECT l_orderkey FROM lineitem", "l_orderkey", FLAT16)
    flag = "SELECT l_returnflag, count(*) AS n_rows, sum(l_linenumber)::BIGINT AS line_sum FROM lineitem WHERE l_orderkey {} (SELECT item FROM ({})) GROUP BY 1"
    part = _bits_of("part", "p_partkey", FLAT16)
    out = {
        "flat_weight_orders": (_weight(FLAT16), _weight_sql(FLAT16)),
        "flat_weight_k8": (_weight(FLAT20), _weight_sql(FLAT20)),
        "blocked_weight": (_weight(BLOCKED16), _weight_sql(BLOCKED16)),
        "sharded_weight": (_weight(SHARDED20), _weight_sql(SHARDED20)),
        "sharded_core_weight": (_weight(SHARDED20, False), _weight_sql(SHARDED20, False)),
        "flat_probe_lineitem": (_probe(FLAT16), _probe_sql(FLAT16)),
        "flat_probe_join": (_probe(FLAT20, "join"), _probe_sql(FLAT20)),
        "blocked_probe": (_probe(BLOCKED16), _probe_sql(BLOCKED16)),
        "blocked_probe_join": (_probe(BLOCKED20, "join"), _probe_sql(BLOCKED20)),
        "sharded_probe": (_probe(SHARDED20), _probe_sql(SHARDED20)),
        "sharded_probe_join": (_probe(SHARDED24, "join"), _probe_sql(SHARDED24)),
        "no_false_negatives": (_no_false_negatives(FLAT16), _no_false_negatives_sql(FLAT16)),
        "no_false_negatives_blocked": (_no_false_negatives(BLOCKED16), _no_false_negatives_sql(BLOCKED16)),
        "no_false_negatives_sharded": (_no_false_negatives(SHARDED20), _no_false_negatives_sql(SHARDED20)),
        "fpr_flat": (_fpr(FLAT16), _fpr_sql(FLAT16)),
        "fpr_blocked": (_fpr(BLOCKED16), _fpr_sql(BLOCKED16)),
        "fpr_sharded": (_fpr(SHARDED20), _fpr_sql(SHARDED20)),
        "fpr_events_users": (fpr_events_users, _fpr_events_sql()),
        "approx_semi_join": (approx_semi_join, flag.format("IN", semi)),
        "approx_anti_join": (approx_anti_join, flag.format("NOT IN", semi)),
        "exact_semi_join": (exact_semi_join, f"SELECT l_shipdate, count(*) AS n_rows FROM lineitem WHERE l_orderkey IN ({MEMBERS_SQL}) GROUP BY 1"),
        "idempotent_reinsert": (idempotent_reinsert, f"SELECT count(*) AS once, count(*) AS twice FROM ({part})"),
        "merge_equals_union": (merge_equals_union, f"SELECT count(*) AS weight FROM ({part} UNION {_bits_of('supplier', 's_suppkey', FLAT16)})"),
        "intersection_weight": (intersection_weight, f"SELECT count(*) AS weight FROM ({part} INTERSECT {_bits_of('customer', 'c_custkey', FLAT16)})"),
        "weight_by_shard": (weight_by_shard, f"SELECT shard::INT AS shard, count(*) AS weight FROM ({_bits_of('customer', 'c_custkey', SHARDED20)}) GROUP BY 1"),
        "shard_histogram": (shard_histogram, f"SELECT shard::INT AS shard, count(*) AS n_rows FROM ({sql_positions('SELECT l_orderkey FROM lineitem', 'l_orderkey', SHARDED24)}) GROUP BY 1"),
        "flat_positions": (position_sums(FLAT20), position_sums_sql(FLAT20)),
        "blocked_positions": (position_sums(BLOCKED20), position_sums_sql(BLOCKED20)),
        "sharded_positions": (position_sums(SHARDED24), position_sums_sql(SHARDED24)),
        "bucket_histogram": (bucket_histogram, f"SELECT (pos[1] // 256)::INT AS bucket, count(*) AS n_rows FROM ({sql_positions('SELECT o_orderkey FROM orders', 'o_orderkey', FLAT16)}) GROUP BY 1"),
        "word_bitcount_histogram": (word_histogram, f"SELECT bits, count(*) AS n_words FROM (SELECT p // 64 AS w, count(*) AS bits FROM ({_bits_of('orders', 'o_orderkey', FLAT16)}) GROUP BY 1) GROUP BY 1"),
        "roundtrip_weight": (roundtrip_weight, f"SELECT count(*) AS weight FROM ({_bits_of('part', 'p_partkey', BLOCKED16)})"),
        "saved_weight": (saved_weight, f"SELECT count(*) AS weight FROM ({_bits_of('part', 'p_partkey', FLAT20)})"),
        "order_kept": (order_kept, f"SELECT o_custkey, o_orderkey, o_orderkey IN (SELECT item FROM ({sql_hits(MEMBERS_SQL, 'o_orderkey', 'SELECT o_orderkey FROM orders', 'o_orderkey', FLAT16)})) AS hit FROM orders"),
        "perf_report_join": (
            perf_report_join,
            "WITH r AS (SELECT l_quantity AS duration, 'insert' AS id, l_linenumber AS k, (l_orderkey % 5)::INT AS size2, 1000::BIGINT AS nb_items, CASE WHEN l_suppkey % 2 = 0 THEN 6 ELSE 8 END AS nb_ranks, l_returnflag FROM lineitem), "
            "a AS (SELECT id, k, size2, nb_items, nb_ranks, avg(duration) AS sharded FROM r GROUP BY ALL), b AS (SELECT id, k, size2, nb_items, avg(duration) AS blocked FROM r WHERE l_returnflag = 'R' GROUP BY ALL) "
            "SELECT a.*, b.blocked, b.blocked / nullif(a.sharded, 0) AS speedup FROM a LEFT JOIN b USING (id, k, size2, nb_items)",
        ),
        "string_key_filter": (string_key_filter, "SELECT count(*) AS n, count(*) FILTER (WHERE url IN (SELECT url FROM pages WHERE page_id % 2 = 0)) AS hits FROM pages"),
        "create_checks": (create_checks, CREATE_CHECKS_SQL),
        "factory_threads": (factory_threads, FACTORY_SQL),
        "number_of_hashes": (number_of_hashes, _number_of_hashes_sql()),
        "topology": (topology, _topology_sql()),
        "destroyed_weight": (destroyed_weight, f"SELECT count(*) AS before, count(*) AS after, false AS cached FROM ({part})"),
        "single_items": (single_items, _single_items_sql()),
        "sharded_export": (sharded_export, f"SELECT shard::INT AS shard, (p // 8)::BIGINT AS at, sum(1 << (p % 8)::INT)::INT AS byte FROM ({_bits_of('part', 'p_partkey', SHARDED24)}) GROUP BY 1, 2"),
        "sharded_import": (sharded_import, f"SELECT shard::INT AS shard, count(*) AS n, sum(p)::BIGINT AS places FROM ({_bits_of('customer', 'c_custkey', SHARDED24)}) GROUP BY 1"),
        "measures_csv": (measures_csv, f"SELECT id, k, size2, nb_items, count(*) AS n, sum(duration) AS total FROM ({MEASURED_SQL}) GROUP BY ALL"),
        "report_rates": (report_rates, REPORT_SQL + "SELECT a.*, b.blocked FROM a LEFT JOIN b USING (id, k, size2, nb_items) WHERE id = 'fpr'"),
        "report_formatted": (
            report_formatted,
            REPORT_SQL + "SELECT id, k, size2, nb_items, nb_ranks, CASE WHEN id = 'fpr' THEN format('{:.5f}', sharded) ELSE format('{:.3f} s', sharded) END AS sharded, "
            "CASE WHEN id = 'fpr' THEN format('{:.5f}', blocked) ELSE format('{:.3f} s', blocked) END AS blocked FROM a LEFT JOIN b USING (id, k, size2, nb_items)",
        ),
        "report_clipped": (report_clipped, REPORT_SQL + "SELECT a.*, b.blocked, least(greatest(b.blocked / nullif(a.sharded, 0), 0.8), 0.95) AS speedup FROM a LEFT JOIN b USING (id, k, size2, nb_items) WHERE id = 'insert'"),
        "sequence_items": (sequence_items, "SELECT unnest(range(500, 1500))::BIGINT AS item"),
        "shuffled_items": (shuffled_items, "SELECT i AS item, row_number() OVER (ORDER BY md5('42:' || i))::INT AS place FROM (SELECT unnest(range(7, 2007))::BIGINT AS i)"),
        "timed_actions": (timed_actions, f"SELECT id, 4::BIGINT AS k, 16::BIGINT AS size2, (SELECT count(*) FROM part) AS nb_items, CASE WHEN id = 'insert' THEN 0.0::DOUBLE ELSE (SELECT count(*) FROM ({part}))::DOUBLE END AS value FROM (VALUES ('insert'), ('weight')) v(id)"),
        "measured_by_command": (measured_by_command, _measured_by_command_sql()),
        "flat_probe_chunks": (_no_false_negatives(FLAT16, "chunks"), _no_false_negatives_sql(FLAT16)),
        "blocked_probe_chunks": (_no_false_negatives(BLOCKED16, "chunks"), _no_false_negatives_sql(BLOCKED16)),
        "sharded_probe_chunks": (_no_false_negatives(SHARDED20, "chunks"), _no_false_negatives_sql(SHARDED20)),
        "merged_export": (merged_export, f"SELECT count(*) AS weight FROM (({part}) UNION ({_bits_of('supplier', 's_suppkey', FLAT16)}))"),
    }
    return out
