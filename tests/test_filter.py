"""Invariants of a filter, for every variant and configuration, and exact weights where the hashes fix them."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitsieve import Filter, FilterSpec
from bitsieve.functions import hashing
from bitsieve.functions.u64 import from_decimal, signed, to_decimal, wrapping
from bitsieve.operators import state
from bitsieve.sources.measures import sequence, shuffled

SIZES = [(24, 1), (24, 8), (16, 1), (16, 4)]
#: All names by all sizes, eight threads asked for; the sharded one with one rank and with eight.
CASES = [(v, {}, *s) for v in ("BASIC", "SYNC_BASIC", "CACHE", "SYNC_CACHE") for s in SIZES] + [("PIM", {"nb_ranks": r}, *s) for r in (1, 8) for s in SIZES]


@pytest.mark.filterwarnings("ignore:.*one thread")
@pytest.mark.parametrize("variant,more,size2,k", CASES)
def test_invariants(spark, variant, more, size2, k):
    items, others = sequence(spark, 10_000), sequence(spark, 1_000, 10_000)
    f = Filter.create(spark, variant, size2, k, 8, **more)
    assert f.weight() == 0
    one = f.insert(1).persist()
    assert 0 < one.weight() <= k and one.contains(1)
    assert one.insert(1).weight() == one.weight()
    full = one.insert_bulk(items).persist()
    assert full.true_count(shuffled(items)) == 10_000
    fpr = full.fpr(others)
    assert fpr <= (0.5 if variant == "PIM" else 0.2)
    for ids in ([1, 10_000_000], [10_000_000, 1]):
        rows = full.contains_bulk(spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "item BIGINT, n INT")).collect()
        assert len(rows) == 2 and all(r.hit for r in rows if r.item == 1) and all(ids[r.n] == r.item for r in rows)
    back = Filter(spark, f.spec).set_data(full.get_data())
    assert back.weight() == full.weight() and back.true_count(items) == 10_000
    full.unpersist()


@pytest.mark.parametrize("size2,k,weight,hits", [(24, 1, 9995, 1), (24, 8, 79811, 0), (16, 1, 9240, 133), (16, 4, 29789, 55)])
def test_flat_weights(spark, size2, k, weight, hits):
    f = Filter.create(spark, "SYNC_BASIC", size2, k).insert_bulk(sequence(spark, 10_000))
    assert f.weight() == weight
    assert f.true_count(sequence(spark, 1_000, 10_000)) == hits


@pytest.mark.parametrize("ranks,size2,k,core,all_bits,hits", [(1, 24, 8, 76908, 79430, 0), (1, 16, 1, 9301, 9301, 150), (8, 16, 4, 9390, 39245, 0)])
def test_sharded_weights(spark, ranks, size2, k, core, all_bits, hits):
    f = Filter.create(spark, "PIM", size2, k, nb_ranks=ranks).insert_bulk(sequence(spark, 10_000)).persist()
    assert f.weight(False) == core and f.weight() == all_bits
    assert f.contains_bulk(sequence(spark, 1_000, 10_000), strategy="join").where("hit").count() == hits
    assert f.weight_by_shard().agg(F.sum("weight")).first()[0] == all_bits
    f.unpersist()


@pytest.mark.parametrize("variant,size2", [("SYNC_BASIC", 17), ("SYNC_CACHE", 17), ("PIM", 17), ("PIM", 22)])
def test_strategies_agree(spark, variant, size2):
    """Over several chunks of words; with null items, repeated rows, and columns named like those that operators add."""
    f = Filter.create(spark, variant, size2, 4, nb_ranks=1, units_per_rank=4).insert_bulk(sequence(spark, 8_000)).persist()
    probes = sequence(spark, 20_000).union(sequence(spark, 10)).union(spark.createDataFrame([(None,)] * 5, "item BIGINT"))
    clash = ["__bs_p0", "__bs_shard", "__bs_out", "__bs_in", "chunk", "c0", "x", "hit"]
    probes = probes.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    found = {s: f.contains_bulk(probes, strategy=s).collect() for s in ("broadcast", "chunks", "join")}
    rows = [r.asDict() for r in found["join"]]
    assert len(rows) == 20_015 and all(r[c] == i for r in rows for i, c in enumerate(clash[:-1]))
    assert sum(r["hit"] is None for r in rows) == 5 and 8_010 <= sum(bool(r["hit"]) for r in rows) < 20_010
    assert sorted(map(str, found["broadcast"])) == sorted(map(str, found["chunks"])) == sorted(map(str, found["join"]))
    kept = f.semi_join(probes, "item")
    assert kept.columns == probes.columns and kept.count() + f.anti_join(probes, "item").count() == 20_010
    f.unpersist()


def test_plans(spark):
    """One exchange of words per insert; a probe by chunks moves no row of the probed table."""
    f = Filter.create(spark, "SYNC_CACHE", 28, 8).insert_bulk(sequence(spark, 1_000))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(f.words).count("Exchange hashpartitioning") == 1
    assert plan(Filter(spark, f.spec, f.words.persist()).insert_bulk(sequence(spark, 5)).words).split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1
    probed = plan(f.contains_bulk(sequence(spark, 50)))
    assert "BroadcastHashJoin" in probed and "SortMergeJoin" not in probed
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    by_join = plan(f.contains_bulk(sequence(spark, 50), strategy="join"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in by_join and "hashpartitioning(__bs_key" in by_join and by_join.count("HashAggregate(") == 2
    f.words.unpersist()


def test_hash_model(spark):
    ids = [0, 1, 2, 9999, 10000, (1 << 64) - 1]
    df = spark.createDataFrame([(signed(i),) for i in ids], "x BIGINT")
    with wrapping(spark):
        out = hashing.with_hash64(df, "x", {"h0": hashing.seeds()[0], "h1": hashing.seeds()[1]}).select("*", hashing.murmur32(F.col("x")).alias("m"), hashing.fold16(F.col("x"), 1).alias("f"))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    rows = out.collect()
    for i, r in zip(ids, rows):
        assert r.h0 == signed(hashing.hash64(i, hashing.seeds()[0])) and r.h1 == signed(hashing.hash64(i, hashing.seeds()[1])) and r.f == hashing.fold16_model(i, 1)
    assert rows[0].h0 == 0x5F3945CF2D9FBF27 and [r.m for r in rows] == [0x63852AFC, 0x53075D44, 0xC61FA2F4, 0xDA016E9C, 0x6A68630A, 0x627564E8]


def test_high_items(spark):
    rows = spark.sql("SELECT explode(array(0BD, 9223372036854775807BD, 9223372036854775808BD, 18446744073709551615BD)) AS d")
    items = rows.select(from_decimal(F.col("d")).alias("item"), "d")
    assert items.where(to_decimal(F.col("item")) != F.col("d")).count() == 0
    for v in ("SYNC_BASIC", "SYNC_CACHE", "PIM"):
        f = Filter.create(spark, v, 12, 4, nb_ranks=1, units_per_rank=2).insert_bulk(items)
        assert f.true_count(items) == 4


@pytest.mark.parametrize("bad", [{"size2": 2}, {"nb_hash": 0}, {"nb_hash": 10}, {"variant": "BASIC", "nb_threads": 8}, {"variant": "PIM", "nb_ranks": 0}, {"variant": "PIM", "size2": 10}, {"variant": "PIM", "size2": 40}])
def test_spec_errors(bad):
    with pytest.raises(ValueError):
        FilterSpec(**bad)


def test_factory(spark):
    with pytest.warns(UserWarning, match="one thread"):
        assert FilterSpec.create("BASIC", 10, 2, 8).nb_threads == 1
    with pytest.raises(ValueError):
        FilterSpec.create("OTHER", 10, 2)
    for size2 in range(3, 8):
        assert Filter.create(spark, "SYNC_CACHE", size2, 3).insert(5).contains(5)


def test_nulls_empty_and_custom_dispatch(spark):
    f = Filter.create(spark, "PIM", 16, 3, nb_ranks=1, dispatch=lambda x: x % 3)
    rows = spark.createDataFrame([(None, "a"), (4, "b"), (4, "b")], "item BIGINT, `hit` STRING")
    g = f.insert_bulk(rows)
    assert g.weight_by_shard().count() == 1 and g.insert_bulk(rows.limit(0)).weight() == g.weight()
    assert sorted(map(str, g.contains_bulk(rows, out="in").collect())) == sorted(["Row(item=None, hit='a', in=None)", *["Row(item=4, hit='b', in=True)"] * 2])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.integers(0, 2**63 - 1), max_size=20), b=st.lists(st.integers(0, 2**63 - 1), max_size=20))
def test_or_algebra(spark, a, b):
    spec = FilterSpec("SYNC_CACHE", 10, 3)
    build = lambda xs: state.build(spark.createDataFrame([(x,) for x in xs], "item BIGINT"), "item", spec)
    rows = lambda s: sorted(map(tuple, s.select("shard", "word_idx", "word").collect()))
    assert rows(state.merge(build(a), build(b))) == rows(state.merge(build(b), build(a))) == rows(build(a + b)) == rows(build(b + a + a))


def test_joins_and_spec_check(spark, tmp_path):
    f = Filter.create(spark, "CACHE", 16, 8).insert_bulk(sequence(spark, 100))
    rows = sequence(spark, 1_000)
    assert f.semi_join(rows, "item").where("item < 100").count() == 100
    assert f.anti_join(rows, "item").where("item < 100").count() == 0
    f.save(str(tmp_path / "f"))
    assert Filter.load(spark, str(tmp_path / "f")).weight() == f.weight()
    with pytest.raises(ValueError):
        Filter.load(spark, str(tmp_path / "f"), FilterSpec("CACHE", 17, 8))
    with pytest.raises(ValueError):
        f.union(Filter.create(spark, "SYNC_BASIC", 16, 8))
    assert f.union(Filter.create(spark, "SYNC_CACHE", 16, 8).insert(5_000)).contains(5_000)
    assert f.intersection(f).weight() == f.weight()


def test_plan_stays_small(spark):
    f = Filter.create(spark, "SYNC_BASIC", 16, 8).insert_bulk(sequence(spark, 10))
    assert len(f.words._jdf.queryExecution().optimizedPlan().toString()) < 40_000
