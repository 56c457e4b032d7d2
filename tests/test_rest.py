"""Reports, streaming, and the queries against their SQL."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from bitsieve import Filter, FilterSpec, measure, queries
from bitsieve.plans import report
from bitsieve.sources import measures
from bitsieve.streaming import ingest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_report(spark, tmp_path):
    rec = measures.Recorder(spark, k=8, size2=20, nb_items=10)
    with rec.timed("insert"):
        pass
    rec.value("fpr", 0.0)
    measures.append_measures(rec.frame(), str(tmp_path / "b"))
    measures.append_measures(rec.frame(), str(tmp_path / "b"))
    blocked = measures.read_measures(spark, str(tmp_path / "b"), measures.BLOCKED_SCHEMA)
    sharded = blocked.withColumn("nb_ranks", F.explode(F.array(F.lit(6), F.lit(8))))
    rows = report.compare(sharded, blocked)
    assert rows.count() == 4 and rows.where("id = 'fpr' AND speedup IS NULL").count() == 2
    assert "speedup" not in report.slice_of(rows, "fpr").columns
    assert report.formatted(rows, "fpr").first()["sharded"] == "0.00000"
    assert report.formatted(rows, "insert").first()["blocked"].endswith(" s")
    assert report.clipped(rows, "speedup", 1.0, 1.0).where("speedup <> 1").count() == 0
    assert not measures.Recorder(spark).rows


@pytest.mark.parametrize("kind,columns", [("PIM", 6), ("CACHE", 5)])
def test_measure(spark, tmp_path, kind, columns):
    measure.main(["-t", kind, "-k", "3", "-m", "16", "-n", "500", "-l", str(tmp_path / "m")])
    rows = measures.read_measures(spark, str(tmp_path / "m"), measures.SHARDED_SCHEMA if columns == 6 else measures.BLOCKED_SCHEMA)
    assert {r.id for r in rows.collect()} == {"init", "insert", "weight", "lookup", "get_data", "set_data", "fpr"} and len(rows.columns) == columns


def test_stream(spark, tmp_path, monkeypatch):
    """Every batch's items are found at any time, and old states go."""
    monkeypatch.setattr(ingest, "COMPACT", 2)
    spec = FilterSpec("SYNC_BASIC", 16, 4)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert ingest.latest(spark, out, spec).weight() == 0
    for part in range(5):
        spark.range(part * 100, part * 100 + 100).withColumnRenamed("id", "item").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("item BIGINT").parquet(src)
        ingest.ingest(stream, "item", spec, out, str(tmp_path / "ck")).awaitTermination(60)
        n = (part + 1) * 100
        assert ingest.latest(spark, out, spec).true_count(spark.range(n), "id") == n
    assert ingest.versions(spark, out, "v") == [2, 4] and ingest.versions(spark, out, "d") == [2, 3, 4, 5]
    whole = ingest.latest(spark, out, spec)
    assert whole.weight() == Filter(spark, spec).insert_bulk(spark.range(500), "id").weight()


@pytest.mark.parametrize("name", list(queries.catalogue()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    query, sql = queries.catalogue()[name]
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = query(spark, DATA)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    same = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted((str([same(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall()))
    assert sorted(names) == sorted(got.columns)
    assert sorted(str([same(r[c]) for c in sorted(names)]) for r in got.collect()) == want
