import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb
import pytest
from conftest_data import CLASH, ODD, SCHEMA, SF


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with columns whose names the operators use inside."""
    rows = [(*r, len(r[1] or ""), *range(len(CLASH))) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", `{c}` INT" for c in CLASH))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id BIGINT, quality INT, toxic INT")


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the smallest table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


@pytest.fixture(scope="session")
def folder(spark, odd, labels, tmp_path_factory):
    """The odd rows as a folder of tables."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    bench = [(1, "a text that has no id at all but is long enough for a window"), (2, None), (None, "short item"), (3, ""), (3, "ids are")]
    spark.createDataFrame(bench, "item_id BIGINT, text STRING").write.parquet(f"{d}/benchmark.parquet")
    return d
