"""Measure one filter configuration and append the figures to a CSV: ``python -m bitsieve.measure -t PIM -k 8 -r 8 -m 24 -n 1000000 -l out``.

Timed: init, insert, weight, lookup of the members in another order, export and
import of the bits; and the rate of false positives among keys that aren't members.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from bitsieve.operators.filter import Filter
from bitsieve.session import local_session
from bitsieve.sources.measures import Recorder, append_measures, sequence, shuffled
from bitsieve.spec import SHARDED, Variant

#: Keys beside the members that are probed for the rate of false positives.
NON_MEMBERS = 100_000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-t", "--type", choices=[v.value for v in Variant], default=Variant.SYNC_CACHE.value)
    p.add_argument("-k", "--hashes", type=int, default=8)
    p.add_argument("-r", "--ranks", type=int, default=1)
    p.add_argument("-m", "--size2", type=int, default=20)
    p.add_argument("-n", "--items", type=int, default=10_000)
    p.add_argument("-c", "--cores", type=int, default=8, help="cores of the local session; a cluster's own session is taken as it is")
    p.add_argument("-l", "--log", help="folder that the CSV rows are appended to")
    return p


def measure(spark: SparkSession, variant: str, k: int, size2: int, n: int, ranks: int = 1) -> DataFrame:
    """(duration, id, k, size2, nb_items[, nb_ranks]): a row for each figure."""
    rec = Recorder(spark, k=k, size2=size2, nb_items=n)
    with rec.timed("init"):
        f = Filter.create(spark, variant, size2, k, nb_ranks=ranks)
    if f.spec.layout == SHARDED:
        rec.params["nb_ranks"] = ranks
        rec.rows = [(*r, ranks) for r in rec.rows]
    items = sequence(spark, n)
    with rec.timed("insert"):
        f = f.insert_bulk(items).persist()
        f.words.count()
    with rec.timed("weight"):
        f.weight()
    with rec.timed("lookup"):
        missed = n - f.true_count(shuffled(items))
    if missed:
        raise AssertionError(f"{missed} members are missed")
    with rec.timed("get_data"):
        data = f.get_data().persist()
        data.count()
    with rec.timed("set_data"):
        f.set_data(data).words.count()
    rec.value("fpr", f.fpr(sequence(spark, NON_MEMBERS, n)))
    data.unpersist()
    f.unpersist()
    return rec.frame()


def main(argv: list[str] | None = None, show: bool = True) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session(a.cores, "measure")
    rows = measure(spark, a.type, a.hashes, a.size2, a.items, a.ranks)
    if show:
        rows.show(truncate=False)
    if a.log:
        append_measures(rows, a.log)


if __name__ == "__main__":
    main()
