"""A stream of items into a filter kept as numbered states in one folder.

Each micro-batch writes the words of its own items only. Every sixteenth one also
writes the whole filter so far, and lets go of what lies before the whole one that
came last before it; so the folder holds a bounded number of states. OR is
idempotent, so a replayed batch changes nothing; a state counts only once Spark's
committer has written its success marker, so readers never see half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bitsieve.operators import state
from bitsieve.operators.filter import Filter
from bitsieve.sources import state_io
from bitsieve.spec import FilterSpec

WHOLE, PART = "v", "d"
#: A whole state is written every so many batches.
COMPACT = 16


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system API, so that any store works."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str, kind: str = WHOLE + PART) -> list[int]:
    """Numbers of the finished states, whole ones or those of single batches."""
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    found = set()
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name[:1] in kind and name[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "spec/_SUCCESS")):
            found.add(int(name[1:]))
    return sorted(found)


def latest(spark: SparkSession, path: str, spec: FilterSpec, upto: int | None = None) -> Filter:
    """The newest whole state and the batches after it, up to batch ``upto``."""
    last = lambda kind: [v for v in versions(spark, path, kind) if upto is None or v <= upto]
    whole = last(WHOLE)[-1:]
    names = [f"{WHOLE}{v}" for v in whole] + [f"{PART}{v}" for v in last(PART) if not whole or v > whole[0]]
    if not names:
        return Filter(spark, spec)
    return Filter(spark, spec, state.merge(*[Filter.load(spark, f"{path}/{n}", spec).words for n in names]))


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Delete the states below that number."""
    root, fs = _folder(spark, path)
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name[:1] in WHOLE + PART and name[1:].isdigit() and int(name[1:]) < before:
            fs.delete(s.getPath(), True)


def ingest(stream: DataFrame, item: str, spec: FilterSpec, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query; ``trigger`` goes to the writer, e.g. ``availableNow=True``."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark, n = batch.sparkSession, epoch + 1
        state_io.save(state.build(batch, item, spec), spec, f"{path}/{PART}{n}", "overwrite")
        if n % COMPACT == 0:
            older = [v for v in versions(spark, path, WHOLE) if v < n]
            state_io.save(latest(spark, path, spec, n).words, spec, f"{path}/{WHOLE}{n}", "overwrite")
            if older:
                # Readers may still be at the whole state before this one, so that stays.
                forget(spark, path, older[-1])

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
