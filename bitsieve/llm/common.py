"""What the operators share.

Rows with whole texts go to Python in Arrow batches that Spark bounds by bytes (64 MB,
``spark.sql.execution.arrow.maxBytesPerBatch``) as well as by rows; operators take the
texts out of a batch one at a time. A text of any length is one row; a very long one
makes a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a class body for regular expressions.
SPACE = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw(column: pa.Array) -> Iterator[bytes | None]:
    """Bytes of a string column, whether they are UTF-8 or not, one text at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.cast(kind):
        yield x.as_py()


def texts(column: pa.Array) -> Iterator[str | None]:
    """Strings of a string column; what isn't UTF-8 reads as U+FFFD."""
    for x in raw(column):
        yield None if x is None else x.decode("utf-8", "replace")


def as_bytes(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't taken, whatever case it is written in."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, UPPER, LOWER)


def fold(ids: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    return (F.crc32(ids.cast("string").cast("binary")) % k).cast("int")


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; null has none."""
    t = F.btrim(text, F.lit(SPACE_CHARS))
    n = F.size(F.split(t, f"[{SPACE}]+"))
    return F.when(t.isNull() | (t == ""), 0).otherwise(n).cast("bigint")
