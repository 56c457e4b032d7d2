"""Token ids in a binary format: blocks of ids with Elias-Fano encoded boundaries.

A file is Parquet, so that Spark's committer makes lost tasks harmless and any
store can hold it. A row is a block of consecutive documents: their ids of about a
million tokens as little-endian integers, the documents' ends in the block and
their document ids as Elias-Fano sequences. Blocks number their partition and
their place in it; partitions are ranges of document ids in ascending order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import table, texts
from bitsieve.session import shared_folder

END_ID = 2
BLOCK_TOKENS = 1 << 20
#: A one bit in so many has its place stored, for select.
SAMPLE = 256
#: Pieces of text with their ids that a worker keeps, twice at most; this bounds its memory.
CACHE_WORDS = 300_000
FORMAT = "part INT, block INT, n_docs BIGINT, n_tokens BIGINT, before BIGINT, width INT, ids BINARY, ends BINARY, n_null BIGINT, first_id BIGINT, doc_ids BINARY"


class EliasFano:
    """A non-decreasing sequence of non-negative integers.

    Of each value the low bits are stored as they are; the high parts are a row of
    unary counts. ``select(i)`` finds the i-th one bit from the nearest sample.
    Layout: n, low width (u64), the number of high bytes (u64), samples (u32), low bits, high bits.
    """

    def __init__(self, n: int, low_width: int, samples: np.ndarray, low: bytes, high: bytes) -> None:
        self.n, self.low_width, self.samples, self.low, self.high = n, low_width, samples, low, high

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint32), b"", b"")
        width = max(0, int(v[-1] // np.uint64(n)).bit_length() - 1)
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, width, ones[::SAMPLE].astype(np.uint32), np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_width, len(self.high)], "<u8").tobytes() + self.samples.astype("<u4").tobytes() + self.low + self.high

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, n_high = map(int, np.frombuffer(data, "<u8", 3))
        k = -(-n // SAMPLE)
        at = 24 + 4 * k
        return cls(n, width, np.frombuffer(data, "<u4", k, 24), data[at : len(data) - n_high], data[len(data) - n_high :])

    def select(self, i: int) -> int:
        """Place of the i-th one bit of the high part."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if not left:
            return at
        byte, skip = at >> 3, (at & 7) + 1
        x = self.high[byte] >> skip << skip & 0xFF
        while (ones := x.bit_count()) < left:
            left -= ones
            byte += 1
            x = self.high[byte]
        for _ in range(left - 1):
            x &= x - 1
        return byte * 8 + (x & -x).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        a = i * self.low_width
        low = int.from_bytes(self.low[a >> 3 : (a + self.low_width + 7) >> 3], "little") >> (a & 7) & ((1 << self.low_width) - 1)
        return (self.select(i) - i) << self.low_width | low

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Values start..stop-1 as unsigned 64-bit integers, found by ``select``; no others are decoded."""
        stop = min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = self.select(start), self.select(stop - 1)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, (last >> 3) - (first >> 3) + 1, first >> 3), bitorder="little")
        ones = np.flatnonzero(bits)[(np.flatnonzero(bits) >= (first & 7)).argmax() :][: stop - start] + (first >> 3 << 3)
        out = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_width)
        if self.low_width:
            a, b = start * self.low_width, stop * self.low_width
            low = np.unpackbits(np.frombuffer(self.low, np.uint8, (b + 7 >> 3) - (a >> 3), a >> 3), bitorder="little")[a & 7 :][: b - a].reshape(stop - start, -1)
            for i in range(self.low_width):
                out |= low[:, i].astype(np.uint64) << np.uint64(i)
        return out

    def find(self, value: int) -> int:
        """Place of the first value that isn't smaller; ``n`` if there is none."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self[mid] < value else (lo, mid)
        return lo

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_width)
        if not self.low_width:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_width).reshape(self.n, -1)
        out = high
        for b in range(self.low_width):
            out = out | bits[:, b].astype(np.uint64) << np.uint64(b)
        return out


class Pieces(dict):
    """Piece -> packed ids, asked for once. A full table becomes the old one, from which pieces still in use come back."""

    def __init__(self, packed) -> None:
        super().__init__()
        self.packed, self.old = packed, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        self[piece] = ids = self.packed(piece) if ids is None else ids
        return ids

    def renew(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class TokenEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode_batch(..., add_special_tokens=False)``.

    A byte-level vocabulary splits text by a fixed pattern and encodes each piece
    by itself. For texts of characters below U+0250, in which classes of characters
    are the same everywhere, the split is made here and a piece's ids are kept;
    all other texts, and other kinds of tokenizers, go through the library whole.
    """

    SAFE = 0x250

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        kind = json.loads(definition)
        pre = kind.get("pre_tokenizer") or {}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        plain = not kind.get("normalizer") and not kind.get("post_processor") and kind["model"].get("type") == "BPE"
        self.by_piece = plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.added = [x["content"] for x in kind.get("added_tokens") or ()]
        of = lambda c: "".join(re.escape(chr(i)) for i in range(self.SAFE) if unicodedata.category(chr(i))[0] == c)
        letter, number, space = of("L"), of("N"), r"\t-\r \x85\xa0"
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.unsafe = re.compile(f"[^\\x00-\\u{self.SAFE - 1:04x}]").search
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for code points from 256 on.
        plain = {*range(33, 127), *range(161, 256)} - {173}
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b if b in plain else 256 + others.index(b)) for b in range(256)}
        self.merge = self.tokenizer.model.tokenize
        self.pieces = Pieces(self._piece)

    def _packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """A piece needs no more splitting: the library's model merges it as it is."""
        ids = [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.alphabet))]
        if self.dtype.itemsize == 2:
            return struct.pack(f"<{len(ids)}H", *ids)
        return np.array(ids, self.dtype).tobytes()

    def encode(self, rows: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        for text in rows:
            if not self.by_piece or self.unsafe(text) or any(a in text for a in self.added):
                yield self._packed(text)
            else:
                yield b"".join(map(self.pieces.__getitem__, self.split(text)))
                self.pieces.renew()


_encoders: dict[int, TokenEncoder] = {}


def encoder(definition: str) -> TokenEncoder:
    """One encoder for each worker process."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = TokenEncoder(definition)
    return _encoders[key]


def write_ids(df: DataFrame, path: str, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode all texts and write them to ``path`` in ascending order of doc_id.

    Null and empty texts are one end id each; texts of any length are encoded whole, and
    bytes that aren't UTF-8 as U+FFFD. Rows without an id come first; rows that repeat
    an id stand together. An empty table writes no blocks. Other
    columns are ignored. The vocabulary file (its size is fixed) is sent to the tasks.
    """
    spark = df.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        end = np.array([end_id], enc.dtype).tobytes()
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, docs, lengths, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            known = np.array([x for x in docs if x is not None], np.int64)
            first = int(known[0]) if len(known) else 0
            row = {"part": part, "block": block, "n_docs": len(docs), "n_tokens": n, "before": before, "width": enc.dtype.itemsize, "ids": b"".join(ids), "ends": EliasFano.encode(np.cumsum(lengths)).to_bytes(), "n_null": len(docs) - len(known), "first_id": first, "doc_ids": EliasFano.encode(known.astype(np.uint64) - np.array([first]).astype(np.uint64)).to_bytes()}
            return pa.RecordBatch.from_pylist([row], schema=FORMAT_ARROW)

        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), enc.encode(t or "" for t in texts(batch.column(1))), strict=True):
                ids += (packed, end)
                docs.append(doc)
                lengths.append(len(packed) // enc.dtype.itemsize + 1)
                n += lengths[-1]
                if n >= BLOCK_TOKENS:
                    yield flush()
                    block, before = block + 1, before + n
                    ids, docs, lengths, n = [], [], [], 0
        if docs:
            yield flush()

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    rows.mapInArrow(blocks, FORMAT).write.option("compression", "zstd").mode("overwrite").parquet(path)


FORMAT_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()), ("n_null", pa.int64()), ("first_id", pa.int64()), ("doc_ids", pa.binary())])


#: Documents of a block whose boundaries are decoded at once.
RUN = 1024


class Block:
    """One block: boundaries are found by select, and ids are views of the bytes that were read."""

    def __init__(self, row: dict) -> None:
        self.part, self.before, self.n_docs, self.n_null, self.first = row["part"], row["before"], row["n_docs"], row["n_null"], row["first_id"]
        self.raw, self.ends, self.known = np.frombuffer(row["ids"], f"<u{row['width']}"), EliasFano.from_bytes(row["ends"]), EliasFano.from_bytes(row["doc_ids"])

    def bounds(self, start: int, stop: int) -> np.ndarray:
        """Where documents start..stop-1 begin, and where the last one ends."""
        before = self.ends[start - 1] if start else 0
        return np.concatenate([[before], self.ends.slice(start, stop).astype(np.int64)])

    def docs(self, start: int, stop: int) -> list[int | None]:
        """Their ids; those without one come first."""
        stop, none = min(stop, self.n_docs), self.n_null
        known = self.known.slice(max(0, start - none), stop - none) if stop > none else np.zeros(0, np.uint64)
        return [None] * max(0, min(stop, none) - start) + (known + np.array([self.first]).astype(np.uint64)).astype(np.int64).tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        return self.raw[start:end].astype("<u4")

    def of(self, doc: int) -> Iterator[tuple[int, int]]:
        """(start, end) in the block of each document with that id; nothing else is decoded."""
        if doc < self.first:
            return
        i = self.known.find(doc - self.first)
        while i < self.known.n and self.known[i] == doc - self.first:
            at = i + self.n_null
            yield (self.ends[at - 1] if at else 0), self.ends[at]
            i += 1


def lookup_ids(spark: SparkSession, path: str, docs: list[int]) -> DataFrame:
    """(doc_id, ids): of a list of documents, found in the blocks by binary search and select.

    Blocks whose first id is larger than all that are asked for aren't read. An id that
    several rows share gives a row for each, one that isn't there none.
    """
    wanted = sorted(set(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, np.ndarray]] = []
            for i in range(batch.num_rows):
                b = Block({n: batch.column(n)[i].as_py() for n in batch.schema.names})
                found += [(doc, b.ids(s, e)) for doc in wanted for s, e in b.of(doc)] if b.known.n else []
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    blocks = spark.read.schema(FORMAT).parquet(path).where(F.col("first_id") <= max(wanted, default=0))
    return blocks.mapInArrow(rows, "doc_id BIGINT, ids ARRAY<BIGINT>")


def read_ids(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and with ``keep_ids`` the ids as an array, out of the files.

    One row for each row that was written, in any order; those without an id come with
    a null. Files of an empty table give no row. Boundaries are decoded a thousand
    documents at a time. The driver holds one number for each partition that was written.
    """
    blocks = spark.read.schema(FORMAT).parquet(path)
    total, base = 0, {}
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[r.part] = total
        total += r.n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Block({n: batch.column(n)[i].as_py() for n in batch.schema.names})
                for lo in range(0, b.n_docs, RUN):
                    at = b.bounds(lo, lo + RUN)
                    starts, ends = at[:-1], at[1:]
                    out = {"doc_id": b.docs(lo, lo + RUN), "start": at[:-1] + base[b.part] + b.before, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(b.ids(s, e)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]}
                    types = [pa.int64()] * 4
                    if keep_ids:
                        out["ids"] = [b.ids(s, e) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                        types.append(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return blocks.mapInArrow(rows, "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT" + (", ids ARRAY<BIGINT>" if keep_ids else ""))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(df: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Write the documents to a new folder of the shared one and read them back."""
    path = f"{shared_folder(df.sparkSession)}/token_ids/{uuid.uuid4().hex}"
    write_ids(df, path, tokenizer_file or vocabulary())
    return read_ids(df.sparkSession, path)


def op5_token_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))
