"""Removal of repeated byte strings across documents, by blockwise suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id. Documents are dealt to groups of a few megabytes.

1. Each string of that length has a minimizer: the least hash of the 16-byte
   strings in it. Groups send their distinct minimizers to buckets, and hear
   back which of them other documents have too. A string whose minimizer
   nobody else has can't repeat.
2. Strings in a row with the same shared minimizer are cut out together and sent
   to that minimizer's bucket; equal cut-outs of a group go once, for the least
   id. A minimizer that very many documents have is split: its strings go one by
   one, to buckets by their content. Where groups are many, some thousands of them
   share such a bucket, and each bucket passes on one string of its equals, that of
   the least id; so the commonest string doesn't gather in one place.
3. A bucket compares cut-outs as a whole, drops those without a partner, and
   sorts the suffixes of the rest with a difference cover. Suffixes that agree in
   ``length`` bytes stand together; all but those of the least id are removed.
4. Groups cut the removed runs out of their documents.

What a bucket gets is bounded by its share of the text: a string comes from a
group at most once for each document that doesn't repeat it there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import raw, table
from bitsieve.llm.suffixsort import SuffixSorter
from bitsieve.session import cut, release

LENGTH = 50
GRAM = 16
#: Bytes of text in a group, about; and in the groups, or buckets, of a task.
GROUP_BYTES, TASK_BYTES = 4 << 20, 64 << 20
#: Documents that share a minimizer, beyond which its strings are sent one by one.
COMMON = 1000
#: Strings of one minimizer in a row that are cut out together, at most.
PIECE = 64
#: Groups whose strings of a common minimizer meet in one bucket; more groups meet in two steps.
SPLIT_GROUPS = 4096
NO_ID = (1 << 63) - 1
REST_BITS = 40
U = np.uint64


class Texts:
    """The documents of a group as one buffer, in the order of their ids; those without an id come last."""

    def __init__(self, rows: pa.Table) -> None:
        ids = rows.column("doc_id").to_pylist()
        data = [t or b"" for t in raw(rows.column("text"))]
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], data[i]))
        self.ids = [ids[i] for i in order]
        self.data = [data[i] for i in order]
        self.raw = b"".join(self.data)
        self.sizes = np.array([len(d) for d in self.data], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.rank = np.array([NO_ID if i is None else i for i in self.ids], np.int64)

    def segments(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first string, strings, minimizer, document) of each row of strings with one minimizer; and all hashes."""
        n = len(self.raw)
        hashes = gram_hashes(self.raw)
        least = sliding(hashes, length - GRAM + 1, np.minimum)
        valid = np.ones(n, bool)
        for k in range(1, length):
            valid[np.maximum(self.ends - k, self.ends - self.sizes)[self.sizes > 0]] = False
        at = np.flatnonzero(valid)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, U), none, hashes
        own = least[at]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(at) > 1)])
        heads = np.flatnonzero(new)
        first = at[heads]
        return first, np.diff(np.append(heads, len(at))), own[heads], np.searchsorted(self.ends, first, "right"), hashes


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of the 16 bytes from each place on; zeros follow the text."""
    n, data = len(raw), raw + b"\0" * GRAM
    h = np.ndarray((n,), "<u8", data, 0, (1,)) * U(0x9E3779B97F4A7C15)
    h ^= np.ndarray((n,), "<u8", data, 8, (1,)) * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def sliding(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` over x[i : i + width]; by doubling. The last places see less."""
    out, done = x.copy(), 1
    while done * 2 <= width:
        out[:-done] = op(out[:-done], out[done:])
        done *= 2
    if width > done and len(out) > width - done:
        out[: done - width] = op(out[: done - width], out[width - done :])
    return out


def dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket, and in the low bits the rest of the hash, in one number."""
    x = h * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    return ((x >> U(REST_BITS)) * U(buckets) >> U(64 - REST_BITS)) << U(REST_BITS) | x & U((1 << REST_BITS) - 1)


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> U(REST_BITS)).astype(np.int64)


def _pack(*columns: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(c).to_bytes(8, "little") + c for c in (x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in columns)))


def _unpack(data: bytes) -> list[bytes]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _blocks(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) of keys."""
    b = _bucket(key)
    order = np.argsort(b, kind="stable")
    b = b[order]
    for part in np.split(order, np.flatnonzero(np.diff(b)) + 1) if len(order) else []:
        yield int(key[part[0]] >> U(REST_BITS)), part


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


TO_BUCKET = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("data", pa.binary())])
TO_GROUP = pa.schema([("grp", pa.int64()), ("data", pa.binary())])
FOUND = pa.schema([("bucket", pa.int64()), ("grp", pa.int64()), ("data", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
BUCKET_DDL, GROUP_DDL = "bucket BIGINT, grp BIGINT, data BINARY", "grp BIGINT, data BINARY"


def _ask(rows: pa.Table, length: int, buckets: int) -> pa.Table:
    """Distinct minimizers of a group with the number of its documents that have them, 255 at most."""
    grp = rows.column("grp")[0].as_py()
    _, _, least, doc, _ = Texts(rows).segments(length)
    order = np.lexsort((doc, least))
    least, doc = least[order], doc[order]
    if not len(least):
        return _rows(TO_BUCKET, [])
    pair = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    least = least[pair]
    head = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    docs = np.minimum(np.diff(np.append(head, len(least))), 255).astype(np.uint8)
    key = dealt(least[head], buckets)
    return _rows(TO_BUCKET, [(b, grp, _pack(key[p].view(np.uint8).reshape(-1, 8)[:, : REST_BITS // 8], docs[p])) for b, p in _blocks(key)])


def _answer(rows: pa.Table, common: int) -> pa.Table:
    """Which minimizers of a bucket more than one document has, to each group that has them; the low bit tells those that are common."""
    bucket = rows.column("bucket")[0].as_py()
    groups, parts = rows.column("grp").to_pylist(), [_unpack(d) for d in rows.column("data").to_pylist()]
    keys = []
    for low, _ in parts:
        wide = np.zeros((len(low) * 8 // REST_BITS, 8), np.uint8)
        wide[:, : REST_BITS // 8] = np.frombuffer(low, np.uint8).reshape(len(wide), -1)
        keys.append(wide.view("<u8").ravel())
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    docs = np.bincount(where, np.concatenate([np.frombuffer(n, np.uint8) for _, n in parts]))
    out, at = [], 0
    for grp, key in zip(groups, keys, strict=True):
        n = docs[where[at : at + len(key)]]
        at += len(key)
        if (n > 1).any():
            full = U(bucket) << U(REST_BITS) | key[n > 1]
            out.append((grp, _pack(full << U(1) | (n[n > 1] > common).astype(U))))
    return _rows(TO_GROUP, out)


def _cut_out(rows: pa.Table, answers: pa.Table, length: int, buckets: int, split: int) -> pa.Table:
    """Cut-outs for the buckets; and, in a bucket of the group's own, runs that it can tell by itself to be repeated."""
    if not rows.num_rows or not answers.num_rows:
        return _rows(TO_BUCKET, [])
    grp = rows.column("grp")[0].as_py()
    texts = Texts(rows)
    first, count, least, doc, hashes = texts.segments(length)
    shared = np.concatenate([np.frombuffer(_unpack(d)[0], "<u8") for d in answers.column("data").to_pylist()])
    shared.sort()
    key = dealt(least, buckets)
    at = np.minimum(np.searchsorted(shared >> U(1), key), len(shared) - 1)
    ok = shared[at] >> U(1) == key
    common = ok & (shared[at] & U(1) == U(1))
    keep = ok & ~common
    # Strings of common minimizers, one by one, under a hash of their own.
    single = _spread(first[common], count[common])
    own = hashes[single] ^ (hashes[single + GRAM] * U(3)) ^ (hashes[single + 2 * GRAM] * U(5)) ^ (hashes[single + length - GRAM] * U(7)) if length >= 3 * GRAM else hashes[single]
    # Long rows of strings in pieces, so that those of periodic text are equal.
    first, count, key, doc, single_doc = first[keep], count[keep], key[keep], doc[keep], np.repeat(doc[common], count[common])
    pieces = -(-count // PIECE)
    nth = _spread(np.zeros(len(count), np.int64), pieces)
    strings = np.minimum(PIECE, np.repeat(count, pieces) - nth * PIECE)
    start = np.concatenate([np.repeat(first, pieces) + nth * PIECE, single])
    size = np.concatenate([strings, np.ones(len(single), np.int64)]) + length - 1
    key = np.concatenate([np.repeat(key, pieces), dealt(own, buckets)])
    doc = np.concatenate([np.repeat(doc, pieces), single_doc])
    order = np.argsort(doc, kind="stable")
    is_single = np.arange(len(start)) >= len(start) - len(single)
    start, size, key, rank, is_single = start[order], size[order], key[order], texts.rank[doc[order]], is_single[order]
    raw, seen, gone = texts.raw, {}, []
    # Of equal cut-outs the first has the least id; others of that id are more places of it.
    of = np.arange(len(start))
    for i, (s, n, r) in enumerate(zip(start.tolist(), size.tolist(), rank.tolist(), strict=True)):
        j, least_id = seen.setdefault(raw[s : s + n], (i, r))
        if least_id < r:
            of[i] = -1
            gone.append((s, s + n))
        else:
            of[i] = j
    del seen
    out = [(buckets + grp, grp, _pack(_merged(np.array(gone, np.int64))))] if gone else []
    head = np.flatnonzero(of == np.arange(len(of)))
    order = np.flatnonzero(of >= 0)
    order = order[np.argsort(of[order], kind="stable")]
    places = start[order]
    number = np.bincount(of[order], minlength=len(of))[head]
    begin = np.cumsum(number) - number
    fan = -(-buckets // split)
    for one_by_one, offset in ((False, 0), (True, (2 if fan == 1 else 3 + grp % fan) * buckets)):
        own = np.flatnonzero(is_single[head] == one_by_one)
        for b, p in _blocks(key[head[own]]):
            p = own[np.sort(p)]
            h = head[p]
            text = b"".join([raw[s : s + n] for s, n in zip(start[h].tolist(), size[h].tolist(), strict=True)])
            out.append((b + offset, grp, _pack(places[_spread(begin[p], number[p])].astype("<u4"), number[p].astype("<u4"), size[h].astype("<u4"), (key[h] & U(0xFFFFFFFF)).astype("<u4"), rank[h].astype("<i8"), text)))
    return _rows(TO_BUCKET, out)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, ``count`` numbers."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _merged(runs: np.ndarray) -> np.ndarray:
    """Runs (start, end), joined where they touch."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    end = np.maximum.accumulate(runs[:, 1])
    new = np.concatenate([[True], runs[1:, 0] > end[:-1]])
    head = np.flatnonzero(new)
    return np.stack([runs[head, 0], end[np.append(head[1:] - 1, len(runs) - 1)]], 1).astype("<i8")


def _compare(rows: pa.Table, length: int, buckets: int) -> pa.Table:
    """Runs of a bucket's cut-outs that start in a document of a smaller id too, to their groups (without a bucket).

    Buckets from ``buckets`` on are runs that a group has found itself; the next as many
    are strings one by one; those beyond hold such strings of some groups only, and pass
    on what has the least id, to the bucket that all groups share.
    """
    bucket = rows.column("bucket")[0].as_py()
    kind = min(bucket // buckets, 3)
    if kind == 1:
        return _rows(FOUND, [(None, g, d) for g, d in zip(rows.column("grp").to_pylist(), rows.column("data").to_pylist(), strict=True)])
    columns: list[list] = [[] for _ in range(6)]
    text = []
    for g, d in zip(rows.column("grp").to_pylist(), rows.column("data").to_pylist(), strict=True):
        *parts, own = _unpack(d)
        arrays = [np.frombuffer(p, t).astype(np.int64) for p, t in zip(parts, ("<u4", "<u4", "<u4", "<u4", "<i8"), strict=True)]
        for column, x in zip(columns, [*arrays, np.full(len(arrays[1]), g)], strict=True):
            column.append(x)
        text.append(own)
    place, number, size, key, rank, source = map(np.concatenate, columns)
    raw = b"".join(text)
    del text
    at, begin = np.cumsum(size) - size, np.cumsum(number) - number
    # Equal cut-outs: only the least id's is compared further.
    order = np.argsort(rank, kind="stable")
    seen, kept, gone = {}, [], []
    for i, a, n, r in zip(order.tolist(), at[order].tolist(), size[order].tolist(), rank[order].tolist(), strict=True):
        if seen.setdefault(raw[a : a + n], r) < r:
            gone.append(i)
        else:
            kept.append(i)
    del seen
    gone, kept = np.array(gone, np.int64), np.array(kept, np.int64)
    found = [np.stack([gone, np.zeros(len(gone), np.int64), size[gone]], 1)]
    out = []
    if kind == 3:
        for own in np.split(kept, np.flatnonzero(np.diff(source[kept])) + 1) if len(kept := kept[np.argsort(source[kept], kind="stable")]) else []:
            its = b"".join([raw[a : a + n] for a, n in zip(at[own].tolist(), size[own].tolist(), strict=True)])
            arrays = (place[_spread(begin[own], number[own])], number[own], size[own], key[own])
            out.append((2 * buckets + bucket % buckets, int(source[own[0]]), _pack(*[x.astype("<u4") for x in arrays], rank[own].astype("<i8"), its)))
    if kind >= 2:
        kept = kept[:0]
    # A cut-out whose minimizer no other cut-out has repeats nothing.
    kept = kept[np.argsort(key[kept], kind="stable")]
    k = key[kept]
    partner = np.zeros(len(k), bool)
    partner[1:] = k[1:] == k[:-1]
    partner[:-1] |= k[1:] == k[:-1]
    kept = kept[partner]
    if len(kept):
        found.append(_by_suffixes(raw, at[kept], size[kept], rank[kept], kept, length))
    runs = np.concatenate(found)
    # A run in a cut-out is one in the text at each of its places.
    own = runs[:, 0]
    where = place[_spread(begin[own], number[own])]
    again = np.repeat(runs, number[own], axis=0)
    again[:, 0] = source[again[:, 0]]
    again[:, 1:] += where[:, None]
    again = again[np.argsort(again[:, 0], kind="stable")]
    for part in np.split(again, np.flatnonzero(np.diff(again[:, 0])) + 1) if len(again) else []:
        out.append((None, int(part[0, 0]), _pack(_merged(part[:, 1:]))))
    return _rows(FOUND, out)


def _by_suffixes(raw: bytes, at: np.ndarray, size: np.ndarray, rank: np.ndarray, name: np.ndarray, length: int) -> np.ndarray:
    """(name of the cut-out, start, end) of runs of strings that a smaller id has as well."""
    text = np.frombuffer(b"".join([raw[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]), np.uint8)
    begin = np.cumsum(size) - size
    strings = size - length + 1
    again = np.zeros(len(text), bool)
    for p, heads in SuffixSorter(text, length).groups(_spread(begin, strings)):
        r = rank[np.searchsorted(begin, p, "right") - 1]
        least = np.minimum.reduceat(r, heads)
        again[p[r > np.repeat(least, np.diff(np.append(heads, len(p))))]] = True
    found = np.flatnonzero(again)
    owner = np.searchsorted(begin, found, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (np.diff(found) > 1) | (np.diff(owner) > 0)])) if len(found) else found
    last = np.append(new[1:] - 1, len(found) - 1) if len(found) else new
    o = owner[new]
    return np.stack([name[o], found[new] - begin[o], found[last] - begin[o] + length], 1)


def _finish(rows: pa.Table, runs: pa.Table, keep: bool) -> pa.Table:
    if not rows.num_rows:
        return _rows(RESULT, [])
    texts = Texts(rows)
    n = len(texts.raw)
    depth = np.zeros(n + 1, np.int32)
    for d in runs.column("data").to_pylist():
        pairs = np.frombuffer(_unpack(d)[0], "<i8").reshape(-1, 2)
        np.add.at(depth, pairs[:, 0], 1)
        np.add.at(depth, pairs[:, 1], -1)
    gone = np.cumsum(depth[:-1]) > 0
    out, buffer, begin = [], np.frombuffer(texts.raw, np.uint8), 0
    for doc, size in zip(texts.ids, texts.sizes.tolist(), strict=True):
        own = gone[begin : begin + size]
        left = buffer[begin : begin + size][~own].tobytes()
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
        out.append((doc, size, size - len(left), spans, left if keep else hashlib.sha256(left).digest()))
        begin += size
    return _rows(RESULT, out)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: bool = True) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, or their SHA-256 if not ``keep``).

    A null text is empty; texts shorter than ``length`` bytes, and empty ones, lose
    nothing; long ones are searched whole; what isn't UTF-8 counts as the bytes it is. A row without an id counts as having the largest one; rows that share
    an id remove nothing from each other. An empty table gives an empty table.
    Other columns are ignored. ``length`` is 24 at least.
    """
    if length < GRAM + 8:
        raise ValueError("the strings are too short")
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    n = max(tasks, total // GROUP_BYTES + 1)
    common, split = COMMON, SPLIT_GROUPS
    # Tasks follow the input, whatever the session's number of shuffle partitions.
    by = lambda df, key: df.repartition(tasks, key).groupBy(key)
    docs = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    asked = by(docs, "grp").applyInArrow(lambda t: _ask(t, length, n), BUCKET_DDL)
    answers = cut(by(asked, "bucket").applyInArrow(lambda t: _answer(t, common), GROUP_DDL))
    del asked
    release(spark)
    sent = by(docs, "grp").cogroup(by(answers, "grp")).applyInArrow(lambda a, b: _cut_out(a, b, length, n, split), BUCKET_DDL)
    compared = lambda t: _compare(t, length, n)
    runs = cut(by(sent, "bucket").applyInArrow(compared, BUCKET_DDL))
    if n > split:
        # What is passed on isn't passed on again.
        more = cut(by(runs.where("bucket IS NOT NULL"), "bucket").applyInArrow(compared, BUCKET_DDL))
        runs = runs.where("bucket IS NULL").union(more)
    runs = runs.select("grp", "data")
    del answers, sent
    release(spark)
    return by(docs, "grp").cogroup(by(runs, "grp")).applyInArrow(lambda a, b: _finish(a, b, keep), "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept BINARY")


def op6_substrings(spark: SparkSession, d: str) -> DataFrame:
    rows = remove_repeats(table(spark, d, "documents"), keep=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))
