"""SimHash near-dedup with a Gray-order hierarchical index.

Two fingerprints that differ in at most three bits agree on one of four blocks of
bits. So distinct fingerprints are filed under each of their four blocks; a file
that is too large is filed again under four blocks of the bits that are left, and
so on, until files are small or twenty bits are left. That is exact at any size.

In a file, fingerprints stand in the order of their Gray rank. Runs of neighbours
make nodes, runs of nodes make upper nodes; a node keeps the bits that all below
it share. Pairs of nodes are compared from the top: the shared bits in which they
differ are added up on the way down, a lower bound of all distances below, which drops
whole groups. A file
returns a spanning forest of its links, never all pairs.

``keep_one`` removes near copies at a Jaccard similarity of 0.8 over five words. Such
texts differ in 15 % of a fingerprint's bits, beyond any three, so its fingerprints have
24 words. Every 16 bits are a file's number, which makes 96 files of a text; a file's
Gray index takes up to 34 differing bits in the two leading words. Two texts at 0.8
agree on the bits of a file with a chance of 0.07, on those of one of 96 with 0.9992.
Components of these links are then decided by the sets of shingles themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import as_bytes, raw, table
from bitsieve.llm.components import connected
from bitsieve.llm.minhash import keep_best
from bitsieve.session import cut, release

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints in one file, beyond which it is split.
FILE_ROWS = 1024
LEVELS = 4
FANOUT = 4
#: Pairs of nodes and rows that a task handles at once.
CHUNK = 1 << 19
#: Words of a fingerprint for near copies; a set's shingles are counted in so many places, each of which has its own weights.
WORDS, PLACES = 24, 2048
#: Bits in which near copies may differ: in a leading word, in both, and in all. Means at 0.8: 9.7, 19.4 and 233; deviations 2.9, 4.1 and 14.
IN_WORD, IN_TWO, IN_ALL = 20, 34, 292
#: Rows of a near copies' file that are compared before its pivot is chosen.
FIRST = 8


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits of the whole text's bytes, be they UTF-8 or not; no words: 0."""
    words = as_bytes(text).lower().split()
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[b" ".join(words)]]
    digest, join, hashes = xxhash.xxh64_digest, b" ".join, []
    ones, n = np.zeros(64, np.int64), 0
    for t in zip(*parts):  # noqa: B905
        hashes.append(digest(join(t), SEED))
        if len(hashes) == 65536:
            ones, n, hashes = ones + _bit_counts(hashes), n + len(hashes), []
    ones, n = ones + (_bit_counts(hashes) if hashes else 0), n + len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8)).reshape(-1, 64)
    return sum(bits[i : i + 255].sum(0, dtype=np.uint8).astype(np.int64) for i in range(0, len(bits), 255))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in raw(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id BIGINT, fp BIGINT")


def block_masks(levels: int = LEVELS, blocks: int = DISTANCE + 1) -> list[list[int]]:
    """For each level, the mask of bits that each path of block choices has fixed."""
    out, paths = [], [(0, list(range(64)))]
    for _ in range(levels):
        nxt = []
        for mask, left in paths:
            for part in np.array_split(np.array(left), blocks):
                nxt.append((mask | sum(1 << int(b) for b in part), [b for b in left if b not in set(part.tolist())]))
        out.append([m for m, _ in nxt])
        paths = nxt
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray code."""
    x = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Index of rows that are sorted by (group, Gray rank); links stay within a group.

    A level holds for each of its nodes the bits' values and the mask of those that all
    rows below share. On the way down a pair of nodes gains masked bits: only these are
    compared, and what differs is added to what the pair above had.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> None:
        self.distance = distance
        every, some = fp, fp
        self.levels = [(every, ~(every ^ some))]
        self.spans: list[np.ndarray] = []
        g = group
        while len(np.unique(g)) < len(g):
            start = np.concatenate([[True], g[1:] != g[:-1]])
            first = np.maximum.accumulate(np.where(start, np.arange(len(g)), 0))
            heads = np.flatnonzero((np.arange(len(g)) - first) % FANOUT == 0)
            every, some = np.bitwise_and.reduceat(every, heads), np.bitwise_or.reduceat(some, heads)
            self.levels.append((every, ~(every ^ some)))
            self.spans.append(np.append(heads, len(g)))
            g = g[heads]

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within the distance, in chunks."""
        top = len(self.levels) - 1
        n = len(self.levels[top][0])
        # Pairs of nodes, the mask of the bits that both share, and how many of these differ.
        stack = [(top, np.arange(n), np.arange(n), self.levels[top][1], np.zeros(n, np.uint8))]
        i, j = np.repeat(np.arange(FANOUT), FANOUT), np.tile(np.arange(FANOUT), FANOUT)
        while stack:
            level, a, b, mask, differ = stack.pop()
            if not level:
                real = a != b
                yield a[real], b[real]
                continue
            if len(a) > CHUNK // FANOUT**2:
                half = len(a) // 2
                stack += [(level, *(v[half:] for v in (a, b, mask, differ))), (level, *(v[:half] for v in (a, b, mask, differ)))]
                continue
            heads = self.spans[level - 1]
            x, y = heads[a][:, None] + i, heads[b][:, None] + j
            ok = (x < heads[a + 1][:, None]) & (y < heads[b + 1][:, None]) & (x <= y)
            above = np.nonzero(ok)[0]
            x, y = x[ok], y[ok]
            every, shared = self.levels[level - 1]
            both = shared[x] & shared[y]
            differ = differ[above] + np.bitwise_count((every[x] ^ every[y]) & both & ~mask[above])
            near = differ <= self.distance
            if near.any():
                stack.append((level - 1, x[near], y[near], both[near], differ[near]))


def union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the components of each pair; a label is the component's least row."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := labels[labels], labels):
            labels = nxt
    return labels


def forest(group: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row's fingerprint, its component's) that connect all that is linked within each group."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp = group[order], fp[order]
    labels = np.arange(len(fp))
    for a, b in GrayIndex(group, fp, distance).links():
        labels = union(labels, a, b)
    member = np.flatnonzero(labels != np.arange(len(fp)))
    return fp[member], fp[labels[member]]


def _whole_files(tables: Iterator[np.ndarray], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group, rows) of whole files: columns of numbers, sorted by the first ``keys`` of them, come in pieces."""
    held = None

    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = (rows[:keys, 1:] != rows[:keys, :-1]).any(0)
        return np.cumsum(np.concatenate([[True], new])), np.ascontiguousarray(rows)

    for rows in tables:
        held = rows if held is None else np.concatenate([held, rows], axis=1)
        if held.size >= 3 * CHUNK:
            stop = int(np.argmax((held[:keys] == held[:keys, -1:]).all(0)))
            if stop:
                yield grouped(held[:, :stop])
                held = held[:, stop:]
    if held is not None and held.shape[1]:
        yield grouped(held)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, fp), sorted by path and key."""
    for group, rows in _whole_files(_numbers(batches), 2):
        yield _edges(*forest(group, rows[2].view(np.uint64)))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(fp), distinct -> (a, b): edges that connect all fingerprints within the distance."""
    masks = block_masks()
    rows = fps.select("fp", F.lit(0).alias("path"))
    out = None
    for level in range(LEVELS):
        here = F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks[level]])
        blocks = DISTANCE + 1
        rows = rows.select("fp", F.explode(F.array(*[F.col("path") * blocks + j for j in range(blocks)])).alias("path"))
        rows = cut(rows.withColumn("key", F.col("fp").bitwiseAND(F.get(here, F.col("path")))))
        counts = cut(rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1"))
        rows = rows.join(counts, ["path", "key"])
        last = level == LEVELS - 1
        small = rows if last else rows.where(F.col("n") <= FILE_ROWS)
        # Level in front of the path: the same path and key of two levels are different files.
        small = small.select((F.col("path") + (level << 16)).alias("path"), "key", "fp")
        # By a hash of its own: dealt by the join's own keys, files came out split over tasks and lost links (Spark may leave such a shuffle out).
        edges = small.repartition(F.xxhash64("path", "key")).sortWithinPartitions("path", "key").mapInArrow(_forests, "a BIGINT, b BIGINT")
        out = edges if out is None else out.union(edges)
        if last or counts.where(F.col("n") > FILE_ROWS).isEmpty():
            break
        rows = rows.where(F.col("n") > FILE_ROWS).select("fp", "path")
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row: doc_id, fp, component_id (least id of all documents reachable by links).

    Null and empty texts have fingerprint 0 and link like any other; texts shorter
    than a shingle are one shingle; long ones are hashed whole; repeated rows share a
    fingerprint; what isn't UTF-8 counts as the bytes it is. Rows without
    an id take part in links but name no component, whose id is null if none of its
    rows has one. An empty table gives an empty table. Other columns are ignored.
    """
    rows = cut(fingerprints(df, doc_id, text, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(fingerprint_links(fps.select("fp"))).withColumnRenamed("node", "fp")
    fps = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    fps = cut(fps)
    ids = cut(fps.groupBy("root").agg(F.min("first").alias("component_id")))
    ids = cut(fps.join(ids, "root").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    rows = near_duplicates(table(spark, d, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@cache
def _weights() -> np.ndarray:
    """Normal weights of each place. They are whole numbers, so that sums are exact."""
    w = np.random.default_rng(SEED).standard_normal((PLACES, 64 * WORDS), np.float32)
    return np.rint(np.float32(32) * w)


def near_words(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The words of sets' fingerprints for near copies; none for an empty set.

    Shingles are counted, with a sign, in places. A bit is the sign of the sum of weights,
    so two sets differ in a share of angle / pi of the bits, however few shingles they have.
    """
    out = []
    for i in range(0, len(sets), 128):
        some = sets[i : i + 128]
        counts = np.zeros((len(some), PLACES), np.float32)
        for row, hashes in zip(counts, some, strict=True):
            sign = 1.0 - 2.0 * (hashes // np.uint64(PLACES) % np.uint64(2)).astype(float)
            row[:] = np.bincount((hashes % np.uint64(PLACES)).astype(np.intp), sign, PLACES)
        words = np.packbits(counts @ _weights() > 0, axis=1).view(np.int64)
        out += [w if len(hashes) else w[:0] for w, hashes in zip(words, some, strict=True)]
    return out


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (words) -> (key, a, b): the number of each file, and the two leading words."""
    for batch in batches:
        words = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
        for i in range(0, len(words), 1024):
            some = np.ascontiguousarray(words[i : i + 1024])
            part = some.view(np.uint16).astype(np.int32)
            files = part.shape[1]
            keys = part + (np.arange(files, dtype=np.int32) << 16)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(some[:, k], files)) for k in (0, 1)]], names=["key", "a", "b"])


def _pivoted(words: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Labels of the rows of one large file. Only rows outside the pivot's component are compared with all: no link leaves it unseen."""
    close = lambda i: np.flatnonzero(near(np.bitwise_count(words ^ words[i])))
    first = max((close(i) for i in range(min(FIRST, len(words)))), key=len)
    labels, pivot = np.arange(len(words)), first[0]
    labels[first] = pivot
    for i in range(len(words)):
        if labels[i] != labels[pivot]:
            also = close(i)
            labels = union(labels, np.full(len(also), i), also)
    return labels


def _near_two(differ: np.ndarray) -> np.ndarray:
    return (differ <= IN_WORD).all(1) & (differ.sum(1, dtype=np.int64) <= IN_TWO)


def _near_all(differ: np.ndarray) -> np.ndarray:
    return differ.sum(1, dtype=np.int64) <= IN_ALL


def near_forest(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between leading words that connect all rows (a, b) of a group that are near in both words."""
    size = np.bincount(group)[group]
    out = []
    for g in np.unique(group[size > FILE_ROWS]):
        words = np.unique(np.stack([a[group == g], b[group == g]], axis=1), axis=0)
        labels = _pivoted(words, _near_two)
        out.append((words[:, 0], words[labels, 0]))
    some = (size > 1) & (size <= FILE_ROWS)
    group, a, b = group[some], a[some], b[some]
    order = np.lexsort((gray_rank(a), group))
    group, a, b = group[order], a[order], b[order]
    labels = np.arange(len(a))
    for x, y in GrayIndex(group, a, IN_WORD).links() if len(a) else ():
        near = _near_two(np.stack([np.bitwise_count(w[x] ^ w[y]) for w in (a, b)], axis=1))
        labels = union(labels, x[near], y[near])
    out.append((a, a[labels]))
    x, y = (np.concatenate(v) for v in zip(*out, strict=True))
    return x[x != y], y[x != y]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b), sorted by key."""
    for group, rows in _whole_files(_numbers(batches), 1):
        yield _edges(*near_forest(group, rows[1].view(np.uint64), rows[2].view(np.uint64)))


def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, words), sorted by key -> edges between nodes that are near in all words."""

    def tables() -> Iterator[np.ndarray]:
        for batch in batches:
            words = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, WORDS)
            yield np.concatenate([np.stack([batch.column(i).to_numpy() for i in (0, 1)]), words.T])

    for group, rows in _whole_files(tables(), 1):
        for g in np.unique(group):
            own = rows[:, group == g]
            labels = _pivoted(np.ascontiguousarray(own[2:].T).view(np.uint64), _near_all)
            moved = labels != np.arange(len(labels))
            yield _edges(own[1, moved], own[1, labels[moved]])


def _components(nodes: DataFrame) -> DataFrame:
    """(key, node): the component that links of near fingerprints make around a node."""
    rows = nodes.select("keys").mapInArrow(_deal, "key INT, a BIGINT, b BIGINT")
    roots = connected(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_near, "a BIGINT, b BIGINT"))
    release(nodes.sparkSession)
    first = nodes.select("node", F.get("keys", F.lit(0)).alias("fp")).where("fp IS NOT NULL")
    return first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", F.coalesce("root", "fp").alias("key"))


def _again(nodes: DataFrame) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """Splits components that are too large for their sets, by the whole fingerprints."""

    def run(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
        rows = rows.select("key", "node")
        full = rows.join(nodes.select("node", "keys"), "node").select("key", "node", "keys")
        roots = connected(full.repartition("key").sortWithinPartitions("key").mapInArrow(_closer, "a BIGINT, b BIGINT"))
        release(nodes.sparkSession)
        return rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("key"), "node")

    return run


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of texts of a Jaccard similarity of 0.8 or more over five words, as ``minhash.keep_best`` says."""
    return keep_best(df, doc_id, text, near_words, _components, _again, 2)
