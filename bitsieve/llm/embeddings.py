"""Embedding near-dedup by product quantisation over inverted lists.

A bounded sample of unit vectors gives a coarse quantiser, stage by stage on what the
stages before leave, and code books of eight subspaces for the residual. A label's
vectors lie in one inverted list while they are few; beyond that, each stage splits
lists sixteenfold, so that lists stay of a size however many vectors there are. Every
vector is filed in its list as eight bytes of code, and asks the lists around it: those
that a vector within the wanted distance of it could lie in, nearest first.

In a list, distances from a query come from table lookups; the code's own error, kept
with it, makes the bound exact, so the filter itself loses nothing. What is left is
decided by the cosine in double precision.

Equal vectors are one row with a count. Rows and queries of a list meet in blocks of
bounded size, each pair in one block. A block returns counts of links and a spanning
forest, never pairs. What moves is a vector for each list it asks, besides its own;
only a list that holds more near-equal vectors than a block takes more, since each
of their pairs is a link to be counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from bitsieve.llm.common import table
from bitsieve.llm.components import connected
from bitsieve.llm.simhash import union
from bitsieve.session import cut

COSINE = 0.93
#: Vectors that the quantisers are fitted on, about.
SAMPLE = 20_000
#: Rows of a label in one list, beyond which the next stage splits it, and into how many.
LIST_ROWS, SPLIT = 8192, 16
#: Most stages: 16^7 lists of a label.
STAGES = 7
#: Lists that a vector asks at most, its own among them.
PROBES = 12
SUBSPACES, CODES = 8, 256
#: Filed rows, and queries from other lists, in one block.
BLOCK, QUERIES = 2048, 8192
#: Queries whose tables are held at once, and pairs whose cosines are.
TABLES, PAIRS = 128, 1 << 15


@dataclass
class Quantiser:
    """``stages``: centroids of each stage; ``books``: subspace, code, dimension in the subspace."""

    stages: list[np.ndarray]
    books: np.ndarray

    def near(self, x: np.ndarray, depth: int, reach: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, residual in the own list): the own list of each row first, then others, nearest first; -1 where there are no more.

        A list is left out if no vector within ``reach`` of the row can lie in it: the
        row is farther than that from the plane between the list's centroid and the best.
        """
        n = len(x)
        lists, rest, alive = np.zeros((n, 1), np.int64), x[:, None, :].astype(np.float32), np.ones((n, 1), bool)
        for c in self.stages[:depth]:
            far = (rest**2).sum(2)[:, :, None] + (c**2).sum(1) - 2 * rest @ c.T
            best = far.argmin(2)
            apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 1e-12))
            low = np.take_along_axis(far, best[:, :, None], 2)
            ok = alive[:, :, None] & (far - low <= 2 * (reach + 1e-3) * apart[best])
            cost = np.where(ok, far, np.inf)
            # The row's own path is greedy and comes first.
            cost[np.arange(n), 0, best[:, 0]] = -1.0
            flat = cost.reshape(n, -1)
            k = min(probes, flat.shape[1])
            top = np.argpartition(flat, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(np.take_along_axis(flat, top, 1), axis=1, kind="stable"), 1)
            alive = np.isfinite(np.take_along_axis(flat, top, 1))
            parent, child = top // len(c), top % len(c)
            lists = np.take_along_axis(lists, parent, 1) * SPLIT + child
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - c[child]
        return np.where(alive, lists, -1), rest[:, 0]

    def centre(self, number: int, depth: int) -> np.ndarray:
        """What a list's residuals are taken from."""
        digits = [number // SPLIT ** (depth - 1 - i) % SPLIT for i in range(depth)]
        return sum((c[d] for c, d in zip(self.stages, digits, strict=False)), np.zeros(self.books.shape[0] * self.books.shape[2], np.float32))

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error: distance of each residual from what its code stands for)."""
        parts = residual.reshape(len(residual), len(self.books), -1)
        codes, lost = [], np.zeros(len(residual))
        for s, book in enumerate(self.books):
            c = ((book**2).sum(1) - 2 * parts[:, s] @ book.T).argmin(1)
            codes.append(c)
            lost += ((parts[:, s] - book[c]) ** 2).sum(1)
        return np.stack(codes, 1).astype(np.uint8), np.sqrt(lost)

    def lookup(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances, squared: queries by filed rows."""
        parts = residuals.reshape(len(residuals), len(self.books), -1)
        d = np.zeros((len(residuals), len(codes)), np.float32)
        for s, book in enumerate(self.books):
            q = parts[:, s]
            tables = (q**2).sum(1, keepdims=True) - 2 * q @ book.T + (book**2).sum(1)
            d += tables.astype(np.float32)[:, codes[:, s]]
        return np.maximum(d, 0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """``k`` centroids; rows that repeat may leave some equal."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(steps):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        order = np.argsort(near, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(near[order]) > 0]))
        c[near[order][head]] = np.add.reduceat(x[order], head, axis=0) / np.diff(np.append(head, len(x)))[:, None]
    return c


def fit(x: np.ndarray, depth: int, seed: int = 7) -> Quantiser:
    """Unit vectors of a sample -> stages and code books of what they leave."""
    rng = np.random.default_rng(seed)
    rest, stages = x.astype(np.float32), []
    for _ in range(depth):
        c = _kmeans(rest, SPLIT, rng)
        stages.append(c)
        rest = rest - c[((c**2).sum(1) - 2 * rest @ c.T).argmin(1)]
    parts = rest.reshape(len(x), SUBSPACES, -1)
    return Quantiser(stages, np.stack([_kmeans(parts[:, s], CODES, rng, 5) for s in range(SUBSPACES)]))


def _unit(raw: list[bytes], kind: str, width: int) -> np.ndarray:
    """Unit vectors in double precision, padded to a common width that the subspaces divide."""
    if len({len(b) for b in raw}) == 1:
        v = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
        out = np.zeros((len(raw), width))
        v /= np.abs(v).max(1, keepdims=True)
        out[:, : v.shape[1]] = v / np.sqrt((v * v).sum(1, keepdims=True))
        return out
    return np.concatenate([_unit([b], kind, width) for b in raw]) if raw else np.zeros((0, width))


def _kind(df: DataFrame, embedding: str) -> str:
    """How components are carried: as floats where the column holds floats, else as doubles."""
    t = df.schema[embedding].dataType
    return "<f4" if isinstance(t, ArrayType) and isinstance(t.elementType, FloatType) else "<f8"


def classes(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, cid, part, vec): cid names equal vectors of a label; null for vectors that link with nothing."""
    kind = _kind(df, embedding)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, labels = b.column(1), b.column(2).to_pylist()
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(kind)) + np.dtype(kind).type(0)  # nulls are NaN, and there is one zero
            size = np.where(np.asarray(lists.is_valid()), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            end = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            ok = (bad[end] == bad[end - size]) & (some[end] > some[end - size])
            cids, parts, vecs = [], [], []
            for good, n, stop, y in zip(ok.tolist(), size.tolist(), end.tolist(), labels, strict=True):
                if good and y is not None:
                    raw, part = flat[stop - n : stop].tobytes(), f"{n}:{y}"
                    cids.append(hashlib.md5(part.encode() + b"\0" + raw).digest())
                    parts.append(part)
                    vecs.append(raw)
                else:
                    cids.append(None)
                    parts.append(None)
                    vecs.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cids, pa.binary()), pa.array(parts, pa.string()), pa.array(vecs, pa.binary())], names=["vec_id", "cid", "part", "vec"])

    element = "array<float>" if kind == "<f4" else "array<double>"
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast(element).alias("e"), F.col(label).cast("string").alias("y"))
    return rows.mapInArrow(run, "vec_id BIGINT, cid BINARY, part STRING, vec BINARY")


def links(distinct: DataFrame, kind: str, cosine: float = COSINE, probes: int = PROBES) -> tuple[DataFrame, DataFrame] | None:
    """(id, part, vec, n), id unique -> (id, linked: sum of the n of linked rows), (a, b: edges that connect all links)."""
    spark = distinct.sparkSession
    sizes = cut(distinct.groupBy("part").agg(F.count("*").alias("rows"), F.max(F.octet_length("vec")).alias("bytes")))
    n, most, longest = sizes.agg(F.sum("rows"), F.max("rows"), F.max("bytes")).first()
    if not n:
        return None
    width = -(-longest // int(kind[-1]) // SUBSPACES) * SUBSPACES
    share = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = sorted(bytes(r.vec) for r in distinct.where(share).select("vec").collect()) or [bytes(distinct.select("vec").first().vec)]
    stages = lambda rows: min(STAGES, next(d for d in range(99) if rows <= LIST_ROWS * SPLIT**d))
    model = spark.sparkContext.broadcast(fit(_unit(sample, kind, width), stages(most)))
    reach = float(np.sqrt(2 - 2 * cosine))
    # How many stages a label's lists have, by its number of rows.
    depth = F.lit(0)
    for d in range(stages(most)):
        depth = F.when(F.col("rows") > LIST_ROWS * SPLIT**d, d + 1).otherwise(depth)
    depths = sizes.select("part", depth.alias("depth"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                rows = b.slice(lo, 2048)
                x, depth = _unit(rows.column(2).to_pylist(), kind, width), rows.column(4).to_numpy()
                near, codes, lost = [None] * len(x), [b""] * len(x), np.zeros(len(x))
                for d in np.unique(depth).tolist():
                    at = np.flatnonzero(depth == d)
                    lists, rest = m.near(x[at], d, reach, probes)
                    code, error = m.encode(rest)
                    lost[at] = error
                    for i, own, c in zip(at.tolist(), lists, code, strict=True):
                        near[i], codes[i] = own[own >= 0].tolist(), c.tobytes()
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near, pa.list_(pa.int64())), pa.array(codes, pa.binary()), pa.array(lost)], names=["id", "part", "vec", "n", "depth", "near", "code", "lost"])

    filed = cut(distinct.select("id", "part", "vec", "n").join(depths, "part").select("id", "part", "vec", "n", "depth").mapInArrow(file, "id BIGINT, part STRING, vec BINARY, n BIGINT, depth INT, near ARRAY<BIGINT>, code BINARY, lost DOUBLE"))
    home = filed.withColumn("list", F.col("near")[0])
    ask = filed.withColumn("list", F.explode(F.slice("near", 2, probes)))
    both = home.groupBy("part", "list").agg(F.count("*").alias("d")).join(ask.groupBy("part", "list").agg(F.count("*").alias("q")), ["part", "list"], "left")
    blocks = lambda c, size: F.ceil(F.coalesce(F.col(c), F.lit(0)) / size).cast("int")
    size = cut(both.select("part", "list", blocks("d", BLOCK).alias("nd"), blocks("q", QUERIES).alias("nq")))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # Cells of a list: data block i with data block j >= i, and with each block of queries.
    own = F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda k: F.struct(F.least(k, "b").alias("i"), F.greatest(k, "b").alias("j"), (k > F.col("b")).alias("query")))
    asked = F.when(F.col("nq") > 0, F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda k: F.struct(F.col("b").alias("i"), (-1 - k).alias("j"), F.lit(False).alias("query")))).otherwise(F.array().cast("array<struct<i:int,j:int,query:boolean>>"))
    keep = ["part", "list", "depth", "cell", "id", "n", "vec", "near", "code", "lost"]
    data = home.join(size, ["part", "list"]).withColumn("b", (at % F.col("nd")).cast("int")).withColumn("cell", F.explode(F.concat(own, asked))).select(keep)
    each = F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda k: F.struct(k.alias("i"), (-1 - F.col("b")).alias("j"), F.lit(True).alias("query")))
    probe = ask.join(size, ["part", "list"]).withColumn("b", (at % F.col("nq")).cast("int")).withColumn("cell", F.explode(each))
    probe = probe.select("part", "list", "depth", "cell", "id", "n", "vec", F.slice("near", 1, 1).alias("near"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("lost"))
    rows = data.unionByName(probe).select("part", "list", "depth", "cell.i", "cell.j", "cell.query", "id", "n", "vec", "near", "code", "lost")
    key = ["part", "list", "i", "j"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = list(zip(*[b.column(b.schema.get_field_index(k)).to_pylist() for k in key], strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if last is not None and keys[lo] != last:
                        yield from _cell(held, model.value, kind, width, cosine)
                        held = []
                    held.append(b.slice(lo, hi - lo))
                    last = keys[lo]
        if held:
            yield from _cell(held, model.value, kind, width, cosine)

    rows = rows.repartition(*key).sortWithinPartitions(*key)
    found = cut(rows.mapInArrow(solve, "id BIGINT, linked BIGINT, other BIGINT"))
    return found.groupBy("id").agg(F.sum("linked").alias("linked")).where("linked > 0"), found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))


def _cell(held: list[pa.RecordBatch], m: Quantiser, kind: str, width: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Links of one cell: of the filed rows among each other (i = j), or of queries with filed rows."""
    t = pa.Table.from_batches(held)
    number, i, j, depth = (t.column(c)[0].as_py() for c in ("list", "i", "j", "depth"))
    query = t.column("query").to_numpy()
    if i == j:
        query = np.zeros(len(query), bool)
    ids, times = t.column("id").to_numpy(), t.column("n").to_numpy()
    d = np.flatnonzero(~query)
    q = d if i == j else np.flatnonzero(query)
    if not len(d) or not len(q):
        return
    unit = _unit(t.column("vec").to_pylist(), kind, width)
    # In a cell of two data blocks both sides have codes; those of the first are asked.
    codes = np.frombuffer(b"".join(t.column("code").take(pa.array(d)).to_pylist()), np.uint8).reshape(len(d), -1)
    bound = (np.float32(np.sqrt(2 - 2 * cosine) + 1e-3) + t.column("lost").to_numpy()[d].astype(np.float32)) ** 2
    rest = unit[q].astype(np.float32) - m.centre(number, depth)
    lefts, rights = [], []
    near = t.column("near").take(pa.array(d)).to_pylist() if j < 0 else None
    homes = np.array([x[0] for x in t.column("near").take(pa.array(q)).to_pylist()]) if j < 0 else None
    for lo in range(0, len(q), TABLES):
        a, b = np.nonzero(m.lookup(rest[lo : lo + TABLES], codes) <= bound)
        a += lo
        if i == j:
            first = a < b
            a, b = a[first], b[first]
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            ok = np.einsum("ij,ij->i", unit[q[x]], unit[d[y]]) >= cosine
            lefts.append(x[ok])
            rights.append(y[ok])
    a, b = np.concatenate(lefts or [np.zeros(0, np.int64)]), np.concatenate(rights or [np.zeros(0, np.int64)])
    if j < 0 and len(a):
        # A pair that meets in the homes of both counts in the lower one.
        twice = np.fromiter((h < number and h in near[y] for h, y in zip(homes[a].tolist(), b.tolist(), strict=True)), bool, len(a))
        a, b = a[~twice], b[~twice]
    if not len(a):
        return
    a, b = q[a], d[b]
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    linked = np.bincount(x, times[b], len(names)) + np.bincount(y, times[a], len(names))
    labels = union(np.arange(len(names)), x, y)
    other = pa.array(ids[names[labels]], mask=labels == np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[names]), pa.array(np.rint(linked).astype(np.int64)), other], names=["id", "linked", "other"])


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null, their vectors have the same
    length, and the cosine is ``cosine`` or more. A vector that is null, empty or
    zero, or holds a null or a non-finite component, links with nothing and is its
    own component. Rows that repeat an id are vectors of their own; a null id names
    no component and is never kept. An empty table gives an empty table.
    """
    rows = cut(classes(df, vec_id, embedding, label))
    good = rows.where("cid IS NOT NULL")
    distinct = good.groupBy("cid", "part").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.any_value("vec").alias("vec"))
    # Numbered once and written, so that the numbers stay.
    distinct = cut(distinct.withColumn("id", F.monotonically_increasing_id()))
    alone = rows.where("cid IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = links(distinct, _kind(df, embedding), cosine, probes)
    if found is None:
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    linked, edges = found
    roots = connected(edges).withColumnRenamed("node", "id")
    full = distinct.select("id", "cid", "first", "n").join(linked, "id", "left").join(roots, "id", "left")
    full = cut(full.select("cid", "first", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")))
    least = cut(full.groupBy("root").agg(F.min("first").alias("component_id")))
    full = cut(full.join(least, "root").select("cid", "n_links", "component_id"))
    out = good.select("vec_id", "cid").join(full, "cid").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates(table(spark, d, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, a.e) > 0 AND list_inner_product(b.e, b.e) > 0 AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = v.vec_id
"""
