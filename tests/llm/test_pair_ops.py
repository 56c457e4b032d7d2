"""Operators on pairs of rows, and on tables as a whole: ops 3, 6, 7, 8 and 10, and the pipeline."""

import glob
import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_data import CLASH, ODD, SF
from pyspark.sql import functions as F

from bitsieve.llm import decontaminate, embeddings, minhash, mixing, registry, simhash, substrings, suffixsort
from bitsieve.llm.components import connected


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    same = lambda v: round(v, 6) if isinstance(v, float) else v
    assert key([same(r[c]) for c in names] for r in got.collect()) == key([same(v) for v in r] for r in cur.fetchall())


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert all(find(n) == root for n, root in got.items())
    assert set(got) == {n for a, b in edges if a != b for n in (a, b)}
    assert connected(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    f, labels = np.array(fps, np.uint64), np.arange(len(fps))
    for i in range(len(f)):
        near = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3)
        labels = simhash.union(labels, np.full(len(near), i), near)
    least = {}
    for i, k in zip(ids, labels.tolist(), strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return [least.get(k) for k in labels.tolist()]


def test_simhash(spark, documents, odd, empty):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, SF).collect()}
    ids, fps = [d for d, _ in documents], [brute_fingerprint(t) for _, t in documents]
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps), strict=True)}
    rows = simhash.near_duplicates(odd).collect()
    ids, fps = [r[0] for r in ODD], [brute_fingerprint(r[1]) if len(r[1] or "") < 1000 else simhash.fingerprint(r[1]) for r in ODD]
    want = Counter(zip(ids, fps, brute_components(ids, fps), strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, None: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, -5: 1, 2**62: 1})


def brute_jaccard(a, b):
    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def brute_keep_one(rows):
    """Indexes of the rows (doc_id, text) that stay: the least id, null last, of each component of pairs at 0.8 or more."""
    label = list(range(len(rows)))
    for i, (_, a) in enumerate(rows):
        for k in range(i):
            if label[i] != label[k] and brute_jaccard(a, rows[k][1]) >= 0.8:
                x, y = label[i], label[k]
                label = [min(x, y) if v in (x, y) else v for v in label]
    best = {}
    for i, k in enumerate(label):
        best[k] = min(best.get(k, i), i, key=lambda j: (rows[j][0] is None, rows[j][0] or 0))
    return set(best.values())


def planted_copies(seed=3, bases=6, copies=14, words=300):
    """(doc_id, text): copies with 0 to 13 words replaced each, of a similarity of 1 down to 0.64, of the base or of the copy before."""
    rng = np.random.default_rng(seed)
    rows = []
    for b in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 5000, words)]
        last = base
        for e in range(copies):
            own = list(last if b % 2 else base)
            for at in rng.choice(words // 8, e, replace=False) * 8 + 2:
                own[at] = f"new{rng.integers(0, 1 << 40)}"
            rows.append((len(rows) * 7 % 83, " ".join(own)))
            last = own
    return rows


@pytest.mark.parametrize("block,rest,levels", [(256, 1024, 3), (4, 0, 2)])
def test_keep_one_links_near_copies(spark, monkeypatch, block, rest, levels):
    """Files that are one cell; files in cells with pivots, whose rest meets all; files that are filed again, and then a grid."""
    monkeypatch.setattr(minhash, "FILE_ROWS", block)
    monkeypatch.setattr(minhash, "REST_ROWS", rest)
    monkeypatch.setattr(minhash, "LEVELS", levels)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    rows = planted_copies(bases=6 if block > 4 else 2)
    at = [brute_jaccard(rows[0][1], t) for _, t in rows[1:14]]
    assert max(at) > 0.95 and sum(0.8 <= x < 0.9 for x in at) > 2 and min(at) < 0.8
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert sorted(r.text for r in minhash.keep_one(df).collect()) == sorted(rows[i][1] for i in brute_keep_one(rows))


def test_keep_one_without_ids(spark):
    """One row of each component, whichever of its rows have ids and whatever else the table holds."""
    a, b, c = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    near = lambda t: t + " tail"
    rows = [(1, a), (None, a), (None, near(a)), (None, b), (None, near(b))]
    for more in ([], [(None, c)], [(7, c)]):
        kept = minhash.keep_one(spark.createDataFrame(rows + more, "doc_id BIGINT, text STRING")).collect()
        assert len(kept) == 2 + len(more) and [r.text for r in kept if r.doc_id == 1] == [a]
        assert sum(r.text in (b, near(b)) for r in kept) == 1


@pytest.mark.parametrize("seed", range(4))
def test_forest(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(40, 60)), replace=False), rng.integers(0, 1 << 60, int(rng.integers(0, 12)), dtype=np.uint64)])) for _ in range(60)]
    want = np.arange(60)
    for i in range(60):
        for k in range(i):
            if minhash.jaccard(sets[i], sets[k]) >= 0.8:
                want = simhash.union(want, np.array([i]), np.array([k]))
    assert (minhash.forest(sets) == want).all() and 1 < len(set(want.tolist())) < 60


@pytest.mark.parametrize("block,rest", [(256, 1024), (4, 4), (4, 0)])
def test_pipeline_near_copies_come_from_fingerprints(spark, monkeypatch, block, rest):
    """Components of near fingerprints that are one cell; in cells with pivots; split by whole fingerprints, and then a grid. No MinHash band is taken."""
    import corpus_pipeline

    monkeypatch.setattr(minhash, "FILE_ROWS", block)
    monkeypatch.setattr(minhash, "REST_ROWS", rest)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    for name in ("bands", "_again", "keep_one"):
        monkeypatch.setattr(minhash, name, None)
    calls, components = [], simhash._components
    monkeypatch.setattr(simhash, "_components", lambda nodes: calls.append(1) or components(nodes))
    rows = planted_copies(seed=5, bases=6 if block > 4 else 2)
    df = spark.createDataFrame([*rows, (500, None), (501, " "), (502, "few words"), (503, "few words"), (504, "few others")], "doc_id BIGINT, text STRING")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, SF).collect()
    assert sorted(r.text for r in kept if r.doc_id < 500) == sorted(rows[i][1] for i in brute_keep_one(rows))
    assert sorted(r.doc_id for r in kept if r.doc_id >= 500) == [500, 502, 504] and calls


@pytest.mark.parametrize("size", [4, 30, 600])
def test_near_fingerprints_reach_a_similarity_of_0_8(size):
    """Pairs at 0.8 share a file and are near there, and in all words; unrelated ones aren't."""
    rng = np.random.default_rng(size)
    pairs = []
    for _ in range(500):
        x = np.unique(rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64))
        rng.shuffle(x)
        lost = size // 9
        pairs += [x[:size], x[lost : size + lost] if lost else x[: size + 1]]
    assert min(minhash.jaccard(np.sort(a), np.sort(b)) for a, b in zip(pairs[::2], pairs[1::2], strict=True)) >= 0.79
    words = np.stack(simhash.near_words(pairs)).view(np.uint64)
    a, b = words[::2], words[1::2]
    differ = np.bitwise_count(a ^ b)
    shared = (np.ascontiguousarray(a).view(np.uint16) == np.ascontiguousarray(b).view(np.uint16)).any(1)
    assert (shared & simhash._near_two(differ[:, :2])).mean() > 0.99 and simhash._near_all(differ).mean() > 0.99
    apart = np.bitwise_count(a[1:] ^ b[:-1])
    assert not simhash._near_two(apart[:, :2]).any() and not simhash._near_all(apart).any()
    assert [len(w) for w in simhash.near_words([np.zeros(0, np.uint64), pairs[0]])] == [0, simhash.WORDS]


@pytest.mark.parametrize("limit", [4, 64, 1024])
def test_near_forest(limit, monkeypatch):
    """Files with and without pivots connect what near pairs connect, and nothing across files."""
    monkeypatch.setattr(simhash, "FILE_ROWS", limit)
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 63, (6, 2), dtype=np.uint64)
    flips = np.array([[sum(1 << int(b) for b in rng.choice(64, int(rng.integers(4, 15)), replace=False)) for _ in "ab"] for _ in range(300)], np.uint64)
    rows, group = base[rng.integers(0, 6, 300)] ^ flips, np.sort(rng.integers(0, 8, 300) ** 2 // 9)
    near = simhash._near_two(np.bitwise_count(rows[:, None] ^ rows[None]).reshape(-1, 2)).reshape(300, 300) & (group[:, None] == group[None])
    want = simhash.union(np.arange(300), *np.nonzero(near))
    at = {int(x): i for i, x in enumerate(rows[:, 0])}
    a, b = simhash.near_forest(group, rows[:, 0].copy(), rows[:, 1].copy())
    got = simhash.union(np.arange(300), np.array([at[int(x)] for x in a]), np.array([at[int(x)] for x in b]))
    assert len(at) == 300 and (got == want).all() and 6 < len(set(want.tolist())) < 200


@pytest.mark.parametrize("rows,limit", [(1, 1024), (700, 1024), (3000, 40)])
def test_simhash_links(spark, rows, limit, monkeypatch):
    """Random fingerprints, chains of near ones, and a dense group that makes files split."""
    monkeypatch.setattr(simhash, "FILE_ROWS", limit)
    rng = np.random.default_rng(rows)
    f = rng.integers(0, 1 << 63, rows, dtype=np.uint64)
    flip = lambda x, n: x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    more = [flip(x, int(rng.integers(1, 5))) for x in f[:100]] + [flip(f[0], int(rng.integers(1, 7))) for _ in range(min(rows, 300))]
    f = np.unique(np.concatenate([f, np.array(more, np.uint64)]))
    edges = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp BIGINT")).collect()
    at = {int(x): i for i, x in enumerate(f.view(np.int64))}
    assert all(int(r.a ^ r.b) and r.a in at and r.b in at for r in edges)
    labels = simhash.union(np.arange(len(f)), np.array([at[r.a] for r in edges], int), np.array([at[r.b] for r in edges], int))
    want = np.arange(len(f))
    for i in range(len(f)):
        near = np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3)
        want = simhash.union(want, np.full(len(near), i), near)
    assert (labels == want).all()


def test_simhash_files_are_whole_beside_many_others(spark):
    """Dense groups among so many other fingerprints that the files' counts aren't broadcast beforehand."""
    import pandas as pd

    rng = np.random.default_rng(1)
    dense = np.full(8000, rng.integers(0, 1 << 63, dtype=np.uint64))
    flips = rng.integers(0, 9, 8000)
    for k in range(9):
        dense[flips > k] ^= np.uint64(1) << rng.integers(0, 64, (flips > k).sum()).astype(np.uint64)
    dense = np.unique(dense)
    f = np.unique(np.concatenate([dense, rng.integers(0, 1 << 63, 300_000, dtype=np.uint64)]))
    edges = simhash.fingerprint_links(spark.createDataFrame(pd.DataFrame({"fp": f.view(np.int64)})).repartition(8)).toPandas()
    a, b = (np.searchsorted(f, edges[c].to_numpy().view(np.uint64)) for c in "ab")
    got = len(np.unique(simhash.union(np.arange(len(f)), a, b)[np.searchsorted(f, dense)]))
    want = np.arange(len(dense))
    for i in range(len(dense)):
        near = np.flatnonzero(np.bitwise_count(dense ^ dense[i]) <= 3)
        want = simhash.union(want, np.full(len(near), i), near)
    assert got == len(np.unique(want))


def test_gray_rank_and_masks():
    code = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert (simhash.gray_rank(code) == np.arange(1000)).all()
    for level, masks in enumerate(simhash.block_masks()):
        assert len(masks) == 4 ** (level + 1)
    assert sorted({64 - m.bit_count() for m in simhash.block_masks()[-1]})[-1] <= 21


def brute_repeats(rows, length=50):
    """(n_bytes, n_removed, n_spans, sha256) of each row, by a table of all strings."""
    order = sorted(range(len(rows)), key=lambda i: substrings.NO_ID if rows[i][0] is None else rows[i][0])
    least = {}
    data = [(r[1] or "").encode() for r in rows]
    rank = [substrings.NO_ID if r[0] is None else r[0] for r in rows]
    for i in order:
        for p in range(len(data[i]) - length + 1):
            least.setdefault(data[i][p : p + length], rank[i])
    out = []
    for i, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if least[d[p : p + length]] < rank[i]:
                gone[p : p + length] = True
        left = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((rows[i][0], len(d), len(d) - len(left), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("common,groups", [(1000, 4096), (3, 4096), (1, 2)])
def test_substrings(spark, documents, odd, empty, monkeypatch, common, groups):
    """Strings of common minimizers one by one, in buckets of all groups and of few."""
    monkeypatch.setattr(substrings, "COMMON", common)
    monkeypatch.setattr(substrings, "SPLIT_GROUPS", groups)
    got = [tuple(r) for r in substrings.op6_substrings(spark, SF).collect()]
    assert key(got) == key(brute_repeats(documents))
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in substrings.remove_repeats(odd).collect()]
    assert key(rows) == key(brute_repeats(ODD))
    assert substrings.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(odd, length=10)


def test_substrings_of_repetitive_text(spark):
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("ab"), 300))
    rows = [(int(rng.integers(0, 12)), base[a : a + int(rng.integers(20, 200))] + "x" * int(rng.integers(0, 120)) + base[b : b + 80]) for a, b in rng.integers(0, 200, (30, 2))] + [(50, "x" * 5000), (51, "x" * 60)]
    got = [tuple(r)[:4] + (hashlib.sha256(r.kept).hexdigest(),) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()]
    assert key(got) == key(brute_repeats(rows))


@pytest.mark.parametrize("bucket", [40, 1 << 19])
def test_suffix_groups(bucket, monkeypatch):
    monkeypatch.setattr(suffixsort, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    for letters in (1, 2, 4):
        base = rng.integers(97, 97 + letters, 300).astype(np.uint8)
        text = np.concatenate([base, base[40:200], rng.integers(97, 120, 5).astype(np.uint8), base[:150]])
        places = rng.permutation(len(text) - 49)
        data, last, total = text.tobytes(), b"", Counter()
        for p, heads in suffixsort.SuffixSorter(text, 50).groups(places):
            for a, b in zip(heads, [*heads[1:], len(p)], strict=True):
                same = {data[q : q + 50] for q in p[a:b].tolist()}
                assert len(same) == 1 and last < min(same)
                last = min(same)
                total[last] += b - a
        assert total == Counter(data[q : q + 50] for q in range(len(text) - 49))


def test_decontaminate_odd(spark, folder, odd, empty):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = decontaminate.contamination(odd, bench).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[None, 22].n_hit == 15 and by[None, 22].contaminated and [tuple(s) for s in by[None, 22].spans] == [(0, 15)]
    assert by[-5, 4].n_hit == 2 and by[-5, 4].items == ["3"]
    assert by[4, 0].n_hit == 0 and not by[4, 0].contaminated
    kept = decontaminate.without_contaminated(odd, bench)
    gone = {r[1] for r in ODD if r[0] in (-5, 2**62) or "no id" in (r[1] or "")}
    assert kept.columns == odd.columns and key(kept.collect()) == key(r for r in odd.collect() if r.text not in gone)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated OR n_hit > 0").count() == 0


def test_decontaminate_by_shuffle(spark, folder, odd, monkeypatch):
    """A set of windows that isn't broadcast gives the same rows; what it shuffles holds no words."""
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = key(decontaminate.op7_decontaminate(spark, SF).collect())
    strange = key(decontaminate.contamination(odd, bench).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontaminate.op7_decontaminate(spark, SF)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan and "SortMergeJoin [h#" in plan
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(h#" in line]
        assert moved and not any("words" in line or "hashes" in line for line in moved)
        assert "Project [row#" in plan.split("Exchange hashpartitioning(h#")[1].splitlines()[1]
        assert key(got.collect()) == want
        assert key(decontaminate.contamination(odd, bench).collect()) == strange
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hits_are_verified(spark, monkeypatch):
    """Were all hashes equal, only windows with the same words would be hits."""
    monkeypatch.setattr(decontaminate, "window_hash", lambda hashes, start, n: F.when(F.get(hashes, start + (n - 1)).isNotNull(), F.lit(1).cast("bigint")))
    bench = spark.createDataFrame([(1, "a b c"), (2, "d e")], "item_id BIGINT, text STRING")
    docs = spark.createDataFrame([(1, "x A-b c, y d f"), (2, "d e d e"), (3, "c b a")], "doc_id BIGINT, text STRING")
    for bound in (1 << 20, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
        rows = {r.doc_id: (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in decontaminate.contamination(docs, bench).collect()}
        assert rows == {1: (7, 3, ["1"], [(1, 4)]), 2: (4, 4, ["2"], [(0, 4)]), 3: (3, 0, [], [])}


def test_mixing_odd(spark, odd, empty):
    rows = mixing.mix(odd).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], size(r[1])) for r in ODD)
    taken, whole = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        whole[r.source] = (r.target, r.source_size)
        assert 0 <= r.taken <= 3 * r.size
    assert all(taken[s] == int(t) and t <= 3 * n for s, (t, n) in whole.items())
    assert np.isclose(sum(t for t, _ in whole.values()), sum(n for _, n in whole.values()))
    assert key(rows) == key(mixing.mix(odd).collect())
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    # Whole rows, each as often as the plan takes it; a text that a budget cuts is the start of one.
    want = Counter()
    for r in rows:
        for e in range(-(-r.taken // r.size) if r.size else 0):
            want[r.doc_id, r.source, min(r.size, r.taken - e * r.size)] += 1
    got = out.collect()
    assert Counter((r.doc_id, r.source, size(r.text)) for r in got) == want
    whole = [r.asDict() for r in odd.collect()]
    for r in got:
        rest = {k: v for k, v in r.asDict().items() if k != "text"}
        assert any({k: v for k, v in w.items() if k != "text"} == rest and (w["text"] or "").startswith(r.text) for w in whole)


def test_mixed_counts_equal_rows_each(spark):
    """Rows that are equal in all columns, without ids too; a table with the names that are used inside."""
    rows = [(1, "a b c", "x", 0)] * 4 + [(None, "d e", "x", 0)] * 3 + [(2, "f", None, 0)] * 2 + [(3, "", "x", 0), (None, None, None, 0)]
    names = ["__row", "taken", "size", "key", "src", "range", "part", "c0", "id"]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, n INT").select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    got, plan = out.collect(), mixing.mix(df).collect()
    assert sum(len(r.text.split()) for r in got) == sum(r.taken for r in plan)
    assert all(tuple(r)[4:] == tuple(range(len(names))) for r in got)
    # Source x has 18 of 20 words and a third of all, 6.67; the null source can give 3 times its 2 words.
    assert Counter((r.source, len(r.text.split())) for r in got if r.source is None) == Counter({(None, 1): 6})
    assert sum(len(r.text.split()) for r in got if r.source == "x") == 14


def test_mixed_keeps_spacing(spark):
    rows = [(i, f"  one{i}\n\ttwo  three\n\n", "x" if i < 3 else "y") for i in range(8)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")).collect()
    text = {i: t for i, t, _ in rows}
    assert all(text[r.doc_id].startswith(r.text) for r in out) and any(r.text != text[r.doc_id] for r in out)


def brute_links(rows):
    def ok(e):
        return e and None not in e and np.isfinite(e).all() and np.any(e)

    out = []
    for i, (_, e, y) in enumerate(rows):
        near = [j for j, (_, f, z) in enumerate(rows) if j != i and y is not None and y == z and ok(e) and ok(f) and len(e) == len(f) and np.dot(e, f) / np.linalg.norm(e) / np.linalg.norm(f) >= 0.93]
        out.append(near)
    label = list(range(len(rows)))
    for _ in rows:
        for i, near in enumerate(out):
            for j in near:
                label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (v, *_), k in zip(rows, label, strict=True):
        if v is not None:
            least[k] = min(least.get(k, v), v)
    return [(v, len(n), least.get(k)) for (v, *_), n, k in zip(rows, out, label, strict=True)]


@pytest.mark.parametrize("block,rows_of_list", [(2048, 8192), (7, 8192), (2048, 40), (7, 5)])
def test_embeddings(spark, monkeypatch, block, rows_of_list):
    """One list of a label, lists of one stage and of two; blocks that hold all, and very small ones."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "QUERIES", 2 * block)
    monkeypatch.setattr(embeddings, "LIST_ROWS", rows_of_list)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 10))
    rows = [(int(i), [float(np.float32(x)) for x in base[i % 60] + rng.normal(size=10) * 0.08 * (i % 5)], int(i % 2)) for i in range(240)]
    e = rows[0][1]
    rows += [(300 + i, e, 0) for i in range(20)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 10, 0), (403, [float("nan")] + e[1:], 0), (404, [float("inf")] + e[1:], 0), (405, [None] + e[1:], 0), (406, e, None), (407, e[:9], 0), (408, [x * 1e-3 for x in e], 0), (0, e, 0), (None, e, 0), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, n INT, cid STRING")
    got = embeddings.near_duplicates(df).collect()
    rounded = [(v, None if x is None else [None if y is None else float(np.float32(y)) for y in x], z) for v, x, z in rows]
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter(brute_links(rounded))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_lists_left_out_hold_no_partner():
    """Where the number of probes doesn't bind, both of a linked pair ask the other's list."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 16))
    x = np.repeat(base, 3, axis=0) + rng.normal(size=(1200, 16)) * 0.12
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = embeddings.fit(x, 2)
    lists, rest = m.near(x, 2, float(np.sqrt(0.14)), 256)
    assert all(np.allclose(m.centre(int(own[0]), 2) + r, v, atol=1e-5) for own, r, v in zip(lists, rest, x, strict=True))
    a, b = np.nonzero(x @ x.T >= 0.93)
    assert all(lists[j, 0] in lists[i] for i, j in zip(a.tolist(), b.tolist(), strict=True))
    assert (lists >= 0).sum() < 0.9 * lists.size and len(set(lists[:, 0].tolist())) > 30


@pytest.mark.parametrize("rows_of_list", [8192, 64])
def test_embedding_recall(spark, monkeypatch, rows_of_list):
    monkeypatch.setattr(embeddings, "LIST_ROWS", rows_of_list)
    d = SF.replace("0.001", "0.1")
    p = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    got = embeddings.op10_embeddings(spark, d).toPandas().set_index("vec_id").n_links
    found = links = 0
    for _, x in p.groupby("label"):
        m = np.array(x.embedding.tolist(), float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        links += int((m @ m.T >= 0.93).sum()) - len(m)
        found += int(got.loc[x.vec_id].sum())
    assert 0.9 * links <= found <= links


def test_pipeline_on_odd_rows(spark, folder, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if n < 4:
            assert out.columns == names
            out.write.parquet(str(tmp_path / str(n)))
            docs = spark.read.parquet(str(tmp_path / str(n)))
    assert out.count() == docs.count() > 0
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, folder).count() == 0, n


def brute_contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit = words(text), set()
    for item in items:
        b = words(item)
        n = min(13, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def brute_mixed(rows):
    """(doc_id, text) as often as taken, of rows (doc_id, text, source)."""
    words = lambda t: re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t or "")
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    size = {s: sum(len(words(r[1])) for r in rows if r[2] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    open_, target, left = set(sources), {}, sum(size.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * size[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    out = []
    for s in sources:
        rest = int(target[s])
        own = sorted(((md5(f"0:{'' if d is None else d}:{md5(t or '')}"), words(t), d, t) for d, t, x in rows if x == s), key=lambda r: (r[0], r[2] or 0, len(r[1])))
        while rest and size[s]:
            for _, w, d, t in own:
                n = min(rest, len(w))
                if n:
                    out.append((d, t if n == len(w) else "".join(w[:n])))
                rest -= n
    return out


def test_pipeline_against_a_plain_version(spark):
    """All stages over the smallest tables, one after another in plain Python."""
    import zlib

    import corpus_pipeline
    from tokenizers import Tokenizer

    from bitsieve.llm import tokenbin, toxicity

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.orderBy("doc_id").collect()]
    scorer = toxicity.train(docs, labels)
    rows = [r for r in rows if scorer.score(np.array([scorer.sums(r[1])]))[0] < toxicity.THRESHOLD]
    kept = brute_keep_one([r[:2] for r in rows])
    rows = [r for i, r in enumerate(rows) if i in kept]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not brute_contaminated(r[1], items)]
    t = Tokenizer.from_file(tokenbin.vocabulary())
    want = Counter()
    for d, text in brute_mixed(rows):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and len(got) > 100
    assert got[0].start == 0 and all(b.start == a.start + a.n_tokens and a.doc_id <= b.doc_id for a, b in zip(got, got[1:], strict=False))
    assert {"__row", "__k", "__mark", "__bs_p0"} <= set(CLASH)


def test_stages_keep_the_rows_of_a_plain_version(spark, tmp_path):
    """Kept ids of the stages that drop rows, on planted copies, insults and benchmark passages."""
    import corpus_pipeline

    from bitsieve.llm import toxicity

    item = " ".join(f"q{i}" for i in range(40))
    rows = [(i + 100 * (n // 83), t) for n, (i, t) in enumerate(planted_copies())]
    rows += [(1000 + i, f"you worthless idiot m{i} go away k{i}") for i in range(60)] + [(2000 + i, f"a calm note m{i} about k{i}") for i in range(60)] + [(3000, "start " + item)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    d = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i < 2000)) for i, _ in rows if 1000 <= i < 3000], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda out: sorted(r.doc_id for r in out.select("doc_id").collect())
    scorer = toxicity.train(df, spark.read.parquet(f"{d}/labels.parquet"))
    clean = [i for i, t in rows if scorer.score(np.array([scorer.sums(t)]))[0] < toxicity.THRESHOLD]
    assert ids(stages["toxicity"](spark, df, d)) == sorted(clean) and not [i for i in clean if 1000 <= i < 2000]
    assert ids(stages["simhash"](spark, df, d)) == sorted(rows[i][0] for i in brute_keep_one(rows))
    assert ids(stages["decontamination"](spark, df, d)) == sorted(i for i, _ in rows if i != 3000)
