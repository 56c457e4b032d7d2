"""Operators that look at one text at a time: ops 1, 2, 4, 5 and 9."""

import random
import zlib

import numpy as np
import pytest
from conftest_data import ODD, SF
from pyspark.sql import functions as F

from bitsieve.llm import language, quality, tokenbin, tokencount, toxicity


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=str)


WANT = sorted((r[0] for r in ODD), key=str)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, odd, empty, labels, module, label):
    for known in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        model = module.train(odd, known)
        rows = module.score(odd, model).collect()
        assert ids(rows) == WANT and all(0 <= r.score <= 1 for r in rows)
    assert module.score(empty, model).count() == 0
    assert module.train(empty, labels) is not None


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1.0
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("query,label,least", [(quality.op1_quality, "quality", 0.95), (toxicity.op2_toxicity, "toxic", 0.9)])
def test_held_out(spark, query, label, least):
    d = SF.replace("0.001", "0.1")
    rows = query(spark, d).toPandas()
    assert len(rows) == 10_000 and rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    both = rows.merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    k = {"quality": (5, 0), "toxic": (4, 2)}[label]
    assert all((zlib.crc32(str(i).encode()) % k[0] == k[1]) == h for i, h in zip(rows.doc_id, rows.held_out, strict=True))
    assert auc(held.score.to_numpy(), held[label].to_numpy()) > least


def test_discriminant_is_the_density(rng=None):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0, 1], 300)
    d = quality._fit(x, y, 0.2, 0.1)
    z = (x[:5] - d.centre) / d.scale

    def log_density(c):
        inv = d.inverses[c]
        s = np.linalg.inv(inv.T @ inv)
        v = z - d.means[c]
        return -0.5 * np.einsum("ij,jk,ik->i", v, np.linalg.inv(s), v) - 0.5 * np.log(np.linalg.det(s))

    assert np.allclose(d.difference(x[:5]), log_density(1) - log_density(0))


CLAUSES = {
    True: ["you idiot", "what an idiot.", "idiots like you ruin this", "so you are such a total idiot", "they are idiots", "i will kill you", "get out, idiot", "you idiots don't get it"],
    False: ["he is not an idiot", "she said what an idiot", "an idiot, he said", "idiot you are not", "according to him: never an idiot", "i will not kill you", "they killed time", "you are an antiidiot", "he said you idiot"],
}


def test_grammar_tells_clauses_apart_that_share_their_words():
    """The same stem in all clauses: the grammar separates them, stems alone can't."""
    curve = np.array([4.0, 0.0, -3.0])
    of = lambda s, t: s.score(np.array([s.sums(t)]))[0]
    full, flat = (toxicity.Scorer({"idiot": (2.0, 0.0)}, curve, arcs) for arcs in (None, toxicity.FLAT))
    right = lambda s: sum((of(s, t) >= toxicity.THRESHOLD) == y for y, ts in CLAUSES.items() for t in ts) / sum(map(len, CLAUSES.values()))
    assert right(full) == 1.0 and right(flat) < 0.75
    kind = lambda t: {k: round(v, 3) for k, v in zip(toxicity.KINDS, full.sums(t), strict=True) if v}
    assert kind("what an idiot. IDIOTIC!") == {"plain": 4.0}
    assert kind("you idiot") == kind("idiots like you") == {"aimed": 2.8}
    assert kind("he is not an idiot") == {"negated": round(2 * 0.15 * 1.4, 3)} and kind("she said what an idiot") == kind("an idiot, she said") == {"reported": 0.7}
    assert kind("such an idiot") == {"plain": 2.4}
    assert kind("i will kill you") == {"threat": 2.8} and kind("they kill") == {} and kind(None) == {}
    assert toxicity.Scorer({}, curve).sums("nothing here " * 5000)[-1] == 0


def test_arcs_are_learned():
    """Rows in which negated insults are toxic and reported ones aren't move the arcs' weights."""
    s = toxicity.Scorer({"idiot": (2.0, 0.0)})
    rows = [("you are not an idiot", 1), ("a calm day", 0), ("he said idiot", 0), ("you idiot", 1)] * 150
    x = np.array([s.by_marks(t) for t, _ in rows])
    curve, arcs = toxicity.fit(x, np.array([y for _, y in rows]))
    assert arcs["neg"] > toxicity.ARCS["neg"] and arcs["said"] < toxicity.ARCS["said"] and curve[0] > 0


@pytest.mark.parametrize("seed", range(3))
def test_composition_equals_running_in_turn(seed):
    plain, every = toxicity.symbols(()), toxicity.symbols(toxicity.ALL)
    w = toxicity.ARCS
    forward = [toxicity.marker(toxicity.NEG, "neg", 3, (), w["neg"]), toxicity.marker(toxicity.SAID, "said", None, ("neg",), w["said"]), toxicity.marker(toxicity.AIM, "aim", 4, ("neg", "said"), w["aim"])]
    forward += [toxicity.marker(toxicity.BOOST, "boost", 2, ("neg", "said", "aim"), w["boost"]), toxicity.marker(toxicity.MEANT, "meant", 3, ("neg", "said", "aim", "boost"), 1.0)]
    backward = [toxicity.closing(toxicity.NEG, "neg", 4, toxicity.ALL, w["neg"]), toxicity.marker(toxicity.SAID, "said", None, toxicity.ALL, w["said"]), toxicity.marker(toxicity.AIM, "aim", 3, toxicity.ALL, w["aim"]), toxicity.verdicts(toxicity.ALL)]
    rng = random.Random(seed)
    for machines, composed, alphabet in zip((forward, backward), toxicity.grammar(), (plain, every), strict=True):
        for _ in range(20):
            states, c = [0] * len(machines), 0
            for x in rng.choices(alphabet, k=12):
                mid, weight = x, 1.0
                for i, m in enumerate(machines):
                    states[i], mid, v = m.step(states[i], mid)
                    weight *= v
                c, out, total = composed.step(c, x)
                assert out == mid and np.isclose(weight, total)


def test_grammar_costs_nothing_on_held_out_rows(spark):
    d = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    s = toxicity.train(docs, labels)
    held = [r for r in docs.join(labels, "doc_id").where("toxic IS NOT NULL").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    y = np.array([r.toxic for r in held])
    right = lambda s: ((s.score(np.array([s.sums(r.text) for r in held])) >= toxicity.THRESHOLD) == y).mean()
    assert right(s) >= right(toxicity.Scorer(s.stems, s.curve, toxicity.FLAT)) >= 0.9
    assert right(s) > right(toxicity.Scorer({}, s.curve)) and y.sum() > 5
    # The query's rows, by a plain loop over the same model.
    rows = {r.doc_id: r for r in toxicity.score(docs, s).collect()}
    assert all(np.allclose([rows[r.doc_id][k] for k in toxicity.KINDS], s.sums(r.text)) for r in held)


def test_filter_keeps_columns(spark, odd, empty, labels):
    scorer = toxicity.Scorer({"idiot": (5.0, 0.0), "moron": (5.0, 0.0)}, np.array([3.0, 0.0, -4.0]))
    kept = toxicity.without_toxic(odd, scorer)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in odd.collect() if r.doc_id != 9)
    assert toxicity.without_toxic(empty, scorer).count() == 0


def test_every_stem_beyond_chance_is_learned(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in (0, 1)) + "xqz" for i in range(450)]
    toxic = [f"{w} {i}" for w in words for i in range(12)]
    rows = [(i, int(i < len(toxic)), t) for i, t in enumerate(toxic + [f"und {i}" for i in range(20_000)])]
    stems = toxicity.learn_stems(spark.createDataFrame(rows, "k BIGINT, y INT, t STRING"))
    assert all(any(w.startswith(s) for s in stems) for w in words) and len(stems) > 400


def test_quality_against_a_plain_version(spark, documents):
    """The query's rows: classes estimated and densities taken without Cholesky factors."""
    import duckdb

    known = sorted({(k, y) for k, y in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet' WHERE quality IN (0, 1)").fetchall() if zlib.crc32(str(k).encode()) % 5})
    text = dict(documents)
    x, y = np.array([quality.statistics(text[k]) for k, _ in known]), np.array([y for _, y in known])
    d = quality.fit(x, y)
    scale = lambda v: (v - x.mean(0)) / (x.std(0) + 1e-6)

    def density(z, c):
        s = np.linalg.inv(d.inverses[c].T @ d.inverses[c])
        v = z - scale(x[y == c]).mean(0)
        return -0.5 * v @ np.linalg.solve(s, v) - 0.5 * np.linalg.slogdet(s)[1]

    for r in quality.op1_quality(spark, SF).collect():
        z = scale(np.array(quality.statistics(text[r.doc_id])))
        score = 1 / (1 + np.exp(-(np.arcsinh(density(z, 1) - density(z, 0)) * d.curve[0] + d.curve[1])))
        assert np.isclose(r.score, score, atol=1e-6) and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_against_a_plain_version(spark, documents):
    """The query's rows: n-grams counted in one loop, and the best path by a plain dynamic programme."""
    import duckdb

    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    names = sorted({v for v in lang.values() if v})
    counts = np.full((1 << language.TABLE_BITS, len(names)), language.SMOOTH)
    for k, t in documents:
        if t is not None and lang[k] and zlib.crc32(str(k).encode()) % 5:
            for slot in language.grams(language.coded(t))[1]:
                for i in slot.tolist():
                    if i < len(counts):
                        counts[i, names.index(lang[k])] += 1
    logp = np.log(counts / counts.sum(0))
    model = language.train(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.langs == names and np.allclose(model.weights[:-1], logp - logp.mean(1, keepdims=True), atol=1e-5)
    got = {r.doc_id: r for r in language.op4_language(spark, SF).collect()}
    for k, t in documents:
        scores, letters = model.word_scores(t or "")
        if not len(scores):
            assert got[k].lang_pred == "und"
            continue
        best = scores[0].copy()
        for x in scores[1:]:
            best = np.maximum(best, best.max() - language.PENALTY) + x
        # The path the query takes is worth as much as any; several may be.
        path = language.viterbi(scores, language.PENALTY)
        assert np.isclose(scores[np.arange(len(path)), path].sum() - language.PENALTY * (path[1:] != path[:-1]).sum(), best.max())
        share = np.bincount(path, letters, len(names)) / letters.sum()
        assert got[k].lang_pred == names[int(share.argmax())] and np.isclose(got[k].score, share.max())


def test_viterbi_on_stretches_that_pay_only_together():
    assert language.viterbi(np.array([[50.0, 60, 0], [50, 0, 60]]), 12).tolist() == [1, 2]
    s = np.array([[20.0, 0, 0], [5, 0, 6], [0, 5, 6], [0, 20, 0]])
    path = language.viterbi(s, 4)
    assert s[np.arange(4), path].sum() - 4 * (path[1:] != path[:-1]).sum() == 46


def test_conflicting_labels_teach_nothing(spark):
    from bitsieve.llm.learn import labelled

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id BIGINT, text STRING")
    known = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 7)], "doc_id BIGINT, toxic INT")
    rows, counts = labelled(docs, known, "doc_id", "text", "toxic", F.lit(True), 100)
    assert sorted(map(tuple, rows.collect())) == [(0, 1, "text 0"), (2, 0, "text 2")] and counts == {0: 1, 1: 1}


def test_bytes_that_are_not_utf8(spark, labels):
    """Every operator on texts takes them; the others' rows are what they are without."""
    from bitsieve.llm import minhash, simhash, substrings

    rows = spark.sql("SELECT CAST(1 AS BIGINT) AS doc_id, CAST(X'61FF62' AS STRING) AS text, 'en' AS lang, 's' AS source, 3L AS n_chars UNION ALL SELECT 2, 'plain words here', 'en', 's', 16")
    assert ids(quality.score(rows, quality.train(rows, labels)).collect()) == [1, 2]
    scorer = toxicity.Scorer({"plain": (9.0, 0.0)}, np.array([9.0, 0.0, -3.0]))
    assert {r.doc_id: r.score > 0.5 for r in toxicity.score(rows, scorer).collect()} == {1: False, 2: True}
    assert [bytes(r[0]) for r in toxicity.without_toxic(rows, scorer).select(F.col("text").cast("binary")).collect()] == [b"a\xffb"]
    assert ids(language.predict(rows, language.train(rows)).collect()) == [1, 2]
    assert {r.doc_id: r.fp for r in simhash.near_duplicates(rows).collect()}[1] == np.uint64(simhash.fingerprint(b"a\xffb")).astype(np.int64)
    assert {r.doc_id: bytes(r.kept) for r in substrings.remove_repeats(rows).collect()}[1] == b"a\xffb"
    assert ids(tokencount.token_counts(rows).collect()) == ids(tokenbin.encode_documents(rows).collect()) == ids(minhash.keep_one(rows).collect()) == [1, 2]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    import itertools

    for _ in range(40):
        s = rng.normal(0, 3, (6, 3))
        path = language.viterbi(s, 4.0)
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(map(value, (p for p in itertools.product(range(3), repeat=6) if all(p[i] == p[i - 1] or s[i].argmax() != s[i - 1].argmax() for i in range(1, 6)))))
        assert np.isclose(value(path.tolist()), best)


def test_viterbi_against_every_path():
    """Also those that change between words which favour the same language, and those that only pay with two stretches together."""
    import itertools

    rng = np.random.default_rng(11)
    paths = np.array(list(itertools.product(range(3), repeat=6)))
    changes = (paths[:, 1:] != paths[:, :-1]).sum(1)
    for penalty in (4.0, 8.0):
        for s in rng.normal(0, 3, (400, 6, 3)):
            path = language.viterbi(s, penalty)
            value = s[np.arange(6), path].sum() - penalty * (path[1:] != path[:-1]).sum()
            assert np.isclose(value, (s[np.arange(6), paths].sum(1) - penalty * changes).max())
    halves = np.array([[9.95, 0.0, 0.05], [-90.0, 9.95, 0.05]])
    halves[0, 1] = -90.0
    assert language.viterbi(halves, 12.0).tolist() == [0, 1]


def test_language(spark, odd, empty):
    d = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = language.op4_language(spark, d).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(rows) == 1000 and (held.lang == held.lang_pred).mean() > 0.97
    model = language.train(docs)
    de = docs.where("lang = 'de'").first().text
    fr = docs.where("lang = 'fr'").first().text
    _, _, spans = model.label(f"{fr} {de} {fr}")
    assert [s[2] for s in spans][:: max(1, len(spans) - 1)] == ["fr", "fr"] and "de" in {s[2] for s in spans}
    out = language.predict(odd, model, spans=True).collect()
    assert ids(out) == WANT and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (3, 4, 5)} == {"und"}
    assert language.predict(empty, language.train(empty)).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.train(empty)).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(i, f"text {i}", f"l{i % 230:03}") for i in range(2300)]
    model = language.train(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING"), sample=5)
    assert model.langs == [f"l{k:03}" for k in range(230)]


def test_scripts_narrow():
    m = language.Model(["en", "ru"], np.zeros(((1 << language.TABLE_BITS) + 1, 2), np.float32), np.zeros((len(language._GROUPS), 2), bool))
    m.allowed[language._GROUPS.index("latin"), 0] = m.allowed[language._GROUPS.index("cyrillic"), 1] = True
    assert m.label("слово дело")[0] == "ru" and m.label("word")[0] == "en"
    assert language.script_name("é") == "latin" and language.script_name("日") == "han"


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_elias_fano(n):
    rng = np.random.default_rng(n)
    for top in (1, n + 1, 1 << 40, (1 << 63) + 5):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = tokenbin.EliasFano.from_bytes(tokenbin.EliasFano.encode(v).to_bytes())
        assert (e.decode() == v).all() and all(e[i] == int(v[i]) for i in range(0, n, 37))
        for a, b in rng.integers(0, n + 3, (20, 2)).tolist():
            assert (e.slice(a, b) == v[a:b]).all()
        for x in [0, *v[::91].tolist(), *(v[::101] + np.uint64(1)).tolist()]:
            assert e.find(x) == np.searchsorted(v, np.uint64(x))
        with pytest.raises(IndexError):
            e[n]
    small = tokenbin.EliasFano.encode(np.arange(0, 100_000, 100, dtype=np.uint64))
    assert len(small.to_bytes()) < 1000 * 10 / 8 + 100


def test_token_ids_round_trip(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(tokenbin.vocabulary()), 0
    got = {r.doc_id: r for r in tokenbin.op5_token_ids(spark, SF).collect()}
    for doc, text in documents:
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_token_ids_of_odd_rows(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenbin.vocabulary())
    tokenbin.write_ids(odd, str(tmp_path / "a"), tokenbin.vocabulary())
    rows = tokenbin.read_ids(spark, str(tmp_path / "a"), keep_ids=True).orderBy("start").collect()
    want = [t.encode(text or "", add_special_tokens=False).ids + [2] for _, text, *_ in ODD]
    assert sorted(map(list, (r.ids for r in rows))) == sorted(want)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ODD), key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    asked = [1, 2, 8, -5, 2**62, 77, -99]
    found = tokenbin.lookup_ids(spark, str(tmp_path / "a"), asked).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in found) == sorted((r[0], w) for r, w in zip(ODD, want, strict=True) if r[0] in asked)
    tokenbin.write_ids(empty, str(tmp_path / "b"), tokenbin.vocabulary())
    assert tokenbin.read_ids(spark, str(tmp_path / "b")).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenbin.vocabulary())
    enc = tokenbin.TokenEncoder(open(tokenbin.vocabulary()).read())
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab Zé9²\n\t\x1c\x85\xa0'sll.!_日ß-", k=rng.randrange(40))) for _ in range(3000)]
    assert [b for b in enc.encode(texts)] == [np.array(e.ids, "<u2").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def brute_counts(model, word):
    data = word.encode()
    best = [(0.0, 0)]
    for end in range(1, len(data) + 1):
        high = (best[-1][0] + model.worst, best[-1][1] + 1)
        for i in range(end - 1, -1, -1):
            s = model.score.get(data[i:end])
            if s is not None and best[i][0] + s >= high[0]:
                high = (best[i][0] + s, best[i][1] + 1)
        best.append(high)
    return best[-1]


def test_token_counts(spark, odd, empty, documents, monkeypatch):
    model = tokencount.Unigram(tokencount.load_pieces(tokencount.vocabulary()))
    words = sorted({w for _, t in documents for w in tokencount.pretokens(t)})[::7]
    assert model.best(words) == {w: brute_counts(model, w) for w in words}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.op9_token_counts(spark, SF).collect()}
    want = {}
    memo = {}
    for doc, t in documents:
        p = tokencount.pretokens(t)
        assert "".join(p) == (t or "")
        want[doc] = (len(p), sum(memo.setdefault(w, None) or memo.__setitem__(w, brute_counts(model, w)[1]) or memo[w] for w in p))
    assert got == want
    rows = tokencount.token_counts(odd).collect()
    assert ids(rows) == WANT and all(r.n_tokens == 0 for r in rows if r.doc_id in (3, 4))
    assert tokencount.token_counts(empty).count() == 0
    monkeypatch.setattr(tokencount, "CACHE", 50)
    small = tokencount.Unigram(list(model.score))
    assert list(small.count([t for _, t in documents])) == [want[d] for d, _ in documents]
