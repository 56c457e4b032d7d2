"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and a clause into tokens of a few classes. Five
transducers mark what a token stands under and multiply its weight: *negation*,
*reported speech*, *target* (whom it is aimed at), *insult* (an intensifier in
front) and *threat* (violence that is meant). Those that look back at earlier
words are composed into one machine that reads a clause forwards, those that look
at later ones ("..., he said", "idiots like you") into one that reads what comes out
backwards. An insult counts its lexicon weight times the weights of the arcs on
its path, so a clause is scored by how its words stand together. The lexicon and
the arcs' weights are learned from labelled rows, counted in tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import fold, table, texts
from bitsieve.llm.learn import PARTS, labelled, logistic, sigmoid
from bitsieve.session import cut

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled rows of each label that the grammar's weights are learned from.
SAMPLE = 4000
#: Lengths of stems.
STEM = (3, 10)
#: What a document that holds a kept stem counts for further ones.
EXPLAINED = 0.1

NEGATION = frozenset("not never no none nor isn't aren't don't doesn't wasn't nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORT = frozenset("said says say told called calls quoted quote reported reportedly alleged claimed claims wrote sagte sagt berichtete nannte dit disait déclaré appelé dijo dice llamó según laut selon".split())
TARGET = frozenset("you your you're youre u ur yourself he she they him her them those these people du dich dir ihr euch sie tu toi te vous ils elles tú usted ustedes ellos ellas".split())
INTENT = frozenset("will shall gonna going must should ought i'll we'll werde werden sollte vais va allons devrait voy vamos debería".split())
VIOLENCE = frozenset("kill hurt beat stab shoot murder burn destroy punch choke strangle töten verletzen schlagen tuer frapper mourir matar golpear morir".split())
STRESS = frozenset("so such total totally utter utterly complete completely absolute absolutely real really fucking bloody damn völlig total echt tellement vraiment complètement totalmente tan realmente".split())
#: Stems that count as insults unless the labelled rows speak against them.
SEEDS = (
    "idiot stupid moron imbecil pathetic worthless loser scum disgusting garbage trash vermin dimwit dumbass jerk clown fool bastard bitch asshole "
    "trottel abschaum versager arschloch dummkopf crétin abruti connard salaud débile estúpid imbécil escoria basura cabrón"
).split()
#: Weight of such a stem that no labelled row holds.
SEED_WEIGHT = 3.0

OTHER, INSULT, NEG, SAID, AIM, MEANT, HARM, BOOST = range(8)
CLASSES = {**dict.fromkeys(STRESS, BOOST), **dict.fromkeys(NEGATION, NEG), **dict.fromkeys(REPORT, SAID), **dict.fromkeys(TARGET, AIM), **dict.fromkeys(INTENT, MEANT), **dict.fromkeys(VIOLENCE, HARM)}
KINDS = ("plain", "aimed", "negated", "reported", "threat", "chance")
#: Arc weights that are expected before any row is seen.
ARCS = {"neg": 0.15, "said": 0.35, "aim": 1.4, "boost": 1.2}
#: How far a weight may go from there, as factors, and how dear that is in units of log-likelihood.
FACTORS, DEAR = (0.5, 0.7, 1.0, 1.4, 2.0), 2.0
#: Mark sets that sums are kept by while weights are learned: of insults, and of threats.
SETS = [frozenset(m for i, m in enumerate(ARCS) if n >> i & 1) for n in range(16)]
COLUMNS = [(c, s) for c in (INSULT, HARM) for s in SETS]

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = ".!?;\n()"
_CLAUSES = re.compile("[" + re.escape(_CLAUSE_END) + "]+")
Symbol = tuple[int, frozenset]


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol, weight). Missing arcs go to state 0, copy and weigh 1."""

    arcs: dict[tuple[int, Symbol], tuple[int, Symbol, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: Symbol) -> tuple[int, Symbol, float]:
        return self.arcs.get((state, symbol)) or (0, symbol, 1.0)

    def compose(self, after: Transducer, symbols: list[Symbol]) -> Transducer:
        """The machine that feeds this one's output to ``after``; weights multiply."""
        out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
        while todo:
            p, q = pair = todo.pop()
            for s in symbols:
                p2, mid, w = self.step(p, s)
                q2, end, v = after.step(q, mid)
                if (p2, q2) not in number:
                    number[p2, q2] = len(number)
                    todo.append((p2, q2))
                out.arcs[number[pair], s] = (number[p2, q2], end, w * v)
        return out


def symbols(marks: tuple[str, ...]) -> list[Symbol]:
    """All classes, bare or with any of the marks."""
    sets = [frozenset()]
    for m in marks:
        sets += [s | {m} for s in sets]
    return [(c, m) for c in range(8) for m in sets]


def marker(opens: int, mark: str, reach: int | None, known: tuple[str, ...], weight: float) -> Transducer:
    """After a symbol of class ``opens``, ``mark`` goes on the next ``reach`` symbols, or on all.

    The arc that puts it on an insult or on a threat has that weight; a symbol that
    has the mark already (from the other direction) passes as it is. Who reports, or is
    spoken of in a report, is no target: there ``aim`` isn't opened, and a word of report ends it.
    """
    t, top = Transducer(), reach or 1
    for state in range(top + 1):
        for c, m in symbols(known):
            if c == opens and not (mark == "aim" and "said" in m):
                t.arcs[state, (c, m)] = (top, (c, m), 1.0)
            elif mark == "aim" and c == SAID:
                t.arcs[state, (c, m)] = (0, (c, m), 1.0)
            elif state:
                t.arcs[state, (c, m)] = (state - 1 if reach else state, (c, m | {mark}), _weight(c, m, mark, weight))
    return t


def closing(opens: int, mark: str, reach: int, known: tuple[str, ...], weight: float) -> Transducer:
    """Like a marker, but opened by the first symbol it reads only: read backwards, by a clause's last word."""
    t, done = Transducer(), reach + 1
    for c, m in symbols(known):
        t.arcs[0, (c, m)] = (reach if c == opens else done, (c, m), 1.0)
        t.arcs[done, (c, m)] = (done, (c, m), 1.0)
        for state in range(1, reach + 1):
            t.arcs[state, (c, m)] = (state - 1 or done, (c, m | {mark}), _weight(c, m, mark, weight))
    return t


def _weight(c: int, marks: frozenset, mark: str, weight: float) -> float:
    return weight if c in (INSULT, HARM) and mark not in marks else 1.0


def verdicts(known: tuple[str, ...]) -> Transducer:
    """What is no insult and no threat weighs nothing; violence is a threat if it is meant."""
    t = Transducer()
    for c, m in symbols(known):
        t.arcs[0, (c, m)] = (0, (c, m), 1.0 if c == INSULT or (c == HARM and "meant" in m) else 0.0)
    return t


ALL = ("neg", "said", "aim", "boost", "meant")


def _composed(machines: list[Transducer], alphabet: list[Symbol]) -> Transducer:
    out = machines[0]
    for t in machines[1:]:
        out = out.compose(t, alphabet)
    return out


@lru_cache(8)
def grammar(weights: tuple[tuple[str, float], ...] = tuple(ARCS.items())) -> tuple[Transducer, Transducer]:
    """The machine that reads forwards, and the one that reads its output backwards."""
    w = dict(weights)
    forward = _composed(
        [
            marker(NEG, "neg", 3, (), w["neg"]),
            marker(SAID, "said", None, ALL[:1], w["said"]),
            marker(AIM, "aim", 4, ALL[:2], w["aim"]),
            marker(BOOST, "boost", 2, ALL[:3], w["boost"]),
            marker(MEANT, "meant", 3, ALL[:4], 1.0),
        ],
        symbols(()),
    )
    backward = _composed([closing(NEG, "neg", 4, ALL, w["neg"]), marker(SAID, "said", None, ALL, w["said"]), marker(AIM, "aim", 3, ALL, w["aim"]), verdicts(ALL)], symbols(ALL))
    return forward, backward


#: Weights of a grammar that sees stems only.
FLAT = dict.fromkeys(ARCS, 1.0)


class Scorer:
    """Sums of whole texts under a lexicon of weighted stems.

    ``stems``: (weight, rate in clean text, by character). ``arcs``: the marks' weights.
    ``curve``: weights of the logarithm of the sum and of what chance brings, and the intercept.
    """

    def __init__(self, stems: dict[str, tuple[float, float]], curve: np.ndarray | None = None, arcs: dict[str, float] | None = None) -> None:
        self.stems, self.curve, self.arcs = stems, curve, dict(arcs or ARCS)
        forward, backward = grammar(tuple(self.arcs.items()))
        self.forward, self.backward = forward.arcs, backward.arcs
        self.bare = {c: (c, frozenset()) for c in range(8)}
        self.threat = float(np.median([w for w, _ in stems.values()])) if stems else SEED_WEIGHT
        words = sorted([*stems, *VIOLENCE], key=lambda s: (-len(s), s))
        tree: dict = {}
        for w in words:
            at = tree
            for c in w:
                at = at.setdefault(c, {})
            at[""] = True
        #: Weight that a character of clean text brings by chance.
        self.chance = sum(w * r for w, r in stems.values())
        self.find = re.compile(_pattern(tree)).finditer

    def clauses(self, text: str | None) -> Iterator[tuple[int, frozenset, float, float]]:
        """(class, marks, lexicon weight, path weight) of each insult and threat; clauses without a stem or violence have none."""
        low, done = (text or "").lower(), 0
        for m in self.find(low):
            if m.start() < done or (m.start() and low[m.start() - 1].isalpha()):
                continue
            begin = max(done, max(low.rfind(c, done, m.start()) for c in _CLAUSE_END) + 1)
            stop = _CLAUSES.search(low, m.end())
            done = stop.end() if stop else len(low)
            yield from self._clause(low[begin:done])

    def _clause(self, clause: str) -> Iterator[tuple[int, frozenset, float, float]]:
        state, tape = 0, []
        for word in _WORD.findall(clause):
            base = self._stem(word)
            state, symbol, w = self.forward[state, self.bare[INSULT if base else CLASSES.get(word, OTHER)]]
            tape.append((symbol, w, base))
        state = 0
        for symbol, w, base in reversed(tape):
            state, (c, marks), v = self.backward[state, symbol]
            if v:
                yield c, marks - {"meant"}, base or self.threat, w * v

    def _stem(self, word: str) -> float:
        for n in range(STEM[0], min(len(word), STEM[1]) + 1):
            if (x := self.stems.get(word[:n])) is not None:
                return x[0]
        return 0.0

    def by_marks(self, text: str | None) -> list[float]:
        """Lexicon weights by class and marks, arcs aside; last, what chance brings."""
        out = dict.fromkeys(COLUMNS, 0.0)
        for c, marks, base, _ in self.clauses(text):
            out[c, marks] += base
        return [*out.values(), self.chance * len(text or "")]

    def sums(self, text: str | None) -> list[float]:
        """Weighted sums by kind; last, what chance brings."""
        out = [0.0] * len(KINDS)
        for c, marks, base, w in self.clauses(text):
            out[4 if c == HARM else 2 if "neg" in marks else 3 if "said" in marks else 1 if "aim" in marks else 0] += base * w
        out[-1] = self.chance * len(text or "")
        return out

    def score(self, sums: np.ndarray) -> np.ndarray:
        return sigmoid(_features(sums[:, :-1].sum(1), sums[:, -1]) @ self.curve[:-1] + self.curve[-1])


def _features(total: np.ndarray, chance: np.ndarray) -> np.ndarray:
    return np.log1p(np.stack([total, chance], 1))


def _pattern(tree: dict) -> str:
    if "" in tree or not tree:
        return ""
    parts = [re.escape(c) + _pattern(t) for c, t in sorted(tree.items())]
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _ratio(a: float, b: float, n1: float, n0: float) -> float:
    """Likelihood ratio of a in n1 against b in n0."""
    both = (a + b) / (n1 + n0)
    return float(2 * ((a * np.log(a / (n1 * both)) if a else 0.0) + (b * np.log(b / (n0 * both)) if b else 0.0)))


def _beyond(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Likelihood ratio of a stem in a of n1 and b of n0 documents; 0 unless it stands for the former."""
    both = (a + b) / float(n1 + n0)
    term = lambda x, n: F.when(x > 0, x * F.log(x / (float(n) * both))).otherwise(0.0)
    return F.when(a / float(n1) <= 2 * b / float(n0), 0.0).otherwise(2 * (term(a, n1) + term(b, n0)))


def _stems(text: str) -> Counter:
    return Counter(w[:k] for w in _WORD.findall(text) for k in range(STEM[0], min(len(w), STEM[1]) + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text) -> (stem, documents of label 0 and 1, occurrences in them); the empty stem has the documents' number and characters."""
    found: dict[str, list[int]] = {}
    for b in batches:
        for y, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            low = (text or "").lower()
            for stem, n in [("", len(low)), *_stems(low).items()]:
                row = found.setdefault(stem, [0, 0, 0, 0])
                row[y] += 1
                row[2 + y] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([v[i] for v in found.values()], pa.int64()) for i in range(4)]], names=["stem", "d0", "d1", "s0", "s1"])


def learn_stems(rows: DataFrame) -> dict[str, tuple[float, float]]:
    """(k, y, t), no text twice -> stems that mark label 1: (log of the ratio of their rates, rate in clean text), by character.

    A stem is kept if its likelihood ratio over documents is beyond chance for the
    number of stems tried, those first whose counts of occurrences are surest.
    Documents that a kept stem is in count a tenth from then on, so that what copies
    of toxic texts happen to share isn't taken for their insults. Of stems that
    extend each other one is kept, and the longest of those that stand for the same
    documents. Seeds are kept unless their rate in clean text is surely higher.

    The tasks count; only stems beyond chance come to the driver, and which documents hold them.
    """
    counted = rows.select("y", "t").mapInArrow(_count, "stem STRING, d0 BIGINT, d1 BIGINT, s0 BIGINT, s1 BIGINT")
    counted = cut(counted.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "s0", "s1")]))
    whole = counted.where("stem = ''").first()
    if whole is None or not whole.d0 or not whole.d1:
        return {s: (SEED_WEIGHT, 0.0) for s in SEEDS}
    n0, n1, size0, size1 = whole.d0, whole.d1, whole.s0 + 1, whole.s1 + 1
    stems = counted.where("stem <> '' AND d1 >= 3")
    least = 2 * np.log((stems.count() + 1) / 0.05)
    found = {r.stem: r for r in stems.where(_beyond(F.col("d1"), F.col("d0"), n1, n0) > float(least)).collect()}
    seeds = {r.stem: r for r in counted.where(F.col("stem").isin([s[: STEM[1]] for s in SEEDS])).collect()}

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(found)
        for b in batches:
            own = [sorted(wanted.intersection(_stems((t or "").lower()))) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.string()))], names=["k", "stems"])

    holds: dict[str, list[int]] = {}
    for i, r in enumerate(rows.where("y = 1").select("k", "t").mapInArrow(hold, "k BIGINT, stems ARRAY<STRING>").collect()):
        for s in r.stems:
            holds.setdefault(s, []).append(i)
    sure = {s: _ratio(r.s1, r.s0, size1, size0) for s, r in found.items()}
    worth = np.ones(n1)
    out: dict[str, tuple[float, float]] = {}
    inner: set[str] = set()
    for s in sorted(found, key=lambda s: (-sure[s], -len(s), s)):
        if s in inner or any(s[:n] in out for n in range(STEM[0], len(s))):
            continue
        r = found[s]
        clean = (r.s0 + 0.5) / size0
        weight = float(np.log((r.s1 + 0.5) / size1 / clean))
        left = float(worth[holds[s]].sum())
        if weight > 0 and left / n1 > 2 * r.d0 / n0 and _ratio(left, r.d0, n1, n0) > least:
            out[s] = (weight, clean)
            inner.update(s[:n] for n in range(STEM[0], len(s)))
            worth[holds[s]] = EXPLAINED
    for s in (s[: STEM[1]] for s in SEEDS):
        if any(s[:n] in out for n in range(STEM[0], len(s) + 1)) or s in inner:
            continue
        r = seeds.get(s)
        k0, k1 = (r.s0, r.s1) if r else (0, 0)
        if not (k0 / size0 > k1 / size1 and _ratio(k1, k0, size1, size0) > 4):
            out[s] = (max(SEED_WEIGHT, float(np.log((k1 + 0.5) / size1 / ((k0 + 0.5) / size0)))) if k1 else SEED_WEIGHT, k0 / size0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, float]]:
    """Sums by marks -> the curve, and the arcs' weights, which move from what is expected only as far as the rows make them."""

    def curve(arcs: dict[str, float]) -> tuple[float, np.ndarray]:
        path = np.array([np.prod([arcs[m] for m in s]) for _, s in COLUMNS])
        f = _features(x[:, :-1] @ path, x[:, -1])
        w = logistic(f, y, ridge=0.5)
        w[0] = max(w[0], 0.5)  # an insult never speaks for a text
        p = np.clip(sigmoid(f @ w[:-1] + w[-1]), 1e-9, 1 - 1e-9)
        far = sum(np.log(arcs[m] / ARCS[m]) ** 2 for m in ARCS)
        return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() - DEAR * far), w

    best, arcs = curve(ARCS), dict(ARCS)
    for _ in range(2):
        for m in ARCS:
            for factor in FACTORS:
                tried = arcs | {m: ARCS[m] * factor}
                if (now := curve(tried))[0] > best[0] + 1e-9:
                    best, arcs = now, tried
    return best[1], arcs


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE) -> Scorer:
    """Learn from labelled rows outside the held-out fold, about ``per_label`` of each label."""
    rows, counts = labelled(df, labels, doc_id, text, label, fold(F.col("k"), FOLDS) != HELD_OUT, per_label)
    # Equal texts count once.
    rows = cut(rows.groupBy("y", F.coalesce("t", F.lit("")).alias("t")).agg(F.min("k").alias("k")).repartition(PARTS, "k"))
    half = F.pmod(F.xxhash64("k"), F.lit(2)) == 0
    # Stems are weighed on one half and the curve on the other, so that chance stems earn no trust.
    check = Scorer(learn_stems(rows.where(half)))
    shared = df.sparkSession.sparkContext.broadcast(check.stems)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.by_marks(t) for t in texts(b.column(2))], pa.list_(pa.float64()))], names=["k", "y", "x"])

    few = sorted(rows.where(~half).select("k", "y", "t").mapInArrow(sums, "k BIGINT, y INT, x ARRAY<DOUBLE>").collect(), key=lambda r: (r.k, r.y))
    y = np.array([r.y for r in few], np.int64)
    if len(set(y.tolist())) == 2:
        curve, arcs = fit(np.array([r.x for r in few]), y)
    else:
        curve, arcs = np.array([2.0, 0.0, -2.0]), ARCS
    scorer = Scorer(learn_stems(rows), curve, arcs)
    if counts.get(0) and counts.get(1) and len(set(y.tolist())) == 2:
        curve[-1] += np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum())
    return scorer


def _model(scorer: Scorer) -> tuple:
    return scorer.stems, scorer.curve, scorer.arcs


def score(df: DataFrame, scorer: Scorer, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, score, and the sum of each kind.

    Null and empty texts hold no clause and score as clean; bytes that aren't UTF-8
    are no letters; texts of any length are read whole; rows that repeat an id are
    scored each; an empty table gives an empty table. Other columns are ignored.
    The grammar, whose stems the labelled sample bounds, goes to the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(_model(scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for b in batches:
            sums = np.array([s.sums(t) for t in texts(b.column(1))]).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.score(sums)), *[pa.array(c) for c in sums.T]], names=["doc_id", "score", *KINDS])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id BIGINT, score DOUBLE, " + ", ".join(f"{k} DOUBLE" for k in KINDS))


def without_toxic(df: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all columns as they were.

    Null, empty, long and repeated texts are judged as in :func:`score`; an empty table gives an empty table.
    """
    shared = df.sparkSession.sparkContext.broadcast(_model(scorer))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(*shared.value)
        for b in batches:
            sums = np.array([s.sums(t) for t in texts(b.column(at))]).reshape(-1, len(KINDS))
            yield b.filter(pa.array(s.score(sums) < threshold))

    return df.mapInArrow(run, df.schema)


def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    out = score(docs, train(docs, table(spark, d, "labels")))
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
