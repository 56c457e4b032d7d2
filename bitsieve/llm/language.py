"""Language identification of mixed-language text.

A word gets a score for each language from its character n-grams; the script of
its letters leaves only the languages that were seen in that script. Viterbi
labels the words of a text with languages, where a switch costs a penalty, and
the labels' spans decide what the text is written in.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import fold, table, texts
from bitsieve.llm.learn import PARTS, stratified

FOLDS, HELD_OUT = 5, 0
#: Texts of each language that are learned from.
SAMPLE = 400
#: Log-odds that a switch of language costs.
PENALTY = 12.0
TABLE_BITS = 16
SMOOTH = 0.5
UNKNOWN = "und"
#: First code points of the script ranges.
SCRIPTS = {"latin": 0x41, "greek": 0x370, "cyrillic": 0x400, "armenian": 0x530, "hebrew": 0x590, "arabic": 0x600, "other": 0x700, "indic": 0x900, "thai": 0xE00, "lao": 0xE80, "other2": 0xF00, "georgian": 0x10A0, "hangul": 0x1100, "other3": 0x1200, "latin2": 0x1E00, "greek2": 0x1F00, "other4": 0x2000, "kana": 0x3040, "hangul2": 0x3130, "han": 0x3400, "other5": 0xA000, "hangul3": 0xAC00, "other6": 0xD7B0}
_STARTS = np.array(list(SCRIPTS.values()))
_GROUPS = sorted({n.rstrip("0123456789") for n in SCRIPTS})
_SCRIPT = np.array([_GROUPS.index(n.rstrip("0123456789")) for n in SCRIPTS])
#: Characters that are scored at once.
CHUNK = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def script_of(cp: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.maximum(np.searchsorted(_STARTS, cp, "right") - 1, 0)]


def script_name(c: str) -> str:
    return _GROUPS[_SCRIPT[max(bisect_right(_STARTS.tolist(), ord(c)) - 1, 0)]]


def grams(cp: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places of letters, table slots of each order): n-grams of 1 to 4 characters that lie in one word or its edges.

    ``cp``: lower-case code points, 0 for all that isn't a letter, with three zeros on either side.
    The last slot stands for no n-gram.
    """
    at = np.flatnonzero(cp[3:-3]) + 3
    x = cp.astype(np.uint32)
    one = x[at] * np.uint32(0x9E3779B1)
    two = one ^ x[at - 1] * np.uint32(0x85EBCA77)
    three = two ^ x[at + 1] * np.uint32(0xC2B2AE3D)
    four = three ^ x[at + 2] * np.uint32(0x27D4EB2F)
    slots = []
    for n, h in enumerate((one, two, three, four)):
        h = (h ^ np.uint32(n * 0x165667B1 & 0xFFFFFFFF)) * np.uint32(0xCC9E2D51)
        slots.append(((h ^ h >> np.uint32(15)) >> np.uint32(32 - TABLE_BITS)).astype(np.int32))
    slots[3][x[at + 1] == 0] = 1 << TABLE_BITS
    return at, slots


def coded(text: str) -> np.ndarray:
    """Lower-case letters as code points between zeros."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(letters()[cp], cp, 0)
    return np.concatenate([np.zeros(3, np.uint32), cp, np.zeros(3, np.uint32)])


@dataclass
class Model:
    """``weights``: slot by language, log-probabilities less their mean. ``allowed``: script by language."""

    langs: list[str]
    weights: np.ndarray
    allowed: np.ndarray

    def word_scores(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(scores by word and language, letters of each word)."""
        cp = coded(text)
        is_letter = cp > 0
        starts = np.flatnonzero(is_letter & ~np.concatenate([[False], is_letter[:-1]]))
        if not len(starts):
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        word = _word_numbers(len(cp), starts)
        lengths = np.bincount(word[is_letter], minlength=len(starts))
        out = np.zeros((len(starts), len(self.langs)))
        for lo in range(0, len(cp), CHUNK):
            shift = max(0, lo - 3)
            at, slots = grams(cp[shift : lo + CHUNK + 3])
            if not len(at):
                continue
            sums = self.weights[slots[0]]
            for s in slots[1:]:
                sums += self.weights[s]
            own = word[at + shift]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[first]] += np.add.reduceat(sums, first, axis=0)
        barred = ~self.allowed[script_of(cp[starts])]
        barred[barred.all(1)] = False
        out[barred] = -1e6
        return out, lengths

    def label(self, text: str | None) -> tuple[str, float, list[tuple[int, int, str]]]:
        """(language, share of the letters that its spans hold, spans of words)."""
        if not text or not self.langs:
            return UNKNOWN, 0.0, []
        scores, lengths = self.word_scores(text)
        if not len(scores):
            return UNKNOWN, 0.0, []
        path = viterbi(scores, PENALTY)
        share = np.bincount(path, lengths, len(self.langs)) / lengths.sum()
        best = int(share.argmax())
        cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist(), len(path)]
        return self.langs[best], float(share[best]), [(a, b, self.langs[path[a]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _word_numbers(n: int, starts: np.ndarray) -> np.ndarray:
    flags = np.zeros(n, np.int64)
    flags[starts] = 1
    return np.maximum(np.cumsum(flags) - 1, 0)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the best path, of which each change costs ``penalty``.

    A path that leaves the language which fits the whole best wins at most the best
    first stretch and the best last one for one change, and the best stretch of all
    for each further one. Where neither pays, the path is known; else it is traced
    word by word.
    """
    n, k = scores.shape
    best = int(scores.sum(0).argmax())
    gain = np.cumsum(scores - scores[:, [best]], axis=0)
    before = np.vstack([np.zeros(k), gain[:-1]])
    head, tail = gain.max(), (gain[-1] - before.min(0)).max()
    if (gain - np.minimum.accumulate(before, axis=0)).max() <= penalty and max(head, 0) + max(tail, 0) <= penalty:
        return np.full(n, best)
    steps = scores.tolist()
    at, back = steps[0], []
    for step in steps[1:]:
        moved = max(at)
        top = at.index(moved)
        moved -= penalty
        back.append((top, [a < moved for a in at]))
        at = [(a if a >= moved else moved) + s for a, s in zip(at, step, strict=True)]
    label = at.index(max(at))
    path = [label]
    for top, left in reversed(back):
        label = top if left[label] else label
        path.append(label)
    return np.array(path[::-1])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) -> (lang, counts of slots, letters by script), packed, of all the task's rows."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            counts, seen = found.setdefault(lang, (np.zeros(1 << TABLE_BITS, np.int64), np.zeros(len(_GROUPS), np.int64)))
            cp = coded(text)
            for slot in grams(cp)[1]:
                counts += np.bincount(slot, minlength=len(counts) + 1)[: len(counts)]
            seen += np.bincount(script_of(cp[cp > 0]), minlength=len(_GROUPS))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array([v[i].astype("<i8").tobytes() for v in found.values()], pa.binary()) for i in (0, 1)]], names=["lang", "counts", "seen"])


def _added(rows: pa.Table) -> pa.Table:
    """Of each language, the sums."""
    sums = [sum(np.frombuffer(x.as_py(), "<i8") for x in rows.column(i)) for i in (1, 2)]
    return pa.table({"lang": rows.column(0)[:1], **{n: pa.array([v.tobytes()], pa.binary()) for n, v in zip(("counts", "seen"), sums, strict=True)}})


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from ``sample`` texts or so of each language, outside the held-out fold.

    The tasks count n-grams; the driver gets a table for each language, which is the
    model's size. Every language is learned, so the model grows with their number.
    Without labelled rows the model knows no language.
    """
    rows = df.select(F.col(doc_id).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("y")).where((fold(F.col("k"), FOLDS) != HELD_OUT) & F.col("t").isNotNull())
    kind = "lang STRING, counts BINARY, seen BINARY"
    counted = stratified(rows, "y", sample, F.col("k")).select("y", "t").repartition(PARTS).mapInArrow(_counts, kind)
    found = {r.lang: r for r in counted.groupBy("lang").applyInArrow(_added, kind).collect()}
    langs = sorted(found)
    counts = np.full((1 << TABLE_BITS, len(langs)), SMOOTH)
    seen = np.zeros((len(_GROUPS), len(langs)))
    for k, name in enumerate(langs):
        counts[:, k] += np.frombuffer(found[name].counts, "<i8")
        seen[:, k] += np.frombuffer(found[name].seen, "<i8")
    logp = np.log(counts / counts.sum(0)) if langs else counts
    # A script counts as a language's own if it holds a hundredth of its letters.
    allowed = seen >= 0.01 * np.maximum(seen.sum(0), 1)
    centred = logp - logp.mean(1, keepdims=True) if langs else logp
    return Model(langs, np.vstack([centred, np.zeros((1, len(langs)))]).astype(np.float32), allowed)


def predict(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row per row: doc_id, lang_pred, score, and with ``spans`` the labelled spans of words.

    Null texts and those without a letter are ``und`` with score 0; rows that repeat
    an id are judged each; ties go to the language first by name; an empty table gives
    an empty table; bytes that aren't UTF-8 are no letters; texts of any length are labelled
    whole. Other columns are ignored. The model (2^16 slots a language) goes to the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.label(t) for t in texts(b.column(1))]
            cols = [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                cols.append(pa.array([[{"first_word": x, "end_word": y, "lang": z} for x, y, z in f[2]] for f in found], kind))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "spans"][: len(cols)])

    schema = "doc_id BIGINT, lang_pred STRING, score DOUBLE" + (", spans ARRAY<STRUCT<first_word: BIGINT, end_word: BIGINT, lang: STRING>>" if spans else "")
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op4_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return predict(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
