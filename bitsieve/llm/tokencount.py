"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A text is split into pre-tokens. The distinct ones that a worker meets are put in
a trie with their numbers; the best score of every prefix is found once, at the
trie's node, from the nodes above it that pieces reach back to. A node where a
pre-token ends keeps its count of tokens. Texts then only add up counts.

Pieces are those of a public vocabulary of byte sequences; a piece's probability
follows Zipf's law in its rank.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitsieve.llm.common import table, texts

#: Pre-tokens with their counts that a worker keeps, twice at most; this bounds its memory.
CACHE = 500_000
#: Characters of texts whose new pre-tokens share a trie.
GROUP_CHARS = 2_000_000
#: Zipf's law: log-probability of rank r is -log(r + SHIFT), less a constant for the sum.
SHIFT = 2.7
#: Pre-tokens: a run of letters, of digits, of white space or of all else, the first two and the last with a space before them.
_SPLIT = re.compile(r" ?[^\W\d_]+| ?\d+|\s+(?=\s\S)|\s+| ?(?:_|[^\w\s])+")


def pretokens(text: str | None) -> list[str]:
    """Every character of the text is in one pre-token."""
    return _SPLIT.findall(text or "")


class Unigram:
    """Scores of pieces, found from their last byte backwards."""

    def __init__(self, pieces: list[bytes]) -> None:
        total = math.log(sum(1 / (r + SHIFT) for r in range(len(pieces))))
        self.score = {p: -math.log(r + SHIFT) - total for r, p in enumerate(pieces)}
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.back: dict = {}
        for p, s in self.score.items():
            at = self.back
            for byte in reversed(p):
                at = at.setdefault(byte, {})
            at[-1] = s
        self.counts: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def best(self, words: list[str]) -> dict[str, tuple[float, int]]:
        """Best score and number of tokens of each word.

        The trie is walked in the order of the sorted words: what the stacks hold
        for a shared prefix stays when the next word begins. Of equal scores the
        one with the longest last piece counts. A byte without a piece is a token
        of the worst score.
        """
        out, scores, tokens, held = {}, [0.0], [0], b""
        for word, data in sorted(((w, w.encode("utf-8", "surrogatepass")) for w in words), key=lambda x: x[1]):
            same, top = 0, min(len(held), len(data))
            while same < top and held[same] == data[same]:
                same += 1
            del scores[same + 1 :], tokens[same + 1 :]
            for end in range(same, len(data)):
                high, n = scores[end] + self.worst, tokens[end] + 1
                at, i = self.back, end
                while i >= 0 and (at := at.get(data[i])) is not None:
                    if (s := at.get(-1)) is not None and scores[i] + s >= high:
                        high, n = scores[i] + s, tokens[i] + 1
                    i -= 1
                scores.append(high)
                tokens.append(n)
            held = data
            out[word] = (scores[-1], tokens[-1])
        return out

    def count(self, rows: Iterable[str | None]) -> Iterator[tuple[int, int]]:
        """(pre-tokens, tokens) of each whole text."""
        group, size = [], 0
        for t in rows:
            group.append(t)
            size += len(t or "")
            if size > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str | None]) -> Iterator[tuple[int, int]]:
        split = [pretokens(t) for t in texts]
        words = set().union(*split)
        new = [w for w in words if w not in self.counts]
        if len(self.counts) + len(new) > CACHE:
            self.old, self.counts = self.counts, {}
            new = list(words)
        self.counts.update({w: self.old[w] for w in new if w in self.old})
        self.counts.update({w: n for w, (_, n) in self.best([w for w in new if w not in self.old]).items()})
        for own in split:
            yield len(own), sum(map(self.counts.__getitem__, own))


def load_pieces(path: str) -> list[bytes]:
    """Byte sequences of a rank file, in order of rank."""
    with open(path, "rb") as f:
        ranked = [(int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f)]
    return [p for _, p in sorted(ranked)]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_models: dict[int, Unigram] = {}


def token_counts(df: DataFrame, vocabulary_file: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_pretokens, n_tokens.

    Null and empty texts have none; bytes that aren't UTF-8 count as U+FFFD; texts of any
    length are counted whole; rows that repeat an id are counted each; an empty table
    gives an empty table. Other columns are ignored. The vocabulary
    (its size is fixed) goes to the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_pieces(vocabulary_file or vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(shared.value))
        if key not in _models:
            _models[key] = Unigram(shared.value)
        for b in batches:
            found = list(_models[key].count(texts(b.column(2))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "n_bytes", "n_pretokens", "n_tokens"])

    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), size.alias("n_bytes"), F.col(text).alias("text")).mapInArrow(run, "doc_id BIGINT, n_bytes BIGINT, n_pretokens BIGINT, n_tokens BIGINT")


def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"))
