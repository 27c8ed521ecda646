"""Token counts by a count-only Viterbi over an Aho-Corasick automaton of a unigram vocabulary.

The automaton lists every vocabulary piece that ends at a position; dynamic programming carries, per
position, the best score and the number of pieces on the way there, and nothing else. Ties are the
tokenizer's: of paths with equal score into a position the one whose last piece starts first (the
longest piece) stays. A character that no piece covers costs the lowest score less 10 and counts as
its UTF-8 bytes where the vocabulary has byte pieces, else as one piece for each run.

No vocabulary piece has the space mark after another character, so the best path is a row of best paths of
stretches that begin at space marks; stretches seen before are remembered in a bounded table.
Scores are whole numbers of 64ths, so sums are exact in doubles whatever their order.

Defined cases: a null or empty text has no tokens; texts of any length are read whole; repeated rows
get the same count; an empty table gives an empty result; results are columns of expressions, so other
columns cannot clash with them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import send

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 250_000
MAX_PIECES = 1_000_000


class Counter:
    """One vocabulary: pieces with scores; byte pieces or not; whether a space mark is put before the text."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool, dummy_prefix: bool = True) -> None:
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece not in self.trie:
                self.trie.add_word(piece, (len(piece), float(score)))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.byte_pieces, self.dummy_prefix = byte_pieces, dummy_prefix
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p, _ in pieces):
            raise ValueError("a piece has a space mark after another character: stretches would not be independent")
        self.stretches = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+").findall
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Number of pieces of the best path over one stretch."""
        n, lowest = len(text), float("-inf")
        score, count, unknown = [lowest] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, hit in self.trie.iter(text):
            ending[end + 1].append(hit)
        for end in range(1, n + 1):
            best, pieces, odd, single = lowest, 0, False, False
            hits = ending[end]
            hits.sort(reverse=True)  # longest first: the earliest start wins a tie
            for size, value in hits:
                single = single or size == 1
                value += score[end - size]
                if value > best:
                    best, pieces, odd = value, count[end - size] + 1, False
            if not single:
                value = score[end - 1] + self.unknown
                if value > best:
                    cost = len(text[end - 1].encode()) if self.byte_pieces else int(not unknown[end - 1])
                    best, pieces, odd = value, count[end - 1] + cost, True
            score[end], count[end], unknown[end] = best, pieces, odd
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = (SPACE_MARK if self.dummy_prefix else "") + text.replace(" ", SPACE_MARK)
        known, total = self.known, 0
        for stretch in self.stretches(text):
            n = known.get(stretch)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.viterbi(stretch)
                if len(stretch) <= 64:
                    known[stretch] = n
            total += n
        return total


def zipf_score(rank: int) -> float:
    """Log-probability of the rank-th piece of a vocabulary ordered by use, in whole 64ths."""
    return -round(64 * math.log2(rank + 2)) / 64


def read_pieces(path: str) -> tuple[list[tuple[str, float]], bool, bool]:
    """Normal pieces with scores, whether there are byte pieces, whether a space is put first; read from a piece model file.

    The file orders pieces by merge rank and has no unigram scores; a piece gets its Zipf score."""
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    kinds = model.ModelProto.SentencePiece
    pieces = [(p.piece, zipf_score(i)) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    spec = proto.normalizer_spec
    if spec.remove_extra_whitespaces or spec.precompiled_charsmap or not spec.escape_whitespaces:
        raise ValueError(f"{path} normalises texts, which this counter does not")
    return pieces, any(p.type == kinds.BYTE for p in proto.pieces), spec.add_dummy_prefix


_COUNTERS: dict[str, Counter] = {}


def token_count(text: str, df: DataFrame, path: str) -> Column:
    """A bigint column: the number of tokens of one text column of df under the vocabulary file's pieces and scores."""
    vocabulary = read_pieces(path)
    held = send(df, (hashlib.sha256(repr(vocabulary).encode()).hexdigest(), vocabulary))

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key, vocabulary = held.value
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*vocabulary)
        counter = _COUNTERS[key]
        for batch in batches:
            yield pa.array([counter.count(x.as_py()) for x in batch], pa.int64())

    return count(F.col(text))
