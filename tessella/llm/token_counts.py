"""Token counts by rank-synchronous array merging.

A text falls into pre-tokens that no merge can cross: a run of marks (spaces count as marks) with what follows up to the
next mark. The distinct pre-tokens of a batch that the worker doesn't know yet are held together as one ragged array of
symbols. In every round each pre-token's adjacent pair of best rank (leftmost on ties) is found by a segmented minimum,
and all pre-tokens apply theirs at once; those without a pair leave. What survives is counted, a symbol outside the
vocabulary as its UTF-8 bytes (byte fallback) or as one unknown. A text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: Pre-tokens of more symbols take the same merges one at a time from a heap: a round for each would cost their square.
LONG = 256
#: Bytes that the pre-tokens a worker remembers may take (with ENTRY for each); beyond, only those that occur again at once
#: are kept.
REMEMBERED, ENTRY = 24 << 20, 200
MARK = "▁"


class Merges:
    """The merge table of a byte-pair vocabulary in which every piece has a score (higher merges first)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_fallback: bool):
        #: Symbols are pieces and their single characters; a pair merges if the joined string is a piece.
        order = {p: k for k, p in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        self.ids, self.byte_fallback = order, byte_fallback
        known = set(pieces)
        self.weight = np.array([1 if p in known else (len(p.encode()) if byte_fallback else 1) for p in order], np.int64)
        rank_of_score = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        pairs = {}
        for piece, score in zip(pieces, scores, strict=True):
            for cut in range(1, len(piece)):
                a, b = order.get(piece[:cut]), order.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank_of_score[score], order[piece])
        self.pairs = pairs
        self.base = len(order) + 1  # symbols outside: id len(order), never in a pair
        keys = np.array([a * self.base + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([r for r, _ in pairs.values()], np.int64)[by], 0)
        self.made = np.append(np.array([m for _, m in pairs.values()], np.int64)[by], 0)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: none) and merged symbol of each pair."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1), self.made[at]

    def count(self, tokens: list[str]) -> np.ndarray:
        """How many symbols survive in each pre-token."""
        total = np.zeros(len(tokens), np.int64)
        short = [k for k, t in enumerate(tokens) if len(t) <= LONG]
        for k, t in enumerate(tokens):
            if len(t) > LONG:
                total[k] = self._one(t)
        if not short:
            return total
        outside = len(self.ids)
        text = "".join(tokens[k] for k in short)
        symbol = np.fromiter((self.ids.get(c, outside) for c in text), np.int64, len(text))
        weight = self.weight[np.minimum(symbol, outside - 1)]
        strange = np.flatnonzero(symbol == outside)
        weight[strange] = [len(text[i].encode()) if self.byte_fallback else 1 for i in strange]
        owner = np.repeat(np.array(short, np.int64), [len(tokens[k]) for k in short])
        while len(symbol):
            joined = owner[:-1] == owner[1:]
            rank, made = self.look_up(symbol[:-1], symbol[1:])
            far = np.iinfo(np.int64).max
            key = np.append(np.where(joined & (rank >= 0), rank * len(symbol) + np.arange(len(symbol) - 1), far), far)
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(key, begin)
            length = np.diff(np.append(begin, len(symbol)))
            done = np.repeat(best == far, length)
            np.add.at(total, owner[done], weight[done])
            at = best[best != far] % len(symbol)
            symbol[at], weight[at] = made[at], 1
            stay = ~done
            stay[at + 1] = False
            symbol, weight, owner = symbol[stay], weight[stay], owner[stay]
        return total

    def _one(self, token: str) -> int:
        """The same merges for one long pre-token, from a heap of (rank, place)."""
        outside = len(self.ids)
        symbol: list = [self.ids.get(c, outside) for c in token]
        weight = [1 if s != outside and self.weight[s] == 1 else (len(c.encode()) if self.byte_fallback else 1) for s, c in zip(symbol, token, strict=True)]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (found := self.pairs.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if symbol[i] is not None else n
            if j >= n or symbol[i] != a or symbol[j] != b:
                continue
            symbol[i], weight[i], symbol[j], weight[j] = self.pairs[a, b][1], 1, None, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := self.pairs.get((symbol[x], symbol[y]))):
                    heapq.heappush(heap, (found[0], x, symbol[x], symbol[y]))
        return sum(weight)


@functools.lru_cache(2)
def sentencepiece_merges(path: str) -> Merges:
    """The merge table of a sentencepiece BPE model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Merges([model.id_to_piece(i) for i in usual], [model.get_score(i) for i in usual], any(map(model.is_byte, range(model.vocab_size()))))


_RUNS = re.compile(" *[^ ]+| +")


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with the word after them, one space put before the text; marks of the text itself are spaces."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" in words:
        return _RUNS.findall(" " + text)
    return words


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = sentencepiece_merges(path)
        known: dict[str, int] = {}
        held = 0
        for batch in batches:
            for ids, raw in common.steps(batch.column(0), batch.column(1)):
                split = [pre_tokens(b.decode()) for b in raw]
                distinct = set().union(*split)
                if held > REMEMBERED:
                    known = {w: known[w] for w in distinct.intersection(known)}
                    held = sum(map(len, known)) + ENTRY * len(known)
                new = list(distinct.difference(known))
                del distinct
                # a word without its space has one space before it; a run from the slow way begins with its own
                counts = merges.count([(w if w[:1] == " " else " " + w).replace(" ", MARK) for w in new])
                known.update(zip(new, counts.tolist(), strict=True))
                held += sum(map(len, new)) + ENTRY * len(new)
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(b) for b in raw], pa.int64()), pa.array([sum(map(known.__getitem__, s)) for s in split], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, as the sentencepiece BPE model at path splits the whole text.

    Null and empty texts have 0 tokens; repeated rows stay; the order of rows doesn't matter; other columns aren't read; an
    empty table gives an empty table. For models without normalisation that put a mark before the text and keep white space."""
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(path), "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("doc_id", id_col)
