"""Benchmark decontamination: n-gram seeds find the candidates, Smith-Waterman alignment of words scores them.

1. The test items are taken in blocks of at most BLOCK_WORDS words, so what a task holds is bounded however many there are.
2. One pass counts in how many documents each word n-gram of the block occurs (partial counts by task, summed by Spark).
   All n-grams of an item are seeds, so edits and many copies never take the last one. Those in at most RARE of the
   documents are rare; where a window has other hits only, it is aligned if the words that it shares with the item could
   reach the least score at all, which leaves no leak out.
3. One pass looks every n-gram of every whole text up among the seeds. Around the hits of a (document, item) pair the words
   are aligned locally (match +2, mismatch and gap -1); the best score over twice the item's words is the pair's score, 1
   for a full copy. Edited and partly rewritten copies score in proportion to what is left of them.

An item of fewer than SEED words is no evidence inside a longer text: it matches texts of just its words.

Words are runs of letters, digits and marks between white space and ASCII punctuation, in lower case.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: Words of a seed; share of documents up to which an n-gram is rare; least score of a leak.
SEED, RARE, LEAST = 4, 0.001, 0.4
#: Words of test items in one block: 8 bytes a word and seed, whatever the number of items.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Cells of one alignment matrix that numpy fills at once.
CELLS = 4_000_000
_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
_FILTER = 22


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all texts, and each text's bounds among them."""
    plain = [b.decode().lower().encode().translate(_PUNCTUATION) for b in texts]
    words, bounds, _ = common.hashed_words(plain)
    return words, bounds


def _whole(words: np.ndarray) -> int:
    """The hash of a short text as a whole."""
    return int(common.mixed((words * common.MIX[: len(words)]).sum(keepdims=True) + common.MIX[8 + len(words)])[0])


class Items:
    """One block of test items: hashed words, and which n-gram belongs to which items."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        self.ids, self.size = np.array(ids, np.int64), size
        self.words, self.bounds = words_of([t.encode() for t in texts])
        grams = common.shingles(self.words, size)
        where = [(k, i) for k, (a, b) in enumerate(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)) for i in range(a, b - size + 1)]
        place = np.array([i for _, i in where], np.int64)
        self.item, self.offset = np.array([k for k, _ in where], np.int64), place - self.bounds[np.array([k for k, _ in where], np.int64)] if len(where) else place
        self.gram = grams[place] if len(where) else np.zeros(0, np.uint64)
        self.short: dict[int, list[int]] = {}
        for k in np.flatnonzero((np.diff(self.bounds) > 0) & (np.diff(self.bounds) < size)).tolist():
            self.short.setdefault(_whole(self.words[self.bounds[k] : self.bounds[k + 1]]), []).append(k)
        self._index()

    def _index(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.offset = self.gram[order], self.item[order], self.offset[order]
        self.unique, first = np.unique(self.gram, return_index=True)
        self.first = np.append(first, len(self.gram))
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[(self.unique & np.uint64((1 << _FILTER) - 1)).astype(np.int64)] = True

    def seeds(self, documents: np.ndarray, total: int, rare: float) -> None:
        """Marks the rare ones of self.unique, given in how many documents each occurs."""
        self.rare = documents <= rare * total

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in grams that are among self.unique, and which of them each is."""
        maybe = np.flatnonzero(self.filter[(grams & np.uint64((1 << _FILTER) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.unique):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(self.unique, grams[maybe]), len(self.unique) - 1)
        ok = self.unique[at] == grams[maybe]
        return maybe[ok], at[ok]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment scores of pairs, in units of a full match of the item.

    Row by row over the item's words for all pairs at once; gaps along a row are a running maximum."""
    m, w = max(map(len, items)), max(map(len, windows))
    a, b = np.zeros((len(items), m), np.uint64), np.zeros((len(windows), w), np.uint64)
    inside, there = np.zeros((len(items), m), bool), np.zeros((len(windows), w), bool)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], inside[k, : len(x)], b[k, : len(y)], there[k, : len(y)] = x, True, y, True
    above = np.zeros((len(items), w + 1), np.int32)
    best = np.zeros(len(items), np.int32)
    slope = -GAP * np.arange(w + 1, dtype=np.int32)
    for i in range(m):
        here = np.zeros_like(above)
        here[:, 1:] = np.maximum(np.maximum(above[:, :-1] + np.where(there & (a[:, i, None] == b), MATCH, MISMATCH), above[:, 1:] + GAP), 0)
        here = np.maximum.accumulate(here + slope, axis=1) - slope
        here[~inside[:, i]] = 0
        best = np.maximum(best, here.max(1))
        above = here
    return best / (MATCH * np.array([len(x) for x in items]))


def _grams_of(texts: list[bytes], size: int):
    words, bounds = words_of(texts)
    grams = common.shingles(words, size)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    whole = owner[: len(grams)] == owner[size - 1 : size - 1 + len(grams)] if len(grams) else np.zeros(0, bool)
    return words, bounds, grams, owner, whole


def _counted(items, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        total = np.zeros(len(block.unique) + 1, np.int64)
        for batch in batches:
            for _, texts in common.steps(batch.column(0), batch.column(1)):
                _, _, grams, owner, whole = _grams_of(texts, size)
                at, which = block.hits(grams)
                ok = whole[at]
                pairs = np.unique(owner[at[ok]] * len(total) + which[ok])
                total += np.bincount(pairs % len(total), minlength=len(total))
                total[-1] += len(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["which", "n"])

    return run


def _aligned(items, size: int, least: float):
    names = ["doc_id", "item_id", "score", "seeds", "first_word", "last_word"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def possible(block: Items, words: np.ndarray, item: int, begin: int, end: int) -> bool:
        """Whether the words that the window shares with the item could give the least score."""
        mine, window = block.words[block.bounds[item] : block.bounds[item + 1]], words[begin:end]
        return min(np.isin(window, mine).sum(), np.isin(mine, window).sum()) / len(mine) >= least

    def scored(block: Items, words: np.ndarray, found: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        score = np.zeros(len(found))
        order = sorted(range(len(found)), key=lambda k: found[k][4] - found[k][3])
        part: list[int] = []
        cells = lambda ks: len(ks) * max(found[k][4] - found[k][3] for k in ks)
        for k in [*order, None]:
            if part and (k is None or cells([part[-1], k]) // 2 * (len(part) + 1) > CELLS // 64):
                score[part] = align([block.words[block.bounds[found[j][1]] : block.bounds[found[j][1] + 1]] for j in part], [words[found[j][3] : found[j][4]] for j in part])
                part = []
            part.append(k)
        return score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        for batch in batches:
            for ids, texts in common.steps(batch.column(0), batch.column(1)):
                words, bounds, grams, owner, whole = _grams_of(texts, size)
                few = np.diff(bounds)
                equal = [(d, k) for d in np.flatnonzero((few > 0) & (few < size)).tolist() for k in block.short.get(_whole(words[bounds[d] : bounds[d + 1]]), ())] if block.short else []
                if equal:
                    given = [[], [], [1.0] * len(equal), [1] * len(equal), [0] * len(equal), [int(few[d]) for d, _ in equal]]
                    given[:2] = ids.take([d for d, _ in equal]), [int(block.ids[k]) for _, k in equal]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(given, types, strict=True)], names=names)
                at, which = block.hits(grams)
                at, which = at[whole[at]], which[whole[at]]
                if not len(at):
                    continue
                many = block.first[which + 1] - block.first[which]
                entry = np.repeat(block.first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = np.repeat(at, many)
                item, doc, rare = block.item[entry], owner[at], np.repeat(block.rare[which], many)
                length = np.diff(block.bounds)[item]
                low = np.maximum(at - block.offset[entry] - length // 2, bounds[doc])
                high = np.minimum(at - block.offset[entry] + length + length // 2 + 1, bounds[doc + 1])
                order = np.lexsort((low, item, doc))
                found: list[tuple[int, int, int, int, int]] = []  # doc, item, seeds, window
                sure: list[bool] = []  # has a rare seed
                for d, i, a, b, r in zip(doc[order].tolist(), item[order].tolist(), low[order].tolist(), high[order].tolist(), rare[order].tolist(), strict=True):
                    if found and found[-1][:2] == (d, i) and a <= found[-1][4]:
                        found[-1] = (d, i, found[-1][2] + 1, found[-1][3], max(b, found[-1][4]))
                        sure[-1] = sure[-1] or r
                    else:
                        found.append((d, i, 1, a, b))
                        sure.append(r)
                found = [f for f, r in zip(found, sure, strict=True) if r or possible(block, words, f[1], f[3], f[4])]
                score = scored(block, words, found)
                best: dict[tuple[int, int], int] = {}
                for k, f in enumerate(found):
                    if score[k] >= least and (f[:2] not in best or score[k] > score[best[f[:2]]]):
                        best[f[:2]] = k
                keep = list(best.values())
                if keep:
                    doc_ids = ids.to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([doc_ids[found[k][0]] for k in keep], pa.int64()), pa.array([int(block.ids[found[k][1]]) for k in keep], pa.int64()), pa.array([float(score[k]) for k in keep]), pa.array([found[k][2] for k in keep], pa.int64()), pa.array([int(found[k][3] - bounds[found[k][0]]) for k in keep], pa.int64()), pa.array([int(found[k][4] - bounds[found[k][0]]) for k in keep], pa.int64())], names=names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = SEED, rare: float = RARE, least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, seeds, first_word, last_word): documents that hold a copy of a test item, with the place.

    Null and empty texts and items match nothing; items of fewer than size words match texts of just these words; repeated documents give a row
    each; equal items are matched each; columns other than doc_id, item_id and text aren't read; no items, no rows."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, seeds long, first_word long, last_word long")
    ids, part, words = [], [], 0

    def found(ids: list[int], part: list[str]) -> DataFrame:
        items = Items(ids, part, size)
        plain = spark.sparkContext.broadcast(items)
        counts = texts.mapInArrow(_counted(plain, size), "which long, n long").groupBy("which").agg(F.sum("n").alias("n")).toArrow()  # a row for each n-gram of the block
        held = np.zeros(len(items.unique) + 1, np.int64)
        held[counts.column("which").to_numpy()] = counts.column("n").to_numpy()
        items.seeds(held[:-1], int(held[-1]), rare)
        return texts.mapInArrow(_aligned(spark.sparkContext.broadcast(items), size, least), out.schema)

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():  # items come a block at a time
        ids.append(row["item_id"])
        part.append(row["text"])
        words += len(row["text"].split())
        if words >= block_words:
            out = out.unionByName(found(ids, part))
            ids, part, words = [], [], 0
    return out.unionByName(found(ids, part)) if ids else out


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows that hold a test item, whatever their doc_id."""
    rows, row = common.keyed(docs)
    bad = common.keep(leaks(rows.select(F.col(row).alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return rows.join(bad, row, "left_anti").select(*docs.columns)
